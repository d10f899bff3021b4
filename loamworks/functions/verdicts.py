"""Quality predicates: each builds a column struct<passed: boolean, reason: string>."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamworks.functions.text import let, most_frequent, ngrams, stripped, token_count, words



def _any(*words_: str) -> str:
    return f"({'|'.join(words_)})"


_KEYS = _any("api[_-]?key", *"password secret token".split())
#: Patterns of which none may occur, unless others are given; the reasons quote them, so their wording is part of the interface.
BLOCKED = tuple("(?i)" + p for p in (rf"\b{_KEYS}\s*[:=]\s*\S+", rf"\b{_any('todo', 'fixme', 'xxx')}\b", _any("error", "exception", "traceback"), "lorem ipsum", r"\[placeholder\]"))
CREDENTIALS = BLOCKED[0]
ASKING = tuple("are can could did do does how is should what when where which who why would".split())


def _first(*problems: tuple[Column, Column | str]) -> Column:
    """The verdict of the first problem there is."""
    reason = F.coalesce(*[F.when(test, F.lit(why) if isinstance(why, str) else why) for test, why in problems], F.lit(""))
    return let(reason, lambda r: F.struct((r == "").alias("passed"), r.alias("reason")))


def field_text(column: Column | str, is_list: bool = False) -> Column:
    """How a field is read: a list is joined by spaces, anything else is text; a null reads "None"."""
    c = F.col(column) if isinstance(column, str) else column
    if is_list:
        return F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), " "), F.lit("None"))
    return F.coalesce(c.cast("string"), F.lit("None"))


@dataclass
class Filter:
    """A named predicate over the field `field`."""

    field: str = "output"
    name: str = dataclasses.field(default="", init=False)

    def verdict(self) -> Column:
        raise NotImplementedError

    def text(self) -> Column:
        return field_text(self.field)


@dataclass
class LengthFilter(Filter):
    min_length: int = 10
    max_length: int = 10000

    def __post_init__(self) -> None:
        self.name = "length"

    def verdict(self) -> Column:
        n = F.length(self.text())
        return _first((n < self.min_length, F.format_string(f"Too short (%d < {self.min_length})", n)), (n > self.max_length, F.format_string(f"Too long (%d > {self.max_length})", n)))


@dataclass
class TokenLengthFilter(Filter):
    min_tokens: int = 5
    max_tokens: int = 2000
    tokenizer: str | Callable = "words"

    def __post_init__(self) -> None:
        self.name = "token_length"

    def verdict(self) -> Column:
        n = token_count(self.text(), self.tokenizer)
        return _first((n < self.min_tokens, F.format_string(f"Too few tokens (%d < {self.min_tokens})", n)), (n > self.max_tokens, F.format_string(f"Too many tokens (%d > {self.max_tokens})", n)))


@dataclass
class LanguageFilter(Filter):
    """`language` and `confidence` are columns, or build them from the text; without any, confidence is 0.5."""

    allowed: Sequence[str] = ("en",)
    min_confidence: float = 0.8
    language: Callable[[Column], Column] | Column | None = None
    confidence: Callable[[Column], Column] | Column | None = None

    def __post_init__(self) -> None:
        self.name = "language"

    def verdict(self) -> Column:
        text = self.text()
        made = [x(text) if callable(x) and not isinstance(x, Column) else x for x in (self.language, self.confidence)]
        lang = F.lit("en") if made[0] is None else made[0]
        sure = made[1] if made[1] is not None else F.lit(0.5 if made[0] is None else 1.0)
        short = F.length(text) < 20
        return _first((~short & (sure < self.min_confidence), F.format_string("Low language confidence (%.2f)", sure)), (~short & ~lang.isin(*self.allowed), F.concat(F.lit("Language not allowed: "), lang)))


@dataclass
class RepetitionFilter(Filter):
    max_word_repetition: float = 0.3
    max_ngram_repetition: float = 0.2
    ngram: int = 3

    def __post_init__(self) -> None:
        self.name = "repetition"

    def shares(self) -> Column:
        """struct<word, gram>: share of the most frequent word and of the most frequent n-gram; 0 below five words."""

        def of(w: Column) -> Column:
            n, few = F.size(w), F.size(w) < 5
            grams = F.greatest(n - (self.ngram - 1), F.lit(1))
            word = F.when(few, F.lit(0.0)).otherwise(most_frequent(w) / n)
            gram = F.when(few, F.lit(0.0)).otherwise(most_frequent(ngrams(w, self.ngram)) / grams)
            return F.struct(word.alias("word"), gram.alias("gram"))

        return let(words(F.lower(self.text())), of)

    def verdict(self) -> Column:
        word, gram = (lambda s: s["word"]), (lambda s: s["gram"])
        return let(
            self.shares(),
            lambda s: _first((word(s) > self.max_word_repetition, F.format_string("High word repetition (%.2f)", word(s))), (gram(s) > self.max_ngram_repetition, F.format_string("High n-gram repetition (%.2f)", gram(s)))),
        )


@dataclass
class ContentFilter(Filter):
    """An empty list of blocked patterns means the default ones."""

    blocked: Sequence[str] = ()
    required: Sequence[str] = ()

    def __post_init__(self) -> None:
        self.name = "content"
        self.blocked = tuple(self.blocked) or BLOCKED

    def verdict(self) -> Column:
        text = self.text()
        return _first(*[(text.rlike("(?U)" + p), f"Contains blocked pattern: {p}") for p in self.blocked], *[(~text.rlike("(?U)" + p), f"Missing required pattern: {p}") for p in self.required])


@dataclass
class QASpecificFilter(Filter):
    min_question: int = 10
    min_answer: int = 20
    question_field: str = "input"
    answer_field: str = "output"

    def __post_init__(self) -> None:
        self.name = "qa_specific"

    def verdict(self) -> Column:
        q, a = field_text(self.question_field), field_text(self.answer_field)
        asked = stripped(F.lower(q))
        marked = stripped(q).endswith("?")
        for w in ASKING:
            marked = marked | asked.startswith(w)
        own = F.array_distinct(words(F.lower(a)))
        shared = F.size(F.array_intersect(F.array_distinct(words(asked)), own)) / F.greatest(F.size(own), F.lit(1))
        return _first(
            (F.length(q) < self.min_question, "Question too short"),
            (F.length(a) < self.min_answer, "Answer too short"),
            (~marked, "Question doesn't appear to be interrogative"),
            (F.contains(F.lower(a), asked) & (shared > 0.7), "Answer repeats too much of question"),
        )
