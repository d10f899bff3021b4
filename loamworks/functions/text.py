"""Column expressions for text: words, normalising, hashing and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Array of the runs between white space; empty for a text without any."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised(text: Column) -> Column:
    """Lower case, with single spaces."""
    return F.array_join(words(F.lower(text)), " ")


def stripped(text: Column) -> Column:
    """`text` without white space of any kind at its ends."""
    head = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "")
    return F.regexp_replace(head, r"(?U)[\s\x1c-\x1f]+\z", "")


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def tokens_by_words(text: Column) -> Column:
    return F.size(words(text))


def tokens_by_chars(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


TOKENIZERS = {"words": tokens_by_words, "chars4": tokens_by_chars}


def tiktoken_tokens(path: str, pattern: str):
    """A counter for `tokenizer=`, from a vocabulary file that all executors have."""
    import functools

    import pandas as pd

    @functools.cache
    def encoder():
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoder()
        return texts.map(lambda t: None if t is None else len(e.encode_ordinary(t)))

    return count


def token_count(text: Column, tokenizer="words") -> Column:
    """By name, `words` or `chars4`, or by any function of a column."""
    return (TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer)(text)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repetitions; 0 if either is empty."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def most_frequent(items: Column) -> Column:
    """Occurrences of the most frequent element: the longest run once they are sorted; 0 without elements."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(seen: Column, item: Column) -> Column:
        run = F.when(seen["last"] == item, seen["run"] + 1).otherwise(1)
        return F.struct(item.alias("last"), run.alias("run"), F.greatest(seen["best"], run).alias("best"))

    return F.aggregate(F.sort_array(items), start, step, lambda seen: seen["best"])


def ngrams(items: Column, n: int) -> Column:
    """Runs of n neighbours, joined by spaces; empty if there are fewer.

    Made by zipping the array with itself moved on, as a lambda that looks into `items` would work
    them out again for each place.
    """
    runs = items
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(items, k + 1, F.greatest(F.size(items), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(runs, lambda r: r.isNotNull())
