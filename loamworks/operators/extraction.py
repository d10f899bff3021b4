"""Chunks to items: a prompt, a language model as a column function, and a lenient parser.

The model is any function from a prompt to a text; it runs in Arrow batches on the executors.
Its results are written before anything else reads them, so no reply is asked for twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.operators.chunking import chunk
from loamworks.schemas import ITEM, ITEM_FIELDS

CATEGORIES = ("policy", "procedure", "requirement", "guideline", "constraint")


def _plain(value: Any) -> str:
    return str(value).strip()


def parse_array(reply: str | None) -> list[Any]:
    """The JSON array from the first [ to the last ]; failing that, every flat object that parses alone."""
    if not reply:
        return []
    a, b = reply.find("["), reply.rfind("]")
    if 0 <= a < b:
        try:
            found = json.loads(reply[a : b + 1])
            return found if isinstance(found, list) else []
        except ValueError:
            pass
    out = []
    for m in re.finditer(r"\{[^}{]+\}", reply):
        try:
            out.append(json.loads(m.group()))
        except ValueError:
            continue
    return out


def _qa(x: dict) -> dict | None:
    return {k: _plain(x[k]) for k in ("question", "answer")} if "question" in x and "answer" in x else None


def _rule(x: dict) -> dict | None:
    if "rule" not in x:
        return None
    return {"rule": _plain(x["rule"]), "context": _plain(x.get("context", "")), "category": _plain(x.get("category", "general")).lower(), "rationale": _plain(x.get("rationale", ""))}


def _fact(x: dict) -> dict | None:
    if "fact" not in x:
        return None
    return {"fact": _plain(x["fact"]), "topic": _plain(x.get("topic", "general")), "confidence": _plain(x.get("confidence", "medium")).lower()}


def _instruction(x: dict) -> dict | None:
    if "instruction" not in x or "output" not in x:
        return None
    return {"instruction": _plain(x["instruction"]), "input": _plain(x.get("input", "")), "output": _plain(x["output"])}


def _conversation(x: Any) -> dict | None:
    turns = x.get("conversation") if isinstance(x, dict) and "conversation" in x else x
    if not isinstance(turns, list) or len(turns) < 2 or not all(isinstance(t, dict) and "role" in t and "content" in t for t in turns):
        return None
    return {"conversation": [{"role": str(t["role"]), "content": str(t["content"])} for t in turns]}


def _summary(x: dict) -> dict | None:
    if "summary_type" not in x or "summary" not in x:
        return None
    return {"summary_type": _plain(x["summary_type"]), "original_text": _plain(x.get("original_text", "")), "summary": _plain(x["summary"])}


@dataclass
class Extractor:
    """`shape` turns one parsed element into an item, or None; what it can't read is left out."""

    name: str
    wanted: str
    keys: str
    shape: Callable[[Any], dict | None]
    max_items: int = 10
    chunk_size: int = 3000
    options: dict[str, Any] = field(default_factory=dict)
    template: str | None = None
    parser: Callable[[str], Sequence[dict]] | None = None

    def prompt(self, text: Column) -> Column:
        if self.template is not None:
            parts = re.split(r"(\{content\}|\{max_items\})", self.template)
            return F.concat(*[text if p == "{content}" else F.lit(str(self.max_items) if p == "{max_items}" else p.replace("{{", "{").replace("}}", "}")) for p in parts])
        n = self.max_items // 2 if self.name == "conversation" else self.max_items
        head = f"Read the passage below and write {'' if self.name == 'summary' else f'no more than {n} '}{self.wanted}. Reply with a JSON list only, each element an object with the keys {self.keys}.\n\nPassage:\n"
        return F.concat(F.lit(head), text)

    def parse(self, reply: str | None) -> list[dict]:
        if self.parser is not None:
            return list(self.parser(reply or ""))
        out = []
        for x in parse_array(reply):
            if isinstance(x, dict) or self.name == "conversation":
                item = self.shape(x)
                if item is not None:
                    out.append(item)
        return out


def _builders() -> dict[str, Callable[..., Extractor]]:
    def rules(categories: Sequence[str] = CATEGORIES, **kw) -> Extractor:
        return Extractor("rules", f"rules (categories: {', '.join(categories or CATEGORIES)})", "rule, context, category, rationale", _rule, **kw)

    def conversation(turns_per_conversation: int = 3, **kw) -> Extractor:
        return Extractor("conversation", f"conversations of {turns_per_conversation} exchanges", "conversation (a list of role and content)", _conversation, **kw)

    return {
        "qa": lambda **kw: Extractor("qa", "question and answer pairs", "question, answer", _qa, **kw),
        "rules": rules,
        "facts": lambda **kw: Extractor("facts", "facts", "fact, topic, confidence", _fact, **kw),
        "instruction": lambda **kw: Extractor("instruction", "instructions with their outputs", "instruction, input, output", _instruction, **kw),
        "conversation": conversation,
        "summary": lambda **kw: Extractor("summary", "summaries of several kinds", "summary_type, original_text, summary", _summary, **kw),
    }


def get_extractor(name: str, **options: Any) -> Extractor:
    known = _builders()
    if name not in known:
        raise ValueError(f"Unknown extractor type: {name}. Available: {', '.join(known)}")
    return known[name](**options)


def custom_extractor(name: str, template: str, parser: Callable[[str], Sequence[dict]] | None = None, **options: Any) -> Extractor:
    """`template` holds {content} and {max_items}; without a parser, objects are taken as they are."""
    return Extractor(name, "", "", lambda x: x, template=template, parser=parser, **options)


def ask(llm: Callable[[str], str], retries: int = 0, delay: float = 0.0, threads: int = 1, per_second: float | None = None, tasks: int = 1) -> Callable[[Column], Column]:
    """Column function: struct<reply, error> of each prompt; errors are data, tried again `retries` times.

    `per_second` limits the calls of all of `tasks` tasks that run at a time: each makes its share.
    """

    @F.pandas_udf("struct<reply: string, error: string>")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor

        from loamworks.operators.parallel import Turns

        turns = Turns(per_second, tasks)

        def one(prompt: str | None) -> tuple[str | None, str | None]:
            if prompt is None:
                return None, None
            for attempt in range(retries + 1):
                time.sleep(turns.next())
                try:
                    return llm(prompt) or "", None
                except Exception as e:  # noqa: BLE001 - whatever a client raises is the row's error
                    error = f"{type(e).__name__}: {e}"
                    if attempt < retries:
                        time.sleep(delay * (attempt + 1))
            return None, error

        with ThreadPoolExecutor(threads) as pool:
            for part in prompts:
                yield pd.DataFrame(list(pool.map(one, part)), columns=["reply", "error"])

    return run.asNondeterministic()


def parse_items(reply: Column, extractor: Extractor) -> Column:
    """array<struct<item, extra>>: the item's fields side by side, and what else it has as JSON."""

    @F.udf(f"array<struct<item: {ITEM}, extra: string>>", useArrow=True)
    def run(text: str | None) -> list[dict]:
        out = []
        for x in extractor.parse(text):
            known = {k: (x[k] if k == "conversation" else str(x[k])) if x.get(k) is not None else None for k in ITEM_FIELDS}
            rest = {k: v for k, v in x.items() if k not in ITEM_FIELDS}
            out.append({"item": known, "extra": json.dumps(rest, ensure_ascii=False) if rest else None})
        return out

    return run(reply)


def extract(docs: DataFrame, extractors: Sequence[Extractor], llm: Callable[[str], str], text_col: str = "content", source_col: str = "source", **asking: Any) -> DataFrame:
    """(source, extractor, chunk_index, item_index, item, extra, error): an item a row, and a row for each failed chunk."""
    from loamworks.sources.scratch import written

    made = None
    for e in extractors:
        cut = docs.select(F.col(source_col).alias("source"), F.posexplode(chunk(F.col(text_col), e.chunk_size)).alias("chunk_index", "chunk"))
        asked = cut.select("source", F.lit(e.name).alias("extractor"), "chunk_index", e.prompt(F.col("chunk")).alias("prompt"))
        made = asked if made is None else made.unionAll(asked)
    replies = written(made.withColumn("answer", ask(llm, **asking)(F.col("prompt"))).drop("prompt"))
    out = None
    for e in extractors:
        own = replies.where(F.col("extractor") == e.name)
        part = own.select("source", "extractor", "chunk_index", F.col("answer.error").alias("error"), F.posexplode_outer(parse_items(F.col("answer.reply"), e)).alias("item_index", "found"))
        part = part.where("found IS NOT NULL OR error IS NOT NULL").select("source", "extractor", "chunk_index", "item_index", "found.item", "found.extra", "error")
        out = part if out is None else out.unionAll(part)
    return out


def extraction_metadata(docs: DataFrame, items: DataFrame, chunk_size: int = 3000, text_col: str = "content", source_col: str = "source") -> DataFrame:
    """(source, extractor, chunk_count, total_items)."""
    sizes = docs.select(F.col(source_col).alias("source"), F.size(chunk(F.col(text_col), chunk_size)).alias("chunk_count"))
    totals = items.where("item IS NOT NULL").groupBy("source", "extractor").agg(F.count("*").alias("total_items"))
    return sizes.join(totals, "source", "left").withColumn("total_items", F.coalesce("total_items", F.lit(0)))
