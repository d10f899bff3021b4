"""Fine-tuning formats as projections: one column expression each, null where an item has no such form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.schemas import ITEM_FIELDS


class Item:
    """The fields of a row's item; a field that the table lacks is null, so its shape is never taken."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.columns else F.lit(None).cast(ITEM_FIELDS.get(name, "string"))

    def has(self, *names: str) -> Column:
        test = F.lit(True)
        for n in names:
            test = test & self[n].isNotNull()
        return test

    def get(self, name: str, default: str = "") -> Column:
        return F.coalesce(self[name], F.lit(default))

    def filled(self, name: str) -> Column:
        return self.get(name) != ""

    def with_input(self, label: str) -> Column:
        return F.when(self.filled("input"), F.concat(self["instruction"], F.lit(f"\n\n{label}"), self["input"])).otherwise(self["instruction"])

    def rule_answer(self) -> Column:
        return F.when(self.filled("rationale"), F.concat(self["rule"], F.lit("\n\nRationale: "), self["rationale"])).otherwise(self["rule"])

    def about(self, filled: str, empty: str, name: str = "context") -> Column:
        """`filled` with the field put in, or `empty` if there is none."""
        head, tail = filled.split("{}")
        return F.when(self.filled(name), F.concat(F.lit(head), self[name], F.lit(tail))).otherwise(F.lit(empty))

    def fact_question(self) -> Column:
        return F.concat(F.lit("Tell me a fact about "), self.get("topic", "this topic"), F.lit("."))


def _pair(ask: Column, reply: Column, names: tuple[str, str], roles: tuple[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias(names[0]), c.alias(names[1])) for r, c in zip(roles, (ask, reply), strict=True)])


def _messages(it: Item, roles: tuple[str, str], names: tuple[str, str], label: str, rule: str, turn_role: Callable[[Column], Column]) -> dict[str, tuple[Column, Column]]:
    """(test, messages) by shape."""
    return {
        "conversation": (it.has("conversation"), F.transform(it["conversation"], lambda t: F.struct(turn_role(t["role"]).alias(names[0]), t["content"].alias(names[1])))),
        "qa": (it.has("question", "answer"), _pair(it["question"], it["answer"], names, roles)),
        "instruction": (it.has("instruction", "output"), _pair(it.with_input(label), it["output"], names, roles)),
        "rule": (it.has("rule"), _pair(it.about(rule, "What is the rule?"), it.rule_answer(), names, roles)),
        "fact": (it.has("fact"), _pair(it.fact_question(), it["fact"], names, roles)),
        "summary": (it.has("summary"), _pair(it.about("Summarize the following:\n\n{}", "Provide a summary.", "original_text"), it["summary"], names, roles)),
    }


def _choose(found: dict[str, tuple[Column, Column]], order: tuple[str, ...]) -> Column:
    out = F.when(*found[order[0]])
    for name in order[1:]:
        out = out.when(*found[name])
    return out


def openai(it: Item, system_prompt: str | None = None) -> Column:
    found = _messages(it, ("user", "assistant"), ("role", "content"), "Input: ", "What is the rule regarding {}?", lambda r: r)
    m = _choose(found, ("qa", "instruction", "conversation", "rule", "fact", "summary"))
    if system_prompt:
        m = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))), F.coalesce(m, F.array().cast("array<struct<role: string, content: string>>")))
    return F.when(F.size(m) >= 2, F.struct(m.alias("messages")))


def _triple(ask: Column, context: Column, reply: Column) -> Column:
    return F.struct(ask.alias("instruction"), context.alias("input"), reply.alias("output"))


def _said(conversation: Column, role: str) -> Column:
    """What the role says first, or nothing."""
    return F.coalesce(F.try_element_at(F.filter(conversation, lambda t: t["role"] == role), F.lit(1))["content"], F.lit(""))


def alpaca(it: Item) -> Column:
    none = F.lit("")
    conv = it["conversation"]
    return (
        F.when(it.has("instruction", "output"), _triple(it["instruction"], it.get("input"), it["output"]))
        .when(it.has("question", "answer"), _triple(it["question"], none, it["answer"]))
        .when(it.has("rule"), _triple(it.about("What is the rule for: {}", "Explain the following rule."), none, it.rule_answer()))
        .when(it.has("fact"), _triple(it.fact_question(), none, it["fact"]))
        .when(it.has("summary"), _triple(F.lit("Summarize the following text."), it.get("original_text"), it["summary"]))
        .when(F.size(conv) >= 2, _triple(_said(conv, "user"), none, _said(conv, "assistant")))
    )


def sharegpt(it: Item) -> Column:
    found = _messages(it, ("human", "gpt"), ("from", "value"), "", "What is the rule for {}?", lambda r: F.when(r == "user", "human").otherwise("gpt"))
    m = _choose(found, ("conversation", "qa", "instruction", "rule", "fact"))
    return F.when(F.size(m) >= 2, F.struct(m.alias("conversations")))


def generic(it: Item, include_metadata: bool = False) -> Column:
    """All fields; those whose names begin with an underscore only if asked for."""
    names = [c for c in it.columns if include_metadata or not c.startswith("_")]
    if not names:
        return F.lit(None).cast("struct<none: string>")
    some = F.lit(False)
    for n in names:
        some = some | it[n].isNotNull()
    return F.when(some, F.struct(*[it[n].alias(n) for n in names]))


def llamafactory(it: Item) -> Column:
    conv = it["conversation"]
    n = F.size(conv)
    before, last = F.try_element_at(conv, F.lit(-2)), F.try_element_at(conv, F.lit(-1))
    ask = F.when(before["role"] == "user", before["content"]).otherwise(last["content"])
    reply = F.when(last["role"] == "assistant", last["content"]).otherwise(before["content"])
    # pairs that end before the last exchange: i = 0, 2, ... while i + 1 < n - 2
    pairs = F.floor((n - 2) / 2).cast("int")
    history = F.when(pairs >= 1, F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.array(F.get(conv, i * 2)["content"], F.get(conv, i * 2 + 1)["content"]))).otherwise(F.array().cast("array<array<string>>"))
    plain = alpaca(it)
    other = F.when(plain.isNotNull(), F.struct(plain["instruction"].alias("instruction"), plain["input"].alias("input"), plain["output"].alias("output"), F.array().cast("array<array<string>>").alias("history")))
    own = F.when(n >= 2, F.struct(ask.alias("instruction"), F.lit("").alias("input"), reply.alias("output"), history.alias("history")))
    return F.when(it.has("conversation"), own).otherwise(other)


def chatml(it: Item, system_prompt: str | None = "You are a helpful assistant.") -> Column:
    found = _messages(it, ("user", "assistant"), ("role", "content"), "", "{}", lambda r: r)
    m = _choose(found, ("conversation", "qa", "instruction"))
    text = F.array_join(F.transform(m, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n"))), "")
    head = f"<|im_start|>system\n{system_prompt}<|im_end|>\n" if system_prompt else ""
    return F.when(F.size(m) > 0, F.struct(F.concat(F.lit(head), text).alias("text")))


_FORMATS: dict[str, Callable[..., Column]] = {"openai": openai, "alpaca": alpaca, "sharegpt": sharegpt, "generic": generic, "llamafactory": llamafactory, "chatml": chatml}


def get_formatter(name: str) -> Callable[..., Column]:
    if name not in _FORMATS:
        raise ValueError(f"Unknown format: {name}. Available: {', '.join(_FORMATS)}")
    return _FORMATS[name]


def register_formatter(name: str, build: Callable[..., Column]) -> None:
    """`build` gets an Item and options and returns a column."""
    _FORMATS[name] = build


def list_formats() -> list[str]:
    return list(_FORMATS)


def format_items(items: DataFrame, name: str, fields: list[str] | None = None, keep: list[str] = (), **options) -> DataFrame:
    """`keep` and the column formatted; items without a form in this format are left out."""
    build = get_formatter(name)
    return items.select(*keep, build(Item(fields or [c for c in items.columns if c not in keep]), **options).alias("formatted")).where("formatted IS NOT NULL")
