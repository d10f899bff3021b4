"""More items from those there are: by synonyms, and by any language model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions.text import stripped, words
from loamworks.operators.extraction import ask

_TABLE = """
important: crucial vital essential significant
good: excellent great fine positive
bad: poor negative unfavorable adverse
big: large substantial significant major
small: little minor slight modest
fast: quick rapid swift speedy
slow: gradual unhurried leisurely sluggish
help: assist aid support facilitate
use: utilize employ apply leverage
show: demonstrate display indicate reveal
make: create produce generate develop
get: obtain acquire receive gain
think: believe consider assume suppose
know: understand recognize realize comprehend
need: require necessitate demand want
"""
SYNONYMS = {k: tuple(v.split()) for k, v in (line.split(": ") for line in _TABLE.strip().splitlines())}
#: From a prompt to a reply.
Model = Callable[[str], str]
STYLES = {"formal": "in formal language", "casual": "in casual language", "detailed": "in more detail", "brief": "as briefly as possible", "step_by_step": "as steps in order"}


def replace_synonyms(text: Column, key: Column, seed: int = 0, share: float = 0.2, synonyms: dict[str, Sequence[str]] = SYNONYMS) -> Column:
    """Known words replaced with a chance of `share`, by a hash of seed, key and place; single spaces between words."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def one(word: Column, at: Column) -> Column:
        bare = F.trim(F.lower(word), F.lit(".,!?;:"))
        other = F.try_element_at(table, bare)
        # the first 15 hexadecimal digits of a SHA-256 hash
        digits = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), at.cast("string")), 256)
        h = F.pmod(F.conv(F.left(digits, F.lit(15)), 16, 10).cast("long"), F.lit(1_000_000))
        pick = F.get(other, F.pmod(F.floor(h / 7), F.size(other)).cast("int"))
        cased = F.when(F.left(word, F.lit(1)).rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(pick, F.lit(1))), F.substring(pick, 2, 10_000))).otherwise(pick)
        tail = F.regexp_extract(word, r"([.,!?;:])$", 1)
        return F.when(other.isNotNull() & (h < int(share * 1_000_000)), F.concat(cased, tail)).otherwise(word)

    return F.array_join(F.transform(words(text), one), " ")


@dataclass
class Augmenter:
    """`make` turns a table of items into more of them, each with _augmentation."""

    name: str
    make: Callable[[DataFrame], DataFrame]


def synonym_augmenter(field: str = "output", variations: int = 2, share: float = 0.2, seed: int = 0, pos: str = "pos") -> Augmenter:
    def make(items: DataFrame) -> DataFrame:
        each = items.withColumn("__v", F.explode(F.sequence(F.lit(1), F.lit(variations))))
        new = replace_synonyms(F.col(field), F.concat_ws(":", F.col(pos).cast("string"), F.col("__v").cast("string")), seed, share)
        return each.withColumn("__new", new).where(F.col("__new") != F.col(field)).withColumn(field, F.col("__new")).withColumn("_augmentation", F.lit("synonym")).drop("__new", "__v")

    return Augmenter("synonym", make)


def _asked(items: DataFrame, prompt: Column, llm: Model) -> DataFrame:
    return items.withColumn("__reply", stripped(ask(llm)(prompt)["reply"]))


def _new(items: DataFrame, field: str, tag: Column) -> DataFrame:
    fresh = items.where((F.col("__reply") != "") & (F.col("__reply") != F.col(field)))
    return fresh.withColumn(field, F.col("__reply")).withColumn("_augmentation", tag).drop("__reply")


def paraphrase_augmenter(llm: Model, field: str = "output", variations: int = 2) -> Augmenter:
    def make(items: DataFrame) -> DataFrame:
        each = items.withColumn("__v", F.explode(F.sequence(F.lit(1), F.lit(variations))))
        return _new(_asked(each, F.concat(F.lit("Say this in other words (version "), F.col("__v").cast("string"), F.lit("), and nothing else:\n\n"), F.col(field)), llm).drop("__v"), field, F.lit("paraphrase"))

    return Augmenter("paraphrase", make)


def question_augmenter(llm: Model, field: str = "input", variations: int = 3) -> Augmenter:
    """One call; its numbered lines are the variations."""

    def make(items: DataFrame) -> DataFrame:
        got = _asked(items, F.concat(F.lit(f"Write {variations} other ways to ask this question, as a numbered list:\n\n"), F.col(field)), llm)
        lines = F.regexp_extract_all("__reply", F.lit(r"(?md)^[0-9]+[\s:).]+(.+)$"), F.lit(1))
        return _new(got.withColumn("__reply", F.explode(F.slice(F.transform(lines, stripped), 1, variations))), field, F.lit("question_variation"))

    return Augmenter("question_variation", make)


def back_translation_augmenter(llm: Model, field: str = "output", languages: Sequence[str] = ("French", "German", "Spanish")) -> Augmenter:
    """Texts of at least 20 characters, to each language and back."""

    def make(items: DataFrame) -> DataFrame:
        each = items.where(F.length(field) >= 20).withColumn("__lang", F.explode(F.array(*map(F.lit, languages))))
        there = _asked(each, F.concat(F.lit("Translate into "), F.col("__lang"), F.lit(":\n\n"), F.col(field)), llm).withColumnRenamed("__reply", "__there")
        return _new(_asked(there.where("__there <> ''"), F.concat(F.lit("Translate into English:\n\n"), F.col("__there")), llm), field, F.concat(F.lit("back_translation_"), F.lower("__lang"))).drop("__lang", "__there")

    return Augmenter("back_translation", make)


def negation_augmenter(llm: Model, field: str = "output") -> Augmenter:
    def make(items: DataFrame) -> DataFrame:
        return _new(_asked(items, F.concat(F.lit("State the opposite of this, and nothing else:\n\n"), F.col(field)), llm), field, F.lit("negation")).withColumn("_is_negation", F.lit(True))

    return Augmenter("negation", make)


def style_augmenter(llm: Model, field: str = "output", styles: Sequence[str] = tuple(STYLES)) -> Augmenter:
    """Texts of at least 30 characters, in each style; an unknown style is a KeyError."""
    how = {s: STYLES[s] for s in styles}

    def make(items: DataFrame) -> DataFrame:
        each = items.where(F.length(field) >= 30).withColumn("__style", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in how.items()])))
        return _new(_asked(each, F.concat(F.lit("Rewrite this "), F.col("__style.v"), F.lit(":\n\n"), F.col(field)), llm), field, F.concat(F.lit("style_"), F.col("__style.k"))).drop("__style")

    return Augmenter("style", make)


def cut_off(variations: DataFrame, target: int, already: int = 0, pos: str = "pos") -> DataFrame:
    """All variations of an item stay if fewer than `target` rows came before that item; of the first item always.

    Running counts are of items, not rows: range-partitioned sums, joined back by item.
    """
    from loamworks.sources.scratch import written

    per = written(variations.groupBy(pos).agg(F.count("*").alias("__n")).orderBy(pos).withColumn("__part", F.spark_partition_id()))
    parts = per.groupBy("__part").agg(F.sum("__n").alias("__m"))
    ahead = parts.select("__part", (F.sum("__m").over(Window.orderBy("__part")) - F.col("__m")).alias("__ahead"))  # a row a partition
    inside = Window.partitionBy("__part").orderBy(pos)
    before = per.join(ahead, "__part").select(pos, (F.col("__ahead") + F.sum("__n").over(inside) - F.col("__n") + already).alias("__before"))
    return variations.join(before.where((F.col("__before") < target) | (F.col("__before") == already)).select(pos), pos, "left_semi")


def augment(items: DataFrame, augmenters: Sequence[Augmenter], factor: float = 2.0, include_original: bool = True, shuffle_seed: int | None = None, pos: str = "pos") -> DataFrame:
    """Items and their variations, about n x factor rows; of each item at most max(1, n (factor - 1) / n) are taken."""
    from loamworks.operators.dataset import hash_order

    n = items.count()
    base = items.withColumn("_augmentation", F.lit(None).cast("string"))
    if not n:
        return base
    target = int(n * factor)
    per_item = max(1, (target - n) // n)
    made = None
    for a in augmenters:
        part = a.make(items).withColumn("__by", F.lit(a.name))
        made = part if made is None else made.unionByName(part, allowMissingColumns=True)
    if made is None:
        return base if include_original else base.where("false")
    order = F.xxhash64(F.col(pos), F.col("__by"), *[F.col(c) for c in items.columns if c != pos])
    few = made.withColumn("__at", F.row_number().over(Window.partitionBy(pos).orderBy(order))).where(F.col("__at") <= per_item).drop("__at", "__by")
    out = cut_off(few, target, n if include_original else 0, pos)
    out = base.unionByName(out, allowMissingColumns=True) if include_original else out
    return out if shuffle_seed is None else out.orderBy(hash_order(shuffle_seed, pos))


def default_augmenters(llm: Model | None = None) -> list[Augmenter]:
    return ([paraphrase_augmenter(llm, variations=1)] if llm else []) + [synonym_augmenter(variations=2)]


def qa_augmenters(llm: Model) -> list[Augmenter]:
    return [question_augmenter(llm, variations=2), paraphrase_augmenter(llm, variations=1), synonym_augmenter(variations=1)]
