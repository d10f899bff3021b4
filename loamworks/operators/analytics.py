"""Statistics of datasets: field lengths, text quality, duplicates, vocabulary and processing logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loamworks.functions.text import base_name, normalised, token_count, words

WORD = r"[\p{L}\p{N}_]+"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def field_stats(items: DataFrame, fields: tuple[str, ...] = ("input", "output"), tokenizer="words") -> DataFrame:
    """(field, n, char_* and token_*): population deviation, percentiles between neighbours; one pass for all fields."""
    long = items.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.length(_text(f)).alias("chars"), token_count(_text(f), tokenizer).alias("tokens")) for f in fields])).alias("x")).select("x.*")
    p = F.percentile("chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    found = long.groupBy("field").agg(
        F.count("*").alias("n"),
        *[f("chars").alias(f"char_{k}") for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        p.alias("p"),
        *[f("tokens").alias(f"token_{k}") for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("median", F.median), ("total", F.sum))],
    )
    return found.select("*", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("char_p25", "char_median", "char_p75", "char_p95"))]).drop("p")


def histograms(items: DataFrame, type_col: str = "type", source_col: str = "source") -> DataFrame:
    """(kind, name, n): extraction types and source files, by base name; a null is unknown."""
    named = items.select(F.coalesce(F.col(type_col), F.lit("unknown")).alias("type"), base_name(F.coalesce(F.col(source_col), F.lit("unknown"))).alias("source"))
    found = named.groupingSets([["type"], ["source"]], "type", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return found.select(F.when(F.col("g") == 1, "type").otherwise("source").alias("kind"), F.coalesce("type", "source").alias("name"), "n")


def totals(items: DataFrame, fields: tuple[str, ...] = ("input", "output"), tokenizer="words") -> DataFrame:
    """(total_items, total_tokens, avg_tokens_per_item)."""
    n = sum((token_count(_text(f), tokenizer) for f in fields), F.lit(0).cast("long"))
    return items.agg(F.count("*").alias("total_items"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_tokens_per_item"))


def text_quality(items: DataFrame, field: str = "output") -> DataFrame:
    """One row: words and sentences a text; diversity and word length only over texts that have words."""
    w = words(_text(field))
    n = F.size(w)
    sentences = F.size(F.filter(F.split(_text(field), r"[.!?]+"), lambda s: F.size(words(s)) > 0))
    some = items.select(
        n.alias("n"),
        sentences.alias("s"),
        F.when(n > 0, F.size(F.array_distinct(F.transform(w, F.lower))) / n).alias("diversity"),
        F.when(n > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n).alias("word_length"),
    )
    named = {"word_mean": F.avg("n"), "word_std": F.stddev_pop("n"), "word_min": F.min("n"), "word_max": F.max("n"), "sentence_mean": F.avg("s"), "sentence_std": F.stddev_pop("s"), "diversity": F.avg("diversity"), "word_length": F.avg("word_length")}
    return some.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in named.items()])


def duplicate_rate(items: DataFrame, field: str = "output") -> DataFrame:
    """(total, unique_hashes, exact_duplicates, duplicate_rate)."""
    counts = items.groupBy(F.sha2(normalised(_text(field)), 256).alias("h")).agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("unique_hashes"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("exact_duplicates")).withColumn("duplicate_rate", F.col("exact_duplicates") / F.greatest("total", F.lit(1)))


def near_duplicate_estimate(items: DataFrame, threshold: float = 0.9, sample: int = 500, seed: int = 0, field: str = "output", pos: str = "pos") -> DataFrame:
    """(sampled, near_duplicates): pairs in a random sample of `sample` rows, scaled up by (n / sample)^2; exact for fewer rows."""
    from loamworks.functions.text import jaccard
    from loamworks.operators.dataset import hash_order

    n = items.count()
    part = items.orderBy(hash_order(seed, pos), pos).limit(sample).select(F.col(pos).alias("pos"), F.array_distinct(words(F.lower(_text(field)))).alias("w"))
    pairs = part.alias("a").join(part.alias("b"), F.col("a.pos") < F.col("b.pos")).where(jaccard(F.col("a.w"), F.col("b.w")) > threshold)
    scale = (n / sample) ** 2 if n > sample else 1.0
    return pairs.agg(F.lit(min(n, sample)).cast("long").alias("sampled"), F.floor(F.count("*") * F.lit(scale)).alias("near_duplicates"))


def vocabulary(items: DataFrame, field: str = "output", pos: str = "pos") -> DataFrame:
    """(word, n, first_pos, first_at) of every word."""
    found = items.select(F.col(pos).alias("pos"), F.posexplode(F.regexp_extract_all(F.lower(_text(field)), F.lit(f"({WORD})"))).alias("at", "word"))
    # counted in each task first, the occurrences as the least of (pos, at)
    counted = found.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    return counted.select("word", "n", F.col("first.pos").alias("first_pos"), F.col("first.at").alias("first_at"))


def top_words(items: DataFrame, n: int = 50, field: str = "output", pos: str = "pos") -> DataFrame:
    """(word, n), the most frequent; a tie goes to the word that occurs first."""
    return vocabulary(items, field, pos).orderBy(F.desc("n"), "first_pos", "first_at").limit(n).select("word", "n")


def top_bigrams(items: DataFrame, n: int = 50, field: str = "output", pos: str = "pos") -> DataFrame:
    """(bigram, n), the most frequent pairs of neighbours in an item; a tie goes to the pair that occurs first."""
    w = F.regexp_extract_all(F.lower(_text(field)), F.lit(f"({WORD})"))
    tailed = items.select(F.col(pos).alias("pos"), w.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    found = tailed.select("pos", F.posexplode(pairs).alias("at", "bigram"))
    # (pos, at) as one number where it can be, as structs are aggregated by sorting all of the pairs
    whole = isinstance(items.schema[pos].dataType, IntegralType)
    first = F.col("pos").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("at") if whole else F.struct("pos", "at")
    counted = found.groupBy("bigram").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(n).select("bigram", "n")


def processing_summary(log: DataFrame) -> DataFrame:
    """One row over (source, items, seconds, tokens, cost, error): counts, rate, times and throughput a minute."""
    ok = F.col("error").isNull()
    t = F.when(ok, F.col("seconds"))
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return log.agg(
        F.count_if(ok).alias("documents"),
        F.count_if(~ok).alias("errors"),
        F.coalesce(F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("success_rate"),
        *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(f"total_{c}") for c in ("items", "tokens", "cost")],
        some(F.avg(t)).alias("time_mean"),
        some(F.median(t)).alias("time_median"),
        some(F.min(t)).alias("time_min"),
        some(F.max(t)).alias("time_max"),
        some(F.sum(t)).alias("time_total"),
        (F.count_if(ok) / F.greatest(some(F.sum(t)), F.lit(1.0)) * 60).alias("per_minute"),
    )


def compare(datasets: dict[str, DataFrame], fields: tuple[str, ...] = ("input", "output"), tokenizer="words") -> DataFrame:
    """(name, total_items, total_tokens, size_ratio, token_ratio): ratios of each dataset to the first."""
    n = lambda: sum((token_count(_text(f), tokenizer) for f in fields), F.lit(0).cast("long"))
    parts = [d.select(F.lit(i).alias("at"), F.lit(name).alias("name"), n().alias("tokens")) for i, (name, d) in enumerate(datasets.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    found = both.groupBy("at", "name").agg(F.count("*").alias("total_items"), F.sum("tokens").alias("total_tokens"))
    first = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a dataset
    ratio = lambda c: F.first(c).over(first) / F.greatest(F.col(c), F.lit(1))
    return found.select("name", "total_items", "total_tokens", ratio("total_items").alias("size_ratio"), ratio("total_tokens").alias("token_ratio"))


def report(items: DataFrame, fields: tuple[str, ...] = ("input", "output"), markdown: bool = False, tokenizer="words") -> str:
    """A text for reading: totals, field statistics and histograms, the ten most frequent sources."""
    t = totals(items, fields, tokenizer).first()
    h = "## " if markdown else ""
    lines = [f"{'# ' if markdown else ''}Dataset statistics", "", f"Items: {t['total_items']:,}", f"Tokens: {t['total_tokens']:,}", f"Tokens per item: {t['avg_tokens_per_item']:.1f}"]
    for r in field_stats(items, fields, tokenizer).orderBy("field").collect():
        lines += ["", f"{h}{r['field']}", f"- characters: mean {r['char_mean']:.1f}, from {r['char_min']} to {r['char_max']}, median {r['char_median']:.1f}", f"- tokens: mean {r['token_mean']:.1f}, in all {r['token_total']:,}"]
    cols = items.columns
    named = items.select(F.col("type") if "type" in cols else F.lit(None).cast("string").alias("type"), F.col("source") if "source" in cols else F.lit(None).cast("string").alias("source"))
    for kind, title in (("type", "Types"), ("source", "Sources")):
        lines += ["", f"{h}{title}"] + [f"- {r['name']}: {r['n']:,}" for r in histograms(named).where(F.col("kind") == kind).orderBy(F.desc("n"), "name").limit(10).collect()]
    return "\n".join(lines) + "\n"
