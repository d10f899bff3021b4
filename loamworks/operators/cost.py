"""Token counts and estimated costs of extraction, by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions.text import token_count

#: US dollars for a million tokens read and written.
_PRICES = """
gpt-4o 2.5 10|gpt-4o-mini .15 .6|gpt-4-turbo 10 30|gpt-4 30 60|gpt-3.5-turbo .5 1.5
claude-3-opus 15 75|claude-3-sonnet 3 15|claude-3-haiku .25 1.25|claude-3-5-sonnet 3 15
mistral-large 4 12|mistral-medium 2.7 8.1|mistral-small 1 3
llama-3-70b .9 .9|llama-3-8b .2 .2|gemini-pro .5 1.5|gemini-1.5-pro 3.5 10.5
"""
PRICING = {name: (float(a), float(b)) for name, a, b in (p.split() for line in _PRICES.split("\n") for p in line.split("|") if p.strip())}
UNKNOWN = (5.0, 15.0)
#: Output tokens for each input token, by extraction type; both spellings of two of them.
OUTPUT_SHARE = {"qa": 0.8, "rules": 0.5, "facts": 0.6, "summary": 0.3, "custom": 0.7} | dict.fromkeys(("instructions", "instruction"), 1.0) | dict.fromkeys(("conversations", "conversation"), 1.5)
DEFAULT_SHARE = 0.7
PROMPT_TOKENS = 500


def price(model: str, legacy: bool = False) -> tuple[float, float]:
    """Exact name, else the longest known name that is part of it or it is part of; legacy: the first such."""
    if model in PRICING:
        return PRICING[model]
    found = [k for k in PRICING if k in model.lower() or model.lower() in k]
    if not found:
        return UNKNOWN
    return PRICING[found[0] if legacy else max(found, key=len)]


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRICING.items()], "model string, input double, output double")


def count_batch(texts: DataFrame, text_col: str = "content", tokenizer="chars4") -> DataFrame:
    return texts.withColumn("tokens", token_count(F.col(text_col), tokenizer))


def message_tokens(messages: Column, tokenizer="chars4") -> Column:
    """Of array<struct<role, content>>: 4 a message besides its role and content, and 2 in all."""
    each = F.transform(messages, lambda m: (4 + token_count(m["role"], tokenizer) + token_count(m["content"], tokenizer)).cast("long"))
    return F.aggregate(each, F.lit(2).cast("long"), lambda a, x: a + x)


def estimates(docs: DataFrame, extraction_type: str = "qa", text_col: str = "content", prompt_tokens: int = PROMPT_TOKENS, tokenizer="chars4", legacy: bool = False) -> DataFrame:
    """`docs` with input_tokens and output_tokens; at least 100 are written. legacy: singular names have no share of their own."""
    share = DEFAULT_SHARE if legacy and extraction_type in ("instruction", "conversation") else OUTPUT_SHARE.get(extraction_type, DEFAULT_SHARE)
    n = token_count(F.col(text_col), tokenizer)
    out = F.greatest(F.floor(n * F.lit(share)), F.lit(100).cast("long"))
    return docs.withColumn("input_tokens", (n + prompt_tokens).cast("long")).withColumn("output_tokens", out)


def extraction_cost(docs: DataFrame, model: str = "gpt-4", types: tuple[str, ...] = ("qa",), text_col: str = "content", prompt_tokens: int = PROMPT_TOKENS, tokenizer="chars4") -> DataFrame:
    """(extraction_type, documents, input_tokens, output_tokens, input_cost, output_cost, total_cost): one scan for all types."""
    spark = docs.sparkSession
    a, b = price(model)
    kinds = spark.createDataFrame([(t, OUTPUT_SHARE.get(t, DEFAULT_SHARE)) for t in types], "extraction_type string, share double")
    n = docs.select(token_count(F.col(text_col), tokenizer).cast("long").alias("n"))
    each = n.crossJoin(F.broadcast(kinds))  # as many rows as types
    found = each.groupBy("extraction_type").agg(F.count("*").alias("documents"), F.sum(F.col("n") + prompt_tokens).alias("input_tokens"), F.sum(F.greatest(F.floor(F.col("n") * F.col("share")), F.lit(100).cast("long"))).alias("output_tokens"))
    cost = found.withColumn("input_cost", F.col("input_tokens") * F.lit(a) / 1e6).withColumn("output_cost", F.col("output_tokens") * F.lit(b) / 1e6)
    return cost.withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def processing_cost(docs: DataFrame, model: str = "gpt-4", types: tuple[str, ...] = ("qa", "rules", "facts", "instructions"), **options) -> DataFrame:
    """extraction_cost() by type, and a row with the type null for all."""
    return extraction_cost(docs, model, types, **options).groupingSets([["extraction_type"], []], "extraction_type").agg(F.max("documents").alias("documents"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "input_cost", "output_cost", "total_cost")])


def describe(costs: DataFrame, model: str) -> str:
    rows = costs.collect()  # a row a type
    lines = [f"Estimated cost with {model}"]
    for r in rows:
        lines.append(f"- {r['extraction_type'] or 'all'}: {r['documents']:,} documents, {r['input_tokens']:,} + {r['output_tokens']:,} tokens, ${r['total_cost']:.4f}")
    return "\n".join(lines)
