"""The test tables as the operators want them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, content, source)"""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("content"), F.format_string("%s/%d.txt", "source", "doc_id").alias("source"))


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, output, source, type)"""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("output"), "source", F.col("lang").alias("type"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, conversation)"""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    each = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("pos")).agg(turns.alias("t"))
    return each.select("pos", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("conversation"))


def pairs(spark: SparkSession, sf_dir: str, asked: str = "input", said: str = "output") -> DataFrame:
    """(pos, asked, said): each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    t = t.where("role = 'user' AND next_role = 'assistant'")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias(asked), F.col("next_text").alias(said))


ITEMS = "items AS (SELECT doc_id AS pos, text AS output, source, lang AS type FROM documents)"
DOCS = "docs AS (SELECT doc_id AS pos, text AS content, source || '/' || doc_id || '.txt' AS source FROM documents)"
CONVS = "convs AS (SELECT conv_id AS pos, list({'role': role, 'content': text} ORDER BY turn) AS c FROM conversations GROUP BY conv_id)"
PAIRS = """turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id * 1000 + turn AS pos, text AS input, next_text AS output FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def sql_words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


def sql_norm(text: str) -> str:
    return f"array_to_string({sql_words(f'lower({text})')}, ' ')"
