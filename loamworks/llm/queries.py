"""One query for each operator, with production parameters over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamworks.llm import decontamination, language_id, lm_scoring, near_dedup, neighbours, quality, suffix_dedup
from loamworks.llm._io import table
from loamworks.llm.packing import pack_documents
from loamworks.llm.token_counts import count_tokens
from loamworks.llm.token_output import encode_documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id 100 divides are the queries, against all rows."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=100)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_output": op2_token_output,
    "op3_language_id": op3_language_id,
    "op4_neighbours": op4_neighbours,
    "op5_packing": op5_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE_SQL,
    "op6_near_dedup": near_dedup.ORACLE_SQL,
    "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
}
