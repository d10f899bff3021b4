"""Streams of documents and logs, with the same column functions as in batch; an extension."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamworks.functions.text import normalised
from loamworks.functions.verdicts import Filter, field_text


def stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def filtered(items: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows that all stateless filters pass."""
    for f in filters:
        items = items.where(f.verdict()["passed"])
    return items


def deduplicated(items: DataFrame, time_col: str, horizon: str, field: str = "output") -> DataFrame:
    """The first of equal normalised texts within the horizon; state is dropped behind the watermark."""
    return items.withColumn("__key", F.sha2(normalised(field_text(field)), 256)).withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def windowed_log(log: DataFrame, time_col: str = "ts", width: str = "1 hour", late: str = "2 hours", slide: str | None = None, error: Column | None = None) -> DataFrame:
    """(start, end, documents, errors) for each window of processing-log rows."""
    bad = F.col("error").isNotNull() if error is None else error
    frame = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    found = log.withWatermark(time_col, late).groupBy(frame.alias("w")).agg(F.count_if(~bad).alias("documents"), F.count_if(bad).alias("errors"))
    return found.select("w.start", "w.end", "documents", "errors")


def run_available(items: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what there is and stops; a rerun continues after the last committed batch.

    `write` gets a batch and its number, and must give the same result if a batch comes twice.
    """
    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
