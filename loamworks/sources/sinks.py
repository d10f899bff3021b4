"""Writing datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, single: bool = False, column: str = "formatted") -> int:
    """JSON lines, counted as they are written; nulls are written out. `single` puts all into one file."""
    seen = Observation()
    lines = df.select(F.to_json(column, {"ignoreNullFields": "false"}).alias("value")).observe(seen, F.count("*").alias("n"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)
    return seen.get["n"]


def write_splits(df: DataFrame, path: str, format: str = "jsonl", split_col: str = "split") -> None:
    """A folder for each split; another format than jsonl or parquet is a ValueError."""
    if format not in ("jsonl", "parquet"):
        raise ValueError(f"Unsupported format: {format}")
    out = df.write.mode("overwrite").partitionBy(split_col)
    out.json(path) if format == "jsonl" else out.parquet(path)
