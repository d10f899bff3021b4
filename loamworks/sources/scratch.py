"""Intermediate tables in the folder that all executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; only a local session, as in tests, gets a folder of its own if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        own = tempfile.mkdtemp(prefix="loamworks-")
        atexit.register(shutil.rmtree, own, True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df`, written once and read from there; the shuffle files that made it are deleted, as nothing needs them again."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/loamworks/{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)
