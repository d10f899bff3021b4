"""Jobs that can be resumed: one table of statuses and results, appended in one write for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions.text import short_hash

STATUS = "job_id string, doc_id string, status string, error string, updated_at timestamp, result string"
#: Status of the row that says how many documents a job has.
TOTAL = "total"


def doc_id(source: Column, content: Column) -> Column:
    """16 hexadecimal digits of the source, or of the content where there is none."""
    return short_hash(F.coalesce(F.nullif(source, F.lit("")), content), 16)


def job_id(docs: DataFrame, kind: str, model: str, source: str = "source") -> DataFrame:
    """(job_id): of kind, model and all sources in order."""
    all_sources = F.array_join(F.sort_array(F.collect_list(source)), ":")
    return docs.agg(short_hash(F.concat(F.lit(f"{kind}:{model}:"), all_sources), 16).alias("job_id"))


class Jobs:
    """Statuses and results under `path`, partitioned by job."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _rows(self) -> DataFrame:
        fs, path = self._files()
        if not fs.exists(path(self.path)):
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).parquet(self.path)

    def table(self, job: str | None = None) -> DataFrame:
        """The latest status of each document."""
        rows = self._rows().where(F.col("status") != TOTAL)
        rows = rows if job is None else rows.where(F.col("job_id") == job)
        at = F.row_number().over(Window.partitionBy("job_id", "doc_id").orderBy(F.desc("updated_at"), "status"))
        return rows.withColumn("__at", at).where("__at = 1").drop("__at")

    def start(self, job: str, total: int) -> None:
        """Notes how many documents the job has, without which it never counts as complete."""
        self.append(job, self.spark.range(1).select(F.lit("").alias("doc_id"), F.lit(TOTAL).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(str(total)).alias("result")))

    def totals(self) -> DataFrame:
        """(job_id, total) of the jobs that have been started, as last noted."""
        return self._rows().where(F.col("status") == TOTAL).groupBy("job_id").agg(F.max_by(F.col("result").cast("long"), "updated_at").alias("total"))

    def append(self, job: str, rows: DataFrame) -> None:
        """(doc_id, status, error, result) of a batch: statuses and results become visible together."""
        rows.select(F.lit(job).alias("job_id"), "doc_id", "status", "error", F.current_timestamp().alias("updated_at"), "result").write.mode("append").partitionBy("job_id").parquet(self.path)

    def pending(self, job: str, docs: DataFrame, retry_failed: bool = False) -> DataFrame:
        """Documents that are neither done nor failed; failed ones too if they are to be tried again."""
        done = self.table(job)
        return docs.join(done.where("status = 'done'") if retry_failed else done, "doc_id", "left_anti")

    def process(self, job: str, docs: DataFrame, fn: Callable[[str], str], retries: int = 3, delay: float = 1.0, retry_failed: bool = False, text_col: str = "content") -> DataFrame:
        """Applies `fn` to what is pending; returns the results of this and all earlier runs."""
        from loamworks.operators.extraction import ask

        got = self.pending(job, docs, retry_failed).select("doc_id", ask(fn, retries, delay)(F.col(text_col)).alias("a"))
        self.append(job, got.select("doc_id", F.when(F.col("a.error").isNull(), "done").otherwise("failed").alias("status"), F.col("a.error").alias("error"), F.col("a.reply").alias("result")))
        return self.table(job)

    def list(self) -> DataFrame:
        """(job_id, done, failed, success_rate, updated_at, total), the latest first; total is null for a job that wasn't started."""
        return summary(self.table()).join(self.totals(), "job_id", "left").orderBy(F.desc("updated_at"), "job_id")

    def delete(self, job: str) -> None:
        fs, path = self._files()
        fs.delete(path(f"{self.path}/job_id={job}"), True)

    def cleanup(self, totals: dict[str, int] | None = None, max_age_days: float = 7) -> list[str]:
        """Deletes jobs that are complete and older than the limit; returns their ids.

        A job is complete with as many done and failed documents as `totals`, or else start(), says;
        one whose total is unknown stays.
        """
        known = totals or {}
        old = self.list().where(F.col("updated_at") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(max_age_days * 86400.0))).collect()
        of = {r["job_id"]: known.get(r["job_id"], r["total"]) for r in old}
        gone = [r["job_id"] for r in old if of[r["job_id"]] is not None and r["done"] + r["failed"] >= of[r["job_id"]]]
        for j in gone:
            self.delete(j)
        return gone


def summary(statuses: DataFrame) -> DataFrame:
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    return statuses.groupBy("job_id").agg(done.alias("done"), failed.alias("failed"), (done / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"), F.max("updated_at").alias("updated_at"))
