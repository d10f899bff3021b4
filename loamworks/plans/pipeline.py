"""From a folder of files to a filtered, deduplicated dataset in a fine-tuning format."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.operators import cost, lineage
from loamworks.operators.dataset import Dataset
from loamworks.operators.extraction import Extractor, extract, get_extractor
from loamworks.operators.jobs import Jobs, doc_id
from loamworks.operators.quality import QualityFilterPipeline
from loamworks.schemas import ITEM_FIELDS
from loamworks.sources.loaders import load_document, load_folder


@dataclass
class Config:
    model: str = "gpt-4"
    extractors: Sequence[str | Extractor] = ("qa", "rules", "facts")
    chunk_size: int = 3000
    max_items_per_chunk: int = 10
    quality: QualityFilterPipeline | None = None
    use_quality_filter: bool = True
    with_attribution: bool = True
    jobs_path: str | None = None
    retry_failed: bool = False
    retries: int = 0
    retry_delay: float = 1.0
    threads: int = 5
    rate_limit: float | None = None
    #: Quality filters read the fields input and output; legacy leaves other shapes without them.
    legacy_fields: bool = False


def input_output(items: DataFrame) -> DataFrame:
    """input and output filled in from whatever shape an item has."""
    conv = F.col("conversation")
    asked = F.coalesce("input", "question", "instruction", "context", "topic", "original_text", F.get(conv, F.lit(0))["content"], F.lit(""))
    said = F.coalesce("output", "answer", "rule", "fact", "summary", F.array_join(F.transform(conv, lambda t: t["content"]), "\n"), F.lit(""))
    return items.withColumn("__input", asked).withColumn("__output", said)


class Processor:
    """`llm` maps a prompt to a reply; without files, processes documents or texts that are given."""

    def __init__(self, spark: SparkSession, llm: Callable[[str], str], config: Config | None = None, **options: Any) -> None:
        self.spark, self.llm = spark, llm
        self.config = config or Config(**options)
        self._extractors: dict[str, Extractor] = {}
        for e in self.config.extractors:
            self.add_extractor(e)

    def add_extractor(self, extractor: str | Extractor, **options: Any) -> None:
        own = get_extractor(extractor, **({"chunk_size": self.config.chunk_size, "max_items": self.config.max_items_per_chunk} | options)) if isinstance(extractor, str) else extractor
        self._extractors[own.name] = own

    def list_extractors(self) -> list[str]:
        return list(self._extractors)

    def set_llm(self, llm: Callable[[str], str]) -> None:
        self.llm = llm

    def _chosen(self, names: Sequence[str] | None) -> list[Extractor]:
        for n in names or ():
            if n not in self._extractors:
                self.add_extractor(n)
        return [self._extractors[n] for n in names or self._extractors]

    def estimate_cost(self, docs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """All the chosen extractors, not the first alone."""
        return cost.processing_cost(docs, self.config.model, tuple(e.name for e in self._chosen(names)))

    def process_documents(self, docs: DataFrame, names: Sequence[str] | None = None, quality: bool | None = None) -> Dataset:
        """docs: (content, source). Items in order of source, extractor, chunk and item."""
        c = self.config
        chosen = self._chosen(names)
        docs = docs.withColumn("doc_id", doc_id(F.col("source"), F.col("content")))
        jobs = Jobs(self.spark, c.jobs_path) if c.jobs_path else None
        job = None
        if jobs:
            from loamworks.operators.jobs import job_id

            job = job_id(docs, "extract", c.model).first()["job_id"]
            jobs.start(job, docs.select("doc_id").distinct().count())
            pending = jobs.pending(job, docs, c.retry_failed)
        else:
            pending = docs
        found = extract(pending, chosen, self.llm, retries=c.retries, delay=c.retry_delay, threads=c.threads, per_second=c.rate_limit)
        if jobs:
            # the statuses and the items of a document in one write; one without items is done too
            own = found.groupBy("source").agg(F.max("error").alias("error"), F.to_json(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("extractor", "chunk_index", "item_index", "item", "extra")))).alias("result"))
            rows = pending.select("doc_id", "source").join(own, "source", "left")
            jobs.append(job, rows.select("doc_id", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", F.to_json(F.struct("source", F.coalesce("result", F.lit("[]")).alias("items"))).alias("result")))
            from loamworks.schemas import ITEM

            stored = jobs.table(job).select(F.from_json("result", "source string, items string").alias("r")).select("r.source", F.explode(F.from_json("r.items", f"array<struct<extractor: string, chunk_index: int, item_index: int, item: {ITEM}, extra: string>>")).alias("x"))
            found = stored.select("source", "x.*")
        order = {e.name: i for i, e in enumerate(chosen)}
        rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
        items = found.where("item IS NOT NULL").withColumn("__at", F.struct(F.split("source", "/").alias("s"), F.try_element_at(rank, F.col("extractor")).alias("e"), "chunk_index", "item_index"))
        flat = items.select("__at", "source", F.col("extractor").alias("extractor_type"), F.col("chunk_index").alias("_chunk_index"), "extra", *[F.col(f"item.{k}").alias(k) for k in ITEM_FIELDS])
        if c.with_attribution:
            flat = flat.withColumn("_attribution_id", lineage.item_id(F.to_json(F.struct(*ITEM_FIELDS))))
        data = Dataset(flat.withColumn("pos", F.lit(0).cast("long")))
        data = Dataset(data._renumbered(flat, [F.col("__at")]).drop("__at"), {"model": c.model})
        if quality if quality is not None else c.use_quality_filter:
            checks = c.quality or QualityFilterPipeline()
            if c.legacy_fields:
                data = Dataset(checks.process(data.df), data.metadata)
            else:
                read = input_output(data.df)
                for_checks = read.select("pos", F.col("__input").alias("input"), F.col("__output").alias("output"))
                kept = checks.process(for_checks).select("pos")
                data = Dataset(data.df.join(kept, "pos", "left_semi"), data.metadata)
        return data

    def process_folder(self, folder: str, recursive: bool = True, extensions: Sequence[str] | None = None, names: Sequence[str] | None = None) -> Dataset:
        return self.process_documents(load_folder(self.spark, folder, recursive, extensions).select("content", "source"), names)

    def process_document(self, path: str, names: Sequence[str] | None = None) -> Dataset:
        """One file, without the quality filter."""
        return self.process_documents(load_document(self.spark, path).select("content", "source"), names, quality=False)

    def process_text(self, text: str, source: str = "text", names: Sequence[str] | None = None) -> Dataset:
        return self.process_documents(self.spark.createDataFrame([(text, source)], "content string, source string"), names, quality=False)


def process(spark: SparkSession, path: str, output: str, llm: Callable[[str], str], format: str = "openai", **options: Any) -> int:
    """A file or a folder to JSON lines, deduplicated; the number of lines."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ValueError(f"No such file or folder: {path}")
    own = Processor(spark, llm, **options)
    data = own.process_folder(path) if fs.getFileStatus(p).isDirectory() else own.process_document(path)
    return data.deduplicate().to_jsonl(output, format)
