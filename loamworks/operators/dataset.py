"""Datasets: a table of items in an order given by `pos`, and metadata on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions.formats import Item, get_formatter


def hash_order(seed: int, pos: str = "pos") -> Column:
    """A random order that any engine with SHA-256 can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(pos).cast("string")), 256)


class Dataset:
    """`df` has pos, source, extractor_type and the items' own fields, `fields`."""

    META = ("pos", "source", "extractor_type", "metadata")

    def __init__(self, df: DataFrame, metadata: dict[str, Any] | None = None) -> None:
        self.df, self.metadata = df, dict(metadata or {})

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.META]

    def _like(self, df: DataFrame) -> Dataset:
        return Dataset(df, self.metadata)

    def filter(self, predicate: Column | str | Callable[[Row], bool]) -> Dataset:
        """A column or SQL, which Spark can push down, or a Python function of the row."""
        if isinstance(predicate, Column | str):
            return self._like(self.df.where(predicate))
        test = F.udf(lambda row: bool(predicate(row)), "boolean")
        return self._like(self.df.where(test(F.struct(*self.df.columns))))

    def filter_by_source(self, pattern: str) -> Dataset:
        """Sources that contain `pattern`."""
        return self.filter(F.contains(F.col("source"), F.lit(pattern)))

    def filter_by_type(self, extractor_type: str) -> Dataset:
        return self.filter(F.col("extractor_type") == extractor_type)

    def _renumbered(self, df: DataFrame, order: list[Column]) -> DataFrame:
        """pos from 0 in the order: ranges are sorted in parallel and offset by the sizes of those before."""
        from loamworks.sources.scratch import written

        parts = written(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()))
        sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__in").alias("__first"))
        ahead = sizes.select("__part", "__first", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__ahead"))  # a row a partition
        return parts.join(ahead, "__part").withColumn("pos", (F.col("__ahead") + F.col("__in") - F.col("__first")).cast("long")).drop("__part", "__in", "__first", "__ahead")

    def shuffle(self, seed: int = 0) -> Dataset:
        return self._like(self._renumbered(self.df, [hash_order(seed), F.col("pos")]))

    def split(self, train_ratio=0.8, seed=0) -> tuple[Dataset, Dataset]:
        """Exact sizes: floor(n * train_ratio) rows and the rest, after a shuffle."""
        mixed = self.shuffle(seed).df
        cut = int(mixed.count() * train_ratio)
        return self._like(mixed.where(F.col("pos") < cut)), self._like(mixed.where(F.col("pos") >= cut))

    def sample(self, n: int, seed: int = 0) -> Dataset:
        """min(n, rows) rows without replacement: a top-n by the random order, without a full sort."""
        return self._like(self.df.orderBy(hash_order(seed), "pos").limit(n))

    def deduplicate(self, key: Column | None = None) -> Dataset:
        """The first row of each key; by default the item's fields whose names have no leading underscore."""
        key = F.to_json(F.struct(*sorted(c for c in self.fields if not c.startswith("_"))), {"ignoreNullFields": "false"}) if key is None else key
        keyed = self.df.withColumn("__key", F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256))
        first = keyed.withColumn("__at", F.row_number().over(Window.partitionBy("__key").orderBy("pos")))
        return self._like(first.where("__at = 1").drop("__key", "__at"))

    def merge(self, other: Dataset) -> Dataset:
        """Rows of both, the other's behind; the other's metadata wins."""
        top = self.df.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("__shift"))
        behind = other.df.crossJoin(F.broadcast(top)).withColumn("pos", F.col("pos") + F.col("__shift")).drop("__shift")
        return Dataset(self.df.unionByName(behind, allowMissingColumns=True), self.metadata | other.metadata)

    def add(self, *rows: dict[str, Any]) -> Dataset:
        if not rows:
            return self
        spark = self.df.sparkSession
        schema = self.df.schema
        made = spark.createDataFrame([tuple(({"pos": i} | r).get(c) for c in schema.names) for i, r in enumerate(rows)], schema)
        return self.merge(Dataset(made))

    add_many = add

    def statistics(self) -> DataFrame:
        """(kind, name, n) with kind total, source or extractor_type, all from one pass."""
        named = self.df.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in ("source", "extractor_type")])
        found = named.groupingSets([["source"], ["extractor_type"], []], "source", "extractor_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "source").otherwise("extractor_type")
        return found.select(kind.alias("kind"), F.coalesce("source", "extractor_type", F.lit("")).alias("name"), "n")

    def formatted(self, name: str = "generic", **options: Any) -> DataFrame:
        col = get_formatter(name)(Item(self.fields), **options)
        return self.df.select("pos", col.alias("formatted")).where("formatted IS NOT NULL")

    def to_jsonl(self, path: str, format: str = "generic", single: bool = False, **options: Any) -> int:
        """JSON lines in a folder, one file a partition, or one file in all with `single`; the number of lines."""
        from loamworks.sources.sinks import write_jsonl

        return write_jsonl(self.formatted(format, **options), path, single)

    def to_json(self, path: str) -> int:
        """One file {metadata, items}, put together on the driver row by row."""
        n = 0
        with open(path, encoding="utf-8", mode="w") as out:
            out.write('{"metadata": ' + json.dumps(self.metadata, ensure_ascii=False) + ', "items": [')
            for row in self.to_envelope().orderBy("pos").toLocalIterator():
                out.write((",\n" if n else "\n") + row["item"])
                n += 1
            out.write("\n]}\n")
        return n

    def to_envelope(self) -> DataFrame:
        item = F.struct(F.struct(*self.fields).alias("data"), F.col("source"), F.col("extractor_type"))
        return self.df.select("pos", F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))

    @classmethod
    def from_jsonl(cls, spark: SparkSession, path: str, extractor_type: str = "", schema: str | None = None) -> Dataset:
        """One item for each line that isn't blank; pass a schema to spare the pass that infers it."""
        from loamworks.sources.loaders import read_jsonl

        df = read_jsonl(spark, path, schema)
        return cls(df.withColumn("source", F.lit(path)).withColumn("extractor_type", F.lit(extractor_type)))

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Dataset:
        """From {metadata, items}; missing keys have defaults."""
        whole = spark.read.option("multiLine", True).json(path)
        meta = whole.select(F.to_json("metadata")).first()[0] if "metadata" in whole.columns else None
        rows = whole.select(F.posexplode("items").alias("pos", "item"))
        have = rows.schema["item"].dataType.names
        parts = [F.col(f"item.{c}").alias(c) if c in have else F.lit("").alias(c) for c in ("source", "extractor_type")]
        return cls(rows.select(F.col("pos").cast("long").alias("pos"), *parts, "item.data.*"), json.loads(meta) if meta else {})

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[Row]:
        return self.df.orderBy("pos").toLocalIterator()

    def __getitem__(self, i: int) -> Row:
        found = self.df.orderBy("pos").offset(i).limit(1).collect() if i >= 0 else self.df.orderBy(F.desc("pos")).offset(-i - 1).limit(1).collect()
        if not found:
            raise IndexError(i)
        return found[0]

    def __repr__(self) -> str:
        return f"Dataset(fields={self.fields}, metadata={self.metadata})"
