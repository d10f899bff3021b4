"""Quality filtering of whole tables: scores, pipelines of filters and duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions.text import let, normalised, short_hash, words
from loamworks.functions.verdicts import ContentFilter, Filter, LengthFilter, QASpecificFilter, RepetitionFilter, TokenLengthFilter, field_text
from loamworks.operators.alike import Alike
from loamworks.sources.scratch import written


class DuplicateFilter:
    """Rows that repeat an earlier one, exactly or nearly; `pos` gives the order.

    mode "sequential" compares each row with the last 100 kept ones, in order.
    mode "scalable" compares it with all earlier rows, and a row goes if it repeats a row that is itself kept.
    Both find exact repeats by hash and near ones by a prefix filter, in parallel.
    """

    name = "duplicate"

    def __init__(self, field: str = "output", similarity_threshold=0.9, mode: str = "sequential", pos: str = "pos") -> None:
        if mode not in ("sequential", "scalable"):
            raise ValueError(f"unknown mode: {mode}")
        self.threshold, self.field, self.mode, self.pos = similarity_threshold, field, mode, pos

    def mark(self, items: DataFrame) -> DataFrame:
        """`items` with a column duplicate: struct<passed, reason>."""
        return self._sequential(items) if self.mode == "sequential" else self._scalable(items)

    def _sequential(self, items: DataFrame) -> DataFrame:
        """All near pairs are found in parallel; the fold in order only gets hashes, and nothing of a row that repeats no other."""
        alike = Alike(items.select(F.col(self.pos).alias("pos"), normalised(field_text(self.field)).alias("norm")), self.threshold)
        partner = F.struct("other", "similarity")
        ends = [alike.links.select(F.col(a).alias("rep"), F.col(b).alias("other"), "similarity") for a, b in ("xy", "yx")]
        ends = ends[0].union(ends[1])
        linked = ends.select("rep").distinct().withColumn("linked", F.lit(True))
        # rows with no partner are kept for sure; a partner that more than 100 of them part from a row isn't among the last 100 kept
        sure = F.count_if(~F.col("many") & F.col("linked").isNull()).over(Window.orderBy("pos"))
        every = written(alike.groups.join(linked, "rep", "left").withColumn("sure", sure))
        first = every.where("linked AND pos = rep").select("rep", "sure", "many")
        ends = ends.join(first, "rep").join(first.toDF("other", "other_sure", "other_many"), "other")
        ends = ends.where(F.col("many") | F.col("other_many") | ((F.col("rep") > F.col("other")) & (F.col("sure") - F.col("other_sure") <= 100)))
        near = ends.groupBy("rep").agg(F.collect_list(partner).alias("near"))
        some = F.col("many") | F.col("linked").isNotNull()
        kind = every.schema["pos"].dataType.simpleString()
        keyed = every.join(near, "rep", "left").select("pos", *[F.when(some, F.col(c)).alias(c) for c in ("text_key", "rep", "n")], "near")
        # one task by nature, as each verdict needs those of all rows before it
        found = keyed.repartition(1).sortWithinPartitions("pos").mapInArrow(in_order(self.threshold), f"pos {kind}, reason string")
        found = written(found).withColumnRenamed("pos", self.pos)
        return items.join(found, self.pos).withColumn("duplicate", F.struct((F.col("reason") == "").alias("passed"), "reason")).drop("reason")

    def _scalable(self, items: DataFrame) -> DataFrame:
        alike = Alike(items.select(F.col(self.pos).alias("pos"), normalised(field_text(self.field)).alias("norm")), self.threshold)
        # the first row of each text; the others repeat it exactly
        first = written(alike.groups.withColumn("first", F.min("pos").over(Window.partitionBy("text_key"))).where("pos = first").drop("first"))
        dropped = greedy(alike.pairs(first))
        kept = first.select(F.col("pos").alias("kept_pos")).join(dropped.select(F.col("b").alias("kept_pos"), F.lit(True).alias("near")), "kept_pos", "left")
        reason = F.when(F.col("kept_pos").isNull(), "Exact duplicate").when(F.col("near"), "Near-duplicate").otherwise("")
        marked = items.join(kept, F.col(self.pos) == F.col("kept_pos"), "left").withColumn("duplicate", F.struct((reason == "").alias("passed"), reason.alias("reason")))
        return marked.drop("kept_pos", "near")


def in_order(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verdicts on rows (pos, text_key, rep, n, near) in order, against the last 100 kept ones; a null text_key repeats no other row."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last: dict = {}  # how many were kept before the last kept row of a representative
        kept = 0
        for batch in batches:
            reasons = []
            for key, rep, n, near in zip(*(batch.column(c).to_pylist() for c in ("text_key", "rep", "n", "near")), strict=True):
                if key is None:
                    kept += 1
                    reasons.append("")
                    continue
                if key in seen:
                    reasons.append("Exact duplicate")
                    continue
                others = [(rep, 1.0)] if n and threshold < 1 else []
                others += [(x["other"], x["similarity"]) for x in near or ()]
                recent = [(last[o], similarity) for o, similarity in others if last.get(o, -101) >= kept - 100]
                if recent:
                    reasons.append(f"Near-duplicate (similarity: {min(recent)[1]:.2f})")
                    continue
                seen.add(key)
                last[rep] = kept
                kept += 1
                reasons.append("")
            yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(reasons, pa.string())], ["pos", "reason"])

    return fold


def near_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of (pos, norm) whose Jaccard of words exceeds the threshold."""
    alike = Alike(docs, threshold)
    return alike.pairs(alike.groups)


def greedy(pairs: DataFrame) -> DataFrame:
    """(b) of the rows that go: in order, a row goes if an earlier kept one is in a pair with it.

    Each round decides every row whose earlier partners are all decided, so it takes as many rounds
    as the longest chain; pairs are few, and each round is written to cut the lineage.
    """
    edges = written(pairs.select("a", "b"))
    state = written(edges.select(F.col("a").alias("x")).unionAll(edges.select("b")).distinct().select("x", F.lit(None).cast("boolean").alias("goes")))
    while True:
        seen = edges.join(state.select(F.col("x").alias("a"), F.col("goes").alias("earlier")), "a")
        by = seen.groupBy(F.col("b").alias("x")).agg(F.max(F.when(F.col("earlier").isNull(), True).otherwise(False)).alias("open"), F.max(F.coalesce(~F.col("earlier"), F.lit(False))).alias("hit"))
        now = F.when(F.col("goes").isNotNull(), F.col("goes")).when(F.coalesce("hit", F.lit(False)), True).when(~F.coalesce("open", F.lit(False)), False)
        state = written(state.join(by, "x", "left").select("x", now.alias("goes")))
        if not state.where("goes IS NULL").limit(1).count():
            return state.where("goes").select(F.col("x").alias("b"))


def repetition_shares(items: DataFrame, field: str = "output") -> DataFrame:
    """`items` with word_share and ngram_share."""
    both = items.withColumn("__shares", RepetitionFilter(field).shares())
    return both.withColumn("word_share", F.col("__shares.word")).withColumn("ngram_share", F.col("__shares.gram")).drop("__shares")


def default_filters(field: str = "output") -> list[Filter]:
    return [LengthFilter(field), RepetitionFilter(field), ContentFilter(field)]


class QualityScorer:
    """`score` adds struct<overall, dimensions, passed, reasons>; any failure fails the row."""

    def __init__(self, filters: Sequence[Filter] = (), threshold: float = 0.6) -> None:
        self.filters = list(filters) or [LengthFilter(max_length=5000, min_length=20), RepetitionFilter(), ContentFilter()]
        self.threshold = threshold

    def column(self) -> Column:
        # each verdict is worked out once, though it is used four times
        return let(F.struct(*[f.verdict().alias(f"v{i}") for i, f in enumerate(self.filters)]), self._of)

    def _of(self, verdicts: Column) -> Column:
        found = [verdicts[f"v{i}"] for i in range(len(self.filters))]
        ones = [F.when(v["passed"], 1.0).otherwise(0.0) for v in found]
        overall = reduce(lambda a, b: a + b, ones) / len(ones)
        reasons = F.filter(F.array(*[F.when(~v["passed"], F.concat(F.lit(f"{f.name}: "), v["reason"])) for f, v in zip(self.filters, found, strict=True)]), lambda r: r.isNotNull())
        dims = F.create_map(*[x for f, one in zip(self.filters, ones, strict=True) for x in (F.lit(f.name), one)])
        return F.struct(overall.alias("overall"), dims.alias("dimensions"), ((overall >= self.threshold) & (F.size(reasons) == 0)).alias("passed"), reasons.alias("reasons"))

    def score(self, items: DataFrame) -> DataFrame:
        return items.withColumn("score", self.column())

    score_batch = score

    def filter_batch(self, items: DataFrame, return_failed: bool = False) -> DataFrame:
        scored = self.score(items)
        return scored.where(~F.col("score.passed") if return_failed else F.col("score.passed"))


class QualityFilterPipeline:
    """Filters in order; a row is charged to the first that rejects it.

    With stop_on_first_fail=False every filter's rejections count. A DuplicateFilter comes last and,
    if it stops at the first failure, sees only what the others passed.
    """

    def __init__(self, filters: Sequence[Filter | DuplicateFilter] = (), stop_on_first_fail: bool = True, pos: str = "pos") -> None:
        self.filters = list(filters) or [*default_filters(), DuplicateFilter(pos=pos)]
        self.stop, self.pos = stop_on_first_fail, pos

    def verdicts(self, items: DataFrame) -> DataFrame:
        """`items` with first_fail (null if it passed) and failed: the names of the filters that reject it."""
        plain = [f for f in self.filters if isinstance(f, Filter)]
        failed = F.filter(F.array(*[F.when(~f.verdict()["passed"], f.name) for f in plain]) if plain else F.array().cast("array<string>"), lambda n: n.isNotNull())
        out = items.withColumn("failed", failed)
        for dup in (f for f in self.filters if isinstance(f, DuplicateFilter)):
            # written, so that the filters work once; of the text only what is compared
            wanted = F.size("failed") == 0 if self.stop else F.lit(True)
            so_far = written(out.select(dup.pos, "failed", wanted.alias("wanted"), F.when(wanted, F.col(dup.field)).alias(dup.field)))
            marked = dup.mark(so_far.where("wanted").select(dup.pos, dup.field)).select(dup.pos, (~F.col("duplicate.passed")).alias("is_duplicate"))
            judged = so_far.select(dup.pos, "failed").join(marked, dup.pos, "left")
            judged = judged.select(dup.pos, F.when(F.col("is_duplicate"), F.concat("failed", F.array(F.lit(dup.name)))).otherwise(F.col("failed")).alias("failed"))
            out = out.drop("failed").join(judged, dup.pos, "left")
        return out.withColumn("first_fail", F.try_element_at("failed", F.lit(1)))

    def process(self, items: DataFrame) -> DataFrame:
        return self.verdicts(items).where("first_fail IS NULL").drop("first_fail", "failed")

    def stats(self, items: DataFrame) -> DataFrame:
        """(filter, failed) for each filter, and rows total_input, total_passed, total_failed."""
        v = self.verdicts(items)
        named = [f.name for f in self.filters]
        hit = (lambda n: F.col("first_fail") == n) if self.stop else (lambda n: F.array_contains("failed", n))
        one = v.agg(F.count("*").alias("total_input"), F.count_if(F.col("first_fail").isNull()).alias("total_passed"), F.count_if(F.col("first_fail").isNotNull()).alias("total_failed"), *[F.count_if(hit(n)).alias(f"failed_{n}") for n in named])
        names = ["total_input", "total_passed", "total_failed", *[f"failed_{n}" for n in named]]
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.name", "x.n")


def qa_quality_pipeline(pos: str = "pos") -> QualityFilterPipeline:
    return QualityFilterPipeline([LengthFilter(min_length=20, max_length=5000), QASpecificFilter(), RepetitionFilter(), ContentFilter(), DuplicateFilter(pos=pos)])


def instruction_quality_pipeline(pos: str = "pos") -> QualityFilterPipeline:
    return QualityFilterPipeline([LengthFilter(min_length=50, max_length=8000), TokenLengthFilter(min_tokens=20, max_tokens=2000), RepetitionFilter(), ContentFilter(), DuplicateFilter(pos=pos)])


def exact_duplicates(items: DataFrame, field: str = "output", pos: str = "pos") -> DataFrame:
    """(pos, key, keep): the first of equal normalised texts is kept."""
    keyed = items.select(F.col(pos).alias("pos"), short_hash(normalised(field_text(field)), 16).alias("key"))
    return keyed.withColumn("keep", F.row_number().over(Window.partitionBy("key").orderBy("pos")) == 1)


def word_sets(items: DataFrame, field: str = "output", pos: str = "pos") -> DataFrame:
    return items.select(F.col(pos).alias("pos"), F.array_distinct(words(F.lower(field_text(field)))).alias("w"))
