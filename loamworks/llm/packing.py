"""Best-fit packing by patterns: non-negative least squares over the histogram of lengths.

A pattern is a multiset of a few length classes that fill one sequence exactly.  How often to
repeat each pattern is fitted to the histogram of lengths by non-negative least squares and
rounded; what the rounded fit leaves over is packed best-fit, longest first, as further patterns.
All of that works on counts of lengths and takes the same time for any number of documents.  A
document then finds its sequence by its rank among those of its length class alone.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm._text import column
from loamworks.llm.token_counts import VOCABULARY, count_tokens

SEQUENCE = 2048
#: Length classes; a piece counts as the upper end of its class, so it fits wherever it is put.
CLASSES = 128
#: Most documents in a fitted pattern.
DOCUMENTS = 3
#: Pieces of one rank shard of a class: the most that one task orders at a time, about.
SHARD = 200_000


def patterns(classes: int, documents: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most `documents` classes (1..classes) that sum to `classes`."""
    found = []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(prefix)
            return
        slots = documents - len(prefix)
        if slots == 0:
            return
        for size in range(min(left, prefix[-1] if prefix else left), -(-left // slots) - 1, -1):
            grow((*prefix, size), left - size)

    grow((), classes)
    return found


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """min |a x - b|, x >= 0, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    gram, right = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, np.abs(right).max(initial=0))
    for _ in range(steps):
        slope = right - gram @ x
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= small:
            break
        free[j] = True
        while True:
            own = np.flatnonzero(free)
            target = np.linalg.solve(gram[np.ix_(own, own)] + 1e-10 * np.eye(len(own)), right[own])
            if (target > 0).all():
                x[:] = 0
                x[own] = target
                break
            bad = target <= 0
            old = x[own]
            ratio = np.min(old[bad] / np.maximum(old[bad] - target[bad], 1e-300))
            x[own] = old + ratio * (target - old)
            stuck = own[(x[own] <= 1e-12 * max(1.0, x.max())) & bad]
            x[stuck] = 0
            free[stuck] = False
            if not len(stuck):  # can't move: give up the entry that just came in
                free[j] = False
                break
    return np.maximum(x, 0)


def best_fit(histogram: np.ndarray, classes: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (pattern, repeats) that use up the histogram exactly."""
    open_by_room: dict[int, Counter] = {}
    rooms: list[int] = []
    full: Counter = Counter()

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = classes - sum(pattern)
        if room == 0:
            full[pattern] += n
            return
        if room not in open_by_room:
            open_by_room[room] = Counter()
            bisect.insort(rooms, room)
        open_by_room[room][pattern] += n

    for size in range(classes, 0, -1):
        left = int(histogram[size])
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # no open sequence has room: open new ones, as full of this class as they go
                each = classes // size
                if left // each:
                    put((size,) * each, left // each)
                if left % each:
                    put((size,) * (left % each), 1)
                break
            room = rooms[at]
            pattern, n = next(iter(open_by_room[room].items()))
            take = min(n, left)
            left -= take
            open_by_room[room][pattern] -= take
            if not open_by_room[room][pattern]:
                del open_by_room[room][pattern]
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            put((*pattern, size), take)
    for held in open_by_room.values():
        full.update(held)
    return sorted(full.items(), reverse=True)


@dataclass
class Plan:
    """(pattern, repeats) in order, and for each class where the ranks of each pattern begin."""

    chosen: list[tuple[tuple[int, ...], int]]
    fitted: int
    begins: list[np.ndarray]
    which: list[np.ndarray]
    first_bin: np.ndarray

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.chosen)


def make_plan(histogram: np.ndarray, classes: int, documents: int) -> Plan:
    """A plan that places every counted piece once; histogram[c] counts the pieces of class c."""
    total = histogram.sum()
    chosen: list[tuple[tuple[int, ...], int]] = []
    left = histogram.astype(np.int64).copy()
    if total:
        every = patterns(classes, documents)
        a = np.zeros((classes, len(every)))
        for j, pattern in enumerate(every):
            for size in pattern:
                a[size - 1, j] += 1
        # short pieces can fill any gap later, so a misfit there matters less
        weight = np.where(np.arange(1, classes + 1) <= classes // 16, 0.1, 1.0)
        fit = nnls(a * weight[:, None], histogram[1:] / total * weight) * total
        for j in np.argsort(-fit, kind="stable"):
            need = Counter(every[j])
            n = min(int(round(fit[j])), *(int(left[size] // m) for size, m in need.items()))
            if n > 0:
                chosen.append((every[j], n))
                for size, m in need.items():
                    left[size] -= n * m
    fitted = len(chosen)
    chosen += best_fit(left, classes)
    begins: list[list[int]] = [[] for _ in range(classes + 1)]
    which: list[list[int]] = [[] for _ in range(classes + 1)]
    used = np.zeros(classes + 1, np.int64)
    first_bin, bins = [], 0
    for p, (pattern, n) in enumerate(chosen):
        for size, m in Counter(pattern).items():
            begins[size].append(int(used[size]))
            which[size].append(p)
            used[size] += n * m
        first_bin.append(bins)
        bins += n
    return Plan(chosen, fitted, [np.array(x, np.int64) for x in begins], [np.array(x, np.int64) for x in which], np.array(first_bin, np.int64))


def place(plan: Plan, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, slot in it) of pieces by class and rank in the class."""
    bins, slots = np.empty(len(classes), np.int64), np.empty(len(classes), np.int64)
    for size in np.unique(classes):
        own = np.flatnonzero(classes == size)
        at = np.searchsorted(plan.begins[size], ranks[own], side="right") - 1
        p = plan.which[size][at]
        inside = ranks[own] - plan.begins[size][at]
        of_size = np.array([pattern.count(size) for pattern, _ in plan.chosen], np.int64)
        before = np.array([next((i for i, s in enumerate(pattern) if s == size), 0) for pattern, _ in plan.chosen], np.int64)
        bins[own] = plan.first_bin[p] + inside // of_size[p]
        slots[own] = before[p] + inside % of_size[p]
    return bins, slots


def pack(lengths: DataFrame, sequence: int = SEQUENCE, classes: int = CLASSES, documents: int = DOCUMENTS, shard: int = SHARD, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(id, piece, start, n_tokens, bin_id, slot, bin_offset): every token in just one place of one sequence.

    A document longer than `sequence` is cut into pieces of that length and a rest. Rows of null
    or zero length have no piece. A repeated row or a null id is packed like any other row; other
    columns are ignored. The pieces of a sequence never add up to more than `sequence` tokens.
    An empty table gives no rows.
    """
    if sequence % classes:
        raise ValueError("classes must divide the sequence's length")
    step = sequence // classes
    rows = lengths.select(F.col(id_col).alias("__id"), F.col(length_col).cast("long").alias("__n")).where("__n > 0")
    cut = rows.select("__id", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / sequence))).alias("piece"))
    piece = cut.select(
        "__id",
        "piece",
        (F.col("piece") * sequence).alias("start"),
        F.least(F.lit(sequence).cast("long"), F.col("__n") - F.col("piece") * sequence).alias("length"),
    ).withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    from loamworks.llm._io import Scratch

    kept = Scratch(lengths.sparkSession, "packing").keep(piece, "pieces")
    counts = {r["class"]: r["n"] for r in kept.groupBy("class").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(classes + 1, np.int64)
    for size, n in counts.items():
        histogram[size] = n
    plan = make_plan(histogram, classes, documents)

    # a rank within each class: shards of bounded size are ordered alone, behind the counts of the shards before
    shards = max(1, -(-int(histogram.max(initial=0)) // shard))
    sharded = kept.withColumn("shard", F.pmod(F.xxhash64("__id", "piece", "length"), F.lit(shards)).cast("int"))
    size = sharded.groupBy("class", "shard").agg(F.count("*").alias("n"))
    ahead = size.select("class", "shard", (F.sum("n").over(Window.partitionBy("class").orderBy("shard")) - F.col("n")).alias("ahead"))
    order = Window.partitionBy("class", "shard").orderBy("__id", "piece", "length")
    ranked = sharded.withColumn("in_shard", F.row_number().over(order) - 1).join(ahead, ["class", "shard"])
    ranked = ranked.select("__id", "piece", "start", "length", "class", (F.col("ahead") + F.col("in_shard")).alias("rank"))

    held = lengths.sparkSession.sparkContext.broadcast(plan)  # at most a few thousand patterns, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, slots = place(held.value, column(batch, "class").to_numpy(), column(batch, "rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bins), pa.array(slots)], names=[*batch.schema.names[:4], "bin_id", "slot"])

    kind = lengths.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(run, f"__id {kind}, piece long, start long, length long, bin_id long, slot long")
    inside = Window.partitionBy("bin_id").orderBy("slot")
    return placed.select(
        F.col("__id").alias(id_col),
        "piece",
        "start",
        F.col("length").alias("n_tokens"),
        "bin_id",
        "slot",
        (F.sum("length").over(inside) - F.col("length")).alias("bin_offset"),
    )


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, path: str = VOCABULARY) -> DataFrame:
    """pack() of the documents' token counts; see there and count_tokens() for odd rows."""
    return pack(count_tokens(docs, path), sequence)
