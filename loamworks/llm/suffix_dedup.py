"""Repeated passages by a distributed difference-cover suffix array.

What is looked for: every run of LENGTH words that occurs before, at a smaller (document, place).
The union of such runs is what a document repeats.

1. Rows with the same sequence of words are read once; a later copy repeats all of itself.
2. Winnowing leaves out what can't repeat: in each run of LENGTH words the least hash of the
   25-word grams is chosen, so two equal runs choose equal grams.  Text that is in reach of no gram
   chosen twice is left out; nothing that repeats is lost.
3. The rest becomes one long text of 41-bit characters, one a word, with a separator of its own
   after each region.  Its suffixes are sorted by the difference cover {1, 2} modulo 3: triples at
   the sampled places are sorted by Spark and named, the names are the text of the next level, and
   the ranks that come back place the remaining suffixes among the sampled ones.
   A name of level l stands for 3^(l+1) words, and only the order of LENGTH-word prefixes matters
   here, so the recursion ends at the level whose names are that long.
   Spark's rows are arrays of suffixes: of one block and one task when they are dealt to the tasks
   by bounds drawn from a sample, and of one whole task once they are sorted.
4. Neighbours in the suffix array are compared on their LENGTH-word prefix.  In each run of equal
   prefixes the first occurrence stays, and the others are repeated.

Places are counted in words, as defined in _text.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.llm._io import Scratch
from loamworks.llm._text import WORD_SQL, blobs, column, flat, lowered, mix, pieces, shingle_hashes, spans, utf8, word_hashes
from loamworks.llm.near_dedup import id_order, id_types, text_head, text_keys

#: Words of the shortest passage that counts as repeated.
LENGTH = 50
#: Characters of the text in one block.
BLOCK = 1 << 18
#: A text of at most so many characters is sorted by one task.
BASE = 400_000
#: Rows that one task sorts, about.
ROWS = 600_000
#: Samples of the suffixes to a task's rows; a triple with very many is cut at every CUT-th of its own.
SAMPLES, CUT = 64, 16
#: Words of regions that one task numbers, about.
NUMBERED = 4_000_000

_MAX = np.uint64(2**64 - 1)
_CHAR = 40


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of x[i : i + width], for each i where that fits."""
    f = np.minimum if least else np.maximum
    span = 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return f(x[:-rest], x[rest:]) if rest else x


def chosen_grams(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the grams that winnowing chooses, every tie with them."""
    gram = max(1, length // 2)
    window = length - gram + 1
    n = len(words)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < length:
        return nothing
    end = np.repeat(first[1:], np.diff(first))
    acc = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[j : n - gram + 1 + j]
    value = np.minimum(mix(acc), _MAX - np.uint64(1)) | np.uint64(1)
    least = _slide(value, window, True)  # of the windows that begin at each word
    fits = np.arange(len(least)) + length <= end[: len(least)]
    least[~fits] = 0  # a window that leaves its text chooses nothing
    pad = np.zeros(window - 1, np.uint64)
    best = _slide(np.concatenate([pad, least, pad]), window, False)
    at = np.flatnonzero(value == best)
    text = np.searchsorted(first, at, side="right") - 1
    return value[at], text, at - first[text]


def _parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row) over the batch."""
    data, offsets = utf8(lowered(texts))
    for lo, hi in pieces(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = spans(part, off)
        yield lo, word_hashes(part, starts, ends), first


def _keys(docs: DataFrame, kind: str) -> DataFrame:
    """(__id, th, n) of every row, without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for _, words, first in _parts(column(batch, "__text")):
                keys += text_keys(words, first)
                counts += np.diff(first).tolist()
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["__id", "th", "n"])

    return docs.mapInArrow(run, f"__id {kind}, th binary, n long")


def _grams(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, first in _parts(column(batch, "__text")):
                value, text, place = chosen_grams(words, first, length)
                if len(value):
                    keys = text_keys(words, first)
                    short = np.array([int.from_bytes(k[:8], "little", signed=True) if k else 0 for k in keys], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(short[text]), pa.array(place.astype(np.int32))], names=["fp", "t", "place"])

    return docs.mapInArrow(run, "fp long, t long, place int")


def _repeated(grams: DataFrame) -> DataFrame:
    """(t, place) of the grams that occur at two places or more; input sorted by fp in each partition.

    Copies of a text have the same t and count as one place. Of the grams seen so far only the
    first place of the last one is remembered, so a gram may occur any number of times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (fp, t, place) of the first place of the current gram, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, t, place = (column(batch, c).to_numpy() for c in ("fp", "t", "place"))
            if last is not None:
                fp, t, place = (np.concatenate([[a], b]) for a, b in zip(last[:3], (fp, t, place), strict=True))
            begin = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            run_of = np.cumsum(np.concatenate([[True], fp[1:] != fp[:-1]])) - 1
            differs = (t != t[begin][run_of]) | (place != place[begin][run_of])
            many = np.logical_or.reduceat(differs, begin)
            if last is not None and last[3]:
                many[0] = True
            give = many[run_of]
            if last is not None and last[3]:
                give[0] = False
            last = (fp[begin[-1]], t[begin[-1]], place[begin[-1]], bool(many[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(t[give]), pa.array(place[give].astype(np.int32))], names=["t", "place"])

    return grams.mapInArrow(run, "t long, place int")


def _regions(rows: DataFrame, order: str, length: int) -> DataFrame:
    """(ord, th, start, words) of the parts in reach of a repeated gram, from (ord, th, text, hits)."""
    gram = max(1, length // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            hits = column(batch, "hits").to_pylist()
            for lo, words, first in _parts(column(batch, "text")):
                for d in range(len(first) - 1):
                    own = words[first[d] : first[d + 1]]
                    edge = np.zeros(len(own) + 1, np.int32)
                    at = np.array(hits[lo + d], np.int64)
                    np.add.at(edge, np.maximum(at - (length - gram), 0), 1)
                    np.add.at(edge, np.minimum(at + length, len(own)), -1)
                    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                    flips = np.flatnonzero(inside[1:] != inside[:-1])
                    for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
                        out[0].append(lo + d)
                        out[1].append(a)
                        out[2].append(own[a:b].tobytes())
            if out[0]:
                at = pa.array(out[0])
                yield pa.RecordBatch.from_arrays([column(batch, "ord").take(at), column(batch, "th").take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["ord", "th", "start", "words"])

    return rows.mapInArrow(run, f"ord {order}, th binary, start long, words binary")


def _numbered(regions: DataFrame) -> DataFrame:
    """Adds the partition and the place in it; each region takes its words and one separator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.array([len(x) // 8 + 1 for x in column(batch, "words").to_pylist()], np.int64)
            end = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(end - size), pa.array(size)], names=[*batch.schema.names, "part", "off", "size"])
            at = int(end[-1]) if len(end) else at

    return regions.mapInArrow(run, T.StructType([*regions.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("off", T.LongType()), T.StructField("size", T.LongType())]))


def _bases(counts: list, n_key: str) -> tuple[dict[int, int], int]:
    """Where each partition begins, from (part, count) rows, one a partition."""
    total, base = 0, {}
    for row in sorted(counts, key=lambda r: r["part"]):
        base[row["part"]] = total
        total += row[n_key]
    return base, total


def _sample(chars: np.ndarray, b: int, n: int, step: int) -> bytes:
    """(hi, lo, p) of every `step`-th suffix or so of a block; they tell where to cut the order of suffixes into tasks."""
    at = _below(b, n)
    at = at[mix((at + b * BLOCK).astype(np.uint64)) % np.uint64(step) == 0]
    return np.stack([*_pack(chars, at), at + b * BLOCK], axis=1).tobytes()


def _text_blocks(regions: DataFrame, base: dict[int, int], n: int, length: int, step: int) -> DataFrame:
    """(b, chars, prefix, sample): BLOCK characters and two more, and the prefix hashes of the block's places."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, off, raw in zip(column(batch, "part").to_pylist(), column(batch, "off").to_pylist(), column(batch, "words").to_pylist(), strict=True):
                words = np.frombuffer(raw, np.uint64)
                at = base[part] + off
                chars = np.empty(len(words) + 1, np.int64)
                chars[:-1] = (words & np.uint64((1 << _CHAR) - 1)).astype(np.int64) | (1 << _CHAR)
                chars[-1] = 1 + (at + len(words)) % ((1 << _CHAR) - 1)  # a separator, less than any word
                prefix = np.zeros(len(chars), np.uint64)
                whole = len(words) - length + 1
                if whole > 0:
                    prefix[:whole] = shingle_hashes(words, np.array([0, len(words)]), length, short=False)[0] | np.uint64(1)
                for b in range(max(0, at - 2) // BLOCK, (at + len(chars) - 1) // BLOCK + 1):
                    lo, hi = max(at, b * BLOCK), min(at + len(chars), (b + 1) * BLOCK + 2)
                    if lo < hi:
                        rows.append((b, lo - b * BLOCK, chars[lo - at : hi - at].tobytes(), prefix[lo - at : hi - at].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["b", "at", "chars", "prefix"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        chars, prefix = np.zeros(BLOCK + 2, np.int64), np.zeros(BLOCK + 2, np.uint64)
        for at, c, p in zip(table["at"].to_pylist(), table["chars"].to_pylist(), table["prefix"].to_pylist(), strict=True):
            chars[at : at + len(c) // 8] = np.frombuffer(c, np.int64)
            prefix[at : at + len(p) // 8] = np.frombuffer(p, np.uint64)
        return pa.table({"b": pa.array([b], pa.int64()), "chars": pa.array([chars.tobytes()], pa.binary()), "prefix": pa.array([prefix.tobytes()], pa.binary()), "sample": pa.array([_sample(chars, b, n, step)], pa.binary())})

    return regions.mapInArrow(emit, "b long, at long, chars binary, prefix binary").groupBy("b").applyInArrow(build, "b long, chars binary, prefix binary, sample binary")


class Values(NamedTuple):
    """Rows that hold many places and their values each, and what reads (p, v) from a batch of them."""

    rows: DataFrame
    read: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]

    def moved(self, to: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Values:
        read = self.read
        return Values(self.rows, lambda batch: (to(p, v) for p, v in read(batch)))


def _value_blocks(values: Values, name: str, n: int = 0, step: int = 0) -> DataFrame:
    """(b, name): BLOCK values and two more, 0 where there is none; with `step` also a sample, if they are a text of n characters."""
    read = values.read

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, v in read(batch):
                b = p // BLOCK
                halo = np.flatnonzero((p - b * BLOCK < 2) & (p >= BLOCK))
                b = np.concatenate([b, b[halo] - 1])
                at = np.concatenate([p, p[halo]]) - b * BLOCK
                yield blobs(b, [at.astype(np.int32), np.concatenate([v, v[halo]])], ["b", "at", "v"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(BLOCK + 2, np.int64)
        out[flat(table, "at", np.int32)] = flat(table, "v")
        b = key[0].as_py()
        more = {"sample": pa.array([_sample(out, b, n, step)], pa.binary())} if step else {}
        return pa.table({"b": pa.array([b], pa.int64()), name: pa.array([out.tobytes()], pa.binary()), **more})

    return values.rows.mapInArrow(emit, "b long, at binary, v binary").groupBy("b").applyInArrow(build, f"b long, {name} binary" + ", sample binary" * bool(step))


def _pack(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three characters of 41 bits in two numbers whose order is that of the triple."""
    c0, c1, c2 = chars[at], chars[at + 1], chars[at + 2]
    return (c0 << 22) | (c1 >> 19), ((c1 & ((1 << 19) - 1)) << 41) | c2


def _below(b: int, n: int) -> np.ndarray:
    return np.arange(max(0, min(BLOCK, n - b * BLOCK)))


def _batches(columns: list[np.ndarray], names: list[str], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + size]) for c in columns], names=names)


def _step(rows: int) -> int:
    return max(1, rows // SAMPLES)


def _samples(blocks: DataFrame) -> np.ndarray:
    """(hi, lo, p) of the blocks' samples; SAMPLES to a task's rows come to the driver."""
    return np.frombuffer(b"".join(r["sample"] for r in blocks.select("sample").collect()), np.int64).reshape(-1, 3)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """`parts` - 1 of the sampled keys, in order, with about as many keys between them."""
    if not len(keys):
        return keys
    keys = keys[np.lexsort(keys.T[::-1])]
    return keys[np.arange(1, parts) * len(keys) // parts]


def range_of(bounds: np.ndarray, hi: np.ndarray, lo: np.ndarray, third: np.ndarray) -> np.ndarray:
    """How many of the bounds each key doesn't come before."""
    low, high = (np.searchsorted(bounds[:, 0], hi, side=s) for s in ("left", "right"))
    while (active := np.flatnonzero(low < high)).size:
        middle = (low[active] + high[active]) // 2
        b, c = bounds[middle, 1], bounds[middle, 2]
        before = (lo[active] < b) | ((lo[active] == b) & (third[active] < c))
        high[active[before]] = middle[before]
        low[active[~before]] = middle[~before] + 1
    return low


def _named(blocks: DataFrame, n: int, rows: int, scratch: Scratch, tag: str) -> tuple[Values, int, list[tuple[int, int]]]:
    """The name v >= 1 of the triple at each sampled place p, how many names there are, and the triples at very many places.

    Equal triples may lie in several tasks: each tells its first and last one, so that a name goes
    on across the border, and those with an eighth of a task's rows or more.
    """
    keys = _samples(blocks)
    bounds = _bounds(keys[keys[:, 2] % 3 != 0], max(1, -(-2 * n // 3 // rows)))
    most = max(2, rows // 8)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw in zip(column(batch, "b").to_pylist(), column(batch, "chars").to_pylist(), strict=True):
                at = _below(b, n)
                at = at[(at + b * BLOCK) % 3 != 0]
                hi, lo = _pack(np.frombuffer(raw, np.int64), at)
                p = at + b * BLOCK
                yield blobs(range_of(bounds, hi, lo, p), [hi, lo, p], ["part", "hi", "lo", "p"])

    def name(key: tuple, table: pa.Table) -> pa.Table:
        hi, lo = flat(table, "hi"), flat(table, "lo")
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        fresh = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        begin = np.flatnonzero(fresh)
        at = begin[np.diff(np.append(begin, len(hi))) >= most]  # 8 at most, as the rest has no room
        told = [pa.array([np.stack([hi[x], lo[x]], axis=1).tobytes()], pa.binary()) for x in (np.array([0, -1]), at)]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([len(begin)], pa.int64()), *told, pa.array([flat(table, "p")[order].tobytes()], pa.binary()), pa.array([fresh.tobytes()], pa.binary())], names=["part", "n", "ends", "many", "p", "fresh"])

    told = blocks.select("b", "chars").mapInArrow(triples, "part long, hi binary, lo binary, p binary").groupBy("part").applyInArrow(name, "part long, n long, ends binary, many binary, p binary, fresh binary")
    local = scratch.keep(told, f"names-{tag}")
    many: set[tuple[int, int]] = set()
    total, base, last = 0, {}, None
    for r in sorted(local.select("part", "n", "ends", "many").collect(), key=lambda r: r["part"]):
        first, end = map(tuple, np.frombuffer(r["ends"], np.int64).reshape(2, 2).tolist())
        many |= set(map(tuple, np.frombuffer(r["many"], np.int64).reshape(-1, 2).tolist()))
        base[r["part"]] = total - (last == first)
        total, last = base[r["part"]] + r["n"], end

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, p, fresh in zip(column(batch, "part").to_pylist(), column(batch, "p").to_pylist(), column(batch, "fresh").to_pylist(), strict=True):
            yield np.frombuffer(p, np.int64), base[part] + np.cumsum(np.frombuffer(fresh, np.uint8), dtype=np.int64)

    return Values(local.select("part", "p", "fresh"), read), total, sorted(many)


def _ranked(local: DataFrame) -> Values:
    """The ranks, from 1, of places that lie in order in (part, n, p)."""
    starts, _ = _bases(local.select("part", "n").collect(), "n")

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, raw in zip(column(batch, "part").to_pylist(), column(batch, "p").to_pylist(), strict=True):
            p = np.frombuffer(raw, np.int64)
            yield p, np.arange(starts[part] + 1, starts[part] + 1 + len(p))

    return Values(local.select("part", "p"), read)


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Ranks from 1 of all suffixes of one array, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    span, n = 1, len(text)
    while n and rank.max() < n:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - span)] = rank[span:]
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        span *= 2
    return rank


def _base_ranks(blocks: DataFrame, n: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        text = np.zeros((n + BLOCK - 1) // BLOCK * BLOCK, np.int64)
        for b, raw in zip(table["b"].to_pylist(), table["chars"].to_pylist(), strict=True):
            text[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(raw, np.int64)[:BLOCK]
        order = np.argsort(sort_suffixes(text[:n]), kind="stable")
        return pa.table({"part": pa.array([0], pa.int64()), "n": pa.array([n], pa.int64()), "p": pa.array([order.tobytes()], pa.binary())})

    return blocks.select(F.lit(0).alias("one"), "b", "chars").groupBy("one").applyInArrow(run, "part long, n long, p binary")


def merge_runs(run: np.ndarray, kind: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """An order of suffixes grouped by `run` (equal triples, ascending).

    kind: place modulo 3. ra: own rank if sampled, else that of the next suffix; rb: for kind 1 of the
    next suffix, for 2 and 0 of the one after.
    """
    sampled = np.flatnonzero(kind != 0)
    sampled = sampled[np.lexsort((ra[sampled], run[sampled]))]
    others = np.flatnonzero(kind == 0)
    others = others[np.lexsort((ra[others], run[others]))]
    lo = np.searchsorted(run[sampled], run[others], side="left")
    hi = np.searchsorted(run[sampled], run[others], side="right")
    while (active := np.flatnonzero(lo < hi)).size:
        middle = (lo[active] + hi[active]) // 2
        s, o = sampled[middle], others[active]
        less = np.where(kind[s] == 1, rb[s] < ra[o], rb[s] < rb[o])
        lo[active[less]] = middle[less] + 1
        hi[active[~less]] = middle[~less]
    # a suffix that isn't sampled comes before the sampled one that it was placed at
    key = np.concatenate([np.arange(len(sampled)) * 2 + 1, lo * 2])
    return np.concatenate([sampled, others])[np.argsort(key, kind="stable")]


def _pivots(blocks: DataFrame, ranks: Values, n: int, rows: int, many: list[tuple[int, int]]) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    """For each triple that too many suffixes begin with, the sampled suffixes it is cut at, in order: p, kind, own, next.

    own: the suffix's rank; next: that of the next suffix for kind 1, of the one after for kind 2.
    What comes to the driver is about SAMPLES to a task's rows, of such triples only.
    """
    if not many:
        return {}
    step = _step(rows)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw in zip(column(batch, "b").to_pylist(), column(batch, "chars").to_pylist(), strict=True):
                at = _below(b, n)
                p = at + b * BLOCK
                at = at[(p % 3 != 0) & (mix(p.astype(np.uint64)) % np.uint64(step) == 0)]
                hi, lo = _pack(np.frombuffer(raw, np.int64), at)
                hot = np.logical_or.reduce([(hi == x) & (lo == y) for x, y in many])
                yield from _batches([hi[hot], lo[hot], at[hot] + b * BLOCK], ["hi", "lo", "p"])

    found = blocks.select("b", "chars").mapInArrow(some, "hi long, lo long, p long").collect()
    places = sorted({q for r in found for q in (r["p"], r["p"] + (1 if r["p"] % 3 == 1 else 2))})
    wanted = np.array(places, np.int64)
    read = ranks.read

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, v in read(batch):
                own = np.isin(p, wanted)
                yield from _batches([p[own], v[own]], ["p", "v"])

    rank = {r["p"]: r["v"] for r in ranks.rows.mapInArrow(asked, "p long, v long").collect()}
    out: dict[tuple[int, int], dict[str, np.ndarray]] = {}
    for triple in {(r["hi"], r["lo"]) for r in found}:
        own = sorted((rank[r["p"]], r["p"]) for r in found if (r["hi"], r["lo"]) == triple)[CUT // 2 :: CUT]
        if own:
            p = np.array([x[1] for x in own])
            out[triple] = {"p": p, "kind": p % 3, "own": np.array([x[0] for x in own]), "next": np.array([rank.get(q + (1 if q % 3 == 1 else 2), 0) for q in p.tolist()])}
    return out


def cuts(hot: dict[tuple[int, int], dict[str, np.ndarray]], hi: np.ndarray, lo: np.ndarray, p: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """How many of its triple's pivots a suffix doesn't come before; -1 for a triple that isn't cut. Ties go by the place."""
    out = np.full(len(p), -1, np.int32)
    for (a, b), cut in hot.items():
        at = np.flatnonzero((hi == a) & (lo == b))
        for k in range(0, len(at), 4096):
            i = at[k : k + 4096]
            # a sampled suffix by its rank; another by the ranks of what follows the characters it shares
            theirs = np.where(p[i, None] % 3 == 0, cut["next"], cut["own"])
            own = np.where((p[i, None] % 3 == 0) & (cut["kind"] == 2), rb[i, None], ra[i, None])
            out[i] = ((theirs < own) | ((theirs == own) & (cut["p"] <= p[i, None]))).sum(axis=1)
    return out


def _merged(blocks: DataFrame, ranks: Values, n: int, rows_: int, many: list[tuple[int, int]], scratch: Scratch, tag: str, final: bool) -> DataFrame:
    """All suffixes in order: (part, n, p), where p has the places of the part's n suffixes.

    If `final`, instead (b, p): in each block the places whose prefix is repeated at an earlier place.
    """
    hot = _pivots(blocks, ranks, n, rows_, many)
    keys = _samples(blocks).copy()
    keys[:, 2] = -1
    for (x, y), cut in hot.items():  # the pivots are as many suffixes apart, so the sample is dealt to the parts between them
        own = np.flatnonzero((keys[:, 0] == x) & (keys[:, 1] == y))
        keys[own, 2] = np.arange(len(own)) * (len(cut["p"]) + 1) // max(1, len(own))
    bounds = _bounds(keys, max(1, -(-n // rows_)))
    wanted = ["hi", "lo", "p", "ra", "rb", *(["cut"] if hot else []), *(["prefix"] if final else [])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = column(batch, "prefix").to_pylist() if final else [None] * batch.num_rows
            for b, raw, given, prefix in zip(column(batch, "b").to_pylist(), column(batch, "chars").to_pylist(), column(batch, "ranks").to_pylist(), prefixes, strict=True):
                chars = np.frombuffer(raw, np.int64)
                rank = np.frombuffer(given, np.int64) if given else np.zeros(BLOCK + 2, np.int64)
                at = _below(b, n)
                if final:
                    own = np.frombuffer(prefix, np.int64)
                    at = at[own[at] != 0]  # fewer words than a passage needs
                hi, lo = _pack(chars, at)
                p = at + b * BLOCK
                ra = np.where(p % 3 == 0, rank[at + 1], rank[at])
                rb = np.where(p % 3 == 1, rank[at + 1], rank[at + 2])
                cut = cuts(hot, hi, lo, p, ra, rb)
                yield blobs(range_of(bounds, hi, lo, cut), [hi, lo, p, ra, rb, *([cut] if hot else []), *([own[at]] if final else [])], ["part", *wanted])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        c = {x: flat(table, x, np.int32 if x == "cut" else np.int64) for x in wanted}
        by = [c[x] for x in ("hi", "lo", "cut") if x in c]
        order = np.lexsort(by[::-1])
        by = [x[order] for x in by]
        run = np.cumsum(np.concatenate([[False], np.logical_or.reduce([x[1:] != x[:-1] for x in by])]))
        order = order[merge_runs(run, c["p"][order] % 3, c["ra"][order], c["rb"][order])]
        p = c["p"][order]
        if not final:
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(p)], pa.int64()), "p": pa.array([p.tobytes()], pa.binary())})
        prefix = c["prefix"][order]  # the merge keeps the runs where they are
        fresh = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (run[1:] != run[:-1])])
        begin = np.flatnonzero(fresh)
        first = np.minimum.reduceat(p, begin)
        later = p[p != np.repeat(first, np.diff(np.append(begin, len(p))))]
        edges = np.zeros((0, 2), np.int64)
        if hot:  # the first and the last prefix of each part of a triple may go on in its neighbours
            of_run = run[begin]
            edge = np.concatenate([[True], of_run[1:] != of_run[:-1]])
            edge |= np.append(edge[1:], True)
            edge &= c["cut"][order][begin] >= 0
            edges = np.stack([first[edge], prefix[begin][edge]], axis=1)
        return pa.table({"p": pa.array([later.tobytes()], pa.binary()), "edges": pa.array([edges.tobytes()], pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in column(batch, "p").to_pylist():
                p = np.frombuffer(raw, np.int64)
                yield blobs(p // BLOCK, [p], ["b", "p"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = flat(batch, "edges").reshape(-1, 2)
            yield from _batches([x[:, 0], x[:, 1]], ["p", "prefix"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = column(batch, "p").to_numpy()
            yield blobs(p // BLOCK, [p], ["b", "p"])

    joined = blocks.drop("sample").join(_value_blocks(ranks, "ranks"), "b", "left")
    dealt = joined.mapInArrow(rows, "part long, " + ", ".join(f"{x} binary" for x in wanted)).groupBy("part")
    kept = scratch.keep(dealt.applyInArrow(merge, "p binary, edges binary" if final else "part long, n long, p binary"), f"merged-{tag}")
    if not final:
        return kept
    repeated = kept.select("p").mapInArrow(spread, "b long, p binary")
    if not hot:
        return repeated
    borders = kept.select("edges").mapInArrow(edges, "p long, prefix long").withColumn("first", F.min("p").over(Window.partitionBy("prefix")))
    return repeated.unionAll(borders.where("p > first").select("p").mapInArrow(gather, "b long, p binary"))


def _sample_ranks(blocks: DataFrame, n: int, level: int, covered: int, length: int, base: int, rows: int, scratch: Scratch) -> tuple[Values, list[tuple[int, int]]]:
    """The rank of each sampled suffix, and the triples at very many places; `covered`: words that a character stands for."""
    names, distinct, many = _named(blocks, n, rows, scratch, str(level))
    n1, n2 = (n + 1) // 3, n // 3
    if distinct == n1 + n2 or 3 * covered >= length:
        return names, many

    def place(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(p % 3 == 1, p // 3, n1 + p // 3), v

    def back(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = p < n1 + n2
        p = p[own]
        return np.where(p < n1, 3 * p + 1, 3 * (p - n1) + 2), v[own]

    m = n1 + n2 + ((n1 + n2) % 3 == 1)
    below = scratch.keep(_value_blocks(names.moved(place), "chars", m, _step(rows)), f"text-{level + 1}")
    scratch.drop(f"names-{level}")
    return _all_ranks(below, m, level + 1, 3 * covered, length, base, rows, scratch).moved(back), many


def _all_ranks(blocks: DataFrame, n: int, level: int, covered: int, length: int, base: int, rows: int, scratch: Scratch) -> Values:
    """The rank of every suffix of a text of n characters, n % 3 != 1."""
    if n <= base:
        return _ranked(scratch.keep(_base_ranks(blocks, n), f"base-{level}"))
    ranks, many = _sample_ranks(blocks, n, level, covered, length, base, rows, scratch)
    local = _merged(blocks, ranks, n, rows, many, scratch, str(level), final=False)
    scratch.drop(*(f"{x}-{y}" for x, y in (("names", level), ("merged", level + 1), ("text", level), ("base", level + 1))))
    return _ranked(local)


def _flagged(regions: DataFrame, length: int, base: int, rows: int, scratch: Scratch) -> DataFrame:
    """(th, start, end) of what every LENGTH-word run of the regions makes up that has occurred before."""
    starts, n = _bases(regions.groupBy("part").agg(F.sum("size").alias("n")).collect(), "n")
    n += n % 3 == 1  # one character 0 at the end
    blocks = scratch.keep(_text_blocks(regions, starts, n, length, _step(rows)), "text-0")
    ranks, many = _sample_ranks(blocks, n, 0, 1, length, base, rows, scratch)
    repeated = _merged(blocks, ranks, n, rows, many, scratch, "0", final=True)
    scratch.drop("names-0", "merged-1", "base-1", "text-0")

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = np.array([starts[x] for x in column(batch, "part").to_pylist()], np.int64) + column(batch, "off").to_numpy()
            end = begin + column(batch, "size").to_numpy()
            lo, hi = begin // BLOCK, (end - 1) // BLOCK
            at = np.repeat(np.arange(len(lo)), hi - lo + 1)
            b = np.arange(len(at)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[at]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(begin[at]), column(batch, "th").take(take), column(batch, "start").take(take)], names=["b", "begin", "th", "start"])

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks().sort_by("begin")
        p = np.sort(flat(left, "p"))
        begin = right["begin"].to_numpy()
        if not len(p) or not len(begin):
            return pa.table({"th": pa.array([], pa.binary()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
        at = np.searchsorted(begin, p, side="right") - 1
        place = p - begin[at] + right["start"].to_numpy()[at]
        # places that follow one another closely make one span
        fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] > place[:-1] + length)])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(p)) - 1
        return pa.table({"th": right["th"].take(pa.array(at[head])), "start": place[head], "end": place[tail] + length})

    homes = regions.select("part", "off", "size", "th", "start").mapInArrow(where, "b long, begin long, th binary, start long")
    return repeated.groupBy("b").cogroup(homes.groupBy("b")).applyInArrow(locate, "th binary, start long, end long")


def _union(found: DataFrame) -> DataFrame:
    """(th, start, end): spans that touch or overlap made one."""
    order = Window.partitionBy("th").orderBy("start", "end")
    before = found.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = before.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(order))
    return island.groupBy("th", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _passages(docs: DataFrame, kinds: tuple[str, str], length: int, base: int, rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(keys: __id, th, n) of all rows, and (th, start, end) of what the first row of each text repeats."""
    kind, order = kinds
    keys = scratch.keep(_keys(docs, kind), "keys")
    long = keys.where(F.col("n") >= length).withColumn("ord", id_order(F.col("__id"), kind))
    grams = _grams(docs.select("__text"), length).repartition("fp").sortWithinPartitions("fp")
    hits = scratch.keep(_repeated(grams), "hits")
    if not hits.limit(1).count():
        return keys, docs.sparkSession.createDataFrame([], "th binary, start long, end long")
    first = long.groupBy("th").agg(F.min("ord").alias("ord"))
    places = hits.groupBy("t").agg(F.collect_set("place").alias("hits"))
    wanted = first.withColumn("t", text_head("th")).join(places, "t").select("th", "ord", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for _, words, begin in _parts(column(batch, "__text")):
                found += text_keys(words, begin)
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(found, pa.binary()), column(batch, "__text")], names=["__id", "th", "text"])

    keyed = docs.mapInArrow(run, f"__id {kind}, th binary, text string").withColumn("ord", id_order(F.col("__id"), kind)).drop("__id")
    regions = _regions(keyed.join(wanted, ["th", "ord"]).select("ord", "th", "text", "hits"), order, length).dropDuplicates(["th", "start"])
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // NUMBERED))
    ordered = regions.repartitionByRange(parts, "ord", "th", "start").sortWithinPartitions("ord", "th", "start")
    numbered = scratch.keep(_numbered(ordered), "regions")
    scratch.drop("hits")
    spans_ = scratch.keep(_union(_flagged(numbered, length, base, rows, scratch)), "spans")
    scratch.drop("regions", "merged-0")
    return keys, spans_


def repeated_passages(docs: DataFrame, length: int = LENGTH, base: int = BASE, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word): the parts of each text, in words, that `length`-word runs seen before make up.

    "Before" goes by the id, nulls last, and then by the place in the text. Of rows with the same
    words the first is the original, and each other row repeats all of itself, also if ids repeat.
    Null and empty texts, and texts of fewer than `length` words, repeat nothing. Ids may be of any
    type that can be ordered. Other columns are ignored; an empty table gives an empty result.
    """
    kinds = id_types(docs, id_col)
    slim = docs.select(F.col(id_col).cast(kinds[0]).alias("__id"), F.col(text_col).alias("__text"))
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    keys, passages = _passages(slim, kinds, length, base, rows, scratch)
    order = Window.partitionBy("th").orderBy(id_order(F.col("__id"), kinds[0]))
    ranked = keys.where(F.col("n") >= length).withColumn("at", F.row_number().over(order))
    first = ranked.where("at = 1").join(passages, "th").select("__id", "start", "end")
    copies = ranked.where("at > 1").select("__id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    found = scratch.keep(first.unionAll(copies).select(F.col("__id").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word")), "found")
    scratch.drop("keys", "spans")
    return found


def cut_words(text: str, passages: list[tuple[int, int]]) -> str:
    """`text` without the given runs of words; each takes the characters up to the next word with it."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, _, _ = spans(data, np.array([0, len(data)], np.int64))
    edges = np.append(starts, len(data))
    raw, kept, at = data.tobytes(), [], 0
    for a, b in sorted(passages):
        kept.append(raw[at : edges[a]])
        at = int(edges[b])
    return b"".join([*kept, raw[at:]]).decode()


def drop_repeated(docs: DataFrame, length: int = LENGTH, base: int = BASE, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """`docs` with the passages of repeated_passages() cut out of the texts; all columns stay.

    A row of which nothing but white space is left goes. `size_col`, if there is such a column,
    counts the characters of what is left of a text that was cut. Other rows stay as they are.
    """
    kinds = id_types(docs, id_col)
    slim = docs.select(F.col(id_col).cast(kinds[0]).alias("__id"), F.col(text_col).alias("__text"))
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    _, passages = _passages(slim, kinds, length, base, rows, scratch)
    scratch.drop("keys")
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at, who = docs.columns.index(text_col), docs.columns.index(id_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None
    plain = docs.toDF(*names)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], []
            for _, words, begin in _parts(batch.column(at)):
                found += text_keys(words, begin)
                n += np.diff(begin).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=[*names, "__th", "__n"])

    keyed = plain.mapInArrow(key, T.StructType([*plain.schema.fields, T.StructField("__th", T.BinaryType()), T.StructField("__n", T.LongType())]))
    spans_of = passages.groupBy(F.col("th").alias("__th")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    joined = keyed.join(spans_of, "__th", "left").withColumn("__alone", F.when(F.col("__n") < length, F.monotonically_increasing_id()))
    order = Window.partitionBy("__th", "__alone").orderBy(id_order(F.col(names[who]).cast(kinds[0]), kinds[0]))
    ranked = joined.withColumn("__at", F.row_number().over(order)).where("__at = 1 OR __n < " + str(int(length)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, given = batch.column(at).to_pylist(), column(batch, "__spans").to_pylist()
            changed = [i for i, s in enumerate(given) if s]
            keep = np.ones(batch.num_rows, bool)
            sizes = batch.column(size).to_pylist() if size is not None else None
            for i in changed:
                texts[i] = cut_words(texts[i], [(s["start"], s["end"]) for s in given[i]])
                keep[i] = bool(texts[i].strip())
                if sizes is not None:
                    sizes[i] = len(texts[i])
            columns = list(batch.columns[: len(names)])
            if changed:
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return ranked.select(*names, "__spans").mapInArrow(cut, plain.schema).toDF(*docs.columns)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i + 1 : i + {LENGTH}], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - {LENGTH - 1})) AS i FROM d WHERE len(w) >= {LENGTH})),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM g),
m AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM r WHERE nth > 1),
k AS (SELECT doc_id, i, sum(CASE WHEN earlier + {LENGTH} >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m)
SELECT doc_id, min(i) AS start_word, max(i) + {LENGTH} AS end_word FROM k GROUP BY doc_id, island
"""
