"""Benchmark decontamination by size-partitioned MinHash containment search.

The items are partitioned by their number of shingles, [2^p, 2^(p+1)).  For the items of a
partition a text is read through windows of twice the partition's upper size that overlap by
half, so an item copied anywhere lies whole in one window, and a window is at most four times as
large as the item: that bounds the Jaccard similarity from below at any length of the text, which
a MinHash of the whole text could not.  From the bound, each partition gets its own number of
rows in a band, the largest that still finds the wanted share of matches.

The search is joined up from the items' side.  A window can only agree with an item in a band if
it contains the shingles that are the item's minima there.  So each shingle of a text is first
looked up among these; windows without such a shingle can't collide and their MinHashes are never
computed.  This skips only what can't match.

Candidates are verified by exact shingle containment: the share of the item's distinct shingles
(tuples of words, compared as strings) that occur anywhere in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.llm._text import WORD_SQL, column, lowered, pieces, shingle_hashes, spans, utf8, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
#: Share of matching windows that banding may miss, at the threshold and in the worst window.
MISS = 1e-3
#: Characters of items that one index holds; a larger benchmark is searched in as many slices as it needs.
INDEX_CHARS = 8_000_000

_RNG = np.random.default_rng(20240601)
_MULTIPLY = _RNG.integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_FILTER_BITS = 20


def rows_in_band(jaccard: float, hashes: int, miss: float) -> int:
    """The most rows r with (1 - j**r) ** (hashes // r) <= miss, at least 1."""
    best = 1
    for r in range(1, hashes + 1):
        if (1 - jaccard**r) ** (hashes // r) <= miss:
            best = r
    return best


@dataclass
class Partition:
    """Items with lower <= shingles < upper; keys of all their bands, each with the item it is of."""

    upper: int
    rows: int
    keys: np.ndarray
    owner: np.ndarray


@dataclass
class Index:
    """What every task gets; its size is bounded by INDEX_CHARS."""

    ids: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    shingles: list = field(default_factory=list)
    partitions: list = field(default_factory=list)
    minima: np.ndarray | None = None
    filter: np.ndarray | None = None


def _band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(bands, n) keys from a (hashes, n) signature."""
    bands = len(signature) // rows
    keys = np.empty((bands, signature.shape[1]), np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], (b * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), np.uint64)
        for r in range(rows):
            h = (h ^ signature[b * rows + r]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        keys[b] = h
    return keys


def _text_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(lowered(texts))
    starts, ends, first = spans(data, offsets)
    return shingle_hashes(word_hashes(data, starts, ends), first, k, short=False)


def build_index(ids: list, texts: list[str | None], k: int, threshold: float, hashes: int, miss: float) -> Index:
    """Items of fewer than k words have no shingle and are left out; repeated texts stay, each with its id."""
    index = Index()
    values, begin = _text_shingles(pa.array(texts, pa.string()), k)
    for i, text in enumerate(texts):
        own = np.unique(values[begin[i] : begin[i + 1]])
        if len(own):
            index.ids.append(ids[i])
            index.texts.append(text)
            index.shingles.append(own)
    sizes = np.array([len(x) for x in index.shingles], np.int64)
    minima = []
    for p in np.unique(np.floor(np.log2(sizes)).astype(int)) if len(sizes) else []:
        members = np.flatnonzero((sizes >= 1 << p) & (sizes < 2 << p))
        upper = 2 << int(p)
        # the smallest item, matching at the threshold, in a window of 2 * upper shingles
        jaccard = threshold * (1 << p) / (2 * upper + (1 - threshold) * (1 << p))
        rows = rows_in_band(jaccard, hashes, miss)
        signature = np.empty((hashes, len(members)), np.uint32)
        for c, m in enumerate(members):
            low = index.shingles[m].astype(np.uint32)[None, :] * _MULTIPLY[:hashes, None] + _ADD[:hashes, None]
            signature[:, c] = low.min(axis=1)
            minima.append(index.shingles[m][low.argmin(axis=1)])
        keys = _band_keys(signature, rows)
        flat, owner = keys.ravel(), np.tile(members, len(keys))
        order = np.argsort(flat, kind="stable")
        index.partitions.append(Partition(upper, rows, flat[order], owner[order]))
    index.minima = np.unique(np.concatenate(minima)) if minima else np.zeros(0, np.uint64)
    index.filter = np.zeros(1 << _FILTER_BITS, bool)
    index.filter[index.minima >> np.uint64(64 - _FILTER_BITS)] = True
    return index


def _candidates(values: np.ndarray, hits: np.ndarray, index: Index, hashes: int) -> set[int]:
    """Items that agree in a band with a window of one text; `hits`: places of shingles among the minima."""
    found: set[int] = set()
    for part in index.partitions:
        stride = part.upper
        last = max(0, -(-len(values) // stride) - 2)  # windows begin at 0, stride, ..., last * stride
        block = hits // stride
        windows = np.unique(np.concatenate([np.minimum(block, last), np.clip(block - 1, 0, last)]))
        for lo in range(0, len(windows), 64):
            at = windows[lo : lo + 64] * stride
            size = np.minimum(at + 2 * stride, len(values)) - at
            begin = np.cumsum(size) - size
            low = values[np.arange(size.sum()) + np.repeat(at - begin, size)].astype(np.uint32)
            signature = np.empty((hashes, len(at)), np.uint32)
            for h in range(hashes):
                signature[h] = np.minimum.reduceat(low * _MULTIPLY[h] + _ADD[h], begin)
            keys = np.unique(_band_keys(signature, part.rows))
            left = np.searchsorted(part.keys, keys, side="left")
            right = np.searchsorted(part.keys, keys, side="right")
            for a, b in zip(left[left < right].tolist(), right[left < right].tolist(), strict=True):
                found.update(part.owner[a:b].tolist())
    return found


def _exact(text: str, k: int) -> set[tuple[bytes, ...]]:
    data, offsets = utf8(lowered(pa.array([text], pa.string())))
    starts, ends, _ = spans(data, offsets)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def search_batch(texts: pa.Array, index: Index, k: int, threshold: float, hashes: int) -> list[tuple[int, int, int, int]]:
    """(place of the text, item, shared shingles, item's shingles) of all verified matches."""
    found = []
    data, offsets = utf8(lowered(texts))
    for lo, hi in pieces(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = spans(part, off)
        values, begin = shingle_hashes(word_hashes(part, starts, ends), first, k, short=False)
        maybe = np.flatnonzero(index.filter[values >> np.uint64(64 - _FILTER_BITS)])
        if not len(maybe):
            continue
        place = np.minimum(np.searchsorted(index.minima, values[maybe]), len(index.minima) - 1)
        maybe = maybe[index.minima[place] == values[maybe]]
        owner = np.searchsorted(begin, maybe, side="right") - 1
        for d in np.unique(owner).tolist():
            own = values[begin[d] : begin[d + 1]]
            hits = maybe[owner == d] - begin[d]
            items = _candidates(own, hits, index, hashes)
            if not items:
                continue
            distinct = np.unique(own)
            exact = None
            for i in sorted(items):
                shingles = index.shingles[i]
                at = np.minimum(np.searchsorted(distinct, shingles), len(distinct) - 1)
                if (distinct[at] == shingles).sum() < threshold * len(shingles):
                    continue  # equal shingles have equal hashes, so the exact share isn't larger
                exact = _exact(texts[lo + d].as_py(), k) if exact is None else exact
                item = _exact(index.texts[i], k)
                shared = len(item & exact)
                if shared >= threshold * len(item):
                    found.append((lo + d, i, shared, len(item)))
    return found


def _slices(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list]]:
    """The items, in slices of about `limit` characters, so that no index outgrows a task."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // limit)
    for s in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == s).collect() if n > 1 else items.collect()
        rows.sort(key=lambda r: (r.i is None, r.i, r.t))
        if rows:
            yield [r.i for r in rows], [r.t for r in rows]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    hashes: int = HASHES,
    miss: float = MISS,
    index_chars: int = INDEX_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc id, item id, shared, n_shingles, containment) of each pair with containment >= threshold.

    Whole texts are searched, in a map without a shuffle. Null and empty texts and items, and
    items of fewer than `shingle` words, match nothing. A repeated document or item gives its
    rows again. Null ids are carried through; other columns are ignored. With an empty benchmark
    the result is empty.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    out = T.StructType([T.StructField(id_col, kinds[0]), T.StructField(item_col, kinds[1]), T.StructField("shared", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("containment", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(kinds[1])
    slim = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    result = None
    for ids, texts in _slices(benchmark, item_col, item_text_col, index_chars):
        held = spark.sparkContext.broadcast(build_index(ids, texts, shingle, threshold, hashes, miss))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                found = search_batch(column(batch, "__text"), index, shingle, threshold, hashes)
                if found:
                    at, item, shared, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "__id").take(pa.array(at)), pa.array([index.ids[i] for i in item], item_type), pa.array(shared, pa.int64()), pa.array(n, pa.int64()), pa.array([s / m for s, m in zip(shared, n, strict=True)], pa.float64())],
                        names=[id_col, item_col, "shared", "n_shingles", "containment"],
                    )

        one = slim.mapInArrow(run, out)
        result = one if result is None else result.unionAll(one)
    return spark.createDataFrame([], out) if result is None else result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES, miss: float = MISS, index_chars: int = INDEX_CHARS, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text contains an item; all columns stay.

    The decision is taken on the row itself, so nulls, repeated rows and clashing names do no
    harm. A row with a null or empty text stays.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for ids, texts in _slices(benchmark, "item_id", "text", index_chars):
        held = spark.sparkContext.broadcast(build_index(ids, texts, shingle, threshold, hashes, miss))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in search_batch(batch.column(at), held.value, shingle, threshold, hashes)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d WHERE len(w) >= {SHINGLE})),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM b WHERE len(w) >= {SHINGLE})),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(n_shingles) AS n_shingles,
       count(*)::DOUBLE / any_value(n_shingles)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*)::DOUBLE >= {THRESHOLD}::DOUBLE * any_value(n_shingles)::DOUBLE
"""
