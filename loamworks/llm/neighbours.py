"""Approximate nearest neighbours by additive quantisation, for every row against all others.

A vector is approximated by the sum of one codeword from each of BOOKS codebooks, all of the
vector's full dimension.  Codebooks are fitted one after another to what is left over, refitted
together by least squares, and codes are found by beam search.  With the norm of each
approximation stored, the squared distance from a query needs one table lookup a codebook:
|q|^2 - 2 sum <q, c> + |x^|^2.  The best by that measure are reranked by their exact distances.

Vectors lie in cells, one for each pair of a first and a second code, WORDS**2 in all.  A query looks
into the cells whose codewords' sum is nearest to it.  How many these must be is measured: for a
sample of rows the exact neighbours among all rows are found, and so many cells are searched that
hold WANTED of them.  With clustered vectors that is a small share of the cells.

No number caps what is reranked.  Each vector is stored with the length r of what its codes leave
over, so a query at distance d from its approximation is at d - r from it at the least.  All those
are reranked whose least distance is within the k-th best so far, however many have the same codes:
within the cells searched the result is exact.

Cells are packed into blocks of at most BLOCK vectors, a larger cell is split; a query goes only to
the blocks that hold one of its cells, and no task holds more than one block and QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.llm._io import Scratch
from loamworks.llm._sample import chosen
from loamworks.llm._text import column

NEIGHBOURS = 10
BOOKS, WORDS, BEAM = 16, 256, 4
#: Rows that the codebooks are fitted on, about, and rows that the number of lists is measured with.
TRAINING, MEASURED = 12_000, 256
#: Share of the exact neighbours that the searched cells must hold.
WANTED = 0.98
BLOCK, QUERIES = 8192, 16_384
#: A block and up to QUERIES queries are searched in a task, up to so many tasks.
MOST_TASKS = 20_000
#: Vectors that give each query its first k-th best.
FIRST = 64


@dataclass
class Quantiser:
    """books: (M, K, D); cells: how many of the nearest cells a query looks into."""

    books: np.ndarray
    cells: int = 0

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.books[0][codes[:, 0]].copy()
        for m in range(1, len(self.books)):
            out += self.books[m][codes[:, m]]
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM, step: int = 2048) -> np.ndarray:
        """(n, M) codes by beam search; the first code is the nearest first codeword."""
        books = self.books
        out = np.empty((len(x), len(books)), np.uint8)
        for lo in range(0, len(x), step):
            own = x[lo : lo + step]
            n = len(own)
            first = self.nearest(own, 1)
            codes = first[:, None, :]  # (n, beam, level)
            left = own[:, None, :] - books[0][first[:, 0]][:, None, :]
            for m in range(1, len(books)):
                book = books[m]
                width = left.shape[1]
                norm = (left * left).sum(axis=2)
                d = norm[:, :, None] - 2 * (left.reshape(n * width, -1) @ book.T).reshape(n, width, -1) + (book * book).sum(axis=1)
                d = d.reshape(n, -1)
                keep = min(beam if m + 1 < len(books) else 1, d.shape[1])
                best = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < d.shape[1] else np.tile(np.arange(d.shape[1]), (n, 1))
                parent, word = best // len(book), best % len(book)
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None]], axis=2)
                left = np.take_along_axis(left, parent[:, :, None], axis=1) - book[word]
            d = (left * left).sum(axis=2)
            out[lo : lo + step] = codes[np.arange(n), d.argmin(axis=1)]
        return out

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest first codewords of each vector, nearest first."""
        book = self.books[0]
        d = (book * book).sum(axis=1) - 2 * x @ book.T
        return d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]

    def cell_distances(self, q: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """(Q, cells) squared distances from the sums of the first two codewords, less |q|^2; of all cells or those given."""
        one, two = self.books[0], self.books[min(1, len(self.books) - 1)] * (len(self.books) > 1)
        k = len(one)
        first, second = -2 * q @ one.T, -2 * q @ two.T
        norm = (one * one).sum(axis=1)[:, None] + (two * two).sum(axis=1) + 2 * one @ two.T
        if cells is None:
            return (first[:, :, None] + second[:, None, :] + norm).reshape(len(q), -1)
        return first[:, cells // k] + second[:, cells % k] + norm.ravel()[cells]

    def radius(self, q: np.ndarray, step: int = 64) -> np.ndarray:
        """How far a query looks: the distance of the last cell it looks into."""
        out = np.empty(len(q), np.float32)
        for lo in range(0, len(q), step):
            d = self.cell_distances(q[lo : lo + step])
            out[lo : lo + step] = np.partition(d, self.cells - 1, axis=1)[:, self.cells - 1]
        return out + 1e-5 * (1 + np.abs(out))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(M, K, Q) lookup tables of -2 <q, c>."""
        return np.ascontiguousarray(np.matmul(self.books, np.float32(-2) * q.T))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = ((words * words).sum(axis=1) - 2 * x @ words.T).argmin(axis=1)
        count = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(count)
        begin = (np.cumsum(count) - count)[full]
        words[full] = np.add.reduceat(x[order], begin, axis=0) / count[full, None]
    return words


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, refits: int = 1, seed: int = 2) -> Quantiser:
    """Residual k-means, then rounds of beam encoding and least squares over all codebooks together."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    k = min(words, len(x))
    found, left = [], x.copy()
    for _ in range(books):
        book = _kmeans(left, k, rounds, rng)
        left -= book[((book * book).sum(axis=1) - 2 * left @ book.T).argmin(axis=1)]
        found.append(book)
    model = Quantiser(np.stack(found).astype(np.float32), k * k)
    for _ in range(refits):
        codes = model.encode(x).astype(np.int64) + np.arange(books) * k
        gram = np.zeros((books * k, books * k))
        right = np.zeros((books * k, x.shape[1]))
        for m in range(books):
            np.add.at(right, codes[:, m], x)
            for j in range(books):
                together = np.bincount((codes[:, m] - m * k) * k + codes[:, j] - j * k, minlength=k * k)
                gram[m * k : (m + 1) * k, j * k : (j + 1) * k] = together.reshape(k, k)
        # drawn to where the codewords were, so those of few vectors stay put
        ridge = 1e-2
        gram[np.diag_indices(len(gram))] += ridge
        fresh = np.linalg.solve(gram, right + ridge * model.books.reshape(books * k, -1))
        model.books = fresh.reshape(model.books.shape).astype(np.float32)
    return model


def _stack(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float32).reshape(-1, dim)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances (Q, n) in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    return np.maximum((q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1), 0)


def _cell_of(codes: np.ndarray, words: int) -> np.ndarray:
    return codes[:, 0].astype(np.int64) * words + (codes[:, 1] if codes.shape[1] > 1 else 0)


def _measure(coded: DataFrame, model: Quantiser, sample: np.ndarray, ids: np.ndarray, k: int, dim: int) -> int:
    """Cells to search, so that they hold WANTED of the sample's exact neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_ in range(0, batch.num_rows, 8192):
                part = batch.slice(at_, 8192)
                x, own = _stack(column(part, "x"), dim), column(part, "id").to_numpy()
                d = _exact(sample, x)
                d[ids[:, None] == own[None, :]] = np.inf
                n = min(k, d.shape[1])
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                at = np.take_along_axis(d, best, axis=1).ravel()
                ok = np.isfinite(at)
                q, cell = np.repeat(np.arange(len(sample)), n), column(part, "cell").to_numpy()[best.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(at[ok]), pa.array(cell[ok])], names=["q", "d", "cell"])

    near = coded.mapInArrow(run, "q long, d double, cell long")
    first = near.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("d", "cell"))).where(F.col("at") <= k)
    found = first.select("q", "cell").collect()  # MEASURED rows of k
    total = model.books.shape[1] ** 2
    if not found:
        return total
    place = np.empty(len(found), np.int64)
    asked, cells = np.array([r["q"] for r in found]), np.array([r["cell"] for r in found])
    for q in np.unique(asked):
        d = model.cell_distances(sample[q : q + 1])[0]
        mine = asked == q
        place[mine] = np.searchsorted(np.sort(d), d[cells[mine]], side="right")
    place.sort()
    return int(min(total, place[min(len(place) - 1, int(np.ceil(WANTED * len(place))) - 1)]))


def _blocks(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each list; lists of one block lie next to each other."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, room = -1, 0
    for i, n in enumerate(sizes.tolist()):
        if n > block:
            parts[i] = -(-n // block)
            first[i], at, room = at + 1, at + int(parts[i]), 0
            continue
        if at < 0 or n > room:
            at, room = at + 1, block
        first[i] = at
        room -= n
    return first, parts


def _search(model: Quantiser, q: np.ndarray, q_ids: np.ndarray, far: np.ndarray, x: np.ndarray, codes: np.ndarray, rest: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, squared distance) of up to k neighbours of each query among x."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(x):
        return nothing
    norm = (model.decode(codes.astype(np.intp)) ** 2).sum(axis=1)
    cells, cell_at = np.unique(_cell_of(codes, model.books.shape[1]), return_inverse=True)
    codes = codes.astype(np.intp)
    found = []
    for lo in range(0, len(q), 64):
        own, own_ids = q[lo : lo + 64], q_ids[lo : lo + 64]
        tables = model.tables(own)
        d = tables[0].take(codes[:, 0], axis=0)
        for m in range(1, len(tables)):
            d += tables[m].take(codes[:, m], axis=0)
        d = np.ascontiguousarray(d.T)
        d += norm
        d += (own * own).sum(axis=1)[:, None]
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        d -= rest
        np.maximum(d, 0, out=d)  # what the distance may be at best
        shut = (model.cell_distances(own, cells) > far[lo : lo + 64, None])[:, cell_at] | (ids[None, :] == own_ids[:, None])
        d[shut] = np.inf
        n = min(max(FIRST, k), len(x))
        best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(n), (len(own), 1))
        exact = np.where(np.isfinite(np.take_along_axis(d, best, axis=1)), ((x[best].astype(np.float64) - own[:, None, :]) ** 2).sum(axis=2), np.inf)
        limit = np.full(len(own), np.inf)
        for i in range(len(own)):  # the k-th best of different ids; of a repeated id any will do
            order = np.argsort(exact[i], kind="stable")
            first = np.sort(np.unique(ids[best[i][order]], return_index=True)[1])
            if len(first) >= k:
                limit[i] = exact[i][order][first[k - 1]]
        at, who = np.nonzero(np.isfinite(d) & (d <= np.sqrt(limit)[:, None] * (1 + 1e-4) + 1e-4))
        value = np.empty(len(at))
        for a in range(0, len(at), 1 << 18):
            part = slice(a, a + (1 << 18))
            value[part] = ((x[who[part]].astype(np.float64) - own[at[part]]) ** 2).sum(axis=1)
        who = ids[who]
        order = np.lexsort((value, who, at))
        at, who, value = at[order], who[order], value[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (who[1:] != who[:-1])  # a repeated row is one neighbour
        at, who, value = at[fresh], who[fresh], value[fresh]
        order = np.lexsort((who, value, at))
        at, who, value = at[order], who[order], value[order]
        begin = np.searchsorted(at, np.arange(len(own)))
        top = np.arange(len(at)) - begin[at] < k
        found.append((lo + at[top], who[top], value[top]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else nothing


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 1, training: int = TRAINING, measured: int = MEASURED, block: int = BLOCK, queries: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, neighbor_id, rank, distance): up to k neighbours of each query among all rows by Euclidean distance, rank from 1.

    Queries are the rows whose id `every` divides, 1 for all; ids that aren't numbers are taken by
    their hash. The codebooks are fitted on about `training` rows, chosen by a hash of the id, and
    `measured` of these tell how many cells to search; every row is coded and searched.

    Distances are exact and ties go to the lesser id. A row is not its own neighbour, nor are rows
    of the same id; a repeated row is searched once and counts as one neighbour, and of rows that
    have one id but different vectors each is searched and the nearest results count. Rows of null
    id, of a null or empty vector, with a null or a value that isn't finite in it, or of another
    dimension than the most frequent one (the lesser in a tie) have no neighbours and are nobody's.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    whole = isinstance(id_type, T.IntegralType)
    # the search works on numbers; ids of another type come back by their numbers in the end
    key = F.col(id_col).cast("long") if whole else F.xxhash64(F.col(id_col))
    raw = vectors.where(F.col(id_col).isNotNull()).select(key.alias("id"), F.col(id_col).alias("name"), F.col(vector_col).cast("array<float>").alias("x"))
    fine = raw.where("size(x) > 0").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    scratch = Scratch(spark, "neighbours")
    dims = fine.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("neighbor_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    if not dims:
        return spark.createDataFrame([], out)
    dim, total = dims[0]["dim"], dims[0]["n"]
    own = fine.where(F.size("x") == dim)
    rows = scratch.keep(own.select("id", "x").distinct(), "rows")
    taken = rows.where(chosen(F.col("id"), training, total, 41)).toArrow()
    if taken.num_rows < 2:  # a handful of rows: all of them
        taken = rows.where(chosen(F.xxhash64("x"), training, total, 42)).toArrow()
    taken = taken.sort_by("id")
    if not taken.num_rows:
        return spark.createDataFrame([], out)
    model = fit(_stack(taken["x"].combine_chunks(), dim))
    width = model.books.shape[1]
    held = spark.sparkContext.broadcast(model)  # WORDS x BOOKS vectors, whatever the input

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(column(batch, "x"), dim)
            codes = held.value.encode(x)
            rest = np.sqrt(((x - held.value.decode(codes)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("id", "x")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest, pa.float32()), pa.array(_cell_of(codes, width))], names=["id", "x", "codes", "rest", "cell"])

    coded = scratch.keep(rows.mapInArrow(code, "id long, x array<float>, codes binary, rest float, cell long"), "coded")
    picked = taken.take(pa.array(np.random.default_rng(3).permutation(taken.num_rows)[:measured]))
    model.cells = _measure(coded, model, _stack(picked["x"].combine_chunks(), dim), picked["id"].to_numpy(), k, dim)
    sizes = np.zeros(width * width, np.int64)
    for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect():  # WORDS**2 rows at most
        sizes[r["cell"]] = r["n"]
    first, parts = _blocks(sizes, block)
    full = np.flatnonzero(sizes)
    last = first[full] + parts[full]
    n_blocks = int(last.max())
    asking = coded.where(F.pmod(F.col("id"), F.lit(every)) == 0).select("id", "x")
    held.unpersist()
    held = spark.sparkContext.broadcast(model)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x = _stack(column(part, "x"), dim)
                far = held.value.radius(x)
                near = held.value.cell_distances(x, full) <= far[:, None]
                goes = np.zeros((len(x), n_blocks + 1), np.int32)  # where its cells' runs of blocks begin and end
                for i, hit in enumerate(near):
                    np.add.at(goes[i], first[full[hit]], 1)
                    np.add.at(goes[i], last[hit], -1)
                at, to = np.nonzero(np.cumsum(goes, axis=1)[:, :-1] > 0)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), column(part, "id").take(take), column(part, "x").take(take), pa.array(far[at], pa.float32())], names=["block", "id", "x", "far"])

    routed = scratch.keep(asking.mapInArrow(route, "block long, id long, x array<float>, far float"), "routed")
    shards = scratch.keep(routed.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / queries), F.lit(1)).cast("int").alias("shards")), "shards")
    tasks = shards.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    runs = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in full], "cell long, first long, parts long")
    data = coded.join(F.broadcast(runs), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).join(shards, "block")  # runs has WORDS**2 rows at most
    data = data.select("block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "id", "x", "codes", F.col("rest").alias("far"))
    sent = routed.join(shards, "block").select("block", F.pmod(F.xxhash64("id", F.lit(5)), "shards").cast("int").alias("shard"), "id", "x", F.lit(None).cast("binary").alias("codes"), "far")

    def search(table: pa.Table) -> pa.Table:
        is_query = pa.compute.is_null(table["codes"])
        q, d = table.filter(is_query), table.filter(pa.compute.invert(is_query)).sort_by("id")
        codes = np.frombuffer(b"".join(d["codes"].to_pylist()), np.uint8).reshape(d.num_rows, -1)
        q_ids = q["id"].to_numpy()
        at, who, exact = _search(held.value, _stack(q["x"].combine_chunks(), dim), q_ids, q["far"].to_numpy(), _stack(d["x"].combine_chunks(), dim), codes, d["far"].to_numpy(), d["id"].to_numpy(), k)
        return pa.table({"id": pa.array(q_ids[at], pa.int64()), "neighbor_id": pa.array(who, pa.int64()), "d": pa.array(exact, pa.float64())})

    # a block takes long for its bytes, so blocks aren't gathered into tasks by their size
    both = data.unionAll(sent).repartition(max(1, min(int(tasks), MOST_TASKS)), "block", "shard")
    found = both.groupBy("block", "shard").applyInArrow(search, "id long, neighbor_id long, d double")
    merged = found.groupBy("id", "neighbor_id").agg(F.min("d").alias("d"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbor_id"))).where(F.col("rank") <= k)
    result = scratch.keep(ranked.select("id", "neighbor_id", "rank", F.sqrt("d").alias("distance")), "found")
    scratch.drop("rows", "coded", "routed", "shards")
    if whole:
        return result.select(F.col("id").cast(id_type).alias(id_col), F.col("neighbor_id").cast(id_type).alias("neighbor_id"), "rank", "distance")
    names = own.groupBy("id").agg(F.min("name").alias("name"))
    named = result.join(names.select("id", F.col("name").alias(id_col)), "id").join(names.select(F.col("id").alias("neighbor_id"), F.col("name").alias("to")), "neighbor_id")
    return named.select(id_col, F.col("to").alias("neighbor_id"), "rank", "distance")
