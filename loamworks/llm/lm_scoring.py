"""Documents scored by masked pseudo-likelihood: each token from its neighbours on both sides.

A token is a word hashed to one of TOKENS ids.  A window network reads the WINDOW tokens on each
side of a masked token, never the token itself: their vectors, one weight matrix for each place in
the window, a hidden layer, and a softmax in two steps.  The first is over CLASSES classes: ranges of
the tokens ordered by frequency, the most frequent ones alone in theirs.  The second leads through a
binary tree over the class's tokens, a Huffman code by their frequency: at each node the hidden layer
decides between left and right.  So every token is predicted from both sides, and the probabilities
of all tokens add up to one.  Untrained, a token is as likely in its class as it is frequent in the
corpus.  A document's score is the sum of its tokens' conditional log-probabilities.

What is learnt grows with the corpus: frequencies count every word of every document, and the
network is trained on all positions, each document's in one of ROUNDS rounds.  Training is spread
over the cluster: in each round every task reads its documents, each shard of windows trains a copy
from the last round's network as it streams by, and the copies' rows are averaged by how often each
was trained.  Shards follow the partitions of the input.  The driver holds one network, whose size
is fixed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm._text import column, lowered, mix, pieces, spans, utf8, word_hashes

TOKENS = 1 << 15
#: Stands for what lies outside the text.
EDGE = TOKENS
WINDOW = 2
DIM, HIDDEN = 12, 16
#: Units of the hidden layer that the nodes of the trees look at, the first ones.
TREE = 8
CLASSES = 128
#: Tokens that are a class of their own.
ALONE = 96
#: Logits are held between -LIMIT and LIMIT, so that their exponentials need no shift.
LIMIT = 60.0
#: One of so many positions is trained on: all.
SHARE = 1
ROUNDS = 4
#: Windows of one shard in one round, about.
SHARD = 40_000
_BLOCKS = 32
NODES = TOKENS - CLASSES
#: Windows of one step of training.
BATCH = 1024
RATE = 0.3
#: Tokens scored together.
STEP = 2048
_DENSE = ("w", "b", "v", "c")


@dataclass
class Model:
    """of: (TOKENS,) class; begin, node, turn: the way to each token in its class's tree; e, w, b, v, c, t: the network.

    Token k passes the nodes node[begin[k] : begin[k + 1]] and turns right where `turn` is 1, left
    where it is -1.  t: (NODES, TREE + 1), the weights of each node, its own tendency last.
    """

    of: np.ndarray
    begin: np.ndarray
    node: np.ndarray
    turn: np.ndarray
    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray
    t: np.ndarray

    def folded(self) -> np.ndarray:
        """(2 WINDOW, TOKENS + 1, HIDDEN): what each token adds to the hidden layer at each place."""
        return np.ascontiguousarray(np.matmul(self.e, self.w), np.float32)


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, tokens, first token of each text from lo to hi) of consecutive texts."""
    data, offsets = utf8(lowered(texts))
    for lo, hi in pieces(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = spans(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, (word_hashes(part, starts, ends) % np.uint64(TOKENS)).astype(np.int64), first


def contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(2 WINDOW, n): the tokens before (nearest first) and after (nearest first) each one."""
    n = len(tokens)
    out = np.full((2 * WINDOW, n), EDGE, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for d in range(1, WINDOW + 1):
        if n > d:
            same = owner[d:] == owner[:-d]
            out[d - 1, d:][same] = tokens[:-d][same]
            out[WINDOW + d - 1, :-d][same] = tokens[d:][same]
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """Class of each token; every token counts one more than it was seen."""
    counts = counts.astype(np.float64) + 1
    order = np.lexsort((np.arange(TOKENS), -counts))
    of = np.empty(TOKENS, np.int64)
    of[order[:ALONE]] = np.arange(ALONE)
    rest = order[ALONE:]
    mass = np.cumsum(counts[rest])
    of[rest] = ALONE + np.minimum((mass - counts[rest]) / mass[-1] * (CLASSES - ALONE), CLASSES - ALONE - 1).astype(np.int64)
    return of


def trees(counts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, node, turn) of each token and the tendency of each node, by a Huffman code of each class."""
    counts = counts.astype(np.float64) + 1
    paths: list[list[tuple[int, int]]] = [[] for _ in range(TOKENS)]
    lean = np.zeros(NODES)
    free = 0
    for k in range(CLASSES):
        heap = [(counts[i], int(i), int(i)) for i in np.flatnonzero(of == k)]  # weight, tie, token or TOKENS + node
        heapq.heapify(heap)
        sides: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            one, two = heapq.heappop(heap), heapq.heappop(heap)
            sides[free] = (one[2], two[2])
            lean[free] = np.log(two[0] / one[0])
            heapq.heappush(heap, (one[0] + two[0], TOKENS + free, TOKENS + free))
            free += 1
        todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])] if heap else []
        while todo:
            at, way = todo.pop()
            if at < TOKENS:
                paths[at] = way
                continue
            left, right = sides[at - TOKENS]
            todo += [(left, [*way, (at - TOKENS, -1)]), (right, [*way, (at - TOKENS, 1)])]
    begin = np.zeros(TOKENS + 1, np.int64)
    np.cumsum([len(way) for way in paths], out=begin[1:])
    flat = [step for way in paths for step in way]
    return begin, np.array([n for n, _ in flat], np.int32), np.array([t for _, t in flat], np.int8), lean


def new_model(counts: np.ndarray, seed: int = 9) -> Model:
    rng = np.random.default_rng(seed)
    of = classes(counts)
    begin, node, turn, lean = trees(counts, of)
    share = np.bincount(of, counts + 1.0, minlength=CLASSES)
    c = np.log(np.maximum(share, 1) / share.sum())  # begins at the classes' own frequencies
    t = np.zeros((NODES, TREE + 1), np.float32)
    t[:, -1] = lean
    return Model(of, begin, node, turn, rng.normal(0, 0.3, (TOKENS + 1, DIM)).astype(np.float32), rng.normal(0, 0.5 / np.sqrt(DIM), (2 * WINDOW, DIM, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), c.astype(np.float32), t)


def hidden_layer(model: Model, folded: np.ndarray, around: np.ndarray) -> np.ndarray:
    h = folded[0].take(around[0], axis=0)
    for p in range(1, 2 * WINDOW):
        h += folded[p].take(around[p], axis=0)
    h += model.b
    return np.maximum(h, 0, out=h)


def ways(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in `tokens`, node, turn) of all the nodes that tokens pass, in their order."""
    begin = model.begin[tokens]
    size = model.begin[tokens + 1] - begin
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(tokens)), size)
    at = np.arange(len(row)) + np.repeat(begin - end + size, size)
    return row, model.node[at], model.turn[at]


def log_probabilities(model: Model, folded: np.ndarray, tokens: np.ndarray, around: np.ndarray, step: int = STEP) -> np.ndarray:
    out = np.empty(len(tokens))
    ones = np.ones(CLASSES, np.float32)
    for lo in range(0, len(tokens), step):
        own = tokens[lo : lo + step]
        h = hidden_layer(model, folded, around[:, lo : lo + step])
        z = h @ model.v
        z += model.c
        np.clip(z, -LIMIT, LIMIT, out=z)
        at = z[np.arange(len(own)), model.of[own]]
        np.exp(z, out=z)
        at = at - np.log(z @ ones)
        row, node, turn = ways(model, own)
        t = model.t.take(node, axis=0)
        s = np.einsum("ij,ij->i", np.ascontiguousarray(h[:, :TREE]).take(row, axis=0), t[:, :-1])
        s += t[:, -1]
        s *= turn
        np.clip(s, -LIMIT, LIMIT, out=s)
        # log of the sigmoid
        out[lo : lo + step] = at - np.bincount(row, np.log1p(np.exp(-s)), minlength=len(own))
    return out


def gradients(model: Model, target: np.ndarray, around: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss, gradients of w, b, v, c, of the window's token vectors (2 WINDOW, n, DIM), and of the nodes passed, with these."""
    n = len(target)
    x = model.e.take(around.T.ravel(), axis=0).reshape(n, -1)
    w = model.w.reshape(x.shape[1], -1)
    pre = x @ w
    pre += model.b
    h = np.maximum(pre, 0)
    z = h @ model.v
    z += model.c
    np.clip(z, -LIMIT, LIMIT, out=z)
    np.exp(z, out=z)
    share = 1 / (z @ np.ones(CLASSES, z.dtype))
    of, row = model.of[target], np.arange(n)
    loss = -np.log(np.maximum(z[row, of] * share, 1e-12)).sum()
    z *= (share / n)[:, None]
    z[row, of] -= z.dtype.type(1 / n)
    dh = z @ model.v.T
    at, node, turn = ways(model, target)
    t = model.t.take(node, axis=0)
    near = np.ascontiguousarray(h[:, :TREE]).take(at, axis=0)
    s = np.einsum("ij,ij->i", near, t[:, :-1])
    s += t[:, -1]
    s *= turn
    np.clip(s, -LIMIT, LIMIT, out=s)
    miss = np.exp(-s)
    loss += np.log1p(miss).sum()
    ds = -turn * (miss / (1 + miss)) / n
    ds = ds.astype(t.dtype)
    dt = np.empty_like(t)
    np.multiply(near, ds[:, None], out=dt[:, :-1])
    dt[:, -1] = ds
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        dh[at[first], :TREE] += np.add.reduceat(t[:, :-1] * ds[:, None], first, axis=0)
    dh *= pre > 0
    grads = {"w": (x.T @ dh).reshape(model.w.shape), "b": dh.sum(0), "v": h.T @ z, "c": np.ones(n, z.dtype) @ z}
    return float(loss) / n, grads, (dh @ w.T).reshape(n, 2 * WINDOW, DIM).transpose(1, 0, 2), dt, node


def _run_sums(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sum of each run of rows that begins at `begin`, the last one's to the end."""
    even = rows.shape[1] // 2 * 2
    last = np.append(begin[1:], len(rows)) - 1
    upto = np.empty((len(begin), rows.shape[1]), rows.dtype)
    # two columns are added up at a time, as one complex number
    upto[:, :even] = np.cumsum(rows[:, :even].view(np.result_type(rows.dtype, np.complex64)), axis=0).take(last, axis=0).view(rows.dtype)
    if even < rows.shape[1]:
        upto[:, even] = np.cumsum(rows[:, even]).take(last)
    out = upto.copy()
    out[1:] -= upto[:-1]
    return out


def _sparse_step(table: np.ndarray, past: np.ndarray, ids: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """Adagrad on the rows of a table that were used, with one step size a row; ids: 16 bits."""
    order = np.argsort(ids, kind="stable")
    ids = ids.take(order)
    begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    ids = ids.take(begin)
    g = _run_sums(grads.take(order, axis=0), begin)
    own = past.take(ids)
    own += np.einsum("ij,ij->i", g, g) * np.float32(1 / g.shape[1])
    past[ids] = own
    g *= (np.float32(rate) / np.sqrt(own))[:, None]
    fresh = table.take(ids, axis=0)
    fresh -= g
    whole = f"V{table.itemsize * table.shape[1]}"  # a row as one item is copied faster
    table.view(whole).ravel()[ids] = fresh.view(whole).ravel()


def train_copy(model: Model, windows: np.ndarray, rate: float, seed: int, batch: int = BATCH) -> tuple[Model, np.ndarray, np.ndarray]:
    """A copy trained on (n, 2 WINDOW + 1) windows, the target last, and how often each token's vector and each node was trained."""
    own = Model(model.of, model.begin, model.node, model.turn, *(getattr(model, k).copy() for k in ("e", *_DENSE, "t")))
    sums = {k: np.full_like(getattr(own, k), 1e-4) for k in _DENSE}
    sums |= {k: np.full(len(getattr(own, k)), 1e-4, np.float32) for k in ("e", "t")}
    order = np.random.default_rng(seed).permutation(len(windows))
    for lo in range(0, len(order), batch):
        part = windows[order[lo : lo + batch]]
        around = part[:, :-1].T
        _, grads, de, dt, node = gradients(own, part[:, -1].astype(np.int64), around)
        for k, g in grads.items():
            sums[k] += g * g
            getattr(own, k)[...] -= (rate * g / np.sqrt(sums[k])).astype(np.float32)
        _sparse_step(own.e, sums["e"], around.ravel(), de.reshape(-1, DIM), rate)
        if len(node):
            _sparse_step(own.t, sums["t"], node.astype(np.uint16), dt, rate)
    seen = np.bincount(windows[:, :-1].ravel(), minlength=TOKENS + 1).astype(float)
    often = np.bincount(windows[:, -1], minlength=TOKENS)
    hit = np.flatnonzero(often)
    row, node, _ = ways(own, hit)
    passed = np.bincount(node, often[hit[row]], minlength=NODES)
    return own, seen, passed


def _dense(model: Model) -> np.ndarray:
    return np.concatenate([getattr(model, k).ravel() for k in _DENSE]).astype(np.float64)


def _set_dense(model: Model, flat: np.ndarray) -> None:
    at = 0
    for k in _DENSE:
        x = getattr(model, k)
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size


def _gather(slim: DataFrame) -> DataFrame:
    """(key, part): counts of tokens by block."""
    n_block = TOKENS // _BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TOKENS, np.int64)
        for batch in batches:
            for _, _, tokens, _ in tokens_of(column(batch, "__text")):
                counts += np.bincount(tokens, minlength=TOKENS)
        parts = [counts[k * n_block : (k + 1) * n_block].tobytes() for k in range(_BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS)), pa.array(parts, pa.binary())], names=["key", "part"])

    return slim.mapInArrow(run, "key long, part binary")


def windows_of(tokens: np.ndarray, first: np.ndarray, share: int) -> np.ndarray:
    """(n, 2 WINDOW + 1) windows, the target last, of one of `share` positions, by a hash of document and position."""
    around = contexts(tokens, first)
    if share > 1:
        size = np.diff(first)
        place = (np.arange(len(tokens)) - np.repeat(first[:-1], size)).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens.astype(np.uint64) + place * np.uint64(TOKENS)))])
        key = mix(np.repeat(total[first[1:]] - total[first[:-1]], size) + place * np.uint64(0x9E3779B97F4A7C15))
        picked = np.flatnonzero(key % np.uint64(share) == 0)
        tokens, around = tokens[picked], around[:, picked]
    return np.concatenate([around, tokens[None]]).T.astype(np.uint16)


def _counts(gathered: DataFrame) -> np.ndarray:
    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["part"].to_pylist())
        return pa.table({"key": [key[0].as_py()], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(TOKENS, np.int64)
    for r in gathered.groupBy("key").applyInArrow(add, "key long, part binary").collect():
        out[r["key"] * (TOKENS // _BLOCKS) :][: TOKENS // _BLOCKS] = np.frombuffer(r["part"], np.int64)
    return out


def _copies(held: Broadcast, rate: float, turn: int, share: int, shard: int):
    """Trains a copy on each shard of a task's windows; the sum of their rows times their weights, by block, and of the rest of the network as block -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, n, shards = 0.0, 0, 0
        sums = {k: np.zeros_like(getattr(held.value, k), float) for k in ("e", "t")}
        weights = {k: np.zeros(len(x)) for k, x in sums.items()}

        def add(windows: np.ndarray) -> None:
            nonlocal dense, n, shards
            own, seen, passed = train_copy(held.value, windows, rate, shards * 1000 + turn)
            dense = dense + _dense(own) * len(windows)
            for k, often in (("e", seen), ("t", passed)):
                sums[k] += getattr(own, k) * often[:, None]
                weights[k] += often
            n, shards = n + len(windows), shards + 1

        left: list[np.ndarray] = []
        for batch in batches:
            for _, _, tokens, first in tokens_of(column(batch, "__text")):
                left.append(windows_of(tokens, first, share))
                while sum(map(len, left)) >= shard:
                    joined = np.concatenate(left)
                    add(joined[:shard])
                    left = [joined[shard:]]
        if sum(map(len, left)):
            add(np.concatenate(left))
        if n:
            rows = [(-1, dense.astype(np.float32).tobytes(), np.array([n], np.float32).tobytes())]
            for i, (k, x) in enumerate(sums.items()):
                for j, at in enumerate(_block_slices(len(x))):
                    rows.append((i * _BLOCKS + j, x[at].astype(np.float32).tobytes(), weights[k][at].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], names=["block", "value", "weight"])

    return run


def _block_slices(n: int) -> list[slice]:
    size = -(-n // _BLOCKS)
    return [slice(k * size, min((k + 1) * size, n)) for k in range(_BLOCKS)]


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    value = weight = 0
    for b in batches:
        for v, w in zip(column(b, "value").to_pylist(), column(b, "weight").to_pylist(), strict=True):
            value = value + np.frombuffer(v, np.float32).astype(np.float64)
            weight = weight + np.frombuffer(w, np.float32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([value.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], names=["block", "value", "weight"])


def train(docs: DataFrame, share: int = SHARE, rounds: int = ROUNDS, shard: int = SHARD, rate: float = RATE, text_col: str = "text") -> Model:
    """A model of the whole corpus: see above. An empty corpus gives the network untrained."""
    spark = docs.sparkSession
    slim = docs.select(F.col(text_col).alias("__text"))
    model = new_model(_counts(_gather(slim)))
    for r in range(rounds):
        held = spark.sparkContext.broadcast(model)  # of fixed size
        step = rate * (1 - 0.7 * r / rounds)

        own = slim.where(F.pmod(F.xxhash64("__text"), F.lit(rounds)) == r)
        sums = own.mapInArrow(_copies(held, step, r, share, shard), "block int, value binary, weight binary").groupBy("block").applyInArrow(_add, "block int, value binary, weight binary")
        for row in sums.collect():  # 2 _BLOCKS + 1 rows, whatever the input
            value, weight = np.frombuffer(row["value"], np.float64), np.frombuffer(row["weight"], np.float64)
            if row["block"] < 0:
                _set_dense(model, value / weight[0])
            else:
                table = (model.e, model.t)[row["block"] // _BLOCKS]
                rows = table[_block_slices(len(table))[row["block"] % _BLOCKS]]
                hit = weight > 0
                rows[hit] = value.reshape(len(weight), -1)[hit] / weight[hit, None]
        held.unpersist()
    return model


def score(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, per_token) for every row of `docs`.

    A null text, or one without words, has 0 tokens, a sum of 0 and null per token. Repeated rows
    and null ids stay; other columns are ignored. Without a model one is trained on `docs`.
    """
    model = model or train(docs, text_col=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = held.value.folded()
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows)
            for lo, hi, tokens, first in tokens_of(column(batch, "__text")):
                n[lo:hi] = np.diff(first)
                if len(tokens):
                    lp = log_probabilities(held.value, folded, tokens, contexts(tokens, first))
                    total[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n[lo:hi]), lp, minlength=hi - lo)
            per = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(n), pa.array(total), per], names=[id_col, "n_tokens", "log_likelihood", "per_token"])

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, log_likelihood double, per_token double")
