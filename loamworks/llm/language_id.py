"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is a position.  Two gated recurrent networks read the bytes, one in each
direction, and a softmax over both states gives each position its probabilities; their mean over
all positions of a text is the text's.  Both carry their states over the whole text.

Texts are read in stretches of STRETCH bytes, so that thousands of stretches of many texts step
together, longest first, so that no step reads padding.  A stretch begins with the state that WARM bytes of its neighbour leave behind; once all
are read, each that should have begun with another state - by more than TOLERANCE from the one its
neighbour ended with - is read again from that one, until there is none.  The states are then those
of one walk over the whole text, however long the network remembers.

The network is trained here, in numpy, by backpropagation through time over segments of SEGMENT
bytes, spread over all of each text.
Gates are hard sigmoids and candidates hard tangents, as these need neither exp nor division, and no
byte leaves more than HELD of the state before it, so that states forget and few are read twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm._sample import chosen
from loamworks.llm._text import column, utf8

SEGMENT = 128
HIDDEN = 8
#: Labelled rows of each language that the network is trained on, about; more rows don't make them more.
PER_LANGUAGE = 400
STEPS, BATCH = 300, 192
#: Segments of one row that it is trained on at most, evenly spread over the text.
PER_TEXT = 64
#: Stretches that step together; bytes of one, and of its neighbour that it starts from.
TOGETHER, STRETCH, WARM = 2048, 1024, 96
#: Positions labelled at a time, so that their probabilities stay in the processor's cache.
BLOCK = 16384
#: Most of a state that one byte leaves: what was read long ago fades.
HELD = 0.9
#: By how much a state may differ from the one that one walk over the text would have.
TOLERANCE = 1e-3


@dataclass
class Model:
    """w: (2, 257, 3H) input tables by byte, the last one for padding; u: (2, 3H, H); v: (2, L, H); c: (L,)."""

    languages: list[str]
    w: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray


def new_model(languages: list[str], hidden: int, rng: np.random.Generator) -> Model:
    w = rng.normal(0, 0.3, (2, 257, 3 * hidden)).astype(np.float32)
    w[:, :, : 2 * hidden] += 0.5  # gates begin half open
    u = rng.normal(0, 0.3 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32)
    v = rng.normal(0, 0.3, (2, len(languages), hidden)).astype(np.float32)
    return Model(languages, w, u, v, np.zeros(len(languages), np.float32))


def segments(data: np.ndarray, offsets: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by step and segment with 256 as padding, owner, begin in the text, size) of all texts."""
    size = np.diff(offsets)
    count = -(-size // length)
    owner = np.repeat(np.arange(len(size)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = inside * length
    n = np.minimum(size[owner] - begin, length)
    at = (offsets[owner] + begin)[None, :] + np.arange(length)[:, None]
    x = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int64) if len(data) else np.zeros(at.shape, np.int64)
    x[np.arange(length)[:, None] >= n[None, :]] = 256
    return x, owner, begin, n


def states(model: Model, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(T, 2, H, B) states: [t, 0] after reading bytes 0..t, [t, 1] after reading bytes T-1..t; for training.

    A padding byte leaves the state as it is. `keep` gets what the way back needs.
    """
    steps, n = x.shape
    hidden = model.u.shape[2]
    out = np.empty((steps, 2, hidden, n), np.float32)
    tables = [np.ascontiguousarray(t.T) for t in model.w]
    h = np.zeros((2, hidden, n), np.float32)
    g = np.empty((2, 3 * hidden, n), np.float32)
    padded = x.max(axis=1, initial=0) == 256
    for t in range(steps):
        back = steps - 1 - t
        np.take(tables[0], x[t], axis=1, out=g[0], mode="clip")
        np.take(tables[1], x[back], axis=1, out=g[1], mode="clip")
        r = np.matmul(model.u, h)
        gates = g[:, : 2 * hidden] + r[:, : 2 * hidden]
        raw = gates.copy() if keep is not None else None
        np.clip(gates, 0, 1, out=gates)
        gates[:, hidden:] *= HELD
        if padded[t]:
            gates[0, hidden:, x[t] == 256] = 1
        if padded[back]:
            gates[1, hidden:, x[back] == 256] = 1
        part = r[:, 2 * hidden :]
        cand = part * gates[:, :hidden]
        cand += g[:, 2 * hidden :]
        if keep is not None:
            keep.append((h.copy(), raw, gates, part, cand.copy()))
        np.clip(cand, -1, 1, out=cand)
        h -= cand
        h *= gates[:, hidden:]
        h += cand
        out[t, 0] = h[0]
        out[back, 1] = h[1]
    return out


def position_probabilities(model: Model, h: np.ndarray) -> np.ndarray:
    """(T, L, B)."""
    z = np.matmul(model.v[0], h[:, 0])
    z += np.matmul(model.v[1], h[:, 1])
    z += model.c[:, None]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions that aren't padding, and its gradients through time."""
    steps, n = x.shape
    hidden = model.u.shape[2]
    kept: list = []
    h = states(model, x, kept)
    p = position_probabilities(model, h)
    real = x < 256
    total = max(1, int(real.sum()))
    loss = -float(np.log(np.maximum(p[:, y, np.arange(n)], 1e-12))[real].sum()) / total
    dz = p
    dz[:, y, np.arange(n)] -= 1
    dz *= real[:, None, :] / np.float32(total)
    dv = np.stack([np.einsum("tlb,thb->lh", dz, h[:, d], optimize=True) for d in (0, 1)])
    dc = dz.sum(axis=(0, 2))
    dh_out = [np.matmul(model.v[d].T, dz) for d in (0, 1)]
    dw, du = np.zeros_like(model.w), np.zeros_like(model.u)
    dh = np.zeros((2, hidden, n), np.float32)
    dx = np.empty((2, 3 * hidden, steps, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before, raw, gates, part, cand = kept[t]
        at = (t, steps - 1 - t)
        dh[0] += dh_out[0][at[0]]
        dh[1] += dh_out[1][at[1]]
        z = gates[:, hidden:]
        new = np.clip(cand, -1, 1)
        dcand = dh * (1 - z) * (np.abs(cand) < 1)
        dgates = np.concatenate([dcand * part, HELD * dh * (before - new)], axis=1) * ((raw > 0) & (raw < 1))
        for d in (0, 1):
            dgates[d, hidden:, x[at[d]] == 256] = 0
        dr = np.concatenate([dgates, dcand * gates[:, :hidden]], axis=1)
        dg = np.concatenate([dgates, dcand], axis=1)
        dh = dh * z + np.matmul(model.u.transpose(0, 2, 1), dr)
        du += np.matmul(dr, before.transpose(0, 2, 1))
        for d in (0, 1):
            dx[d, :, at[d]] = dg[d]
    for d in (0, 1):
        for j in range(3 * hidden):
            dw[d, :, j] = np.bincount(x.ravel(), dx[d, j].ravel(), minlength=257)
    dw[:, 256] = 0
    return loss, {"w": dw, "u": du, "v": dv, "c": dc}


def fit(texts: list[str] | list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 4) -> Model:
    """Adam over random segments, as many of one language as of another."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = new_model(languages, hidden, rng)
    data, offsets = utf8(pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.large_binary()))
    x, owner, _, _ = segments(data, offsets)
    of = np.array([languages.index(label) for label in labels])[owner] if len(owner) else np.zeros(0, int)
    pools = [np.flatnonzero(of == k) for k in range(len(languages))]
    pools = [p for p in pools if len(p)]
    m = {k: np.zeros_like(getattr(model, k)) for k in ("w", "u", "v", "c")}
    s = {k: np.zeros_like(getattr(model, k)) for k in m}
    for step in range(1, steps + 1 if pools else 1):
        picked = np.concatenate([rng.choice(p, -(-batch // len(pools))) for p in pools])
        _, grads = gradients(model, x[:, picked], of[picked])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            getattr(model, k)[...] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def spread_segments(text: str, most: int = PER_TEXT) -> list[bytes]:
    """The segments of a text, or `most` of them from its first to its last at even distances."""
    data = text.encode()
    n = -(-len(data) // SEGMENT)
    picked = range(n) if n <= most else [i * (n - 1) // (most - 1) for i in range(most)]
    return [data[i * SEGMENT : (i + 1) * SEGMENT] for i in picked]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from about `per_language` labelled rows of each language, chosen by a hash of id and text.

    Of each row PER_TEXT segments at most, spread over all of it, go to the driver, and rows that
    are equal count once, so its share is bounded. Rows of null id, null or empty text, or null
    language aren't used. None without any row.
    """
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("__key"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang")).where("__id IS NOT NULL AND __text IS NOT NULL AND __text <> '' AND __lang IS NOT NULL").drop("__id")
    counts = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.approx_count_distinct("__key").alias("n")).collect()}  # copies count once
    if not counts:
        return None
    wanted = F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = wanted | ((F.col("__lang") == lang) & chosen(F.col("__key"), per_language, n, 31))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [spread_segments(t) for t in column(batch, "__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "__key"), column(batch, "__lang"), pa.array(made, pa.list_(pa.binary()))], names=["key", "lang", "parts"])

    pieces = rows.where(wanted).mapInArrow(cut, "key long, lang string, parts array<binary>")
    found = sorted((r["lang"], r["key"], r["parts"]) for r in pieces.groupBy("lang", "key").agg(F.first("parts").alias("parts")).collect())
    if not found:
        return None
    return fit([bytes(p) for r in found for p in r[2]], [r[0] for r in found for _ in r[2]])


def label(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, L) pooled probabilities, bytes of each text, and runs of equal labels as (owner, start, length, label)."""
    data, offsets = utf8(texts)
    size = np.diff(offsets)
    pooled, labels = _walk(model, data, offsets)
    pooled /= np.maximum(size, 1)[:, None]
    edge = np.zeros(len(labels), bool)
    edge[1:] = labels[1:] != labels[:-1]
    edge[offsets[:-1][size > 0]] = True
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, len(labels)))
    owner = np.searchsorted(offsets, start, side="right") - 1
    return pooled, size, (owner, start - offsets[owner], length, labels[start] if len(start) else np.zeros(0, np.int32))


def _read(w: np.ndarray, u: np.ndarray, x: np.ndarray, rows: list[int], h: np.ndarray, steps: range, out: np.ndarray | None = None) -> None:
    """Take the (n, H) states `h` of one direction through bytes, in place.

    Step t reads x[rows[t] : rows[t + 1]] into as many of the first states; `out` gets the states
    after each byte. `w`: (3, 257, H) and `u`: (3, H, H), see `_walk`.
    """
    n, hidden = h.shape
    g, r = np.empty((3, n, hidden), np.float32), np.empty((3, n, hidden), np.float32)
    for t in steps:
        a, b = rows[t], rows[t + 1]
        k = b - a
        at, state, gates = x[a:b], h[:k], r[:2, :k]
        np.matmul(state, u, out=r[:, :k])
        for j in (0, 1, 2):
            w[j].take(at, axis=0, out=g[j, :k], mode="clip")
        gates += g[:2, :k]
        z, cand = r[1, :k], r[2, :k]
        np.clip(gates[0], 0, 1, out=gates[0])
        np.clip(z, 0, HELD, out=z)
        cand *= gates[0]
        cand += g[2, :k]
        np.clip(cand, -1, 1, out=cand)
        state -= cand
        state *= z
        state += cand
        if out is not None:
            out[a:b] = state


def _packed(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bytes, their places in `data`, where each step begins): step by step those of all stretches, longest first, that have one."""
    count = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    rows = [0, *np.cumsum(count).tolist()]
    place = np.empty(rows[-1], np.int64)
    for t in range(len(rows) - 1):
        np.add(first[: rows[t + 1] - rows[t]], t, out=place[rows[t] : rows[t + 1]])
    return data[place].astype(np.int64), place, rows


def _walk(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, L) sums of the probabilities of each text's positions, and the label of every byte."""
    size = np.diff(offsets)
    languages, hidden = len(model.languages), model.u.shape[2]
    count = -(-size // STRETCH)
    owner = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
    used = np.minimum(size[owner] - begin, STRETCH)
    first = offsets[owner] + begin
    n = len(owner)
    labels = np.empty(len(data), np.int32)
    sums = np.zeros((n, languages))
    has_left = begin > 0
    has_right = np.append(owner[1:] == owner[:-1], False)[:n]
    # by direction, then gate or candidate: tables by byte and recurrent weights, those of the update gate times HELD
    w = model.w.reshape(2, 257, 3, hidden).transpose(0, 2, 1, 3).astype(np.float32)
    u = model.u.reshape(2, 3, hidden, hidden).transpose(0, 1, 3, 2).astype(np.float32)
    w[:, 1] *= HELD
    u[:, 1] *= HELD
    w, u = np.ascontiguousarray(w), np.ascontiguousarray(u)
    # by stretch: what each direction begins with and ends with
    start, end = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
    for d, beside in ((0, np.flatnonzero(has_left) - 1), (1, np.flatnonzero(has_right) + 1)):
        near = np.minimum(used[beside], WARM)
        beside = beside[np.argsort(-near, kind="stable")]
        for a in range(0, len(beside), TOGETHER):
            s = beside[a : a + TOGETHER]
            length = np.minimum(used[s], WARM)
            x, _, rows = _packed(data, first[s] if d else first[s] + used[s] - length, length)
            h = np.zeros((len(s), hidden), np.float32)
            _read(w[d], u[d], x, rows, h, range(len(rows) - 1)[:: -1 if d else 1])
            start[d, s - 1 if d else s + 1] = h
    room = np.empty((2, min(TOGETHER * STRETCH, len(data)), hidden), np.float32)
    todo = np.arange(n)
    while len(todo):
        todo = todo[np.argsort(-used[todo], kind="stable")]  # equal lengths step together
        for a in range(0, len(todo), TOGETHER):
            s = todo[a : a + TOGETHER]
            x, place, rows = _packed(data, first[s], used[s])
            out = room[:, : len(x)]
            for d in (0, 1):
                h = start[d, s]
                _read(w[d], u[d], x, rows, h, range(len(rows) - 1)[:: -1 if d else 1], out[d])
                end[d, s] = h
            sums[s] = _label_positions(model, out, rows, place, labels, len(s))
        should = np.zeros_like(start)
        should[0, has_left] = end[0, np.flatnonzero(has_left) - 1]
        should[1, has_right] = end[1, np.flatnonzero(has_right) + 1]
        todo = np.flatnonzero((np.abs(should - start) > TOLERANCE).any(axis=(0, 2)))
        start[:, todo] = should[:, todo]
    return np.stack([np.bincount(owner, sums[:, k], minlength=len(size)) for k in range(languages)], axis=1, dtype=np.float64), labels


def _label_positions(model: Model, out: np.ndarray, rows: list[int], place: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """(n, L) sums of the probabilities of each stretch's positions; fills `labels` at `place`."""
    sums = np.zeros((len(model.languages), n))
    t = 0
    while t < len(rows) - 1:
        last = t + 1
        while last < len(rows) - 1 and rows[last + 1] - rows[t] <= BLOCK:
            last += 1
        a, b = rows[t], rows[last]
        p = position_probabilities(model, out[:, a:b].transpose(0, 2, 1)[None])[0]
        top = p.max(axis=0)
        best = np.empty(b - a, np.int32)
        for k in range(len(p) - 1, -1, -1):  # the first by name in a tie
            np.copyto(best, k, where=p[k] == top)
        labels[place[a:b]] = best
        for i in range(t, last):
            sums[:, : rows[i + 1] - rows[i]] += p[:, rows[i] - a : rows[i + 1] - a]
        t = last
    return sums.T


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, probability, runs) for every row of `docs`: after training, a map without a shuffle.

    `lang` has the highest pooled probability, the first by name in a tie. `runs` labels every
    position of the text's UTF-8 bytes: array of (start, length, lang), without gaps. A null or
    empty text has null lang and probability and no runs; so has every text if no row is labelled
    to train on. Repeated rows and null ids stay; other columns are ignored.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    arrow_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None:
                yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array([[]] * n, pa.list_(arrow_run))], names=[id_col, "lang", "probability", "runs"])
                continue
            names = pa.array(model.languages, pa.string())
            pooled, size, (owner, start, length, of) = label(model, column(batch, "__text"))
            none = size == 0
            best = pa.array(pooled.argmax(axis=1), pa.int32(), mask=none)
            offsets = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(length), names.take(pa.array(of.astype(np.int32)))], fields=list(arrow_run)))
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), names.take(best), pa.array(pooled.max(axis=1, initial=0), pa.float64(), mask=none), runs], names=[id_col, "lang", "probability", "runs"])

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang string, probability double, runs array<struct<start: bigint, length: bigint, lang: string>>")
