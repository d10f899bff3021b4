"""MinHash near-duplicate removal with sequential Bayesian verification.

1. Rows with the same sequence of words are one node. A node has one MinHash signature.
2. Nodes that agree in a band of the signature share a bucket; pairs come from buckets.
3. A pair's signatures are compared a batch of hashes at a time. After m agreements among n, the
   posterior of the similarity (uniform prior) bounds the chance that the pair reaches the
   threshold; once it is below the chosen miss probability, the pair is dropped.
4. Survivors are verified exactly on their sets of shingles.
5. Groups are the connected components of verified pairs.

Only pairs that could still join two groups are compared: first each node with the bucket leader
it meets most often, then with its other leaders in other groups, then all pairs across groups of
a bucket.  Pairs inside a group can't change it, so a group of thousands costs thousands of
comparisons, not millions, and no bucket or list of partners is capped.

Buckets and posterior can miss a pair. So last, an exact prefix filter over the shingles of all nodes
finds every pair across groups that can still reach the threshold, and these are verified too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.llm import _text
from loamworks.llm._io import Scratch
from loamworks.llm._text import WORD_SQL, blobs, column, flat, lowered, pieces, shingle_hashes, spans, utf8, word_hashes

SHINGLE = 3
THRESHOLD = 0.6
#: A pair at the threshold shares no bucket once in 7200 times, one at 0.65 once in 290 000.
BANDS, ROWS = 64, 4
#: Hashes compared before the posterior is looked at again.
BATCH = 32
MISS = 1e-6
#: Characters whose shingles one task counts, and shingles that are dealt to the tasks at a time.
CHARS, DEALT = 4_000_000, 500_000

_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 1 << 32, 1024, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint64).astype(np.uint32)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest agreements among n hashes with P(similarity >= threshold) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at the
    threshold is the lower tail of a binomial with n + 1 trials.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def text_keys(words: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes for each text's sequence of words; None for a text without words."""
    count = np.diff(first)
    full = np.flatnonzero(count > 0)
    keys: list[bytes | None] = [None] * len(count)
    if len(full):
        powers, _ = _text._powers(int(count.max()) + 1)
        at = np.arange(len(words)) - np.repeat(first[:-1], count)
        p = powers[at]
        pair = np.empty((len(full), 2), np.uint64)
        pair[:, 0] = _text.mix(np.add.reduceat(words * p, first[full]) + count[full].astype(np.uint64))
        pair[:, 1] = _text.mix(np.add.reduceat(_text.mix(words ^ np.uint64(0x5851F42D4C957F2D)) * p, first[full]))
        raw = pair.tobytes()
        for i, f in enumerate(full.tolist()):
            keys[f] = raw[16 * i : 16 * i + 16]
    return keys


def text_head(th: str) -> Column:
    """The first 8 bytes as a number, the lowest first, as numpy reads them."""
    word = F.hex(th)
    swapped = F.concat(*(F.substring(word, 15 - 2 * i, 2) for i in range(8)))
    high = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def signatures(texts: pa.Array, shingle: int, hashes: int) -> tuple[list[bytes | None], list[bytes | None]]:
    """(key, signature) of each text; both None for a text without words. hashes = 0: no signatures."""
    keys: list[bytes | None] = []
    signed: list[bytes | None] = []
    data, offsets = utf8(lowered(texts))
    for lo, hi in pieces(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = spans(part, off)
        words = word_hashes(part, starts, ends)
        own = text_keys(words, first)
        keys += own
        if not hashes:
            continue
        values, begin = shingle_hashes(words, first, shingle, short=True)
        full = np.flatnonzero(np.diff(begin) > 0)
        result: list[bytes | None] = [None] * (hi - lo)
        if len(full):
            low = values.astype(np.uint32)
            work = np.empty_like(low)
            table = np.empty((hashes, len(full)), np.uint32)
            for h in range(hashes):
                np.multiply(low, _MULTIPLY[h], out=work)
                np.add(work, _ADD[h], out=work)
                np.minimum.reduceat(work, begin[full], out=table[h])
            raw = np.ascontiguousarray(table.T).tobytes()
            for i, f in enumerate(full.tolist()):
                result[f] = raw[4 * hashes * i : 4 * hashes * (i + 1)]
        signed += result
    return keys, signed


def id_types(docs: DataFrame, id_col: str) -> tuple[str, str]:
    """The types of an id as the operators carry it, and of its place in the order of ids."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        return "long", "long"
    name = kind.simpleString()
    return name, f"struct<last: boolean, id: {name}>"


def id_order(ids: Column, kind: str) -> Column:
    """The place of an id of type `kind`: a null id comes after all others."""
    return F.coalesce(ids, F.lit(2**63 - 1)) if kind == "long" else F.struct(ids.isNull().alias("last"), ids.alias("id"))


def id_at(order: str, kind: str) -> Column:
    """The id that has this place."""
    return F.nullif(F.col(order), F.lit(2**63 - 1)) if kind == "long" else F.col(f"{order}.id")


def _sign(docs: DataFrame, kind: str, shingle: int, hashes: int) -> DataFrame:
    """(__id, th, sig) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, signed = signatures(column(batch, "__text"), shingle, hashes)
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], names=["__id", "th", "sig"])

    return docs.mapInArrow(run, f"__id {kind}, th binary, sig binary")


def _keyed_texts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = signatures(column(batch, "__text"), 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), column(batch, "__text")], names=["th", "text"])

    return docs.mapInArrow(run, "th binary, text string")


def _bands(nodes: DataFrame, order: str, bands: int, rows: int) -> DataFrame:
    """(key, node) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                n = part.num_rows
                sig = np.frombuffer(b"".join(column(part, "sig").to_pylist()), np.uint32).reshape(n, -1)
                for b in range(bands):
                    h = np.full(n, (b * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), np.uint64)
                    for r in range(rows):
                        h = _text.mix(h ^ sig[:, b * rows + r])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), column(part, "ord"), column(part, "th")], names=["key", "ord", "th"])

    return nodes.select("ord", "th", "sig").mapInArrow(run, f"key long, ord {order}, th binary")


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, order: str, scratch: Scratch, name: str, shingle: int, threshold: float, batch_hashes: int, miss: float) -> DataFrame:
    """The pairs (a, b) of nodes that reach the threshold, by 64-bit hashes of all their shingles. miss = 0: none is dropped before, and no signatures are read."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint32).reshape(n, -1) for c in ("sig_a", "sig_b"))
            alive, same = np.arange(n), np.zeros(n, np.int64)
            for lo in range(0, a.shape[1], batch_hashes):
                hi = min(lo + batch_hashes, a.shape[1])
                same[alive] += (a[alive, lo:hi] == b[alive, lo:hi]).sum(axis=1)
                alive = alive[same[alive] >= least_matches(hi, threshold, miss)]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}

        def shingles(key: bytes, text: str) -> np.ndarray:
            if key not in sets:
                if len(sets) > 500:
                    sets.clear()
                data, offsets = utf8(lowered(pa.array([text], pa.string())))
                starts, ends, first = spans(data, offsets)
                sets[key] = np.unique(shingle_hashes(word_hashes(data, starts, ends), first, shingle, short=True)[0])
            return sets[key]

        for batch in batches:
            keep = []
            texts_a, texts_b = column(batch, "text_a"), column(batch, "text_b")
            for i, (a, b) in enumerate(zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True)):
                x, y = shingles(a["th"], texts_a[i].as_py()), shingles(b["th"], texts_b[i].as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= threshold * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    node = f"struct<ord: {order}, th: binary>"
    if not miss:
        likely = pairs.select("a", "b")
    else:
        sig = nodes.select("th", "sig")
        both = pairs.join(sig.select(F.col("th").alias("th_a"), F.col("sig").alias("sig_a")), F.col("a.th") == F.col("th_a")).join(sig.select(F.col("th").alias("th_b"), F.col("sig").alias("sig_b")), F.col("b.th") == F.col("th_b"))
        likely = both.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, f"a {node}, b {node}")
    full = likely.join(texts.select(F.col("th").alias("th_b"), F.col("text").alias("text_b")), F.col("b.th") == F.col("th_b")).join(texts.select(F.col("th").alias("th_a"), F.col("text").alias("text_a")), F.col("a.th") == F.col("th_a"))
    return scratch.keep(full.select("a", "b", "text_a", "text_b").mapInArrow(exact, f"a {node}, b {node}"), name)


def _unmet(docs: DataFrame, nodes: DataFrame, labels: DataFrame, shingle: int, threshold: float, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of nodes in different groups that can reach the threshold.

    Two sets of n and m that do share at least threshold * max(n, m) shingles, so in any order of
    all shingles a shared one is among the first n - threshold * n + 1 of the one, and so of the
    other. The order is by the number of texts a shingle is in: those of one text come first and are
    shared by none. A pair's first common place bounds what can be common from there on.
    Shingles go by 48 bits here, which only adds pairs: of a text's n, d fell together with another
    of its own, and as many fewer must be common, so the prefix is as long as without that.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length("__text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS))

    def part(x: np.ndarray) -> np.ndarray:
        return (_text.mix(x.astype(np.uint64)) >> np.uint64(20)) % np.uint64(parts)

    def halves(h: np.ndarray) -> list[np.ndarray]:
        return [(h >> 16).astype(np.uint32), (h & 0xFFFF).astype(np.uint16)]

    def whole(table: pa.Table) -> np.ndarray:
        return flat(table, "high", np.uint32).astype(np.int64) << 16 | flat(table, "low", np.uint16)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            data, offsets = utf8(lowered(column(batch, "__text")))
            for lo, hi in pieces(offsets):
                own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = spans(own, off)
                words = word_hashes(own, starts, ends)
                h, begin = shingle_hashes(words, first, shingle, short=True)
                if not len(h):
                    continue
                text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                h = h[np.lexsort((h, text))]  # the order by text is as it was
                other = np.concatenate([[True], text[1:] != text[:-1]])
                n = np.bincount(text[other | (h != np.roll(h, 1))], minlength=len(begin) - 1).astype(np.int32)
                h = (h >> np.uint64(16)).view(np.int64)
                fresh = other | (h != np.roll(h, 1))
                h, text = h[fresh], text[fresh]
                d = n - np.bincount(text, minlength=len(begin) - 1).astype(np.int32)
                t = np.frombuffer(b"".join(k[:8] if k else bytes(8) for k in text_keys(words, first)), np.int64)
                held.append([h, t[text], n[text], d[text]])
                if sum(len(x[0]) for x in held) >= DEALT:
                    x = [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                    yield blobs(part(x[0]), [*halves(x[0]), *x[1:]], ["part", "high", "low", "t", "n", "d"])
        if held:
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield blobs(part(x[0]), [*halves(x[0]), *x[1:]], ["part", "high", "low", "t", "n", "d"])

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        h, t = whole(table), flat(table, "t")
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])  # copies of a text are one
        h, t, order = h[fresh], t[fresh], order[fresh]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(begin, len(h)))
        count = np.repeat(count, count)
        own = count > 1
        h, t, order = h[own], t[own], order[own]
        more = [np.minimum(count[own], 0xFFFF).astype(np.uint16), *(flat(table, x, np.int32)[order] for x in ("n", "d"))]
        return pa.Table.from_batches([blobs(part(t), [*halves(h), t, *more], ["part", "high", "low", "t", "count", "n", "d"])])

    def prefixes(key: tuple, table: pa.Table) -> pa.Table:
        h, t, n, d = whole(table), flat(table, "t"), flat(table, "n", np.int32), flat(table, "d", np.int32)
        order = np.lexsort((h, flat(table, "count", np.uint16), t))
        h, t, n, d = h[order], t[order], n[order], d[order]
        fresh = np.concatenate([[True], t[1:] != t[:-1]])
        begin, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        alone = n[begin] - d[begin] - np.diff(np.append(begin, len(t)))
        at = np.arange(len(t)) - begin[of] + alone[of]
        own = at < (n - np.ceil(threshold * n - 1e-6) + 1)
        found = blobs(of[own], [h[own], at[own].astype(np.int32)], ["i", "h", "at"])
        i = begin[column(found, "i").to_numpy()]
        return pa.table({"t": t[i], "n": n[i], "h": column(found, "h"), "at": column(found, "at")})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = [len(x) // 8 for x in column(batch, "h").to_pylist()]
                h = flat(batch, "h")
                yield blobs(part(h), [h, flat(batch, "at", np.int32), *(np.repeat(column(batch, c).to_numpy(), size) for c in ("t", "n", "g"))], ["part", "h", "at", "t", "n", "g"])

    def crossing(key: tuple, table: pa.Table) -> pa.Table:
        c = {x: flat(table, x, np.int32 if x in ("at", "n") else np.int64) for x in ("h", "t", "g", "n", "at")}
        order = np.argsort(c["h"], kind="stable")
        h, g = c["h"][order], c["g"][order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(g, begin) != np.maximum.reduceat(g, begin)
        own = order[np.repeat(several, np.diff(np.append(begin, len(h))))]
        return pa.table({x: v[own] for x, v in c.items()})

    counted = docs.select("__text").mapInArrow(dealt, "part long, high binary, low binary, t binary, n binary, d binary").groupBy("part").applyInArrow(shared, "part long, high binary, low binary, t binary, count binary, n binary, d binary")
    first = counted.groupBy("part").applyInArrow(prefixes, "t long, n int, h binary, at binary")
    own = nodes.select("th", text_head("th").alias("t"))
    grouped = own.join(labels.select("th", F.col("label.th").alias("l")), "th", "left").select("t", F.when(F.col("l").isNull(), F.col("t")).otherwise(text_head("l")).alias("g"))
    met = first.join(grouped, "t").mapInArrow(spread, "part long, h binary, at binary, t binary, n binary, g binary").groupBy("part").applyInArrow(crossing, "h long, t long, g long, n int, at int")
    met = scratch.keep(met, "met")
    a, b = (met.select("h", *(F.col(x).alias(f"{x}_{s}") for x in ("t", "g", "n", "at"))) for s in "ab")
    sizes = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6
    pairs = a.join(b, "h").where((F.col("t_a") < F.col("t_b")) & (F.col("g_a") != F.col("g_b")) & sizes).groupBy("t_a", "t_b", "n_a", "n_b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    likely = pairs.where(most >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    for s in "ab":
        likely = likely.join(nodes.select(text_head("th").alias(f"t_{s}"), F.struct("ord", "th").alias(s)), f"t_{s}")
    unmet = scratch.keep(likely.select("a", "b"), "unmet")
    scratch.drop("met")
    return unmet


def components(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, str]:
    """(th, label) for each node of an edge (a, b), and the scratch table it is in; label: the least node of its component.

    Each round takes the least label among the neighbours and then the label's own label, so a
    chain of any length is halved. It ends when no label changes.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b"), F.col("a")))
    links = scratch.keep(both.distinct(), f"{name}-links")
    labels = scratch.keep(links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select(F.col("node.th").alias("th"), F.least("node", "y").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = links.select(F.col("x.th").alias("th"), F.col("y.th").alias("to")).join(labels.select(F.col("th").alias("to"), "label"), "to").groupBy("th").agg(F.min("label").alias("near"))
        lower = labels.join(near, "th").select("th", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("th").alias("up_th"), F.col("label").alias("up"))
        fresh = scratch.keep(lower.join(up, F.col("label.th") == F.col("up_th"), "left").select("th", "was", F.least("label", "up").alias("label")), f"{name}-{step}")
        changed = fresh.where(F.col("was") != F.col("label")).limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = fresh.select("th", "label")
        if not changed:
            scratch.drop(f"{name}-links")
            return labels, f"{name}-{step}"


def _groups(docs: DataFrame, kind: str, order: str, scratch: Scratch, shingle: int, threshold: float, bands: int, rows: int, batch_hashes: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(signed rows: __id, th) and (th, label) of the nodes that are in a group with another node."""
    labels_kept: list[str] = []
    signed = scratch.keep(_sign(docs, kind, shingle, bands * rows), "signed")
    nodes = scratch.keep(signed.where("th IS NOT NULL").groupBy("th").agg(F.min(id_order(F.col("__id"), kind)).alias("ord"), F.first("sig").alias("sig")), "nodes")
    bucket = Window.partitionBy("key")
    node = F.struct("ord", "th")
    members = scratch.keep(
        _bands(nodes, order, bands, rows).select("key", node.alias("b"), F.min(node).over(bucket).alias("a"), F.count("*").over(bucket).alias("n")).where("n > 1").drop("n"),
        "members",
    )
    in_bucket = members.select(F.col("b.th").alias("th")).distinct()
    # any of the texts of a node will do: their words are the same
    texts = scratch.keep(_keyed_texts(docs.select("__text").where("__text IS NOT NULL")).join(in_bucket, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")), "texts")

    led = scratch.keep(members.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.count("*").alias("met")), "led")
    most = led.groupBy("b").agg(F.max_by("a", F.struct("met", F.col("a"))).alias("a")).select("a", "b")
    edges = _verify(most, nodes, texts, order, scratch, "edges-1", shingle, threshold, batch_hashes, miss)
    labels, table = components(edges, scratch, "labels-1")
    labels_kept.append(table)

    def crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends aren't in the same group yet."""
        at = [labels.select(F.col("th").alias(f"th_{s}"), F.col("label.th").alias(f"label_{s}")) for s in "ab"]
        joined = pairs.join(at[0], F.col("a.th") == F.col("th_a"), "left").join(at[1], F.col("b.th") == F.col("th_b"), "left")
        return joined.where(F.coalesce("label_a", "a.th") != F.coalesce("label_b", "b.th")).select("a", "b")

    more = _verify(crossing(led.select("a", "b").join(most, ["a", "b"], "left_anti"), labels), nodes, texts, order, scratch, "edges-2", shingle, threshold, batch_hashes, miss)
    edges = edges.unionAll(more)
    labels, table = components(edges, scratch, "labels-2")
    labels_kept.append(table)

    # buckets that still hold several groups: all pairs across groups that haven't been compared
    grouped = members.select("key", "b").join(labels.select(F.col("th").alias("to"), F.col("label.th").alias("label")), F.col("b.th") == F.col("to"), "left").select("key", "b", F.coalesce("label", "b.th").alias("label"))
    mixed = grouped.join(grouped.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key"), "key", "left_semi")
    mixed = scratch.keep(mixed, "mixed")
    other = mixed.select("key", F.col("b").alias("a"), F.col("label").alias("label_a"))
    across = mixed.join(other, "key").where(F.col("label") != F.col("label_a")).where(F.col("a") < F.col("b")).select("a", "b").distinct()
    last = _verify(across.join(led, ["a", "b"], "left_anti"), nodes, texts, order, scratch, "edges-3", shingle, threshold, batch_hashes, miss)
    labels, table = components(edges.unionAll(last), scratch, "labels-3")
    labels_kept.append(table)
    # what no bucket brought together, and what the posterior dropped; the signatures go first, as this takes their room
    edges = edges.unionAll(last)
    signed = scratch.keep(signed.select("__id", "th"), "rows")
    nodes = scratch.keep(nodes.select("th", "ord"), "places")
    scratch.drop("signed", "nodes", "texts", "led", "mixed", "members", *labels_kept[:-1])
    unmet = _unmet(docs, nodes, labels, shingle, threshold, scratch)
    if unmet.limit(1).count():
        ends = unmet.select(F.col("a.th").alias("th")).unionAll(unmet.select(F.col("b.th"))).distinct()
        their = scratch.keep(_keyed_texts(docs.select("__text").where("__text IS NOT NULL")).join(ends, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")), "texts-4")
        missed = _verify(unmet, nodes, their, order, scratch, "edges-4", shingle, threshold, batch_hashes, 0)
        if missed.limit(1).count():
            labels, table = components(edges.unionAll(missed), scratch, "labels-4")
            labels_kept.append(table)
    groups = scratch.keep(labels.join(nodes.select("th", "ord"), "th").select("th", "ord", "label"), "groups")
    scratch.drop("texts-4", "places", "unmet", *(f"edges-{i}" for i in (1, 2, 3, 4)), *labels_kept)
    return signed, groups


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    batch_hashes: int = BATCH,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, group_id, keep), one row for each row of `docs`; group_id: the least id of its group.

    Two texts are near duplicates if the Jaccard similarity of their sets of `shingle` words
    reaches the threshold; a text of fewer words is one shingle. The sets are compared by 64-bit
    hashes of their shingles. Groups are connected by such pairs. Ids may be of any type that can
    be ordered. One row of each group is kept: of its least id, and one of them if that is repeated.
    A null or empty text, or one without words, is a group by itself and kept. A null id comes
    last in a group. Other columns are ignored; an empty table gives an empty result.
    """
    kind, order = id_types(docs, id_col)
    slim = docs.select(F.col(id_col).cast(kind).alias("__id"), F.col(text_col).alias("__text"))
    scratch = Scratch(docs.sparkSession, "near-dedup")
    signed, groups = _groups(slim, kind, order, scratch, shingle, threshold, bands, rows, batch_hashes, miss)
    # rows without words get a place of their own, so they neither meet nor pile up in one task
    alone = F.when(F.col("th").isNull(), F.monotonically_increasing_id())
    same = Window.partitionBy("th", "alone")
    joined = signed.withColumn("alone", alone).join(groups, "th", "left")
    ranked = joined.withColumn("at", F.row_number().over(same.orderBy(id_order(F.col("__id"), kind)))).withColumn("least", F.min("__id").over(same))
    whole = F.col("label").isNull()
    group = F.when(whole, F.col("least")).otherwise(id_at("label.ord", kind))
    found = ranked.select(F.col("__id").alias(id_col), group.alias("group_id"), ((F.col("at") == 1) & (whole | (F.col("label.th") == F.col("th")))).alias("keep"))
    kept = scratch.keep(found, "found")
    scratch.drop("rows", "groups")
    return kept


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, batch_hashes: int = BATCH, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near duplicates; all columns stay. See near_duplicates()."""
    kind, order = id_types(docs, id_col)
    slim = docs.select(F.col(id_col).cast(kind).alias("__id"), F.col(text_col).alias("__text"))
    scratch = Scratch(docs.sparkSession, "near-dedup")
    _, groups = _groups(slim, kind, order, scratch, shingle, threshold, bands, rows, batch_hashes, miss)
    at = docs.columns.index(text_col)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = signatures(batch.column(at), 1, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*names, "__th"])

    keyed = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("__th", T.BinaryType())]))
    losers = scratch.keep(groups.where(F.col("label.th") != F.col("th")).select(F.col("th").alias("__th")), "losers")
    scratch.drop("rows", "groups")
    left = keyed.join(losers, "__th", "left_anti").withColumn("__alone", F.when(F.col("__th").isNull(), F.monotonically_increasing_id()))
    by = Window.partitionBy("__th", "__alone").orderBy(id_order(F.col(names[docs.columns.index(id_col)]).cast(kind), kind))
    first = left.withColumn("__at", F.row_number().over(by)).where("__at = 1")
    return first.select(*names).toDF(*docs.columns)


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {SHINGLE} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {SHINGLE - 1}], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE shared >= {THRESHOLD}::DOUBLE * (x.n + y.n - shared)),
both_ways AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x)
SELECT x AS doc_id, min(y) AS group_id, x = min(y) AS keep FROM reach GROUP BY x
"""
