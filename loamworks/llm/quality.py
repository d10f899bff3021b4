"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Only trusted positives (labelled rows of good quality that aren't labelled toxic) and unlabelled web
text are used; labelled bad or toxic rows are never shown to the model as such.  With g the model, l
the logistic loss and p the class prior, it minimises

    p E_pos[l(g)]  +  max(0, E_unl[l(-g)] - p E_pos[l(-g)])

and where the bracket turns negative it steps against it, as a model that fits its sample too
closely would make it do.  The prior is estimated beforehand: a classifier of positives against
unlabelled text orders held-out rows, and p is the least ratio of the unlabelled share to the
positive share above any cut of that order.

The positives are a bounded sample of the labelled rows; the unlabelled text is every document.  Its
features are written once, in random order; in each of ROUNDS rounds every task trains a copy of the
model on each shard of its rows, and the copies are averaged.

Besides the form of a text the model sees its words, by hash: those that clearly more of the
unlabelled than of the trusted texts have, or have often, are evidence against a text, as toxic
words are.  Where they make it likelier than not that a text isn't good, its score is set below the
cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm._sample import chosen
from loamworks.llm._io import Scratch
from loamworks.llm._text import column, lowered, mix, pieces, spans, utf8, word_hashes

#: Labelled rows that the model is fitted on, about; more labels don't make them more.
POSITIVES = 8000
#: Rounds of training, passes over each shard in one, rows of a shard; shards of a task.
ROUNDS, EPOCHS, SHARD, SHARDS = 6, 10, 8192, 2
HIDDEN = 12
#: Fewer trusted positives or unlabelled rows than this teach nothing.
LEAST = 4
#: The cut lies below this quantile of held-out trusted positives, by its distance from their median.
LOW = 0.01
#: Share of the trusted positives that their words may reject.
REJECTED_POSITIVES = 0.002

_KINDS = 12
_KIND = np.full(256, 11, np.uint8)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("aeiouy", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t", 4), ("\n\r", 5), (".,;:!?", 6), ("'\"()[]-", 7), ("|", 8), ("%&*#$@~^_+=<>/\\{}`", 9)):
    for _c in _chars:
        _KIND[ord(_c)] = _k
_KIND[0x80:] = 10
FEATURES = _KINDS * _KINDS + 6
#: Words, the first PREFIX bytes of longer ones, and those of them that are OFTEN twice or more and one word of so many, are hashed to so many buckets.
BUCKETS, PREFIX, OFTEN = 1 << 20, 6, 256
_BLOCKS = 32
#: Standard errors by which a bucket's share of the unlabelled texts must exceed its share of the trusted ones.
EVIDENT = 3.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, FEATURES) of whole texts, and which of them have a word at all.

    Shares of pairs of neighbouring character kinds, and of words: the logarithm of their number,
    mean length, share of distinct words, of distinct pairs, of words equal to the one before, and
    of the characters outside words.
    """
    n = len(texts)
    x, some = np.zeros((n, FEATURES), np.float32), np.zeros(n, bool)
    data, offsets = utf8(texts)
    low, low_offsets = utf8(lowered(texts))
    for lo, hi in pieces(offsets):
        m = hi - lo
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        size = np.diff(off)
        if len(part) > 1:
            kind = _KIND[part].astype(np.int64)
            doc = np.repeat(np.arange(m) * (_KINDS * _KINDS), size)
            pair = doc[:-1] + kind[:-1] * _KINDS + kind[1:]
            inner = off[1:-1]
            inner = inner[(inner > 0) & (inner < len(part))]
            same = np.ones(len(pair), bool)
            same[inner - 1] = False
            counts = np.bincount(pair[same], minlength=m * _KINDS * _KINDS).reshape(m, -1)
            x[lo:hi, : _KINDS * _KINDS] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
        part, off = low[low_offsets[lo] : low_offsets[hi]], low_offsets[lo : hi + 1] - low_offsets[lo]
        starts, ends, first = spans(part, off)
        count = np.diff(first)
        words = word_hashes(part, starts, ends)
        safe = np.maximum(count, 1)
        owner = np.repeat(np.arange(m), count)
        f = x[lo:hi, _KINDS * _KINDS :]
        f[:, 0] = np.log1p(count)
        letters = np.bincount(owner, ends - starts, minlength=m)
        f[:, 1] = letters / safe
        f[:, 2] = _distinct(owner, words, m) / safe
        inside = owner[:-1] == owner[1:]
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[inside]
        f[:, 3] = _distinct(owner[:-1][inside], pairs, m) / np.maximum(count - 1, 1)
        f[:, 4] = np.bincount(owner[1:][inside & (words[:-1] == words[1:])], minlength=m) / safe
        f[:, 5] = 1 - letters / np.maximum(np.diff(off), 1)
        some[lo:hi] = count > 0
    return x, some


def word_buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, text less lo, bucket) of the distinct buckets of consecutive texts: words, first bytes, frequent first bytes."""
    data, offsets = utf8(lowered(texts))
    for lo, hi in pieces(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = spans(part, offsets[lo : hi + 1] - offsets[lo])
        count = np.diff(first)
        owner = np.repeat(np.arange(hi - lo), count)
        long = ends - starts > PREFIX
        heads = word_hashes(part, starts[long], starts[long] + PREFIX)
        of = np.uint64(BUCKETS)
        whole = owner * BUCKETS + (word_hashes(part, starts, ends) % of).astype(np.int64)
        head, times = np.unique(owner[long] * BUCKETS + ((heads + np.uint64(1)) % of).astype(np.int64), return_counts=True)
        text = head // BUCKETS
        often = (times > 1) & (times * OFTEN >= count[text])
        again = text[often] * BUCKETS + (mix(head[often].astype(np.uint64) % of + np.uint64(BUCKETS)) % of).astype(np.int64)
        both = np.unique(np.concatenate([whole, head, again]))
        yield lo, hi, both // BUCKETS, both % BUCKETS


def weigh_words(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int) -> np.ndarray:
    """(BUCKETS,) evidence of a bucket against a text, from the numbers of texts that have it; 0 if it isn't clear."""
    share_p, share_u = pos / n_pos, unl / n_unl
    both = (pos + unl) / (n_pos + n_unl)
    error = np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl))
    weight = np.log((unl + 1) / (n_unl + 1)) - np.log((pos + 1) / (n_pos + 1))
    return np.where((share_u - share_p > EVIDENT * error) & (weight > 0), weight, 0.0).astype(np.float32)


def evidence(owner: np.ndarray, bucket: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    """The sum of the weights of each text's buckets."""
    return np.bincount(owner, words[bucket], minlength=n)


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    bits = max(1, int(n).bit_length())
    key = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (values >> np.uint64(bits)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] >> np.uint64(64 - bits)).astype(np.int64), minlength=n)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 1.0
    cut: float = 0.0
    #: (BUCKETS,) evidence against a text; without it the model looks at form only.
    words: np.ndarray | None = None
    #: More evidence than this rejects a text.
    most: float = np.inf

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale).clip(-6, 6) @ self.w1 + self.b1, 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


_NAMES = ("w1", "b1", "w2", "b2")


def new_model(mean: np.ndarray, scale: np.ndarray, seed: int, hidden: int = HIDDEN) -> Model:
    rng = np.random.default_rng(seed)
    n = len(mean)
    return Model(mean, scale, rng.normal(0, 1 / np.sqrt(n), (n, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)


def risk(gp: np.ndarray, gu: np.ndarray, prior: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """What a step lowers, by the scores of positives and of unlabelled rows, and its slopes by these.

    With a prior, the non-negative risk; where its bracket is negative, minus the bracket. Without,
    the loss of positives against unlabelled rows, to order rows.
    """
    n, m = max(len(gp), 1), max(len(gu), 1)
    if prior is None:
        return float(np.logaddexp(0, -gp).sum() / n + np.logaddexp(0, gu).sum() / m), -_sigmoid(-gp) / n, _sigmoid(gu) / m
    bracket = np.logaddexp(0, gu).sum() / m - prior * np.logaddexp(0, gp).sum() / n
    if bracket >= 0:
        return float(prior * np.logaddexp(0, -gp).sum() / n + bracket), prior * (-_sigmoid(-gp) - _sigmoid(gp)) / n, _sigmoid(gu) / m
    return float(-bracket), prior * _sigmoid(gp) / n, -_sigmoid(gu) / m


def gradients(model: Model, x: np.ndarray, d: np.ndarray, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """From the slopes d by the scores of rows x; `decay` pulls the weights towards 0."""
    z = ((x - model.mean) / model.scale).clip(-6, 6)
    h = np.maximum(z @ model.w1 + model.b1, 0)
    dh = np.outer(d, model.w2) * (h > 0)
    return {"w1": z.T @ dh + decay * model.w1, "b1": dh.sum(0), "w2": h.T @ d + decay * model.w2, "b2": np.asarray(d.sum())}


def train_copy(model: Model, pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int, seed: int, rate: float = 3e-3, batch: int = 256) -> Model:
    """A copy trained on all of `unl` with as many parts of `pos`, by Adam."""
    rng = np.random.default_rng(seed)
    own = Model(model.mean, model.scale, *(np.array(getattr(model, k), float) for k in _NAMES))
    m = {k: np.zeros_like(getattr(own, k)) for k in _NAMES}
    v = {k: np.zeros_like(getattr(own, k)) for k in _NAMES}
    step, batches = 0, max(1, len(unl) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(pos))
        for i, iu in enumerate(np.array_split(rng.permutation(len(unl)), batches)):
            width = max(16, -(-len(pos) // batches))
            ip = order[np.arange(i * width, (i + 1) * width) % len(order)] if width < len(pos) else order
            x = np.concatenate([pos[ip], unl[iu]])
            g = own.score(x)
            _, dp, du = risk(g[: len(ip)], g[len(ip) :], prior)
            grads = gradients(own, x, np.concatenate([dp, du]))
            step += 1
            for k in _NAMES:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(own, k, getattr(own, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    return own


def prior_of(p: np.ndarray, above_u: np.ndarray, n_unl: int) -> float:
    """Share of positives among n_unl unlabelled rows: the least ratio of tail shares.

    p: ascending scores of held-out positives; above_u: how many unlabelled rows score as high as
    each of the first nine tenths of them.
    """
    cuts = p[: max(1, len(p) * 9 // 10)]
    above_p = (len(p) - np.searchsorted(p, cuts)) / len(p)
    share = above_u / max(n_unl, 1)
    # two standard errors are added, as the least of many ratios falls below the true one by chance
    error = np.sqrt(share * (1 - share) / max(n_unl, 1) + share**2 / above_p * (1 - above_p) / len(p))
    return float(np.clip(((share + 2 * error) / above_p).min(), 0.05, 0.98))


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = 0.0, 0
    for b in batches:
        for v, w in zip(column(b, "value").to_pylist(), column(b, "n").to_pylist(), strict=True):
            total, n = total + np.frombuffer(v, np.float64), n + w
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["block", "value", "n"])


_SUM = "block int, value binary, n long"


def _summed(rows: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """Sums of the values and weights of (block, value, n), a few blocks of fixed size."""
    return {r["block"]: (np.frombuffer(r["value"], np.float64), r["n"]) for r in rows.groupBy("block").applyInArrow(_add, _SUM).collect()}


def _one(value: np.ndarray, n: int, block: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.asarray(value, np.float64).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["block", "value", "n"])


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, "x").to_pylist()), np.float16).reshape(-1, FEATURES).astype(float)


def _count_buckets(slim: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket is, and how many texts have a word, over all rows."""
    size = BUCKETS // _BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, owner, bucket in word_buckets(column(batch, "__text")):
                counts += np.bincount(bucket, minlength=BUCKETS)
                n += len(np.unique(owner))
        for k in range(_BLOCKS):
            yield _one(counts[k * size : (k + 1) * size], n, k)

    got = _summed(slim.select("__text").mapInArrow(run, _SUM))
    return (np.concatenate([got[k][0] for k in range(_BLOCKS)]), got[0][1]) if got else (np.zeros(BUCKETS), 0)


def _averaged(shown: DataFrame, model: Model, pos: np.ndarray, prior: float | None, rounds: int, epochs: int, parity: int | None, shard: int) -> Model:
    """Rounds over all rows (of a parity): each shard trains a copy, and the copies are averaged by their rows."""
    spark = shown.sparkSession
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((model, pos))  # of fixed size and of POSITIVES rows

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, held=held) -> Iterator[pa.RecordBatch]:
            start, good = held.value
            total, n, left = 0.0, 0, []

            def work(x: np.ndarray) -> None:
                nonlocal total, n
                own = train_copy(start, good, x, prior, epochs, turn * 1000 + len(x))
                total, n = total + np.concatenate([np.ravel(getattr(own, k)) for k in _NAMES]) * len(x), n + len(x)

            for batch in batches:
                x = _rows_of(batch)
                left.append(x if parity is None else x[column(batch, "odd").to_numpy(zero_copy_only=False) == bool(parity)])
                while sum(map(len, left)) >= shard:
                    joined = np.concatenate(left)
                    work(joined[:shard])
                    left = [joined[shard:]]
            if sum(map(len, left)):
                work(np.concatenate(left))
            if n:
                yield _one(total, n)

        got = _summed(shown.mapInArrow(run, _SUM))
        held.unpersist()
        if not got:
            return model
        flat, at = got[0][0] / got[0][1], 0
        parts = {}
        for k in _NAMES:
            old = np.asarray(getattr(model, k))
            parts[k] = flat[at : at + old.size].reshape(old.shape)
            at += old.size
        model = Model(model.mean, model.scale, **parts)
    return model


def _moments(shown: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows_of(batch)
                yield _one(np.concatenate([x.sum(0), (x * x).sum(0)]), len(x))

    total, n = _summed(shown.mapInArrow(run, _SUM))[0]
    mean = total[:FEATURES] / n
    return mean, np.sqrt(np.maximum(total[FEATURES:] / n - mean**2, 0)) + 1e-3


def _tails(shown: DataFrame, model: Model, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of the odd rows score as high as each cut, and how many these rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch)[column(batch, "odd").to_numpy(zero_copy_only=False)]
            if len(x):
                yield _one(len(x) - np.searchsorted(np.sort(model.score(x)), cuts), len(x))

    got = _summed(shown.mapInArrow(run, _SUM))
    return got[0] if got else (np.zeros(len(cuts)), 0)


def estimate_prior(shown: DataFrame, pos: np.ndarray, mean: np.ndarray, scale: np.ndarray, shard: int = SHARD, seed: int = 5) -> float:
    """Share of positives among all unlabelled rows, by half of the rows with a classifier of the other half."""
    order = _averaged(shown, new_model(mean, scale, seed), pos[::2], None, 2, 6, 0, shard)
    p = np.sort(order.score(pos[1::2] if len(pos) > 1 else pos))
    above, n = _tails(shown, order, p[: max(1, len(p) * 9 // 10)])
    return prior_of(p, above, n)


def fit(shown: DataFrame, pos: np.ndarray, rounds: int = ROUNDS, epochs: int = EPOCHS, shard: int = SHARD, low_share: float = LOW, seed: int = 3) -> Model:
    """The form model, from (x, odd) of all unlabelled rows and the features of positives."""
    mean, scale = _moments(shown)
    prior = estimate_prior(shown, pos, mean, scale, shard)
    held = np.arange(len(pos)) % 4 == 0
    model = _averaged(shown, new_model(mean, scale, seed), pos[~held] if len(pos) > 8 else pos, prior, rounds, epochs, None, shard)
    model.prior = prior
    # the prior is uncertain, so the cut isn't 0 but well below nearly all of the held-out trusted text
    low, middle = np.quantile(model.score(pos[held] if len(pos) > 8 else pos), [low_share, 0.5])
    model.cut = float(low - (middle - low))
    return model


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, rounds: int = ROUNDS, epochs: int = EPOCHS, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", toxic_col: str = "toxic") -> Model | None:
    """A model from about `positives` labelled good rows and all documents.

    The positives are chosen by a hash of the id, one row for each; ids that are null, labels that
    are null or contradict each other, ids that any row marks toxic, and texts without words aren't
    used as positives. Labels needn't have a column of toxicity. None with fewer than LEAST
    positives or texts with words.
    """
    spark = docs.sparkSession
    toxic = F.coalesce(F.col(toxic_col).cast("int"), F.lit(0)) if toxic_col in labels.columns else F.lit(0)
    clean = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__q"), toxic.alias("__toxic")).where("__id IS NOT NULL").groupBy("__id").agg(F.min("__q").alias("lo"), F.max("__toxic").alias("toxic"))
    good = clean.where("lo = 1 AND toxic = 0").select("__id")
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    picked = good.where(chosen(F.col("__id"), positives, good.count(), 11))
    # picked is bounded by the parameter, so it can go to every task
    sample = slim.join(F.broadcast(picked), "__id").select(F.col("__id").cast("string").alias("id"), "__text")

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = features(column(batch, "__text"))
            words: list[bytes] = []
            for lo, hi, owner, bucket in word_buckets(column(batch, "__text")):
                words += [w.tobytes() for w in np.split(bucket.astype(np.uint32), np.searchsorted(owner, np.arange(1, hi - lo)))]
            made = pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(words, pa.binary())], names=["id", "x", "words"])
            yield made.filter(pa.array(some))

    one = sample.mapInArrow(positive, "id string, x binary, words binary").groupBy("id").agg(F.min(F.struct("x", "words")).alias("r"))
    rows = sorted((r["id"], bytes(r["r"]["x"]), bytes(r["r"]["words"])) for r in one.collect())
    if len(rows) < LEAST:
        return None
    pos = np.array([np.frombuffer(r[1], np.float32) for r in rows], float)
    held = [np.frombuffer(r[2], np.uint32) for r in rows]
    unl, n_unl = _count_buckets(slim)
    if n_unl < LEAST:
        return None

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = features(column(batch, "__text"))
            made = pa.RecordBatch.from_arrays([column(batch, "place"), column(batch, "odd"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["place", "odd", "x"])
            yield made.filter(pa.array(some))

    # by a hash, so that every task gets rows of all sources
    place = F.xxhash64("__id", "__text", F.lit(12))
    shown = slim.select((place.bitwiseAND(1) == 1).alias("odd"), F.shiftright(place, 1).alias("place"), "__text").mapInArrow(form, "place long, odd boolean, x binary")
    scratch = Scratch(spark, "quality")
    tasks = min(max(1, -(-n_unl // (SHARDS * shard))), 20_000)
    shown = scratch.keep(shown.repartition(tasks, F.shiftright("place", 8)).sortWithinPartitions("place").select("odd", "x"), "features")
    model = fit(shown, pos, rounds, epochs, shard)
    scratch.drop("features")
    model.words = weigh_words(np.bincount(np.concatenate(held), minlength=BUCKETS), unl, len(rows), n_unl)
    against = [model.words[h].sum() for h in held]
    # beyond this the odds of a good text are under even, and no more trusted texts are than form rejects
    model.most = max(float(np.quantile(against, 1 - REJECTED_POSITIVES)), float(np.log(2 * model.prior)), 0.0)
    return model


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, keep) for every row of `docs`.

    A null or empty text, or one without words, has a null score and isn't kept. With fewer than
    LEAST trusted positives nothing can be learnt: the score is null and texts with words are kept.
    Repeated rows and null ids stay; other columns are ignored.
    """
    model = model or train(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, keep = judge(model, column(batch, "__text"))
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(score, pa.float64(), mask=np.isnan(score)), pa.array(keep)], names=[id_col, "score", "keep"])

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, keep boolean")


def judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, some = features(texts)
    score = np.full(len(x), np.nan)
    if model is None:
        return score, some
    score[some] = model.score(x[some])
    if model.words is not None and model.words.any():
        against = np.concatenate([np.zeros(0), *(evidence(owner, bucket, hi - lo, model.words) for lo, hi, owner, bucket in word_buckets(texts))])
        score = np.where(some & (against > model.most), np.minimum(score, model.cut - against), score)
    return score, some & (np.nan_to_num(score, nan=-np.inf) >= model.cut)


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that classify() doesn't keep; all columns stay."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(model, batch.column(at))[1]))

    return docs.mapInArrow(run, docs.schema)
