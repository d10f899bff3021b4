import base64
import re

import numpy as np
import odd
import pandas as pd
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from loamworks.llm import _text, decontamination, language_id, lm_scoring, near_dedup, neighbours, packing, quality, queries, suffix_dedup, token_counts, token_output


WORD = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m.group(1), 16):08x}", _text.WORD_SQL))


def words(text):
    return WORD.findall((text or "").lower())


def test_words():
    texts = {"“hello”—then x": ["hello", "then", "x"], "Müller's straße": ["müller", "s", "straße"], "один 😀abc": ["один", "abc"], "中文abc字": ["中", "文", "abc", "字"], "ไท x": ["ไ", "ท", "x"], "…": [], "": [], "한국어 word": ["한국어", "word"]}
    data, offsets = _text.utf8(_text.lowered(pa.array(list(texts))))
    starts, ends, first = _text.spans(data, offsets)
    found = [[data[starts[i] : ends[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert found == list(texts.values()) == [words(t) for t in texts]


def test_chinese_is_found_cut_and_grouped(spark):
    rng = np.random.default_rng(6)
    item = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 60)))
    own = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 400))) for _ in range(4)]
    docs = spark.createDataFrame([(0, own[0] + item + own[1]), (1, own[2] + "。" + item), (2, own[3]), (3, own[3] + "新")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontamination.contamination(docs, items).collect()) == [0, 1]
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs).collect()) == [(1, 400, 460), (3, 0, 400)]
    assert {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.execute(queries.ORACLES[name]).df())


# ---- token counts and codes ----


def _tiktoken():
    import tiktoken

    lines = map(bytes.split, open(token_counts.VOCABULARY, "rb"))
    return tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def test_counts_and_codes_are_exact(spark, sf):
    t = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(odd.table(spark).select("doc_id", "text"))
    enc = _tiktoken()
    texts = {r.doc_id: r.text for r in t.collect()}
    for df in (t.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]),):
        texts = {r.doc_id: r.text for r in df.collect()}
        want = {k: enc.encode_ordinary(v) if v else [] for k, v in texts.items()}
        assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == {k: len(v) for k, v in want.items()}
        for r in token_output.encode_documents(df).collect():
            levels = [x.asDict() for x in r.levels]
            ids = token_output.decode(levels, r.n_tokens).tolist()
            assert ids == want[r.doc_id]
            for i in range(0, len(ids), 97):
                assert token_output.access(levels, i) == ids[i]
    got = token_output.encode_documents(odd.table(spark)).select("doc_id", token_output.token_at("levels", F.lit(2)).alias("t")).collect()
    assert len(got) == 9 and {r.t for r in got if r.doc_id == 2} == {None}
    assert token_counts.count_tokens(odd.empty(spark)).count() == 0 and token_output.encode_documents(odd.empty(spark)).count() == 0


def test_whole_tokens_are_proven():
    ranks = token_counts.load_ranks(token_counts.VOCABULARY)
    proven = token_counts.proven_whole_tokens(ranks)
    enc = _tiktoken()
    some = sorted(proven)[::500]
    assert len(proven) > 40_000 and all(len(enc.encode_ordinary(s)) == 1 for s in some)
    for s in ("unbelievably", "x" * 300, "aébç" * 40):
        assert token_counts.merge(s.encode(), ranks) == [enc.decode_single_token_bytes(t) for t in enc._core_bpe.encode_single_piece(s.encode())]


@pytest.mark.parametrize("widths", [(8, 4, 4), (4, 4, 8), (5, 7, 4)])
def test_codes_round_trip(widths):
    ids = np.random.default_rng(1).integers(0, 1 << 16, 3000) >> np.random.default_rng(2).integers(0, 16, 3000)
    levels = token_output.encode(ids, widths)
    assert token_output.decode(levels, len(ids), widths).tolist() == ids.tolist()
    assert [token_output.access(levels, i, widths) for i in range(len(ids))] == ids.tolist()
    with pytest.raises(ValueError):
        token_output.encode(np.array([1 << 20]), widths)


@pytest.mark.parametrize("widths", [(8, 4, 4), (4, 4, 8), (5, 7, 4), (1, 7, 8)])
def test_token_at_knows_the_length(spark, widths):
    texts = [" ".join(["word"] * n) for n in (1, 2, 3, 5, 7, 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    coded = token_output.encode_documents(df, widths=widths)
    for i in (-1, 0, 1, 2, 3, 5, 8, 9, 10):
        found = coded.select("n_tokens", token_output.token_at("levels", F.lit(i), widths, "n_tokens").alias("t")).collect()
        assert all((r.t is not None) == (0 <= i < r.n_tokens) for r in found)


# ---- language ----


def test_language_gradients():
    rng = np.random.default_rng(0)
    m = language_id.new_model(["a", "b", "c"], 4, rng)
    for k in "wuvc":
        setattr(m, k, getattr(m, k).astype(np.float64))
    x, y = rng.integers(0, 256, (12, 5)), np.array([0, 1, 2, 0, 1])
    x[8:, 2] = 256
    _, g = language_id.gradients(m, x, y)
    for k in "wuvc":
        flat, i = getattr(m, k).reshape(-1), int(np.abs(g[k]).argmax())
        old, both = flat[i], []
        for e in (1e-2, -1e-2):
            flat[i] = old + e
            both.append(language_id.gradients(m, x, y)[0])
        flat[i] = old
        assert abs((both[0] - both[1]) / 2e-2 - g[k].reshape(-1)[i]) < 1e-3


def _plain_network(m, text):
    """One byte after the other, as the rules of a gated recurrent network say."""
    hidden, data, out = m.u.shape[2], text.encode(), []
    hard = lambda v: np.clip(v, 0, 1)
    found = []
    for d, order in ((0, range(len(data))), (1, range(len(data) - 1, -1, -1))):
        h, at = np.zeros(hidden), {}
        for i in order:
            x, u = m.w[d, data[i]], m.u[d] @ h
            r, z = hard(x[:hidden] + u[:hidden]), language_id.HELD * hard(x[hidden : 2 * hidden] + u[hidden : 2 * hidden])
            n = np.clip(x[2 * hidden :] + r * u[2 * hidden :], -1, 1)
            h = (1 - z) * n + z * h
            at[i] = h
        found.append(at)
    for i in range(len(data)):
        e = np.exp(m.v[0] @ found[0][i] + m.v[1] @ found[1][i] + m.c)
        out.append(e / e.sum())
    return np.array(out)


def test_language_is_learnt(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").toPandas()
    train, held = t[t.doc_id % 2 == 0], t[t.doc_id % 2 == 1]
    m = language_id.fit(train.text.tolist(), train.lang.tolist(), steps=150)
    p, size, (owner, start, length, of) = language_id.label(m, pa.array(held.text.tolist()))
    assert (np.array(m.languages)[p.argmax(axis=1)] == held.lang.to_numpy()).mean() > 0.97
    assert (np.bincount(owner, length, len(held)) == size).all() and len(of) == len(start)
    for i in range(5):
        assert np.allclose(p[i], _plain_network(m, held.text.iloc[i]).mean(axis=0), atol=1e-3)
    got = {(r.doc_id, r.lang): r for r in language_id.identify(odd.table(spark), m).collect()}
    assert got[(2, None)].runs == [] and got[(3, None)].probability is None
    assert sum(r.length for r in next(v for k, v in got.items() if k[0] == 5).runs) == len(odd.LONG)
    assert language_id.identify(odd.table(spark), m).count() == 9
    assert language_id.identify(odd.empty(spark)).count() == 0


def test_language_states_go_through_the_whole_text(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").toPandas()
    by = {k: " ".join(g.text.iloc[:20]).replace("\n", " ") for k, g in t.groupby("lang")}
    m = language_id.fit(list(by.values()), list(by), steps=120)
    names = np.array(m.languages)
    mixed = by["en"][:700] + by["de"][:900] + by["fr"][:1111] + "日本" + by["es"][:300]
    p, size, (owner, start, length, of) = language_id.label(m, pa.array([mixed, "", mixed[:5], mixed]))
    assert size[0] == len(mixed.encode()) and p[1].sum() == 0 and np.allclose(p[0], p[3])
    plain = _plain_network(m, mixed)
    got = np.repeat(of[owner == 0], length[owner == 0])
    top = np.sort(plain, axis=1)
    sure = top[:, -1] - top[:, -2] > 0.02
    assert (got == plain.argmax(axis=1))[sure].all() and sure.mean() > 0.9
    want = np.repeat(["en", "de", "fr", "fr", "es"], [len(x.encode()) for x in (by["en"][:700], by["de"][:900], by["fr"][:1111], "日本", by["es"][:300])])
    assert (names[got] == want).mean() > 0.9
    # a network that forgets nothing is read over again until it holds
    m.w[:, :, 8:16] += 5
    few = language_id.label(m, pa.array([mixed[:1500]]))[0][0]
    assert np.allclose(few, _plain_network(m, mixed[:1500]).mean(axis=0), atol=5e-3)


def test_language_stretches_of_any_length():
    rng = np.random.default_rng(3)
    m = language_id.new_model(["a", "b", "c"], 8, rng)
    edge = language_id.STRETCH
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (edge + 1, 0, 1, edge, 2 * edge + 7, edge - 1, 2 * edge + language_id.WARM, edge + 40)] + ["x" * (edge - 1) + "日本é"]
    p, size, (owner, start, length, of) = language_id.label(m, pa.array(texts))
    assert size.tolist() == [len(t.encode()) for t in texts]
    for i, text in enumerate(texts):
        if text:
            plain = _plain_network(m, text)
            top = np.sort(plain, axis=1)
            got = np.repeat(of[owner == i], length[owner == i])
            assert np.allclose(p[i], plain.mean(axis=0), atol=1e-3) and (got == plain.argmax(axis=1))[top[:, -1] - top[:, -2] > 0.02].all()


def test_language_bytes_are_read_about_once(monkeypatch):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    m = language_id.fit(docs.text.tolist(), docs.lang.tolist(), steps=60)
    read = []
    both, one = language_id.states, language_id._read
    monkeypatch.setattr(language_id, "states", lambda m, x, *a, **k: read.append(2 * x.size) or both(m, x, *a, **k))
    monkeypatch.setattr(language_id, "_read", lambda w, u, x, *a: read.append(x.size) or one(w, u, x, *a))
    size = language_id.label(m, pa.array(docs.text.tolist()))[1]
    assert 2 * size.sum() <= sum(read) < 2.5 * size.sum()


def test_many_languages(spark):
    names = [f"l{i:03}" for i in range(150)]
    m = language_id.fit([f"{n} " * 10 for n in names], names, steps=2)
    m.c[:] = 0
    m.c[149] = 50
    df = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    assert language_id.identify(df, m).first().lang == "l149"


def test_language_sample_is_bounded(spark):
    assert len(language_id.spread_segments("é" * 1_000_000)) == language_id.PER_TEXT
    parts = language_id.spread_segments("ab" * 1000)
    assert b"".join(parts) == b"ab" * 1000
    df = spark.createDataFrame([(1, "same text", "en")] * 500 + [(2, "autre", "fr")], "doc_id int, text string, lang string")
    assert language_id.train(df).languages == ["en", "fr"]


# ---- neighbours ----


def test_neighbours(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = neighbours.nearest_neighbours(t, block=200, queries=150).toPandas()
    p = t.orderBy("vec_id").toPandas()
    x, ids = np.stack(p.embedding.to_numpy()).astype(float), p.vec_id.to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {i: set(ids[np.argsort(row)[:10]]) for i, row in zip(ids, d, strict=True)}
    found = got.groupby("vec_id").neighbor_id.apply(set).to_dict()
    assert sum(len(want[i] & found[i]) for i in ids) / (10 * len(ids)) >= 0.9
    assert (got.groupby("vec_id").size() == 10).all() and (got.vec_id != got.neighbor_id).all()
    near = {(a, b): c for a, b, c in zip(got.vec_id, got.neighbor_id, got.distance, strict=True)}
    assert all(abs(c - np.sqrt(d[a, b])) < 1e-5 for (a, b), c in list(near.items())[:200])


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, id string, x string, list int"
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0, float("nan")]), (7, [1.0, 2.0, 3.0]), (None, [0.0, 0.5]), (8, [None, 1.0])]
    df = spark.createDataFrame([r + ("a", "b", 1) for r in rows], schema)
    got = sorted((r.vec_id, r.rank, r.neighbor_id) for r in neighbours.nearest_neighbours(df).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert neighbours.nearest_neighbours(df.where("false")).count() == 0
    assert neighbours.nearest_neighbours(df.where("vec_id = 2")).count() == 0


def test_dense_group_that_the_sample_misses(spark, monkeypatch):
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(3000, 16))
    dense = rng.normal(size=16) + rng.normal(0, 0.003, (3000, 16))
    x = np.concatenate([wide, dense]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    pick = neighbours.chosen
    monkeypatch.setattr(neighbours, "chosen", lambda key, wanted, total, salt: (key < 3000) & pick(key, wanted, total, salt))
    got = neighbours.nearest_neighbours(df, every=50, block=2000).toPandas().groupby("vec_id").neighbor_id.apply(set).to_dict()
    assert sorted(got) == list(range(0, 6000, 50))
    hit = []
    for i in got:
        d = ((x.astype(float) - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit.append(len(got[i] & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(hit[60:]) >= 0.95 and np.mean(hit) >= 0.95


def test_neighbours_of_named_rows(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [5.0, 0.0]), (None, [0.0, 0.0])], "vec_id string, embedding array<double>")
    got = sorted((r.vec_id, r.rank, r.neighbor_id) for r in neighbours.nearest_neighbours(df, k=1).collect())
    assert got == [("a", 1, "b"), ("b", 1, "a"), ("c", 1, "b")]


# ---- packing ----


def test_packing(spark):
    rng = np.random.default_rng(3)
    n = [*rng.integers(0, 300, 400).tolist(), 1000, 64, 64, None]
    df = spark.createDataFrame([(i if i % 50 else None, x, "a") for i, x in enumerate(n)], "doc_id bigint, n_tokens bigint, piece string")
    got = packing.pack(df, sequence=64, classes=16, shard=50).toPandas()
    total = sum(x or 0 for x in n)
    assert got.n_tokens.sum() == total
    used = got.groupby("bin_id").n_tokens.sum()
    assert used.max() <= 64 and sorted(used.index) == list(range(len(used)))
    for _, g in got.sort_values("bin_offset").groupby("bin_id"):
        assert (g.bin_offset.to_numpy() == np.concatenate([[0], np.cumsum(g.n_tokens)[:-1]])).all()
    assert total / (64 * len(used)) > 0.85
    whole = got.dropna(subset=["doc_id"])
    for i, g in whole.groupby("doc_id"):
        assert g.n_tokens.sum() == n[int(i)] and sorted(g.start) == [64 * k for k in range(len(g))]
    assert packing.pack(df.where("false"), 64, 16).count() == 0
    assert packing.pack_documents(odd.table(spark)).agg(F.sum("n_tokens")).first()[0] == token_counts.count_tokens(odd.table(spark)).agg(F.sum("n_tokens")).first()[0]


def test_nnls():
    rng = np.random.default_rng(5)
    a, b = rng.random((12, 20)), rng.random(12)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


# ---- near duplicates ----


def jaccard_groups(texts, k=near_dedup.SHINGLE, t=near_dedup.THRESHOLD):
    sets = []
    for x in texts:
        w = words(x)
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(8)
    texts = []
    for g in range(12):
        base = [f"w{g}x{i}" for i in rng.integers(0, 500, 60)]
        for c in range(g % 5 + 1):
            w = list(base)
            for at in rng.integers(0, 60, c):
                w[at] = "changed"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.group_id, r.keep) for r in near_dedup.near_duplicates(df).collect()}
    want = jaccard_groups(texts)
    assert got == {i: (g, g == i) for i, g in enumerate(want)}
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()) == sorted(set(want))


def test_near_duplicates_odd(spark):
    got = near_dedup.near_duplicates(odd.table(spark)).collect()
    assert len(got) == 9 and sorted(r.doc_id for r in got if not r.keep) == [1]
    left = near_dedup.drop_near_duplicates(odd.table(spark))
    assert left.columns == odd.table(spark).columns and left.count() == 8
    assert near_dedup.near_duplicates(odd.empty(spark)).count() == 0 and near_dedup.drop_near_duplicates(odd.empty(spark)).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    rows = []
    for i in range(3000):  # 30 of 50 shingles are shared
        base = [f"w{i}x{j}" for j in range(42)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:32] + [f"v{i}x{j}" for j in range(10)]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.where("NOT keep").count() >= 2997 and got.where("group_id <> doc_id - doc_id % 2").count() <= 3


@pytest.mark.parametrize("bands", [1, near_dedup.BANDS])
def test_no_pair_at_the_threshold_is_lost(spark, bands):
    """Of each four texts the first is at 0.6 to the second and third (30 of 50 shingles) and below to the fourth (29 of 51); one band of buckets finds few of these pairs."""
    rows, want = [], {}
    for i in range(1500):
        base = [f"w{i}x{j}" for j in range(42)]
        rows += [(4 * i, " ".join(base)), (4 * i + 1, " ".join(base[:32] + [f"v{i}x{j}" for j in range(10)])), (4 * i + 2, " ".join([f"u{i}x{j}" for j in range(10)] + base[10:]))]
        rows.append((4 * i + 3, " ".join(base[:31] + [f"t{i}x{j}" for j in range(11)])))
        want |= {4 * i + k: 4 * i for k in range(3)} | {4 * i + 3: 4 * i + 3}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bands=bands)
    assert {r.doc_id: r.group_id for r in got.collect()} == want


# ---- repeated passages ----


def plain_passages(texts, n):
    seen, out = set(), []
    for i, t in enumerate(texts):
        w, hit = words(t), []
        for a in range(len(w) - n + 1):
            run = tuple(w[a : a + n])
            if run in seen:
                hit.append(a)
            seen.add(run)
        for a in hit:
            if out and out[-1][0] == i and out[-1][2] >= a:
                out[-1][2] = a + n
            else:
                out.append([i, a, a + n])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("base", [suffix_dedup.BASE, 10])
def test_repeated_passages(spark, base):
    rng = np.random.default_rng(4)
    shared = [" ".join(f"s{k}y{i}" for i in rng.integers(0, 60, 40)) for k in range(3)]
    texts = []
    for _ in range(30):
        own = [f"o{i}" for i in rng.integers(0, 3000, 50)]
        texts.append(" ".join(own[:20]) + ", " + shared[rng.integers(0, 3)] + ". " + " ".join(own[20:]))
    texts += ["ab " * 120, texts[0], "short text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(df, 30, base).collect())
    want = plain_passages(texts, 30)
    copy = len(texts) - 2
    assert [g for g in got if g[0] != copy] == [w for w in want if w[0] != copy]
    assert [g for g in got if g[0] == copy] == [(copy, 0, len(words(texts[copy])))]
    left = {r.doc_id: r.text for r in suffix_dedup.drop_repeated(df, 30, base).collect()}
    assert copy not in left and left[len(texts) - 1] == "short text" and set(left) >= {w for w in range(30)}
    assert not plain_passages([left[k] for k in sorted(left) if k < 30], 30)


def test_a_line_in_half_of_all_documents(spark):
    """Tasks of 300 rows: the line's triples are cut into many, and the result is that of one walk."""
    rng = np.random.default_rng(11)
    line = " ".join(f"b{i}" for i in range(90))
    texts = []
    for k in range(120):
        own = " ".join(f"o{i}" for i in rng.integers(0, 5000, 30))
        texts.append(f"{own} {line} x{k}" if k % 2 else f"{own} y{k}")
    texts += ["a a a " * 60, "q " * 200 + line]
    df = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(5)
    cut = []
    found = suffix_dedup._pivots

    def seen(*args):
        cut.append(found(*args))
        return cut[-1]

    suffix_dedup._pivots = seen
    try:
        got = sorted((int(r.doc_id[1:]), r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(df, 30, 10, 300).collect())
    finally:
        suffix_dedup._pivots = found
    assert got == plain_passages(texts, 30)
    assert cut[-1] and max(len(c["p"]) for c in cut[-1].values()) > 1


def test_suffixes_move_in_blocks(spark, sf, monkeypatch):
    """What the sorts write is a row for each task, not one for each suffix; and that is still the whole result."""
    keep, sizes = suffix_dedup.Scratch.keep, {}

    def counted(self, df, name):
        kept = keep(self, df, name)
        sizes[name] = kept.count()
        return kept

    monkeypatch.setattr(suffix_dedup.Scratch, "keep", counted)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = suffix_dedup.repeated_passages(docs, base=2000, rows=5000).collect()
    monkeypatch.undo()
    assert sorted(map(tuple, got)) == sorted(map(tuple, suffix_dedup.repeated_passages(docs).collect())) and len(got) > 50
    sorts = {k: v for k, v in sizes.items() if k.startswith(("names", "merged", "base"))}
    assert len(sorts) >= 6 and max(sorts.values()) > 1 and sum(sorts.values()) < 300


def test_values_of_blocks_and_keys_of_tasks(spark):
    rng = np.random.default_rng(5)
    n = 2 * suffix_dedup.BLOCK + 9
    order, half = rng.permutation(n), n // 2
    df = spark.createDataFrame([(0, half, order[:half].tobytes()), (1, n - half, order[half:].tobytes())], "part long, n long, p binary")
    want = np.zeros(3 * suffix_dedup.BLOCK + 2, np.int64)
    want[order] = np.arange(1, n + 1)
    blocks = {r.b: np.frombuffer(r.v, np.int64) for r in suffix_dedup._value_blocks(suffix_dedup._ranked(df), "v").collect()}
    assert sorted(blocks) == [0, 1, 2]
    for b, v in blocks.items():
        assert (v == want[b * suffix_dedup.BLOCK : (b + 1) * suffix_dedup.BLOCK + 2]).all()
    keys = rng.integers(0, 4, (500, 3))
    bounds = suffix_dedup._bounds(keys, 9)
    assert suffix_dedup.range_of(bounds, *keys.T).tolist() == [sum(tuple(b) <= tuple(k) for b in bounds.tolist()) for k in keys.tolist()]


def test_named_documents(spark):
    a = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("x", a), ("b", a + " eleven"), (None, a), ("c", None)], "doc_id string, text string")
    got = {(r.doc_id, r.group_id, r.keep) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {("b", "b", True), ("x", "b", False), (None, "b", False), ("c", "c", True)}
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()} == {"b", "c"}
    cut = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(df, 8).collect()}
    assert cut == {("x", 0, 10), (None, 0, 10)}
    assert {r.doc_id for r in suffix_dedup.drop_repeated(df, 8).collect()} == {"b", "c"}


def test_repeated_passages_odd(spark):
    got = {(r.doc_id, r.start_word) for r in suffix_dedup.repeated_passages(odd.table(spark), 10).collect()}
    assert {g[0] for g in got} == {1, 5}
    left = suffix_dedup.drop_repeated(odd.table(spark), 10)
    assert left.columns == odd.table(spark).columns and left.count() == 8
    assert suffix_dedup.repeated_passages(odd.empty(spark)).count() == 0 and suffix_dedup.drop_repeated(odd.empty(spark)).count() == 0


# ---- benchmark items ----


def test_contamination_odd(spark):
    items = spark.createDataFrame([(1, "the quick brown fox went over to see the lazy dog", "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (None, "der trotzdem gelesen werden will nicht wahr nein", "x"), (1, "the quick brown fox went over to see the lazy dog", "x")], "item_id bigint, text string, doc_id string")
    got = sorted((str(r.doc_id), str(r.item_id), r.containment) for r in decontamination.contamination(odd.table(spark), items).collect())
    assert got == [("1", "1", 1.0)] * 4
    left = decontamination.drop_contaminated(odd.table(spark), items)
    assert left.columns == odd.table(spark).columns and left.count() == 7
    assert decontamination.contamination(odd.table(spark), items.where("false")).count() == 0
    assert decontamination.drop_contaminated(odd.table(spark), items.where("false")).count() == 9
    assert decontamination.contamination(odd.empty(spark), items).count() == 0


# ---- quality ----


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    # rows marked toxic are to be rejected, whatever their quality
    good, bad, toxic = got[(got.quality == 1) & (got.toxic == 0)], got[got.quality == 0], got[got.toxic == 1]
    assert good.keep.mean() > 0.98 and bad.keep.mean() < 0.35 and toxic.keep.mean() < 0.35
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    flipped = labels.where("quality = 1")  # labelled bad rows are never looked at
    again = quality.classify(docs, flipped).toPandas().set_index("doc_id").keep
    assert (again.sort_index() == quality.classify(docs, labels).toPandas().set_index("doc_id").keep.sort_index()).all()


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None), (6, 0), (6, 1)], "doc_id bigint, quality int")
    got = quality.classify(odd.table(spark), labels).collect()
    assert len(got) == 9 and all(not r.keep and r.score is None for r in got if r.doc_id in (2, 3, 4, 6))
    none = quality.classify(odd.table(spark), labels.where("false")).collect()
    assert sum(r.keep for r in none) == 5
    assert quality.classify(odd.empty(spark), labels).count() == 0 and quality.drop_rejected(odd.empty(spark), labels).count() == 0


def test_toxic_words_are_learnt(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = quality.train(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    got = quality.classify(docs.where("doc_id % 2 = 1"), labels, m).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("quality = 1").toPandas()
    toxic = got[got.toxic == 1]
    assert toxic[toxic.lang == "en"].keep.mean() < 0.02 and toxic.keep.mean() < 0.1 and got[got.toxic == 0].keep.mean() > 0.98
    bad = quality.classify(docs.where("doc_id % 2 = 1"), labels, m).join(labels, "doc_id").where("quality = 0").toPandas()
    assert bad.keep.mean() < 0.15


def _shown(spark, x, parts=3):
    full = np.zeros((len(x), quality.FEATURES), np.float16)
    full[:, : x.shape[1]] = x
    return spark.createDataFrame([(i % 2 == 1, r.tobytes()) for i, r in enumerate(full)], "odd boolean, x binary").repartition(parts).cache()


def test_prior(spark):
    rng = np.random.default_rng(1)
    pos = np.zeros((600, quality.FEATURES))
    pos[:, :4] = rng.normal(2, 1, (600, 4))
    unl = np.concatenate([rng.normal(2, 1, (600, 4)), rng.normal(-2, 1, (400, 4))])[rng.permutation(1000)]
    shown = _shown(spark, unl)
    mean, scale = quality._moments(shown)
    assert np.allclose(mean[:4], unl.mean(0), atol=1e-2) and np.allclose(scale[:4], unl.std(0) + 1e-3, atol=1e-2)
    assert 0.5 < quality.estimate_prior(shown, pos, mean, scale) < 0.75
    m = quality.fit(shown, pos, shard=300)
    full = np.zeros((1000, quality.FEATURES))
    full[:, :4] = unl
    g = m.score(full)
    assert ((g > 0) == (unl.sum(1) > 0)).mean() > 0.95


@pytest.mark.parametrize("prior", [None, 0.3, 0.95])
def test_quality_gradients(prior):
    """The slopes of the risk against differences of it, word for word by its formula, on both sides of the bracket."""
    rng = np.random.default_rng(2)
    pos, unl = rng.normal(1, 1, (7, 5)), rng.normal(0, 1, (11, 5))
    m = quality.new_model(np.zeros(5), np.ones(5), 1, 3)

    def value():
        l_pos, l_neg, l_unl = (np.log1p(np.exp(s)).mean() for s in (-m.score(pos), m.score(pos), m.score(unl)))
        if prior is None:
            return l_pos + l_unl
        bracket = l_unl - prior * l_neg
        return prior * l_pos + bracket if bracket >= 0 else -bracket

    x = np.concatenate([pos, unl])
    g = m.score(x)
    got, dp, du = quality.risk(g[:7], g[7:], prior)
    assert abs(got - value()) < 1e-9
    grads = quality.gradients(m, x, np.concatenate([dp, du]), decay=0)
    for k in ("w1", "b1", "w2"):
        flat, i = getattr(m, k).reshape(-1), int(np.abs(grads[k]).argmax())
        old, both = flat[i], []
        for e in (1e-5, -1e-5):
            flat[i] = old + e
            both.append(value())
        flat[i] = old
        assert abs((both[0] - both[1]) / 2e-5 - grads[k].reshape(-1)[i]) < 1e-4


def test_buckets_by_brute_force():
    texts = ["achlichung " * 3 + "other achlichkeit", "once achlichung", "", "éééééé ééééééa " * 300]
    for lo, hi, owner, bucket in quality.word_buckets(pa.array(texts)):
        assert len(owner) == len(set(zip(owner.tolist(), bucket.tolist(), strict=True)))
        n = np.bincount(owner, minlength=hi - lo)
        # words, first bytes, and those that are frequent
        assert n.tolist()[:3] == [3 + 1 + 1, 2 + 1, 0]
    counts = quality.weigh_words(np.array([0, 500, 5]), np.array([30, 500, 6]), 1000, 1000)
    assert counts[0] > 2 and counts[1] == 0 == counts[2]


# ---- language model ----


def test_lm_gradients():
    rng = np.random.default_rng(0)
    m = lm_scoring.new_model(rng.integers(0, 9, lm_scoring.TOKENS))
    m.t[:] += rng.normal(0, 0.1, m.t.shape)
    for k in "ewbvct":
        setattr(m, k, getattr(m, k).astype(np.float64))
    target, around = rng.integers(0, 50, 7), rng.integers(0, 50, (4, 7))
    _, g, de, dt, node = lm_scoring.gradients(m, target, around)
    dense, nodes = np.zeros_like(m.e), np.zeros_like(m.t)
    np.add.at(dense, around.ravel(), de.reshape(-1, lm_scoring.DIM))
    np.add.at(nodes, node, dt)
    for k, grad in {**g, "e": dense, "t": nodes}.items():
        flat, i = getattr(m, k).reshape(-1), int(np.abs(grad).argmax())
        old, both = flat[i], []
        for e in (1e-4, -1e-4):
            flat[i] = old + e
            both.append(lm_scoring.gradients(m, target, around)[0])
        flat[i] = old
        assert abs((both[0] - both[1]) / 2e-4 - grad.reshape(-1)[i]) < 1e-5


def test_lm_step():
    """One batch of Adagrad, row by row."""
    rng = np.random.default_rng(1)
    m = lm_scoring.new_model(rng.integers(0, 9, lm_scoring.TOKENS))
    windows = rng.integers(0, 40, (30, 2 * lm_scoring.WINDOW + 1)).astype(np.uint16)
    got, seen, passed = lm_scoring.train_copy(m, windows, 0.1, 3)
    order = np.random.default_rng(3).permutation(30)
    own = windows[order].astype(np.int64)
    _, g, de, dt, node = lm_scoring.gradients(m, own[:, -1], own[:, :-1].T)
    dense, nodes = np.zeros((lm_scoring.TOKENS + 1, lm_scoring.DIM)), np.zeros((lm_scoring.NODES, lm_scoring.TREE + 1))
    np.add.at(dense, own[:, :-1].T.ravel(), de.reshape(-1, lm_scoring.DIM))
    np.add.at(nodes, node, dt)
    for k, grad in {**g, "e": dense, "t": nodes}.items():
        past = grad**2 if k in g else (grad**2).mean(axis=1, keepdims=True)  # tables have one step size a row
        want = getattr(m, k) - 0.1 * grad / np.sqrt(1e-4 + past)
        assert np.allclose(getattr(got, k), want, atol=1e-4), k
    assert (seen == np.bincount(windows[:, :-1].ravel(), minlength=len(seen))).all()
    assert (passed == np.bincount(lm_scoring.ways(m, windows[:, -1].astype(int))[1], minlength=len(passed))).all()


def test_lm_probabilities_add_up():
    rng = np.random.default_rng(2)
    m = lm_scoring.new_model(rng.integers(0, 1000, lm_scoring.TOKENS) ** 2)
    untrained = lm_scoring.log_probabilities(m, m.folded() * 0, np.arange(lm_scoring.TOKENS), np.zeros((4, lm_scoring.TOKENS), int))
    counts = np.random.default_rng(2).integers(0, 1000, lm_scoring.TOKENS) ** 2 + 1.0
    assert np.allclose(untrained, np.log(counts / counts.sum()), atol=1e-4)  # as frequent as in the corpus
    m.t[:] += rng.normal(0, 0.5, m.t.shape)
    around = np.repeat(rng.integers(0, lm_scoring.TOKENS, (4, 1)), lm_scoring.TOKENS, axis=1)
    assert abs(np.exp(lm_scoring.log_probabilities(m, m.folded(), np.arange(lm_scoring.TOKENS), around)).sum() - 1) < 1e-4


def _plain_score(m, text):
    data = pa.array([text])
    total = 0.0
    for _, _, tokens, _ in lm_scoring.tokens_of(data):
        for i, t in enumerate(tokens):
            h = m.b.astype(float).copy()
            for p, at in enumerate((i - 1, i - 2, i + 1, i + 2)):
                h += m.e[tokens[at] if 0 <= at < len(tokens) else lm_scoring.EDGE].astype(float) @ m.w[p]
            h = np.maximum(h, 0)
            z = h @ m.v + m.c
            total += z[m.of[t]] - np.log(np.exp(z).sum())
            for k in range(m.begin[t], m.begin[t + 1]):
                node = m.t[m.node[k]].astype(float)
                total -= np.log1p(np.exp(-m.turn[k] * (h[: lm_scoring.TREE] @ node[:-1] + node[-1])))
    return total


def test_lm_scoring(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = lm_scoring.train(docs, share=2, shard=4000)
    got = {r.doc_id: r for r in lm_scoring.score(docs, m).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for i in sorted(texts)[:4]:
        assert got[i].n_tokens == len(words(texts[i])) and abs(got[i].log_likelihood - _plain_score(m, texts[i])) < 1e-3 * max(1, got[i].n_tokens)
    counts = np.zeros(lm_scoring.TOKENS)
    for t in texts.values():
        for _, _, tokens, _ in lm_scoring.tokens_of(pa.array([t])):
            counts += np.bincount(tokens, minlength=lm_scoring.TOKENS)
    untrained = lm_scoring.new_model(counts)
    assert (untrained.of == m.of).all() and (untrained.node == m.node).all()
    base = sum(r.log_likelihood for r in lm_scoring.score(docs, untrained).collect())
    assert sum(r.log_likelihood for r in got.values()) > base
    out = {r.doc_id: r for r in lm_scoring.score(odd.table(spark), m).collect()}
    assert out[2].n_tokens == 0 and out[3].per_token is None and out[5].n_tokens == 60_000
    assert lm_scoring.score(odd.empty(spark)).count() == 0


def test_lm_trains_on_all_positions():
    texts = ["a b c d a b c", "a b c", "", "e"]
    got = [lm_scoring.windows_of(tokens, first, lm_scoring.SHARE) for _, _, tokens, first in lm_scoring.tokens_of(pa.array(texts))]
    assert sum(map(len, got)) == 11
    # of a trigram that occurs often some positions are picked, neither all nor none
    _, _, tokens, first = next(lm_scoring.tokens_of(pa.array(["x y z " * 1000])))
    assert 2500 / 4 < len(lm_scoring.windows_of(tokens, first, 4)) < 3500 / 4
