import odd
import pytest
from test_operators import jaccard_groups, plain_passages, words

import corpus_pipeline
from loamworks.llm import decontamination, packing, quality, token_counts


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "near" in names[1]


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stage = [f for _, f in corpus_pipeline.STAGES]
    one = stage[0](spark, docs, sf).cache()
    keep = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.keep}
    assert {r.doc_id for r in one.collect()} == keep and one.columns == docs.columns

    two = stage[1](spark, one, sf).cache()
    rows = sorted(one.collect(), key=lambda r: r.doc_id)
    groups = jaccard_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in two.collect()) == [rows[i].doc_id for i, g in enumerate(groups) if g == i]

    three = stage[2](spark, two, sf).cache()
    rows = sorted(two.collect(), key=lambda r: r.doc_id)
    cut = plain_passages([r.text for r in rows], 50)
    left = {r.doc_id: r for r in three.collect()}
    for i, r in enumerate(rows):
        gone = {k for d, a, b in cut if d == i for k in range(a, b)}
        kept = [w for k, w in enumerate(words(r.text)) if k not in gone]
        assert (words(left[r.doc_id].text) if r.doc_id in left else []) == kept
        if r.doc_id in left:
            assert left[r.doc_id].n_chars == len(left[r.doc_id].text)

    four = stage[3](spark, three, sf).cache()
    k = decontamination.SHINGLE
    shingles = lambda t: {tuple(w[i : i + k]) for w in [words(t)] for i in range(len(w) - k + 1)}
    items = [s for s in map(shingles, bench) if s]
    clean = {i for i, r in left.items() if not any(len(s & shingles(r.text)) >= decontamination.THRESHOLD * len(s) for s in items)}
    assert {r.doc_id for r in four.collect()} == clean and four.columns == docs.columns

    five = stage[4](spark, four, sf).toPandas()
    tokens = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(four).collect()}
    assert five.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in tokens.items() if v}
    assert five.groupby("bin_id").n_tokens.sum().max() <= packing.SEQUENCE


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("make", [odd.table, odd.empty])
def test_odd_rows(spark, sf, make):
    docs = make(spark)
    for name, f in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = f(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
