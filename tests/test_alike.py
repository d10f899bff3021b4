"""Pairs of texts with like word sets: against all pairs compared, and how many of them are compared."""

import random

import pytest

from loamworks.operators import alike, quality


def near_copies(n, vocabulary, length, seed=0):
    """Texts of words from a small vocabulary, so that no word is rare; every third is a copy with a few other words."""
    r = random.Random(seed)
    texts = []
    for i in range(n):
        own = [f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(1, length))]
        if i % 3 == 2:
            own = texts[r.randrange(len(texts))].split()
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = f"w{r.randrange(vocabulary)}"
            r.shuffle(own)
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_all_pairs(spark, threshold):
    texts = [*near_copies(240, 60, 80), "", "", None, "w1", "w1", "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "pos bigint, norm string")
    got = {(r.a, r.b): r.similarity for r in quality.near_pairs(docs, threshold).collect()}
    sets = [set((t or "").split()) for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b) if sets[a] & sets[b]}
    assert got == {k: v for k, v in want.items() if v > threshold}


def test_few_are_compared(spark, monkeypatch):
    """Words that all texts share, and many texts with the same words, don't make all pairs candidates."""
    texts = [*near_copies(600, 60, 50, 1), *["a b c d e f g h i j k l"] * 300]
    compared = []
    found = alike.candidates
    monkeypatch.setattr(alike, "candidates", lambda *x: compared.append(found(*x)) or compared[-1])
    assert quality.near_pairs(spark.createDataFrame(list(enumerate(texts)), "pos bigint, norm string"), 0.9).count() >= 300 * 299 // 2
    assert compared[0].count() < 2000  # of 404 550


def test_in_order_gets_no_text(spark, monkeypatch):
    """The one task of the sequential filter reads hashes, and nothing of rows that repeat no other; the window is of kept rows."""
    from test_quality import plain_duplicates

    own = lambda i: " ".join(f"v{i}x{k}" for k in range(40))
    changed = lambda i: own(i).replace(f"v{i}x7", "other")
    texts = [own(0), own(1), *[own(1)] * 50, *map(own, range(2, 101)), changed(0), changed(1), changed(90), own(0), changed(1), "", ""]
    read = []

    def kept_of(threshold, made=quality.in_order):
        read.append(threshold)
        return made(threshold)

    monkeypatch.setattr(quality, "in_order", kept_of)
    items = spark.createDataFrame(list(enumerate(texts)), "pos bigint, output string")
    got = [r.reason for r in quality.DuplicateFilter().mark(items).select("pos", "duplicate.reason").orderBy("pos").collect()]
    assert [r[:4] for r in got] == [w[:4] for w in plain_duplicates(texts)]
    assert read == [0.9]


def test_filters_work_once(spark):
    """A pipeline with a duplicate filter doesn't judge the rows again for it."""
    seen = spark.sparkContext.accumulator(0)
    from pyspark.sql import functions as F

    def note(t):
        seen.add(1)
        return t

    items = spark.createDataFrame([(i, f"a text of its own, number {i}") for i in range(40)], "pos bigint, output string")
    once = items.select("pos", F.udf(note)("output").alias("output"))
    assert quality.QualityFilterPipeline().verdicts(once).select("pos", "first_fail").where("first_fail IS NULL").count() == 40
    assert seen.value == 40
