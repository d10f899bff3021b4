import pytest
from pyspark.sql import functions as F

from loamworks.functions.verdicts import ContentFilter, LanguageFilter, LengthFilter, QASpecificFilter, RepetitionFilter, TokenLengthFilter
from loamworks.operators import quality


def items(spark, *texts, field="output"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"pos bigint, {field} string")


def verdicts(df, f):
    return [(r.v.passed, r.v.reason) for r in df.select("pos", f.verdict().alias("v")).orderBy("pos").collect()]


def test_length(spark):
    got = verdicts(items(spark, "x" * 9, "x" * 10, "x" * 20, None), LengthFilter(max_length=15))
    assert got == [(False, "Too short (9 < 10)"), (True, ""), (False, "Too long (20 > 15)"), (False, "Too short (4 < 10)")]


def test_tokens_and_language(spark):
    df = items(spark, "a b", "a b c d e", "un texte assez long en français")
    assert [p for p, _ in verdicts(df, TokenLengthFilter())] == [False, True, True]
    assert [p for p, _ in verdicts(df, LanguageFilter())] == [True, True, False]
    assert [p for p, _ in verdicts(df, LanguageFilter(language=F.lit("fr")))] == [True, True, False]


def test_repetition(spark):
    df = items(spark, "the the the the the", "one two three four five six", "a b c d e f g h i j k l", "", "a b a b a b a b a b")
    got = verdicts(df, RepetitionFilter())
    assert [p for p, _ in got] == [False, False, True, True, False]
    assert got[0][1].startswith("High word repetition") and got[1][1].startswith("High n-gram")


def test_content(spark):
    df = items(spark, "password: hunter2", "a TODO here", "plain", "terror", None)
    assert [p for p, _ in verdicts(df, ContentFilter())] == [False, False, True, False, True]
    assert [p for p, _ in verdicts(df, ContentFilter(blocked=["plain"], required=["p"]))] == [True, False, False, False, False]


def test_qa(spark):
    rows = [("Why?", "x" * 30), ("What is it, then", "short"), ("island of birds", "x" * 30), ("Tell me all of it", "x" * 30), ("What is the sky like?", "What is the sky like? Blue.")]
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "pos int, input string, output string")
    assert [r for _, r in verdicts(df, QASpecificFilter())] == ["Question too short", "Answer too short", "", "Question isn't interrogative", "Answer repeats too much of question"]


def plain_duplicates(texts, threshold=0.9):
    """The rule, said again in plain Python."""
    seen, recent, out = set(), [], []
    for t in texts:
        norm = " ".join(t.lower().split())
        own = set(norm.split())
        if norm in seen:
            out.append("Exact duplicate")
            continue
        near = any(own and o and len(own & o) / len(own | o) > threshold for o in recent[-100:])
        out.append("Near" if near else "")
        if not near:
            seen.add(norm)
            recent.append(own)
    return out


def test_sequential_duplicates(spark, sf):
    from loamworks.plans import views

    df = views.doc_items(spark, sf)
    got = quality.DuplicateFilter().mark(df).select("pos", "duplicate.reason").orderBy("pos").collect()
    want = plain_duplicates([r.output for r in df.orderBy("pos").collect()])
    assert [r.reason[:4] for r in got] == [w[:4] for w in want]


def test_scalable_duplicates(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base[:-1] + ["x"]), " ".join(base[:-2] + ["x", "y"]), "other words here", "", None]
    df = items(spark, *texts)
    got = {r.pos: r.reason for r in quality.DuplicateFilter(mode="scalable").mark(df).select("pos", "duplicate.reason").collect()}
    read = ["None" if t is None else t for t in texts]
    sets = [set(t.lower().split()) for t in read]
    kept, want = [], {}
    for i, s in enumerate(sets):
        exact = next((j for j in range(i) if read[j].lower().split() == read[i].lower().split()), None)
        near = any(s and sets[j] and len(s & sets[j]) / len(s | sets[j]) > 0.9 for j in kept)
        want[i] = "Exact duplicate" if exact is not None else "Near-duplicate" if near else ""
        if not want[i]:
            kept.append(i)
    assert got == want


def test_greedy_keeps_what_follows_a_dropped_row(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a bigint, b bigint")
    assert sorted(r.b for r in quality.greedy(pairs).collect()) == [2, 4]


def test_pipeline_and_scorer(spark):
    df = items(spark, "A perfectly fine answer of some length", "short", "A perfectly fine answer of some length", "see TODO: more of the same here")
    p = quality.QualityFilterPipeline()
    stats = {r["name"]: r["n"] for r in p.stats(df).collect()}
    assert stats["total_input"] == 4 and stats["failed_duplicate"] == 1 and stats["failed_content"] == 1 and stats["failed_length"] == 1
    assert [r.pos for r in p.process(df).collect()] == [0]
    assert quality.QualityFilterPipeline(stop_on_first_fail=False).stats(df).where("name = 'failed_duplicate'").first()["n"] == 1
    s = quality.QualityScorer()
    assert s.filter_batch(df).count() == 2 and s.filter_batch(df, return_failed=True).count() == 2
    assert p.stats(df.where("false")).where("name = 'total_input'").first()["n"] == 0
    assert quality.qa_quality_pipeline().filters and quality.instruction_quality_pipeline().filters
    with pytest.raises(ValueError):
        quality.DuplicateFilter(mode="other")
