"""Formats, datasets, chunks, extraction, augmentation and lineage."""

import json

import pytest
from pyspark.sql import functions as F

from loamworks.functions.formats import format_items, get_formatter, list_formats
from loamworks.operators import augmentation, chunking, cost, extraction, jobs, lineage, parallel
from loamworks.operators.dataset import Dataset
from loamworks.schemas import ITEM_FIELDS


def item(spark, **fields):
    schema = ", ".join(f"{k} {v}" for k, v in ITEM_FIELDS.items())
    return spark.createDataFrame([tuple(fields.get(k) for k in ITEM_FIELDS)], schema)


def formatted(df, name, **kw):
    rows = format_items(df, name, **kw).collect()
    return rows[0]["formatted"].asDict(recursive=True) if rows else None


def said(**turns):
    return [dict(role=r, content=c) for r, c in turns.items()]


def test_formats(spark):
    qa = item(spark, question="Q?", answer="A")
    assert formatted(qa, "openai", system_prompt="S")["messages"] == said(system="S", user="Q?", assistant="A")
    assert formatted(qa, "alpaca") == {"instruction": "Q?", "input": "", "output": "A"}
    assert formatted(qa, "sharegpt")["conversations"][1] == {"from": "gpt", "value": "A"}
    assert formatted(qa, "llamafactory")["history"] == []
    assert formatted(qa, "chatml")["text"].endswith("<|im_start|>assistant\nA<|im_end|>\n")
    rule = item(spark, rule="R", context="C", rationale="W")
    assert formatted(rule, "openai")["messages"] == said(user="What is the rule regarding C?", assistant="R\n\nRationale: W")
    assert formatted(rule, "chatml") is None
    assert formatted(item(spark, summary="S", original_text=""), "openai")["messages"][0]["content"] == "Provide a summary."
    assert formatted(item(spark, summary="S"), "sharegpt") is None
    assert formatted(item(spark, instruction="I", input="X", output="O"), "openai")["messages"][0]["content"] == "I\n\nInput: X"
    assert formatted(item(spark, fact="F"), "alpaca")["instruction"] == "Tell me a fact about this topic."
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    conv = item(spark, conversation=turns)
    assert formatted(conv, "llamafactory") == {"instruction": "c", "input": "", "output": "d", "history": [["a", "b"]]}
    assert formatted(item(spark, conversation=turns[:1]), "llamafactory") is None
    assert formatted(spark.createDataFrame([("v", "m")], "key string, _internal string"), "generic") == {"key": "v"}
    assert formatted(item(spark), "openai") is None
    assert len(list_formats()) == 6
    with pytest.raises(ValueError):
        get_formatter("other")


def dataset(spark, n=10):
    return Dataset(spark.createDataFrame([(i, f"q{i % 7}", "a", f"s{i % 2}.txt", "qa" if i % 3 else "") for i in range(n)], "pos bigint, question string, answer string, source string, extractor_type string"), {"k": 1})


def test_dataset(spark, tmp_path):
    d = dataset(spark)
    assert len(d) == 10 and d[0]["question"] == "q0" and d[-1]["pos"] == 9
    assert len(d.deduplicate()) == 7 and len(d.filter_by_source("s1")) == 5 and len(d.filter(lambda r: r["pos"] < 3)) == 3
    train, test = d.split(0.8, 3)
    assert (len(train), len(test)) == (8, 2)
    assert sorted(r["pos"] for r in d.shuffle(1)) == list(range(10)) and len(d.sample(4)) == 4 and len(d.sample(40)) == 10
    both = d.merge(Dataset(d.df, {"k": 2}))
    assert len(both) == 20 and both.metadata == {"k": 2} and sorted(r["pos"] for r in both) == list(range(20))
    assert len(d.add({"question": "new", "source": "x", "extractor_type": "qa"})) == 11
    stats = {(r["kind"], r["name"]): r["n"] for r in d.statistics().collect()}
    assert stats[("total", "")] == 10 and stats[("extractor_type", "unknown")] == 4
    assert d.to_jsonl(str(tmp_path / "out"), "alpaca", single=True) == 10
    again = Dataset.from_jsonl(spark, str(tmp_path / "out"), "qa")
    assert len(again) == 10 and "instruction" in again.fields
    assert d.to_json(str(tmp_path / "d.json")) == 10
    assert json.loads((tmp_path / "d.json").read_text())["items"][3]["data"]["question"] == "q3"
    back = Dataset.from_json(spark, str(tmp_path / "d.json"))
    assert len(back) == 10 and back.metadata == {"k": 1}
    with pytest.raises(IndexError):
        d[10]


def test_chunks(spark):
    text = "A sentence of twenty-six ch. " * 50
    got = chunking.chunk_text(text, 100)
    assert all(len(c) <= 100 for c in got) and "".join("".join(got).split()) == "".join(text.split())
    assert chunking.chunk_text("", 10) == [""] and chunking.chunk_text(" x ", 10) == [" x "]
    over = chunking.chunk_text("word " * 100, 50, 10)
    assert len(over) > 10 and all(c == c.strip() for c in over)
    df = spark.createDataFrame([("a", "x" * 25), ("b", None), ("c", "")], "source string, content string")
    assert [(r.source, r.chunk_index, len(r.chunk)) for r in chunking.chunks(df, 10).orderBy("source", "chunk_index").collect()] == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("c", 0, 0)]
    with pytest.raises(ValueError):
        chunking.chunk(F.lit("x"), 10, 8)


def test_parse():
    qa = extraction.get_extractor("qa")
    assert qa.parse('Sure: [{"question": " Q ", "answer": 1}, {"question": "x"}, 3] done') == [{"question": "Q", "answer": "1"}]
    assert qa.parse('[{"question": "Q", "answer": "A"}, {broken]') == [{"question": "Q", "answer": "A"}]
    assert qa.parse("nothing") == [] and qa.parse(None) == []
    assert extraction.get_extractor("rules").parse('[{"rule": "R", "category": "X"}, "the rule"]') == [{"rule": "R", "context": "", "category": "x", "rationale": ""}]
    assert extraction.get_extractor("facts").parse('[{"fact": "F"}]')[0]["confidence"] == "medium"
    conv = '[{"conversation": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"conversation": [{"role": "user", "content": "a"}]}]'
    assert len(extraction.get_extractor("conversation").parse(conv)) == 1
    assert extraction.get_extractor("summary").parse('[{"summary_type": "s", "summary": "t"}]')[0]["original_text"] == ""
    with pytest.raises(ValueError):
        extraction.get_extractor("other")


def test_extract(spark):
    def llm(prompt):
        if "fails" in prompt:
            raise RuntimeError("down")
        return '[{"question": "Q", "answer": "A", "level": 2}]'

    docs = spark.createDataFrame([("a.txt", "fine"), ("b.txt", "fails")], "source string, content string")
    got = {(r.source, r.extractor): r for r in extraction.extract(docs, [extraction.get_extractor("qa"), extraction.custom_extractor("mine", "Do {content} {max_items}")], llm).collect()}
    assert got[("a.txt", "qa")]["item"]["answer"] == "A" and json.loads(got[("a.txt", "mine")]["extra"]) == {"level": 2}
    assert got[("b.txt", "qa")]["error"] == "RuntimeError: down"


def test_augmentation(spark):
    df = spark.createDataFrame([(i, "what is it?", "This is a good and important need, use it to help") for i in range(10)], "pos bigint, input string, output string")
    a = augmentation.synonym_augmenter(share=1.0, variations=1).make(df)
    assert a.count() == 10 and all(r.output != "x" and "good" not in r.output and "need," not in r.output for r in a.collect())
    assert sorted(a.collect()) == sorted(a.collect())
    llm = lambda p: "1. One way\n2) Other way\n3: Third" if "numbered" in p else "Changed text"
    assert augmentation.question_augmenter(llm).make(df).count() == 30
    assert augmentation.paraphrase_augmenter(llm).make(df).count() == 20
    assert augmentation.back_translation_augmenter(llm).make(df).select("_augmentation").distinct().count() == 3
    assert augmentation.negation_augmenter(llm).make(df).where("_is_negation").count() == 10
    assert augmentation.style_augmenter(llm).make(df).count() == 50
    with pytest.raises(KeyError):
        augmentation.style_augmenter(llm, styles=["none"])
    out = augmentation.augment(df, [augmentation.paraphrase_augmenter(llm)], 1.5)
    assert out.count() == 15 and out.where("_augmentation IS NULL").count() == 10
    assert augmentation.augment(df.where("false"), augmentation.default_augmenters()).count() == 0


def test_lineage(spark):
    text = "# Top\nline two\n\nSub\n---\nmore text here\n1.2 Numbered Part\nend"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").withColumn("h", lineage.section_headers(F.col("t")))
    rows = df.select("h", lineage.section_at(F.col("h"), F.lit(30)).alias("s")).collect()
    assert [h.header for h in rows[0].h] == ["Top", "Sub", "1.2 Numbered Part"] and rows[0].s == "Sub"
    assert rows[1].h == [] and rows[1].s is None and rows[2].h == []
    at = lineage.span(F.col("t"), F.lit("/x/a.md"), F.lit(7), F.lit(20), page=F.lit(3))
    assert df.select(lineage.citation(at).alias("c")).first().c == "a.md, p. 3, lines 2-5"
    found = df.select(lineage.find_text(F.col("t"), F.lit("MORE  text")).alias("f"), lineage.find_text(F.col("t"), F.lit("absent")).alias("g")).first()
    assert not found.f.fuzzy and found.g is None
    two = spark.createDataFrame([("i", 1.0, "old"), ("i", 2.0, "new")], "item_id string, timestamp double, v string")
    assert [r.v for r in lineage.latest(two).collect()] == ["new"]


def test_cost():
    assert cost.price("gpt-4o-mini-2024") == (0.15, 0.6) and cost.price("gpt-4o-mini-2024", legacy=True) == (2.5, 10.0) and cost.price("nobody") == (5.0, 15.0)


def test_jobs(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(4)], "doc_id string, content string")
    j = jobs.Jobs(spark, f"file://{tmp_path}/jobs")

    def work(t):
        if t.endswith("3"):
            raise ValueError("bad")
        return t.upper()

    assert j.pending("j", docs).count() == 4
    assert j.process("j", docs.where("doc_id < '2'"), work, retries=0).where("status = 'done'").count() == 2
    assert j.process("j", docs, work, retries=0).count() == 4
    assert j.pending("j", docs).count() == 0 and j.pending("j", docs, retry_failed=True).count() == 1
    one = j.list().first()
    assert (one["done"], one["failed"]) == (3, 1)
    assert j.cleanup({"j": 4}, max_age_days=7) == []
    j.delete("j")
    assert j.table("j").count() == 0


def test_parallel(spark):
    import asyncio

    async def later(x):
        await asyncio.sleep(0.001)
        return x * 2

    df = spark.createDataFrame([(i,) for i in range(6)], "value bigint")
    assert sorted(r.r.result for r in df.select(parallel.apply(later, "bigint", threads=3)(F.col("value")).alias("r")).collect()) == [0, 2, 4, 6, 8, 10]
    bad = df.coalesce(1).select(parallel.apply_batches(lambda xs: xs[:1], "bigint", 4)(F.col("value")).alias("r"))
    assert all("results for" in r.r.error for r in bad.collect())
    s = parallel.Stages().add("double", lambda x: x * 2, "bigint").add("big", lambda x: x > 4, is_filter=True)
    assert sorted(r.value for r in s.process(df).collect()) == [6, 8, 10]


def test_cleanup_keeps_what_is_not_complete(spark, tmp_path):
    j = jobs.Jobs(spark, f"file://{tmp_path}/jobs")
    row = lambda i: spark.createDataFrame([(i, "done", None, None)], "doc_id string, status string, error string, result string")
    j.append("unknown", row("a"))
    j.start("half", 2)
    j.append("half", row("a"))
    j.start("whole", 1)
    j.append("whole", row("a"))
    assert {r.job_id: r.total for r in j.list().collect()} == {"unknown": None, "half": 2, "whole": 1}
    assert j.table("half").count() == 1
    assert j.cleanup(max_age_days=-1) == ["whole"]
    assert {r.job_id for r in j.list().collect()} == {"unknown", "half"}


async def _double(x):
    return str(x * 2)


def test_rate_limits(spark):
    """Five calls at 20 a second take four gaps of 50 ms, of coroutines as of functions, and a task's share is its part."""
    import time

    one = spark.range(5).coalesce(1)
    for fn, tasks, least in ((_double, 1, 0.2), (lambda x: str(x * 2), 1, 0.2), (_double, 3, 0.6)):
        began = time.monotonic()
        got = one.select(parallel.apply(fn, threads=5, per_second=20, tasks=tasks)("id").alias("a")).collect()
        assert time.monotonic() - began >= least
        assert [r.a.result for r in got] == ["0", "2", "4", "6", "8"]
    turns = parallel.Turns(100)
    with __import__("concurrent.futures").futures.ThreadPoolExecutor(8) as pool:
        waits = sorted(pool.map(lambda _: turns.next(), range(20)))
    assert waits[-1] > 0.15 and len(set(waits)) == 20


def test_entry_survives_a_missing_package():
    """Without tiktoken the queries of the operators that need it are left out, and the others are there."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tiktoken'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; assert 'q_chunk' in e.queries() and len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_public_names():
    import loamworks

    assert all(callable(getattr(loamworks, n)) for n in loamworks.__all__)


def test_bigrams_are_counted_by_hash(spark, capsys):
    """Not by sorting all pairs; ties of a text go by place, also if pos is far from 0."""
    from loamworks.operators import analytics

    items = spark.createDataFrame([(-3, "c d c e"), (2**62, "a b"), (5, "d c f")], "pos bigint, output string")
    top = analytics.top_bigrams(items)
    assert [tuple(r) for r in top.collect()] == [("d c", 2), ("c d", 1), ("c e", 1), ("c f", 1), ("a b", 1)]
    top.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_chunks_take_few_texts_at_once():
    import pyarrow as pa

    from loamworks.operators import chunking

    texts = ["x" * 10, None, "", "y" * 30, "z" * 3, "é" * 4]
    for part in (pa.array(texts), pa.array(["", *texts])[1:], pa.array([None, None], pa.string()), pa.array([], pa.string())):
        found = list(chunking.slices(part, 12))
        assert [t for f in found for t in f.to_pylist()] == part.to_pylist()
        assert all(len(f) <= 1 or sum(len((t or "").encode()) for t in f.to_pylist()) <= 12 for f in found)
