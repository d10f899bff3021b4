import json
import zipfile

import pytest

from loamworks.cli import main, parser
from loamworks.plans.pipeline import Processor, process
from loamworks.sources import hub, loaders
from loamworks.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("two\r\nlines é".encode())
    (tmp_path / "l.TXT").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "sub" / "b.md").write_text("# H\n\n\n\n<b>bold</b> text\n")
    (tmp_path / "c.json").write_text(json.dumps({"Text": " one ", "items": [{"content": "two"}, "bare"], "body": {"x": {"description": "three"}}}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "d.xyz").write_text("no")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda s: f"<w:tc><w:p><w:r><w:t>{s}</w:t></w:r></w:p></w:tc>"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell("x")}{cell("")}{cell("y")}</w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", body)
    return tmp_path


def test_folder(spark, folder):
    got = {r.source.rsplit("/", 1)[1]: r for r in loaders.load_folder(spark, str(folder)).collect()}
    assert set(got) == {"a.txt", "l.TXT", "b.md", "c.json", "e.docx"}
    assert got["a.txt"].content == "two\nlines é" and got["l.TXT"].content == "café" and got["b.md"].content == "# H\n\nbold text"
    assert got["c.json"].content == "one\n\ntwo\n\nthree" and got["e.docx"].content == "Para\n\nx | y"
    assert got["e.docx"].metadata.paragraph_count == 2 and got["a.txt"].metadata.encoding == "utf-8"
    assert loaders.load_folder(spark, str(folder), recursive=False, extensions=[".md"]).count() == 0
    assert loaders.load_folder(spark, str(folder), errors=True).where("error IS NOT NULL").count() == 1
    with pytest.raises(ValueError):
        loaders.load_folder(spark, str(folder / "none"))
    with pytest.raises(ValueError):
        loaders.load_document(spark, str(folder / "d.xyz"))
    assert loaders.load_document(spark, str(folder / "d.xyz"), loaders.text_loader()).first().content == "no"
    assert ".docx" in loaders.supported_extensions()


def reply(prompt):
    return '[{"question": "What is in this passage?", "answer": "A passage of %d characters in all"}]' % len(prompt)


def test_processor(spark, folder, tmp_path):
    p = Processor(spark, reply, extractors=("qa",), jobs_path=f"file://{tmp_path}/jobs")
    first = p.process_folder(str(folder))
    assert 1 <= len(first) <= 5 and "_attribution_id" in first.fields
    assert len(p.process_folder(str(folder))) == len(first)
    assert len(Processor(spark, reply, extractors=("qa",)).process_text("some text")) == 1
    assert p.estimate_cost(loaders.load_folder(spark, str(folder))).count() == 2
    assert process(spark, str(folder), str(tmp_path / "out"), reply, extractors=("qa",)) >= 1
    with pytest.raises(ValueError):
        process(spark, str(folder / "none"), str(tmp_path / "out2"), reply)


def test_hub(spark, tmp_path):
    t = hub.FolderTransport(str(tmp_path / "hub"))
    df = spark.createDataFrame([("a", "b")] * 3, "input string, output string")
    url = hub.upload_to_hub(t, df, "me/set", str(tmp_path / "stage"), "Set")
    assert url.endswith("me/set") and hub.download(spark, t, "me/set").count() == 3
    assert "n<1K" in (tmp_path / "hub/me/set/README.md").read_text()
    assert [hub.size_category(n) for n in (999, 1000, 99_999, 100_000)] == ["n<1K", "1K<n<10K", "10K<n<100K", "n>100K"]
    with pytest.raises(ValueError):
        hub.upload_splits(t, {"train": df}, "me/set", str(tmp_path / "s"), format="csv")
    with pytest.raises(FileNotFoundError):
        hub.upload_jsonl(t, str(tmp_path / "none.jsonl"), "me/set")
    assert "- fr" in hub.DatasetCard("n", language=["en", "fr"]).to_yaml_header()


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text('{"input": "a b", "output": "c"}\n{"input": "d", "output": "e f"}\n')
    assert main(["analyze", str(tmp_path / "in.jsonl")]) == 0 and "Items: 2" in capsys.readouterr().out
    assert main(["augment", str(tmp_path / "in.jsonl"), str(tmp_path / "aug")]) == 0
    assert main(["upload", str(tmp_path / "in.jsonl"), "--repo", "r", "--hub", str(tmp_path / "hub")]) == 0
    assert main(["download", "r", str(tmp_path / "down"), "--hub", str(tmp_path / "hub")]) == 0
    assert main(["checkpoints", "list", "--dir", f"file://{tmp_path}/none"]) == 0
    assert main(["analyze", str(tmp_path / "absent.jsonl")]) == 1
    with pytest.raises(SystemExit):
        parser().parse_args([])


def test_streams(spark, sf, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    log = ingest.stream(spark, str(tmp_path / "in"), schema).withColumnRenamed("event_type", "error")
    q = ingest.run_available(log.select("event_id", "ts"), str(tmp_path / "c"), ingest.append_parquet(str(tmp_path / "out")))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    again = ingest.run_available(log.select("event_id", "ts"), str(tmp_path / "c"), ingest.append_parquet(str(tmp_path / "out")))
    again.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
