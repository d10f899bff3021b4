"""Files as documents: text, Markdown, PDF, Word and JSON, one row each."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions.text import stripped, suffix
from loamworks.schemas import METADATA

TEXT_FIELDS = ("text", "content", "body", "description")


def _newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decoded(content: Column, fallback: bool = True) -> Column:
    """UTF-8, else Latin-1 (null without the fallback)."""
    plain = content.cast("string")
    return _newlines(F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, "ISO-8859-1") if fallback else F.lit(None).cast("string")))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def squeeze_lines(text: Column) -> Column:
    return stripped(F.regexp_replace(text, "\n\n\n+", "\n\n"))


def clean_markdown(text: Column, strip_html: bool = True) -> Column:
    return squeeze_lines(strip_tags(text) if strip_html else text)


def clean_pdf(text: Column) -> Column:
    """Words broken at line ends joined, single spaces, no more than one blank line."""
    joined = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    return squeeze_lines(F.regexp_replace(joined, r"[ \t]+", " "))


def json_texts(value: Any, wanted: frozenset[str], out: list[str]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            if str(k).lower() in wanted and isinstance(v, str):
                if v.strip():
                    out.append(v.strip())
            else:
                json_texts(v, wanted, out)
    elif isinstance(value, list):
        for v in value:
            json_texts(v, wanted, out)


_READ = "struct<content: string, page_count: int, paragraph_count: int, table_count: int, title: string, author: string, subject: string, keywords: string>"
_EMPTY = dict.fromkeys(("content", "page_count", "paragraph_count", "table_count", "title", "author", "subject", "keywords"))


def read_docx(data: bytes) -> dict[str, Any]:
    """Paragraphs that aren't blank, then all tables, a row a line with its filled cells."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    paragraphs, tables = body.findall(f"{w}p"), body.findall(f"{w}tbl")
    parts = [s for p in paragraphs if (s := text(p).strip())]
    for t in tables:
        lines = [" | ".join(c for cell in row.findall(f"{w}tc") if (c := text(cell).strip())) for row in t.findall(f"{w}tr")]
        if kept := [x for x in lines if x]:
            parts.append("\n".join(kept))
    return {"content": "\n\n".join(parts), "paragraph_count": len(paragraphs), "table_count": len(tables)}


def read_pdf(data: bytes) -> dict[str, Any]:
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF files needs PyMuPDF: pip install pymupdf") from e
    with fitz.open(stream=data, filetype="pdf") as pdf:
        pages = [t for page in pdf if (t := page.get_text()).strip()]
        about = {k: pdf.metadata.get(k) or None for k in ("title", "author", "subject", "keywords")}
        return {"content": "\n\n".join(pages), "page_count": pdf.page_count} | about


def _by_bytes(read: Callable[[bytes], dict[str, Any]]) -> Callable[[Column], Column]:
    @F.pandas_udf(f"struct<value: {_READ}, error: string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part:
                try:
                    rows.append((_EMPTY | read(bytes(data)), None))
                except Exception as e:  # noqa: BLE001 - a file that can't be read is skipped, with its reason
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["value", "error"])

    return run


def _json_reader(fields: Sequence[str]) -> Callable[[bytes], dict[str, Any]]:
    wanted = frozenset(f.lower() for f in (fields or TEXT_FIELDS))

    def read(data: bytes) -> dict[str, Any]:
        out: list[str] = []
        json_texts(json.loads(data.decode()), wanted, out)
        return {"content": "\n\n".join(out)}

    return read


class Loader:
    """`extensions`, and `read`: from the column of bytes to struct<value, error>."""

    def __init__(self, format: str, extensions: Sequence[str], read: Callable[[Column], Column], encoding: str | None = None) -> None:
        self.format, self.extensions, self.read, self.encoding = format, tuple(extensions), read, encoding


def _native(text: Callable[[Column], Column], null_error: str = "not UTF-8") -> Callable[[Column], Column]:
    def read(data: Column) -> Column:
        t = text(data)
        fields = [t.alias("content"), *[F.lit(None).cast(k).alias(n) for n, k in (("page_count", "int"), ("paragraph_count", "int"), ("table_count", "int"), ("title", "string"), ("author", "string"), ("subject", "string"), ("keywords", "string"))]]
        return F.struct(F.when(t.isNotNull(), F.struct(*fields)).alias("value"), F.when(t.isNull(), null_error).alias("error"))

    return read


def text_loader() -> Loader:
    return Loader("text", (".txt", ".text"), _native(decoded), "utf-8")


def markdown_loader(strip_html: bool = True) -> Loader:
    return Loader("markdown", (".md", ".markdown", ".mdown"), _native(lambda c: clean_markdown(decoded(c, fallback=False), strip_html)))


def pdf_loader() -> Loader:
    def read(data: Column) -> Column:
        got = _by_bytes(read_pdf)(data)
        return F.struct(got["value"].withField("content", clean_pdf(got["value"]["content"])).alias("value"), got["error"].alias("error"))

    return Loader("pdf", (".pdf",), read)


def docx_loader() -> Loader:
    return Loader("docx", (".docx",), lambda data: _by_bytes(read_docx)(data))


def json_loader(text_fields: Sequence[str] = ()) -> Loader:
    return Loader("json", (".json",), lambda data: _by_bytes(_json_reader(text_fields))(data))


_LOADERS: list[Loader] = [text_loader(), markdown_loader(), pdf_loader(), docx_loader(), json_loader()]


def register_loader(loader: Loader) -> None:
    """Taken before the others."""
    _LOADERS.insert(0, loader)


def supported_extensions() -> set[str]:
    return {e for x in _LOADERS for e in x.extensions}


def _documents(files: DataFrame, loaders: Sequence[Loader]) -> DataFrame:
    """(content, metadata, source, error) of a binaryFile scan; each format is read by its own branch."""
    out, taken = None, set()
    for x in loaders:
        own = [e for e in x.extensions if e not in taken]
        taken |= set(own)
        if not own:
            continue
        part = files.where(suffix(F.col("path")).isin(own)).select("path", "length", x.read(F.col("content")).alias("r"))
        v = F.col("r.value")
        meta = F.struct(F.lit(x.format).alias("format"), F.lit(x.encoding).cast("string").alias("encoding"), F.col("length").alias("size_bytes"), *[v[c].alias(c) for c in ("page_count", "paragraph_count", "table_count", "title", "author", "subject", "keywords")])
        part = part.select(v["content"].alias("content"), meta.cast(METADATA).alias("metadata"), F.regexp_replace("path", "^file:/+", "/").alias("source"), F.col("r.error").alias("error"))
        out = part if out is None else out.unionAll(part)
    return out


def load_document(spark: SparkSession, path: str, loader: Loader | None = None) -> DataFrame:
    """One row; an extension that no loader takes is a ValueError."""
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    found = loader or next((x for x in _LOADERS if ext in x.extensions), None)
    if found is None:
        raise ValueError(f"Unsupported file type: {ext}. Supported: {', '.join(sorted(supported_extensions()))}")
    found = Loader(found.format, (*found.extensions, ext), found.read, found.encoding)
    return _documents(spark.read.format("binaryFile").load(path), [found])


def load_folder(spark: SparkSession, folder: str, recursive: bool = True, extensions: Sequence[str] | None = None, errors: bool = False) -> DataFrame:
    """A row for each file that a loader takes; those that can't be read only with `errors`.

    The scan leaves out names that begin with a dot or an underscore.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise ValueError(f"Not a folder: {folder}")
    wanted = sorted(supported_extensions() & {e.lower() for e in extensions} if extensions else supported_extensions())
    glob = "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)
    docs = _documents(files.where(suffix(F.col("path")).isin(wanted)), _LOADERS)
    return docs if errors else docs.where("error IS NULL AND content IS NOT NULL").drop("error")


def in_order(docs: DataFrame) -> DataFrame:
    """By path, its parts compared one by one."""
    return docs.orderBy(F.split("source", "/"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row for each line that isn't blank, with pos by file and line."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.option("mode", "FAILFAST").json(path)
    order = F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    return rows.withColumn("pos", order["i"])
