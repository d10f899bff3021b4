"""Where items come from: locations, citations, sections and attributions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions.text import base_name, let, normalised, short_hash, words

_HEADERS = (re.compile(r"^([#]{1,6})\s+(.+)$", re.M), re.compile(r"^(.+)\n[=-]{2,}$", re.M), re.compile(r"^([0-9]+(?:[.][0-9]+)*[.]?)\s+([A-Z].*)$", re.M))


def item_id(content: Column) -> Column:
    return short_hash(content, 12)


def line_of(content: Column, offset: Column) -> Column:
    """Line from 1 of the character at `offset`; behind the end, the last one."""
    before = F.left(content, offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def span(content: Column, file_path: Column, start: Column, end: Column, section: Column | None = None, page: Column | None = None) -> Column:
    """A location with its lines; a page of 0 counts as none."""
    return F.struct(
        file_path.alias("file_path"),
        F.nullif(page if page is not None else F.lit(None).cast("int"), F.lit(0)).alias("page_number"),
        line_of(content, start).cast("int").alias("line_start"),
        line_of(content, end).cast("int").alias("line_end"),
        start.cast("int").alias("char_start"),
        end.cast("int").alias("char_end"),
        (section if section is not None else F.lit(None).cast("string")).alias("section"),
    )


def citation(location: Column) -> Column:
    """Name, page, section and lines, as far as they are known."""
    a, b = location["line_start"], location["line_end"]
    lines = F.when(b.isNotNull() & (a != b), F.format_string("lines %d-%d", a, b)).when(a.isNotNull(), F.format_string("line %d", a))
    return F.concat_ws(", ", base_name(location["file_path"]), F.when(location["page_number"].isNotNull(), F.format_string("p. %d", location["page_number"])), F.when(location["section"].isNotNull(), F.concat(F.lit('"'), location["section"], F.lit('"'))), lines)


def find_text(content: Column, text: Column, start: Column | int = 0) -> Column:
    """struct<char_start, char_end, fuzzy> in the normalised content, or null: the whole text, else its first five words."""
    start = F.lit(start) if isinstance(start, int) else start


    def of(v: Column) -> Column:
        space = v["space"]
        wanted, head = F.array_join(v["own"], " "), F.array_join(F.slice(v["own"], 1, 5), " ")
        whole = F.nullif(F.position(wanted, space, start + 1), F.lit(0))
        part = F.nullif(F.position(head, space, start + 1), F.lit(0))
        return let(F.struct(whole.alias("whole"), (F.coalesce(whole, F.when(head != "", part)) - 1).alias("at")), lambda f: F.when(f["at"].isNotNull(), F.struct(f["at"].alias("char_start"), (f["at"] + F.length(text)).alias("char_end"), f["whole"].isNull().alias("fuzzy"))))

    # both texts are normalised once
    return let(F.struct(normalised(content).alias("space"), words(F.lower(text)).alias("own")), of)


def section_headers(content: Column) -> Column:
    """array<struct<header, offset>> by offset: lines after #, underlined lines and numbered lines."""

    @F.arrow_udf("array<struct<header: string, offset: int>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("header", pa.string()), ("offset", pa.int32())]))
        for part in parts:
            out = []
            for text in part.to_pylist():
                found = [] if text else None
                if text:
                    found += [(m.start(), m.group(2).strip()) for m in _HEADERS[0].finditer(text)]
                    found += [(m.start(), m.group(1).strip()) for m in _HEADERS[1].finditer(text)]
                    found += [(m.start(), f"{m.group(1)} {m.group(2)}".strip()) for m in _HEADERS[2].finditer(text)]
                    found.sort(key=lambda x: x[0])
                out.append([{"header": h, "offset": o} for o, h in found or []])
            yield pa.array(out, kind)

    return run(content)


def section_at(headers: Column, offset: Column) -> Column:
    """The last header at or before `offset`, or null."""
    return F.try_element_at(F.filter(headers, lambda h: h["offset"] <= offset), F.lit(-1))["header"]


def latest(attributions: DataFrame, id_col: str = "item_id", time_col: str = "timestamp") -> DataFrame:
    """One attribution for each item: the last one wins."""
    at = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(time_col)))
    return attributions.withColumn("__at", at).where("__at = 1").drop("__at")


def filter_by_source(items: DataFrame, path: str, sources: str = "sources") -> DataFrame:
    return items.where(F.exists(sources, lambda s: s["file_path"] == path))


def attribution_stats(items: DataFrame, sources: str = "sources", method: str = "extraction_method") -> DataFrame:
    """(total_items, unique_sources, avg_sources, methods)."""
    one = items.agg(F.count("*").alias("total_items"), F.coalesce(F.avg(F.size(sources)), F.lit(0.0)).alias("avg_sources"))
    unique = items.select(F.explode(F.transform(sources, lambda s: s["file_path"])).alias("p")).agg(F.count_distinct("p").alias("unique_sources"))
    methods = items.groupBy(method).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(method, F.lit("unknown")), "n")))).alias("methods"))
    return one.crossJoin(unique).crossJoin(methods)  # a row each


def public_fields(items: DataFrame) -> DataFrame:
    return items.select(*[c for c in items.columns if not c.startswith("_")])


def save_attributed(items: DataFrame, path: str, attribution: str = "attribution") -> None:
    """JSON lines with the attribution inline, and the attributions beside them."""
    rest = [c for c in items.columns if c != attribution]
    items.select(F.to_json(F.struct(*rest, F.col(attribution).alias("_attribution")))).write.text(path)
    items.select(F.to_json(attribution)).write.text(path.removesuffix(".jsonl") + ".attributions")


def load_attributions(spark, *paths: str) -> DataFrame:
    """Attributions of several files; of one item the one read last wins."""
    out = None
    for i, p in enumerate(paths):
        d = spark.read.json(p).withColumn("__from", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("__from")))
    return out.withColumn("__at", at).where("__at = 1").drop("__at", "__from")
