"""Texts cut into chunks at paragraph, line, sentence or word ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = ("\n" * 2, "\n", ". ", " ")


def chunk_text(text: str, size: int, overlap: int = 0) -> list[str]:
    """A text of at most `size` characters stays as it is, even if empty; else stripped chunks without blank ones."""
    if len(text) <= size:
        return [text]
    found, at, n = [], 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            for b in BREAKS:
                cut = text.rfind(b, at, end)
                if cut - at > size // 2:
                    end = cut + len(b)
                    break
        if piece := text[at:end].strip():
            found.append(piece)
        at = end - overlap
    return found


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """`texts` in runs of at most so many bytes, or of one text: a batch of Spark's is as large as its rows are long."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts) or not at:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def chunk(text: Column, size: int = 3000, overlap: int = 0) -> Column:
    """array<string>; null for null."""
    if size < 1 or overlap < 0 or overlap >= max(1, size // 2):
        raise ValueError("size must be positive and overlap less than half of it")

    @F.arrow_udf("array<string>")
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            for few in slices(part):
                yield pa.array([None if t is None else chunk_text(t, size, overlap) for t in few.to_pylist()], pa.list_(pa.string()))

    return cut(text)


def chunks(docs: DataFrame, size: int = 3000, overlap: int = 0, text_col: str = "content") -> DataFrame:
    """A row for each chunk, with chunk_index and chunk in the text's place."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(chunk(F.col(text_col), size, overlap)).alias("chunk_index", "chunk"))
