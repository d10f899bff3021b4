"""Token ids as directly addressable codes.

Each id is cut into chunks of fixed widths, the lowest bits first.  Level j holds the j-th chunk
of every id that is long enough to have one, and a bitmap that says which of these ids go on to
level j+1.  The place of an id on the next level is the number of set bits before it, which a
directory of running counts answers without reading more than a few bytes.  So token i of a
document is found by one look into each level, and no block is ever decoded.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.llm._text import column
from loamworks.llm.token_counts import PATTERN, VOCABULARY, load_ranks

#: Bits of an id on each level; the last level takes whatever is left.
WIDTHS = (8, 4, 4)
#: Bits of the bitmap for each count of the rank directory.
RANK_BLOCK = 512

LEVEL = "struct<chunks: binary, more: binary, ranks: binary>"


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """`width` bits of each value, the highest first, without gaps."""
    if width == 8:
        return values.astype(np.uint8).tobytes()
    if width == 4:
        v = values.astype(np.uint8)
        if len(v) % 2:
            v = np.append(v, np.uint8(0))
        return ((v[0::2] << 4) | v[1::2]).tobytes()
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((values[:, None].astype(np.uint32) >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def chunk_at(packed: bytes, width: int, i: int) -> int:
    bit = i * width
    stop = (bit + width + 7) // 8
    return (int.from_bytes(packed[bit // 8 : stop], "big") >> (stop * 8 - bit - width)) & ((1 << width) - 1)


def encode(ids: np.ndarray, widths: Sequence[int] = WIDTHS) -> list[dict[str, bytes]]:
    """The levels of one sequence of ids, as many as its largest id needs."""
    if len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError(f"an id needs more than {sum(widths)} bits")
    levels = []
    left = ids.astype(np.uint32)
    for j, width in enumerate(widths):
        if not len(left):
            break
        rest = left >> np.uint32(width)
        # on the last level nothing goes on, so neither bitmap nor directory is kept
        more = rest > 0 if j + 1 < len(widths) else np.zeros(0, bool)
        level = {"chunks": pack_bits(left & np.uint32((1 << width) - 1), width), "more": b"", "ranks": b""}
        if more.any():
            level["more"] = np.packbits(more).tobytes()
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint32)
            level["ranks"] = (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes()
        levels.append(level)
        left = rest[more] if len(more) else rest[:0]
    return levels


def rank(level: dict[str, bytes], i: int) -> int:
    """Set bits of the bitmap before place i."""
    block = i // RANK_BLOCK
    n = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
    bits = level["more"][block * RANK_BLOCK // 8 : i // 8]
    tail = level["more"][i // 8] >> (8 - i % 8) if i % 8 else 0
    return n + int.from_bytes(bits, "big").bit_count() + tail.bit_count()


def access(levels: Sequence[dict[str, bytes]], i: int, widths: Sequence[int] = WIDTHS) -> int:
    """Token i, by one look into each level."""
    value = shift = 0
    for level, width in zip(levels, widths, strict=False):
        value |= chunk_at(level["chunks"], width, i) << shift
        shift += width
        if not level["more"] or not level["more"][i // 8] >> (7 - i % 8) & 1:
            break
        i = rank(level, i)
    return value


def decode(levels: Sequence[dict[str, bytes]], n: int, widths: Sequence[int] = WIDTHS) -> np.ndarray:
    """All ids of a sequence at once."""
    out = np.zeros(n, np.uint32)
    at, shift = np.arange(n), 0
    for level, width in zip(levels, widths, strict=False):
        bits = np.unpackbits(np.frombuffer(level["chunks"], np.uint8))[: len(at) * width].reshape(-1, width)
        value = np.zeros(len(at), np.uint32)
        for b in range(width):
            value = (value << np.uint32(1)) | bits[:, b]
        out[at] |= value << np.uint32(shift)
        shift += width
        if not level["more"]:
            break
        at = at[np.unpackbits(np.frombuffer(level["more"], np.uint8))[: len(at)].astype(bool)]
    return out


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.buffer = core._core_bpe.encode_to_tiktoken_buffer

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.buffer(text, frozenset()), np.uint32) if text else np.zeros(0, np.uint32)


@functools.cache
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str = VOCABULARY, widths: Sequence[int] = WIDTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, levels) for every row of `docs`: a map without a shuffle.

    A null or empty text has 0 tokens and no levels. Repeated rows and null ids stay; other
    columns are ignored. Texts of any length are encoded whole.
    """
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("levels", T.ArrayType(T.StructType([T.StructField(x, T.BinaryType()) for x in ("chunks", "more", "ranks")])))])
    arrow = pa.list_(pa.struct([(x, pa.binary()) for x in ("chunks", "more", "ranks")]))
    widths = tuple(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                n, levels = [], []
                for text in column(batch, "__text").to_pylist():
                    ids = enc.ids(text)
                    n.append(len(ids))
                    levels.append(encode(ids, widths))
                yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(n, pa.int64()), pa.array(levels, arrow)], names=[id_col, "n_tokens", "levels"])

    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(run, out)


def token_at(levels: Column | str, position: Column | str, widths: Sequence[int] = WIDTHS, n_tokens: Column | str = "n_tokens") -> Column:
    """Column: the token id at `position` (from 0) of `levels`; null outside the `n_tokens` of the sequence or for null."""
    widths = tuple(widths)

    @F.arrow_udf(T.IntegerType())
    def look(lv: pa.Array, at: pa.Array, n: pa.Array) -> pa.Array:
        found = []
        for ls, i, size in zip(lv.to_pylist(), at.to_pylist(), n.to_pylist(), strict=True):
            found.append(access(ls, i, widths) if ls and i is not None and 0 <= i < (size or 0) else None)
        return pa.array(found, pa.int32())

    return look(*(F.col(c) if isinstance(c, str) else c for c in (levels, position, n_tokens)))
