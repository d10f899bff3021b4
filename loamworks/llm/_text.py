"""Numpy kernels over Arrow string buffers, shared by the operators.

A *word* of the lower-cased text is a maximal run of letters and digits of any script, or one
character of a script that doesn't put spaces between words (Chinese, Japanese, Thai, Lao, Burmese,
Khmer).  Every other character - punctuation, symbols, emoji, white space - separates words.  Which
characters are which goes by blocks: those of SEPARATE and ALONE below, all others beyond ASCII are
letters.  In SQL: ``regexp_extract_all(lower(text), WORD_SQL)``.

All kernels work on whole texts.  They take a few hundred kilobytes at a time only so that the
arrays stay in the processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points beyond ASCII that aren't part of words, by first and last.
SEPARATE = (
    (0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7),
    (0x55A, 0x55F), (0x589, 0x58A), (0x5BE, 0x5BE), (0x5C0, 0x5C0), (0x5C3, 0x5C3), (0x60C, 0x60C), (0x61B, 0x61F), (0x6D4, 0x6D4), (0x964, 0x965),
    (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x245F), (0x2500, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F),
    (0xE000, 0xF8FF), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFFF), (0x1F000, 0x1FAFF),
)
#: Code points that are a word each.
ALONE = (
    (0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x303C), (0x3040, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)


def _ranges(spans_: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans_)


WORD_SQL = f"[{_ranges(ALONE)}]|[^{_ranges(((0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))}{_ranges(SEPARATE)}{_ranges(ALONE)}]+"

#: By code point: 0 separates, 1 is part of a word, 2 is a word.
_CLASS = np.ones(0x110000, np.uint8)
_CLASS[:0x80] = 0
for _span in ("09", "AZ", "az"):
    _CLASS[ord(_span[0]) : ord(_span[1]) + 1] = 1
for _a, _b in SEPARATE:
    _CLASS[_a : _b + 1] = 0
for _a, _b in ALONE:
    _CLASS[_a : _b + 1] = 2
_ASCII = np.ones(256, np.uint8)
_ASCII[:0x80] = _CLASS[:0x80]

_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n places."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)

        def run(b: int) -> np.ndarray:
            out = np.full(size, b, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        fresh = run(_BASE), run(inverse)
        if size > 1 << 23:  # one enormous text: don't keep its tables
            return fresh
        _POW, _INV = fresh
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    size = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def pieces(offsets: np.ndarray, limit: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte's character, and where the characters are that are words of their own."""
    kind = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return kind, lead
    b = np.concatenate([data, np.zeros(3, np.uint8)])
    size = 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0)
    at = [(b[lead + i] & 0x3F).astype(np.int32) for i in range(4)]
    point = np.where(size == 2, (at[0] & 0x1F) << 6 | at[1], np.where(size == 3, (at[0] & 0x0F) << 12 | at[1] << 6 | at[2], (at[0] & 0x07) << 18 | at[1] << 12 | at[2] << 6 | at[3]))
    of = _CLASS[np.minimum(point, 0x10FFFF)]
    odd = np.flatnonzero(of != 1)
    for i in range(4):
        place = odd[size[odd] > i]
        kind[np.minimum(lead[place] + i, len(data) - 1)] = of[place]
    return kind, lead[odd][of[odd] == 2]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of its first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind, alone = _classes(data)
    inside = kind > 0
    fresh = np.empty(n, bool)  # a word begins here, if any does
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh[alone] = True
    fresh[offsets[(offsets > 0) & (offsets < n)]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = fresh[1:]
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * powers[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and where each text's runs begin.

    With `short`, a text of 1 to k-1 words has one run, made of all its words; else it has none.
    """
    n = len(words)
    count = np.diff(first)
    end = np.repeat(first[1:], count)
    at = np.arange(n)
    keep = at + k <= end
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= _SHINGLE
        acc[: max(n - j, 0)] += words[j:]
    if short:
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            head = first[few]
            value = np.full(len(few), 7, np.uint64)
            for j in range(k - 1):
                more = j < count[few]
                value[more] = value[more] * _SHINGLE + words[head[more] + j]
            acc[head] = value
            keep[head] = True
    runs = np.where(count >= k, count - k + 1, (count > 0) & short)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=begin[1:])
    return mix(acc[keep]), begin


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blobs(of: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each value of `of`, with what belongs to it of each column, as bytes."""
    order = np.argsort(of.astype(np.uint16) if len(of) and of.max() < 1 << 16 else of, kind="stable")
    of = of[order]
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    edge = np.append(begin, len(of))
    packed = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((edge * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])]) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(of[begin].astype(np.int64)), *packed], names=names)


def flat(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    """The values of all rows of a column of blobs()."""
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)
