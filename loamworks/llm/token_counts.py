"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is put to the proof: is it one pre-token as it stands,
and does merging its bytes end in one token?  In a text, a pre-token among the proven strings
counts one without any merging; only the others are merged.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamworks.llm._text import column

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this kind cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a Python worker remembers; words beyond them are worked out each time they occur.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank."""
    lines = map(bytes.split, Path(path).read_bytes().splitlines())
    return {base64.b64decode(a): int(b) for a, b in lines}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Byte-pair merging: the neighbours of the lowest rank, the leftmost first, join until none can."""
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The same with a heap over a linked list, so that a pre-token of any length takes n log n."""
    import heapq

    n = len(parts)
    right, left, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = []

    def offer(i: int) -> None:
        if right[i] < n and (rank := ranks.get(parts[i] + parts[right[i]])) is not None:
            heap.append((rank, i, len(parts[i]), len(parts[right[i]])))

    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if gone[i] or right[i] >= n or len(parts[i]) != a or len(parts[right[i]]) != b:
            continue
        j = right[i]
        parts[i] += parts[j]
        gone[j], right[i] = True, right[j]
        if right[j] < n:
            left[right[j]] = i
        size = len(heap)
        for x in (left[i], i):
            if x >= 0:
                offer(x)
        fresh = heap[size:]
        del heap[size:]
        for entry in fresh:
            heapq.heappush(heap, entry)
    return [p for p, dead in zip(parts, gone, strict=True) if not dead]


def proven_whole_tokens(ranks: dict[bytes, int], pattern: str = PATTERN) -> frozenset[str]:
    """The strings of the vocabulary that are one pre-token and merge to one token.

    A token whose bytes are no valid UTF-8 is part of a character and can't be a pre-token.
    A token that the merges never reach as a whole fails the proof.
    """
    cut = regex.compile(pattern)
    found = set()
    for token in ranks:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if cut.fullmatch(text) and cut.findall(text) == [text] and merge(token, ranks) == [token]:
            found.add(text)
    return frozenset(found)


class SegmentMemo(dict):
    """Segment between two single spaces -> what `work` makes of it with its space in front.

    A space between two characters that aren't white space always begins a pre-token, so such
    segments can be worked on one by one.  A segment that is empty or has white space at an end
    touches a run of white space: it maps to None, and the text as a whole is then worked on.
    """

    def __init__(self, work, limit: int = REMEMBERED) -> None:
        super().__init__()
        self.work, self.limit = work, limit

    def __missing__(self, segment: str):
        value = None if not segment or segment[0].isspace() or segment[-1].isspace() else self.work(" " + segment)
        if len(self) < self.limit:
            self[segment] = value
        return value


class TokenCounter:
    """Counts tokens of whole texts; `whole` and `merged` say how pre-tokens were counted."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        self.ranks = load_ranks(path)
        self.cut = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.proven = proven_whole_tokens(self.ranks, pattern)
        self.memo = SegmentMemo(self.count_plain)

    def count_plain(self, text: str) -> int:
        proven, total = self.proven, 0
        for word in self.cut.findall(text):
            total += 1 if word in proven else self.merged(word)
        return total

    def merged(self, word: str) -> int:
        return len(self.bpe.encode_single_piece(word.encode()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        head, *tail = text.split(" ")
        if not head or head[0].isspace() or head[-1].isspace():
            return self.count_plain(text)
        try:
            return self.count_plain(head) + sum(map(self.memo.__getitem__, tail))
        except TypeError:  # a None: a run of white space
            return self.count_plain(text)


@functools.cache
def counter(path: str, pattern: str = PATTERN) -> TokenCounter:
    """One counter a Python worker."""
    return TokenCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) for every row of `docs`: a map without a shuffle.

    A null or empty text has 0 tokens. Repeated rows and null ids stay as they are; other
    columns are ignored. The vocabulary's path must exist on every executor.
    """
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = [count(x) for x in column(batch, "__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(run, out)
