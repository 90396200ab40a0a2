"""Token counts by byte-pair merging with a heap and a linked list.

A piece starts as one symbol per byte. A heap holds the adjacent pairs that have a
merge rank, lowest rank first and then leftmost; popping one joins its two symbols
in a linked list and offers the two new pairs. The piece's tokens are its initial
symbols minus its merges, so no identifier is ever made.

What the vocabulary file prescribes around the merges is followed; special strings
count as one token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import part_bytes, pick
from blocklens.llm.pretokens import byte_symbols, pre_tokens

CACHE_WORDS = 400_000
CACHE_PIECES = 400_000


class MergeTable:
    """Ranks and results of the merges of one vocabulary file, over small integers."""

    def __init__(self, path: str):
        self.before = before = pre_tokens(path)
        self.ids: dict[str, int] = {}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(before.spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.id(a), self.id(b)), (rank, self.id(a + b)))
        symbols = byte_symbols()
        self.inner = [self.id(s) for s in symbols]
        self.last = [self.id(s + before.suffix) for s in symbols]

    def id(self, symbol: str) -> int:
        return self.ids.setdefault(symbol, len(self.ids))

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n = len(piece)
        if n < 2:
            return n
        merges = self.merges
        symbol = [self.inner[b] for b in piece[:-1]]
        symbol.append(self.last[piece[-1]])
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        heap = []
        for i in range(n - 1):
            m = merges.get((symbol[i], symbol[i + 1]))
            if m:
                heap.append((m[0], i, m[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = right[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = made, -1
            k = right[j]
            right[i] = k
            done += 1
            if k >= 0:
                left[k] = i
                if m := merges.get((made, symbol[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, symbol[k]))
            h = left[i]
            if h >= 0 and (m := merges.get((symbol[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], symbol[h], made))
        return n - done


@cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class PieceCounts(dict):
    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = n = self.table.count(piece.encode("utf-8", "surrogateescape"))
        return n


class WordCounts(dict):
    """Token counts of words between ASCII white space; a bounded memory.

    No piece and no special string holds white space, so a text's count is the sum
    over its words.
    """

    def __init__(self, path: str):
        super().__init__()
        self.table = merge_table(path)
        self.piece = PieceCounts(self.table)

    def plain(self, text: str) -> int:
        return sum(map(self.piece.__getitem__, self.table.before.pieces(text)))

    def __missing__(self, word: bytes) -> int:
        text, special = word.decode("utf-8", "replace"), self.table.before.special
        if special and special.search(text):
            parts = special.split(text)
            n = len(parts) - 1 + sum(map(self.plain, parts))
        else:
            n = self.plain(text)
        self[word] = n
        return n

    def text(self, raw: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        return sum(map(self.__getitem__, raw.split()))


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Whole texts, without begin, end or added tokens. A null or empty text has 0 bytes
    and 0 tokens; repeated rows and null ids are answered row by row; an empty table
    gives an empty result; other columns are ignored. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCounts(vocabulary)
        for batch in batches:
            data, offsets = part_bytes(batch.column("text"))
            raw, cuts = memoryview(data), offsets.tolist()
            n = [words.text(bytes(raw[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = pick(docs, id=id_col, text=text_col)
    counted = rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
