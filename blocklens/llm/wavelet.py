"""Token identifiers kept as wavelet matrices, one compressed file image per shard.

A shard holds the identifiers of a run of documents in ascending id order. Its
file image is self-contained::

    magic "BLWM2\\0" | header (little-endian) | directories | document table | bit-planes

    header       n_docs u64, n_tokens u64, width u32, bytes of a block u32, length of the table u64
    directories  per plane, for each block and the end: where it begins u64, ones before it u64
    table        zstd of: ids i64[n_docs], id-is-null u8[n_docs], first token u64[n_docs + 1]
    plane        the packed bits of one level, most significant first, in blocks; each is
                 zstd, or plain where that is no longer

Level ``w`` holds one bit of every token, in the order that stably sorting by the
bits before it leaves them in. ``access``, ``rank``, ``count``, ``select`` and
``occurrences`` read the stored ranks and unpack only the blocks that they touch.

The images are the ``image`` column of a Parquet table in the shared folder,
because executors may lose their own disks and the store may be one that only
Spark can write to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.llm.common import blocks, new_path, part_bytes, pick, pieces_for
from blocklens.llm.wordhash import STEP, fold_ascii, same_spans, scan, word_class

MAGIC = b"BLWM2\0"
HEAD = struct.Struct("<QQIIQ")
#: Bytes of a plane that are packed together, and unpacked blocks that a plane remembers.
BLOCK = 4096
HELD_BLOCKS = 64
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 400_000
#: New words that go to the library as one text.
TOGETHER = 1000
WORD_END = "</w>"
BATCH_BYTES = 1 << 22
SHARD_SCHEMA = "part int, seq long, first_id long, n_docs long, n_tokens long, image binary"


class Plane:
    """One level's bits: blocks that are unpacked when they are touched, with ranks beside them."""

    def __init__(self, n: int, begins: np.ndarray, ranks: np.ndarray, packed: memoryview, block: int):
        self.n, self.begins, self.ranks, self.packed, self.block = n, begins, ranks, packed, block
        self.zeros = n - int(ranks[-1])
        self.held: dict[int, np.ndarray] = {}

    def bytes(self, b: int) -> np.ndarray:
        found = self.held.get(b)
        if found is None:
            raw = self.packed[int(self.begins[b]) : int(self.begins[b + 1])]
            size = min(self.block, (self.n + 7) // 8 - b * self.block)
            found = np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, size), np.uint8)
            if len(self.held) >= HELD_BLOCKS:
                self.held.clear()
            self.held[b] = found
        return found

    def bits(self) -> np.ndarray:
        """All bits, as booleans; nothing is remembered."""
        unpack = zstandard.ZstdDecompressor().decompress
        out = np.empty((self.n + 7) // 8, np.uint8)
        for b in range(len(self.begins) - 1):
            raw, at = self.packed[int(self.begins[b]) : int(self.begins[b + 1])], b * self.block
            size = min(self.block, len(out) - at)
            out[at : at + size] = np.frombuffer(raw if len(raw) == size else unpack(raw, size), np.uint8)
        return np.unpackbits(out, count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        b, at = divmod(i // 8, self.block)
        return int(self.bytes(b)[at]) >> (i % 8) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        b, at = divmod(i // 8, self.block)
        count = int(self.ranks[b])
        if at or i % 8:
            own = self.bytes(b)
            count += int(np.bitwise_count(own[:at]).sum())
            if i % 8:
                count += (int(own[at]) & ((1 << i % 8) - 1)).bit_count()
        return count

    def select(self, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit: its block by the ranks, then within it."""
        per = 8 * self.block
        before = self.ranks if bit else np.minimum(np.arange(len(self.ranks)) * per, self.n) - self.ranks
        b = int(np.searchsorted(before, j, "right")) - 1
        own = np.unpackbits(self.bytes(b), count=min(per, self.n - b * per), bitorder="little")
        return b * per + int(np.flatnonzero(own == bit)[j - int(before[b])])


def packed_plane(bits: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where each block of a plane begins, the ones before it, and the packed blocks."""
    raw = np.packbits(bits, bitorder="little")
    count, pack = -(-len(raw) // block), zstandard.ZstdCompressor(level=1).compress
    blocks_, ones = [], np.zeros(count + 1, np.int64)
    for b in range(count):
        plain = raw[b * block : (b + 1) * block]
        small = pack(plain)
        blocks_.append(small if len(small) < len(plain) else plain.tobytes())
        ones[b + 1] = ones[b] + int(np.bitwise_count(plain).sum())
    return np.cumsum([0, *map(len, blocks_)]), ones, b"".join(blocks_)


class WaveletMatrix:
    """Rank and select over a sequence of unsigned integers, by its bit-planes."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes, self.width = n, planes, len(planes)

    def values(self) -> np.ndarray:
        """All values in order: the sorts undone from the last level up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        y = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            bit, z = self.planes[level].bits(), self.planes[level].zeros
            x = np.empty(self.n, kind)
            x[np.flatnonzero(~bit)] = y[:z]
            x[np.flatnonzero(bit)] = y[z:] | kind(1 << (self.width - 1 - level))
            y = x
        return y

    def _step(self, level: int, bit: int, i: int) -> int:
        ones = self.planes[level].rank1(i)
        return self.planes[level].zeros + ones if bit else i - ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = plane.bit(i)
            value, i = value << 1 | bit, self._step(level, bit, i)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.width):
            bit = value >> (self.width - 1 - level) & 1
            lo, hi = self._step(level, bit, lo), self._step(level, bit, hi)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` is among the first ``i``."""
        if value >> self.width:
            return 0
        lo, hi = self._range(value, min(max(i, 0), self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence."""
        lo, hi = (0, 0) if value >> self.width else self._range(value, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        at = lo + j
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            at = self.planes[level].select(bit, at - self.planes[level].zeros if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]


def pack_shard(ids: np.ndarray, null: np.ndarray, first: np.ndarray, values: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    table = zstandard.ZstdCompressor(level=1).compress(ids.astype("<i8").tobytes() + null.astype("u1").tobytes() + first.astype("<u8").tobytes())
    directories, planes, x = [], [], values
    for shift in range(width - 1, -1, -1):
        bit = (x & x.dtype.type(1 << shift)) != 0
        begins, ones, packed = packed_plane(bit, block)
        directories += [begins.astype("<u8").tobytes(), ones.astype("<u8").tobytes()]
        planes.append(packed)
        x = x.take(np.concatenate((np.flatnonzero(~bit), np.flatnonzero(bit))))
    return b"".join((MAGIC, HEAD.pack(len(ids), len(values), width, block, len(table)), *directories, table, *planes))


def open_shard(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, first token of each (and the end), and the matrix; no plane is unpacked."""
    if image[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    docs, tokens, width, block, size = HEAD.unpack_from(image, len(MAGIC))
    at, count = len(MAGIC) + HEAD.size, -(-(-(-tokens // 8)) // block) + 1
    directory = np.frombuffer(image, "<u8", 2 * width * count, at).reshape(width, 2, count).astype(np.int64)
    at += 16 * width * count
    table = zstandard.ZstdDecompressor().decompress(image[at : at + size])
    ids = np.frombuffer(table, "<i8", docs)
    null = np.frombuffer(table, "u1", docs, 8 * docs)
    first = np.frombuffer(table[9 * docs :], "<u8", docs + 1).astype(np.int64)
    at += size
    planes, whole = [], memoryview(image)
    for begins, ones in directory:
        planes.append(Plane(tokens, begins, ones, whole[at : at + int(begins[-1])], block))
        at += int(begins[-1])
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], first, WaveletMatrix(tokens, planes)


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def sign_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(b".,!?;:|%$&*#\"()-=+/")] = True
    return table


def tails(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where signs begin that follow an ASCII letter or digit and end a word."""
    sign = sign_table()[data]
    after = word_class("alnum")[data] & (data < 0x80)
    begins = np.flatnonzero(sign[1:] & after[:-1]) + 1
    last = np.flatnonzero(sign & ~np.append(sign[1:], False)) + 1
    ends = last[np.searchsorted(last, begins, "right")]
    return begins[(ends == len(data)) | ~inside[data[np.minimum(ends, len(data) - 1)]]]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each different hash is, and which of these each hash equals."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


class WordIds:
    """Identifiers of whole texts by the library, each different word encoded once.

    This tokenizer never joins anything over white space and lower-cases A-Z, so a
    text's identifiers are those of its words. A hash groups a run's equal words, which is
    checked byte by byte; the memory goes by the words themselves. Signs at a
    word's end are a piece of their own and count as a word. Words not met yet go to the library together, parted by a special string whose identifier
    marks the cuts; runs of rows that hold a special string themselves are encoded
    text by text. The memory holds a bounded number of words.
    """

    def __init__(self, path: str, kind: type):
        self.library, self.kind = tokenizer(path), kind
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content.encode().lower() for t in added.values()]
        self.cut = next(((i, t.content) for i, t in added.items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.inside = word_class("space")
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max([*vocabulary.values(), *added, 0]) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str], sign: str = "", mark: tuple[int, ...] = ()) -> np.ndarray:
        """Identifiers of words with ``sign`` between them, whose identifiers are ``mark``.

        They go to the library in texts of ``TOGETHER`` words, which costs it less than one long text.
        """
        texts = [f" {sign} ".join(words[i : i + TOGETHER]) if sign else " ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        out: list[int] = []
        for n, ids in enumerate(self.encode(texts)):
            out.extend((*mark, *ids) if n else ids)
        return np.array(out, np.int64)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of words in turn, and how many each has."""
        if self.cut:
            found = self.joined(words, self.cut[1], self.cut[:1])
            marks = np.flatnonzero(found == self.cut[0])
            return np.delete(found, marks), np.diff(np.concatenate(([-1], marks, [len(found)]))) - 1
        each = self.encode(words)
        return np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64)

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Places of new words in the memory.

        A word of letters alone is one piece, whose last token the vocabulary marks:
        such words need only a space between them.
        """
        # No word holds a space.
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        out = np.zeros(len(words), np.int64)
        for kind in (True, False):
            some = np.flatnonzero(letters == kind)
            if not len(some):
                continue
            own = [texts[i] for i in some.tolist()]
            found = sizes = None
            if kind:
                found = self.joined(own)
                ends = np.flatnonzero(self.ends[found])
                sizes = np.diff(ends, prepend=-1) if len(ends) == len(own) else None
            if sizes is None:
                found, sizes = self.encoded(own)
            out[some] = len(self.sizes) + np.arange(len(own))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, found.astype(self.kind)))
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers of a run of rows, and where each row's begin."""
        lower = fold_ascii()[data].tobytes()
        if any(s in lower for s in self.special):
            raw, cuts = data.tobytes(), offsets.tolist()
            each = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            return np.array([i for e in each for i in e], self.kind), np.cumsum([0, *map(len, each)])
        words = scan(data, offsets, self.inside, breaks=tails(data, self.inside))
        where, inverse = distinct(words.hashes)
        length, first = words.ends - words.starts, where[inverse]
        # Words of one length and at most eight bytes never share a hash.
        long = np.flatnonzero(length > STEP)
        if not np.array_equal(length, length[first]) or not same_spans(words.data, words.starts[long], length[long], words.starts[first[long]], length[first[long]]):
            # Two words share a hash: every one is a word of its own.
            where = inverse = np.arange(len(length))
        if len(self.at) > CACHE_WORDS:
            self.forget()
        listed = [lower[a:b] for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)]
        place = np.fromiter(map(self.at.get, listed, repeat(-1)), np.int64, len(listed))
        at = np.flatnonzero(place < 0)
        if len(at):
            new = [listed[i] for i in at.tolist()]
            if len(where) == len(length):
                # Every word was a word of its own: some may be equal.
                new = list(dict.fromkeys(new))
                self.at.update(zip(new, self.learn(new).tolist(), strict=True))
                place = np.fromiter(map(self.at.get, listed), np.int64, len(listed))
            else:
                place[at] = self.learn(new)
                self.at.update(zip(new, place[at].tolist(), strict=True))
        chosen = place[inverse]
        sizes = self.sizes[chosen]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(ends[-1]) + np.repeat(self.starts[chosen] - ends[:-1], sizes)
        return self.flat[take], ends[words.first]


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write the shards of ascending ids as a table at ``path``.

    A null text is empty and still gets the end id. Null ids come first; repeated
    ids are ordered by a hash of the text, then the text. A shard closes after ``shard_tokens`` tokens, always at
    a document's end, so that a longer document makes a longer shard.
    """
    parts = pieces_for(docs, each=1 << 26, least=0)
    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, (max(tokenizer(vocabulary).get_vocab_size(), end_id + 1) - 1).bit_length())
        kind = np.uint16 if width <= 16 else np.uint32
        words, end = WordIds(vocabulary, kind), np.array([end_id], kind).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), kind)
            first = np.cumsum([0, *(len(h) // kind().itemsize for h in held)])
            image = pack_shard(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), first, values, width)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "first_id": ids[0], "n_docs": len(ids), "n_tokens": len(values), "image": image}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())]))

        for batch in batches:
            keys = batch.column("id").to_pylist()
            for lo, hi, data, offsets in blocks(*part_bytes(batch.column("text")), BATCH_BYTES):
                tokens, first = words.rows(data, offsets)
                cuts = first.tolist()
                for i, begin, stop in zip(keys[lo:hi], cuts[:-1], cuts[1:], strict=True):
                    ids.append(i)
                    held.append(tokens[begin:stop].tobytes() + end)
                    size += len(held[-1])
                    if size >= shard_tokens * kind().itemsize:
                        yield close()
                        ids, held, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    order = F.col("id").asc_nulls_first(), F.col("th")
    ordered = docs.withColumn("th", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    ordered.drop("th").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``(part, seq, base)``: tokens in all shards before. One row per part is ordered globally."""
    sizes = shards.select("part", "seq", "first_id", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min_by("first_id", "seq").alias("first_id"))
    before = W.orderBy(F.col("first_id").asc_nulls_first(), "part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return sizes.join(parts, "part").select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("base"))


def token_rows(shards: DataFrame) -> DataFrame:
    """Per document, read off the shards: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image")), strict=True):
                ids, first, matrix = open_shard(image)
                raw, cuts = memoryview(matrix.values().astype("<u4")).cast("B"), (first * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "image").mapInArrow(run, "part int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, vocabulary: str, tag: str = "tokens", **options) -> DataFrame:
    """Write the shards to the shared folder, then read every document off them."""
    path = new_path(docs.sparkSession, tag)
    write_token_shards(docs, path, vocabulary, **options)
    return token_rows(read_token_shards(docs.sparkSession, path))
