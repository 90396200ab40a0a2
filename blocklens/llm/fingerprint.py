"""Quartile bucket digests of documents.

Every window of four bytes gives three byte triplets; a triplet's hash picks one of
128 buckets. A digest is, in hex: the version, the length on a logarithmic scale,
the ratios of the first and second quartile of the bucket counts to the third, and
two bits per bucket saying in which quartile its count lies.

Digests are compared by a difference score: header differences and bucket
distances add up to at most ``BOUND``; likeness is one minus their share of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.llm.common import blocks, materialize, part_bytes, pick, pieces_for

VERSION = "1"
BUCKETS = 128
BOUND = 256
#: Bytes of texts that are counted at once.
PIECE = 1 << 19
#: Offsets of a triplet's second and third byte.
SHAPES = ((1, 2), (1, 3), (2, 3))
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@cache
def byte_tables() -> np.ndarray:
    """For each shape and place in it, a random code of every byte."""
    return np.random.default_rng(411).integers(0, BUCKETS, (len(SHAPES), 3, 256)).astype(np.uint8)


def long_counts(data: np.ndarray, piece: int) -> np.ndarray:
    """Bucket counts of one text, read in pieces; each window counts where it begins."""
    counts = np.zeros(BUCKETS, np.int64)
    for (second, third), (a, b, c) in zip(SHAPES, byte_tables(), strict=True):
        for lo in range(0, len(data) - third, piece):
            hi = min(lo + piece, len(data) - third)
            counts += np.bincount(a[data[lo:hi]] ^ b[data[lo + second : hi + second]] ^ c[data[lo + third : hi + third]], minlength=BUCKETS)
    return counts[None]


def bucket_counts(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> np.ndarray:
    rows = len(offsets) - 1
    if rows == 1 and len(data) > piece:
        return long_counts(data, piece)
    counts = np.zeros(rows * BUCKETS, np.int64)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets)) * BUCKETS
    for (second, third), (a, b, c) in zip(SHAPES, byte_tables(), strict=True):
        n = len(data) - third
        if n <= 0:
            continue
        bucket = a[data[:n]] ^ b[data[second : second + n]] ^ c[data[third : third + n]]
        whole = row[:n] == row[third:]
        counts += np.bincount((row[:n] + bucket)[whole], minlength=len(counts))
    return counts.reshape(rows, BUCKETS)


def length_code(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(np.log(np.maximum(sizes, 1)) / np.log(1.1))).astype(np.uint8)


def codes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of small integers per text: length, two ratios, a quartile per bucket."""
    out = []
    for _, _, part, off in blocks(data, offsets, PIECE):
        counts = bucket_counts(part, off)
        q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        codes = np.zeros((len(counts), 3 + BUCKETS), np.uint8)
        codes[:, 0] = length_code(np.diff(off))
        codes[:, 1:3] = q[:, :2] * 15 // np.maximum(q[:, 2:], 1)
        codes[:, 3:] = (counts[:, :, None] > q[:, None, :]).sum(axis=2)
        out.append(codes)
    return np.concatenate(out) if out else np.zeros((0, 3 + BUCKETS), np.uint8)


def digest(code: np.ndarray) -> str:
    b = code[3:].reshape(-1, 4)
    body = b[:, 0] << 6 | b[:, 1] << 4 | b[:, 2] << 2 | b[:, 3]
    return f"{VERSION}{int(code[0]):02x}{int(code[1]):x}{int(code[2]):x}{body.tobytes().hex()}"


def parse(fingerprint: str) -> np.ndarray:
    if fingerprint[:1] != VERSION or len(fingerprint) != 5 + BUCKETS // 2:
        raise ValueError("not a digest of this version")
    body = np.frombuffer(bytes.fromhex(fingerprint[5:]), np.uint8)
    head = [int(fingerprint[1:3], 16), int(fingerprint[3], 16), int(fingerprint[4], 16)]
    return np.concatenate((np.array(head, np.uint8), np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=1).ravel()))


def difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounded difference scores of rows of codes."""
    gap = np.abs(x.astype(np.int64) - y.astype(np.int64))
    length = np.where(gap[:, 0] <= 1, 0, np.minimum(gap[:, 0], 48))
    ratios = np.minimum(gap[:, 1:3], 6).sum(axis=1)
    body = np.where(gap[:, 3:] == 3, 6, gap[:, 3:]).sum(axis=1)
    return np.minimum(length + ratios + body, BOUND)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1.0 - difference(x, y) / BOUND


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def compared(ids: list, texts: list[str], codes: np.ndarray, following: list[str], next_codes: np.ndarray) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    edited_codes = codes_of(*joined(edited))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(list(map(digest, codes)), pa.string()),
            pa.array(list(map(digest, edited_codes)), pa.string()),
            pa.array(likeness(codes, edited_codes)),
            pa.array(likeness(codes, next_codes)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its half-edited text and the next document by falling id.

    The rows are dealt once into ranges of ids and, within an id, of text hashes. Within a
    range the next row follows in the stream; each range also hands over its first and
    last row, and ranges are matched up by their numbers, which are in the ids' order.
    The last document's next is the first; a single one's is itself. Null texts are
    empty; null ids come last; repeated ids are ordered by a hash of the text, then the
    text. An empty table gives an empty result; other columns are ignored.
    """
    edge = "part int, first_text string, last_id long, last_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, last_codes = TaskContext.get().partitionId(), None, None, None
        edges = pa.schema([("part", pa.int32()), ("first_text", pa.string()), ("last_id", pa.int64()), ("last_text", pa.string())])

        def widened(made: pa.RecordBatch) -> pa.RecordBatch:
            none = [pa.nulls(made.num_rows, f.type) for f in edges]
            return pa.RecordBatch.from_arrays([*made.columns, *none], [*made.schema.names, *edges.names])

        for batch in batches:
            ids = batch.column("id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if not ids:
                continue
            codes = codes_of(*part_bytes(batch.column("text")))
            first = texts[0] if first is None else first
            if last is not None:
                ids, texts, codes = [last[0], *ids], [last[1], *texts], np.concatenate((last_codes, codes))
            last, last_codes = (ids[-1], texts[-1]), codes[-1:]
            if len(ids) > 1:
                yield widened(compared(ids[:-1], texts[:-1], codes[:-1], texts[1:], codes[1:]))
        if last is not None:
            empty = compared([], [], np.zeros((0, 3 + BUCKETS), np.uint8), [], np.zeros((0, 3 + BUCKETS), np.uint8))
            values = [part, first, *last]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in empty.columns), *(pa.array([v], f.type) for v, f in zip(values, edges, strict=True))], [*empty.schema.names, *edges.names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(c).to_pylist() for c in ("last_id", "last_text", "next_text"))
            if ids:
                yield compared(ids, texts, codes_of(*joined(texts)), following, codes_of(*joined(following)))

    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    falling = F.col("id").desc_nulls_last()
    order = falling, F.col("th")
    rows = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(pieces_for(docs, each=1 << 26, least=0), *order).sortWithinPartitions(*order, "text")
    made = materialize(rows.drop("th").mapInArrow(run, f"{OUT}, {edge}"), "digests")
    # One short row per range is ordered; texts are joined to it by the ranges' numbers.
    edges = made.filter("part IS NOT NULL")
    along = W.orderBy("part")
    following = F.coalesce(F.lead("part").over(along), F.first("part").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    pairs = edges.select("part").select("part", following.alias("next"))
    firsts = edges.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    met = edges.select("part", "last_id", "last_text").join(pairs, "part").join(firsts, "next").select("last_id", "last_text", "next_text")
    return made.filter("part IS NULL").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").unionByName(met.mapInArrow(meet, OUT))
