"""Benchmark decontamination by a broadcast hash set of normalised test windows.

Texts and items are lower-cased (A-Z) and cut into words of ASCII letters, digits
and everything beyond ASCII. An item's windows are its runs of ``window`` words; a
shorter item is one window of all its words. Every window of every text is hashed,
looked up, and a hit is verified word by word before its words count as hit.

The set is broadcast in blocks of at most ``block`` windows: its size is counted
first, and a larger benchmark costs more passes, not more memory. One block is one narrow
pass that carries the rows along; with more, each pass writes only the rows with hits,
named by id and text hash, and texts stay where they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from blocklens.llm.common import as_long, blocks, materialize, null_safe_eq, part_bytes, pick, scratch, with_columns
from blocklens.llm.wordhash import Words, fold_ascii, join_hash, scan, word_class

BLOCK_WINDOWS = 200_000
FILTER_BITS = 22


def windows_of(words: Words, row: int, window: int) -> Iterator[tuple[int, int]]:
    """(first word, length) of an item's windows."""
    a, b = int(words.first[row]), int(words.first[row + 1])
    if b - a >= window:
        yield from ((i, window) for i in range(a, b - window + 1))
    elif b > a:
        yield a, b - a


def window_text(data: np.ndarray, words: Words, at: int, size: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[at : at + size].tolist(), words.ends[at : at + size].tolist(), strict=True))


def benchmark_windows(bench: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``(item, size, hash, words)``, once for each item and window. Null items and texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, fold = word_class("alnum"), fold_ascii()
        for batch in batches:
            items = batch.column("item").to_pylist()
            out: dict[tuple[str, bytes], tuple[int, int]] = {}
            for lo, hi, data, offsets in blocks(*part_bytes(batch.column("text"))):
                words, data = scan(data, offsets, inside), fold[data]
                for row in range(hi - lo):
                    for at, size in windows_of(words, row, window):
                        h = join_hash(words.hashes[at : at + size], size)
                        out[items[lo + row], window_text(data, words, at, size)] = (size, int(as_long(h)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([v[0] for v in out.values()], pa.int32()), pa.array([v[1] for v in out.values()], pa.int64()), pa.array([k[1] for k in out], pa.binary())], ["item", "size", "hash", "words"])

    named = pick(bench, item=item_col, text=text_col).select(F.col("item").cast("string").alias("item"), "text").filter("item IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(run, "item string, size int, hash long, words binary").distinct()


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


MADE = [StructField("__n_words", LongType()), StructField("__spans", ArrayType(LongType())), StructField("__items", ArrayType(StringType()))]


def find_hits(rows: DataFrame, windows: list, text_col: str) -> DataFrame:
    """``rows`` and, for one block of windows, ``__n_words, __spans, __items`` of each."""
    known: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
    hashes: dict[int, list[int]] = defaultdict(list)
    for item, size, h, words in windows:
        known[size].setdefault(bytes(words), []).append(item)
        hashes[size].append(h)
    sets = {}
    for size, hs in hashes.items():
        held = np.unique(np.array(hs, np.int64).view(np.uint64))
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(held >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        sets[size] = (held, np.packbits(seen))
    shared = rows.sparkSession.sparkContext.broadcast((sets, dict(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = word_class("alnum")
        sets, known = shared.value
        filters = {size: np.unpackbits(bits).view(bool) for size, (_, bits) in sets.items()}
        for batch in batches:
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            n_words = np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in blocks(*part_bytes(batch.column(text_col))):
                words = scan(data, offsets, inside)
                n_words[lo:hi] = np.diff(words.first)
                for size, (held, _) in sets.items():
                    h = join_hash(words.hashes, size)
                    at = np.flatnonzero(filters[size][h >> np.uint64(64 - FILTER_BITS)])
                    at = at[words.rows[at] == words.rows[at + size - 1]]
                    place = np.minimum(np.searchsorted(held, h[at]), len(held) - 1)
                    for i in at[held[place] == h[at]].tolist():
                        found = known[size].get(window_text(words.data, words, i, size))
                        if found:
                            row = int(words.rows[i])
                            first = int(words.first[row])
                            spans[lo + row].append((i - first, i - first + size))
                            items[lo + row].update(found)
            flat = [[x for s in union_spans(spans[r]) for x in s] if r in spans else [] for r in range(batch.num_rows)]
            listed = [sorted(items[r]) if r in items else [] for r in range(batch.num_rows)]
            yield with_columns(batch, {"__n_words": pa.array(n_words), "__spans": pa.array(flat, pa.list_(pa.int64())), "__items": pa.array(listed, pa.list_(pa.string()))})

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *MADE]))


def merged_hits(hits: DataFrame) -> DataFrame:
    """The hits of several passes, one row per row name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[x for s in union_spans([p for one in many for p in zip(one[::2], one[1::2], strict=True)]) for x in s] for many in batch.column("__spans").to_pylist()]
            items = [sorted({x for one in many for x in one}) for many in batch.column("__items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("of_id"), batch.column("of_th"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["of_id", "of_th", "found_spans", "found_items"])

    lists = hits.groupBy("of_id", "of_th").agg(F.collect_list("__spans").alias("__spans"), F.collect_list("__items").alias("__items"))
    return lists.mapInArrow(run, f"of_id {hits.schema['of_id'].dataType.simpleString()}, of_th long, found_spans array<long>, found_items array<string>")


def rows_with_hits(docs: DataFrame, bench: DataFrame, *, window: int = 10, block: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in all their columns, and ``__n_words, __spans, __items``.

    ``__spans`` lists the hit words as flat, disjoint ``[from, to)`` word numbers, and
    ``__items`` the ids (as sorted strings) of items that have a window in the text. A
    null or wordless text has 0 words and no hit; repeated rows, rows that share an id and
    null ids are answered row by row; with an empty benchmark nothing is hit; an empty
    table gives an empty result.
    """
    with scratch(docs.sparkSession):
        kept = materialize(benchmark_windows(bench, window, item_col, item_text_col), "windows")
        passes = max(1, -(-kept.count() // block))

        def part(i: int) -> list[tuple]:
            of = kept.filter(F.pmod(F.xxhash64("words", "item"), F.lit(passes)) == i)
            return [tuple(r) for r in of.select("item", "size", "hash", "words").collect()]

        if passes == 1:
            return find_hits(docs, part(0), text_col)
        named, hits = pick(docs, of_id=id_col, text=text_col).withColumn("of_th", F.xxhash64("text")), None
        for i in range(passes):
            found = materialize(find_hits(named, part(i), "text").filter(F.size("__items") > 0).select("of_id", "of_th", "__spans", "__items").distinct(), "hits")
            hits = found if hits is None else hits.unionByName(found)
        hits = materialize(merged_hits(hits), "hits", keep=True)
    counted = find_hits(docs, [], text_col).drop("__spans", "__items").withColumn("__th", F.xxhash64(F.col(f"`{text_col}`")))
    both = counted.join(hits, null_safe_eq(counted[f"`{id_col}`"], hits["of_id"]) & (counted["__th"] == hits["of_th"]), "left")
    none = F.array()
    return both.select(*(F.col(f"`{c}`") for c in docs.columns), "__n_words", F.coalesce("found_spans", none.cast("array<long>")).alias("__spans"), F.coalesce("found_items", none.cast("array<string>")).alias("__items"))


def contamination(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """Per row of ``docs``: ``id, n_words, spans, items`` (and ``text``), as ``rows_with_hits`` finds them; other columns are ignored."""
    found = rows_with_hits(pick(docs, id=id_col, text=text_col), bench, id_col="id", text_col="text", **options)
    return found.select("id", *(["text"] if keep_text else []), F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def hit_counts(found: DataFrame) -> DataFrame:
    """The digest of ``contamination``: hit words, and the items as one checksum."""
    hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_spans(found: DataFrame, margin: int = 0) -> DataFrame:
    """``(id, text)`` with the hit words (and ``margin`` words around) cut out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = word_class("alnum")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for row, flat in enumerate(batch.column("spans").to_pylist()):
                if not flat or texts[row] is None:
                    continue
                raw = texts[row].encode()
                words = scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), inside)
                out, at = [], 0
                for a, b in union_spans([(max(0, a - margin), min(len(words.starts), b + margin)) for a, b in zip(flat[::2], flat[1::2], strict=True)]):
                    out.append(raw[at : words.starts[a]])
                    at = int(words.ends[b - 1])
                texts[row] = b"".join([*out, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return found.select("id", "text", "spans").mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, text string")
