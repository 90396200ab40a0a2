"""N-gram Jaccard join by vertical partitioning.

Word shingles have one global order, their hash. It is cut into contiguous
fragments; a row's shingles fall apart into one segment per fragment, and each
fragment is worked on by itself.

1. Rows with equal shingle sets form a class, named by its least id.
2. Two classes with ``den * |x & y| >= num * |x | y|`` share at least ``l`` of the
   first ``n - ceil(n * num / den) + l`` shingles of both, for any ``l``. Fragments
   count, per class, how many shingles of that prefix another class also has; the
   counts are summed and classes that fall short of ``l`` can have no link.
3. The classes that remain get exact shingle frequencies. A shingle that no other
   class has can't be in an intersection, so rare-first order puts it at the start
   of the prefix, where it uses the prefix up without making any candidate.
4. Candidates are verified by vertical partial overlaps: the sizes of the
   intersections of the segments of each fragment, summed per pair.
5. Links are looked for twice. First each class meets the most central class of a
   posting list, which joins up groups of near copies without their pairs. Then
   every pair of classes that the prefix index brings together and that is not yet
   in one component is verified. What is left out is only pairs whose ends are
   already connected, so components are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import as_long, blocks, drop_table, materialize, part_bytes, pick, pieces_for, scratch
from blocklens.llm.components import linked_components
from blocklens.llm.wordhash import row_grams, scan, word_class

FLUSH = 1_000_000
#: Names of classes (24 bytes each) that are sent to the executors at most.
SEND_CLASSES = 1_000_000


def signature(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def grams_of(batch: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    inside = word_class("space")
    for _, _, data, offsets in blocks(*part_bytes(batch.column(column))):
        yield from row_grams(scan(data, offsets, inside), k)


def needed(n: int, num: int, den: int) -> int:
    """Least intersection that a set of ``n`` can have with one that it links to."""
    return -(-n * num // den)


def spare(n: int, num: int, den: int) -> int:
    """``l``: how many prefix shingles a link must share; grows with ``n``."""
    return max(1, n * (den - num) // den)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(id, n, sig)`` per row; ``sig`` is null for a row without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(grams_of(batch, "text", k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                ["id", "n", "sig"],
            )

    return docs.select("id", "text").mapInArrow(run, "id long, n long, sig binary")


def low64(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little")


def prefix_shares(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(sig64, shared)``: prefix shingles of a class that some other class has in its prefix.

    A map task sends each shingle at most once: one that two classes of the task have
    is counted there and sent without a class. So a shingle of a third of all rows
    costs its fragment one entry per task. Counts may be too high, never too low.
    """
    # The prefix is the low part of the hash order; fragments are equal ranges of it, as
    # many as the table's size asks for.
    fragments = pieces_for(docs)
    bound = min(1.0, 2.2 * (den - num) / den)
    main = fragments - fragments // 8

    def fragment_of(tokens: np.ndarray) -> np.ndarray:
        x = tokens.astype(np.float64) / 2.0**64
        low = (x / bound * main).astype(np.int64)
        high = main + ((x - bound) / max(1e-12, 1 - bound) * (fragments - main)).astype(np.int64)
        return np.minimum(np.where(x < bound, low, high), fragments - 1)

    def sorted_runs(tokens: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (token, class) entries by token; the first entry of each token."""
        order = np.lexsort((sigs, tokens))
        tokens, sigs = tokens[order], sigs[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])
        tokens, sigs = tokens[keep], sigs[keep]
        head = np.ones(len(tokens), bool)
        head[1:] = tokens[1:] != tokens[:-1]
        return tokens, sigs, np.flatnonzero(head)

    def counts(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(sigs, return_counts=True)

    def send(tokens: list[np.ndarray], sigs: list[np.ndarray], salt: int) -> pa.RecordBatch:
        t, s, heads = sorted_runs(np.concatenate(tokens), np.concatenate(sigs))
        sizes = np.diff(np.append(heads, len(t)))
        many = np.repeat(sizes > 1, sizes)
        who, times = counts(s[many])
        t, s = t[heads], np.where(sizes > 1, np.uint64(0), s[heads])
        cuts = np.searchsorted(fragment_of(t), np.arange(fragments + 1))
        rows = [(f, t[a:b].tobytes(), s[a:b].tobytes()) for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        if len(who):
            rows.append((-1 - salt % fragments, times.astype(np.uint64).tobytes(), who.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["fragment", "tokens", "sigs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sigs, held, salt = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for grams in grams_of(batch, "text", k):
                n = len(grams)
                if n:
                    head = grams[: n - needed(n, num, den) + spare(n, num, den)]
                    tokens.append(head)
                    sigs.append(np.full(len(head), low64(signature(grams)) | 1, np.uint64))
                    held += len(head)
                if held >= FLUSH:
                    yield send(tokens, sigs, salt)
                    tokens, sigs, held, salt = [], [], 0, salt + 7919
        if held:
            yield send(tokens, sigs, salt)

    def shares(table: pa.Table) -> pa.Table:
        joined = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("tokens", "sigs")]
        if table.column("fragment")[0].as_py() < 0:
            times, who = joined
        else:
            t, s, heads = sorted_runs(*joined)
            sizes = np.diff(np.append(heads, len(t)))
            shared = np.repeat((sizes > 1) | (s[heads] == 0), sizes) & (s != 0)
            who, times = counts(s[shared])
        return pa.table({"sig64": pa.array(as_long(who)), "shared": pa.array(times.astype(np.int64))})

    cut_up = docs.select("text").mapInArrow(cut, "fragment int, tokens binary, sigs binary")
    return cut_up.groupBy("fragment").applyInArrow(shares, "sig64 long, shared long").groupBy("sig64").agg(F.sum("shared").alias("shared"))


def class_grams(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``(cid, n, toks)`` of the classes ``(cid, sig, n)``, read off the row that names each.

    Up to ``SEND_CLASSES`` names are sent to where the texts are; more are joined.
    """
    classes = materialize(classes, "classes")
    few = classes.count() <= SEND_CLASSES
    names = sorted(tuple(r) for r in classes.select("cid", "sig").collect()) if few else []
    held = docs.sparkSession.sparkContext.broadcast((np.array([c for c, _ in names], np.int64), b"".join(bytes(s) for _, s in names)) if few else None)

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(grams_of(batch, "text", k))
        same = pa.array([len(s) > 0 and signature(s) == sig for s, sig in zip(sets, batch.column("sig").to_pylist(), strict=True)], pa.bool_())
        out = pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([as_long(s) for s in sets], pa.list_(pa.int64()))], ["cid", "n", "toks"])
        return out.filter(same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield grams(batch)

    def run_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, sigs = held.value
        for batch in batches:
            ids = batch.column("cid").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(cids, ids), max(0, len(cids) - 1))
            rows = np.flatnonzero(cids[at] == ids) if len(cids) else np.zeros(0, np.int64)
            if len(rows):
                found = pa.array([sigs[16 * i : 16 * i + 16] for i in at[rows].tolist()], pa.binary())
                yield grams(batch.take(pa.array(rows)).append_column("sig", found))

    schema, named = "cid long, n long, toks array<long>", docs.select(F.col("id").alias("cid"), "text")
    if few:
        return named.mapInArrow(run_held, schema)
    return named.join(classes.select("cid", "sig"), "cid").select("cid", "sig", "text").mapInArrow(run, schema)


def overlap_sums(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``(a, b, inter)``: partial overlaps of each fragment, summed per pair."""
    left = segments.select(F.col("cid").alias("a"), "fragment", F.col("seg").alias("sa"))
    right = segments.select(F.col("cid").alias("b"), "fragment", F.col("seg").alias("sb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("inter"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, class_id``.

    Rows link when ``den * |x & y| >= num * |x | y|`` over their sets of distinct
    ``k``-word shingles (A-Z lower-cased, words are runs of anything but space and
    bytes 9-13; fewer words than ``k`` are one shingle). Every row comes back:

    * null or wordless text: ``n_shingles`` 0, linked with nothing, its own component;
    * equal sets, repeated rows and repeated ids: one class, one row each;
    * null id: the row is compared with nothing and has null class and component;
    * an empty table gives an empty result; other columns are ignored.
    """
    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    sets = materialize(shingle_sets(docs, k), "sets")
    with scratch(docs.sparkSession):
        names = materialize(class_names(docs, sets, k, num, den), "names", keep=True)
    out = sets.join(names, "sig", "left")
    named = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(named, F.coalesce("component", "id")).alias("component_id"),
        F.when(named, F.coalesce("cid", "id")).alias("class_id"),
    )


def class_names(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(sig, cid, component)``: each class of ``sets``, its least id and its component."""
    classes = sets.filter("sig IS NOT NULL AND id IS NOT NULL").groupBy("sig").agg(F.min("id").alias("cid"), F.first("n").alias("n"))
    # Spare shingles that the smallest partner's shorter prefix still guarantees.
    least = F.greatest(F.lit(1), F.expr(f"(((n * {num} + {den - 1}) div {den}) * {den - num}) div {den}"))
    low = F.expr("cast(conv(concat(" + ", ".join(f"hex(substring(sig, {i}, 1))" for i in range(8, 0, -1)) + "), 16, -10) as bigint)").bitwiseOR(F.lit(1))
    shares = prefix_shares(docs.filter("id IS NOT NULL"), k, num, den)
    alive = classes.withColumn("sig64", low).join(shares, "sig64").filter(F.col("shared") >= least).select("cid", "sig", "n")
    kept = materialize(class_grams(docs.filter("id IS NOT NULL"), alive, k).dropDuplicates(["cid"]), "grams")

    entries = kept.select("cid", "n", F.explode("toks").alias("tok"))
    often = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = entries.join(often, "tok").groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"))
    # r shingles are shared with some class, the other n - r come first in the order.
    index = materialize(shared.withColumn("r", F.size("toks").cast("long")).filter(f"{den} * r >= {num} * n"), "index")
    drop_table(kept)
    fragment = F.shiftrightunsigned(F.col("t.tok"), 61)
    segments = index.select("cid", F.explode("toks").alias("t")).groupBy("cid", fragment.alias("fragment")).agg(F.collect_list("t.tok").alias("seg"))
    segments = materialize(segments, "segments")
    prefix = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1 - (n - r)")
    posts = index.filter(prefix > 0).select("cid", "n", "r", F.posexplode(F.slice("toks", F.lit(1), prefix.cast("int"))).alias("i", "t")).select(F.col("t.tok").alias("tok"), "cid", "n", "r", (F.col("i") + F.col("n") - F.col("r")).alias("pos"))
    posts = materialize(posts, "postings")

    def possible(a: str, b: str) -> str:
        """The shingles that can still be common reach the least intersection."""
        return f"{num + den} * least({a}.r, {b}.r, {a}.n - {a}.pos, {b}.n - {b}.pos) >= {num} * ({a}.n + {b}.n)"

    def links(pairs: DataFrame) -> DataFrame:
        sums = overlap_sums(pairs.select("a", "b"), segments)
        sizes = index.select("cid", "n")
        sums = sums.join(sizes.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b")
        return sums.filter(f"{num + den} * inter >= {num} * (na + nb)").select("a", "b")

    # The most central class of a list is the one with the least share of its own shingles.
    final = linked_components(posts, possible, links, [F.col("r") / F.col("n")])
    return classes.join(final.withColumnRenamed("v", "cid"), "cid", "left").select("sig", "cid", F.coalesce("label", "cid").alias("component"))
