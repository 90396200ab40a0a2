"""Integrity checks over references and reference counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def used(refs: DataFrame) -> DataFrame:
    return refs.groupBy("cluster_idx").agg(F.count(F.lit(1)).alias("want"))


def compared_counts(refs: DataFrame, refcounts: DataFrame) -> DataFrame:
    """Wanted and stored counts of every cluster that either side knows."""
    return refcounts.join(used(refs), "cluster_idx", "full_outer").select("cluster_idx", F.coalesce("want", F.lit(0)).alias("want"), "stored")


def leaked(refs: DataFrame, refcounts: DataFrame) -> DataFrame:
    return refcounts.filter("stored > 0").join(refs, "cluster_idx", "left_anti")


def fragmentation(places: DataFrame, cluster: int, chunk: int = 65536) -> DataFrame:
    """Share, in whole percent, of data clusters that don't follow their logical predecessor.

    ``places(image_id, logical, host_offset)``. Runs of ``chunk`` logical places are
    counted by themselves; the joints between runs need one row of each run.
    """
    run = F.expr(f"logical div {chunk}")
    within = W.partitionBy("image_id", "run").orderBy("logical")
    marked = places.withColumn("run", run).withColumn("gap", (F.col("host_offset") != F.lag("host_offset").over(within) + cluster).cast("int"))
    runs = marked.groupBy("image_id", "run").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps"), F.min_by("host_offset", "logical").alias("head"), F.max_by("host_offset", "logical").alias("tail"))
    joint = (F.col("head") != F.lag("tail").over(W.partitionBy("image_id").orderBy("run")) + cluster).cast("int")
    total = runs.withColumn("joint", F.coalesce(joint, F.lit(0))).groupBy("image_id").agg(F.sum("n").alias("clusters"), F.sum(F.col("gaps") + F.col("joint")).alias("gaps"))
    return total.withColumn("percent", F.expr("if(clusters <= 1, 0, gaps * 100 div (clusters - 1))"))


def corrections(refs: DataFrame, refcounts: DataFrame) -> DataFrame:
    """What a full repair does to each counted cluster; the safe tier only frees leaks."""
    both = compared_counts(refs, refcounts).filter("stored IS NOT NULL")
    action = F.expr("case when want > stored then 'raised' when want < stored and want > 0 then 'lowered' when want = 0 and stored <> 0 then 'freed' else 'kept' end")
    return both.withColumn("action", action).withColumn("safe", F.expr("if(want = 0, 0L, stored)"))


def copied_flags(refs: DataFrame, refcounts: DataFrame) -> DataFrame:
    """A reference is flagged copied iff its cluster is counted once; unknown clusters are cleared."""
    return refs.join(refcounts, "cluster_idx", "left").select("src", "cluster_idx", F.coalesce(F.col("stored") == 1, F.lit(False)).alias("copied"))


def validate_chain(layers: DataFrame) -> DataFrame:
    """Per chain: layers whose format is not the recorded one, and layers of no size."""
    return layers.groupBy("chain_id").agg(F.count(F.lit(1)).alias("depth"), F.count_if(~F.col("format").eqNullSafe(F.col("declared"))).alias("format_errors"), F.count_if(F.col("virtual_size") == 0).alias("size_errors"))


def saturating_count(refs: DataFrame, most: int = 65535) -> DataFrame:
    return refs.groupBy("cluster_idx").agg(F.least(F.count(F.lit(1)), F.lit(most).cast("long")).alias("refcount"))


def computed_counts(refs: DataFrame, bits: int = 16) -> DataFrame:
    """``(cluster_idx, counted, overflow)``: references of each cluster, and whether the width can't hold them."""
    return used(refs).select("cluster_idx", F.col("want").alias("counted"), (F.col("want") > (1 << bits) - 1).alias("overflow"))


def repaired_counts(refs: DataFrame, refcounts: DataFrame, safe: bool = False) -> DataFrame:
    """The counts' next version: ``(cluster_idx, stored)``; the safe tier only frees leaks."""
    found = corrections(refs, refcounts)
    return found.select("cluster_idx", F.col("safe" if safe else "want").alias("stored"))


def header_faults(headers: DataFrame) -> DataFrame:
    """The first fault of each layer's header, or ``ok``, in the order that they are looked for.

    ``headers(chain_id, depth, magic, l1_offset, l1_size, table_offset, table_clusters,
    cluster, size, corrupt)``; ``size`` is the file's. A sum that overflows lies outside.
    """
    end = F.try_add("table_offset", F.try_multiply("table_clusters", "cluster"))
    outside = lambda c: (F.col(c) == 0) | (F.col(c) >= F.col("size"))
    fault = (
        F.when(F.col("magic") != 0x514649FB, "magic")
        .when(outside("l1_offset"), "l1_offset")
        .when(F.coalesce(F.try_multiply("l1_size", F.lit(8).cast("long")), F.col("size") + 1) > F.col("size"), "l1_size")
        .when(outside("table_offset"), "table_offset")
        .when(end.isNull() | (end > F.col("size")), "table_end")
        .when(F.col("corrupt"), "corrupt")
        .otherwise("ok")
    )
    return headers.select("chain_id", "depth", fault.alias("fault"))
