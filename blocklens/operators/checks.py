"""Integrity of whole images: every table entry gets a verdict, and the verdicts are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.operators.lookups import COMPRESSED_BIT, OFFSET_MASK

#: Verdicts that are corruptions by themselves.
BAD = ("zero_after_mask", "out_of_file", "misaligned", "compressed_out")
#: States of a VHDX block; fixed values.
FULLY_PRESENT, PARTIALLY_PRESENT, KNOWN_ABSENT = 6, 7, (0, 1, 2, 3)
MIB = 1 << 20


def qcow2_verdicts(entries: DataFrame, cluster_bits: int = 16) -> DataFrame:
    """Adds ``verdict, at, end`` to ``entries(pos, level, raw, size)``; ``size`` is the file's.

    Level 1: an entry that is not zero but has no offset is corrupt, then one beyond the
    file, then one off the cluster grid. Level 2: entries without an offset name no cluster,
    whatever their flags; the grid is tested before the file's end. A compressed cluster
    has an offset and a number of sectors, and must end within the file.
    """
    cluster, raw = 1 << cluster_bits, F.col("raw")
    offset, width = raw.bitwiseAND(OFFSET_MASK), 62 - (cluster_bits - 8)
    packed = (F.col("level") == 2) & (F.getbit(raw, F.lit(COMPRESSED_BIT)) == 1)
    begin = raw.bitwiseAND((1 << width) - 1)
    sectors = F.shiftrightunsigned(raw, width).bitwiseAND((1 << (cluster_bits - 8)) - 1) + 1
    stop = begin + sectors * 512 - begin.bitwiseAND(511)
    beyond, crooked = offset >= F.col("size"), offset % cluster != 0
    first = F.when(offset == 0, "zero_after_mask").when(beyond, "out_of_file").when(crooked, "misaligned").otherwise("allocated")
    second = F.when(packed & (stop > F.col("size")), "compressed_out").when(packed, "compressed").when(offset == 0, "unplaced").when(crooked, "misaligned").when(beyond, "out_of_file").otherwise("allocated")
    verdict = F.when(raw == 0, "empty").when(F.col("level") == 1, first).otherwise(second)
    return entries.select("*", verdict.alias("verdict"), F.when(packed, begin).otherwise(offset).alias("at"), F.when(packed, stop).otherwise(offset + cluster).alias("end"))


def claims(refs: DataFrame, silent: DataFrame) -> DataFrame:
    """``(cluster_idx, n, overlaps)`` of ``refs(cluster_idx, pos)``, and of ``silent`` ones.

    Every reference after a cluster's first overlaps. Silent references claim clusters
    without being tested, so that the first other one overlaps if a silent one came before.
    """
    both = refs.select("cluster_idx", "pos", F.lit(None).cast("long").alias("quiet")).unionByName(silent.select("cluster_idx", F.lit(None).cast("long").alias("pos"), F.col("pos").alias("quiet")))
    found = both.groupBy("cluster_idx").agg(F.count("pos").alias("n"), F.min("pos").alias("first"), F.min("quiet").alias("quiet"))
    late = F.coalesce((F.col("quiet") < F.col("first")).cast("long"), F.lit(0))
    return found.select("cluster_idx", "n", F.when(F.col("n") > 0, F.col("n") - 1 + late).otherwise(0).alias("overlaps"))


def check_qcow2(entries: DataFrame, refcounts: DataFrame, metadata: DataFrame, cluster_bits: int = 16) -> DataFrame:
    """The counters of a whole image, one row.

    ``metadata(cluster_idx)`` are the clusters of the header and of the counts' own tables:
    in use without a reference. Corruptions are bad entries and overlaps; counted clusters
    that nothing uses are leaks, which leave the image valid; references to a cluster
    counted 0 are count errors, one each, which do not.
    """
    marked = qcow2_verdicts(entries, cluster_bits)
    cluster = F.expr(f"at div {1 << cluster_bits}").alias("cluster_idx")
    refs = marked.filter("verdict = 'allocated'").select(cluster, "pos")
    last = F.expr(f"(end - 1) div {1 << cluster_bits}")
    packed = marked.filter("verdict = 'compressed'").select(F.explode(F.sequence(F.expr(f"at div {1 << cluster_bits}"), last)).alias("cluster_idx"), "pos")
    # A cluster of metadata is as good as claimed, but overlaps with nothing that was tested.
    held = claims(refs, packed).join(metadata.select("cluster_idx", F.lit(True).alias("meta")).distinct(), "cluster_idx", "full_outer")
    both = held.join(refcounts, "cluster_idx", "full_outer")
    counted = both.agg(
        F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"),
        F.coalesce(F.sum(F.when(F.col("stored") == 0, F.col("n"))), F.lit(0)).alias("refcount_errors"),
        F.count(F.when((F.col("stored") > 0) & F.col("n").isNull() & F.col("meta").isNull(), 1)).alias("leaks"),
    )
    walked = marked.agg(
        F.count(F.lit(1)).alias("clusters_checked"),
        F.count_if(F.col("verdict").isin("allocated", "compressed", "compressed_out")).alias("clusters_allocated"),
        F.count_if(F.col("verdict").isin(*BAD)).alias("bad_entries"),
        F.coalesce(F.max(F.when(F.col("verdict").isin("allocated", "compressed"), F.col("end"))), F.lit(0)).alias("image_end"),
    )
    return verdict_row(walked.crossJoin(F.broadcast(counted)), F.col("overlaps") + F.col("bad_entries"))


def verdict_row(counts: DataFrame, corruptions: Column) -> DataFrame:
    counts = counts.withColumn("corruptions", corruptions)
    return counts.withColumns({"total_errors": F.expr("corruptions + leaks + refcount_errors"), "valid": F.expr("corruptions = 0 AND refcount_errors = 0"), "has_leaks": F.expr("leaks > 0")})


def slots_overlap(blocks: DataFrame, *by: str) -> DataFrame:
    """References beyond the first of each slot, summed."""
    per = blocks.groupBy(*by, "slot_of").agg((F.count(F.lit(1)) - 1).alias("more"))
    return per.groupBy(*by).agg(F.sum("more").alias("overlaps"))


def check_vhd(table: DataFrame, block_total: int) -> DataFrame:
    """Per image of ``table(image_id, slot, entry, size)``: its block table's counters.

    ``block_total`` is a block with its bitmap. Entries that end beyond the file are
    corrupt; blocks overlap in slots of that size; fragmentation is by the order of slots.
    """
    rows = table.withColumn("at", F.col("entry") * 512).withColumn("used", F.col("entry") != 0xFFFFFFFF)
    rows = rows.withColumn("good", F.col("used") & (F.col("at") + block_total <= F.col("size")))
    counts = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("clusters_checked"), F.count_if("used").alias("clusters_allocated"), F.count_if(F.col("used") & ~F.col("good")).alias("out_of_file"))
    good = rows.filter("good").withColumn("slot_of", F.expr(f"at div {block_total}"))
    order = W.partitionBy("image_id").orderBy("slot")
    gaps = good.withColumn("gap", (F.col("at") != F.lag("at").over(order) + block_total).cast("int")).groupBy("image_id").agg(F.expr(f"if(count(1) <= 1, 0, coalesce(sum(gap), 0) * 100 div (count(1) - 1))").alias("fragmentation"))
    both = counts.join(slots_overlap(good, "image_id"), "image_id", "left").join(gaps, "image_id", "left")
    both = both.select("image_id", "clusters_checked", "clusters_allocated", "out_of_file", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.coalesce("fragmentation", F.lit(0)).alias("fragmentation"))
    return both.withColumn("corruptions", F.col("out_of_file") + F.col("overlaps"))


def vhdx_verdicts(table: DataFrame, regions: DataFrame, block: int) -> DataFrame:
    """Adds ``verdict, at`` to ``table(image_id, slot, entry, size, virtual_size)``, payload blocks only.

    ``regions(image_id, region_offset, region_length)`` are what the file declares; an
    image has a handful of them. A range that overflows, as one that is empty, is
    told as in ``chains.ranges_overlap``.
    """
    from blocklens.operators.chains import ranges_overlap

    declared = regions.groupBy("image_id").agg(F.collect_list(F.struct("region_offset", "region_length")).alias("declared"))
    state, at = F.col("entry").bitwiseAND(7), F.shiftrightunsigned("entry", 20) * MIB
    left = F.col("virtual_size") - F.col("slot") * block
    inside = F.exists("declared", lambda r: ranges_overlap(F.col("at"), F.lit(block).cast("long"), r["region_offset"], r["region_length"]))
    rows = table.join(declared, "image_id", "left").withColumn("at", at).withColumn("left", left)
    end = F.try_add("at", F.least("left", F.lit(block).cast("long")))
    verdict = (
        F.when(state.isin(*KNOWN_ABSENT), "absent")
        .when(state == PARTIALLY_PRESENT, "partial")
        .when(state != FULLY_PRESENT, "unknown")
        .when(F.col("left") < 0, "past_end")
        .when(end.isNull() | (F.col("at") >= F.col("size")) | (end > F.col("size")), "out_of_file")
        .when(F.col("at") == 0, "offset_zero")
        .when(F.coalesce(inside, F.lit(False)), "in_region")
        .otherwise("good")
    )
    return rows.withColumn("verdict", verdict).drop("declared", "left")


def check_vhdx(table: DataFrame, regions: DataFrame, block: int) -> DataFrame:
    """Per image the counters of ``vhdx_verdicts``."""
    marked = vhdx_verdicts(table, regions, block)
    counts = marked.groupBy("image_id").agg(F.count(F.lit(1)).alias("clusters_checked"), F.count_if(F.expr("entry % 8 = 6")).alias("clusters_allocated"), F.count_if(~F.col("verdict").isin("absent", "good")).alias("bad_entries"))
    over = slots_overlap(marked.filter("verdict = 'good'").withColumn("slot_of", F.expr(f"at div {block}")), "image_id")
    both = counts.join(over, "image_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    return both.withColumn("corruptions", F.col("bad_entries") + F.col("overlaps"))


def check_vmdk(directory: DataFrame, tables: DataFrame, grain: int, table_bytes: int) -> DataFrame:
    """Counters of one sparse extent: ``directory(gd_idx, entry, size)`` and ``tables(gd_idx, gt_idx, entry)``.

    Entries are sectors. A grain table must begin and end within the file; only the grains
    of such tables are looked at. 0 is not allocated and 1 a grain of zeros. A grain
    overlaps with a grain, or with a table that was met before it.
    """
    gd = directory.withColumn("at", F.col("entry") * 512)
    verdict = F.when(F.col("entry") == 0, "empty").when(F.col("at") >= F.col("size"), "out_of_file").when(F.col("at") + table_bytes > F.col("size"), "table_out").otherwise("good")
    gd = gd.withColumn("verdict", verdict)
    met = gd.filter("verdict = 'good'").select("gd_idx", F.col("at").alias("table_at"), "size")
    grains = tables.join(met, "gd_idx").withColumn("at", F.col("entry") * 512)
    grains = grains.withColumn("verdict", F.when(F.col("entry") == 0, "empty").when(F.col("entry") == 1, "zero").when(F.col("at") >= F.col("size"), "out_of_file").otherwise("good"))
    # Positions of the walk: a table, then its grains.
    pos = lambda i: F.col("gd_idx") * (table_bytes // 4 + 1) + i
    refs = grains.filter("verdict = 'good'").select(F.expr(f"at div {grain}").alias("cluster_idx"), pos(F.col("gt_idx") + 1).alias("pos"))
    silent = met.select(F.explode(F.expr(f"sequence(table_at div {grain}, (table_at + {table_bytes - 1}) div {grain})")).alias("cluster_idx"), pos(F.lit(0)).alias("pos"))
    over = claims(refs, silent).agg(F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"))
    top = gd.agg(F.count(F.lit(1)).alias("tables_checked"), F.count_if(F.expr("verdict = 'good'")).alias("tables"), F.count_if(F.expr("verdict IN ('out_of_file', 'table_out')")).alias("bad_tables"))
    low = grains.agg(F.count(F.lit(1)).alias("grains_checked"), F.count_if(F.expr("verdict = 'good'")).alias("grains"), F.count_if(F.expr("verdict = 'zero'")).alias("zero_grains"), F.count_if(F.expr("verdict = 'out_of_file'")).alias("bad_grains"))
    row = top.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(over))
    return row.select(
        (F.col("tables_checked") + F.col("grains_checked")).alias("clusters_checked"),
        (F.col("tables") + F.col("grains")).alias("clusters_allocated"),
        "zero_grains",
        "overlaps",
        (F.col("bad_tables") + F.col("bad_grains") + F.col("overlaps")).alias("corruptions"),
    )


def table_counts(entries: DataFrame) -> DataFrame:
    """Per image: VHDX blocks with data, allocated VMDK grains and populated directory entries of ``entries(image_id, bat, gt, gd)``."""
    return entries.groupBy("image_id").agg(F.count_if(F.col("bat").bitwiseAND(7) == FULLY_PRESENT).alias("bat"), F.count_if(F.expr("gt > 1")).alias("gt"), F.count_if(F.expr("gd != 0")).alias("gd"))
