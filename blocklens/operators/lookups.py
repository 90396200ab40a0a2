"""Where a byte of an image lies: block tables of the formats joined to the offsets asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets in first- and second-level entries, and the flags beside them; fixed values.
OFFSET_MASK = 0x00FFFFFFFFFFFE00
COMPRESSED_BIT, ZERO_BIT = 62, 0
#: The least entry that says "not in this file": discarded or never written; fixed values.
VDI_DISCARDED = 0xFFFFFFFE


def raw_extent(images: DataFrame) -> DataFrame:
    """One extent of data per raw image of ``images(image_id, size)``; an empty one has none."""
    zero = F.lit(0).cast("long")
    return images.filter("size > 0").select("image_id", zero.alias("start"), F.col("size").alias("length"), F.lit("data").alias("state"), zero.alias("file_offset"))


def vdi_lookup(offsets: DataFrame, table: DataFrame, block: int, blocks: int, data_start: int) -> DataFrame:
    """``(offset, allocated, host)`` by ``table(block_idx, entry)``; what is not allocated reads as zeros."""
    asked = offsets.withColumn("block_idx", F.expr(f"offset div {block}"))
    there = F.coalesce((F.col("block_idx") < blocks) & (F.col("entry") < VDI_DISCARDED), F.lit(False))
    host = data_start + F.col("entry") * block + F.col("offset") % block
    return asked.join(table, "block_idx", "left").select("offset", there.alias("allocated"), F.when(there, host).alias("host"))


def parallels_lookup(offsets: DataFrame, table: DataFrame, cluster: int, multiplier: Column) -> DataFrame:
    """As above for tables of sector numbers (``multiplier`` 1) or of clusters (sectors of a cluster); 0 is not allocated."""
    asked = offsets.withColumn("block_idx", F.expr(f"offset div {cluster}"))
    there = F.coalesce(F.col("entry") != 0, F.lit(False))
    host = F.col("entry") * multiplier * 512 + F.col("offset") % cluster
    return asked.join(table, "block_idx", "left").select("offset", there.alias("allocated"), F.when(there, host).alias("host"))


def two_level(offsets: DataFrame, l1: DataFrame, l2: DataFrame, cluster_bits: int, l2_bits: int) -> DataFrame:
    """Adds ``l2_table`` and ``entry``, 0 where either level has none."""
    asked = offsets.withColumn("l1_idx", F.shiftrightunsigned("offset", cluster_bits + l2_bits)).withColumn("l2_idx", F.shiftrightunsigned("offset", cluster_bits).bitwiseAND((1 << l2_bits) - 1))
    found = asked.join(l1, "l1_idx", "left").withColumn("l2_table", F.coalesce("l2_table", F.lit(0)))
    return found.join(l2, ["l2_table", "l2_idx"], "left").withColumn("entry", F.when(F.col("l2_table") == 0, 0).otherwise(F.coalesce("entry", F.lit(0))))


def qcow1_lookup(offsets: DataFrame, l1: DataFrame, l2: DataFrame, cluster_bits: int, l2_bits: int) -> DataFrame:
    """``(offset, state, host, size)``: ``data``, ``compressed`` or ``backing``.

    What this image does not hold is its backing file's to answer. A negative entry has its
    highest bit set: compressed, the size in bytes above the offset.
    """
    found = two_level(offsets, l1, l2, cluster_bits, l2_bits)
    shift, entry = 63 - cluster_bits, F.col("entry")
    state = F.when(entry == 0, "backing").when(entry < 0, "compressed").otherwise("data")
    host = F.when(entry < 0, entry.bitwiseAND((1 << shift) - 1)).when(entry > 0, entry + F.col("offset") % (1 << cluster_bits))
    size = F.when(entry < 0, F.shiftrightunsigned(entry, shift).bitwiseAND((1 << cluster_bits) - 1))
    return found.select("offset", state.alias("state"), host.alias("host"), size.alias("size"))


def entry_state(entry: Column) -> Column:
    """The state that a second-level entry gives its cluster."""
    flag = lambda bit: F.getbit(entry, F.lit(bit)) == 1
    placed = entry.bitwiseAND(OFFSET_MASK) != 0
    return F.when(flag(COMPRESSED_BIT), "compressed").when(flag(ZERO_BIT) & placed, "zero_at").when(flag(ZERO_BIT), "zero").when(placed, "data").otherwise("hole")


def qcow2_lookup(offsets: DataFrame, l1: DataFrame, l2: DataFrame, cluster_bits: int) -> DataFrame:
    """``(offset, state, host)`` through both tables; ``host`` is where the byte lies, or a compressed cluster begins."""
    l2_bits = cluster_bits - 3
    named = l1.select("l1_idx", F.col("l1_entry").bitwiseAND(OFFSET_MASK).alias("l2_table"))
    found = two_level(offsets, named, l2, cluster_bits, l2_bits)
    state, entry = entry_state(F.col("entry")), F.col("entry")
    packed = entry.bitwiseAND((1 << 62 - (cluster_bits - 8)) - 1)
    host = F.when(state == "compressed", packed).when(state.isin("data", "zero_at"), entry.bitwiseAND(OFFSET_MASK) + F.col("offset") % (1 << cluster_bits))
    return found.select("offset", state.alias("state"), host.alias("host"))
