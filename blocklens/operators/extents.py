"""Extents: classification, coalescing, clipping and window arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.model import BLOCK, DATA, HOLE, PLACED, STATE_FLAGS, ZERO


def placed(state: Column) -> Column:
    return state.isin(*PLACED)


def extents_of_blocks(blocks: DataFrame, block: int = BLOCK, virtual_size: Column | None = None) -> DataFrame:
    """One extent per block, the last one trimmed to the image's size."""
    start = F.col("block_idx") * block
    length = F.lit(block).cast("long") if virtual_size is None else F.least(F.lit(block).cast("long"), virtual_size - start)
    return blocks.select("image_id", start.alias("start"), length.alias("length"), "state", "file_offset").filter("length > 0")


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Merge runs that follow on each other; ``end`` and ``file_end`` are exclusive."""
    order = W.partitionBy(*by).orderBy("start")
    last_end, last_state, last_file = (F.lag(c).over(order) for c in ("end", "state", "file_end"))
    follows = (last_end == F.col("start")) & (last_state == F.col("state")) & (~placed(F.col("state")) | (last_file == F.col("file_offset")))
    marked = rows.withColumn("opens", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("state").alias("state"), F.min("file_offset").alias("file_offset"), F.max("file_end").alias("file_end"))


def coalesce_extents(extents: DataFrame, chunk: int = BLOCK * 65536) -> DataFrame:
    """Merge adjacent extents of one state (and, where placed, of adjacent file ranges).

    An image is cut into chunks of address space that are merged by themselves, so that
    one huge image is the work of many tasks. Only the first and the last run of a chunk
    can go on into another; a second window orders just those, two rows a chunk.
    """
    rows = extents.filter("length > 0").select("image_id", "start", (F.col("start") + F.col("length")).alias("end"), "state", "file_offset", (F.col("file_offset") + F.col("length")).alias("file_end"))
    local = _islands(rows.withColumn("chunk", F.floor(F.col("start") / chunk)), ["image_id", "chunk"])
    whole = W.partitionBy("image_id", "chunk")
    local = local.withColumn("edge", (F.col("start") == F.min("start").over(whole)) | (F.col("end") == F.max("end").over(whole)))
    edges = _islands(local.filter("edge"), ["image_id"])
    columns = ["image_id", "start", (F.col("end") - F.col("start")).alias("length"), "state", F.when(placed(F.col("state")), F.col("file_offset")).alias("file_offset")]
    return local.filter("NOT edge").select(*columns).unionByName(edges.select(*columns))


def clip(extents: DataFrame, window_start: Column, window_end: Column) -> DataFrame:
    """Extents cut to a window; trimming the front moves the file offset along."""
    end = F.col("start") + F.col("length")
    front = F.greatest(F.col("start"), window_start)
    inside = extents.filter((end > window_start) & (F.col("start") < window_end))
    return inside.select("image_id", front.alias("start"), (F.least(end, window_end) - front).alias("length"), "state", F.when(F.col("file_offset").isNotNull(), F.col("file_offset") + front - F.col("start")).alias("file_offset"))


def map_window(start: Column, max_length: Column, virtual_size: Column) -> tuple[Column, Column]:
    """A length of 0 means to the end; the end never passes the image's."""
    return start, F.when(max_length == 0, virtual_size).otherwise(F.least(start + max_length, virtual_size))


def dd_window(block: Column, count: Column, skip: Column, virtual_size: Column) -> tuple[Column, Column]:
    """``count`` is measured from offset 0, not from ``skip``; past the end is empty, not an error."""
    end = F.when(count.isNull(), virtual_size).otherwise(F.least(count * block, virtual_size))
    start = skip * block
    return F.least(start, end), F.greatest(end - start, F.lit(0))


def flags(extents: DataFrame, version: tuple[int, int] = (10, 0)) -> DataFrame:
    """Map rows with the flag columns that a version shows."""
    state = F.col("state")
    shown = [F.col("image_id"), F.col("start"), F.col("length"), F.lit(0).cast("long").alias("depth")]
    for i, name in enumerate(("present", "zero", "data")):
        if name != "present" or version >= (6, 1):
            shown.append(state.isin(*(s for s, f in STATE_FLAGS.items() if f[i])).alias(name))
    if version >= (8, 2):
        shown.append(F.lit(False).alias("compressed"))
    return extents.select(*shown, F.col("file_offset").alias("offset"))


def classify_vhd(entry: Column, data_offset: int) -> tuple[Column, Column]:
    free = entry == 0xFFFFFFFF
    return F.when(free, HOLE).otherwise(DATA), F.when(~free, entry * 512 + data_offset)


def classify_vhdx(entry: Column) -> tuple[Column, Column]:
    """States 0-2 are holes apart from zero (2); 6 and 7 hold data; unknown ones are holes."""
    state = entry.bitwiseAND(7)
    here = state.isin(6, 7)
    return F.when(here, DATA).when(state == 2, ZERO).otherwise(HOLE), F.when(here, F.shiftrightunsigned(entry, 20) * 1048576)


def classify_vmdk(entry: Column) -> tuple[Column, Column]:
    return F.when(entry == 0, HOLE).when(entry == 1, ZERO).otherwise(DATA), F.when(entry > 1, entry * 512)


def subcluster_type(cluster: Column, alloc: Column, zero: Column, sub: Column) -> Column:
    """The type of one of 32 subclusters, from its cluster's type and both bitmaps."""
    a, z = (F.expr("1") == F.getbit(m, sub) for m in (alloc, zero))
    normal = F.when(alloc.bitwiseAND(zero) != 0, "invalid").when(z, "zero_alloc").when(a, "normal").otherwise("unallocated_alloc")
    none = F.when(alloc != 0, "invalid").when(z, "zero_plain").otherwise("unallocated_plain")
    return F.when(cluster == "compressed", "compressed").when(cluster == "normal", normal).when(cluster == "unallocated", none).otherwise("invalid")


def split_transfers(ranges: DataFrame, most: int) -> DataFrame:
    """Ranges ``(offset, length)`` cut into pieces of at most ``most`` bytes."""
    pieces = ranges.filter("length > 0").withColumn("at", F.explode(F.expr(f"sequence(offset, offset + length - 1, {most}L)")))
    return pieces.select("id", F.col("at").alias("offset"), F.least(F.lit(most).cast("long"), F.col("offset") + F.col("length") - F.col("at")).alias("length"))
