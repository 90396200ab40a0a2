"""Layer chains: composing, comparing, rebasing, committing and sector ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compose(layers: DataFrame, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """Per block the state and value of the shallowest layer that answers.

    Data and zero answer, a hole defers. The least depth is one aggregation that
    combines before its shuffle; blocks that no layer answers are not listed and read
    as zeros (``or_zero``).
    """
    own = layers.filter("state <> 'hole'")
    if lowest is not None:
        own = own.filter(F.col("depth") >= lowest)
    if highest is not None:
        own = own.filter(F.col("depth") <= highest)
    answer = F.min_by(F.struct("depth", "state", "value"), "depth").alias("a")
    return own.groupBy("chain_id", "block_idx").agg(answer).select("chain_id", "block_idx", "a.depth", "a.state", F.when(F.col("a.state") == "data", F.col("a.value")).otherwise(0).alias("value"))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def compare(a: DataFrame, b: DataFrame, sizes: DataFrame) -> DataFrame:
    """Two composed chains: the first difference, and whether a longer tail is zero.

    ``sizes`` is one row ``(size_a, size_b)``. ``compared`` is the common size even when a
    difference ends the walk early.
    """
    left = a.select("block_idx", F.col("value").alias("va"))
    right = b.select("block_idx", F.col("value").alias("vb"))
    both = left.join(right, "block_idx", "full_outer").withColumn("differs", or_zero(F.col("va")) != or_zero(F.col("vb")))
    both = both.crossJoin(F.broadcast(sizes.select("size_a", "size_b")))
    inside = F.col("block_idx") < F.least("size_a", "size_b")
    counts = both.agg(
        F.min(F.when(F.col("differs") & inside, F.col("block_idx"))).alias("first_mismatch"),
        F.count(F.when(F.col("differs") & inside, 1)).alias("n_mismatches"),
        F.count(F.when(F.col("differs") & ~inside, 1)).alias("tail_mismatches"),
    )
    sized = counts.crossJoin(F.broadcast(sizes.select(F.least("size_a", "size_b").cast("long").alias("compared"), (F.col("size_a") != F.col("size_b")).alias("size_mismatch"))))
    return sized.withColumn("identical", (F.col("n_mismatches") == 0) & (F.col("tail_mismatches") == 0))


def rebase_copies(overlay: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks the overlay lacks and whose old and new content differ, with the old content."""
    before, after = old.select("block_idx", F.col("value").alias("old")), new.select("block_idx", F.col("value").alias("new"))
    both = before.join(after, "block_idx", "full_outer").join(overlay.select("block_idx"), "block_idx", "left_anti")
    return both.filter(or_zero(F.col("old")) != or_zero(F.col("new"))).select("block_idx", or_zero(F.col("old")).alias("value"))


def commit(overlay: DataFrame, backing: DataFrame) -> DataFrame:
    """The backing layer after the overlay's data has overwritten it."""
    top = overlay.filter("state <> 'hole'").select("block_idx", F.col("value").alias("top"), F.lit(True).alias("written"))
    merged = backing.select("block_idx", F.col("value").alias("below")).join(top, "block_idx", "full_outer")
    return merged.select("block_idx", F.when(F.col("written"), F.col("top")).otherwise(F.col("below")).alias("value"), F.coalesce("written", F.lit(False)).alias("written"))


def sector_owner(bits: Column, sector: Column, order: str) -> Column:
    """Whether the child owns a sector of a byte's eight; ``msb`` or ``lsb`` first."""
    place = sector if order == "lsb" else 7 - sector
    return F.getbit(bits, place.cast("int")) == 1


def rechunk(sectors: DataFrame, ratio: int) -> DataFrame:
    """Input sectors gathered into output sectors of ``ratio`` each; all-zero ones are dropped."""
    out = sectors.groupBy(F.expr(f"sector div {ratio}").alias("sector")).agg(F.count(F.lit(1)).alias("parts"), F.sum("value").alias("value"), F.max(F.abs("value")).alias("most"))
    return out.filter("most <> 0").drop("most")


def compose_differencing(sectors: DataFrame, order: str) -> DataFrame:
    """``sectors(block_idx, sector, present, bits, child, parent)``: who answers each sector, and its value.

    ``bits`` is the byte of the block's bitmap that covers the sector, whose place in it is
    ``sector % 8``. A block that is wholly present is the child's, one that is absent the
    parent's (``present`` 'full', 'absent'); others go sector by sector.
    """
    own = F.when(F.col("present") == "full", True).when(F.col("present") == "absent", False).otherwise(sector_owner(F.col("bits"), F.col("sector") % 8, order))
    return sectors.select("block_idx", "sector", own.alias("child_owned"), F.when(own, F.col("child")).otherwise(or_zero(F.col("parent"))).alias("value"))


def commit_refusal(overlay: DataFrame) -> DataFrame:
    """Why an overlay can't be committed: it holds compressed clusters; else ``ok``. One row."""
    return overlay.agg(F.when(F.coalesce(F.max((F.col("state") == "compressed").cast("int")), F.lit(0)) > 0, "compressed").otherwise("ok").alias("outcome"))


def repointed(images: DataFrame, changes: DataFrame) -> DataFrame:
    """An unsafe rebase: parents of ``images(id, parent, parent_format)`` as ``changes(id, new_parent, new_format)`` say.

    No data is read or copied. A null new parent takes the parent away; a format that is
    not named stays null. Each row says whether it was rewritten.
    """
    listed = changes.select("id", "new_parent", "new_format", F.lit(True).alias("rewritten"))
    both = images.join(listed, "id", "left")
    new = F.coalesce("rewritten", F.lit(False))
    return both.select("id", F.when(new, F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), F.when(new, F.col("new_format")).otherwise(F.col("parent_format")).alias("parent_format"), new.alias("rewritten"))
