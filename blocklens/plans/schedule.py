"""Benchmark schedules, write placement and option changes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.functions.scalars import ceil_div, div


def schedule(spark: SparkSession, count: int, offset: int, step: int, buffer: int, image: int, flush: int = 0) -> DataFrame:
    """Requests of a run: the first offset is raw, later ones wrap at the last that fits.

    A step of 0 means the buffer's size. A request is followed by a flush when the
    requests that remain are a whole number of intervals. Made where it is used: one
    closed form per row.
    """
    step = step or buffer
    room = image - buffer
    later = F.lit(0).cast("long") if room <= 0 else F.expr(f"({offset}L + id * {step}L) % {room}L")
    rows = spark.range(count).withColumn("offset", F.when(F.col("id") == 0, F.lit(offset).cast("long")).otherwise(later))
    return rows.select(F.col("id").alias("request"), "offset", F.expr(f"({count} - id - 1) % {flush} = 0" if flush else "false").alias("flush"))


def touched_bound(count: Column, offset: Column, step: Column, buffer: Column, image: Column, unit: Column) -> Column:
    """The most units a schedule can touch: the least of three bounds."""
    end = offset + (count - 1) * step + buffer
    straddle = count * (div(buffer, unit) + 2)
    span = div(end - 1, unit) - div(offset, unit) + 1
    whole = ceil_div(image, unit)
    return F.when((image == 0) | (count == 0), 0).otherwise(F.least(straddle, whole, F.when((count == 1) | (end < image), span).otherwise(whole))).cast("long")


def place_clusters(extents: DataFrame, first: int, chunk: int = 65536) -> DataFrame:
    """Host clusters for the data blocks of each image, in order of address.

    Numbers are given within chunks of blocks; how many came before a chunk is a sum
    over one row per chunk.
    """
    rows = extents.withColumn("chunk", F.expr(f"block_idx div {chunk}"))
    counts = rows.groupBy("image_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("image_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("image_id", "chunk", before.alias("base"))
    number = F.row_number().over(W.partitionBy("image_id", "chunk").orderBy("block_idx"))
    return rows.join(base, ["image_id", "chunk"]).select("image_id", "block_idx", (F.col("base") + number - 1 + first).cast("long").alias("host_cluster"))


def place_tables(blocks: DataFrame, per_table: int, first: int, unit: int, table_unit: int) -> tuple[DataFrame, DataFrame]:
    """Where a writer puts data and the tables that name it, in the order of addresses.

    A table comes first, then the blocks it names; empty tables are not written. Gives
    ``(image_id, block_idx, table_idx, at)`` and ``(image_id, table_idx, at)``. Only one
    row per table is ordered over a whole image.
    """
    rows = blocks.select("image_id", "block_idx", F.expr(f"block_idx div {per_table}").alias("table_idx"))
    counts = rows.groupBy("image_id", "table_idx").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("image_id").orderBy("table_idx").rowsBetween(W.unboundedPreceding, -1)
    at = first + F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)) * table_unit + F.coalesce(F.sum("n").over(before), F.lit(0)) * unit
    tables = counts.select("image_id", "table_idx", at.cast("long").alias("at"))
    turn = F.row_number().over(W.partitionBy("image_id", "table_idx").orderBy("block_idx")) - 1
    placed = rows.withColumn("turn", turn).join(tables, ["image_id", "table_idx"])
    return placed.select("image_id", "block_idx", "table_idx", (F.col("at") + table_unit + F.col("turn") * unit).cast("long").alias("at")), tables


def place_blocks(blocks: DataFrame, first: int, unit: int, chunk: int = 65536) -> DataFrame:
    """File offsets of equal blocks behind one table that names them all."""
    return place_clusters(blocks, 0, chunk).select("image_id", "block_idx", (first + F.col("host_cluster") * unit).alias("file_offset"))


def vhd_entries(blocks: DataFrame, first: int, block: int, chunk: int = 65536) -> DataFrame:
    """Block table entries of a dynamic VHD image: sectors; each block has its bitmap before it."""
    bitmap = -(-(-(-(block // 512) // 8)) // 512) * 512
    return place_blocks(blocks, first, bitmap + block, chunk).select("image_id", "block_idx", F.expr("file_offset div 512").alias("entry"))


def vhdx_entries(blocks: DataFrame, first: int, block: int, chunk: int = 65536) -> DataFrame:
    """Entries of a dynamic VHDX image: a block's slot counts the bitmap slots before it."""
    ratio = (1 << 23) * 512 // block
    return place_blocks(blocks, first, block, chunk).select("image_id", (F.col("block_idx") + F.expr(f"block_idx div {ratio}")).alias("slot"), (F.col("file_offset") + 6).alias("entry"))


def create_steps(images: DataFrame) -> DataFrame:
    """What a new, empty image's file holds: ``(image_id, step, part, offset, length)`` of ``images(image_id, format, v)``.

    Steps are in file order; sizes are those of the formats' fixed structures and of the
    tables that ``v`` asks for. Unknown formats have none.
    """
    from blocklens.plans.sizes import MIB, SECTOR, vhdx_block_size, vhdx_layout

    v = F.col("v")
    sector = lambda c: ceil_div(c, SECTOR) * SECTOR
    part = lambda name, offset, length: F.struct(F.lit(name).alias("part"), (F.lit(offset) if isinstance(offset, int) else offset).cast("long").alias("offset"), (F.lit(length) if isinstance(length, int) else length).cast("long").alias("length"))
    layout = vhdx_layout(ceil_div(v, SECTOR) * SECTOR, vhdx_block_size(v))
    bat = sector(ceil_div(v, 2 * MIB) * 4)
    tables = ceil_div(ceil_div(v, 65536), 512)
    made = {
        "raw": [part("data", 0, v)],
        "vhd": [part("footer_copy", 0, 512), part("dynamic_header", 512, 1024), part("block_table", 1536, bat), part("footer", 1536 + bat, 512)],
        "vhdx": [part("identifier", 0, 65536), part("header_1", 65536, 4096), part("header_2", 131072, 4096), part("region_table_1", 196608, 65536), part("region_table_2", 262144, 65536), part("log", MIB, MIB), part("block_table", 2 * MIB, layout["bat_bytes"]), part("metadata", 2 * MIB + layout["bat_bytes"], MIB)],
        "vmdk": [part("header", 0, 512), part("descriptor", 512, 20 * 512), part("grain_directory", 21 * 512, F.greatest(sector(tables * 4), F.lit(512).cast("long")))],
    }
    steps = F.lit(None).cast("array<struct<part: string, offset: bigint, length: bigint>>")
    for name, parts in made.items():
        steps = F.when(F.col("format") == name, F.array(*parts)).otherwise(steps)
    return images.select("image_id", F.posexplode(steps).alias("step", "p")).select("image_id", "step", "p.*")


def place_compressed(blocks: DataFrame, align: int, first: int, chunk: int = 65536) -> DataFrame:
    """File offsets of compressed blocks of different sizes, each padded to ``align``."""
    rows = blocks.withColumn("padded", F.expr(f"((size + {align - 1}) div {align}) * {align}")).withColumn("chunk", F.expr(f"block_idx div {chunk}"))
    sums = rows.groupBy("image_id", "chunk").agg(F.sum("padded").alias("n"))
    base = sums.select("image_id", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("image_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("padded").over(W.partitionBy("image_id", "chunk").orderBy("block_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("own", own).join(base, ["image_id", "chunk"]).select("image_id", "block_idx", "size", (F.col("base") + F.col("own") + first).cast("long").alias("file_offset"))


def place_deflated(clusters: DataFrame, align: int, first: int, chunk: int = 65536) -> DataFrame:
    """As ``place_compressed``, for clusters given by their payload: each is as long as its raw deflate stream.

    A cluster that does not get shorter is stored as it is and is no row of this plan.
    """
    from blocklens.functions.geometry import deflated_size

    sized = clusters.withColumn("size", deflated_size("payload")).filter(F.col("size") < F.octet_length("payload"))
    return place_compressed(sized.drop("payload"), align, first, chunk)


def subcluster_masks(subclusters: DataFrame) -> DataFrame:
    """Per cluster the 32 allocation bits and the 32 zero bits, as one signed word."""
    bit = F.expr("shiftleft(1L, cast(sub as int))")
    masks = subclusters.groupBy("cluster_idx").agg(F.coalesce(F.bit_or(F.when(F.col("state") == "data", bit)), F.lit(0)).alias("alloc"), F.coalesce(F.bit_or(F.when(F.col("state") == "zero", bit)), F.lit(0)).alias("zero"))
    return masks.withColumn("word", F.shiftleft("zero", 32).bitwiseOR(F.col("alloc")))


def resize_action(old: Column, new: Column, fmt: Column, may_shrink: Column) -> Column:
    return F.when((new == 0) & fmt.isin("raw", "qcow2"), "refused_zero").when(new == old, "noop").when(new > old, "grow").when(~fmt.isin("raw", "qcow2"), "refused_format").when(~may_shrink, "refused_shrink").otherwise("shrink")


def amend_action(version: Column, lazy: Column, incompatible: Column, bits: Column, want_version: Column, want_lazy: Column) -> Column:
    """What an option change does; null wants leave an option as it is."""
    target = F.coalesce(want_version, version)
    down = (version == 3) & (target == 2)
    lazy_after = F.when(down, False).otherwise(F.coalesce(want_lazy, lazy))
    return (
        F.when(incompatible.bitwiseAND(3) != 0, "dirty")
        .when(F.coalesce(want_lazy, F.lit(False)) & (target == 2), "lazy_requires_v3")
        .when(down & (incompatible != 0), "downgrade_blocked_feature")
        .when(down & (bits != 16), "downgrade_refcount_width")
        .when((target == version) & (lazy_after == lazy), "noop")
        .when(target == version, "lazy_word")
        .otherwise("rebuild")
    )


#: Longest request that the schedule takes as an argument, and the longest buffer; fixed values.
MOST_ARGUMENT, MOST_BUFFER = (1 << 31) - 1, 2 << 20


def bench_refusal(count: Column, depth: Column, buffer: Column, step: Column, flush: Column, writes: Column) -> Column:
    """Why a schedule's parameters are refused, in the order that they are looked at; else ``ok``."""
    return (
        F.when(count < 1, "count")
        .when(depth < 1, "depth")
        .when((buffer < 1) | (buffer > MOST_ARGUMENT), "buffer")
        .when(buffer > MOST_BUFFER, "buffer_cap")
        .when(step > MOST_ARGUMENT, "step")
        .when((flush != 0) & ~writes, "flush_requires_write")
        .when((flush != 0) & (flush < depth), "flush_below_depth")
        .otherwise("ok")
    )


def write_order(writes: DataFrame, chunk: int = 65536) -> DataFrame:
    """The steps of a crash-safe write program in order: ``(seq, class, kind, block_idx, barrier)``.

    Classes follow each other as in ``write_steps``; the first step of a class waits for
    all of the class before it. Within a class steps are by block.
    """
    kinds = F.expr("if(fresh, array(named_struct('class', 0L, 'kind', 'data'), named_struct('class', 1L, 'kind', 'l2'), named_struct('class', 2L, 'kind', 'l1'), named_struct('class', 3L, 'kind', 'refcount')), array(named_struct('class', 0L, 'kind', 'data')))")
    steps = writes.select("block_idx", F.explode(kinds).alias("s")).select("block_idx", "s.class", "s.kind")
    placed = place_clusters(steps.select(F.col("class").alias("image_id"), "block_idx"), 0, chunk).withColumnsRenamed({"image_id": "class", "host_cluster": "turn"})
    sizes = steps.groupBy("class", "kind").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("class", "kind", before.alias("base"))
    both = placed.join(F.broadcast(base), "class")
    return both.select((F.col("base") + F.col("turn")).alias("seq"), "class", "kind", "block_idx", ((F.col("turn") == 0) & (F.col("base") > 0)).alias("barrier"))


def write_steps(writes: DataFrame) -> DataFrame:
    """Steps of a crash-safe write program: data, then L2, then L1, counts last, each class behind a barrier."""
    steps = writes.select("write_id", "block_idx", F.explode(F.expr("if(fresh, array(named_struct('class', 0, 'kind', 'data'), named_struct('class', 1, 'kind', 'l2'), named_struct('class', 2, 'kind', 'l1'), named_struct('class', 3, 'kind', 'refcount')), array(named_struct('class', 0, 'kind', 'data')))")).alias("s"))
    return steps.groupBy("s.class", "s.kind").agg(F.count(F.lit(1)).alias("writes"), F.min("block_idx").alias("first_block"), F.max("block_idx").alias("last_block"))


def progress_marks(steps: DataFrame, interval: int) -> DataFrame:
    """Which steps report: every tenth, never, or at each crossing of the interval."""
    if interval == 100:
        return steps.withColumn("report", F.lit(False))
    if interval == 0:
        return steps.withColumn("report", F.col("done") % 10 == 9)
    level = F.expr(f"percent div {interval}")
    return steps.withColumn("report", F.coalesce(level > F.lag(level).over(W.partitionBy("job").orderBy("done")), level > 0))


def merged_config(layers: DataFrame) -> DataFrame:
    """Per key the value of the layer of highest precedence that sets it, and which that is."""
    set_ = layers.filter("value IS NOT NULL").groupBy("key").agg(F.max(F.struct("precedence", "value", "origin")).alias("m"))
    return set_.select("key", "m.value", "m.origin")
