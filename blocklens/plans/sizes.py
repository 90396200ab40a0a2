"""Sizes that an image would take in a target format, from its allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scalars import ceil_div, div, round_up

MIB = 1 << 20
#: Header, descriptor and marker sizes of the formats, in bytes; fixed values.
#: Gap before a fixed VHDX image's data, and the most entries of a first-level table; fixed values.
FIXED_GAP, MOST_L1 = 5 * MIB, 32 * MIB // 8
SECTOR, VHD_FOOTER, VHD_HEADER, VMDK_DATA_START, VMDK_TAIL, STREAM_ALIGN = 512, 512, 1024, 512 + 20 * 512, 3 * 512, 65536


def allocation(extents: DataFrame, unit: int) -> DataFrame:
    """Per image: size, allocated bytes (never more than the size) and target units with data."""
    return allocations(extents, [unit]).drop("unit")


def allocations(extents: DataFrame, units: list[int]) -> DataFrame:
    """``(image_id, unit, virtual_size, allocated_bytes, units)`` for each of several unit sizes, in one pass.

    A unit that two extents share counts once: an extent names its first and last unit,
    units wholly inside count by arithmetic, and only units on an extent's edge are listed.
    """
    rows = extents.withColumn("end", F.col("start") + F.col("length")).withColumn("data", (F.col("state") == "data") & (F.col("length") > 0))
    rows = rows.withColumn("unit", F.explode(F.array(*(F.lit(u).cast("long") for u in units))))
    a, b = F.expr("start div unit"), F.expr("(end - 1) div unit")
    # One entry per edge unit; the first also brings what the extent adds by arithmetic.
    zero = F.lit(0).cast("long")
    entry = lambda u, inner, bytes_: F.struct(u.alias("u"), inner.alias("inner"), bytes_.alias("bytes"))
    first, last = entry(a, F.greatest(b - a - 1, zero), F.col("length")), entry(b, zero, zero)
    parts = F.when(~F.col("data"), F.array(entry(F.lit(None).cast("long"), zero, zero))).when(a == b, F.array(first)).otherwise(F.array(first, last))
    listed = rows.select("image_id", "unit", "end", F.explode(parts).alias("e"))
    per = listed.groupBy("image_id", "unit", "e.u").agg(F.max("end").alias("end"), F.sum("e.inner").alias("inner"), F.sum("e.bytes").alias("bytes"))
    total = per.groupBy("image_id", "unit").agg(F.max("end").alias("virtual_size"), F.sum("bytes").alias("allocated"), (F.sum("inner") + F.count("u")).alias("units"))
    return total.select("image_id", "unit", "virtual_size", F.least("allocated", "virtual_size").alias("allocated_bytes"), "units")


def data_units(units: Column, allocated: Column, unit: Column | int) -> Column:
    """Counted units, or the allocation over the unit where none were counted."""
    return F.when(units != 0, units).otherwise(ceil_div(allocated, unit))


def refcount_layout(df: DataFrame, used: str = "used", cluster: str = "cluster", bits: str = "bits") -> DataFrame:
    """Adds ``layout(table, blocks)``: clusters of the counting structures, themselves counted.

    A fixed point of at most 16 rounds; null where they don't settle. One higher-order
    expression over three columns, so that a round's text appears once in the plan.
    """
    blocks = f"({used} + s.table + s.blocks - 1) div ({cluster} * 8 div {bits}) + 1"
    rounds = f"""aggregate(sequence(1, 16), named_struct('table', 1L, 'blocks', 1L, 'done', false),
      (s, i) -> if(s.done, s, element_at(transform(array({blocks}), b -> element_at(transform(array((b * 8 - 1) div {cluster} + 1),
        t -> named_struct('table', t, 'blocks', b, 'done', t = s.table AND b = s.blocks)), 1)), 1)),
      s -> if(s.done, named_struct('table', s.table, 'blocks', s.blocks), null))"""
    return df.withColumn("layout", F.expr(rounds))


def measure_qcow2(df: DataFrame, cluster: int = 65536, bits: int = 16, entry: int = 8, luks: int = 0) -> DataFrame:
    """Adds ``required`` and ``full`` bytes to rows of ``(v, units)``: size and units with data."""
    per_table, extra = cluster * (cluster // entry), -(-luks // cluster)
    up = lambda a, b: f"if({a} = 0, 0L, ({a} - 1) div {b}L + 1)"
    df = df.withColumns({"cluster": F.lit(cluster).cast("long"), "bits": F.lit(bits).cast("long"), "l1": F.expr(up("v", per_table)), "full_units": F.expr(up("v", cluster))})
    df = df.withColumn("fixed", F.expr(f"1 + {up('l1 * 8', cluster)} + l1 + {extra}"))
    df = refcount_layout(df.withColumn("used", F.expr("fixed + full_units")))
    meta = F.col("fixed") + F.col("layout.table") + F.col("layout.blocks")
    return df.withColumns({"required": cluster * (meta + F.col("units")), "full": cluster * (meta + F.col("full_units"))}).drop("cluster", "bits", "l1", "full_units", "fixed", "used", "layout")


def measure_vmdk(v: Column, units: Column, kind: str, grain: int = 65536, per_table: int = 512) -> Column:
    full = ceil_div(v, grain)
    tables = ceil_div(full, per_table)
    table_bytes, directory = round_up(F.lit(per_table * 4), SECTOR), F.greatest(round_up(tables * 4, SECTOR), F.lit(SECTOR))
    if kind == "flat":
        return F.struct((v + SECTOR).alias("required"), (v + SECTOR).alias("full"))
    if kind == "sparse":
        total = lambda u: VMDK_DATA_START + u * grain + tables * table_bytes + directory
    else:
        total = lambda u: round_up(VMDK_DATA_START + u * (grain + SECTOR) + tables * (SECTOR + table_bytes) + SECTOR + directory + VMDK_TAIL, STREAM_ALIGN)
    return F.struct(total(units).alias("required"), total(full).alias("full"))


def measure_vhd(v: Column, units: Column, block: int, fixed: bool = False) -> Column:
    if fixed:
        size = round_up(v, SECTOR) + VHD_FOOTER
        return F.struct(size.alias("required"), size.alias("full"))
    entries = ceil_div(v, block)
    bitmap = round_up(F.lit(-(-(block // 512) // 8)).cast("long"), SECTOR)
    total = lambda u: VHD_FOOTER + VHD_HEADER + round_up(entries * 4, SECTOR) + u * (bitmap + block) + VHD_FOOTER
    return F.struct(total(units).alias("required"), total(entries).alias("full"))


def wide(x: Column) -> Column:
    """Room for what 64 bits can't hold: an image's bytes, or a product of counts and sizes."""
    return x.cast("decimal(38,0)")


def units_of(v: Column, unit: Column | int) -> Column:
    """``ceil_div`` of a size that may pass 64 bits; the count itself fits them. Evaluates ``v`` once."""
    unit = unit if isinstance(unit, Column) else F.lit(unit)
    return F.call_function("div", wide(v) + (unit - 1), wide(unit))


def vhdx_block_size(v: Column) -> Column:
    """The default block size by image size; fixed thresholds."""
    return F.when(v > 32 << 40, 64 * MIB).when(v > 100 << 30, 32 * MIB).when(v > 1 << 30, 16 * MIB).otherwise(8 * MIB).cast("long")


def vhdx_layout(v: Column, block: Column, sector: int = 512) -> dict[str, Column]:
    """Chunk ratio, block and table sizes, and where payload begins when the table follows 3 MiB.

    ``v`` may be a decimal beyond 64 bits.
    """
    ratio = div(F.lit((1 << 23) * sector).cast("long"), block)
    payload = units_of(v, block)
    entries = payload + div(F.greatest(payload - 1, F.lit(0)), ratio)
    region = F.greatest(div(entries * 8 + (MIB - 1), MIB) * MIB, F.lit(MIB))
    return {"chunk_ratio": ratio, "payload_blocks": payload, "bat_entries": entries, "bat_bytes": region, "data_start": 3 * MIB + region}


def measure_vhdx(v: Column, units: Column, allocated: Column, block: Column, fixed: bool = False) -> Column:
    """Sizes of a VHDX image of ``v`` bytes, which are rounded up to sectors; a fixed one is dense.

    ``v`` may be a decimal beyond 64 bits; a size that itself passes them is null.
    """
    size = wide(units_of(v, SECTOR)) * SECTOR
    # Blocks are whole sectors: as many hold the rounded size.
    layout = vhdx_layout(v, block)
    if fixed:
        total = (size + (2 * MIB + layout["bat_bytes"] + FIXED_GAP)).try_cast("long")
        return F.struct(total.alias("required"), total.alias("full"))
    each = round_up(block, MIB)
    total = lambda n: (wide(n) * each + layout["data_start"]).try_cast("long")
    return F.struct(total(data_units(units, allocated, block)).alias("required"), total(layout["payload_blocks"]).alias("full"))


#: What each target counts its data in; VHDX by the default block size of the image.
TARGET_UNITS = {"qcow2": 65536, "vmdk_sparse": 65536, "vhd_dynamic": 2 * MIB, "vhdx_dynamic": None, "raw": SECTOR}


def measure_extents(extents: DataFrame) -> DataFrame:
    """``(image_id, target, required, fully_allocated)`` of images given by their extents.

    Each target counts the units of its own size that hold data; an image whose allocation
    is larger than itself can't be measured and has null sizes.
    """
    rows = allocations(extents, [SECTOR, 65536, 2 * MIB, 8 * MIB, 16 * MIB, 32 * MIB, 64 * MIB])
    v, u, held, unit = (F.col(c) for c in ("virtual_size", "units", "allocated_bytes", "unit"))
    # Whatever counts in the same unit is told by the same row.
    rows = measure_qcow2(rows.withColumn("v", v)).drop("v")
    sized = lambda name, chosen, m: F.when(chosen, F.struct(F.lit(name).alias("target"), m["required"].cast("long").alias("required"), m["full"].cast("long").alias("fully_allocated")))
    made = [
        sized("raw", unit == SECTOR, F.struct(v.alias("required"), v.alias("full"))),
        sized("qcow2", unit == 65536, F.struct(F.col("required"), F.col("full"))),
        sized("vmdk_sparse", unit == 65536, measure_vmdk(v, u, "sparse")),
        sized("vhd_dynamic", unit == 2 * MIB, measure_vhd(v, u, 2 * MIB)),
        sized("vhdx_dynamic", unit == vhdx_block_size(v), measure_vhdx(v, u, held, unit)),
    ]
    return rows.select("image_id", F.explode(F.array_compact(F.array(*made))).alias("m")).select("image_id", "m.*")


def qcow2_layout(images: DataFrame, cluster: int = 65536, bits: int = 16, entry: int = 8) -> DataFrame:
    """Where a new image's structures lie: ``images(image_id, v, preallocated)``.

    Header, L1, refcount table and blocks, then (preallocated) L2 tables and data. Sizes of
    0 and tables of more than ``MOST_L1`` entries are refused: null columns, and a reason.
    """
    per_table = cluster * (cluster // entry)
    rows = images.withColumn("l1_entries", F.when(F.col("v") == 0, 0).otherwise(F.expr(f"(v - 1) div {per_table} + 1")))
    rows = rows.withColumn("refusal", F.when((F.col("v") == 0) | (F.col("l1_entries") > MOST_L1), "invalid_size"))
    rows = rows.withColumn("l1_clusters", F.greatest(ceil_div(F.col("l1_entries") * 8, cluster), F.lit(1).cast("long")))
    full = F.col("preallocated")
    rows = rows.withColumn("l2_clusters", F.when(full, F.col("l1_entries")).otherwise(0).cast("long")).withColumn("data_clusters", F.when(full, ceil_div(F.col("v"), cluster)).otherwise(0).cast("long"))
    rows = refcount_layout(rows.withColumns({"used": F.expr("1 + l1_clusters + l2_clusters + data_clusters"), "cluster": F.lit(cluster).cast("long"), "bits": F.lit(bits).cast("long")}))
    table = (1 + F.col("l1_clusters")) * cluster
    blocks = table + F.col("layout.table") * cluster
    l2 = blocks + F.col("layout.blocks") * cluster
    data = l2 + F.col("l2_clusters") * cluster
    columns = {"l1_offset": F.lit(cluster).cast("long"), "refcount_table": table, "refcount_blocks": blocks, "l2_offset": l2, "data_offset": data, "file_size": data + F.col("data_clusters") * cluster}
    return rows.select("image_id", "refusal", *(F.when(F.col("refusal").isNull(), c).alias(k) for k, c in columns.items()))


def fixed_bat(layouts: DataFrame) -> DataFrame:
    """Entries of a dense table: a bitmap slot closes each group, and its entry is 0."""
    rows = layouts.withColumn("slot", F.explode(F.expr("sequence(0L, bat_entries - 1)")))
    bitmap = F.expr("slot % (chunk_ratio + 1) = chunk_ratio")
    offset = F.expr("(slot - slot div (chunk_ratio + 1)) * block_size + data_start")
    return rows.select("image_id", "slot", bitmap.alias("is_bitmap"), F.when(bitmap, 0).otherwise(offset + 6).alias("entry"))
