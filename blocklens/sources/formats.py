"""Format detection and header decoding as expressions over header and tail bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.functions.scalars import big_endian, div, little_endian

#: Magic bytes; fixed values.
MAGIC = {"qfi": b"QFI\xfb", "vmdk": b"KDMV", "cowd": b"COWD", "qed": b"QED\0", "vhdx": b"vhdxfile", "vhd": b"conectix", "vdi": b"\x7f\x10\xda\xbe", "luks": b"LUKS\xba\xbe", "iso": b"CD001"}
PARALLELS = (b"WithoutFreeSpace", b"WithouFreSpacExt")
BOCHS = (b"Bochs Virtual HD Image", b"Redolog", b"Growing")
CLOOP = b"#!/bin/sh\n#V2.0 Format\nmodprobe cloop file=$0 && mount -r -t iso9660 /dev/cloop $1\n"
DESCRIPTOR = b"# Disk DescriptorFile"
#: Bounds of a cloop image's block size and block count; fixed values.
CLOOP_BLOCK, CLOOP_BLOCKS = 64 << 20, ((1 << 32) - 2) // 8


def at(header: Column, offset: int, size: int) -> Column:
    return F.hex(F.substring(header, offset + 1, size))


def holds(header: Column, offset: int, raw: bytes) -> Column:
    return at(header, offset, len(raw)) == raw.hex().upper()


def text_at(header: Column, offset: int, size: int) -> Column:
    """The NUL-terminated text of a field, as hex; null if it isn't terminated."""
    raw = at(header, offset, size)
    return F.regexp_extract(raw, "^((?:..)*?)00", 1)


def detect_format(header: Column) -> Column:
    """The first test that matches names the format; content only, never the file's name."""
    size = F.octet_length(header)
    bochs = F.lit(True)
    for (offset, width), name in zip(((0, 32), (32, 16), (48, 16)), BOCHS, strict=True):
        bochs = bochs & (text_at(header, offset, width) == name.hex().upper())
    return (
        F.when(size < 8, "unknown")
        .when(holds(header, 0, MAGIC["qfi"]), F.when(big_endian(header, 4, 4) == 1, "qcow").otherwise("qcow2"))
        .when(holds(header, 0, MAGIC["vmdk"]), "vmdk")
        .when(holds(header, 0, MAGIC["cowd"]), "vmdk3")
        .when(holds(header, 0, MAGIC["qed"]), "qed")
        .when(holds(header, 0, MAGIC["vhdx"]), "vhdx")
        .when(holds(header, 0, MAGIC["vhd"]), "vhd")
        .when(holds(header, 64, MAGIC["vdi"]), "vdi")
        .when(holds(header, 0, MAGIC["luks"]), "luks")
        .when((size >= 64) & (holds(header, 0, PARALLELS[0]) | holds(header, 0, PARALLELS[1])) & (little_endian(header, 16, 4) == 2), "parallels")
        .when((size >= 512) & bochs & little_endian(header, 64, 4).isin(0x10000, 0x20000), "bochs")
        .when(holds(header, 0, CLOOP), "cloop")
        .when(holds(header, 0, DESCRIPTOR), "vmdk")
        .otherwise("raw")
    )


def vhd_checksum(footer: Column, size: int = 512) -> Column:
    """Ones' complement of the byte sum, the checksum's own four bytes left out."""
    bytes_ = F.expr("sequence(0, 511)") if size == 512 else F.expr(f"sequence(0, {size - 1})")
    total = F.aggregate(bytes_, F.lit(0).cast("long"), lambda s, i: s + F.when(i.between(64, 67), 0).otherwise(F.conv(F.hex(footer.substr(i + 1, F.lit(1))), 16, 10).cast("long")))
    return F.lit(0xFFFFFFFF) - total


def detect_tail(tail: Column) -> Column:
    """VHD by its footer: the cookie and a right checksum, else raw."""
    good = holds(tail, 0, MAGIC["vhd"]) & (big_endian(tail, 64, 4) == vhd_checksum(tail))
    return F.when((F.octet_length(tail) == 512) & good, "vhd").otherwise("raw")


def is_iso(sector: Column) -> Column:
    """The volume descriptor's mark, at byte 32769 of an image."""
    return holds(sector, 1, MAGIC["iso"])


def partition_table(sector: Column) -> Column:
    """``none``, ``mbr`` or ``gpt`` of a first sector; an invalid boot mark refutes it."""
    entries = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.hex(sector.substr(i * 16 + 447, F.lit(1))).alias("boot"), F.hex(sector.substr(i * 16 + 451, F.lit(1))).alias("kind")))
    used = F.filter(entries, lambda e: e["kind"] != "00")
    bad = F.exists(used, lambda e: ~e["boot"].isin("00", "80"))
    gpt = F.exists(used, lambda e: e["kind"] == "EE")
    return F.when((F.octet_length(sector) < 512) | (at(sector, 510, 2) != "55AA") | bad, "none").when(gpt, "gpt").otherwise("mbr")


def descriptor_extents(lines: DataFrame) -> DataFrame:
    """Extent lines ``ACCESS sectors KIND "file" offset`` of text descriptors; others are left out."""
    pattern = r'^\s*(RW|RDONLY|NOACCESS)\s+([0-9]+)\s+([A-Z0-9]+)(?:\s+"([^"]*)"(?:\s+([0-9]+))?)?\s*$'
    part = lambda i: F.regexp_extract("line", pattern, i)
    found = lines.filter(F.col("line").rlike(pattern))
    return found.select("image_id", "line_no", part(1).alias("access"), part(2).cast("long").alias("sectors"), part(3).alias("kind"), F.nullif(part(4), F.lit("")).alias("file"), F.coalesce(F.expr("try_cast(nullif({0}, '') as bigint)".format(f"regexp_extract(line, r'{pattern}', 5)")), F.lit(0)).alias("offset"))


def info(headers: DataFrame) -> DataFrame:
    """One row per image of ``headers(path, header)``: format, version, sizes and flags."""
    h, fmt = F.col("header"), F.col("format")
    found = headers.withColumn("format", detect_format(h))
    disk = F.when(little_endian(h, 64, 4) == 0x20000, little_endian(h, 88, 8)).otherwise(little_endian(h, 84, 8)).cast("long")
    block, blocks = big_endian(h, 128, 4), big_endian(h, 132, 4)
    cloop = F.when((block > 0) & (block % 512 == 0) & (block <= CLOOP_BLOCK) & (blocks <= CLOOP_BLOCKS), block * blocks)
    cluster = F.call_function("shiftleft", F.lit(1).cast("long"), (big_endian(h, 20, 4) % 64).cast("int"))
    return found.select(
        "path",
        "format",
        F.when(fmt.isin("qcow2", "qcow"), big_endian(h, 4, 4)).when(fmt.isin("vmdk", "vmdk3"), little_endian(h, 4, 4)).alias("version"),
        F.when(fmt.isin("qcow2", "qcow"), big_endian(h, 24, 8)).when(fmt == "vhd", big_endian(h, 48, 8)).when(fmt == "vmdk", little_endian(h, 12, 8) * 512).when(fmt == "vdi", little_endian(h, 368, 8)).when(fmt == "parallels", little_endian(h, 36, 8) * 512).when(fmt == "qed", little_endian(h, 48, 8)).when(fmt == "bochs", div(disk, 512) * 512).when(fmt == "cloop", cloop).alias("virtual_size"),
        F.when(fmt == "qcow2", cluster).when(fmt == "vdi", little_endian(h, 376, 4)).when(fmt == "qed", little_endian(h, 4, 4)).alias("cluster_size"),
        F.when(fmt.isin("qcow2", "qcow"), big_endian(h, 8, 8) != 0).when(fmt == "qed", (little_endian(h, 56, 4) > 0) & (little_endian(h, 60, 4) > 0)).otherwise(False).alias("has_backing"),
        F.when(fmt == "qcow2", big_endian(h, 32, 4) != 0).when(fmt == "luks", True).otherwise(False).alias("encrypted"),
    )


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, header)`` of files; meant for descriptors and images that a task can hold."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 65536).alias("header"))


def newest_header(headers: DataFrame) -> DataFrame:
    """Of an image's header copies the valid one of the highest sequence number."""
    return headers.filter("valid").groupBy("image_id").agg(F.max_by(F.struct("slot", "sequence"), "sequence").alias("h")).select("image_id", "h.slot", "h.sequence")
