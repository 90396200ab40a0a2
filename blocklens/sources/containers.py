"""Tables inside containers' headers and trailers: VHDX regions and metadata, LUKS, DMG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scalars import big_endian, little_endian
from blocklens.sources.formats import at

#: Identifiers of regions and metadata items, as their specification prints them; fixed values.
REGIONS = {"bat": "2DC27766-F623-4200-9D64-115E9BFD4A08", "metadata": "8B7CA206-4790-4B9A-B8FE-575F050F886E"}
ITEMS = {
    "file_parameters": "CAA16737-FA36-4D43-B3B6-33F0AA44E76B",
    "virtual_disk_size": "2FA54224-CD1B-4876-B211-5DBED83BF4B8",
    "page_83_data": "BECA12AB-B2E6-4523-93EF-C309E000C746",
    "logical_sector_size": "8141BF1D-A96F-4709-BA47-F233A8FAAB5F",
    "physical_sector_size": "CDA348C7-445D-4471-9CC9-E9885251C556",
    "parent_locator": "A8D35F2D-B30B-454D-ABF7-D3D84834AB0C",
}
MOST_REGIONS, MOST_ITEMS = 2047, 2047
KEY_ENABLED = 0x00AC71F3


def stored(identifier: str) -> str:
    """The sixteen bytes of an identifier as hex: the first three groups are little-endian."""
    a, b, c, d, e = identifier.split("-")
    return "".join(bytes.fromhex(x)[::-1].hex() for x in (a, b, c)).upper() + d + e


def named(raw: Column, names: dict[str, str]) -> Column:
    """The name of a 16-byte identifier, or ``unknown``."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for name, text in names.items() for x in (stored(text), name))), at(raw, 0, 16)), F.lit("unknown"))


def entries(raw: Column, first: int, size: int, count: Column) -> Column:
    """Whole entries of a table, as binaries; those past the end of ``raw`` are left out."""
    n = F.least(count, F.floor((F.octet_length(raw) - first) / size).cast("long"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(raw, (i * size + first + 1).cast("int"), F.lit(size)))).otherwise(F.expr("cast(array() as array<binary>)"))


def vhdx_regions(tables: DataFrame) -> DataFrame:
    """``(image_id, region, file_offset, length, required)`` of ``tables(image_id, raw, good)``.

    ``good`` says whether the table's checksum is right; tables without it, without the
    signature or of too many entries give no rows.
    """
    raw = F.col("raw")
    valid = F.col("good") & (at(raw, 0, 4) == "72656769") & (little_endian(raw, 8, 4) <= MOST_REGIONS)
    e = F.col("e")
    found = tables.filter(valid).select("image_id", F.explode(entries(raw, 16, 32, little_endian(raw, 8, 4))).alias("e"))
    return found.select("image_id", named(e, REGIONS).alias("region"), little_endian(e, 16, 8).cast("long").alias("file_offset"), little_endian(e, 24, 4).alias("length"), (little_endian(e, 28, 4) % 2 == 1).alias("required"))


def usable_regions(regions: DataFrame) -> DataFrame:
    """Per image whether both regions are there and no other one is required."""
    seen = lambda name: F.max(F.col("region") == name)
    return regions.groupBy("image_id").agg(seen("bat").alias("has_bat"), seen("metadata").alias("has_metadata"), F.max((F.col("region") == "unknown") & F.col("required")).alias("foreign")).select("image_id", (F.col("has_bat") & F.col("has_metadata") & ~F.col("foreign")).alias("usable"))


def vhdx_metadata(tables: DataFrame) -> DataFrame:
    """``(image_id, item, item_offset, length, user, virtual_disk, required)`` of ``tables(image_id, raw)``."""
    raw = F.col("raw")
    count = little_endian(raw, 10, 2)
    e, flags = F.col("e"), little_endian(F.col("e"), 24, 4)
    found = tables.filter((at(raw, 0, 8) == "6D65746164617461") & (count <= MOST_ITEMS)).select("image_id", F.explode(entries(raw, 32, 32, count)).alias("e"))
    return found.select("image_id", named(e, ITEMS).alias("item"), little_endian(e, 16, 4).alias("item_offset"), little_endian(e, 20, 4).alias("length"), *((F.call_function("shiftright", flags.cast("int"), F.lit(bit)) % 2 == 1).alias(name) for bit, name in enumerate(("user", "virtual_disk", "required"))))


def field_text(raw: Column, offset: int, size: int) -> Column:
    """A NUL-padded ASCII field."""
    return F.substring_index(F.decode(F.substring(raw, offset + 1, size), "ISO-8859-1"), "\0", 1)


def luks1(headers: DataFrame) -> DataFrame:
    """The header of version 1, with one row for every enabled key slot; ``headers(image_id, raw)``."""
    raw, s = F.col("raw"), F.col("s")
    whole = headers.filter((at(raw, 0, 6) == "4C554B53BABE") & (big_endian(raw, 6, 2) == 1) & (F.octet_length(raw) >= 592))
    slots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("slot"), F.substring(raw, i * 48 + 209, F.lit(48)).alias("bytes")))
    found = whole.select("image_id", field_text(raw, 8, 32).alias("cipher"), field_text(raw, 40, 32).alias("mode"), field_text(raw, 72, 32).alias("hash"), (big_endian(raw, 104, 4) * 512).alias("payload_offset"), big_endian(raw, 108, 4).alias("key_bytes"), field_text(raw, 168, 40).alias("uuid"), F.explode(slots).alias("s"))
    b = s["bytes"]
    return found.filter(big_endian(b, 0, 4) == KEY_ENABLED).select("image_id", "cipher", "mode", "hash", "payload_offset", "key_bytes", "uuid", s["slot"].alias("slot"), big_endian(b, 4, 4).alias("iterations"), (big_endian(b, 40, 4) * 512).alias("key_offset"), big_endian(b, 44, 4).alias("stripes"))


def luks2_segments(headers: DataFrame) -> DataFrame:
    """Data segments of version 2's JSON area; ``headers(image_id, json)``. A size of ``dynamic`` is null."""
    shape = "segments map<string, struct<type: string, offset: string, size: string, encryption: string, sector_size: bigint>>"
    parsed = headers.select("image_id", F.from_json("json", shape)["segments"].alias("segments"))
    v = F.col("value")
    return parsed.select("image_id", F.explode("segments").alias("segment", "value")).select("image_id", "segment", v["type"].alias("type"), F.expr("try_cast(value.offset AS bigint)").alias("start"), F.expr("try_cast(value.size AS bigint)").alias("length"), v["encryption"].alias("encryption"), v["sector_size"].alias("sector_size"))


def dmg_trailers(tails: DataFrame) -> DataFrame:
    """The trailer of ``tails(image_id, tail, length)``: where it begins and its fields.

    ``tail`` holds the file's last bytes. The trailer may begin anywhere from 1023 to 512
    bytes before the end; the earliest mark counts. Files without one give no row.
    """
    tail, size = F.col("tail"), F.octet_length("tail").cast("long")
    from_ = F.greatest(size - 1023, F.lit(0))
    # One character per byte, so that positions in the text are positions in the tail.
    place = F.expr("cast(locate('koly', decode(tail, 'ISO-8859-1'), cast(greatest(octet_length(tail) - 1023, 0) + 1 as int)) as long)") - 1
    found = tails.filter(F.col("length") >= 512).select("image_id", "length", "tail", place.alias("place"), from_.alias("from")).filter((F.col("place") >= F.col("from")) & (F.col("place") <= F.octet_length("tail") - 512))
    body = F.substring(tail, (F.col("place") + 1).cast("int"), F.lit(512))
    return found.select("image_id", (F.col("length") - size + F.col("place")).alias("koly_offset"), body.alias("b")).select("image_id", "koly_offset", *(big_endian(F.col("b"), o, 8).cast("long").alias(name) for o, name in ((0x18, "data_fork_offset"), (0x28, "resource_offset"), (0x30, "resource_length"), (0xD8, "xml_offset"), (0xE0, "xml_length"), (0x1EC, "sectors"))))


def parsed_snapshots(raw: Column, n: Column) -> Column:
    """Entries of a snapshot table one after another; ``(at, whole, entries)``.

    An entry is 40 fixed bytes, extra data, id and name, and fills up to eight bytes. One
    that reaches past the end stops the walk: the table is not whole.
    """
    def field(offset: int, size: int, at: Column) -> Column:
        number = F.conv(F.hex(raw.substr((at + offset + 1).cast("int"), F.lit(size))), 16, 10)
        return F.coalesce(number.cast("long"), F.lit(0).cast("long"))

    entry = "struct<id: string, name: string, l1_offset: bigint, l1_size: bigint, seconds: bigint, vm_clock: bigint>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("whole"), F.expr(f"cast(array() as array<{entry}>)").alias("entries"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        texts = at + 40 + field(36, 4, at)
        ids, names = field(12, 2, at), field(14, 2, at)
        end = texts + ids + names
        fits = s["whole"] & (at + 40 <= F.octet_length(raw)) & (end <= F.octet_length(raw))
        text = lambda begin, size: F.decode(raw.substr((begin + 1).cast("int"), size.cast("int")), "UTF-8")
        own = F.struct(text(texts, ids).alias("id"), text(texts + ids, names).alias("name"), field(0, 8, at).alias("l1_offset"), field(8, 4, at).alias("l1_size"), field(16, 4, at).alias("seconds"), field(24, 8, at).alias("vm_clock"))
        after = F.floor((end + 7) / 8).cast("long") * 8
        return F.struct(F.when(fits, after).otherwise(at).alias("at"), fits.alias("whole"), F.when(fits, F.concat(s["entries"], F.array(own))).otherwise(s["entries"]).alias("entries"))

    return F.aggregate(F.sequence(F.lit(1), n), start, step)


def snapshot_tables(tables: DataFrame) -> DataFrame:
    """Whether each of ``tables(image_id, raw, n)`` holds its ``n`` entries."""
    return tables.select("image_id", parsed_snapshots(F.col("raw"), F.col("n"))["whole"].alias("whole"))


def snapshot_entries(tables: DataFrame) -> DataFrame:
    """``(image_id, ordinal, id, name, l1_offset, l1_size, seconds, vm_clock, whole)``; a table that is not whole aborts its operation."""
    parsed = tables.select("image_id", parsed_snapshots(F.col("raw"), F.col("n")).alias("t"))
    return parsed.select("image_id", "t.whole", F.posexplode("t.entries").alias("ordinal", "e")).select("image_id", "ordinal", "e.*", "whole")
