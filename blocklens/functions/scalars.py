"""Scalar functions as column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format codes and the names they print as; fixed values.
FORMAT_NAMES = {0: "unknown", 1: "raw", 2: "qcow2", 3: "vmdk", 4: "vmdk3", 5: "vhd", 6: "vhdx", 7: "qcow", 8: "vdi", 9: "qed", 10: "iso", 11: "luks", 12: "vmdk", 13: "parallels", 14: "bochs", 15: "cloop", 16: "dmg"}
#: The most sectors that CHS geometry addresses: 65535 cylinders, 16 heads, 255 sectors.
MOST_CHS_SECTORS = 65535 * 16 * 255
SUFFIXES = "BKMGTPE"


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def ceil_div(a: Column, b: Column | int) -> Column:
    """0 for 0, without the overflow of adding first."""
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(div(a - 1, b) + 1)


def round_up(a: Column, b: Column | int) -> Column:
    return ceil_div(a, b) * b


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def checked_sum(a: Column, b: Column) -> Column:
    """Null where the sum overflows."""
    return F.try_add(a, b)


def checked_product(a: Column, b: Column) -> Column:
    """Null where the product overflows."""
    return F.try_multiply(a, b)


def parse_size(text: Column) -> Column:
    """``[+]digits[.fraction][suffix]``; a fraction needs a scaling suffix; halves round up.

    The fraction is carried through a double. What the grammar refuses is null.
    """
    trimmed = F.trim(text)
    pattern = r"^\+?([0-9]+)(\.[0-9]+)?([BbKkMmGgTtPpEe])?$"
    whole, part = F.regexp_extract(trimmed, pattern, 1), F.regexp_extract(trimmed, pattern, 2)
    suffix = F.upper(F.regexp_extract(trimmed, pattern, 3))
    power = F.greatest(F.instr(F.lit(SUFFIXES), F.when(suffix == "", "B").otherwise(suffix)) - 1, F.lit(0))
    scale = F.element_at(F.array(*(F.lit(1 << (10 * i)).cast("long") for i in range(7))), (power + 1).cast("int"))
    value = whole.cast("decimal(20,0)") * scale.cast("decimal(20,0)")
    fraction = F.floor(F.when(part == "", 0.0).otherwise(F.concat(F.lit("0"), part).cast("double")) * scale.cast("double") + 0.5).cast("decimal(20,0)")
    legal = trimmed.rlike(pattern) & ((part == "") | (power > 0))
    return F.when(legal, (value + fraction)).cast("decimal(38,0)")


def human_bytes(n: Column) -> Column:
    two = lambda unit, name: F.concat(F.format_string("%.2f", n.cast("double") / unit), F.lit(f" {name}"))
    return F.when(n >= 1 << 30, two(float(1 << 30), "GB")).when(n >= 1 << 20, two(float(1 << 20), "MB")).when(n >= 1 << 10, two(1024.0, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def safe_rate(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def version_parts(text: Column) -> Column:
    """``(major, minor)`` of the first dotted number in a banner; null without one."""
    major, minor = (F.regexp_extract(text, r"([0-9]+)\.([0-9]+)", i) for i in (1, 2))
    return F.when(major != "", F.struct(major.cast("int").alias("major"), minor.cast("int").alias("minor")))


#: Control characters and direction marks; fixed values.
UNSAFE = r"[\x00-\x1f\x7f-\x9f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"


def escaped(text: Column, named: dict[str, str], form: str) -> Column:
    """Characters written out: the named ones, and unsafe ones by their number in ``form``."""
    def one(c: Column) -> Column:
        out = F.when(c.rlike(UNSAFE), F.format_string(form, F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int"))).otherwise(c)
        for sign, written in named.items():
            out = F.when(c == sign, F.lit(written)).otherwise(out)
        return out

    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: one(text.substr(i, F.lit(1))))
    return F.when(text == "", "").otherwise(F.array_join(each, ""))


def escape_terminal(text: Column) -> Column:
    """Control characters and direction marks written out, so that a terminal shows them."""
    return escaped(text, {"\n": "\\n", "\r": "\\r", "\t": "\\t"}, "\\u{%x}")


def escape_json(text: Column) -> Column:
    """The inside of a JSON string; direction marks are written out as well."""
    return escaped(text, {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}, "\\u%04x")


def relative_path(value: Column) -> Column:
    """A stored relative path with forward slashes and without a leading dot; null if nothing is left."""
    body = F.regexp_replace(value, r"^\.\\", "")
    return F.when(body != "", F.translate(body, "\\", "/"))


def utf16_bytes(text: Column, big: bool) -> Column:
    """The text's units, without a mark at the front."""
    return F.encode(text, "UTF-16BE" if big else "UTF-16LE")


def base64_bytes(text: Column) -> Column:
    """Decoded up to the first character outside the alphabet; padding at the end is not needed.

    A last group of one character holds no byte.
    """
    body = F.regexp_extract(F.rtrim(text, F.lit("=")), "^[A-Za-z0-9+/]*", 0)
    whole = F.when(F.length(body) % 4 == 1, F.substring(body, F.lit(1), (F.length(body) - 1).cast("int"))).otherwise(body)
    return F.unbase64(F.rpad(whole, F.ceil(F.length(whole) / 4).cast("int") * 4, "="))


def normal_path(path: Column) -> Column:
    """``.`` and empty components dropped, ``..`` resolved; never above the root of an absolute path."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.expr("cast(array() as array<string>)"),
        lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when((x == "..") & path.startswith("/"), a).otherwise(F.concat(a, F.array(x))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def utf16_text(raw: Column, big: bool) -> Column:
    """Text up to the first NUL; null for an odd length or a surrogate without its partner before it."""
    half = div(F.octet_length(raw), 2)
    digits = F.hex(raw)
    pair = lambda i, at: F.substring(digits, (i * 4 + at).cast("int"), F.lit(2))
    unit = lambda i: F.concat(pair(i, 1), pair(i, 3)) if big else F.concat(pair(i, 3), pair(i, 1))
    units = F.when(half > 0, F.transform(F.sequence(F.lit(0).cast("long"), half - 1), unit)).otherwise(F.expr("cast(array() as array<string>)"))
    nul = F.array_position(units, "0000").cast("int")
    kept = F.when(nul > 0, F.slice(units, F.lit(1), nul - 1)).otherwise(units)
    high, low = (lambda u: F.coalesce(u.between("D800", "DBFF"), F.lit(False))), (lambda u: F.coalesce(u.between("DC00", "DFFF"), F.lit(False)))
    # Each high unit is followed by a low one, each low one follows a high one.
    broken = F.exists(F.arrays_zip(kept.alias("a"), F.concat(F.array(F.lit("")), kept).alias("b")), lambda p: high(p["b"]) != low(p["a"]))
    return F.when((F.octet_length(raw) % 2 == 0) & ~broken, F.decode(F.unhex(F.array_join(kept, "")), "UTF-16BE"))


def vm_clock(nanos: Column) -> Column:
    """``HHHH:MM:SS.mmm``."""
    ms = div(nanos, 1_000_000)
    return F.format_string("%04d:%02d:%02d.%03d", div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000)


def big_endian(raw: Column, at: int, size: int) -> Column:
    """An unsigned field of at most 7 bytes (longer ones as decimal) of a binary column."""
    number = F.conv(F.hex(F.substring(raw, at + 1, size)), 16, 10)
    return number.cast("long") if size < 8 else number.cast("decimal(20,0)")


def little_endian(raw: Column, at: int, size: int) -> Column:
    bytes_ = [F.hex(F.substring(raw, at + i + 1, 1)) for i in reversed(range(size))]
    number = F.conv(F.concat(*bytes_), 16, 10)
    return number.cast("long") if size < 8 else number.cast("decimal(20,0)")


def format_name(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FORMAT_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("unknown"))
