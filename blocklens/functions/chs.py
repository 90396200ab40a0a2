"""Cylinder, head and sector geometry of VHD footers, as expressions.

A footer's geometry depends on the sector count alone, and is constant in (heads, sectors
per track) over a few ranges of it. The ranges are listed once, so that the least geometry
which covers a request is picked from one candidate per range instead of being searched
sector by sector.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from blocklens.functions.scalars import MOST_CHS_SECTORS, ceil_div, div

#: Sectors per track of small, middle, large and the largest disks; fixed values.
TRACKS = (17, 31, 63, 255)
MOST_HEADS, LEAST_HEADS, MOST_CYLINDERS = 16, 4, 1024
#: From here on only the longest track will do.
LONGEST_FROM = 65535 * 16 * 63


@cache
def ranges() -> tuple[tuple[int, int, int, int], ...]:
    """``(first, last, heads, sectors per track)`` of every range of sector counts.

    With the shortest track, heads grow with the tracks; a count of tracks that fills the
    last cylinder of its heads already takes the next longer track.
    """
    short, middle, long, longest = TRACKS
    out, first = [], 0
    for heads in range(LEAST_HEADS, MOST_HEADS + 1):
        full = heads * MOST_CYLINDERS * short
        out += [(first, full - 1, heads, short), (full, full + short - 1, MOST_HEADS, middle)]
        first = full + short
    turn = MOST_HEADS * MOST_CYLINDERS * middle
    out += [(first, turn - 1, MOST_HEADS, middle), (turn, LONGEST_FROM - 1, MOST_HEADS, long), (LONGEST_FROM, MOST_CHS_SECTORS, MOST_HEADS, longest)]
    return tuple(out)


def listed() -> Column:
    """The ranges as one constant array, which keeps the generated code short."""
    rows = (F.struct(F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"), F.lit(heads).alias("heads"), F.lit(track).alias("track")) for first, last, heads, track in ranges())
    return F.array(*rows)


def per_cylinder(r: Column) -> Column:
    return (r["heads"] * r["track"]).cast("long")


def geometry(sectors: Column, r: Column) -> list[Column]:
    return [div(sectors, per_cylinder(r)).alias("cylinders"), r["heads"].alias("heads"), r["track"].alias("track")]


def floor_geometry(sectors: Column) -> Column:
    """The geometry of a sector count; it may address fewer sectors, never more."""
    sectors = F.least(sectors.cast("long"), F.lit(MOST_CHS_SECTORS))
    return F.element_at(F.transform(F.filter(listed(), lambda r: sectors <= r["last"]), lambda r: F.struct(*geometry(sectors, r))), 1)


def covering_geometry(size: Column) -> Column:
    """The geometry of the least sector count whose geometry covers ``size`` bytes; zeros for 0."""
    wanted = F.least(ceil_div(size.cast("long"), 512), F.lit(MOST_CHS_SECTORS))
    # The least count of each range whose whole cylinders cover the request.
    least = lambda r: F.greatest(ceil_div(wanted, per_cylinder(r)) * per_cylinder(r), r["first"])
    found = F.array_min(F.transform(F.filter(listed(), lambda r: least(r) <= r["last"]), least))
    zeros = F.struct(F.lit(0).cast("long").alias("cylinders"), F.lit(0).alias("heads"), F.lit(0).alias("track"))
    return F.when(size == 0, zeros).otherwise(floor_geometry(found))


def addressed(g: Column) -> Column:
    return g["cylinders"] * g["heads"] * g["track"]


def rounded_size(size: Column, covering: Column) -> Column:
    """What an image of ``size`` bytes is rounded up to; at the largest geometry the request stays."""
    asked = F.least(ceil_div(size.cast("long"), 512), F.lit(MOST_CHS_SECTORS))
    return F.when(addressed(covering) == MOST_CHS_SECTORS, asked).otherwise(addressed(covering)) * 512


def footer_geometry(size: Column, covering: Column) -> Column:
    """What a footer states: the covering geometry for a size that is already rounded, else the floor."""
    return F.when(rounded_size(size, covering) == size, covering).otherwise(floor_geometry(div(size, 512)))
