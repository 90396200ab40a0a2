"""Backing references against an allow-list, over a listing of the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scalars import normal_path


def allowed_by(path: Column, prefixes: list[str]) -> Column:
    """Whether a normal path is an entry of the list or lies below one."""
    entries = F.array(*(F.lit(p.rstrip("/")) for p in prefixes)) if prefixes else F.expr("cast(array() as array<string>)")
    return F.exists(entries, lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/"))))


def file_name(reference: Column) -> Column:
    """The last component; null where it is ``..`` or missing."""
    name = F.regexp_extract(reference, r"([^/]+)(?:/+\.?)*$", 1)
    return F.when(~name.isin("", ".", ".."), name)


def resolve_references(references: DataFrame, files: DataFrame, prefixes: list[str]) -> DataFrame:
    """``(ref_id, outcome, path)`` of ``references(ref_id, image, reference, writes)``.

    ``files(path, physical)`` lists what exists, with where each path leads once links are
    followed (null: they run in a circle). ``prefixes`` is the operator's short list. The
    spelling is tested before the listing is asked, so an outcome tells nothing about files
    outside the list: a spelling outside is ``not_allowed``, whether the file is there or
    not; a link that leads out is ``not_allowed``; a circle is ``loop``; ``not_found`` is
    said of allowed spellings only. An absolute reference that can't be used as written is
    looked for by its name beside the image (``beside``), unless it is to be written to.
    A null or empty reference names no file: ``none``.
    """
    folder = F.regexp_extract("image", "^(.*)/[^/]*$", 1)
    absolute = F.col("reference").startswith("/")
    by_name = absolute & ~F.coalesce("writes", F.lit(False))
    asked = references.select(
        "ref_id",
        F.coalesce(F.col("reference") == "", F.lit(True)).alias("none"),
        normal_path(F.when(absolute, F.col("reference")).otherwise(F.concat(folder, F.lit("/"), "reference"))).alias("candidate"),
        F.when(by_name, normal_path(F.concat(folder, F.lit("/"), file_name(F.col("reference"))))).alias("beside"),
    ).select("*", allowed_by(F.col("candidate"), prefixes).alias("inside"), F.coalesce(allowed_by(F.col("beside"), prefixes), F.lit(False)).alias("beside_inside"))

    def listed(side: str) -> DataFrame:
        return files.select(F.col("path").alias(f"{side}_path"), F.col("physical").alias(f"{side}_physical")).dropDuplicates([f"{side}_path"])

    # Only allowed spellings are looked up.
    first, second = listed("first"), listed("second")
    found = asked.join(first, (F.col("candidate") == F.col("first_path")) & F.col("inside"), "left").join(second, (F.col("beside") == F.col("second_path")) & F.col("beside_inside"), "left")
    exists = F.col("first_path").isNotNull()
    good = allowed_by(F.col("first_physical"), prefixes)
    instead = F.coalesce(allowed_by(F.col("second_physical"), prefixes), F.lit(False))
    outcome = (
        F.when(F.col("none"), "none")
        .when(exists & F.col("first_physical").isNull(), "loop")
        .when(exists & good, "found")
        .when(exists, "not_allowed")
        .when(instead, "beside")
        .when(F.col("inside"), "not_found")
        .otherwise("not_allowed")
    )
    return found.select("ref_id", outcome.alias("outcome"), "first_physical", "second_physical").select(
        "ref_id", "outcome", F.when(F.col("outcome") == "found", F.col("first_physical")).when(F.col("outcome") == "beside", F.col("second_physical")).alias("path")
    )
