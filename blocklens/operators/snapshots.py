"""Snapshot tables, reference-count changes and cluster allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.operators.chains import last_before

#: The most snapshots an image may have; fixed value.
MOST_SNAPSHOTS = 16
ID, NAME = 0, 1


def decimal_id(text: Column) -> Column:
    """Leading digits as a number; none, or more than 64 bits hold, is 0."""
    digits = F.regexp_extract(text, "^[0-9]+", 0)
    value = F.try_to_number(F.when(F.length(digits).between(1, 20), digits), F.lit("9" * 20)).cast("decimal(20,0)")
    return F.when(value.isNull() | (value > F.lit("18446744073709551615").cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).otherwise(value)


def lookup(table: DataFrame, needles: DataFrame, name_only: bool = False) -> DataFrame:
    """First match in table order for each needle; an id anywhere beats a name."""
    by_name = needles.join(table, needles["needle"] == table["name"]).select("needle", F.lit(NAME).alias("how"), "ordinal")
    found = by_name
    if not name_only:
        found = needles.join(table, needles["needle"] == table["id"]).select("needle", F.lit(ID).alias("how"), "ordinal").unionByName(by_name)
    first = found.groupBy("needle").agg(F.min(F.struct("how", "ordinal")).alias("m"))
    return needles.join(first, "needle", "left").select("needle", F.col("m.ordinal").alias("ordinal"), F.col("m.how").alias("how"))


def next_id(table: DataFrame) -> DataFrame:
    return table.agg((F.coalesce(F.max(decimal_id(F.col("id"))), F.lit(0)) + 1).cast("long").alias("next_id"), F.count(F.lit(1)).alias("n"))


def appended(table: DataFrame, name: str) -> DataFrame:
    """The table with a snapshot added at its end, under the next id; with sixteen it is refused.

    ``(ordinal, id, name, refused)``: a refused table comes back as it is, marked so.
    """
    facts = next_id(table).crossJoin(table.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("ordinal")))
    full = F.col("n") >= MOST_SNAPSHOTS
    new = facts.filter(~full).select(F.col("ordinal").cast(table.schema["ordinal"].dataType).alias("ordinal"), F.col("next_id").cast("string").alias("id"), F.lit(name).alias("name"), F.lit(False).alias("refused"))
    old = table.select("ordinal", "id", "name").crossJoin(F.broadcast(facts.select(full.alias("refused"))))
    return old.unionByName(new)


def without(table: DataFrame, name: str) -> DataFrame:
    """The table after deleting the first snapshot of that name (ids don't count)."""
    gone = table.filter(F.col("name") == name).agg(F.min("ordinal").alias("gone"))
    return table.crossJoin(F.broadcast(gone)).filter("gone IS NULL OR ordinal <> gone").drop("gone")


def refcount_delta(refcounts: DataFrame, changes: DataFrame, bits: int = 16) -> DataFrame:
    """Counts after adding ``changes(cluster_idx, delta)``; each row says if it is allowed.

    Going over the width and going below zero are different errors; a plan with any
    error changes nothing, which the caller decides on the whole result.
    """
    sums = changes.groupBy("cluster_idx").agg(F.sum("delta").alias("delta"))
    both = refcounts.join(sums, "cluster_idx", "full_outer").select("cluster_idx", F.coalesce("stored", F.lit(0)).alias("before"), F.coalesce("delta", F.lit(0)).alias("delta"))
    after = F.col("before") + F.col("delta")
    error = F.when(after < 0, "parse_failed").when(after > (1 << bits) - 1, "refcount_overflow")
    return both.select("cluster_idx", "before", after.alias("after"), error.alias("error"))


def reachable(tables: DataFrame, edges: DataFrame, sign: int) -> DataFrame:
    """Changes for every cluster a tree reaches: its tables and what they point to."""
    own = tables.select("cluster_idx", F.lit(sign).cast("long").alias("delta"))
    below = edges.select("cluster_idx", F.lit(sign).cast("long").alias("delta"))
    return own.unionByName(below)


def first_fit(refcounts: DataFrame, requests: DataFrame, chunk: int = 65536) -> DataFrame:
    """First run of ``n`` free clusters at or after ``cursor``, per request; null if there is none.

    A run that the cursor cuts starts at the cursor. The run under the cursor is looked up
    by itself; the next long enough one by size: a run is listed for every size asked for
    that it can hold, and sizes are few.
    """
    every = free_runs(refcounts, chunk)
    asked = requests.withColumn("pos", F.col("cursor"))
    under = last_before(asked, every.select(F.col("first").alias("pos"), F.struct("first", "last").alias("mark")), chunk)
    here = F.when(F.col("mark.last") - F.col("cursor") + 1 >= F.col("n"), F.col("cursor"))
    under = under.withColumn("here", here).drop("mark", "pos")
    sizes = requests.agg(F.collect_set("n").alias("sizes"))
    listed = every.crossJoin(F.broadcast(sizes)).withColumn("n", F.explode(F.filter("sizes", lambda x: x <= F.col("last") - F.col("first") + 1)))
    # The first mark at or after a place is the last one at or before it, counted backwards.
    ahead = last_before(under.withColumn("pos", -F.col("cursor")), listed.select("n", (-F.col("first")).alias("pos"), F.col("first").alias("mark")), chunk, ["n"])
    return ahead.select("request", "cursor", "n", F.coalesce("here", "mark").alias("at"))


def free_runs(refcounts: DataFrame, chunk: int = 65536) -> DataFrame:
    """Runs ``(first, last)`` of free clusters.

    They are found chunk by chunk; only runs that touch a chunk's edge are joined in a
    second window.
    """
    free = refcounts.filter("stored = 0").select("cluster_idx", F.expr(f"cluster_idx div {chunk}").alias("chunk"))
    local = free.withColumn("island", F.col("cluster_idx") - F.row_number().over(W.partitionBy("chunk").orderBy("cluster_idx")))
    runs = local.groupBy("chunk", "island").agg(F.min("cluster_idx").alias("first"), F.max("cluster_idx").alias("last")).drop("island")
    edge = (F.col("first") == F.col("chunk") * chunk) | (F.col("last") == F.col("chunk") * chunk + chunk - 1)
    order = W.orderBy("first")
    joined = runs.filter(edge).withColumn("opens", F.when(F.lag("last").over(order) + 1 == F.col("first"), 0).otherwise(1))
    joined = joined.withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.filter(~edge).select("first", "last").unionByName(joined.select("first", "last"))


def claim_runs(refcounts: DataFrame, requests: DataFrame, size: int, cursor: int = 0, chunk: int = 65536) -> DataFrame:
    """``(request, at)``: the clusters that requests of ``size`` each claim, one after the other.

    Each takes the first free run at or after where the last one ended; a run holds as
    many as fit. Requests beyond the last get null: the counts are exhausted.
    """
    runs = free_runs(refcounts, chunk).filter(F.col("last") >= cursor).withColumn("first", F.greatest("first", F.lit(cursor).cast("long")))
    runs = runs.withColumn("fit", F.expr(f"(last - first + 1) div {size}")).filter("fit > 0")
    order = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    marks = runs.select(F.coalesce(F.sum("fit").over(order), F.lit(0)).alias("pos"), F.struct("first", "fit").alias("mark"))
    # Requests by rank: a run answers the ranks from its own on.
    ranked = requests.select("request", (F.row_number().over(W.orderBy("request")) - 1).cast("long").alias("pos"))
    found = last_before(ranked, marks.withColumn("mark", F.struct("pos", "mark.first", "mark.fit")), chunk)
    turn = F.col("pos") - F.col("mark.pos")
    return found.select("request", F.when(turn < F.col("mark.fit"), F.col("mark.first") + turn * size).alias("at"))


def packed_refcount(block: Column, index: Column, bits: int) -> Column:
    """The counter at an index of a block: below a byte least significant first, above big-endian."""
    if bits < 8:
        per = 8 // bits
        byte = F.conv(F.hex(block.substr((index / per).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return F.floor(byte / F.pow(F.lit(2), (index % per) * bits)).cast("long") % (1 << bits)
    size = bits // 8
    return F.conv(F.hex(block.substr((index * size + 1).cast("int"), F.lit(size))), 16, 10).cast("decimal(20,0)")


def with_refcount(block: Column, index: Column, bits: int, value: Column) -> Column:
    """The block with the counter at an index set; null where the value needs more bits."""
    if bits < 8:
        per = 8 // bits
        byte = F.floor(index / per).cast("int")
        old = F.conv(F.hex(block.substr(byte + 1, F.lit(1))), 16, 10).cast("long")
        shift = F.pow(F.lit(2.0), (index % per) * bits).cast("long")
        new = old + (value - F.floor(old / shift) % (1 << bits)) * shift
        digits, at, size = F.lpad(F.hex(new), 2, "0"), byte, 1
    else:
        size = bits // 8
        digits, at = F.lpad(F.hex(value), 2 * size, "0"), (index * size).cast("int")
    # The digits before the counter, its own, and those behind it.
    whole = F.hex(block)
    made = F.concat(F.substring(whole, F.lit(1), at * 2), digits, whole.substr(at * 2 + 2 * size + 1, F.length(whole)))
    return F.when((value >= 0) & (value < (1 << min(bits, 62))), F.unhex(made))


def reachable_from(l1: DataFrame, l2: DataFrame, sign: int) -> DataFrame:
    """Changes for all that a tree's first level ``l1(l1_idx, cluster_idx)`` reaches.

    ``l2(table_idx, cluster_idx)`` are the entries of second-level tables, by the table's
    cluster. Every first-level entry counts its table and all that the table names: a
    table that two entries share counts twice. 0 names nothing.
    """
    tops = l1.filter("cluster_idx != 0")
    below = tops.select(F.col("cluster_idx").alias("table_idx")).join(l2.filter("cluster_idx != 0"), "table_idx")
    return reachable(tops, below, sign)


def applied(refcounts: DataFrame, changes: DataFrame, bits: int = 16) -> DataFrame:
    """Counts after a whole plan: a single error anywhere leaves every count as it was.

    ``(cluster_idx, before, after, allowed)``.
    """
    rows = refcount_delta(refcounts, changes, bits)
    fault = rows.agg((F.count("error") == 0).alias("allowed"))
    both = rows.crossJoin(F.broadcast(fault))
    return both.select("cluster_idx", "before", F.when(F.col("allowed"), F.col("after")).otherwise(F.col("before")).alias("after"), "allowed")
