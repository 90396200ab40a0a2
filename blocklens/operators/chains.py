"""Chains of images and tables of members, segments and declared regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.model import MAX_CHAIN_DEPTH


def discover(parents: DataFrame, most: int = MAX_CHAIN_DEPTH) -> DataFrame:
    """Per image: its depth, the root it reaches, and ``ok``, ``cycle``, ``too_deep`` or ``missing``.

    Paths double: a path of ``2 ** k`` ancestors is followed by that of its last one, so
    that ``most`` steps take a logarithm of joins. Paths that have ended keep a join key of
    their own, which nothing matches, so that finished images don't gather at their root.
    An image that returns to itself is a cycle; one that walks into another's is too deep.
    """
    none = F.expr(f"cast(array() as array<{parents.schema['id'].dataType.simpleString()}>)")
    walk = parents.select("id", F.when(F.col("parent").isNull(), none).otherwise(F.array("parent")).alias("path"), F.when(F.col("parent").isNull(), "ok").alias("end"))
    reach = 1
    while reach <= most + 1:
        open_ = F.col("end").isNull()
        asked = walk.withColumn("open", open_).withColumn("at", F.when(open_, F.try_element_at("path", F.lit(-1))).otherwise(F.col("id")))
        known = walk.select(F.lit(True).alias("open"), F.col("id").alias("at"), F.col("path").alias("more"), F.col("end").alias("then"), F.lit(True).alias("known"))
        step = asked.join(known, ["open", "at"], "left")
        end = F.when(~F.col("open"), F.col("end")).when(F.col("known").isNull(), "missing").otherwise(F.col("then"))
        walk = step.select("id", F.when(F.col("open") & F.col("known").isNotNull(), F.concat("path", "more")).otherwise(F.col("path")).alias("path"), end.alias("end"))
        reach *= 2
    home = F.array_position("path", F.col("id"))
    cycle = (home > 0) & (home <= most + 1)
    depth = F.when(cycle, home - 1).otherwise(F.least(F.size("path"), F.lit(most + 1)).cast("long"))
    outcome = F.when(cycle, "cycle").when(F.size("path") > most, "too_deep").otherwise(F.coalesce("end", F.lit("too_deep")))
    found = walk.select("id", "path", depth.cast("long").alias("depth"), outcome.alias("outcome"))
    return found.select("id", F.when(F.col("depth") == 0, F.col("id")).otherwise(F.try_element_at("path", F.col("depth").cast("int"))).alias("root"), "depth", "outcome")


def last_before(points: DataFrame, marks: DataFrame, chunk: int, by: list[str] | None = None) -> DataFrame:
    """``points(*by, pos, ...)`` with the ``mark`` of the last of ``marks(*by, pos, mark)`` at or before each.

    Positions are cut into chunks that are ordered by themselves; what a chunk begins with
    comes from one row per chunk that holds a mark.
    """
    by = by or []
    cell = F.expr(f"floor(pos / {chunk})")
    marks = marks.withColumn("cell", cell)
    own = [*by, "cell"]
    both = points.withColumn("cell", cell).withColumn("is_point", F.lit(1)).unionByName(marks.withColumn("is_point", F.lit(0)), allowMissingColumns=True)
    along = W.partitionBy(*own).orderBy("pos", "is_point").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = both.withColumn("inside", F.last("mark", ignorenulls=True).over(along)).filter("is_point = 1")
    cells = both.groupBy(*own).agg(F.max(F.when(F.col("is_point") == 0, F.struct("pos", "mark")))["mark"].alias("last"))
    before = F.last("last", ignorenulls=True).over((W.partitionBy(*by) if by else W.partitionBy()).orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    carried = cells.withColumn("carried", before).select(*own, "carried")
    return within.join(carried, own, "left").withColumn("mark", F.coalesce("inside", "carried")).drop("cell", "is_point", "inside", "carried")


def member_starts(members: DataFrame) -> DataFrame:
    """Half-open spans of concatenated members, in their order; members are a short table."""
    before = W.orderBy("member").rowsBetween(W.unboundedPreceding, -1)
    return members.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("size"))


def members_at(offsets: DataFrame, members: DataFrame, chunk: int = 1 << 30) -> DataFrame:
    """The member that holds each offset, and the place in it; beyond the end reads as zeros.

    With a ``held`` column, a member holds fewer bytes than its size takes up: the rest of
    it reads as zeros too, each member's for itself.
    """
    spans = member_starts(members if "held" in members.columns else members.withColumn("held", F.col("size")))
    marks = spans.filter("size > 0").select(F.col("start").alias("pos"), F.struct("member", "start", "end", "held").alias("mark"))
    found = last_before(offsets.withColumn("pos", F.col("offset")), marks, chunk)
    m, inside = F.col("mark"), F.col("offset") - F.col("mark.start")
    there = F.coalesce(F.col("offset") < m["end"], F.lit(False))
    return found.select("offset", F.when(there, m["member"]).alias("member"), F.when(there, inside).alias("inside"), (~there | (inside >= m["held"])).alias("zero"))


def level_of(length: Column, base: int) -> Column:
    """The least level at which a range covers at most seventeen cells of ``base * 16 ** level``."""
    return F.expr("0L") + F.greatest(F.lit(0), F.floor((F.length(F.bin(F.call_function("div", length - 1, F.lit(base).cast("long")))) + 3) / 4) - 1)


def cell_size(level: Column, base: int) -> Column:
    return F.lit(base).cast("long") * F.pow(F.lit(16.0), level).cast("long")


def last_started(points: DataFrame, chunks: DataFrame, cell: int) -> DataFrame:
    """For each sector the chunk that holds it, ``first <= sector < first + count``, or a gap.

    A range join on cells: a chunk is listed in the few cells that it covers at the level of
    its length, a sector looks in its own cell of every level there is. Overlapping chunks
    resolve to the one that starts last; a gap is an error that callers must not read as zeros.
    """
    chunks = chunks.filter("count > 0").withColumn("level", level_of(F.col("count"), cell))
    width = cell_size(F.col("level"), cell)
    div = lambda x: F.call_function("div", x, width)
    covered = chunks.withColumn("cell", F.explode(F.sequence(div(F.col("first")), div(F.col("first") + F.col("count") - 1))))
    levels = chunks.agg(F.collect_set("level").alias("levels"))
    asked = points.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels")
    held = asked.withColumn("cell", div(F.col("sector"))).join(covered, ["level", "cell"]).filter("sector >= first AND sector < first + count")
    best = held.groupBy("sector").agg(F.max(F.struct("first", "chunk")).alias("c"))
    return points.join(best, "sector", "left").select("sector", F.col("c.chunk").alias("chunk"), (F.col("sector") - F.col("c.first")).alias("inside"), F.coalesce(F.col("c.chunk").isNull(), F.lit(True)).alias("gap"))


def tiling_faults(segments: DataFrame) -> DataFrame:
    """Per table: segments must tile ``[0, n)`` exactly; files need only ascend without overlap."""
    order = W.partitionBy("table_id").orderBy("first", "seq")
    before = F.lag("end").over(order)
    marked = segments.withColumn("end", F.col("first") + F.col("count")).withColumn("fault", (F.col("count") <= 0) | (F.col("first") != F.coalesce(before, F.lit(0)))).withColumn("file_fault", F.coalesce(F.lag("file_end").over(order) > F.col("file_first"), F.lit(False)))
    ends = marked.groupBy("table_id").agg(F.count_if("fault").alias("breaks"), F.count_if("file_fault").alias("file_breaks"), F.max("end").alias("covered"), F.max("n").alias("n"))
    return ends.select("table_id", "breaks", "file_breaks", "covered", ((F.col("breaks") == 0) & (F.col("covered") == F.col("n"))).alias("sound"))


def ranges_overlap(offset: Column, length: Column, other: Column, other_length: Column) -> Column:
    """Whether two ranges share a byte: empty ones never do, one whose end overflows always does."""
    end, other_end = F.try_add(offset, length), F.try_add(other, other_length)
    return F.when((length == 0) | (other_length == 0), False).when(end.isNull() | other_end.isNull(), True).otherwise((offset < other_end) & (other < end))


def overlaps(a: DataFrame, b: DataFrame, cell: int) -> DataFrame:
    """Pairs of ranges ``(id, start, length)`` that overlap, by the cells they cover.

    A range is listed in its cells at the level of its length and at every coarser level
    there is; two ranges meet at the coarser of their levels, in the first cell that both
    cover, so a pair comes once. Empty ranges never overlap. A range whose end overflows
    overlaps with every other one: it is told once, with the other side null.
    """
    def named(df: DataFrame, p: str) -> DataFrame:
        return df.filter(f"{p}_length > 0").withColumn(f"{p}_end", F.try_add(f"{p}_start", f"{p}_length"))

    a, b = named(a, "a"), named(b, "b")
    lost = lambda df, p: df.filter(f"{p}_end IS NULL")
    whole = lambda df, p: df.filter(f"{p}_end IS NOT NULL").withColumn(f"{p}_level", level_of(F.col(f"{p}_length"), cell))
    wa, wb = whole(a, "a"), whole(b, "b")
    levels = wa.select(F.col("a_level").alias("level")).unionByName(wb.select(F.col("b_level").alias("level"))).agg(F.collect_set("level").alias("levels"))

    def cells(df: DataFrame, p: str) -> DataFrame:
        df = df.crossJoin(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col(f"{p}_level")))).drop("levels")
        width = cell_size(F.col("level"), cell)
        return df.withColumn("cell", F.explode(F.sequence(F.call_function("div", F.col(f"{p}_start"), width), F.call_function("div", F.col(f"{p}_end") - 1, width))))

    met = cells(wa, "a").join(cells(wb, "b"), ["level", "cell"])
    first = F.call_function("div", F.greatest("a_start", "b_start"), cell_size(F.col("level"), cell))
    met = met.filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("level") == F.greatest("a_level", "b_level")) & (F.col("cell") == first))
    pairs = met.select("a_id", "b_id", F.expr("greatest(a_start, b_start)").alias("start"), F.expr("least(a_end, b_end)").alias("end"))
    for df, p, other in ((a, "a", b), (b, "b", a)):
        alone = lost(df, p).select(*(F.col(f"{q}_id") if q == p else F.lit(None).cast((b if q == "b" else a).schema[f"{q}_id"].dataType).alias(f"{q}_id") for q in "ab"), F.col(f"{p}_start").alias("start"), F.lit(None).cast("long").alias("end"))
        pairs = pairs.unionByName(alone)
    return pairs


def preferred_locator(locators: DataFrame) -> DataFrame:
    """Lowest platform rank, then lowest slot; ambiguous if that rank holds different bytes."""
    sound = locators.filter("rank IS NOT NULL")
    best = sound.groupBy("image_id").agg(F.min("rank").alias("rank"))
    own = sound.join(best, ["image_id", "rank"])
    return own.groupBy("image_id").agg(F.min(F.struct("slot", "bytes")).alias("m"), F.count_distinct("bytes").alias("kinds"), F.count_if(F.col("bytes").isNull()).alias("unread"), F.count(F.lit(1)).alias("n")).select("image_id", "m.slot", F.when(F.expr("n > 1 AND (kinds > 1 OR unread > 0)"), None).otherwise(F.col("m.bytes")).alias("bytes"), F.expr("n > 1 AND (kinds > 1 OR unread > 0)").alias("ambiguous"))


def common_size(extents: DataFrame) -> DataFrame:
    """A cluster size for a whole table only when every extent has one and all agree."""
    agreed = (F.count_distinct("cluster_size") == 1) & (F.count("cluster_size") == F.count(F.lit(1)))
    return extents.groupBy("table_id").agg(F.when(agreed, F.max("cluster_size")).alias("cluster_size"))


def parent_format_matches(child: Column, parent: Column) -> Column:
    return F.when(child.isin("vhd", "vhdx"), parent.eqNullSafe(child)).otherwise(F.lit(True))


def lookup(blocks: DataFrame, table: DataFrame, per_table: int) -> DataFrame:
    """Two-level lookup: a block's directory slot, then its entry; missing ones read as 0."""
    keyed = blocks.withColumn("slot", F.expr(f"block_idx div {per_table}")).withColumn("idx", F.expr(f"block_idx % {per_table}"))
    return keyed.join(table, ["slot", "idx"], "left").select("block_idx", F.coalesce("entry", F.lit(0)).alias("entry"))


def data_devices_owned(devices: DataFrame, tops: DataFrame) -> DataFrame:
    """``(chain_id, owned)`` of ``devices(chain_id, slot, format, is_data, data_slot)``.

    A segment's top (``tops(chain_id, slot)``) is no data device; an owner (``data_slot``
    other than 0 or null) is a qcow2 image whose data device is the very next slot; every
    data device is claimed so. A chain has at most sixteen devices.
    """
    top = tops.select(F.col("chain_id"), F.col("slot"), F.lit(True).alias("top")).distinct()
    order = W.partitionBy("chain_id").orderBy("slot")
    next_is = lambda c: F.when(F.lead("slot").over(order) == F.col("slot") + 1, F.lead(c).over(order))
    claims = F.coalesce(F.col("data_slot") != 0, F.lit(False))
    claimed = F.coalesce((F.lag("data_slot").over(order) == F.col("slot")) & (F.lag("slot").over(order) == F.col("slot") - 1), F.lit(False))
    faulty_claim = claims & ~F.coalesce(~F.col("is_data") & (F.col("format") == "qcow2") & (F.col("data_slot") == F.col("slot") + 1) & next_is("is_data"), F.lit(False))
    faulty_device = F.col("is_data") & (~claimed | F.coalesce("top", F.lit(False)))
    return devices.join(top, ["chain_id", "slot"], "left").select("chain_id", (faulty_claim | faulty_device).alias("fault")).groupBy("chain_id").agg((~F.bool_or("fault")).alias("owned"))


def extent_files(extents: DataFrame, files: DataFrame) -> DataFrame:
    """The file behind each extent line of a descriptor: ``(image_id, line_no, path, start, outcome)``.

    ``extents(image_id, folder, line_no, sectors, kind, file, offset)``; ``files(path,
    length)`` lists what exists. Lines are laid end to end. A line of zeros needs no file;
    a flat one must lie within its file; a name is taken beside the descriptor.
    """
    order = W.partitionBy("image_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    laid = extents.withColumn("start", F.coalesce(F.sum("sectors").over(order), F.lit(0)) * 512)
    path = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat("folder", F.lit("/"), "file"))
    found = laid.withColumn("path", F.when(F.col("kind") != "ZERO", path)).join(files, "path", "left")
    end = (F.col("offset") + F.col("sectors")) * 512
    outcome = F.when(F.col("kind") == "ZERO", "zeros").when(F.col("length").isNull(), "missing").when((F.col("kind") == "FLAT") & (end > F.col("length")), "short").otherwise("ok")
    return found.select("image_id", "line_no", "path", "start", outcome.alias("outcome"))
