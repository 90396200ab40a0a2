"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations.

A source's target words, over its size, is its documents' expected number of copies.
Its whole part is allocated to every document with certainty. The rest is a sample of
unequal probabilities. A document's inclusion probability p grows with its tilt (its size
over the source's mean, between 1/2 and 2), by the one factor that makes the expected
words, the sum of p times size, the rest; where that would pass 1 the document is certain
and the others share what is left. Random odds come from a hash of the id; documents rank
by random odds over inclusion odds, the certain ones first. The sample is cut where its
words fill the rest, so its size in words is fixed; the document whose size comes nearest
to the gap that whole documents leave closes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blocklens.llm.common import materialize, null_safe_eq, pick, scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Ranks are summed in this many cells before any single document is looked at.
CELLS = 1 << 16
#: Rows alike in id, text and source that are numbered by one task.
SHARED_ROWS = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``(source, source_size, n_docs, target)`` of ``sizes(source, source_size, n_docs)``.

    Sources by code point, null last, take the weights in turn. Targets share
    ``percent`` of all sizes; none passes ``most`` times its source's size, and what
    is over is shared again by weight. That is one water level: sources in order of
    cap over weight are full until the level that the rest can hold is below the cap;
    from there on levels only fall, so the highest of them is the one that holds.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(one) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    ranked = ranked.withColumn("ratio", F.col("source_size") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    filled = F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (percent * F.sum("source_size").over(everything) - 100 * most * filled) / (100 * left)
    placed = ranked.withColumn("level", level).withColumn("full", F.col("level") > most * F.col("ratio"))
    free = placed.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    cap = (most * F.col("source_size")).cast("double")
    return free.select("source", "source_size", "n_docs", F.when(F.col("full"), cap).otherwise(F.least(cap, F.col("weight") * F.col("water"))).alias("target"))


def copies_to_take(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken, copies, source, inclusion``.

    ``inclusion`` is the probability of a copy beyond the whole part.

    Null texts have size 0 and take no words; null sources are one source, ordered
    last; repeated rows are separate documents that rank alike; null ids rank by a
    fixed hash; an empty table gives an empty result. Reruns agree: the random odds
    depend on ``seed`` and the id only. Work is one pass over the texts; what follows
    has one short row per document, and no window spans a source's documents but
    those of the one rank cell in which its sample ends.
    """
    rows = pick(docs, id=id_col, text=text_col, source=source_col)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    random = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    with scratch(docs.sparkSession):
        sized = materialize(rows.select("id", "source", size.alias("size"), random.alias("u"), F.xxhash64("text", "source").alias("th"), F.monotonically_increasing_id().alias("row")), "sizes", keep=True)

        totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        targets = source_targets(totals, weights, percent, most)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        targets = materialize(targets, "targets", keep=True).withColumnRenamed("source", "key")

        def with_source(df: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
            return df.join(facts, null_safe_eq(df["source"], facts["key"]), how).drop("key")

        sized = with_source(sized, targets)
        tilt = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("size") * F.col("n_docs") / F.col("source_size")))
        sized = sized.withColumn("tilt", F.when(F.expr("rest > 0 AND size > 0"), tilt))
        factors = inclusion_factors(sized.filter("tilt IS NOT NULL").groupBy("source", "tilt").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
        factors = materialize(factors, "factors", keep=True).withColumnRenamed("source", "key")
        sized = with_source(sized, factors, "left").withColumn("p", F.when(F.col("tilt").isNull(), 0.0).when(F.col("tilt") >= F.col("certain"), 1.0).otherwise(F.col("factor") * F.col("tilt")))
        ranked = sized.filter("p > 0")
        ranked = ranked.withColumn("rank", F.when(F.col("p") >= 1, 0.0).otherwise(F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")))
        ranked = ranked.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS)).select("id", "source", "size", "row", "rank", "cell", "rest")
        ranked = materialize(ranked, "ranks")

        cells = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        run = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
        cells = cells.withColumn("upto", F.sum("words").over(run)).filter("upto > rest")
        ends = cells.groupBy(F.col("source").alias("key")).agg(F.min("cell").alias("end"), F.min_by(F.col("upto") - F.col("words"), "cell").alias("before"))
        placed = with_source(ranked, ends, "left")

        inside = placed.filter("cell = end")
        along = W.partitionBy("source").orderBy("rank", "id", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
        inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(along))
        taken_inside = inside.filter("upto <= rest").select("source", "row", "size")
        early = placed.filter("end IS NULL OR cell < end").select("source", "row", "size")
        sample = materialize(early.unionByName(taken_inside), "sample")

        # The best single document for what is left, among those not taken.
        filled = sample.groupBy(F.col("source").alias("key")).agg(F.sum("size").alias("filled"))
        left_over = with_source(ranked, filled, "left").join(sample.select("row"), "row", "left_anti")
        gap = F.col("rest") - F.coalesce("filled", F.lit(0))
        left_over = left_over.withColumn("gap", gap).withColumn("off", F.abs(F.col("size") - F.col("gap"))).filter("off < gap")
        last = left_over.groupBy("source").agg(F.min(F.struct("off", "rank", "id", "row")).alias("best")).select(F.col("best.row").alias("row"))
        chosen = materialize(sample.select("row").unionByName(last).withColumn("more", F.lit(1).cast("long")), "chosen", keep=True)

    out = sized.join(chosen, "row", "left")
    copies = F.col("whole") + F.coalesce("more", F.lit(0))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", F.col("p").alias("inclusion"), "th", "row")


def inclusion_factors(tilts: DataFrame) -> DataFrame:
    """``(source, factor, certain)`` of ``tilts(source, tilt, words, rest)``.

    Tilts from ``certain`` on are included for sure, others with ``factor`` times the
    tilt, so that the expected words are the rest. The groups of a source are its
    sizes between half its mean and twice its mean, a number that doesn't grow with the
    count of its documents.
    """
    order = W.partitionBy("source").orderBy(F.col("tilt").desc())
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("tilt") * F.col("words")).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    tried = tilts.withColumn("factor", (F.col("rest") - before) / left).withColumn("fits", F.col("factor") * F.col("tilt") <= 1)
    # The first group, from the largest tilt down, that need not be certain.
    return tried.filter("fits").groupBy("source").agg(F.max_by("factor", "tilt").alias("factor")).join(
        tried.filter("NOT fits").groupBy(F.col("source").alias("s")).agg(F.min("tilt").alias("certain")), null_safe_eq(F.col("source"), F.col("s")), "left"
    ).select("source", "factor", F.coalesce("certain", F.lit(float("inf"))).alias("certain"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, in all their columns.

    Rows are found again by id and a hash of text and source. Rows that agree in these
    share their copies out among themselves, in parts of ``SHARED_ROWS``.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    plan = copies_to_take(docs, **options).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.count(F.lit(1)).alias("__rows"), F.sum("copies").alias("__copies"))
    plan = materialize(plan.filter("__copies > 0"), "plan")
    named = docs.withColumn("__of", F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{source_col}`")))

    def found(part: DataFrame) -> DataFrame:
        return named.join(part, null_safe_eq(named[id_col], part["__id"]) & (named["__of"] == part["__th"]))

    single = found(plan.filter("__rows = 1"))
    several = found(plan.filter("__rows > 1")).withColumn("__parts", F.expr(f"(__rows + {SHARED_ROWS - 1}) div {SHARED_ROWS}"))
    several = several.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__parts")))
    turn = F.row_number().over(W.partitionBy("__id", "__th", "__part").orderBy(F.lit(1)))
    extra = F.expr("(__copies % __rows) div __parts + if(__part < (__copies % __rows) % __parts, 1, 0)")
    several = several.withColumn("__turn", turn).withColumn("__copies", F.expr("__copies div __rows") + (F.col("__turn") <= extra).cast("long"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = single.select(*columns, "__copies").unionByName(several.select(*columns, "__copies")).filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*columns)


def mix_sql(weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix") -> str:
    """The same mix over ``documents(doc_id, text, source)`` in DuckDB's SQL."""
    listed = ", ".join(map(str, weights))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    row_number() OVER () AS row
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
ranked AS (SELECT *, [{listed}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS weight FROM totals),
ratios AS (SELECT *, source_size::DOUBLE / weight AS ratio FROM ranked),
levels AS (SELECT *,
    ({percent} * sum(source_size) OVER () - {100 * most} * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (100 * sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM ratios),
water AS (SELECT *, level > {most} * ratio AS is_full, max(CASE WHEN level <= {most} * ratio THEN level END) OVER () AS water FROM levels),
targets AS (SELECT source, source_size, n_docs, CASE WHEN is_full THEN ({most} * source_size)::DOUBLE ELSE least(({most} * source_size)::DOUBLE, weight * water) END AS target FROM water),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, target - whole * source_size AS rest FROM rates),
tilted AS (
  SELECT s.*, r.rest, least(2.0::DOUBLE, greatest(0.5::DOUBLE, (s.size * r.n_docs)::DOUBLE / r.source_size)) AS tilt
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE r.rest > 0 AND s.size > 0),
tilts AS (SELECT source, tilt, sum(size) AS words, any_value(rest) AS rest FROM tilted GROUP BY source, tilt),
tried AS (SELECT *, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY tilt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(tilt * words) OVER (PARTITION BY source ORDER BY tilt DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM tilts),
factors AS (SELECT source, arg_max(factor, tilt) FILTER (WHERE factor * tilt <= 1) AS factor, coalesce(min(tilt) FILTER (WHERE factor * tilt > 1), 'inf'::DOUBLE) AS certain FROM tried GROUP BY source),
likely AS (SELECT t.*, CASE WHEN tilt >= certain THEN 1.0::DOUBLE ELSE factor * tilt END AS p FROM tilted t JOIN factors f ON t.source IS NOT DISTINCT FROM f.source),
open AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE u / (1 - u) * (1 - p) / p END AS rank FROM likely),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, row ROWS UNBOUNDED PRECEDING) AS upto FROM open),
gaps AS (SELECT *, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM summed),
fills AS (
  SELECT row FROM (
    SELECT row, row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), rank, doc_id, row) AS n
    FROM gaps WHERE upto > rest AND abs(size - gap) < gap) WHERE n = 1),
chosen AS (SELECT row FROM summed WHERE upto <= rest UNION ALL SELECT row FROM fills)
SELECT s.doc_id, s.size, r.source_size, r.target, ((r.whole + CASE WHEN c.row IS NULL THEN 0 ELSE 1 END) * s.size)::BIGINT AS taken,
  (r.whole + CASE WHEN c.row IS NULL THEN 0 ELSE 1 END)::BIGINT AS copies, s.source
FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN chosen c ON s.row = c.row
"""
