"""Connected components of a link table, as joins over the links alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import drop_table, materialize

#: Rows of a posting list that share one join key.
LIST_PART = 256


def connected_components(links: DataFrame) -> DataFrame:
    """Rows ``(v, label)`` for every end of ``links(a, b)``: label is the least end reachable.

    Each round takes the least label among a vertex's neighbours, which the
    aggregation combines before its shuffle, and then jumps from label to label's
    label, so that the rounds grow with the logarithm of the longest path. Rounds
    are written to the shared folder; nothing but a count reaches the driver. An
    empty link table gives an empty result; repeated links and loops change nothing.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        at = labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
        near = both.join(at, "b").groupBy(F.col("a").alias("v")).agg(F.min("lb").alias("least"))
        hooked = labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label"))
        # A label is itself a vertex, so its own label is at most as large.
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("upper"))
        jumped = hooked.join(up, "label", "left").select("v", "old", F.least("label", F.coalesce("upper", "label")).alias("label"))
        new = materialize(jumped, "labels")
        changed = not new.filter(F.col("old") != F.col("label")).isEmpty()
        drop_table(labels)
        labels = new.select("v", "label")
        if not changed:
            return labels


def centres_of(posts: DataFrame, centre: Column) -> DataFrame:
    """Of each list with two rows or more, the row of the largest ``centre``."""
    at = F.struct(*(c for c in posts.columns if c != "tok"))
    best = posts.groupBy("tok").agg(F.max(F.struct(centre.alias("share"), (-F.col("cid")).alias("rank"), at.alias("at"))).alias("c"), F.count(F.lit(1)).alias("len"))
    return best.filter("len > 1").select("tok", F.col("c.share").alias("share"), F.col("len").alias("listed"), "c.at.*")


def linked_components(posts: DataFrame, possible: Callable[[str, str], str], verify: Callable[[DataFrame], DataFrame], orders: list[Column], within: Callable[[DataFrame], DataFrame] | None = None, list_part: int = LIST_PART) -> DataFrame:
    """Components of the links among vertices that meet in posting lists, without all pairs.

    ``posts(tok, cid, ...)`` lists vertices by key; two vertices can only link if they
    share a key with ``possible(x, y)``, a condition on the two rows; ``verify`` turns
    pairs ``(a, b)`` into the links among them. First each vertex meets, for each of
    ``orders``, one list's centre (the row that is largest by it), which joins up groups
    that link to a common vertex or are densely linked. Then every possible pair that
    lies in two components is verified: one of its ends is outside its list's home
    component, so only those rows meet the whole list, which is cut into parts of
    ``list_part`` rows, each a join key of its own. Pairs that are left out have ends that
    are connected already.

    ``within``, if given, finds the last links from the lists themselves, so that their
    pairs never become rows: its rows are those of ``posts`` with ``part``, ``comp``,
    ``home`` and ``away``. Rows of one ``tok`` and ``part`` meet, each with ``away`` each
    without, as above; it states links ``(a, b)`` between the rows' ``comp``, as many as
    join up what the links of all that are possible join. Only these few are followed then.
    """
    centres = materialize(centres_of(posts, orders[0]), "centres")
    pairs = None
    for n, order in enumerate(orders):
        hubs = centres if n == 0 else materialize(centres_of(posts, order), "centres")
        met = posts.alias("x").join(hubs.alias("y"), F.expr("x.tok = y.tok AND x.cid != y.cid AND " + possible("x", "y")))
        first = met.groupBy(F.col("x.cid").alias("x")).agg(F.max(F.struct(F.col("y.share"), (-F.col("y.cid")).alias("rank"))).alias("c")).select("x", (-F.col("c.rank")).alias("y"))
        first = first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = first if pairs is None else pairs.unionByName(first)
    found = materialize(verify(pairs.distinct()), "links")

    labels = connected_components(found)
    comp = posts.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")
    main = comp.join(centres.select("tok", F.col("cid").alias("centre"), "listed"), "tok")
    home = main.filter("cid = centre").select("tok", F.col("comp").alias("home")).distinct()
    main = materialize(main.join(home, "tok").withColumn("parts", F.expr(f"(listed + {list_part - 1}) div {list_part}")).drop("centre", "listed"), "postings", free=within is not None)
    away = main.filter("comp != home").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).alias("x")
    all_ = main.withColumn("part", F.expr("pmod(xxhash64(cid), parts)")).alias("y")
    if within:
        met = all_.join(away.select("tok").distinct(), "tok", "left_semi").withColumn("away", F.lit(False))
        upper = connected_components(within(met.unionByName(away.withColumn("away", F.lit(True)))))
        # A component is named by one of its vertices; one without a link is in no label yet.
        alone = upper.join(labels, "v", "left_anti")
        joined = labels.join(upper.select(F.col("v").alias("label"), F.col("label").alias("least")), "label", "left")
        return joined.select("v", F.coalesce("least", "label").alias("label")).unionByName(alone)
    rest = away.join(all_, F.expr("x.tok = y.tok AND x.part = y.part AND x.comp != y.comp AND (y.comp = y.home OR x.cid < y.cid) AND " + possible("x", "y")))
    rest = rest.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    return connected_components(found.unionByName(verify(rest)))
