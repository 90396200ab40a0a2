"""The driver's tables in the roles of block-storage metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.model import BLOCK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per order; its status gives the state, its key the place."""
    b = F.col("o_orderkey")
    state = F.expr("case o_orderstatus when 'O' then 'data' when 'P' then if(o_orderkey % 3 = 0, 'zero_at', 'zero') else if(o_orderkey % 5 = 0, 'hole_at', 'hole') end")
    place = F.expr(f"(o_orderkey + o_orderkey div 4) * {BLOCK}")
    return table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("image_id"), b.alias("block_idx"), state.alias("state"), F.when(state.isin("data", "zero_at", "hole_at"), place).alias("file_offset"))


BLOCKS_SQL = f"""SELECT 0::BIGINT AS image_id, o_orderkey AS block_idx,
  CASE o_orderstatus WHEN 'O' THEN 'data' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'zero_at' ELSE 'zero' END ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'hole_at' ELSE 'hole' END END AS state,
  CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderkey % 3 = 0) OR (o_orderstatus = 'F' AND o_orderkey % 5 = 0) THEN (o_orderkey + o_orderkey // 4) * {BLOCK} END AS file_offset
FROM orders"""


def layers(spark: SparkSession, sf_dir: str, tag: int = 0) -> DataFrame:
    """Three layers over the orders; a chain's ``tag`` changes some payloads."""
    o = table(spark, sf_dir, "orders")
    cents = F.expr("cast(round(o_totalprice * 100) as bigint)")

    def layer(depth: int, rule: str, state: str, value) -> DataFrame:
        return o.filter(rule).select(F.lit(tag).cast("long").alias("chain_id"), F.lit(depth).alias("depth"), F.col("o_orderkey").alias("block_idx"), F.expr(state).alias("state"), value.alias("value"))

    top = layer(0, f"o_orderkey % {5 + tag} = 0", "case o_orderstatus when 'F' then 'zero' when 'P' then 'hole' else 'data' end", cents + 1)
    mid = layer(1, "o_orderkey % 3 = 0", "if(o_orderkey % 4 = 0, 'hole', 'data')", cents + 2)
    base = layer(2, "o_orderkey % 7 <> 0", "'data'", cents + 3)
    return top.unionByName(mid).unionByName(base)


def layers_sql(tag: int = 0) -> str:
    v = "cast(round(o_totalprice * 100) AS BIGINT)"
    return f"""SELECT {tag}::BIGINT AS chain_id, 0 AS depth, o_orderkey AS block_idx, CASE o_orderstatus WHEN 'F' THEN 'zero' WHEN 'P' THEN 'hole' ELSE 'data' END AS state, {v} + 1 AS value FROM orders WHERE o_orderkey % {5 + tag} = 0
UNION ALL SELECT {tag}, 1, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'hole' ELSE 'data' END, {v} + 2 FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT {tag}, 2, o_orderkey, 'data', {v} + 3 FROM orders WHERE o_orderkey % 7 <> 0"""


#: The cluster that a line item refers to: its order's, the next one's, one of a shared lot, or one outside the file.
CLUSTER_OF = "CASE WHEN l_partkey % 97 = 0 THEN l_orderkey + 100000000 WHEN l_linenumber <= 2 THEN l_orderkey WHEN l_partkey % 5 = 0 THEN l_orderkey + 1 ELSE l_suppkey * 64 + l_partkey % 64 END"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item refers to a cluster; the order is the logical place."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.expr(CLUSTER_OF).alias("cluster_idx"))


REFS_SQL = f"SELECT l_orderkey AS src, {CLUSTER_OF} AS cluster_idx FROM lineitem"


def refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as counted clusters."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_idx"), (F.col("o_custkey") % 4).alias("stored"))


REFCOUNTS_SQL = "SELECT o_orderkey AS cluster_idx, o_custkey % 4 AS stored FROM orders"


def l2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of the tables that hold the references: one for every 64 places."""
    return refs(spark, sf_dir).select(F.expr("src div 64").alias("cluster_idx")).distinct()


L2_TABLES_SQL = f"SELECT DISTINCT src // 64 AS cluster_idx FROM ({REFS_SQL})"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as first-level entries, line items as second-level ones, good and bad; the file has a cluster per order."""
    first = table(spark, sf_dir, "orders").selectExpr("o_orderkey * 1000 AS pos", "1 AS level", f"{RAW_L1} AS raw")
    second = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 1000 + 1 + l_linenumber AS pos", "2 AS level", f"{RAW_L2.replace('//', 'div')} AS raw")
    size = table(spark, sf_dir, "orders").agg((F.count(F.lit(1)) * BLOCK).alias("size"))
    return first.unionByName(second).crossJoin(F.broadcast(size))


RAW_L1 = f"CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 89 = 0 THEN 511 WHEN o_orderkey % 83 = 0 THEN o_orderkey * {BLOCK} + 512 WHEN o_orderkey % 79 = 0 THEN (o_orderkey + 100000000) * {BLOCK} ELSE o_custkey * {BLOCK} END"
RAW_L2 = f"CASE WHEN l_partkey % 11 = 0 THEN 0 WHEN l_partkey % 13 = 0 THEN 1 WHEN l_partkey % 17 = 0 THEN 4611686018427387904 + (l_suppkey % 128) * 18014398509481984 + l_orderkey * {BLOCK} + l_linenumber * 1000 WHEN l_partkey % 19 = 0 THEN l_orderkey * {BLOCK} + 1024 WHEN l_partkey % 23 = 0 THEN (l_orderkey + 100000000) * {BLOCK} ELSE l_orderkey * {BLOCK} END"
ENTRIES_SQL = f"""SELECT *, (SELECT count(*) * {BLOCK} FROM orders) AS size FROM (SELECT o_orderkey * 1000 AS pos, 1 AS level, {RAW_L1} AS raw FROM orders
UNION ALL SELECT l_orderkey * 1000 + 1 + l_linenumber, 2, {RAW_L2} FROM lineitem)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a snapshot table: some ids are not plain numbers."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("ordinal"), F.expr("case when s_suppkey % 10 = 3 then concat(cast(s_suppkey as string), 'abc') when s_suppkey % 10 = 7 then concat('x', cast(s_suppkey as string)) else cast(s_suppkey as string) end").alias("id"), F.col("s_nationkey").cast("string").alias("name"))


SNAPSHOTS_SQL = "SELECT s_suppkey AS ordinal, CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey || 'abc' WHEN s_suppkey % 10 = 7 THEN 'x' || s_suppkey ELSE s_suppkey::VARCHAR END AS id, s_nationkey::VARCHAR AS name FROM supplier"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dirty bitmaps over granules of four events."""
    e = table(spark, sf_dir, "events")
    kinds = F.expr("case when event_type = 'click' and user_id % 2 = 0 then 'a' when event_type = 'view' and user_id % 3 = 0 then 'b' end")
    return e.select(kinds.alias("bitmap"), F.expr("event_id div 4").alias("granule")).filter("bitmap is not null").distinct()


DIRTY_SQL = "SELECT DISTINCT CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'a' WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'b' END AS bitmap, event_id // 4 AS granule FROM events WHERE (event_type = 'click' AND user_id % 2 = 0) OR (event_type = 'view' AND user_id % 3 = 0)"


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a forest of images: the parent's number is a third of the child's."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("if(p_partkey = 0, null, p_partkey div 3)").alias("parent"))


PARENTS_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 3 END AS parent FROM part"
