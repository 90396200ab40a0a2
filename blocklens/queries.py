"""Every query by name, each with the SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens import lift
from blocklens.functions import chs
from blocklens.functions import scalars as S
from blocklens.model import BLOCK
from blocklens.operators import bitmaps, chains, checks, extents, integrity, layers, paths, snapshots
from blocklens.plans import schedule, sizes
from blocklens.sources import containers, formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


# Extents

EXTENTS_SQL = f"""ext AS (SELECT image_id, block_idx * {BLOCK} AS start, block_idx * {BLOCK} + {BLOCK} AS fin, state, file_offset FROM ({lift.BLOCKS_SQL})),
marked AS (SELECT *, CASE WHEN lag(fin) OVER w = start AND lag(state) OVER w = state AND (state IN ('hole', 'zero') OR lag(file_offset) OVER w + {BLOCK} = file_offset) THEN 0 ELSE 1 END AS opens
  FROM ext WINDOW w AS (PARTITION BY image_id ORDER BY start)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY image_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM marked),
extents AS (SELECT image_id, min(start) AS start, (max(fin) - min(start))::BIGINT AS length, min(state) AS state, min(file_offset) AS file_offset FROM numbered GROUP BY image_id, island)"""


def all_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents.coalesce_extents(extents.extents_of_blocks(lift.blocks(spark, sf_dir)), chunk=BLOCK * 4096)


@query(f"WITH {EXTENTS_SQL} SELECT * FROM extents")
def map_extents(spark, sf_dir):
    return all_extents(spark, sf_dir)


LO, HI = 100 * BLOCK + 777, 900 * BLOCK + 5
CLIP_SQL = f"clipped AS (SELECT image_id, greatest(start, {LO}) AS start, least(start + length, {HI}) - greatest(start, {LO}) AS length, state, file_offset + greatest(start, {LO}) - start AS file_offset FROM extents WHERE start + length > {LO} AND start < {HI})"


@query(f"WITH {EXTENTS_SQL}, {CLIP_SQL} SELECT * FROM clipped")
def map_window(spark, sf_dir):
    # Only blocks that reach into the window are read; one more on either side changes no cut extent.
    near = lift.blocks(spark, sf_dir).filter(F.col("block_idx").between(LO // BLOCK, HI // BLOCK))
    found = extents.coalesce_extents(extents.extents_of_blocks(near))
    start, end = extents.map_window(F.lit(LO).cast("long"), F.lit(HI - LO).cast("long"), F.lit(1 << 50).cast("long"))
    return extents.clip(found, start, end)


@query(f"WITH {EXTENTS_SQL} SELECT image_id, start, length, 0::BIGINT AS depth, state = 'data' AS present, state <> 'data' AS zero, state = 'data' AS data, false AS compressed, file_offset AS \"offset\" FROM extents WHERE state IN ('data', 'hole', 'hole_at') UNION ALL SELECT image_id, start, length, 0, true, true, false, false, file_offset FROM extents WHERE state LIKE 'zero%'")
def map_json(spark, sf_dir):
    return extents.flags(all_extents(spark, sf_dir))


@query(f"WITH {EXTENTS_SQL} SELECT image_id, start, length, 0::BIGINT AS depth, state <> 'data' AS zero, state = 'data' AS data, file_offset AS \"offset\" FROM extents")
def map_json_old_profile(spark, sf_dir):
    return extents.flags(all_extents(spark, sf_dir), version=(6, 0))


@query(f"WITH {EXTENTS_SQL} SELECT image_id, start, length, file_offset FROM extents WHERE state = 'data'")
def map_human(spark, sf_dir):
    return all_extents(spark, sf_dir).filter("state = 'data'").select("image_id", "start", "length", "file_offset")


DD = "p_size * 512 AS bs, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 50 END AS cnt, p_partkey % 7 AS skip, p_partkey * 1000 AS vsize"


@query(f"""WITH p AS (SELECT p_partkey AS id, {DD} FROM part), e AS (SELECT *, CASE WHEN cnt IS NULL THEN vsize ELSE least(cnt * bs, vsize) END AS fin FROM p)
SELECT id, least(skip * bs, fin)::BIGINT AS start, greatest(fin - skip * bs, 0)::BIGINT AS length FROM e""")
def dd_window(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "cast(p_size as bigint) * 512 AS bs", "if(p_partkey % 4 = 0, null, p_partkey % 50) AS cnt", "p_partkey % 7 AS skip", "p_partkey * 1000 AS vsize")
    start, length = extents.dd_window(F.col("bs"), F.col("cnt"), F.col("skip"), F.col("vsize"))
    return p.select("id", start.alias("start"), length.alias("length"))


@query("SELECT o_orderkey AS id, o_orderkey * 100 + n * 4096 AS \"offset\", least(4096, o_orderkey % 20000 - n * 4096)::BIGINT AS length FROM orders, (SELECT unnest(range(0, 5)) AS n) WHERE n * 4096 < o_orderkey % 20000")
def split_transfers(spark, sf_dir):
    ranges = lift.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey * 100 AS offset", "o_orderkey % 20000 AS length")
    return extents.split_transfers(ranges, 4096)


@query("""SELECT l_orderkey AS block_idx, l_linenumber AS slot, CASE WHEN e = 4294967295 THEN 'hole' ELSE 'data' END AS vhd, CASE WHEN e <> 4294967295 THEN e * 512 + 512 END AS vhd_offset,
CASE WHEN x % 8 IN (6, 7) THEN 'data' WHEN x % 8 = 2 THEN 'zero' ELSE 'hole' END AS vhdx, CASE WHEN x % 8 IN (6, 7) THEN (x // 1048576) * 1048576 END AS vhdx_offset,
CASE WHEN g = 0 THEN 'hole' WHEN g = 1 THEN 'zero' ELSE 'data' END AS vmdk, CASE WHEN g > 1 THEN g * 512 END AS vmdk_offset
FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 4294967295 ELSE l_partkey END AS e, l_partkey * 1048576 + l_suppkey % 8 AS x, l_suppkey % 5 AS g FROM lineitem)""")
def classify_tables(spark, sf_dir):
    t = lift.table(spark, sf_dir, "lineitem")
    vhd, vhd_at = extents.classify_vhd(F.expr("if(l_linenumber = 1, 4294967295L, l_partkey)"), 512)
    vhdx, vhdx_at = extents.classify_vhdx(F.expr("l_partkey * 1048576 + l_suppkey % 8"))
    vmdk, vmdk_at = extents.classify_vmdk(F.expr("l_suppkey % 5"))
    return t.select(F.col("l_orderkey").alias("block_idx"), F.col("l_linenumber").alias("slot"), vhd.alias("vhd"), vhd_at.alias("vhd_offset"), vhdx.alias("vhdx"), vhdx_at.alias("vhdx_offset"), vmdk.alias("vmdk"), vmdk_at.alias("vmdk_offset"))


@query("""WITH c AS (SELECT p_partkey AS id, ['compressed', 'normal', 'unallocated', 'zero_plain'][1 + p_partkey % 4] AS kind, (p_partkey * 37 % 64)::BIGINT AS a, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey * 11 % 64 END::BIGINT AS z, p_size % 6 AS sub FROM part),
b AS (SELECT *, (a // (1 << sub)) % 2 = 1 AS ab, (z // (1 << sub)) % 2 = 1 AS zb FROM c)
SELECT id, CASE kind WHEN 'compressed' THEN 'compressed' WHEN 'normal' THEN CASE WHEN a & z <> 0 THEN 'invalid' WHEN zb THEN 'zero_alloc' WHEN ab THEN 'normal' ELSE 'unallocated_alloc' END
 WHEN 'unallocated' THEN CASE WHEN a <> 0 THEN 'invalid' WHEN zb THEN 'zero_plain' ELSE 'unallocated_plain' END ELSE 'invalid' END AS kind FROM b""")
def subcluster_types(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "element_at(array('compressed', 'normal', 'unallocated', 'zero_plain'), cast(1 + p_partkey % 4 as int)) AS cluster", "p_partkey * 37 % 64 AS a", "if(p_partkey % 3 = 0, 0, p_partkey * 11 % 64) AS z", "p_size % 6 AS sub")
    return p.select("id", extents.subcluster_type(F.col("cluster"), F.col("a"), F.col("z"), F.col("sub")).alias("kind"))


# Layers

COMPOSE = "SELECT chain_id, block_idx, depth, state, CASE WHEN state = 'data' THEN value ELSE 0 END AS value FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, block_idx ORDER BY depth) AS rn FROM ({layers}) WHERE state <> 'hole'{more}) WHERE rn = 1"


def compose_sql(tag: int = 0, more: str = "") -> str:
    return COMPOSE.format(layers=lift.layers_sql(tag), more=more)


@query(compose_sql())
def chain_compose(spark, sf_dir):
    return layers.compose(lift.layers(spark, sf_dir))


@query(compose_sql(more=" AND depth >= 1"))
def chain_compose_below(spark, sf_dir):
    return layers.compose(lift.layers(spark, sf_dir), lowest=1)


@query(f"""WITH a AS ({compose_sql()}), b AS ({compose_sql(1)}), s AS (SELECT max(o_orderkey) + 1 AS va, max(o_orderkey) - 99 AS vb FROM orders),
d AS (SELECT coalesce(a.block_idx, b.block_idx) AS block_idx, coalesce(a.value, 0) <> coalesce(b.value, 0) AS differs FROM a FULL JOIN b ON a.block_idx = b.block_idx)
SELECT min(CASE WHEN differs AND block_idx < vb THEN block_idx END) AS first_mismatch, count(CASE WHEN differs AND block_idx < vb THEN 1 END) AS n_mismatches, count(CASE WHEN differs AND block_idx >= vb THEN 1 END) AS tail_mismatches,
 any_value(vb)::BIGINT AS compared, any_value(va <> vb) AS size_mismatch, count(CASE WHEN differs THEN 1 END) = 0 AS identical FROM d, s""")
def compare_chains(spark, sf_dir):
    a, b = layers.compose(lift.layers(spark, sf_dir)), layers.compose(lift.layers(spark, sf_dir, 1))
    sizes_ = lift.table(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 1).alias("size_a"), (F.max("o_orderkey") - 99).alias("size_b"))
    return layers.compare(a, b, sizes_)


@query(f"""WITH old AS ({compose_sql(more=' AND depth >= 1')}), new AS ({compose_sql(more=' AND depth >= 2')}), top AS (SELECT block_idx FROM ({lift.layers_sql()}) WHERE depth = 0 AND state <> 'hole')
SELECT block_idx, coalesce(vo, 0) AS value FROM (SELECT coalesce(o.block_idx, n.block_idx) AS block_idx, o.value AS vo, n.value AS vn FROM old o FULL JOIN new n ON o.block_idx = n.block_idx) WHERE coalesce(vo, 0) <> coalesce(vn, 0) AND block_idx NOT IN (SELECT block_idx FROM top)""")
def rebase_copyset(spark, sf_dir):
    all_ = lift.layers(spark, sf_dir)
    return layers.rebase_copies(all_.filter("depth = 0 AND state <> 'hole'"), layers.compose(all_, lowest=1), layers.compose(all_, lowest=2))


@query(f"""WITH l AS ({lift.layers_sql()}), t AS (SELECT * FROM l WHERE depth = 0 AND state <> 'hole'), b AS (SELECT * FROM l WHERE depth = 1)
SELECT coalesce(t.block_idx, b.block_idx) AS block_idx, CASE WHEN t.block_idx IS NOT NULL THEN t.value ELSE b.value END AS value, t.block_idx IS NOT NULL AS written FROM b FULL JOIN t ON t.block_idx = b.block_idx""")
def commit_merge(spark, sf_dir):
    all_ = lift.layers(spark, sf_dir)
    return layers.commit(all_.filter("depth = 0"), all_.filter("depth = 1"))


@query("SELECT p_partkey AS block_idx, i AS sector, (p_size // (1 << (7 - i))) % 2 = 1 AS vhd_child, (p_size // (1 << i)) % 2 = 1 AS vhdx_child FROM part, (SELECT unnest(range(0, 8)) AS i)")
def differencing_owner(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("bits"), F.explode(F.expr("sequence(0L, 7L)")).alias("sector"))
    return p.select(F.col("p_partkey").alias("block_idx"), "sector", layers.sector_owner(F.col("bits"), F.col("sector"), "msb").alias("vhd_child"), layers.sector_owner(F.col("bits"), F.col("sector"), "lsb").alias("vhdx_child"))


@query("SELECT o_orderkey // 8 AS sector, count(*) AS parts, sum(CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE 0 END)::BIGINT AS value FROM orders GROUP BY 1 HAVING max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE 0 END) <> 0")
def copy_rechunk(spark, sf_dir):
    return layers.rechunk(lift.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sector", "if(o_orderstatus = 'O', o_orderkey, 0) AS value"), 8)


@query(f"""WITH c AS ({compose_sql()}) SELECT block_idx - 40 AS block_idx, value FROM c WHERE block_idx >= 40 AND value <> 0""")
def convert_raw(spark, sf_dir):
    image = layers.compose(lift.layers(spark, sf_dir).filter("block_idx >= 40"))
    return image.filter("value <> 0").select((F.col("block_idx") - 40).alias("block_idx"), "value")


# Placement of writers

@query(f"SELECT image_id, block_idx, (row_number() OVER (PARTITION BY image_id ORDER BY block_idx) + 3)::BIGINT AS host_cluster FROM ({lift.BLOCKS_SQL}) WHERE state = 'data'")
def convert_qcow2_placement(spark, sf_dir):
    return schedule.place_clusters(lift.blocks(spark, sf_dir).filter("state = 'data'"), 4, chunk=1024)


@query("SELECT 0::BIGINT AS image_id, o_orderkey AS block_idx, (1 + o_orderkey * 7919 % 65000)::BIGINT AS size, (4096 + coalesce(sum((1 + o_orderkey * 7919 % 65000 + 511) // 512 * 512) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS file_offset FROM orders")
def convert_compressed_placement(spark, sf_dir):
    b = lift.table(spark, sf_dir, "orders").selectExpr("0L AS image_id", "o_orderkey AS block_idx", "1 + o_orderkey * 7919 % 65000 AS size")
    return schedule.place_compressed(b, 512, 4096, chunk=1024)


@query(f"""WITH s AS (SELECT block_idx // 32 AS cluster_idx, bit_or(CASE WHEN state = 'data' THEN (1::UBIGINT << (block_idx % 32)::INT) ELSE 0::UBIGINT END) AS alloc, bit_or(CASE WHEN state = 'zero' THEN (1::UBIGINT << (block_idx % 32)::INT) ELSE 0::UBIGINT END) AS zero FROM ({lift.BLOCKS_SQL}) GROUP BY 1)
SELECT cluster_idx, alloc::BIGINT AS alloc, zero::BIGINT AS zero, CASE WHEN zero >= 2147483648 THEN (zero::HUGEINT * 4294967296 + alloc - 18446744073709551616::HUGEINT)::BIGINT ELSE (zero * 4294967296 + alloc)::BIGINT END AS word FROM s""")
def subcluster_bitmap(spark, sf_dir):
    return schedule.subcluster_masks(lift.blocks(spark, sf_dir).selectExpr("block_idx div 32 AS cluster_idx", "block_idx % 32 AS sub", "state"))


@query("SELECT l_suppkey AS cluster_idx, least(count(*), 500)::BIGINT AS refcount FROM lineitem GROUP BY 1")
def saturating_refcount(spark, sf_dir):
    return integrity.saturating_count(lift.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster_idx")), 500)


@query("""WITH v AS (SELECT c_custkey AS image_id, c_custkey * c_custkey * 33554432 + 1 AS v FROM customer), b AS (SELECT *, CASE WHEN v > 35184372088832 THEN 67108864 WHEN v > 107374182400 THEN 33554432 WHEN v > 1073741824 THEN 16777216 ELSE 8388608 END AS bs FROM v)
SELECT image_id, bs::BIGINT AS block_size, (4294967296 // bs)::BIGINT AS chunk_ratio, ((v + bs - 1) // bs)::BIGINT AS payload_blocks, ((v + bs - 1) // bs + ((v + bs - 1) // bs - 1) // (4294967296 // bs))::BIGINT AS bat_entries FROM b""")
def vhdx_layouts(spark, sf_dir):
    v = lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS image_id", "cast(c_custkey AS decimal(38,0)) * c_custkey * 33554432 + 1 AS v").withColumn("block_size", sizes.vhdx_block_size(F.col("v")))
    layout = sizes.vhdx_layout(F.col("v"), F.col("block_size"))
    return v.select("image_id", "block_size", *(layout[c].alias(c) for c in ("chunk_ratio", "payload_blocks", "bat_entries")))


@query("""WITH l AS (SELECT s_suppkey AS image_id, 5 + s_suppkey % 3 AS chunk_ratio, 20 + s_suppkey AS bat_entries, 1048576 AS block_size, 4194304 AS data_start FROM supplier)
SELECT image_id, slot, slot % (chunk_ratio + 1) = chunk_ratio AS is_bitmap, CASE WHEN slot % (chunk_ratio + 1) = chunk_ratio THEN 0 ELSE (slot - slot // (chunk_ratio + 1)) * block_size + data_start + 6 END::BIGINT AS entry FROM (SELECT *, unnest(range(0, bat_entries)) AS slot FROM l)""")
def vhdx_fixed_bat(spark, sf_dir):
    return sizes.fixed_bat(lift.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS image_id", "5 + s_suppkey % 3 AS chunk_ratio", "20 + s_suppkey AS bat_entries", "1048576L AS block_size", "4194304L AS data_start"))


@query("""SELECT c.f AS child, p.f AS parent, CASE WHEN c.f IN ('vhd', 'vhdx') THEN c.f = p.f ELSE true END AS matches FROM (SELECT unnest(['raw', 'qcow2', 'vhd', 'vhdx']) AS f) c, (SELECT unnest(['raw', 'qcow2', 'vhd', 'vhdx']) AS f) p""")
def parent_formats(spark, sf_dir):
    f = [(a, b) for a in ("raw", "qcow2", "vhd", "vhdx") for b in ("raw", "qcow2", "vhd", "vhdx")]
    return rows(spark, "child string, parent string", *f).withColumn("matches", chains.parent_format_matches(F.col("child"), F.col("parent")))


# Aggregation-shaped operators

ALLOC_SQL = f"""{EXTENTS_SQL}, total AS (SELECT image_id, max(start + length) AS virtual_size, sum(CASE WHEN state = 'data' THEN length ELSE 0 END)::BIGINT AS allocated FROM extents GROUP BY 1),
u AS (SELECT image_id, count(DISTINCT u) AS units FROM (SELECT image_id, unnest(range(start // 262144, (start + length - 1) // 262144 + 1)) AS u FROM extents WHERE state = 'data') GROUP BY 1),
alloc AS (SELECT image_id, virtual_size, least(allocated, virtual_size) AS allocated_bytes, coalesce(units, 0)::BIGINT AS units FROM total LEFT JOIN u USING (image_id))"""


@query(f"WITH {ALLOC_SQL} SELECT * FROM alloc")
def alloc_summary(spark, sf_dir):
    return sizes.allocation(all_extents(spark, sf_dir), 262144)


def fixed_point_sql(source: str) -> str:
    """Rounds of the counting layout over ``source(id, used, cluster, bits)``."""
    nb = "(used + rt + rb + cluster * 8 // bits - 1) // (cluster * 8 // bits)"
    return f"""src AS ({source}), turn AS (SELECT id, used, cluster, bits, 0 AS n, 1::BIGINT AS rt, 1::BIGINT AS rb, false AS done FROM src
UNION ALL SELECT id, used, cluster, bits, n + 1, CASE WHEN done THEN rt ELSE ({nb} * 8 + cluster - 1) // cluster END, CASE WHEN done THEN rb ELSE {nb} END, done OR ({nb} = rb AND ({nb} * 8 + cluster - 1) // cluster = rt) FROM turn WHERE n < 16),
settled AS (SELECT id, CASE WHEN done THEN rt END AS table_clusters, CASE WHEN done THEN rb END AS block_clusters FROM turn WHERE n = 16)"""


@query(f"WITH RECURSIVE {fixed_point_sql('SELECT c_custkey AS id, (c_custkey * c_custkey * 97 + 5)::BIGINT AS used, 65536::BIGINT AS cluster, 16::BIGINT AS bits FROM customer')} SELECT id, table_clusters::BIGINT AS table_clusters, block_clusters::BIGINT AS block_clusters FROM settled")
def refcount_layout(spark, sf_dir):
    c = lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey * c_custkey * 97 + 5 AS used", "65536L AS cluster", "16L AS bits")
    return sizes.refcount_layout(c).select("id", F.col("layout.table").alias("table_clusters"), F.col("layout.blocks").alias("block_clusters"))


MEASURED = "SELECT c_custkey AS id, (c_custkey * c_custkey * 1048576)::BIGINT AS v, (c_custkey * c_custkey * 3)::BIGINT AS u FROM customer WHERE c_custkey > 0"


@query(f"""WITH RECURSIVE m AS ({MEASURED}), g AS (SELECT *, (v + 536870911) // 536870912 AS l1, (v + 65535) // 65536 AS full_c FROM m), h AS (SELECT *, (l1 * 8 + 65535) // 65536 AS l1c FROM g),
{fixed_point_sql('SELECT id, (1 + l1c + l1 + full_c)::BIGINT AS used, 65536::BIGINT AS cluster, 16::BIGINT AS bits FROM h')}
SELECT id, (65536 * (1 + l1c + l1 + table_clusters + block_clusters + u))::BIGINT AS required, (65536 * (1 + l1c + l1 + table_clusters + block_clusters + full_c))::BIGINT AS fully_allocated FROM h JOIN settled USING (id)""")
def measure_qcow2(spark, sf_dir):
    c = lift.table(spark, sf_dir, "customer").filter("c_custkey > 0").selectExpr("c_custkey AS id", "c_custkey * c_custkey * 1048576 AS v", "c_custkey * c_custkey * 3 AS units")
    return sizes.measure_qcow2(c).select("id", "required", F.col("full").alias("fully_allocated"))


@query(f"""WITH m AS ({MEASURED}), g AS (SELECT *, (v + 65535) // 65536 AS n, (v + 2097151) // 2097152 AS nb FROM m), t AS (SELECT *, (n + 511) // 512 AS gd FROM g), d AS (SELECT *, greatest((gd * 4 + 511) // 512 * 512, 512) AS gdb FROM t),
o AS (SELECT *, 10752 + gd * 2048 + gdb AS sparse, 10752 + gd * 2560 + 512 + gdb + 1536 AS stream, 2048 + (nb * 4 + 511) // 512 * 512 AS vhd FROM d)
SELECT id, 'vmdk_flat' AS target, v + 512 AS required, v + 512 AS fully_allocated FROM o UNION ALL SELECT id, 'vmdk_sparse', sparse + u * 65536, sparse + n * 65536 FROM o
UNION ALL SELECT id, 'vmdk_stream', (stream + u * 66048 + 65535) // 65536 * 65536, (stream + n * 66048 + 65535) // 65536 * 65536 FROM o
UNION ALL SELECT id, 'vhd_dynamic', vhd + u * 2097664, vhd + nb * 2097664 FROM o UNION ALL SELECT id, 'vhd_fixed', v + 512, v + 512 FROM o UNION ALL SELECT id, 'raw', v, v FROM o""")
def measure_others(spark, sf_dir):
    c = lift.table(spark, sf_dir, "customer").filter("c_custkey > 0").selectExpr("c_custkey AS id", "c_custkey * c_custkey * 1048576 AS v", "c_custkey * c_custkey * 3 AS u")
    v, u = F.col("v"), F.col("u")
    made = {"vmdk_flat": sizes.measure_vmdk(v, u, "flat"), "vmdk_sparse": sizes.measure_vmdk(v, u, "sparse"), "vmdk_stream": sizes.measure_vmdk(v, u, "stream"), "vhd_dynamic": sizes.measure_vhd(v, u, 2097152), "vhd_fixed": sizes.measure_vhd(v, u, 2097152, fixed=True), "raw": F.struct(v.alias("required"), v.alias("full"))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("target"), m["required"].cast("long").alias("required"), m["full"].cast("long").alias("fully_allocated")) for k, m in made.items())))
    return c.select("id", each.alias("m")).select("id", "m.*")


BOTH_SQL = f"""r AS ({lift.REFS_SQL}), c AS ({lift.REFCOUNTS_SQL}), used AS (SELECT cluster_idx, count(*) AS want FROM r GROUP BY 1),
b AS (SELECT coalesce(c.cluster_idx, u.cluster_idx) AS cluster_idx, coalesce(want, 0) AS want, stored FROM c FULL JOIN used u ON c.cluster_idx = u.cluster_idx)"""


VERDICTS_SQL = f"""raw AS ({lift.ENTRIES_SQL}), p AS (SELECT *, raw & 72057594037927424 AS ofs, level = 2 AND (raw >> 62) & 1 = 1 AS packed, raw & 18014398509481983 AS bg, ((raw >> 54) & 255) + 1 AS sec FROM raw),
q AS (SELECT *, bg + sec * 512 - (bg & 511) AS fin FROM p),
v AS (SELECT *, CASE WHEN raw = 0 THEN 'empty' WHEN level = 1 THEN CASE WHEN ofs = 0 THEN 'zero_after_mask' WHEN ofs >= size THEN 'out_of_file' WHEN ofs % 65536 <> 0 THEN 'misaligned' ELSE 'allocated' END
 WHEN packed THEN CASE WHEN fin > size THEN 'compressed_out' ELSE 'compressed' END WHEN ofs = 0 THEN 'unplaced' WHEN ofs % 65536 <> 0 THEN 'misaligned' WHEN ofs >= size THEN 'out_of_file' ELSE 'allocated' END AS verdict,
 CASE WHEN packed THEN bg ELSE ofs END AS pl, CASE WHEN packed THEN fin ELSE ofs + 65536 END AS stop FROM q)"""


@query(f"WITH {VERDICTS_SQL} SELECT level, verdict, count(*) AS n, max(stop) AS furthest FROM v GROUP BY 1, 2")
def entry_verdicts(spark, sf_dir):
    return checks.qcow2_verdicts(lift.entries(spark, sf_dir)).groupBy("level", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("furthest"))


@query(f"""WITH {VERDICTS_SQL}, counts AS ({lift.REFCOUNTS_SQL}), meta AS (SELECT s_suppkey AS c FROM supplier),
claim AS (SELECT pl // 65536 AS c, pos, NULL::BIGINT AS quiet FROM v WHERE verdict = 'allocated' UNION ALL SELECT unnest(range(pl // 65536, (stop - 1) // 65536 + 1)), NULL, pos FROM v WHERE verdict = 'compressed'),
per AS (SELECT c, count(pos) AS n, min(pos) AS f, min(quiet) AS qf FROM claim GROUP BY c),
over AS (SELECT sum(CASE WHEN n > 0 THEN n - 1 + CASE WHEN qf < f THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS "overlaps" FROM per),
rc AS (SELECT coalesce(sum(n), 0)::BIGINT AS refcount_errors FROM per JOIN counts ON c = cluster_idx WHERE stored = 0),
lk AS (SELECT count(*) AS leaks FROM counts WHERE stored > 0 AND cluster_idx NOT IN (SELECT c FROM per) AND cluster_idx NOT IN (SELECT c FROM meta)),
walk AS (SELECT count(*) AS clusters_checked, count(CASE WHEN verdict IN ('allocated', 'compressed', 'compressed_out') THEN 1 END) AS clusters_allocated, count(CASE WHEN verdict IN ('zero_after_mask', 'out_of_file', 'misaligned', 'compressed_out') THEN 1 END) AS bad_entries,
 max(CASE WHEN verdict IN ('allocated', 'compressed') THEN stop ELSE 0 END) AS image_end FROM v)
SELECT *, "overlaps" + bad_entries AS corruptions, "overlaps" + bad_entries + leaks + refcount_errors AS total_errors, "overlaps" + bad_entries = 0 AND refcount_errors = 0 AS valid, leaks > 0 AS has_leaks FROM walk, over, rc, lk""")
def check_counters(spark, sf_dir):
    meta = lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster_idx"))
    return checks.check_qcow2(lift.entries(spark, sf_dir), lift.refcounts(spark, sf_dir), meta)


@query(f"SELECT * FROM ({lift.REFCOUNTS_SQL}) c WHERE stored > 0 AND cluster_idx NOT IN (SELECT cluster_idx FROM ({lift.REFS_SQL}))")
def leaked_clusters(spark, sf_dir):
    return integrity.leaked(lift.refs(spark, sf_dir), lift.refcounts(spark, sf_dir))


@query(f"SELECT r.cluster_idx, count(*) AS uses FROM ({lift.REFS_SQL}) r GROUP BY 1 HAVING count(*) > 1")
def overlapping_clusters(spark, sf_dir):
    return integrity.used(lift.refs(spark, sf_dir)).filter("want > 1").select("cluster_idx", F.col("want").alias("uses"))


@query(f"SELECT DISTINCT c.cluster_idx FROM ({lift.REFCOUNTS_SQL}) c SEMI JOIN ({lift.REFS_SQL}) r ON c.cluster_idx = r.cluster_idx WHERE stored = 0")
def uncounted_clusters(spark, sf_dir):
    return lift.refcounts(spark, sf_dir).filter("stored = 0").join(lift.refs(spark, sf_dir), "cluster_idx", "left_semi").select("cluster_idx")


@query(f"""WITH d AS (SELECT image_id, file_offset <> lag(file_offset) OVER (PARTITION BY image_id ORDER BY block_idx) + {BLOCK} AS gap FROM ({lift.BLOCKS_SQL}) WHERE state = 'data'),
t AS (SELECT image_id, count(*) AS clusters, count(CASE WHEN gap THEN 1 END) AS gaps FROM d GROUP BY 1) SELECT *, CASE WHEN clusters <= 1 THEN 0 ELSE gaps * 100 // (clusters - 1) END AS percent FROM t""")
def fragmentation(spark, sf_dir):
    return integrity.fragmentation(lift.blocks(spark, sf_dir).filter("state = 'data'").selectExpr("image_id", "block_idx AS logical", "file_offset AS host_offset"), BLOCK, chunk=1000)


@query(f"WITH {BOTH_SQL} SELECT cluster_idx, want, stored, CASE WHEN want > stored THEN 'raised' WHEN want < stored AND want > 0 THEN 'lowered' WHEN want = 0 AND stored <> 0 THEN 'freed' ELSE 'kept' END AS action, CASE WHEN want = 0 THEN 0 ELSE stored END AS safe FROM b WHERE stored IS NOT NULL")
def refcount_corrections(spark, sf_dir):
    return integrity.corrections(lift.refs(spark, sf_dir), lift.refcounts(spark, sf_dir))


@query(f"SELECT src, r.cluster_idx, coalesce(stored = 1, false) AS copied FROM ({lift.REFS_SQL}) r LEFT JOIN ({lift.REFCOUNTS_SQL}) c ON r.cluster_idx = c.cluster_idx")
def reconcile_copied(spark, sf_dir):
    return integrity.copied_flags(lift.refs(spark, sf_dir), lift.refcounts(spark, sf_dir)).select("src", "cluster_idx", "copied")


@query("SELECT c_nationkey::BIGINT AS chain_id, count(*) AS depth, count(CASE WHEN c_mktsegment IS DISTINCT FROM CASE WHEN c_custkey % 9 = 0 THEN 'X' ELSE c_mktsegment END THEN 1 END) AS format_errors, count(CASE WHEN c_custkey % 11 = 0 THEN 1 END) AS size_errors FROM customer GROUP BY 1")
def validate_chains(spark, sf_dir):
    return integrity.validate_chain(lift.table(spark, sf_dir, "customer").selectExpr("cast(c_nationkey as bigint) AS chain_id", "c_mktsegment AS format", "if(c_custkey % 9 = 0, 'X', c_mktsegment) AS declared", "if(c_custkey % 11 = 0, 0, 1) AS virtual_size"))


@query("SELECT event_type, count(*) AS ops, sum(user_id * 512)::BIGINT AS bytes, CASE WHEN count(CASE WHEN user_id % 2 = 0 THEN 1 END) > 0 THEN count(*) / count(CASE WHEN user_id % 2 = 0 THEN 1 END) ELSE 0.0 END AS per_exit FROM events GROUP BY 1")
def operation_rates(spark, sf_dir):
    e = lift.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("ops"), F.sum(F.expr("user_id * 512")).alias("bytes"), F.count_if(F.expr("user_id % 2 = 0")).alias("exits"))
    return e.select("event_type", "ops", "bytes", S.safe_rate(F.col("ops"), F.col("exits")).alias("per_exit"))


# Snapshots

PARSED = "CASE WHEN regexp_extract(id, '^[0-9]+') = '' THEN 0 ELSE CAST(regexp_extract(id, '^[0-9]+') AS BIGINT) END"


@query(f"SELECT ordinal, id, name, {PARSED} AS number FROM ({lift.SNAPSHOTS_SQL})")
def snapshot_list(spark, sf_dir):
    return lift.snapshots(spark, sf_dir).withColumn("number", snapshots.decimal_id(F.col("id")).cast("long"))


@query(f"SELECT max({PARSED}) + 1 AS next_id, count(*) AS n FROM ({lift.SNAPSHOTS_SQL})")
def snapshot_next_id(spark, sf_dir):
    return snapshots.next_id(lift.snapshots(spark, sf_dir))


LOOKUP = """WITH t AS ({table}), n AS (SELECT n_nationkey::VARCHAR AS needle FROM nation), f AS (SELECT needle, 0 AS how, ordinal FROM n JOIN t ON needle = id WHERE {ids} UNION ALL SELECT needle, 1, ordinal FROM n JOIN t ON needle = name),
b AS (SELECT needle, how, ordinal, row_number() OVER (PARTITION BY needle ORDER BY how, ordinal) AS rn FROM f) SELECT n.needle, b.ordinal, b.how FROM n LEFT JOIN b ON n.needle = b.needle AND rn = 1"""


@query(LOOKUP.format(table=lift.SNAPSHOTS_SQL, ids="true"))
def snapshot_lookup(spark, sf_dir):
    return snapshots.lookup(lift.snapshots(spark, sf_dir), lift.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("needle")))


@query(LOOKUP.format(table=lift.SNAPSHOTS_SQL, ids="false"))
def snapshot_lookup_name(spark, sf_dir):
    return snapshots.lookup(lift.snapshots(spark, sf_dir), lift.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("needle")), name_only=True)


@query(f"WITH t AS ({lift.SNAPSHOTS_SQL}) SELECT * FROM t WHERE ordinal <> (SELECT min(ordinal) FROM t WHERE name = '7') OR (SELECT min(ordinal) FROM t WHERE name = '7') IS NULL")
def snapshot_delete(spark, sf_dir):
    return snapshots.without(lift.snapshots(spark, sf_dir), "7")


def delta_sql(changes: str) -> str:
    return f"""WITH c AS ({lift.REFCOUNTS_SQL}), d AS (SELECT cluster_idx, sum(delta)::BIGINT AS delta FROM ({changes}) GROUP BY 1), b AS (SELECT coalesce(c.cluster_idx, d.cluster_idx) AS cluster_idx, coalesce(stored, 0) AS before, coalesce(delta, 0) AS delta FROM c FULL JOIN d ON c.cluster_idx = d.cluster_idx)
SELECT cluster_idx, before, before + delta AS after, CASE WHEN before + delta < 0 THEN 'parse_failed' WHEN before + delta > 15 THEN 'refcount_overflow' END AS error FROM b"""


@query(delta_sql(f"SELECT cluster_idx, 1 AS delta FROM ({lift.REFS_SQL}) UNION ALL SELECT cluster_idx, 1 FROM ({lift.L2_TABLES_SQL})"))
def snapshot_create_counts(spark, sf_dir):
    r = lift.refs(spark, sf_dir)
    return snapshots.refcount_delta(lift.refcounts(spark, sf_dir), snapshots.reachable(lift.l2_tables(spark, sf_dir), r, 1), bits=4)


@query(delta_sql(f"SELECT cluster_idx, -1 AS delta FROM ({lift.REFS_SQL}) UNION ALL SELECT cluster_idx, -1 FROM ({lift.L2_TABLES_SQL})"))
def snapshot_delete_counts(spark, sf_dir):
    r = lift.refs(spark, sf_dir)
    return snapshots.refcount_delta(lift.refcounts(spark, sf_dir), snapshots.reachable(lift.l2_tables(spark, sf_dir), r, -1), bits=4)


@query(delta_sql(f"SELECT cluster_idx, CASE WHEN src // 64 % 2 = 0 THEN -1 ELSE 1 END AS delta FROM ({lift.REFS_SQL}) UNION ALL SELECT cluster_idx, CASE WHEN cluster_idx % 2 = 0 THEN -1 ELSE 1 END FROM ({lift.L2_TABLES_SQL})"))
def snapshot_apply_counts(spark, sf_dir):
    r = lift.refs(spark, sf_dir)
    tables = lift.l2_tables(spark, sf_dir)
    # The tables of the old state lose a reference, with all they name; those of the target gain one.
    changes = snapshots.reachable(tables.filter("cluster_idx % 2 = 0"), r.filter("src div 64 % 2 = 0"), -1).unionByName(snapshots.reachable(tables.filter("cluster_idx % 2 = 1"), r.filter("src div 64 % 2 = 1"), 1))
    return snapshots.refcount_delta(lift.refcounts(spark, sf_dir), changes, bits=4)


@query(f"""WITH f AS (SELECT cluster_idx, cluster_idx - row_number() OVER (ORDER BY cluster_idx) AS g FROM ({lift.REFCOUNTS_SQL}) WHERE stored = 0), r AS (SELECT min(cluster_idx) AS a, max(cluster_idx) AS z FROM f GROUP BY g),
q AS (SELECT s_suppkey AS request, s_suppkey * 3 AS "cursor", 1 + s_suppkey % 3 AS n FROM supplier), m AS (SELECT request, min(greatest(a, "cursor")) AS spot FROM q JOIN r ON z - greatest(a, "cursor") + 1 >= n GROUP BY 1) SELECT q.request, q."cursor", q.n, m.spot AS "at" FROM q LEFT JOIN m USING (request)""")
def alloc_first_fit(spark, sf_dir):
    requests = lift.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS request", "s_suppkey * 3 AS cursor", "1 + s_suppkey % 3 AS n")
    return snapshots.first_fit(lift.refcounts(spark, sf_dir), requests, chunk=100)


@query("SELECT p_partkey AS cluster_idx, (p_size % 256 // (1 << (2 * (p_partkey % 4)))) % 4 AS two_bits, (p_size * 257)::BIGINT AS sixteen_bits FROM part")
def packed_refcounts(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").selectExpr("p_partkey", "unhex(lpad(hex(p_size), 2, '0')) AS small", "unhex(concat(lpad(hex(p_size), 2, '0'), lpad(hex(p_size), 2, '0'))) AS big")
    return p.select(F.col("p_partkey").alias("cluster_idx"), snapshots.packed_refcount(F.col("small"), F.expr("p_partkey % 4"), 2).alias("two_bits"), snapshots.packed_refcount(F.col("big"), F.lit(0), 16).cast("long").alias("sixteen_bits"))


# Bitmaps

@query(f"SELECT DISTINCT 'a' AS bitmap, granule FROM ({lift.DIRTY_SQL})")
def bitmap_merge(spark, sf_dir):
    return bitmaps.merge(lift.dirty(spark, sf_dir), "a", "b")


@query(f"SELECT bitmap, granule // 32 AS word, bit_or(1::BIGINT << (granule % 32)::INT) AS bits FROM ({lift.DIRTY_SQL}) GROUP BY 1, 2")
def bitmap_words(spark, sf_dir):
    return bitmaps.packed(lift.dirty(spark, sf_dir))


@query("SELECT CASE WHEN d.g IS NULL THEN 'no_destination' WHEN s.g IS NULL THEN 'no_source' WHEN d.u OR s.u THEN 'in_use' WHEN d.g <> s.g THEN 'granularity' ELSE 'ok' END AS outcome FROM (SELECT max(CASE WHEN s_suppkey = 2 THEN 65536 END) AS g, max(CASE WHEN s_suppkey = 2 THEN false END) AS u FROM supplier) d, (SELECT max(CASE WHEN s_suppkey = 5 THEN 65536 * 2 END) AS g, max(CASE WHEN s_suppkey = 5 THEN false END) AS u FROM supplier) s")
def bitmap_merge_outcome(spark, sf_dir):
    d = lift.table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) AS name", "if(s_suppkey = 5, 131072L, 65536L) AS granularity", "s_suppkey % 10 = 9 AS in_use")
    return bitmaps.merge_outcome(d, "2", "5")


ACTIONS_SQL = """WITH RECURSIVE dir AS (SELECT s_suppkey::VARCHAR AS name, s_suppkey % 2 = 0 AS enabled FROM supplier),
act AS (SELECT name, action, row_number() OVER (PARTITION BY name ORDER BY seq) AS k FROM (SELECT (user_id % 300)::VARCHAR AS name, event_id AS seq, ['add', 'remove', 'clear', 'enable', 'disable'][1 + event_id % 5] AS action FROM events)),
start AS (SELECT coalesce(d.name, a.name) AS name, d.name IS NOT NULL AS here, coalesce(d.enabled, false) AS onn FROM dir d FULL JOIN (SELECT DISTINCT name FROM act) a ON d.name = a.name),
fold AS (SELECT name, 0::BIGINT AS k, here, onn, 0::BIGINT AS clears, NULL::VARCHAR AS error FROM start
 UNION ALL SELECT f.name, a.k, CASE WHEN a.action = 'add' THEN true WHEN NOT f.here THEN false ELSE a.action <> 'remove' END,
  CASE WHEN a.action = 'add' THEN f.here AND f.onn OR NOT f.here WHEN NOT f.here THEN false WHEN a.action = 'remove' THEN false WHEN a.action = 'enable' THEN true WHEN a.action = 'disable' THEN false ELSE f.onn END,
  CASE WHEN a.action = 'add' AND NOT f.here THEN 0 WHEN a.action = 'clear' AND f.here THEN f.clears + 1 ELSE f.clears END,
  CASE WHEN a.action = 'add' AND f.here THEN 'exists' WHEN a.action <> 'add' AND NOT f.here THEN 'missing' END
 FROM fold f JOIN act a ON a.name = f.name AND a.k = f.k + 1 WHERE f.error IS NULL)
SELECT name, here AS exists, onn AS enabled, clears, error FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC) AS rn FROM fold) WHERE rn = 1"""


@query(ACTIONS_SQL)
def bitmap_actions(spark, sf_dir):
    directory = lift.table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) AS name", "s_suppkey % 2 = 0 AS enabled")
    acts = lift.table(spark, sf_dir, "events").selectExpr("cast(user_id % 300 as string) AS name", "event_id AS seq", "element_at(array('add', 'remove', 'clear', 'enable', 'disable'), cast(1 + event_id % 5 as int)) AS action")
    return bitmaps.apply_actions(directory, acts)


@query("SELECT p_partkey AS id, greatest(4096, least(65536, 512 << (p_size % 13)))::BIGINT AS granularity, (((p_partkey * 999983 + greatest(4096, least(65536, 512 << (p_size % 13))) - 1) // greatest(4096, least(65536, 512 << (p_size % 13))) + 7) // 8)::BIGINT AS bytes FROM part")
def bitmap_sizes(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), bitmaps.default_granularity(F.expr("shiftleft(512L, p_size % 13)")).alias("granularity"))
    bits = S.ceil_div(F.expr("id * 999983"), F.col("granularity"))
    return p.select("id", "granularity", S.ceil_div(bits, 8).alias("bytes"))


# Chains

@query(f"""WITH RECURSIVE p AS ({lift.PARENTS_SQL}), w AS (SELECT id, id AS a, 0::BIGINT AS depth FROM p UNION ALL SELECT w.id, p.parent, depth + 1 FROM w JOIN p ON w.a = p.id WHERE p.parent IS NOT NULL AND depth < 16)
SELECT id, a AS root, depth, 'ok' AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS rn FROM w) WHERE rn = 1""")
def chain_discovery(spark, sf_dir):
    return chains.discover(lift.parents(spark, sf_dir))


@query("""WITH m AS (SELECT c_nationkey::BIGINT AS member, count(*) AS size FROM customer GROUP BY 1), s AS (SELECT *, (coalesce(sum(size) OVER (ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM m)
SELECT o_orderkey AS "offset", member, o_orderkey - start AS inside, member IS NULL AS zero FROM orders o LEFT JOIN s ON o_orderkey >= start AND o_orderkey < start + size""")
def concat_members(spark, sf_dir):
    m = lift.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("member")).agg(F.count(F.lit(1)).alias("size"))
    return chains.members_at(lift.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offset")), m)


@query("""WITH c AS (SELECT p_partkey AS chunk, p_partkey * 9 AS first, 5 + p_partkey % 5 AS cnt FROM part)
SELECT o_orderkey AS sector, chunk, o_orderkey - first AS inside, chunk IS NULL AS gap FROM orders LEFT JOIN c ON o_orderkey >= first AND o_orderkey < first + cnt""")
def chunk_lookup(spark, sf_dir):
    c = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS chunk", "p_partkey * 9 AS first", "5 + p_partkey % 5 AS count")
    return chains.last_started(lift.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sector")), c, 64)


@query("""WITH s AS (SELECT s_suppkey // 10 AS table_id, s_suppkey % 10 AS seq, (s_suppkey % 10) * 8 + CASE WHEN s_suppkey = 25 THEN 1 ELSE 0 END AS first, CASE WHEN s_suppkey = 47 THEN 7 ELSE 8 END AS cnt, s_suppkey * 100 AS ff, s_suppkey * 100 + CASE WHEN s_suppkey = 63 THEN 150 ELSE 50 END AS fe FROM supplier),
m AS (SELECT *, cnt <= 0 OR first <> coalesce(lag(first + cnt) OVER w, 0) AS fault, coalesce(lag(fe) OVER w > ff, false) AS ffault FROM s WINDOW w AS (PARTITION BY table_id ORDER BY first, seq))
SELECT table_id, count(CASE WHEN fault THEN 1 END) AS breaks, count(CASE WHEN ffault THEN 1 END) AS file_breaks, max(first + cnt)::BIGINT AS covered, count(CASE WHEN fault THEN 1 END) = 0 AND max(first + cnt) = 80 AS sound FROM m GROUP BY 1""")
def segments_tile(spark, sf_dir):
    s = lift.table(spark, sf_dir, "supplier").selectExpr("s_suppkey div 10 AS table_id", "s_suppkey % 10 AS seq", "(s_suppkey % 10) * 8 + if(s_suppkey = 25, 1, 0) AS first", "if(s_suppkey = 47, 7L, 8L) AS count", "s_suppkey * 100 AS file_first", "s_suppkey * 100 + if(s_suppkey = 63, 150, 50) AS file_end", "80L AS n")
    return chains.tiling_faults(s)


@query(f"""WITH all_r AS (SELECT s_suppkey AS a_id, CASE WHEN s_suppkey % 9 = 8 THEN 9223372036854775000 ELSE s_suppkey * 40000 END AS a_start, CASE WHEN s_suppkey % 7 = 3 THEN 3000000000 ELSE (s_suppkey % 4) * 9000 END AS len FROM supplier),
r AS (SELECT a_id, a_start, a_start::HUGEINT + len AS a_end FROM all_r WHERE a_start <= 9223372036854775807 - len), e AS (SELECT block_idx AS b_id, file_offset AS b_start, file_offset + {BLOCK} AS b_end FROM ({lift.BLOCKS_SQL}) WHERE state = 'data')
SELECT a_id, b_id, greatest(a_start, b_start) AS start, least(a_end, b_end)::BIGINT AS "end" FROM r JOIN e ON a_start < b_end AND b_start < a_end AND a_end > a_start
UNION ALL SELECT a_id, NULL, a_start, NULL FROM all_r WHERE len > 0 AND a_start > 9223372036854775807 - len""")
def region_overlap(spark, sf_dir):
    r = lift.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS a_id", "if(s_suppkey % 9 = 8, 9223372036854775000L, s_suppkey * 40000) AS a_start", "if(s_suppkey % 7 = 3, 3000000000L, (s_suppkey % 4) * 9000) AS a_length")
    e = lift.blocks(spark, sf_dir).filter("state = 'data'").selectExpr("block_idx AS b_id", "file_offset AS b_start", f"{BLOCK}L AS b_length")
    return chains.overlaps(r, e, 1 << 20)


@query("""WITH l AS (SELECT l_orderkey AS image_id, l_linenumber AS slot, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber % 3 END AS rank, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_shipdate::VARCHAR END AS bytes, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k FROM lineitem),
s AS (SELECT *, min(rank) OVER (PARTITION BY image_id) AS best FROM l WHERE rank IS NOT NULL), g AS (SELECT image_id, min(k) AS slot, count(DISTINCT bytes) AS kinds, count(CASE WHEN bytes IS NULL THEN 1 END) AS unread, count(*) AS n FROM s WHERE rank = best GROUP BY 1)
SELECT image_id, slot, n > 1 AND (kinds > 1 OR unread > 0) AS ambiguous FROM g""")
def locator_choice(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    t = lift.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.row_number().over(order).cast("long").alias("slot"), F.expr("if(l_returnflag = 'N', null, l_linenumber % 3)").alias("rank"), F.expr("if(l_suppkey % 10 = 0, null, cast(l_shipdate as string))").alias("bytes"))
    return chains.preferred_locator(t).select("image_id", "slot", "ambiguous")


@query("SELECT c_nationkey::BIGINT AS table_id, CASE WHEN count(DISTINCT cs) = 1 AND count(cs) = count(*) THEN max(cs) END AS cluster_size FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 5 = 1 AND c_custkey % 50 = 0 THEN NULL WHEN c_nationkey % 5 = 2 THEN 512 * (1 + c_custkey % 2) ELSE 65536 END::BIGINT AS cs FROM customer) GROUP BY 1")
def common_cluster_size(spark, sf_dir):
    return chains.common_size(lift.table(spark, sf_dir, "customer").selectExpr("cast(c_nationkey as bigint) AS table_id", "case when c_nationkey % 5 = 1 and c_custkey % 50 = 0 then null when c_nationkey % 5 = 2 then 512 * (1 + c_custkey % 2) else 65536L end AS cluster_size"))


@query("SELECT o_orderkey AS block_idx, coalesce(p_retailprice::BIGINT, 0) AS entry FROM orders LEFT JOIN (SELECT p_partkey, floor(p_retailprice) AS p_retailprice FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = o_orderkey")
def table_lookup(spark, sf_dir):
    t = lift.table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").selectExpr("p_partkey div 512 AS slot", "p_partkey % 512 AS idx", "cast(floor(p_retailprice) as bigint) AS entry")
    return chains.lookup(lift.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_idx")), t, 512)


# Sources

BOCHS_HEADER = (formats.BOCHS[0].ljust(32, b"\0") + formats.BOCHS[1].ljust(16, b"\0") + formats.BOCHS[2].ljust(16, b"\0") + (0x20000).to_bytes(4, "little")).ljust(512, b"\0")
HEADERS = {
    "qcow": b"QFI\xfb\0\0\0\1",
    "qcow2": b"QFI\xfb\0\0\0\3",
    "vmdk": b"KDMV\1\0\0\0",
    "vmdk3": b"COWD\3\0\0\0",
    "qed": b"QED\0\0\0\0\0",
    "vhdx": b"vhdxfile",
    "vhd": b"conectix",
    "luks": b"LUKS\xba\xbe\0\1",
    "raw": bytes(8),
    "unknown": bytes(4),
    "vdi": bytes(64) + formats.MAGIC["vdi"],
    "parallels": formats.PARALLELS[0] + (2).to_bytes(4, "little") + bytes(44),
    "parallels ": formats.PARALLELS[1] + (2).to_bytes(4, "little") + bytes(44),
    "raw ": formats.PARALLELS[1] + (3).to_bytes(4, "little") + bytes(44),
    "bochs": BOCHS_HEADER,
    "raw  ": BOCHS_HEADER[:511],
    "cloop": formats.CLOOP,
    "vmdk ": formats.DESCRIPTOR + b"\nversion=1\n",
}


@query(f"SELECT event_id AS id, [{', '.join(repr(name.strip()) for name in HEADERS)}][1 + event_id % {len(HEADERS)}] AS format FROM events")
def detect_formats(spark, sf_dir):
    e = lift.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*(F.lit(raw.hex()) for raw in HEADERS.values())), F.expr(f"cast(1 + event_id % {len(HEADERS)} as int)")).alias("hex"))
    return e.select(F.col("event_id").alias("id"), formats.detect_format(F.unhex("hex")).alias("format"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'none' WHEN s_suppkey % 4 = 1 THEN 'mbr' WHEN s_suppkey % 4 = 2 THEN 'gpt' ELSE 'none' END AS kind FROM supplier")
def partition_tables(spark, sf_dir):
    s = lift.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey % 4 AS k")
    entry = F.expr("case k when 1 then '80000000830000000000000000000000' when 2 then '00000000EE0000000000000000000000' else '11000000830000000000000000000000' end")
    sector = F.unhex(F.concat(F.lit("00" * 446), entry, F.lit("00" * 48), F.expr("if(k = 0, '0000', '55AA')")))
    return s.select("id", formats.partition_table(sector).alias("kind"))


@query("SELECT p_partkey AS image_id, 2::BIGINT AS line_no, 'RW' AS access, (p_size * 63)::BIGINT AS sectors, CASE WHEN p_size % 2 = 0 THEN 'FLAT' ELSE 'SPARSE' END AS kind, p_brand || '.vmdk' AS file, CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE 0 END AS \"offset\" FROM part")
def descriptor_extents(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part")
    line = F.expr("concat('RW ', p_size * 63, if(p_size % 2 = 0, ' FLAT', ' SPARSE'), ' \"', p_brand, '.vmdk\"', if(p_size % 2 = 0, concat(' ', p_partkey), ''))")
    lines = p.select(F.col("p_partkey").alias("image_id"), F.posexplode(F.array(F.lit("# Disk DescriptorFile"), F.lit('parentCID="ffffffff"'), line)).alias("line_no", "line"))
    return formats.descriptor_extents(lines.withColumn("line_no", F.col("line_no").cast("long")))


@query("SELECT l_orderkey AS image_id, max(l_linenumber * 1000 + l_partkey % 1000)::BIGINT AS sequence FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def newest_header(spark, sf_dir):
    t = lift.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image_id", "l_linenumber AS slot", "cast(l_linenumber * 1000 + l_partkey % 1000 as bigint) AS sequence", "l_returnflag <> 'R' AS valid")
    return formats.newest_header(t).select("image_id", "sequence")


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def json_metadata(spark, sf_dir):
    return lift.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint")["k"].alias("value"))


# Plans and scalars

@query("SELECT k AS request, CASE WHEN k = 0 THEN 12345 ELSE (12345 + k * 4096 * 7) % (1048576000 - 4096) END::BIGINT AS \"offset\", (75000 - k - 1) % 100 = 0 AS flush FROM (SELECT unnest(range(0, 75000)) AS k)")
def bench_schedule(spark, sf_dir):
    return schedule.schedule(spark, 75000, 12345, 4096 * 7, 4096, 1048576000, 100)


@query("""WITH q AS (SELECT p_partkey AS id, 1 + p_partkey % 50 AS n, p_partkey * 100 AS o, 4096 * (1 + p_size % 9) AS st, 4096::BIGINT AS b, 20000000::BIGINT AS img, 65536::BIGINT AS u FROM part)
SELECT id, least(n * (b // u + 2), (img + u - 1) // u, CASE WHEN n = 1 OR o + (n - 1) * st + b < img THEN (o + (n - 1) * st + b - 1) // u - o // u + 1 ELSE (img + u - 1) // u END)::BIGINT AS units FROM q""")
def touched_units(spark, sf_dir):
    q = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "1 + p_partkey % 50 AS n", "p_partkey * 100 AS o", "cast(4096 * (1 + p_size % 9) as bigint) AS st")
    return q.select("id", schedule.touched_bound(F.col("n"), F.col("o"), F.col("st"), F.lit(4096).cast("long"), F.lit(20000000).cast("long"), F.lit(65536).cast("long")).alias("units"))


@query("""WITH r AS (SELECT c_custkey AS id, (c_custkey % 5) * 1000 AS old, (c_custkey % 7) * 1000 AS new, ['raw', 'qcow2', 'vmdk', 'vhd'][1 + c_custkey % 4] AS fmt, c_custkey % 3 = 0 AS may FROM customer)
SELECT id, CASE WHEN new = 0 AND fmt IN ('raw', 'qcow2') THEN 'refused_zero' WHEN new = old THEN 'noop' WHEN new > old THEN 'grow' WHEN fmt NOT IN ('raw', 'qcow2') THEN 'refused_format' WHEN NOT may THEN 'refused_shrink' ELSE 'shrink' END AS action FROM r""")
def resize_plan(spark, sf_dir):
    r = lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "(c_custkey % 5) * 1000 AS old", "(c_custkey % 7) * 1000 AS new", "element_at(array('raw', 'qcow2', 'vmdk', 'vhd'), cast(1 + c_custkey % 4 as int)) AS fmt", "c_custkey % 3 = 0 AS may")
    return r.select("id", schedule.resize_action(F.col("old"), F.col("new"), F.col("fmt"), F.col("may")).alias("action"))


@query("""WITH r AS (SELECT p_partkey AS id, 2 + p_partkey % 2 AS ver, p_partkey % 2 = 1 AND p_partkey % 3 = 0 AS lazy, CASE WHEN p_size % 10 = 0 THEN 1 WHEN p_size % 10 = 1 THEN 8 ELSE 0 END AS inc, CASE WHEN p_size % 7 = 0 THEN 8 ELSE 16 END AS bits, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 2 + p_size % 2 END AS wv, CASE WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 5 = 1 THEN false END AS wl FROM part),
t AS (SELECT *, coalesce(wv, ver) AS tv, CASE WHEN ver = 3 AND coalesce(wv, ver) = 2 THEN false ELSE coalesce(wl, lazy) END AS la FROM r)
SELECT id, CASE WHEN inc & 3 <> 0 THEN 'dirty' WHEN coalesce(wl, false) AND tv = 2 THEN 'lazy_requires_v3' WHEN ver = 3 AND tv = 2 AND inc <> 0 THEN 'downgrade_blocked_feature' WHEN ver = 3 AND tv = 2 AND bits <> 16 THEN 'downgrade_refcount_width' WHEN tv = ver AND la = lazy THEN 'noop' WHEN tv = ver THEN 'lazy_word' ELSE 'rebuild' END AS action FROM t""")
def amend_plan(spark, sf_dir):
    r = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "2 + p_partkey % 2 AS ver", "p_partkey % 2 = 1 and p_partkey % 3 = 0 AS lazy", "case when p_size % 10 = 0 then 1 when p_size % 10 = 1 then 8 else 0 end AS inc", "if(p_size % 7 = 0, 8, 16) AS bits", "if(p_size % 3 = 0, null, 2 + p_size % 2) AS wv", "case when p_partkey % 5 = 0 then true when p_partkey % 5 = 1 then false end AS wl")
    return r.select("id", schedule.amend_action(*(F.col(c) for c in ("ver", "lazy", "inc", "bits", "wv", "wl"))).alias("action"))


@query("""WITH w AS (SELECT o_orderkey AS block_idx, o_orderstatus = 'P' AS fresh FROM orders), s AS (SELECT 0 AS class, 'data' AS kind, block_idx FROM w UNION ALL SELECT c, k, block_idx FROM w, (VALUES (1, 'l2'), (2, 'l1'), (3, 'refcount')) v(c, k) WHERE fresh)
SELECT class, kind, count(*) AS writes, min(block_idx) AS first_block, max(block_idx) AS last_block FROM s GROUP BY 1, 2""")
def write_program(spark, sf_dir):
    return schedule.write_steps(lift.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS write_id", "o_orderkey AS block_idx", "o_orderstatus = 'P' AS fresh"))


@query("""WITH s AS (SELECT o_custkey AS job, o_orderkey AS done, (o_orderkey * 100 // (SELECT max(o_orderkey) FROM orders)) AS pct FROM orders) SELECT job, done, coalesce(pct // 10 > lag(pct // 10) OVER (PARTITION BY job ORDER BY done), pct // 10 > 0) AS report FROM s""")
def progress_reports(spark, sf_dir):
    o = lift.table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderkey").alias("last"))
    steps = o.crossJoin(F.broadcast(last)).selectExpr("o_custkey AS job", "o_orderkey AS done", "o_orderkey * 100 div last AS percent")
    return schedule.progress_marks(steps, 10).select("job", "done", "report")


@query("""WITH l AS (SELECT p_brand AS key, p_partkey % 4 AS precedence, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS value, ['default', 'system', 'user', 'flag'][1 + p_partkey % 4] AS origin FROM part)
SELECT key, value, origin FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY precedence DESC, value DESC) AS rn FROM l WHERE value IS NOT NULL) WHERE rn = 1""")
def config_merge(spark, sf_dir):
    return schedule.merged_config(lift.table(spark, sf_dir, "part").selectExpr("p_brand AS key", "p_partkey % 4 AS precedence", "if(p_size % 3 = 0, null, p_type) AS value", "element_at(array('default', 'system', 'user', 'flag'), cast(1 + p_partkey % 4 as int)) AS origin"))


@query("SELECT event_id AS id, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024) ELSE b || ' B' END AS size FROM (SELECT event_id, event_id * event_id * 37 AS b FROM events)")
def human_sizes(spark, sf_dir):
    return lift.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), S.human_bytes(F.expr("event_id * event_id * 37")).alias("size"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 + 524288 ELSE NULL END::BIGINT AS bytes FROM part")
def size_literals(spark, sf_dir):
    text = F.expr("case p_partkey % 4 when 0 then cast(p_size as string) when 1 then concat('+', p_size, 'k') when 2 then concat(p_size, '.5M') else concat(p_size, '.5') end")
    return lift.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.parse_size(text).cast("long").alias("bytes"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN 0 ELSE (p_partkey - 1) // (1 + p_size) + 1 END AS units, CASE WHEN p_partkey = 0 THEN 0 ELSE ((p_partkey - 1) // 512 + 1) * 512 END AS rounded, p_size IN (1, 2, 4, 8, 16, 32, 64) AS power FROM part")
def integer_math(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), S.ceil_div(F.col("p_partkey"), F.expr("1 + p_size")).alias("units"), S.round_up(F.col("p_partkey"), 512).alias("rounded"), S.is_power_of_two(F.col("p_size")).alias("power"))


@query("SELECT event_id AS id, printf('%04d:%02d:%02d.%03d', event_id * 98765 // 3600000, event_id * 98765 // 60000 % 60, event_id * 98765 // 1000 % 60, event_id * 98765 % 1000) AS clock FROM events")
def vm_clocks(spark, sf_dir):
    return lift.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), S.vm_clock(F.expr("event_id * 98765000000")).alias("clock"))


@query("SELECT r_regionkey AS id, ['/a/c', '../x', 'a/b', '/', '/q'][1 + r_regionkey] AS path FROM region")
def normal_paths(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["/a/./b/../c", "../a/../x", "a//b/", "/../..", "//q/."])), F.expr("cast(1 + r_regionkey as int)"))
    return lift.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), S.normal_path(raw).alias("path"))


@query("SELECT n_nationkey AS id, ['unknown', 'raw', 'qcow2', 'vmdk', 'vmdk3', 'vhd', 'vhdx', 'qcow', 'vdi', 'qed', 'iso', 'luks', 'vmdk', 'parallels', 'bochs', 'cloop', 'dmg'][1 + n_nationkey % 17] AS name FROM nation")
def format_names(spark, sf_dir):
    return lift.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), S.format_name(F.expr("n_nationkey % 17")).alias("name"))


@query("SELECT n_nationkey AS id, 7 AS major, n_nationkey AS minor, n_name AS text FROM nation")
def version_and_text(spark, sf_dir):
    n = lift.table(spark, sf_dir, "nation")
    v = S.version_parts(F.concat(F.lit("tool version 7."), F.col("n_nationkey"), F.lit(".1 (x)")))
    text = S.utf16_text(F.concat(F.encode("n_name", "UTF-16LE"), F.unhex(F.lit("00004100"))), big=False)
    return n.select(F.col("n_nationkey").alias("id"), v["major"].alias("major"), v["minor"].alias("minor"), text.alias("text"))


# Containers, references, geometry

CHS_SIZES = "SELECT c_custkey AS id, c_custkey * c_custkey * 20011 AS size FROM customer"


def chs_of(n: str) -> str:
    """Cylinders times heads, heads and track of ``n`` sectors, step by step in SQL."""
    return f"""SELECT id, size, r, n, CASE WHEN n >= 65535 * 16 * 63 THEN n // 255 // 16 WHEN t >= 16384 OR h > 16 OR t >= h * 1024 THEN CASE WHEN n // 31 >= 16384 THEN n // 63 // 16 ELSE n // 31 // 16 END ELSE t // h END AS c,
  CASE WHEN n >= 65535 * 16 * 63 OR h > 16 OR t >= h * 1024 THEN 16 ELSE h END AS h, CASE WHEN n >= 65535 * 16 * 63 THEN 255 WHEN h > 16 OR t >= h * 1024 THEN CASE WHEN n // 31 >= 16384 THEN 63 ELSE 31 END ELSE 17 END AS s
  FROM (SELECT *, n // 17 AS t, greatest(4, (n // 17 + 1023) // 1024) AS h FROM ({n}))"""


@query(f"""WITH z AS (SELECT id, size, (size + 511) // 512 AS r FROM ({CHS_SIZES})),
tried AS (SELECT id, arg_min({{'c': c, 'h': h, 's': s}}, n) AS g FROM ({chs_of("SELECT id, size, r, unnest(range(r, r + 8200)) AS n FROM z")}) WHERE r > 0 AND c * h * s >= r GROUP BY id),
low AS ({chs_of("SELECT id, size, r, size // 512 AS n FROM z")}),
pair AS (SELECT id, size, coalesce(g.c, 0) AS cc, coalesce(g.h, 0) AS ch, coalesce(g.s, 0) AS cs, low.c AS c, low.h AS h, low.s AS s FROM low LEFT JOIN tried USING (id))
SELECT id, size, (cc * ch * cs * 512)::BIGINT AS rounded, (CASE WHEN cc * ch * cs * 512 = size THEN cc ELSE c END)::BIGINT AS cylinders, (CASE WHEN cc * ch * cs * 512 = size THEN ch ELSE h END)::INT AS heads, (CASE WHEN cc * ch * cs * 512 = size THEN cs ELSE s END)::INT AS track FROM pair""")
def footer_geometry(spark, sf_dir):
    sizes_ = lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey * c_custkey * 20011 AS size")
    g = sizes_.withColumn("covering", chs.covering_geometry(F.col("size")))
    return g.select("id", "size", chs.rounded_size(F.col("size"), F.col("covering")).alias("rounded"), chs.footer_geometry(F.col("size"), F.col("covering")).alias("g")).select("id", "size", "rounded", "g.cylinders", "g.heads", "g.track")


IMAGE_NAMES = """CASE c_custkey % 8 WHEN 0 THEN 'base' || c_custkey % 40 || '.raw' WHEN 1 THEN './x/../base' || c_custkey % 40 || '.raw' WHEN 2 THEN '/img/n' || c_nationkey || '/base' || c_custkey % 40 || '.raw'
  WHEN 3 THEN '/old/host/base' || c_custkey % 40 || '.raw' WHEN 4 THEN '../../etc/secret' WHEN 5 THEN '/etc/secret' WHEN 6 THEN '../../img/n' || c_nationkey || '/link' WHEN 7 THEN '' END"""
FILES = """SELECT '/img/n' || n_nationkey || '/base' || k || '.raw' AS path, '/img/n' || n_nationkey || '/base' || k || '.raw' AS physical FROM nation, (SELECT s_suppkey % 40 AS k FROM supplier GROUP BY 1) WHERE (n_nationkey + k) % 2 = 0
UNION ALL SELECT '/etc/secret', '/etc/secret' FROM region WHERE r_regionkey = 0
UNION ALL SELECT '/img/n' || n_nationkey || '/link', CASE n_nationkey % 3 WHEN 0 THEN '/etc/secret' WHEN 1 THEN '/img/shared' END FROM nation"""


@query(f"""WITH f AS ({FILES}),
r AS (SELECT c_custkey AS ref_id, c_custkey % 8 AS kind, c_custkey % 3 = 0 AS writes, '/img/n' || c_nationkey || '/base' || c_custkey % 40 || '.raw' AS near, '/img/n' || c_nationkey || '/link' AS link FROM customer),
j AS (SELECT r.*, f.path IS NOT NULL AS there, l.physical AS leads FROM r LEFT JOIN f ON f.path = near LEFT JOIN f l ON l.path = link)
SELECT ref_id, o AS outcome, CASE WHEN o IN ('found', 'beside') THEN CASE WHEN kind = 6 THEN leads ELSE near END END AS path FROM (SELECT *, CASE WHEN kind = 7 THEN 'none' WHEN kind IN (0, 1, 2) THEN CASE WHEN there THEN 'found' ELSE 'not_found' END WHEN kind = 3 THEN CASE WHEN there AND NOT writes THEN 'beside' ELSE 'not_allowed' END WHEN kind IN (4, 5) THEN 'not_allowed' WHEN leads IS NULL THEN 'loop' WHEN leads = '/etc/secret' THEN 'not_allowed' ELSE 'found' END AS o FROM j)""")
def allowed_references(spark, sf_dir):
    for name in ("nation", "supplier", "region"):
        lift.table(spark, sf_dir, name).createOrReplaceTempView(f"blocklens_{name}")
    # The listing is a few rows per nation; its SQL is the same in both dialects.
    files = spark.sql(FILES.replace("FROM nation", "FROM blocklens_nation").replace("FROM supplier", "FROM blocklens_supplier").replace("FROM region", "FROM blocklens_region"))
    refs = lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS ref_id", "'/img/n' || c_nationkey || '/top.qcow2' AS image", f"{IMAGE_NAMES} AS reference", "c_custkey % 3 = 0 AS writes")
    return paths.resolve_references(refs, files, ["/img"])


@query("""WITH d AS (SELECT l_orderkey AS chain_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS slot, l_orderkey % 7 AS k FROM lineitem),
e AS (SELECT chain_id, slot, CASE WHEN k = 2 THEN 'raw' ELSE 'qcow2' END AS fmt, slot = 1 AND k <> 3 AS is_data, CASE WHEN slot = 0 AND k <> 4 THEN CASE WHEN k = 5 THEN 2 ELSE 1 END ELSE 0 END AS ds, k = 6 AND slot = 1 AS top FROM d),
m AS (SELECT *, lead(is_data) OVER w AS nd, lag(ds) OVER w AS pd FROM e WINDOW w AS (PARTITION BY chain_id ORDER BY slot))
SELECT chain_id, NOT bool_or((ds <> 0 AND NOT coalesce(NOT is_data AND fmt = 'qcow2' AND ds = slot + 1 AND nd, false)) OR (is_data AND (coalesce(pd, 0) <> slot OR top))) AS owned FROM m GROUP BY 1""")
def data_device_owners(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    d = lift.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain_id"), (F.row_number().over(order) - 1).cast("long").alias("slot"), F.expr("l_orderkey % 7 AS k"))
    devices = d.selectExpr("chain_id", "slot", "if(k = 2, 'raw', 'qcow2') AS format", "slot = 1 and k <> 3 AS is_data", "if(slot = 0 and k <> 4, if(k = 5, 2, 1), 0) AS data_slot")
    return chains.data_devices_owned(devices, d.filter("k = 6 and slot = 1"))


def le(value: str, size: int) -> Column:
    """Little-endian hex of a whole number's expression."""
    return F.concat(*(F.lpad(F.hex(F.expr(f"shiftright(cast({value} as bigint), {8 * i}) & 255")), 2, "0") for i in range(size)))


def be(value: str, size: int) -> Column:
    return F.lpad(F.hex(F.expr(f"cast({value} as bigint)")), 2 * size, "0")


@query("""SELECT p_partkey AS image_id, r AS region, CASE r WHEN 'bat' THEN p_partkey * 1048576 WHEN 'metadata' THEN 2097152 ELSE 77 END::BIGINT AS file_offset, CASE r WHEN 'bat' THEN p_size * 65536 ELSE 1048576 END::BIGINT AS length, r <> 'unknown' OR p_size % 5 = 0 AS required
FROM part, (VALUES ('bat'), ('metadata'), ('unknown')) v(r) WHERE p_partkey % 4 <> 0 AND (r <> 'unknown' OR p_partkey % 3 = 0)""")
def vhdx_region_table(spark, sf_dir):
    return containers.vhdx_regions(region_tables(spark, sf_dir))


def region_tables(spark, sf_dir) -> DataFrame:
    bat = F.concat(F.lit(containers.stored(containers.REGIONS["bat"])), le("p_partkey * 1048576", 8), le("p_size * 65536", 4), le("1", 4))
    meta = F.concat(F.lit(containers.stored(containers.REGIONS["metadata"])), le("2097152", 8), le("1048576", 4), le("1", 4))
    other = F.concat(F.lit("AB" * 16), le("77", 8), le("1048576", 4), le("if(p_size % 5 = 0, 1, 0)", 4))
    head = F.concat(F.lit("72656769" + "00" * 4), le("if(p_partkey % 3 = 0, 3, 2)", 4), F.lit("00" * 4))
    return lift.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.unhex(F.concat(head, bat, meta, other)).alias("raw"), F.expr("p_partkey % 4 <> 0").alias("good"))


@query("SELECT p_partkey AS image_id, NOT (p_partkey % 3 = 0 AND p_size % 5 = 0) AS usable FROM part WHERE p_partkey % 4 <> 0")
def vhdx_usable_regions(spark, sf_dir):
    return containers.usable_regions(containers.vhdx_regions(region_tables(spark, sf_dir)))


@query("""SELECT s_suppkey AS image_id, i AS item, (65536 + s_suppkey * n)::BIGINT AS item_offset, (8 * n)::BIGINT AS length, n = 3 AS "user", n = 2 AS virtual_disk, n <> 3 AS required FROM supplier, (VALUES (1, 'file_parameters'), (2, 'virtual_disk_size'), (3, 'unknown')) v(n, i)""")
def vhdx_metadata_table(spark, sf_dir):
    def entry(identifier: str, n: int, flags: int) -> Column:
        return F.concat(F.lit(identifier), le(f"65536 + s_suppkey * {n}", 4), le(str(8 * n), 4), le(str(flags), 4), F.lit("00" * 4))

    head = F.lit("6D657461646174610000" + "0300" + "00" * 20)
    raw = F.concat(head, entry(containers.stored(containers.ITEMS["file_parameters"]), 1, 4), entry(containers.stored(containers.ITEMS["virtual_disk_size"]), 2, 6), entry("CD" * 16, 3, 1))
    return containers.vhdx_metadata(lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.unhex(raw).alias("raw")))


@query("""SELECT s_suppkey AS image_id, 'aes' AS cipher, 'xts-plain64' AS mode, 'sha256' AS hash, 4096 * 512::BIGINT AS payload_offset, 64::BIGINT AS key_bytes, 'id-' || s_suppkey AS uuid, slot::INT AS slot, (1000 + s_suppkey)::BIGINT AS iterations, ((8 + slot * 512) * 512)::BIGINT AS key_offset, 4000::BIGINT AS stripes FROM supplier, range(8) t(slot) WHERE (s_suppkey + slot) % 3 = 0""")
def luks_key_slots(spark, sf_dir):
    text = lambda value, size: F.rpad(F.hex(F.encode(value, "UTF-8")), 2 * size, "0")
    slots = [F.concat(F.expr(f"if((s_suppkey + {i}) % 3 = 0, '00AC71F3', '0000DEAD')"), be("1000 + s_suppkey", 4), F.lit("11" * 32), be(str(8 + i * 512), 4), be("4000", 4)) for i in range(8)]
    uuid = F.concat(F.lit("id-"), F.col("s_suppkey"))
    raw = F.concat(F.lit("4C554B53BABE0001"), text(F.lit("aes"), 32), text(F.lit("xts-plain64"), 32), text(F.lit("sha256"), 32), be("4096", 4), be("64", 4), F.lit("00" * 56), text(uuid, 40), *slots)
    return containers.luks1(lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.unhex(raw).alias("raw")))


@query("SELECT event_id AS image_id, '0' AS segment, 'crypt' AS type, event_id * 4096 AS start, CASE WHEN event_id % 2 = 0 THEN event_id END AS length, 'aes-xts-plain64' AS encryption, 512::BIGINT AS sector_size FROM events")
def luks_segments(spark, sf_dir):
    json = F.expr("""concat('{"segments":{"0":{"type":"crypt","offset":"', event_id * 4096, '","size":"', if(event_id % 2 = 0, cast(event_id as string), 'dynamic'), '","encryption":"aes-xts-plain64","sector_size":512}}}')""")
    return containers.luks2_segments(lift.table(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), json.alias("json")))


@query("""SELECT s_suppkey AS image_id, 100000 - 512 - s_suppkey % 512 AS koly_offset, 0::BIGINT AS data_fork_offset, 5::BIGINT AS resource_offset, 6::BIGINT AS resource_length, s_suppkey * 512 AS xml_offset, 4096::BIGINT AS xml_length, s_suppkey * 8 AS sectors FROM supplier WHERE s_suppkey % 4 <> 0""")
def dmg_trailer(spark, sf_dir):
    mark = F.expr("if(s_suppkey % 4 = 0, '6B6F6C7A', '6B6F6C79')")
    body = F.concat(mark, F.lit("00" * 20), be("0", 8), F.lit("00" * 8), be("5", 8), be("6", 8), F.lit("00" * 160), be("s_suppkey * 512", 8), be("4096", 8), F.lit("00" * 260), be("s_suppkey * 8", 8), F.lit("00" * 12))
    # Bytes beyond ASCII before the mark, and as many after the trailer as the supplier's key.
    tail = F.unhex(F.concat(F.expr("repeat('FF', cast(512 - s_suppkey % 512 as int))"), body, F.expr("repeat('C3', cast(s_suppkey % 512 as int))")))
    rows_ = lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), tail.alias("tail"), F.lit(100000).cast("long").alias("length"))
    return containers.dmg_trailers(rows_)


@query("SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name || chr(128512) WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '' END AS text FROM nation")
def strict_utf16(spark, sf_dir):
    n = lift.table(spark, sf_dir, "nation")
    raw = F.concat(F.expr("if(n_nationkey % 5 = 4, '', hex(encode(n_name, 'UTF-16BE')))"), F.element_at(F.array(*map(F.lit, ["0000D800", "D83DDE00", "DE00", "D83D0041", "0000"])), F.expr("cast(n_nationkey % 5 + 1 as int)")))
    return n.select(F.col("n_nationkey").alias("id"), S.utf16_text(F.unhex(raw), big=True).alias("text"))


from blocklens import queries_tables  # noqa: E402, F401
