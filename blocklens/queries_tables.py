"""Queries over block tables, checks by format, placements and plans; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens import lift
from blocklens.functions import scalars as S
from blocklens.operators import bitmaps, chains, checks, integrity, layers, lookups, snapshots
from blocklens.plans import schedule, sizes
from blocklens.queries import BOTH_SQL, EXTENTS_SQL, all_extents, be, delta_sql, fixed_point_sql, le, query
from blocklens.sources import containers, formats

# Lookups

OFFSETS = "o_orderkey * 262144 + 77"


@query("SELECT p_partkey AS image_id, 0::BIGINT AS start, p_size::BIGINT AS length, 'data' AS state, 0::BIGINT AS file_offset FROM part WHERE p_size > 3 AND p_size % 7 <> 0")
def raw_extents(spark, sf_dir):
    return lookups.raw_extent(lift.table(spark, sf_dir, "part").filter("p_size > 3").selectExpr("p_partkey AS image_id", "if(p_size % 7 = 0, 0L, cast(p_size as bigint)) AS size"))


@query(f"""WITH t AS (SELECT p_partkey AS b, CASE p_partkey % 7 WHEN 0 THEN 4294967295 WHEN 1 THEN 4294967294 ELSE p_partkey * 3 + p_size END AS e FROM part), o AS (SELECT {OFFSETS} AS ofs FROM orders),
j AS (SELECT ofs, ofs // 1048576 < 1500 AND coalesce(e < 4294967294, false) AS ok, e FROM o LEFT JOIN t ON b = ofs // 1048576)
SELECT ofs AS "offset", ok AS allocated, CASE WHEN ok THEN 2097152 + e * 1048576 + ofs % 1048576 END AS host FROM j""")
def vdi_lookup(spark, sf_dir):
    t = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS block_idx", "case p_partkey % 7 when 0 then 4294967295L when 1 then 4294967294L else p_partkey * 3 + p_size end AS entry")
    return lookups.vdi_lookup(lift.table(spark, sf_dir, "orders").selectExpr(f"{OFFSETS} AS offset"), t, 1 << 20, 1500, 2 << 20)


@query("""WITH t AS (SELECT p_partkey AS b, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey * 2 + 1 END AS e FROM part), o AS (SELECT o_orderkey * 20000 AS ofs FROM orders),
j AS (SELECT m, ofs, coalesce(e, 0) <> 0 AS ok, e FROM (VALUES (1), (128)) v(m), o LEFT JOIN t ON b = ofs // 65536)
SELECT m::BIGINT AS multiplier, ofs AS "offset", ok AS allocated, CASE WHEN ok THEN e * m * 512 + ofs % 65536 END AS host FROM j""")
def parallels_lookup(spark, sf_dir):
    t = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS block_idx", "if(p_partkey % 5 = 0, 0L, p_partkey * 2 + 1) AS entry")
    o = lift.table(spark, sf_dir, "orders").selectExpr("o_orderkey * 20000 AS offset")
    found = [lookups.parallels_lookup(o, t, 65536, F.lit(m).cast("long")).select(F.lit(m).cast("long").alias("multiplier"), "offset", "allocated", "host") for m in (1, 128)]
    return found[0].unionByName(found[1])


QCOW1_ENTRY = "CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN -9223372036854775807 - 1 + (o_orderkey % 4096) * 2251799813685248 + o_orderkey * 100 ELSE o_orderkey * 4096 END"


@query(f"""WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey // 512 % 3 = 1 THEN 0 ELSE {QCOW1_ENTRY} END AS e FROM orders)
SELECT k * 4096 + 5 AS "offset", CASE WHEN e = 0 THEN 'backing' WHEN e < 0 THEN 'compressed' ELSE 'data' END AS state, CASE WHEN e < 0 THEN k * 100 WHEN e > 0 THEN e + 5 END AS host, CASE WHEN e < 0 THEN k % 4096 END AS size FROM e""")
def qcow1_lookup(spark, sf_dir):
    o = lift.table(spark, sf_dir, "orders")
    l1 = o.select(F.expr("o_orderkey div 512").alias("l1_idx")).distinct().select("l1_idx", F.expr("if(l1_idx % 3 = 1, 0L, (l1_idx + 1) * 65536)").alias("l2_table"))
    l2 = o.selectExpr("(o_orderkey div 512 + 1) * 65536 AS l2_table", "o_orderkey % 512 AS l2_idx", f"{QCOW1_ENTRY} AS entry")
    return lookups.qcow1_lookup(o.selectExpr("o_orderkey * 4096 + 5 AS offset"), l1, l2, 12, 9)


QCOW2_ENTRY = "CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN o_orderkey * 65536 + 1 WHEN 3 THEN 4611686018427387904 + o_orderkey * 700 ELSE -9223372036854775807 - 1 + o_orderkey * 65536 END"


@query(f"""WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey // 8192 % 4 = 3 THEN 0 ELSE 1 + o_orderkey % 6 END AS m FROM orders)
SELECT k * 65536 + 9 AS "offset", ['hole', 'hole', 'zero', CASE WHEN k = 0 THEN 'zero' ELSE 'zero_at' END, 'compressed', CASE WHEN k = 0 THEN 'hole' ELSE 'data' END, CASE WHEN k = 0 THEN 'hole' ELSE 'data' END][m + 1] AS state,
 CASE WHEN m = 4 THEN k * 700 WHEN m IN (3, 5, 6) AND k > 0 THEN k * 65536 + 9 END AS host FROM e""")
def qcow2_lookup(spark, sf_dir):
    o = lift.table(spark, sf_dir, "orders")
    l1 = o.select(F.expr("o_orderkey div 8192").alias("l1_idx")).distinct().select("l1_idx", F.expr("if(l1_idx % 4 = 3, 0L, (l1_idx + 1) * 65536)").alias("l1_entry"))
    l2 = o.selectExpr("(o_orderkey div 8192 + 1) * 65536 AS l2_table", "o_orderkey % 8192 AS l2_idx", f"{QCOW2_ENTRY} AS entry")
    return lookups.qcow2_lookup(o.selectExpr("o_orderkey * 65536 + 9 AS offset"), l1, l2, 16)


@query("""WITH m AS (SELECT c_nationkey::BIGINT AS member, count(*) AS size, count(*) - c_nationkey % 5 AS held FROM customer GROUP BY c_nationkey), s AS (SELECT *, (coalesce(sum(size) OVER (ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM m)
SELECT o_orderkey AS "offset", member, o_orderkey - start AS inside, member IS NULL OR o_orderkey - start >= held AS zero FROM orders LEFT JOIN s ON o_orderkey >= start AND o_orderkey < start + size""")
def concat_padded_members(spark, sf_dir):
    m = lift.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("member")).agg(F.count(F.lit(1)).alias("size")).withColumn("held", F.expr("size - member % 5"))
    return chains.members_at(lift.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offset")), m, chunk=100)


# Checks by format

VHD_ENTRY = "CASE WHEN l_partkey % 6 = 0 THEN 4294967295 WHEN l_partkey % 50 = 1 THEN 100000000 + l_partkey ELSE l_suppkey * 4104 + (l_linenumber % 2) * 8 END"
VHD_ROWS = "SELECT l_orderkey % 500 AS image_id, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS slot, {} AS entry, 250000000 AS size FROM lineitem"


@query(f"""WITH t AS ({VHD_ROWS.format(VHD_ENTRY)}), r AS (SELECT image_id, slot, entry * 512 AS pl, entry <> 4294967295 AS used, entry <> 4294967295 AND entry * 512 + 2097664 <= size AS good FROM t),
c AS (SELECT image_id, count(*) AS clusters_checked, count(CASE WHEN used THEN 1 END) AS clusters_allocated, count(CASE WHEN used AND NOT good THEN 1 END) AS out_of_file FROM r GROUP BY 1),
s AS (SELECT image_id, sum(n - 1)::BIGINT AS ov FROM (SELECT image_id, pl // 2097664 AS k, count(*) AS n FROM r WHERE good GROUP BY 1, 2) GROUP BY 1)
SELECT c.*, coalesce(ov, 0) AS "overlaps", out_of_file + coalesce(ov, 0) AS corruptions FROM c LEFT JOIN s USING (image_id)""")
def check_vhd(spark, sf_dir):
    t = lift.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 AS image_id", "l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS slot", f"{VHD_ENTRY} AS entry", "250000000L AS size")
    # Line items can share a place, which leaves the order of slots open.
    return checks.check_vhd(t, 2097664).drop("fragmentation")


VHDX_ENTRY = "CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 7 WHEN 3 THEN 5 ELSE (l_partkey % 60) * 1048576 + 6 END"


@query(f"""WITH t AS (SELECT l_orderkey % 300 AS image_id, l_suppkey AS slot, {VHDX_ENTRY} AS entry, 50 * 1048576 AS size, 150 * 1048576 + 512 * l_orderkey AS vsize FROM lineitem),
r AS (SELECT *, entry % 8 AS st, entry // 1048576 * 1048576 AS pl, vsize - slot * 2097152 AS remain FROM t),
v AS (SELECT *, CASE WHEN st IN (0, 1, 2, 3) THEN 'absent' WHEN st = 7 THEN 'partial' WHEN st <> 6 THEN 'unknown' WHEN remain < 0 THEN 'past_end' WHEN pl >= size OR pl + least(remain, 2097152) > size THEN 'out_of_file' WHEN pl = 0 THEN 'offset_zero'
 WHEN pl < 3 * 1048576 AND pl + 2097152 > 1048576 OR pl < (12 + image_id % 3) * 1048576 AND pl + 2097152 > 11 * 1048576 THEN 'in_region' ELSE 'good' END AS verdict FROM r),
c AS (SELECT image_id, count(*) AS clusters_checked, count(CASE WHEN st = 6 THEN 1 END) AS clusters_allocated, count(CASE WHEN verdict NOT IN ('absent', 'good') THEN 1 END) AS bad_entries FROM v GROUP BY 1),
s AS (SELECT image_id, sum(n - 1)::BIGINT AS ov FROM (SELECT image_id, pl // 2097152 AS k, count(*) AS n FROM v WHERE verdict = 'good' GROUP BY 1, 2) GROUP BY 1)
SELECT c.*, coalesce(ov, 0) AS "overlaps", bad_entries + coalesce(ov, 0) AS corruptions FROM c LEFT JOIN s USING (image_id)""")
def check_vhdx(spark, sf_dir):
    t = lift.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 300 AS image_id", "l_suppkey AS slot", f"{VHDX_ENTRY} AS entry", "50 * 1048576L AS size", "150 * 1048576L + 512 * l_orderkey AS virtual_size")
    ids = t.select("image_id").distinct()
    regions = ids.selectExpr("image_id", "1048576L AS region_offset", "2097152L AS region_length").unionByName(ids.selectExpr("image_id", "11 * 1048576L AS region_offset", "(1 + image_id % 3) * 1048576L AS region_length"))
    return checks.check_vhdx(t, regions, 2 << 20)


GD_ENTRY = "CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 9 = 1 THEN 900000000 ELSE (s_suppkey + 1) * 128 END"
GT_ENTRY = "CASE p_partkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 900000000 + p_partkey ELSE (p_partkey % 900) * 128 END"


@query(f"""WITH gd AS (SELECT s_suppkey AS gd, {GD_ENTRY} AS e FROM supplier), g AS (SELECT *, e <> 0 AND e * 512 < 65536000 AND e * 512 + 2048 <= 65536000 AS ok FROM gd),
gt AS (SELECT p_partkey // 512 AS gd, p_partkey % 512 AS i, {GT_ENTRY} AS e FROM part), w AS (SELECT gt.*, CASE WHEN gt.e = 0 THEN 'empty' WHEN gt.e = 1 THEN 'zero' WHEN gt.e * 512 >= 65536000 THEN 'out' ELSE 'good' END AS v FROM gt JOIN g ON gt.gd = g.gd WHERE ok),
claim AS (SELECT e * 512 // 65536 AS c, gd * 513 + i + 1 AS pos, NULL AS quiet FROM w WHERE v = 'good' UNION ALL SELECT unnest(range(e * 512 // 65536, (e * 512 + 2047) // 65536 + 1)), NULL, gd * 513 FROM g WHERE ok),
per AS (SELECT c, count(pos) AS n, min(pos) AS f, min(quiet) AS q FROM claim GROUP BY c), o AS (SELECT coalesce(sum(CASE WHEN n > 0 THEN n - 1 + CASE WHEN q < f THEN 1 ELSE 0 END ELSE 0 END), 0)::BIGINT AS ov FROM per),
a AS (SELECT count(*) AS n, count(CASE WHEN ok THEN 1 END) AS good, count(CASE WHEN e <> 0 AND NOT ok THEN 1 END) AS bad FROM g), b AS (SELECT count(*) AS n, count(CASE WHEN v = 'good' THEN 1 END) AS good, count(CASE WHEN v = 'zero' THEN 1 END) AS z, count(CASE WHEN v = 'out' THEN 1 END) AS bad FROM w)
SELECT a.n + b.n AS clusters_checked, a.good + b.good AS clusters_allocated, z AS zero_grains, ov AS "overlaps", a.bad + b.bad + ov AS corruptions FROM a, b, o""")
def check_vmdk(spark, sf_dir):
    gd = lift.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS gd_idx", f"{GD_ENTRY} AS entry", "65536000L AS size")
    gt = lift.table(spark, sf_dir, "part").selectExpr("p_partkey div 512 AS gd_idx", "p_partkey % 512 AS gt_idx", f"{GT_ENTRY} AS entry")
    return checks.check_vmdk(gd, gt, 65536, 2048)


@query("SELECT l_suppkey AS image_id, count(CASE WHEN (l_partkey * 8 + l_linenumber) % 8 = 6 THEN 1 END) AS bat, count(CASE WHEN l_partkey % 4 > 1 THEN 1 END) AS gt, count(CASE WHEN l_partkey % 3 <> 0 THEN 1 END) AS gd FROM lineitem GROUP BY 1")
def table_counts(spark, sf_dir):
    return checks.table_counts(lift.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS image_id", "l_partkey * 8 + l_linenumber AS bat", "l_partkey % 4 AS gt", "l_partkey % 3 AS gd"))


# Sizes and layouts

VHDX_SIZES = "SELECT c_custkey AS id, c_custkey * c_custkey * 33554432 + c_custkey % 600 AS v, c_custkey % 9 AS u, c_custkey * 1000000 AS a FROM customer"


@query(f"""WITH s AS (SELECT id, (v + 511) // 512 * 512 AS v, u, a FROM ({VHDX_SIZES})), b AS (SELECT *, CASE WHEN v > 35184372088832 THEN 67108864 WHEN v > 107374182400 THEN 33554432 WHEN v > 1073741824 THEN 16777216 ELSE 8388608 END AS bs FROM s),
l AS (SELECT *, (v + bs - 1) // bs AS n, 4294967296 // bs AS ratio FROM b), e AS (SELECT *, greatest(((n + CASE WHEN n > 0 THEN (n - 1) // ratio ELSE 0 END) * 8 + 1048575) // 1048576 * 1048576, 1048576) AS bat FROM l)
SELECT id, 'dynamic' AS kind, (3145728 + bat + CASE WHEN u <> 0 THEN u ELSE (a + bs - 1) // bs END * bs)::BIGINT AS required, (3145728 + bat + n * bs)::BIGINT AS fully_allocated FROM e
UNION ALL SELECT id, 'fixed', (2097152 + bat + 5242880 + v)::BIGINT, (2097152 + bat + 5242880 + v)::BIGINT FROM e""")
def measure_vhdx(spark, sf_dir):
    c = lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "cast(c_custkey AS decimal(38,0)) * c_custkey * 33554432 + c_custkey % 600 AS v", "c_custkey % 9 AS u", "c_custkey * 1000000 AS a")
    # The thresholds are whole sectors: rounding first would choose the same block size.
    c = c.withColumn("block", sizes.vhdx_block_size(F.col("v")))
    made = {k: sizes.measure_vhdx(F.col("v"), F.col("u"), F.col("a"), F.col("block"), fixed=k == "fixed") for k in ("dynamic", "fixed")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), m["required"].cast("long").alias("required"), m["full"].cast("long").alias("fully_allocated")) for k, m in made.items())))
    return c.select("id", each.alias("m")).select("id", "m.*")


UNITS_SQL = "SELECT image_id, count(DISTINCT u) AS n FROM (SELECT image_id, unnest(range(start // {0}, (start + length - 1) // {0} + 1)) AS u FROM extents WHERE state = 'data') GROUP BY 1"


@query(f"""WITH RECURSIVE {EXTENTS_SQL}, base AS (SELECT image_id, max(start + length) AS v FROM extents GROUP BY 1), u1 AS ({UNITS_SQL.format(65536)}), u2 AS ({UNITS_SQL.format(2097152)}), u3 AS ({UNITS_SQL.format(8388608)}),
g AS (SELECT image_id AS id, v, (v + 536870911) // 536870912 AS l1, (v + 65535) // 65536 AS n FROM base), h AS (SELECT *, (l1 * 8 + 65535) // 65536 AS l1c FROM g), {fixed_point_sql('SELECT id, (1 + l1c + l1 + n)::BIGINT AS used, 65536::BIGINT AS cluster, 16::BIGINT AS bits FROM h')},
m AS (SELECT id, v, n, 65536 * (1 + l1c + l1 + table_clusters + block_clusters) AS meta, greatest(((n + 511) // 512 * 4 + 511) // 512 * 512, 512) + (n + 511) // 512 * 2048 + 10752 AS sparse, (v + 2097151) // 2097152 AS nb, (v + 8388607) // 8388608 AS nx FROM h JOIN settled USING (id))
SELECT id AS image_id, 'qcow2' AS target, (meta + 65536 * u1.n)::BIGINT AS required, (meta + 65536 * m.n)::BIGINT AS fully_allocated FROM m JOIN u1 ON id = image_id UNION ALL SELECT id, 'raw', v, v FROM m
UNION ALL SELECT id, 'vmdk_sparse', sparse + 65536 * u1.n, sparse + 65536 * m.n FROM m JOIN u1 ON id = image_id
UNION ALL SELECT id, 'vhd_dynamic', 2048 + (nb * 4 + 511) // 512 * 512 + u2.n * 2097664, 2048 + (nb * 4 + 511) // 512 * 512 + nb * 2097664 FROM m JOIN u2 ON id = image_id
UNION ALL SELECT id, 'vhdx_dynamic', (3145728 + greatest(((nx + (nx - 1) // 512) * 8 + 1048575) // 1048576 * 1048576, 1048576) + u3.n * 8388608)::BIGINT, (3145728 + greatest(((nx + (nx - 1) // 512) * 8 + 1048575) // 1048576 * 1048576, 1048576) + nx * 8388608)::BIGINT FROM m JOIN u3 ON id = image_id WHERE v <= 1073741824
UNION ALL SELECT id, 'vhdx_dynamic', (3145728 + greatest(((x + (x - 1) // 256) * 8 + 1048575) // 1048576 * 1048576, 1048576) + u4.n * 16777216)::BIGINT, (3145728 + greatest(((x + (x - 1) // 256) * 8 + 1048575) // 1048576 * 1048576, 1048576) + x * 16777216)::BIGINT FROM (SELECT id, v, (v + 16777215) // 16777216 AS x FROM m) JOIN ({UNITS_SQL.format(16777216)}) u4 ON id = image_id WHERE v > 1073741824 AND v <= 107374182400""")
def measure_image(spark, sf_dir):
    return sizes.measure_extents(all_extents(spark, sf_dir))


@query(f"""WITH RECURSIVE i AS (SELECT c_custkey AS id, c_custkey * c_custkey * 7000001 AS v, c_custkey % 2 = 1 AS pre FROM customer), a AS (SELECT *, (v + 536870911) // 536870912 AS l1 FROM i), b AS (SELECT *, greatest((l1 * 8 + 65535) // 65536, 1) AS l1c, CASE WHEN pre THEN l1 ELSE 0 END AS l2, CASE WHEN pre THEN (v + 65535) // 65536 ELSE 0 END AS d FROM a),
{fixed_point_sql('SELECT id, (1 + l1c + l2 + d)::BIGINT AS used, 65536::BIGINT AS cluster, 16::BIGINT AS bits FROM b')}
SELECT id AS image_id, CASE WHEN v = 0 THEN 'invalid_size' END AS refusal, CASE WHEN v > 0 THEN 65536 END::BIGINT AS l1_offset, CASE WHEN v > 0 THEN (1 + l1c) * 65536 END::BIGINT AS refcount_table, CASE WHEN v > 0 THEN (1 + l1c + table_clusters) * 65536 END::BIGINT AS refcount_blocks,
 CASE WHEN v > 0 THEN (1 + l1c + table_clusters + block_clusters) * 65536 END::BIGINT AS l2_offset, CASE WHEN v > 0 THEN (1 + l1c + table_clusters + block_clusters + l2) * 65536 END::BIGINT AS data_offset, CASE WHEN v > 0 THEN (1 + l1c + table_clusters + block_clusters + l2 + d) * 65536 END::BIGINT AS file_size FROM b JOIN settled USING (id)""")
def qcow2_layouts(spark, sf_dir):
    return sizes.qcow2_layout(lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS image_id", "c_custkey * c_custkey * 7000001 AS v", "c_custkey % 2 = 1 AS preallocated"))


@query("""WITH i AS (SELECT c_custkey AS image_id, ['raw', 'vhd', 'vhdx', 'vmdk', 'other'][1 + c_custkey % 5] AS f, 1 + c_custkey * 1000000 AS v FROM customer), t AS (SELECT *, ((v + 2097151) // 2097152 * 4 + 511) // 512 * 512 AS bat, greatest((((v + 65535) // 65536 + 511) // 512 * 4 + 511) // 512 * 512, 512) AS gd, 1048576 AS vb FROM i)
SELECT image_id, step::INT AS step, part, "offset"::BIGINT AS "offset", length::BIGINT AS length FROM (
 SELECT image_id, 0 AS step, 'data' AS part, 0 AS "offset", v AS length FROM t WHERE f = 'raw'
 UNION ALL SELECT image_id, s, p, o, l FROM t, (VALUES (0, 'footer_copy', 0, 512), (1, 'dynamic_header', 512, 1024)) x(s, p, o, l) WHERE f = 'vhd' UNION ALL SELECT image_id, 2, 'block_table', 1536, bat FROM t WHERE f = 'vhd' UNION ALL SELECT image_id, 3, 'footer', 1536 + bat, 512 FROM t WHERE f = 'vhd'
 UNION ALL SELECT image_id, s, p, o, l FROM t, (VALUES (0, 'identifier', 0, 65536), (1, 'header_1', 65536, 4096), (2, 'header_2', 131072, 4096), (3, 'region_table_1', 196608, 65536), (4, 'region_table_2', 262144, 65536), (5, 'log', 1048576, 1048576), (6, 'block_table', 2097152, 1048576), (7, 'metadata', 3145728, 1048576)) x(s, p, o, l) WHERE f = 'vhdx'
 UNION ALL SELECT image_id, s, p, o, l FROM t, (VALUES (0, 'header', 0, 512), (1, 'descriptor', 512, 10240)) x(s, p, o, l) WHERE f = 'vmdk' UNION ALL SELECT image_id, 2, 'grain_directory', 10752, gd FROM t WHERE f = 'vmdk')""")
def create_plans(spark, sf_dir):
    i = lift.table(spark, sf_dir, "customer").selectExpr("c_custkey AS image_id", "element_at(array('raw', 'vhd', 'vhdx', 'vmdk', 'other'), cast(1 + c_custkey % 5 as int)) AS format", "1 + c_custkey * 1000000 AS v")
    return schedule.create_steps(i)


# Placement of writers, with their tables

PLACED_SQL = """WITH d AS (SELECT image_id, block_idx, block_idx // {per} AS t FROM (""" + lift.BLOCKS_SQL + """) WHERE state = 'data'), g AS (SELECT image_id, t, count(*) AS n FROM d GROUP BY 1, 2),
w AS (SELECT image_id, t, {first} + (row_number() OVER (PARTITION BY image_id ORDER BY t) - 1) * {tab} + coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {unit} AS pl FROM g)"""


@query(PLACED_SQL.format(per=1000, first=1, tab=1, unit=1) + " SELECT d.image_id, d.block_idx, d.t AS table_idx, (w.pl + row_number() OVER (PARTITION BY d.image_id, d.t ORDER BY d.block_idx))::BIGINT AS host_cluster FROM d JOIN w ON d.image_id = w.image_id AND d.t = w.t")
def convert_qcow2_clusters(spark, sf_dir):
    placed, _ = schedule.place_tables(lift.blocks(spark, sf_dir).filter("state = 'data'"), 1000, 1, 1, 1)
    return placed.withColumnRenamed("at", "host_cluster")


@query(PLACED_SQL.format(per=1000, first=1, tab=1, unit=1) + " SELECT image_id, t AS table_idx, pl::BIGINT AS host_cluster, (-9223372036854775807 - 1 + (pl * 65536)::BIGINT)::BIGINT AS l1_entry FROM w")
def convert_qcow2_tables(spark, sf_dir):
    _, tables = schedule.place_tables(lift.blocks(spark, sf_dir).filter("state = 'data'"), 1000, 1, 1, 1)
    return tables.select("image_id", "table_idx", F.col("at").alias("host_cluster"), F.expr("shiftleft(1L, 63) | (at * 65536)").alias("l1_entry"))


@query(PLACED_SQL.format(per=512, first=10752, tab=2048, unit=65536) + " SELECT d.image_id, d.block_idx, ((w.pl + 2048 + (row_number() OVER (PARTITION BY d.image_id, d.t ORDER BY d.block_idx) - 1) * 65536) // 512)::BIGINT AS grain_entry, (w.pl // 512)::BIGINT AS directory_entry FROM d JOIN w ON d.image_id = w.image_id AND d.t = w.t")
def convert_vmdk_grains(spark, sf_dir):
    placed, tables = schedule.place_tables(lift.blocks(spark, sf_dir).filter("state = 'data'"), 512, sizes.VMDK_DATA_START, 65536, 2048)
    return placed.join(tables.withColumnRenamed("at", "table_at"), ["image_id", "table_idx"]).select("image_id", "block_idx", F.expr("at div 512").alias("grain_entry"), F.expr("table_at div 512").alias("directory_entry"))


@query(f"SELECT image_id, block_idx, ((3584 + (row_number() OVER (PARTITION BY image_id ORDER BY block_idx) - 1) * 2097664) // 512)::BIGINT AS entry FROM ({lift.BLOCKS_SQL}) WHERE state = 'data'")
def convert_vhd_blocks(spark, sf_dir):
    return schedule.vhd_entries(lift.blocks(spark, sf_dir).filter("state = 'data'"), 3584, 2 << 20, chunk=1000)


@query(f"SELECT image_id, block_idx + block_idx // 512 AS slot, (4194304 + (row_number() OVER (PARTITION BY image_id ORDER BY block_idx) - 1) * 8388608 + 6)::BIGINT AS entry FROM ({lift.BLOCKS_SQL}) WHERE state = 'data'")
def convert_vhdx_blocks(spark, sf_dir):
    return schedule.vhdx_entries(lift.blocks(spark, sf_dir).filter("state = 'data'"), 4 << 20, 8 << 20, chunk=1000)


# Layers

SECTORS = "p_partkey AS block_idx, CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'absent' ELSE 'partial' END AS present, p_size AS bits"


@query(f"""WITH s AS (SELECT {SECTORS}, i AS sector, p_partkey * 100 + i AS child, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE -p_partkey END AS parent FROM part, (SELECT unnest(range(0, 8)) AS i)),
o AS (SELECT 'msb' AS ord, *, (bits // (1 << (7 - sector))) % 2 = 1 AS bit FROM s UNION ALL SELECT 'lsb', *, (bits // (1 << sector)) % 2 = 1 FROM s), w AS (SELECT *, CASE present WHEN 'full' THEN true WHEN 'absent' THEN false ELSE bit END AS own FROM o)
SELECT ord, block_idx, sector, own AS child_owned, CASE WHEN own THEN child ELSE coalesce(parent, 0) END AS value FROM w""")
def compose_differencing(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").selectExpr(*SECTORS.split(", ")).withColumn("bits", F.col("bits").cast("long")).withColumn("sector", F.explode(F.expr("sequence(0L, 7L)")))
    p = p.withColumns({"child": F.expr("block_idx * 100 + sector"), "parent": F.expr("if(block_idx % 3 = 0, null, -block_idx)")})
    return layers.compose_differencing(p, "msb").select(F.lit("msb").alias("ord"), "*").unionByName(layers.compose_differencing(p, "lsb").select(F.lit("lsb").alias("ord"), "*"))


@query("SELECT k, CASE WHEN k = 1 THEN 'ok' ELSE 'compressed' END AS outcome FROM (VALUES (1::BIGINT), (2)) v(k)")
def commit_refusals(spark, sf_dir):
    blocks = lift.blocks(spark, sf_dir)
    packed = blocks.withColumn("state", F.when(F.expr("block_idx % 50 = 7"), "compressed").otherwise(F.col("state")))
    return layers.commit_refusal(blocks).select(F.lit(1).cast("long").alias("k"), "outcome").unionByName(layers.commit_refusal(packed).select(F.lit(2).cast("long").alias("k"), "outcome"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE p_partkey + 1 END ELSE CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 3 END END AS parent, CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE 'raw' END ELSE 'qcow2' END AS parent_format, p_partkey % 6 = 0 AS rewritten FROM part")
def unsafe_rebase(spark, sf_dir):
    images = lift.parents(spark, sf_dir).withColumn("parent_format", F.lit("qcow2"))
    changes = lift.parents(spark, sf_dir).filter("id % 6 = 0").selectExpr("id", "if(id % 12 = 0, null, id + 1) AS new_parent", "if(id % 12 = 0, null, 'raw') AS new_format")
    return layers.repointed(images, changes)


# Snapshots and counts

@query("""WITH t AS (SELECT s_suppkey AS ordinal, s_suppkey::VARCHAR AS id, s_nationkey::VARCHAR AS name FROM supplier WHERE s_suppkey < 5), f AS (SELECT * FROM t UNION ALL SELECT ordinal + 100, id, name FROM t UNION ALL SELECT ordinal + 200, id, name FROM t UNION ALL SELECT ordinal + 300, id, name FROM t)
SELECT 'room' AS kind, ordinal, id, name, false AS refused FROM t UNION ALL SELECT 'room', max(ordinal) + 1, (max(id::BIGINT) + 1)::VARCHAR, 'new', false FROM t UNION ALL SELECT 'full', ordinal, id, name, true FROM f""")
def snapshot_append(spark, sf_dir):
    t = lift.table(spark, sf_dir, "supplier").filter("s_suppkey < 5").selectExpr("s_suppkey AS ordinal", "cast(s_suppkey as string) AS id", "cast(s_nationkey as string) AS name")
    full = t
    for more in (100, 200, 300):
        full = full.unionByName(t.withColumn("ordinal", F.col("ordinal") + more))
    return snapshots.appended(t, "new").select(F.lit("room").alias("kind"), "*").unionByName(snapshots.appended(full, "new").select(F.lit("full").alias("kind"), "*"))


@query("""SELECT p_partkey AS id, upper(printf('%02x', p_size - (p_size // (1 << (2 * (p_partkey % 4)))) % 4 * (1 << (2 * (p_partkey % 4))) + p_partkey % 4 * (1 << (2 * (p_partkey % 4))))) AS two_bits,
 CASE WHEN p_partkey % 70000 < 65536 THEN upper(printf('%02x', p_size)) || upper(printf('%02x', p_size)) || upper(printf('%04x', p_partkey)) || 'FFFF' END AS sixteen_bits FROM part""")
def set_refcounts(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").selectExpr("p_partkey", "unhex(lpad(hex(p_size), 2, '0')) AS small", "unhex(concat(lpad(hex(p_size), 2, '0'), lpad(hex(p_size), 2, '0'), '0000FFFF')) AS big")
    two = snapshots.with_refcount(F.col("small"), F.expr("p_partkey % 4"), 2, F.expr("p_partkey % 4"))
    wide = snapshots.with_refcount(F.col("big"), F.lit(1), 16, F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("id"), F.hex(two).alias("two_bits"), F.hex(wide).alias("sixteen_bits"))


@query(f"""WITH f AS (SELECT cluster_idx, cluster_idx - row_number() OVER (ORDER BY cluster_idx) AS g FROM ({lift.REFCOUNTS_SQL}) WHERE stored IN (0, 1)), r AS (SELECT greatest(min(cluster_idx), 50) AS a, max(cluster_idx) AS z FROM f GROUP BY g HAVING max(cluster_idx) >= 50),
s AS (SELECT unnest(range(a, z - 2 + 1, 3)) AS pl FROM r WHERE z - a + 1 >= 3), n AS (SELECT pl, row_number() OVER (ORDER BY pl) AS k FROM s), q AS (SELECT s_suppkey AS request, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT request, pl AS "at" FROM q LEFT JOIN n USING (k)""")
def claim_runs(spark, sf_dir):
    free = lift.refcounts(spark, sf_dir).withColumn("stored", F.expr("if(stored = 1, 0L, stored)"))
    return snapshots.claim_runs(free, lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request")), 3, cursor=50, chunk=100)


def snapshot_bytes(spark, sf_dir) -> DataFrame:
    """Tables of two entries; every seventh one is cut short, and every fifth one has extra data."""
    extra = "if(s_suppkey % 5 = 0, 16, 0)"

    def entry(n: int, text: str, name: str) -> Column:
        fixed = F.concat(be(f"s_suppkey * 65536 + {n}", 8), be("3", 4), be(f"length({text})", 2), be(f"length({name})", 2), be("1000 + s_suppkey", 4), be("7", 4), be("s_suppkey * 1000000", 8), be("0", 4), be(extra, 4))
        body = F.concat(fixed, F.expr(f"repeat('AB', {extra})"), F.hex(F.encode(F.expr(text), "UTF-8")), F.hex(F.encode(F.expr(name), "UTF-8")))
        return F.rpad(body, (F.ceil(F.length(body) / 16) * 16).cast("int"), "0")

    whole = F.concat(entry(0, "cast(s_suppkey as string)", "s_name"), entry(1, "'x'", "'second'"))
    cut = F.when(F.expr("s_suppkey % 7 = 0"), F.substring(whole, 1, 100)).otherwise(whole)
    return lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.unhex(cut).alias("raw"), F.lit(2).alias("n"))


@query("""SELECT s_suppkey AS image_id, k::INT AS ordinal, CASE k WHEN 0 THEN s_suppkey::VARCHAR ELSE 'x' END AS id, CASE k WHEN 0 THEN s_name ELSE 'second' END AS name, s_suppkey * 65536 + k AS l1_offset, 3::BIGINT AS l1_size, (1000 + s_suppkey)::BIGINT AS seconds, s_suppkey * 1000000 AS vm_clock FROM supplier, (VALUES (0), (1)) v(k) WHERE s_suppkey % 7 <> 0""")
def snapshot_entries(spark, sf_dir):
    return containers.snapshot_entries(snapshot_bytes(spark, sf_dir)).filter("whole").drop("whole")


@query("SELECT s_suppkey AS image_id, s_suppkey % 7 <> 0 AS whole FROM supplier")
def snapshot_tables_whole(spark, sf_dir):
    return containers.snapshot_tables(snapshot_bytes(spark, sf_dir))


@query("SELECT s_suppkey::VARCHAR AS name, CASE WHEN s_suppkey % 4 = 0 THEN 131072 ELSE 65536 END::BIGINT AS granularity, CASE WHEN s_suppkey % 4 = 0 THEN false ELSE s_suppkey % 2 = 0 END AS enabled, s_suppkey % 4 = 0 AS replaced FROM supplier")
def directory_replaced(spark, sf_dir):
    s = lift.table(spark, sf_dir, "supplier")
    old = s.selectExpr("cast(s_suppkey as string) AS name", "65536L AS granularity", "s_suppkey % 2 = 0 AS enabled")
    new = s.filter("s_suppkey % 4 = 0").selectExpr("cast(s_suppkey as string) AS name", "131072L AS granularity", "false AS enabled")
    other = s.limit(1).selectExpr("'missing' AS name", "1L AS granularity", "true AS enabled")
    return bitmaps.replaced(old, new.unionByName(other))


# Headers

def header(size: int, *fields: tuple[int, Column, int]) -> Column:
    """A header's bytes as hex: each field (offset, hex, bytes), zeros between."""
    parts, at = [], 0
    for offset, digits, width in fields:
        parts += [F.lit("00" * (offset - at)), digits]
        at = offset + width
    return F.concat(*parts, F.lit("00" * (size - at)))


def magic(raw: bytes) -> Column:
    return F.lit(raw.hex().upper())


@query("""SELECT s_suppkey::VARCHAR AS path, ['qcow2', 'vhd', 'vdi', 'vmdk', 'qed', 'parallels', 'qcow', 'luks'][1 + s_suppkey % 8] AS format, CASE s_suppkey % 8 WHEN 0 THEN 3 WHEN 3 THEN 1 WHEN 6 THEN 1 END::BIGINT AS version, CASE WHEN s_suppkey % 8 < 7 THEN s_suppkey * 1048576 END::BIGINT AS virtual_size,
 CASE s_suppkey % 8 WHEN 0 THEN 65536 WHEN 2 THEN 1048576 WHEN 4 THEN 65536 END::BIGINT AS cluster_size, s_suppkey % 8 IN (0, 4, 6) AND s_suppkey % 3 <> 0 AS has_backing, s_suppkey % 8 = 7 OR s_suppkey % 8 = 0 AND s_suppkey % 5 = 0 AS encrypted FROM supplier""")
def image_info(spark, sf_dir):
    m, v, named = formats.MAGIC, "s_suppkey * 1048576", "if(s_suppkey % 3 = 0, 0, 512)"
    made = [
        header(104, (0, magic(m["qfi"]), 4), (4, be("3", 4), 4), (8, be(named, 8), 8), (20, be("16", 4), 4), (24, be(v, 8), 8), (32, be("if(s_suppkey % 5 = 0, 2, 0)", 4), 4)),
        header(512, (0, magic(m["vhd"]), 8), (48, be(v, 8), 8)),
        header(512, (64, magic(m["vdi"]), 4), (368, le(v, 8), 8), (376, le("1048576", 4), 4)),
        header(512, (0, magic(m["vmdk"]), 4), (4, le("1", 4), 4), (12, le(f"{v} div 512", 8), 8)),
        header(512, (0, magic(m["qed"]), 4), (4, le("65536", 4), 4), (48, le(v, 8), 8), (56, le(named, 4), 4), (60, le(named, 4), 4)),
        header(512, (0, magic(formats.PARALLELS[1]), 16), (16, le("2", 4), 4), (36, le(f"{v} div 512", 8), 8)),
        header(512, (0, magic(m["qfi"]), 4), (4, be("1", 4), 4), (8, be(named, 8), 8), (24, be(v, 8), 8)),
        header(592, (0, magic(m["luks"]), 6)),
    ]
    chosen = F.element_at(F.array(*made), F.expr("cast(1 + s_suppkey % 8 as int)"))
    return formats.info(lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.unhex(chosen).alias("header"))).withColumn("virtual_size", F.col("virtual_size").cast("long"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'vhd' ELSE 'raw' END AS tail, s_suppkey % 2 = 0 AS iso FROM supplier")
def tails_and_marks(spark, sf_dir):
    # The sum of the bytes before the checksum decides it: the cookie's and the size's.
    cookie = sum(formats.MAGIC["vhd"])
    total = F.expr(f"{cookie} + s_suppkey % 256 + s_suppkey div 256 % 256")
    right = F.lpad(F.hex(F.lit(0xFFFFFFFF) - total - F.expr("if(s_suppkey % 3 = 1, 1, 0)")), 8, "0")
    foot = header(512, (0, F.when(F.expr("s_suppkey % 3 = 2"), F.lit("00" * 8)).otherwise(magic(formats.MAGIC["vhd"])), 8), (54, be("s_suppkey % 65536", 2), 2), (64, right, 4))
    iso = F.concat(F.lit("01"), F.when(F.expr("s_suppkey % 2 = 0"), magic(formats.MAGIC["iso"])).otherwise(F.lit("00" * 5)))
    return lift.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), formats.detect_tail(F.unhex(foot)).alias("tail"), formats.is_iso(F.unhex(iso)).alias("iso"))


# Texts and numbers

@query("""SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN n_name || '\\n' WHEN 1 THEN '\\u{1b}[31m' || n_name WHEN 2 THEN n_name || '"' || chr(92) WHEN 3 THEN '' END AS terminal,
 CASE n_nationkey % 4 WHEN 0 THEN n_name || '\\n' WHEN 1 THEN '\\u001b[31m' || n_name WHEN 2 THEN n_name || chr(92) || '"' || chr(92) || chr(92) WHEN 3 THEN '' END AS json FROM nation""")
def escaped_texts(spark, sf_dir):
    text = F.when(F.expr("n_nationkey % 4 = 0"), F.concat("n_name", F.lit("\n"))).when(F.expr("n_nationkey % 4 = 1"), F.concat(F.lit("\x1b[31m"), "n_name")).when(F.expr("n_nationkey % 4 = 2"), F.concat("n_name", F.lit('"\\'))).otherwise("")
    return lift.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), S.escape_terminal(text).alias("terminal"), S.escape_json(text).alias("json"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE '../' || n_name || '/base.vhdx' END AS path, n_name AS decoded, (2 * length(n_name))::BIGINT AS utf16_bytes, n_name AS back FROM nation")
def stored_texts(spark, sf_dir):
    n = lift.table(spark, sf_dir, "nation")
    stored = F.when(F.expr("n_nationkey % 5 = 0"), ".\\").when(F.expr("n_nationkey % 5 = 1"), F.concat(F.lit(".\\..\\"), "n_name", F.lit("\\base.vhdx"))).otherwise(F.concat(F.lit("..\\"), "n_name", F.lit("\\base.vhdx")))
    plain = F.rtrim(F.base64(F.encode("n_name", "UTF-8")), F.lit("="))
    wide = S.utf16_bytes(F.col("n_name"), big=True)
    return n.select(F.col("n_nationkey").alias("id"), S.relative_path(stored).alias("path"), F.decode(S.base64_bytes(plain), "UTF-8").alias("decoded"), F.octet_length(wide).cast("long").alias("utf16_bytes"), S.utf16_text(wide, big=True).alias("back"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey <= 3037000499 // 1000000 THEN c_custkey * c_custkey * 1000000000000 END AS product, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS total FROM customer")
def checked_numbers(spark, sf_dir):
    c = lift.table(spark, sf_dir, "customer")
    big = F.expr("if(c_custkey % 2 = 0, 0L, 9223372036854775807L)")
    return c.select(F.col("c_custkey").alias("id"), S.checked_product(F.expr("c_custkey * c_custkey"), F.lit(1_000_000_000_000).cast("long")).alias("product"), S.checked_sum(F.col("c_custkey"), big).alias("total"))


# Repairs and plans over references

@query(f"SELECT cluster_idx, count(*) AS counted, count(*) > 7 AS overflow FROM ({lift.REFS_SQL}) GROUP BY 1")
def computed_counts(spark, sf_dir):
    return integrity.computed_counts(lift.refs(spark, sf_dir), bits=3)


@query(f"WITH {BOTH_SQL} SELECT cluster_idx, want AS stored, CASE WHEN want = 0 THEN 0 ELSE stored END AS safe FROM b WHERE stored IS NOT NULL")
def repaired_counts(spark, sf_dir):
    refs, counts = lift.refs(spark, sf_dir), lift.refcounts(spark, sf_dir)
    return integrity.repaired_counts(refs, counts).join(integrity.repaired_counts(refs, counts, safe=True).withColumnRenamed("stored", "safe"), "cluster_idx")


HEADER_ROWS = "c_nationkey AS chain_id, c_custkey AS depth, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1363560955 END AS magic, CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 17 = 0 THEN 90000000 ELSE 65536 END AS l1_offset, CASE WHEN c_custkey % 19 = 0 THEN 2000000000000000000 ELSE c_custkey END AS l1_size, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 131072 END AS table_offset, CASE WHEN c_custkey % 23 = 0 THEN 9000000000000000 ELSE c_custkey % 1300 END AS table_clusters, 65536 AS cluster, 80000000 AS size, c_custkey % 5 = 0 AS corrupt"


@query(f"""SELECT chain_id::BIGINT AS chain_id, depth, CASE WHEN magic <> 1363560955 THEN 'magic' WHEN l1_offset = 0 OR l1_offset >= size THEN 'l1_offset' WHEN l1_size::HUGEINT * 8 > size THEN 'l1_size' WHEN table_offset = 0 OR table_offset >= size THEN 'table_offset' WHEN table_offset + table_clusters::HUGEINT * cluster > size THEN 'table_end' WHEN corrupt THEN 'corrupt' ELSE 'ok' END AS fault
FROM (SELECT {HEADER_ROWS} FROM customer)""")
def header_faults(spark, sf_dir):
    rows = lift.table(spark, sf_dir, "customer").selectExpr(*HEADER_ROWS.replace("c_nationkey AS", "cast(c_nationkey as bigint) AS").replace("131072 END", "131072L END").replace("65536 AS cluster", "65536L AS cluster").replace("80000000 AS size", "80000000L AS size").split(", "))
    return integrity.header_faults(rows)


TREE = "o_orderkey % 4000"


@query(f"""WITH l1 AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 + s_suppkey // 2 END AS c FROM supplier), l2 AS (SELECT o_orderkey % 40 AS t, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE {TREE} END AS c FROM orders),
d AS (SELECT c FROM l1 WHERE c <> 0 UNION ALL SELECT l2.c FROM l1 JOIN l2 ON l1.c = l2.t WHERE l1.c <> 0 AND l2.c <> 0) SELECT c::BIGINT AS cluster_idx, count(*) AS delta FROM d GROUP BY 1""")
def snapshot_reach(spark, sf_dir):
    l1 = lift.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l1_idx", "if(s_suppkey % 5 = 0, 0L, 1 + s_suppkey div 2) AS cluster_idx")
    l2 = lift.table(spark, sf_dir, "orders").selectExpr("o_orderkey % 40 AS table_idx", f"if(o_orderkey % 3 = 0, 0L, {TREE}) AS cluster_idx")
    return snapshots.reachable_from(l1, l2, 1).groupBy("cluster_idx").agg(F.sum("delta").alias("delta"))


@query(f"""WITH p AS (SELECT 'refused' AS plan, * FROM ({delta_sql(f"SELECT cluster_idx, -1 AS delta FROM ({lift.REFS_SQL})")}) UNION ALL SELECT 'allowed', * FROM ({delta_sql(f"SELECT cluster_idx, 1 AS delta FROM ({lift.REFS_SQL}) WHERE src % 5 = 0")})), a AS (SELECT plan, count(error) = 0 AS allowed FROM p GROUP BY 1)
SELECT plan, cluster_idx, before, CASE WHEN allowed THEN after ELSE before END AS after, allowed FROM p JOIN a USING (plan)""")
def snapshot_plans(spark, sf_dir):
    refs, counts = lift.refs(spark, sf_dir), lift.refcounts(spark, sf_dir)
    down = snapshots.applied(counts, refs.selectExpr("cluster_idx", "-1L AS delta"), bits=4).select(F.lit("refused").alias("plan"), "*")
    up = snapshots.applied(counts, refs.filter("src % 5 = 0").selectExpr("cluster_idx", "1L AS delta"), bits=4).select(F.lit("allowed").alias("plan"), "*")
    return down.unionByName(up)


@query("""WITH w AS (SELECT o_orderkey AS block_idx, o_orderstatus = 'P' AS fresh FROM orders), s AS (SELECT 0 AS class, 'data' AS kind, block_idx FROM w UNION ALL SELECT c, k, block_idx FROM w, (VALUES (1, 'l2'), (2, 'l1'), (3, 'refcount')) v(c, k) WHERE fresh)
SELECT row_number() OVER (ORDER BY class, block_idx) - 1 AS seq, class::BIGINT AS class, kind, block_idx, row_number() OVER (PARTITION BY class ORDER BY block_idx) = 1 AND class > 0 AS barrier FROM s""")
def write_order(spark, sf_dir):
    return schedule.write_order(lift.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS block_idx", "o_orderstatus = 'P' AS fresh"), chunk=1000)


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 9 AS n, p_size % 6 AS depth, CASE WHEN p_partkey % 10 = 1 THEN 0 WHEN p_partkey % 10 = 2 THEN 3000000000 WHEN p_partkey % 10 = 3 THEN 40000000 ELSE 4096 END AS b, CASE WHEN p_partkey % 14 = 5 THEN 3000000000 ELSE 0 END AS st, p_size % 4 AS fl, p_partkey % 2 = 0 AS w FROM part)
SELECT id, CASE WHEN n < 1 THEN 'count' WHEN depth < 1 THEN 'depth' WHEN b < 1 OR b > 2147483647 THEN 'buffer' WHEN b > 2097152 THEN 'buffer_cap' WHEN st > 2147483647 THEN 'step' WHEN fl <> 0 AND NOT w THEN 'flush_requires_write' WHEN fl <> 0 AND fl < depth THEN 'flush_below_depth' ELSE 'ok' END AS refusal FROM p""")
def bench_refusals(spark, sf_dir):
    p = lift.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey % 9 AS n", "p_size % 6 AS depth", "case p_partkey % 10 when 1 then 0L when 2 then 3000000000L when 3 then 40000000L else 4096L end AS b", "if(p_partkey % 14 = 5, 3000000000L, 0L) AS st", "p_size % 4 AS fl", "p_partkey % 2 = 0 AS w")
    return p.select("id", schedule.bench_refusal(*(F.col(c) for c in ("n", "depth", "b", "st", "fl", "w"))).alias("refusal"))


LINES = "SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS line_no, 100 + l_partkey % 7 AS sectors, CASE l_suppkey % 3 WHEN 0 THEN 'FLAT' WHEN 1 THEN 'SPARSE' ELSE 'ZERO' END AS kind, 'disk-' || l_suppkey || '.vmdk' AS file, l_linenumber AS ofs FROM lineitem"


@query(f"""WITH e AS ({LINES}), f AS (SELECT '/img/disk-' || s_suppkey || '.vmdk' AS path, (102 + s_suppkey % 8) * 512 AS length FROM supplier WHERE s_suppkey % 4 <> 1),
l AS (SELECT *, coalesce(sum(sectors) OVER (PARTITION BY image_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 512 AS start, CASE WHEN kind <> 'ZERO' THEN '/img/' || file END AS path FROM e)
SELECT image_id, line_no, l.path, start::BIGINT AS start, CASE WHEN kind = 'ZERO' THEN 'zeros' WHEN length IS NULL THEN 'missing' WHEN kind = 'FLAT' AND (ofs + sectors) * 512 > length THEN 'short' ELSE 'ok' END AS outcome FROM l LEFT JOIN f ON l.path = f.path""")
def descriptor_files(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    t = lift.table(spark, sf_dir, "lineitem").withColumn("line_no", F.row_number().over(order).cast("long"))
    e = t.selectExpr("l_orderkey AS image_id", "'/img' AS folder", "line_no", "100 + l_partkey % 7 AS sectors", "case l_suppkey % 3 when 0 then 'FLAT' when 1 then 'SPARSE' else 'ZERO' end AS kind", "concat('disk-', l_suppkey, '.vmdk') AS file", "cast(l_linenumber as bigint) AS offset")
    files = lift.table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 1").selectExpr("concat('/img/disk-', s_suppkey, '.vmdk') AS path", "(102 + s_suppkey % 8) * 512 AS length")
    return chains.extent_files(e, files)
