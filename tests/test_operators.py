"""Operators on small hand-made tables: the cases that a plausible rewrite gets wrong."""

import random

import pytest
from pyspark.sql import functions as F

from blocklens.functions import chs, geometry
from blocklens.functions import scalars as S
from blocklens.operators import bitmaps, chains, checks, extents, integrity, layers, paths, snapshots
from blocklens.plans import schedule, sizes
from blocklens.sources import containers, formats

EXT = "image_id long, start long, length long, state string, file_offset long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def merged(rows):
    out = []
    for image, start, length, state, at in sorted(r for r in rows if r[2]):
        p = out[-1] if out else None
        if p and p[0] == image and p[1] + p[2] == start and p[3] == state and (at is None or p[4] + p[2] == at):
            out[-1] = (image, p[1], p[2] + length, state, p[4])
        else:
            out.append((image, start, length, state, at))
    return out


@pytest.mark.parametrize("chunk", [3, 10, 1000])
def test_coalesce_does_not_depend_on_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows, at = [], 0
    for i in range(200):
        state = rng.choice(["hole", "zero", "data"])
        jump = rng.random() < 0.2
        at += 7 if jump else 0
        rows.append((i // 120, i % 120, 1, state, at if state == "data" else None))
        at += 1
    got = extents.coalesce_extents(spark.createDataFrame(rows, EXT), chunk=chunk)
    assert sorted(map(tuple, got.collect())) == merged(rows)


def test_coalesce_empty_and_zero_length(spark):
    assert extents.coalesce_extents(spark.createDataFrame([], EXT)).count() == 0
    assert extents.coalesce_extents(spark.createDataFrame([(0, 5, 0, "data", 1)], EXT)).count() == 0


def test_last_block_is_trimmed(spark):
    b = spark.createDataFrame([(0, 0, "data", 0), (0, 1, "zero", None), (0, 2, "hole", None)], "image_id long, block_idx long, state string, file_offset long")
    got = extents.extents_of_blocks(b, 100, F.lit(150).cast("long")).orderBy("start").collect()
    assert [(r.start, r.length) for r in got] == [(0, 100), (100, 50)]


def test_clip_moves_the_file_offset(spark):
    e = spark.createDataFrame([(0, 0, 100, "data", 1000), (0, 100, 50, "hole", None)], EXT)
    assert [tuple(r) for r in extents.clip(e, F.lit(30), F.lit(120)).orderBy("start").collect()] == [(0, 30, 70, "data", 1030), (0, 100, 20, "hole", None)]


@pytest.mark.parametrize("bs, count, skip, size, want", [(512, 4, 1, 10_000, (512, 1536)), (512, 0, 0, 10_000, (0, 0)), (512, None, 100, 10_000, (10_000, 0)), (1000, 99, 3, 10_000, (3000, 7000)), (512, 2, 5, 10_000, (1024, 0))])
def test_dd_counts_from_zero(spark, bs, count, skip, size, want):
    start, length = extents.dd_window(*(F.lit(x).cast("long") for x in (bs, count, skip, size)))
    assert tuple(spark.range(1).select(start, length).first()) == want


LAYERS = "chain_id long, depth int, block_idx long, state string, value long"


def test_compose_invariants(spark):
    rows = [(0, 0, 1, "hole", 9), (0, 1, 1, "data", 5), (0, 0, 2, "zero", 9), (0, 1, 2, "data", 6), (0, 0, 3, "hole", 1), (0, 0, 4, "data", 7), (0, 1, 4, "zero", 0)]
    got = {r.block_idx: (r.state, r.value) for r in layers.compose(spark.createDataFrame(rows, LAYERS)).collect()}
    # Zero hides what lies below, a hole does not, an unanswered block is not listed.
    assert got == {1: ("data", 5), 2: ("zero", 0), 4: ("data", 7)}


def test_compare_zero_tail_is_equal(spark):
    a = spark.createDataFrame([(0, 0, 0, "data", 1), (0, 0, 9, "zero", 0)], LAYERS)
    b = spark.createDataFrame([(0, 0, 0, "data", 1)], LAYERS)
    sized = spark.createDataFrame([(10, 5)], "size_a long, size_b long")
    r = layers.compare(layers.compose(a), layers.compose(b), sized).first()
    assert (r.identical, r.size_mismatch, r.compared, r.first_mismatch) == (True, True, 5, None)
    c = spark.createDataFrame([(0, 0, 0, "data", 1), (0, 0, 9, "data", 3)], LAYERS)
    assert not layers.compare(layers.compose(c), layers.compose(b), sized).first().identical


def test_commit_keeps_explicit_zero(spark):
    over = spark.createDataFrame([(0, 0, 1, "zero", 0), (0, 0, 2, "hole", 0)], LAYERS)
    back = spark.createDataFrame([(0, 1, 1, "data", 5), (0, 1, 2, "data", 6)], LAYERS)
    assert {r.block_idx: r.value for r in layers.commit(over, back).collect()} == {1: 0, 2: 6}


def test_bit_orders_differ(spark):
    assert one(spark, layers.sector_owner(F.lit(0b10000000), F.lit(0), "msb"))
    assert not one(spark, layers.sector_owner(F.lit(0b10000000), F.lit(0), "lsb"))


def test_fragmentation_across_chunks(spark):
    rows = [(0, i, i * 10 + (5 if i >= 6 else 0)) for i in range(12)]
    df = spark.createDataFrame(rows, "image_id long, logical long, host_offset long")
    for chunk in (1, 4, 6, 100):
        r = integrity.fragmentation(df, 10, chunk).first()
        assert (r.clusters, r.gaps, r.percent) == (12, 1, 9)


CLUSTER = 65536


def walk_by_hand(entries, counts, metadata, size):
    """The checks' rules, an entry at a time in the order of the walk."""
    seen, errors = set(metadata), dict.fromkeys(("bad", "overlaps", "refcount_errors", "allocated"), 0)
    claimed = set()
    for _, level, raw in sorted(entries):
        at = raw & 0x00FFFFFFFFFFFE00
        if raw == 0:
            continue
        if level == 2 and raw >> 62 & 1:
            begin = raw & (1 << 54) - 1
            end = begin + ((raw >> 54 & 255) + 1) * 512 - (begin & 511)
            errors["allocated"] += 1
            if end > size:
                errors["bad"] += 1
            else:
                claimed |= set(range(begin // CLUSTER, (end - 1) // CLUSTER + 1))
            continue
        if level == 2 and at == 0:
            continue
        if at == 0 or at >= size or at % CLUSTER:
            errors["bad"] += 1
            continue
        errors["allocated"] += 1
        errors["overlaps"] += at // CLUSTER in claimed
        claimed.add(at // CLUSTER)
        errors["refcount_errors"] += counts.get(at // CLUSTER) == 0
    errors["leaks"] = sum(n > 0 and c not in claimed | seen for c, n in counts.items())
    return errors


def test_check_follows_the_walk(spark):
    rng = random.Random(8)
    for _ in range(3):
        size = 40 * CLUSTER
        kinds = [lambda: 0, lambda: 511, lambda: 1, lambda: rng.randrange(40) * CLUSTER + 512, lambda: (rng.randrange(20) + 40) * CLUSTER, lambda: (1 << 62) + (rng.randrange(200) << 54) + rng.randrange(42 * CLUSTER)]
        entries = [(i, rng.choice([1, 2]), rng.choice(kinds)() if rng.random() < 0.4 else rng.randrange(40) * CLUSTER) for i in range(60)]
        counts, meta = {c: rng.randrange(3) for c in range(40)}, [0, 1, 2]
        e = spark.createDataFrame([(*x, size) for x in entries], "pos long, level int, raw long, size long")
        r = checks.check_qcow2(e, spark.createDataFrame(list(counts.items()), "cluster_idx long, stored long"), spark.createDataFrame([(m,) for m in meta], "cluster_idx long")).first()
        want = walk_by_hand(entries, counts, meta, size)
        assert {"bad": r.bad_entries, "overlaps": r.overlaps, "refcount_errors": r.refcount_errors, "allocated": r.clusters_allocated, "leaks": r.leaks} == want
        assert r.corruptions == r.bad_entries + r.overlaps and r.clusters_checked == 60


def test_check_tells_leaks_from_corruption(spark):
    entries = spark.createDataFrame([(0, 2, CLUSTER, 9 * CLUSTER)], "pos long, level int, raw long, size long")
    counts = spark.createDataFrame([(1, 1), (2, 1), (4, 0)], "cluster_idx long, stored long")
    r = checks.check_qcow2(entries, counts, counts.limit(0).select("cluster_idx")).first()
    assert (r.leaks, r.corruptions, r.refcount_errors, r.valid, r.has_leaks) == (1, 0, 0, True, True)
    refs = spark.createDataFrame([(0, 1), (1, 1), (2, 3), (3, 99)], "src long, cluster_idx long")
    counts = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (4, 0)], "cluster_idx long, stored long")
    got = {x.cluster_idx: x.action for x in integrity.corrections(refs, counts).collect()}
    assert got == {1: "kept", 2: "freed", 3: "raised", 4: "kept"}


@pytest.mark.parametrize("size, want", [(1 << 20, (327_680, 1_376_256)), (16 << 20, (327_680, 17_104_896))])
def test_measure_goldens(spark, size, want):
    r = sizes.measure_qcow2(spark.createDataFrame([(size, 0)], "v long, units long")).first()
    assert (r.required, r.full) == want


def test_allocation_counts_shared_units_once(spark):
    e = spark.createDataFrame([(0, 0, 10, "data", 0), (0, 10, 5, "hole", None), (0, 15, 80, "data", 90)], EXT)
    r = sizes.allocation(e, 20).first()
    assert (r.virtual_size, r.allocated_bytes, r.units) == (95, 90, 5)


@pytest.mark.parametrize("text, want", [("12abc", 12), ("abc", 0), ("", 0), ("007", 7), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", 0), ("9" * 30, 0)])
def test_decimal_prefix(spark, text, want):
    assert int(one(spark, snapshots.decimal_id(F.lit(text)))) == want


def test_id_beats_an_earlier_name(spark):
    t = spark.createDataFrame([(0, "1", "2"), (1, "2", "x"), (2, "3", "2")], "ordinal long, id string, name string")
    n = spark.createDataFrame([("2",), ("nope",)], "needle string")
    got = {r.needle: r.ordinal for r in snapshots.lookup(t, n).collect()}
    assert got == {"2": 1, "nope": None}
    assert {r.needle: r.ordinal for r in snapshots.lookup(t, n, name_only=True).collect()} == {"2": 0, "nope": None}


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_first_fit_over_chunks(spark, chunk):
    counts = spark.createDataFrame([(i, 0 if i in (1, 2, 5, 6, 7, 8, 11) else 1) for i in range(12)], "cluster_idx long, stored long")
    q = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 6, 3), (3, 0, 5), (4, 9, 1)], "request long, cursor long, n long")
    assert {r.request: r.at for r in snapshots.first_fit(counts, q, chunk).collect()} == {0: 1, 1: 5, 2: 6, 3: None, 4: 11}


def test_refcount_errors_are_told_apart(spark):
    counts = spark.createDataFrame([(1, 15), (2, 0), (3, 1)], "cluster_idx long, stored long")
    changes = spark.createDataFrame([(1, 1), (2, -1), (3, 1)], "cluster_idx long, delta long")
    got = {r.cluster_idx: r.error for r in snapshots.refcount_delta(counts, changes, bits=4).collect()}
    assert got == {1: "refcount_overflow", 2: "parse_failed", 3: None}


def test_chains_end_well_or_not(spark):
    edges = [(0, None), (1, 0), (2, 2), (3, 4), (4, 3), (5, 77)] + [(100 + i, 100 + i - 1 if i else None) for i in range(19)]
    got = {r.id: (r.outcome, r.depth) for r in chains.discover(spark.createDataFrame(edges, "id long, parent long")).collect()}
    assert got[0] == ("ok", 0) and got[1] == ("ok", 1) and got[2][0] == "cycle"
    assert got[3][0] == got[4][0] == "cycle" and got[5][0] == "missing"
    assert got[116] == ("ok", 16) and got[117][0] == "too_deep"


def test_gaps_are_not_zeros(spark):
    points = spark.createDataFrame([(0,), (4,), (5,), (30,)], "sector long")
    parts = spark.createDataFrame([(7, 0, 5), (8, 6, 20)], "chunk long, first long, count long")
    got = {r.sector: (r.chunk, r.gap) for r in chains.last_started(points, parts, 8).collect()}
    assert got == {0: (7, False), 4: (7, False), 5: (None, True), 30: (None, True)}


def test_empty_ranges_overlap_nothing(spark):
    a = spark.createDataFrame([(1, 5, 0), (2, 0, 100)], "a_id long, a_start long, a_length long")
    b = spark.createDataFrame([(1, 0, 10), (2, 99, 21), (3, 100, 1)], "b_id long, b_start long, b_length long")
    assert sorted((r.a_id, r.b_id) for r in chains.overlaps(a, b, 16).collect()) == [(2, 1), (2, 2)]


def test_overflowing_ranges_overlap_everything(spark):
    top = (1 << 63) - 1
    cases = [(0, 0, 0, top, False), (top, 5, 0, 1, True), (0, 1, top, 5, True), (top, 5, 0, 0, False), (3, 4, 7, 1, False), (3, 5, 7, 1, True)]
    df = spark.createDataFrame(cases, "o long, l long, p long, m long, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", chains.ranges_overlap(*(F.col(c) for c in "olpm"))).collect())
    a = spark.createDataFrame([(1, top - 1, 10), (2, 5, 5)], "a_id long, a_start long, a_length long")
    b = spark.createDataFrame([(7, 0, 100)], "b_id long, b_start long, b_length long")
    assert sorted((r.a_id, r.b_id or 0) for r in chains.overlaps(a, b, 16).collect()) == [(1, 0), (2, 7)]


def test_ranges_of_all_lengths(spark):
    rng = random.Random(13)
    made = lambda n: [(i, rng.randrange(5000), rng.choice([0, 1, 3, 40, 700, 4000])) for i in range(n)]
    left, right = made(60), made(60)
    want = sorted((a, b) for a, s, n in left for b, t, m in right if n and m and s < t + m and t < s + n)
    got = chains.overlaps(spark.createDataFrame(left, "a_id long, a_start long, a_length long"), spark.createDataFrame(right, "b_id long, b_start long, b_length long"), 4)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want
    parts = [(i, s, n) for i, s, n in right if n]
    points = [(x,) for x in range(0, 9000, 37)]
    found = {r.sector: r.chunk for r in chains.last_started(spark.createDataFrame(points, "sector long"), spark.createDataFrame(parts, "chunk long, first long, count long"), 4).collect()}
    assert found == {x: max(((s, i) for i, s, n in parts if s <= x < s + n), default=(0, None))[1] for (x,) in points}


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_last_mark_before(spark, chunk):
    rng = random.Random(chunk)
    marks = [(k, p, f"{k}:{p}") for k in (0, 1) for p in sorted(rng.sample(range(-300, 300), 12))]
    points = [(k, rng.randrange(-400, 400), i) for i, k in enumerate([0, 1] * 40)]
    got = chains.last_before(spark.createDataFrame(points, "k int, pos long, n int"), spark.createDataFrame(marks, "k int, pos long, mark string"), chunk, ["k"])
    want = {n: max(((p, m) for j, p, m in marks if j == k and p <= x), default=(0, None))[1] for k, x, n in points}
    assert {r.n: r.mark for r in got.collect()} == want


def test_claims_follow_each_other(spark):
    rng = random.Random(4)
    counts = [(i, int(rng.random() < 0.35)) for i in range(200)]
    held, at, want = dict(counts), 20, []
    while at + 2 <= 200 and len(want) < 30:
        if all(held[at + k] == 0 for k in range(2)):
            want.append(at)
            at += 2
        else:
            at += 1
    asked = spark.createDataFrame([(i,) for i in range(len(want) + 3)], "request long")
    got = {r.request: r.at for r in snapshots.claim_runs(spark.createDataFrame(counts, "cluster_idx long, stored long"), asked, 2, cursor=20, chunk=7).collect()}
    assert [got[i] for i in range(len(want))] == want
    assert len(want) == 30 or all(got[i] is None for i in range(len(want), len(want) + 3))


def test_counters_are_set_and_read_back(spark):
    for bits, size in ((1, 2), (4, 2), (8, 4), (16, 8), (64, 16)):
        raw, n = bytes(range(size)), size * 8 // bits
        for index, value in ((0, 1), (n - 1, (1 << min(bits, 40)) - 1), (n // 2, 0)):
            made = spark.range(1).select(snapshots.with_refcount(F.lit(bytearray(raw)), F.lit(index), bits, F.lit(value).cast("long")).alias("b"))
            row = made.select("b", *(snapshots.packed_refcount(F.col("b"), F.lit(i), bits).cast("long").alias(f"c{i}") for i in range(n))).first()
            old = spark.range(1).select(F.lit(bytearray(raw)).alias("b")).select(*(snapshots.packed_refcount(F.col("b"), F.lit(i), bits).cast("long").alias(f"c{i}") for i in range(n))).first()
            assert len(row["b"]) == size and [row[f"c{i}"] for i in range(n)] == [value if i == index else old[f"c{i}"] for i in range(n)]
    assert one(spark, snapshots.with_refcount(F.lit(bytearray(2)), F.lit(0), 4, F.lit(16).cast("long"))) is None


def test_texts_are_written_out(spark):
    assert one(spark, S.escape_terminal(F.lit("a\n\x07\u202eb\x7f"))) == "a\\n\\u{7}\\u{202e}b\\u{7f}"
    assert one(spark, S.escape_json(F.lit('"\\\t\b\x01é\u061c'))) == '\\"\\\\\\t\\b\\u0001é\\u061c'
    assert one(spark, S.relative_path(F.lit(".\\a\\b"))) == "a/b" and one(spark, S.relative_path(F.lit(".\\"))) is None
    for text, raw in (("TWFu", b"Man"), ("TWE=", b"Ma"), ("TQ", b"M"), ("TWFu!TWFu", b"Man"), ("TWFuT", b"Man"), ("", b"")):
        assert bytes(one(spark, S.base64_bytes(F.lit(text)))) == raw


def test_vhdx_measure_goldens(spark):
    mib = 1 << 20
    for v, units, block, fixed, want in ((0, 0, 8 * mib, False, (4 * mib, 4 * mib)), (1 << 30, 3, 8 * mib, False, (28 * mib, 1028 * mib)), (1000, 0, 8 * mib, True, (8 * mib + 1024, 8 * mib + 1024))):
        r = one(spark, sizes.measure_vhdx(F.lit(v).cast("long"), F.lit(units).cast("long"), F.lit(0).cast("long"), F.lit(block).cast("long"), fixed))
        assert tuple(r) == want


def test_broken_snapshot_tables(spark):
    entry = bytes(12) + (1).to_bytes(2, "big") + (3).to_bytes(2, "big") + bytes(20) + bytes(4) + b"7abc" + bytes(4)
    rows = [(0, bytearray(entry * 2), 2), (1, bytearray(entry + entry[:41]), 2), (2, bytearray(b""), 1), (3, bytearray(entry), 1)]
    got = {r.image_id: r.whole for r in containers.snapshot_tables(spark.createDataFrame(rows, "image_id long, raw binary, n int")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}
    first = containers.snapshot_entries(spark.createDataFrame(rows, "image_id long, raw binary, n int")).filter("image_id = 0").orderBy("ordinal").collect()
    assert [(r.ordinal, r.id, r.name) for r in first] == [(0, "7", "abc"), (1, "7", "abc")]


def test_tables_come_before_what_they_name(spark):
    blocks = [(0, b) for b in (0, 3, 9, 10, 11, 25, 40)]
    placed, tables = schedule.place_tables(spark.createDataFrame(blocks, "image_id long, block_idx long"), 10, 1, 1, 1)
    # As a writer would: a table is placed at its first block.
    at, want, names = 1, {}, {}
    for _, b in blocks:
        if b // 10 not in names:
            names[b // 10], at = at, at + 1
        want[b], at = at, at + 1
    assert {r.block_idx: r.at for r in placed.collect()} == want and {r.table_idx: r.at for r in tables.collect()} == names

def test_bitmap_actions_fold_in_order(spark):
    directory = spark.createDataFrame([("a", False)], "name string, enabled boolean")
    acts = spark.createDataFrame([("a", 1, "enable"), ("a", 2, "clear"), ("b", 1, "add"), ("b", 2, "add"), ("c", 1, "remove"), ("c", 2, "add")], "name string, seq long, action string")
    got = {r.name: (r.exists, r.enabled, r.clears, r.error) for r in bitmaps.apply_actions(directory, acts).collect()}
    assert got == {"a": (True, True, 1, None), "b": (True, True, 0, "exists"), "c": (False, False, 0, "missing")}


def test_add_refusals_in_order(spark):
    ok = [F.lit(16), F.lit("n"), F.lit(4096).cast("long"), F.lit(0), F.lit(False)]
    assert one(spark, bitmaps.add_refusal(*ok)) == "ok"
    assert one(spark, bitmaps.add_refusal(F.lit(8), F.lit(""), *ok[2:])) == "refcount_width"
    assert one(spark, bitmaps.add_refusal(ok[0], F.lit(""), F.lit(5).cast("long"), *ok[3:])) == "name_length"
    assert one(spark, bitmaps.add_refusal(ok[0], ok[1], F.lit(5000).cast("long"), *ok[3:])) == "granularity"
    assert one(spark, bitmaps.add_refusal(*ok[:4], F.lit(True))) == "duplicate"


def test_division_is_exact_beyond_doubles(spark):
    n = (1 << 62) + 12345
    assert one(spark, S.div(F.lit(n), 7)) == n // 7 and one(spark, S.ceil_div(F.lit(n), 7)) == -(-n // 7)


@pytest.mark.parametrize("text, want", [("1.5M", 1572864), ("1m", 1 << 20), ("1.5", None), ("1.5b", None), ("+7", 7), (" 2K ", 2048), ("0x10", None), ("1.1E", 1268213655067531680), ("", None)])
def test_size_grammar(spark, text, want):
    got = one(spark, S.parse_size(F.lit(text)))
    assert (None if got is None else int(got)) == want


def test_bench_schedule_matches_iteration(spark):
    at, want = 5000, []
    for _ in range(50):
        want.append(at)
        at = (at + 700) % (3000 - 512)
    assert [r.offset for r in schedule.schedule(spark, 50, 5000, 700, 512, 3000).orderBy("request").collect()] == want
    assert [r.request for r in schedule.schedule(spark, 10, 0, 0, 512, 4096, 4).filter("flush").collect()] == [1, 5, 9]


def test_formats(spark):
    def detect(raw):
        return one(spark, formats.detect_format(F.lit(bytearray(raw))))

    assert detect(b"QFI\xfb\0\0\0\1") == "qcow" and detect(b"QFI\xfb\0\0\0\7") == "qcow2" and detect(b"QFI") == "unknown"
    assert detect(b"conectix" + bytes(504)) == "vhd"
    assert detect(bytes(64) + bytes.fromhex("7f10dabe")) == "vdi"
    assert detect(b"WithoutFreeSpace" + (2).to_bytes(4, "little") + bytes(50)) == "parallels"
    assert detect(b"WithoutFreeSpace" + (3).to_bytes(4, "little") + bytes(50)) == "raw"
    assert detect(b"# Disk DescriptorFile\n") == "vmdk"
    bochs = (b"Bochs Virtual HD Image".ljust(32, b"\0") + b"Redolog".ljust(16, b"\0") + b"Growing".ljust(16, b"\0") + (0x20000).to_bytes(4, "little")).ljust(512, b"\0")
    assert detect(bochs) == "bochs"
    foot = bytearray(512)
    foot[:8] = b"conectix"
    total = sum(foot)
    foot[64:68] = (0xFFFFFFFF - total).to_bytes(4, "big")
    assert one(spark, formats.detect_tail(F.lit(foot))) == "vhd"
    foot[100] = 1
    assert one(spark, formats.detect_tail(F.lit(foot))) == "raw"


def test_info_reads_files(spark, tmp_path):
    h = bytearray(104)
    h[:8] = b"QFI\xfb\0\0\0\3"
    h[20:24] = (16).to_bytes(4, "big")
    h[24:32] = (1 << 30).to_bytes(8, "big")
    (tmp_path / "a.img").write_bytes(h)
    r = formats.info(formats.read_headers(spark, str(tmp_path))).first()
    assert (r.format, r.version, int(r.virtual_size), r.cluster_size, r.has_backing) == ("qcow2", 3, 1 << 30, 65536, False)


def test_crc32c(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "x binary")
    assert [r[0] for r in df.select(geometry.crc32c("x")).collect()] == [0xE3069283, None]


def test_streamed_bitmap(spark, tmp_path):
    from blocklens.streaming.dirty import keep_bitmap

    writes = spark.createDataFrame([("a", i * 100) for i in range(50)], "bitmap string, offset long")
    writes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(writes.schema).parquet(str(tmp_path / "in"))
    keep_bitmap(stream, 1000, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.granule for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_streams_drop_repeats_and_late_rows(spark, tmp_path):
    from blocklens.streaming.dirty import granules, windowed_writes

    schema = "ts timestamp, bitmap string, offset long, length long"

    def put(name, rows):
        spark.createDataFrame(rows, "t string, bitmap string, offset long, length long").selectExpr("cast(t as timestamp) AS ts", "bitmap", "offset", "length").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run(name, made, out):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        made(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"{out}-state")).trigger(availableNow=True).start(str(tmp_path / out)).awaitTermination()
        return spark.read.parquet(str(tmp_path / out)).collect()

    put("one", [("2024-01-01 00:00:00", "a", 100, 5), ("2024-01-01 00:01:00", "a", 900, 5), ("2024-01-01 00:02:00", "a", 1500, 5)])
    run("one", lambda s: granules(s, 1000), "dirty_granules")
    put("one", [("2024-01-01 00:03:00", "a", 10, 5), ("2024-01-01 00:03:30", "b", 10, 5)])
    assert sorted((r.bitmap, r.granule) for r in run("one", lambda s: granules(s, 1000), "dirty_granules")) == [("a", 0), ("a", 1), ("b", 0)]
    put("two", [("2024-01-01 00:10:00", "a", 0, 5), ("2024-01-01 00:50:00", "a", 0, 7)])
    run("two", windowed_writes, "dirty_windows")
    put("two", [("2024-01-01 03:00:00", "a", 0, 1)])
    run("two", windowed_writes, "dirty_windows")
    put("two", [("2024-01-01 00:20:00", "a", 0, 100)])
    got = run("two", windowed_writes, "dirty_windows")
    # The last batch comes after its window has closed.
    assert [(r.bitmap, r.writes, r.bytes) for r in got if r.window.start.hour == 0] == [("a", 2, 12)]


def stepwise_geometry(n):
    """The specification's algorithm, one sector count at a time."""
    n = min(n, S.MOST_CHS_SECTORS)
    if n >= 65535 * 16 * 63:
        return n // 255 // 16, 16, 255
    tracks = n // 17
    heads, track = max(4, -(-tracks // 1024)), 17
    for longer in (31, 63):
        if tracks >= heads * 1024 or (longer == 31 and heads > 16):
            heads, track = 16, longer
            tracks = n // track
    return tracks // heads, heads, track


def test_geometry_covers_like_a_search(spark):
    rng = random.Random(4)
    edges = [b + d for first, last, _, _ in chs.ranges() for b in (first, last) for d in (-1, 0, 1, 7)]
    counts = [n for n in edges + [rng.randrange(1, 1 << rng.randrange(1, 28)) for _ in range(300)] if 0 < n <= S.MOST_CHS_SECTORS]
    t = spark.createDataFrame([(n,) for n in counts], "n long").select("n", chs.covering_geometry(F.col("n") * 512).alias("g"), chs.floor_geometry(F.col("n")).alias("f"))
    for row in t.collect():
        assert tuple(row.f) == stepwise_geometry(row.n), row.n
        c = row.n
        while True:
            g = stepwise_geometry(c)
            if g[0] * g[1] * g[2] >= row.n:
                break
            c += 1
        assert tuple(row.g) == g, row.n


def test_geometry_of_known_sizes(spark):
    sizes_ = [0, 53433856, 5_000_000_000_000]
    t = spark.createDataFrame([(n,) for n in sizes_], "n long").withColumn("c", chs.covering_geometry(F.col("n")))
    got = {r.n: (r.r, tuple(r.g)) for r in t.select("n", chs.rounded_size(F.col("n"), F.col("c")).alias("r"), chs.footer_geometry(F.col("n"), F.col("c")).alias("g")).collect()}
    assert got[0] == (0, (0, 0, 0))
    assert got[53433856] == (53433856, (877, 7, 17))
    assert got[5_000_000_000_000] == (S.MOST_CHS_SECTORS * 512, (65535, 16, 255))


@pytest.mark.parametrize("raw, text", [("", ""), ("00", None), ("4100", "A"), ("410000", None), ("00D8", None), ("00DC", None), ("3DD800DE", "\U0001f600"), ("3DD83DD8", None), ("41000000" + "00D8", "A"), ("00DC3DD8", None)])
def test_utf16_refuses_broken_surrogates(spark, raw, text):
    assert one(spark, S.utf16_text(F.unhex(F.lit(raw)), big=False)) == text
    swapped = "".join(raw[i + 2 : i + 4] + raw[i : i + 2] for i in range(0, len(raw), 4))
    assert one(spark, S.utf16_text(F.unhex(F.lit(swapped)), big=True)) == text


def test_references_tell_nothing_about_files_outside(spark):
    files = spark.createDataFrame([("/img/a", "/img/a"), ("/img/out", "/etc/x"), ("/img/ring", None), ("/etc/x", "/etc/x"), ("/imgs/a", "/imgs/a")], "path string, physical string")
    refs = [(1, "a", False), (2, "/etc/x", False), (3, "/etc/y", False), (4, "out", False), (5, "ring", False), (6, "gone", False), (7, "/else/a", False), (8, "/else/a", True), (9, "../imgs/a", False), (10, None, False), (11, "/img/sub/../a", None), (12, "/else/..", False)]
    t = spark.createDataFrame([(i, "/img/top", r, w) for i, r, w in refs], "ref_id int, image string, reference string, writes boolean")
    got = {r.ref_id: (r.outcome, r.path) for r in paths.resolve_references(t, files, ["/img/"]).collect()}
    no = ("not_allowed", None)
    assert got == {1: ("found", "/img/a"), 2: no, 3: no, 4: no, 5: ("loop", None), 6: ("not_found", None), 7: ("beside", "/img/a"), 8: no, 9: no, 10: ("none", None), 11: ("found", "/img/a"), 12: no}
    assert {r.outcome for r in paths.resolve_references(t.filter("ref_id = 1"), files, []).collect()} == {"not_allowed"}


def test_headers_of_growing_and_compressed_formats(spark):
    bochs = b"Bochs Virtual HD Image".ljust(32, b"\0") + b"Redolog".ljust(16, b"\0") + b"Growing".ljust(16, b"\0")
    sample = {
        "v2": (bochs + (0x20000).to_bytes(4, "little")).ljust(88, b"\0") + (1_000_000).to_bytes(8, "little"),
        "v1": (bochs + (0x10000).to_bytes(4, "little")).ljust(84, b"\0") + (5120).to_bytes(8, "little"),
        "other": bochs + (0x30000).to_bytes(4, "little"),
        "cloop": formats.CLOOP.ljust(128, b"\0") + (65536).to_bytes(4, "big") + (10).to_bytes(4, "big"),
        "qed": b"QED\0" + (65536).to_bytes(4, "little") + b"\0" * 40 + (1 << 30).to_bytes(8, "little") + (64).to_bytes(4, "little") + (9).to_bytes(4, "little"),
    }
    t = spark.createDataFrame([(k, bytearray(v.ljust(512, b"\0"))) for k, v in sample.items()], "path string, header binary")
    got = {r.path: (r.format, int(r.virtual_size or 0), r.cluster_size, r.has_backing) for r in formats.info(t).collect()}
    assert got == {"v2": ("bochs", 999936, None, False), "v1": ("bochs", 5120, None, False), "other": ("raw", 0, None, False), "cloop": ("cloop", 655360, None, False), "qed": ("qed", 1 << 30, 65536, True)}


def test_trailers_and_tables_cut_short(spark):
    koly = b"koly" + bytes(508)
    tails = [(1, bytearray(b"\xff" * 600 + koly), 5000), (2, bytearray(koly + b"x" * 512), 1024), (3, bytearray(b"koly" + b"x" * 100), 104), (4, None, 9), (5, bytearray(b"x" + koly + b"x" * 511), 9000)]
    got = {r.image_id: r.koly_offset for r in containers.dmg_trailers(spark.createDataFrame(tails, "image_id int, tail binary, length long")).collect()}
    assert got == {1: 4488, 5: 7977}
    regions = spark.createDataFrame([(1, bytearray(b"regi" + bytes(4) + b"\xff\x07" + bytes(6) + bytes(40)), True), (2, bytearray(b"regi"), True), (3, None, True)], "image_id int, raw binary, good boolean")
    assert [(r.image_id, r.region, r.required) for r in containers.vhdx_regions(regions).collect()] == [(1, "unknown", False)]


def test_data_devices_need_their_owner(spark):
    d = [(1, 0, "qcow2", False, 1), (1, 1, "raw", True, 0), (2, 0, "qcow2", False, 0), (2, 1, "raw", True, 0), (3, 0, "raw", False, 1), (3, 1, "raw", True, 0), (4, 0, "qcow2", False, 2), (4, 1, "raw", False, 0), (4, 2, "raw", True, 0), (5, 0, "qcow2", False, None), (6, 0, "qcow2", False, 1), (6, 1, "raw", True, 0)]
    t = spark.createDataFrame(d, "chain_id int, slot int, format string, is_data boolean, data_slot int")
    tops = spark.createDataFrame([(1, 0), (6, 1), (6, 1)], "chain_id int, slot int")
    assert {r.chain_id: r.owned for r in chains.data_devices_owned(t, tops).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_deflated_clusters_are_placed(spark):
    import zlib

    rng = random.Random(3)
    payloads = [bytes([b % 7]) * 4096 if b % 3 else rng.randbytes(4096) for b in range(12)]
    df = spark.createDataFrame([(0, b, bytearray(p)) for b, p in enumerate(payloads)], "image_id long, block_idx long, payload binary")
    at, want = 1024, {}
    for b, p in enumerate(payloads):
        c = zlib.compressobj(9, zlib.DEFLATED, -12)
        size = len(c.compress(p) + c.flush())
        if size < 4096:
            want[b], at = (size, at), at + -(-size // 512) * 512
    got = schedule.place_deflated(df, 512, 1024, chunk=5)
    assert {r.block_idx: (r["size"], r.file_offset) for r in got.collect()} == want and len(want) == 8


#: Keys whose images have less than 63 bits of bytes, and more.
WIDE_KEYS = [0, 1, 7, 524287, 524288, 741456, 899999]


def vhdx_by_hand(v):
    block = next(b for limit, b in ((32 << 40, 64 << 20), (100 << 30, 32 << 20), (1 << 30, 16 << 20), (-1, 8 << 20)) if v > limit)
    blocks, ratio = -(-v // block), (1 << 32) // block
    return block, ratio, blocks, blocks + max(blocks - 1, 0) // ratio


def test_measure_vhdx_beyond_64_bits(spark, tmp_path):
    from blocklens.queries import QUERIES

    spark.createDataFrame([(k,) for k in WIDE_KEYS], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want, mib = {}, 1 << 20
    for k in WIDE_KEYS:
        v = -(-((k * k << 25) + k % 600) // 512) * 512
        block, _, blocks, entries = vhdx_by_hand(v)
        bat = max(-(-entries * 8 // mib), 1) * mib
        held = k % 9 or -(-k * 1000000 // block)
        sizes_of = {"dynamic": (3 * mib + bat + held * block, 3 * mib + bat + blocks * block), "fixed": (7 * mib + bat + v,) * 2}
        want |= {(k, kind): tuple(n if n < 1 << 63 else None for n in pair) for kind, pair in sizes_of.items()}
    got = {(r.id, r.kind): (r.required, r.fully_allocated) for r in QUERIES["measure_vhdx"](spark, str(tmp_path)).collect()}
    assert got == want and want[524288, "fixed"] == (None, None) and want[524288, "dynamic"][0]


def test_vhdx_layouts_beyond_64_bits(spark, tmp_path):
    from blocklens.queries import QUERIES

    spark.createDataFrame([(k,) for k in WIDE_KEYS], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.image_id: tuple(r)[1:] for r in QUERIES["vhdx_layouts"](spark, str(tmp_path)).collect()}
    assert got == {k: vhdx_by_hand((k * k << 25) + 1) for k in WIDE_KEYS}
