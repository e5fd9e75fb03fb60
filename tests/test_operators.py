"""Operators on small made-up frames."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plangrove.functions import geometry as G
from plangrove.functions import scalars as S
from plangrove.operators import aggregates, classify, generate, graph, matching, rules, units, windows


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_keys(spark):
    r = one(spark, S.sheet_key(F.lit("APT_FP_ab_12_u3")).alias("a"), S.sheet_key(F.lit("APT_u1_FP_u2x")).alias("b"), S.drawing_key(F.lit("X_u12")).alias("c"), S.signature_of_plan(F.lit("APT_FP_9f_77_u2")).alias("d"), S.signature_of_plan(F.lit("none")).alias("e"), S.config_key(F.lit("gen-v0-x-seed42")).alias("f"), S.fingerprint_of_sheet(F.lit("APT_FP_9f_77")).alias("g"))
    assert tuple(r) == ("APT_FP_ab_12", "APT_u1_FP", "X", "9f_77", None, "gen-v0-x", "9f_77")


def test_split_buckets_follow_md5(spark):
    import hashlib

    keys = [f"APT_FP_{k}" for k in range(200)]
    got = {r.k: r for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.split_bucket(F.col("k")).alias("b"), S.md5_mod(F.col("k"), 20).alias("m")).collect()}
    for k in keys:
        assert got[k].b == int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert got[k].m == int(hashlib.md5(k.encode()).hexdigest(), 16) % 20


@pytest.mark.parametrize("values", [[], [5], [1, 2], [3, 1, 2], [4, 1, 3, 2], list(range(37))])
def test_quantiles(spark, values):
    a = F.array(*map(F.lit, values)).cast("array<double>")
    r = one(spark, S.upper_median(a).alias("u"), S.lower_median(a).alias("l"), S.nearest_rank(a, 0.9).alias("n"))
    s = sorted(values)
    want = (s[len(s) // 2], s[math.ceil(len(s) / 2) - 1], s[round(0.9 * (len(s) - 1))]) if s else (None, None, None)
    assert tuple(r) == want


def test_wilson_and_draws(spark):
    for k, n in ((0, 0), (0, 10), (3, 10), (10, 10), (250, 1000)):
        low, high = S.wilson(F.lit(k), F.lit(n))
        r = one(spark, low.alias("l"), high.alias("h"))
        if not n:
            assert tuple(r) == (0.0, 0.0)
            continue
        z, p = 1.96, k / n
        c, h = (p + z * z / 2 / n) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
        assert abs(r.l - max(0, c - h)) < 1e-12 and abs(r.h - min(1, c + h)) < 1e-12
    r = one(spark, *(S.draws_for(F.lit(p)).alias(f"c{i}") for i, p in enumerate((0.0, 0.25, 1.0))))
    assert tuple(r) == (None, 11, None)


def test_reasons_and_dispositions(spark):
    rows = [("success", None), ("quarantine", "R2_doorless_room,R4_no_entrance"), ("quarantine", "duplicate:x,R1_isolated_component"), ("quarantine", ""), (None, "odd")]
    g, n = classify.disposition_of(F.col("s"), F.col("r"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "s string, r string").select(g, n).collect()]
    assert got == [("use", "accepted"), ("fix", "R4_no_entrance"), ("excl", "duplicate"), ("fix", "other"), ("use", "accepted")]
    assert one(spark, S.clean_reasons(F.lit(" a, b,a ,,")).alias("x")).x == ["a", "b"]
    assert one(spark, S.clean_reasons(F.lit(None).cast("string")).alias("x")).x == [""]


def test_filenames(spark):
    rows = [("APT_FP_STR_123456789",), ("APT_FP_STR_12345678",), ("XXX_FP_STR_123456789",), ("APT_FP_STR",), ("",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "s string").select(classify.filename_parts(F.col("s")).alias("p")).collect()]
    assert tuple(got[0]) == ("APT", "FP", "STR", "123456789") and got[1:] == [None] * 5


def test_rings(spark):
    square, ell, bow = ring((0, 0), (4, 0), (4, 3), (0, 3)), ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)), ring((0, 0), (1, 0))
    r = one(spark, G.area(square).alias("a"), G.perimeter(square).alias("p"), G.area(ell).alias("e"), G.area(bow).alias("b"), G.corner_count(ell).alias("c"), G.bbox(ell).alias("box"))
    assert (r.a, r.p, r.e, r.b, r.c, tuple(r.box)) == (12.0, 14.0, 6.0, 0.0, 6, (0.0, 0.0, 4.0, 3.0))
    inside = [one(spark, G.contains(ell, F.lit(float(x)), F.lit(float(y))).alias("c")).c for x, y in ((0.5, 2), (2, 0.5), (2, 2), (5, 0.5))]
    assert inside == [True, True, False, False]
    assert one(spark, G.ring_distance(square, F.lit(6.0), F.lit(1.0)).alias("d")).d == 2.0
    assert one(spark, G.segment_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("d")).d == 0.0


def test_canonical_key_ignores_shift_and_mirror(spark):
    base = [[(0, 0), (4, 0), (4, 3)], [(5, 5), (9, 5), (9, 6), (5, 6)]]
    key = lambda rings: one(spark, G.canonical_key(F.array(*(ring(*r) for r in rings)), 1.0).alias("k")).k
    keys = {key([[(fx * x + dx, fy * y + dy) for x, y in r] for r in base]) for fx, fy, dx, dy in ((1, 1, 0, 0), (-1, 1, 7, -3), (1, -1, 100, 2), (-1, -1, 0, 9))}
    assert len(keys) == 1 and key([base[0]]) not in keys


def test_islands_pages_samples(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 4, 10, 11, 30, 2)], "k int, v int")
    got = sorted((r.low, r.high, r.n_values) for r in windows.islands(df, ["k"], "v", 2).collect())
    assert got == [(1, 4, 3), (10, 11, 2), (30, 30, 1)]
    ids = spark.range(103).select(F.col("id"))
    assert [r.id for r in windows.page(ids, ["id"], 10_000, 25).collect()] == [100, 101, 102]
    assert [r.id for r in windows.page(ids, ["id"], -5, 2).collect()] == [0, 1]
    assert windows.page(ids.where("id < 0"), ["id"], 5, 2).count() == 0
    assert sorted(r.id for r in windows.strided_sample(ids, ["id"], 10).collect()) == [i * 103 // 10 for i in range(10)]
    assert windows.strided_sample(ids, ["id"], 500).count() == 103


def random_plan(spark, seed, n=60):
    r = random.Random(seed)
    nodes, edges = [], []
    for g in range(6):
        for k in range(1, n // 6 + 1):
            nodes.append((g, k, r.choice("ABC"), float(r.randint(1, 30)), 100.0, r.random() < 0.1, r.random() < 0.5))
        for _ in range(r.randint(0, 12)):
            a, b = r.sample(range(1, n // 6 + 1), 2)
            edges.append((g, a, b, "A", "B", r.choice(["door", "open"])))
    return nodes, edges, spark.createDataFrame(nodes, "g long, n int, role string, area double, price double, is_entrance boolean, has_window boolean"), spark.createDataFrame(edges, "g long, a int, b int, role_a string, role_b string, via string")


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_hops(spark, seed):
    nodes, edges, nd, ed = random_plan(spark, seed)
    near = {}
    for g, a, b, *_ in edges:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    comp, hops = {}, {}
    for g, n, *_ in nodes:
        seen, todo = {n}, [n]
        while todo:
            for w in near.get((g, todo.pop()), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        comp[g, n] = min(seen)
    for g in range(6):
        front = {n for h, n, *_, e, _ in nodes if h == g and e}
        known, d = set(front), 0
        for n in front:
            hops[g, n] = 0
        while front:
            d += 1
            front = {w for v in front for w in near.get((g, v), ())} - known
            known |= front
            hops |= {(g, w): d for w in front}
    assert {(r.g, r.n): r.component for r in graph.components(nd, ed).collect()} == comp
    assert {(r.g, r.n): r.hops for r in graph.hop_distance(nd, ed, F.col("is_entrance")).collect()} == {k: hops.get(k) for k in comp}
    empty = ed.where("false")
    assert {(r.g, r.n): r.component for r in graph.components(nd, empty).collect()} == {(g, n): n for g, n, *_ in nodes}
    # plans above the limit of a task are solved through tables, with the same result
    whole = {(r.g, r.n): r for r in graph.solved(nd, ed, F.col("is_entrance")).collect()}
    for limit in (0, 14, 20):
        assert {(r.g, r.n): r for r in graph.solved(nd, ed, F.col("is_entrance"), limit=limit).collect()} == whole, limit
    assert {k: r.component for k, r in whole.items()} == comp and {k: r.hops for k, r in whole.items()} == {k: hops.get(k) for k in comp}
    for (g, n), r in whole.items():
        size = {c: sum(comp[k] == c for k in comp if k[0] == g) for c in {comp[k] for k in comp if k[0] == g}}
        assert r.main == (min(size, key=lambda c: (-size[c], c)) == r.component) and r.degree == sum((h == g) * ((a == n) + (b == n)) for h, a, b, *_ in edges)
        assert r.entered == any(h == g and e for h, _, *_, e, _ in nodes) and r.first == (n == 1)


def test_plans_stay_whole_where_rooms_and_edges_come_dealt_by_plan(spark):
    """Both sides come from shuffles by plan of very different sizes, which AQE coalesces apart."""
    from pyspark.sql import Window

    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        rows = spark.range(6000).select((F.col("id") % 2000).alias("g"), F.col("id").alias("k"))
        rooms = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k"))).select("g", "n")
        wide = rows.withColumn("pad", F.sha2(F.col("k").cast("string"), 512)).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
        pairs = wide.select("g", F.col("n").alias("a"), F.col("pad").alias("p")).join(wide.select("g", F.col("n").alias("b"), F.col("pad").alias("q")), "g")
        near = pairs.where("a < b and p <> q").select("g", "a", "b", F.lit("near").alias("via"))
        found = graph.solved(rooms, near).groupBy("component").agg(F.count("*").alias("k")).collect()
        assert [(r.component, r.k) for r in found] == [(1, 6000)]
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rules_of(spark, rooms, edges, unresolved=()):
    """The rules that one plan (rooms as role, entrance) violates."""
    nd = spark.createDataFrame([(1, k, role, e) for k, (role, e) in enumerate(rooms, 1)], "g long, n int, role string, is_entrance boolean")
    ed = spark.createDataFrame([(1, a, b, via) for a, b, via in edges], "g long, a int, b int, via string")
    left = spark.createDataFrame(list(unresolved), "g long, n_unresolved long")
    found = rules.integrity(graph.solved(nd, ed, F.col("is_entrance")), left)
    return sorted((r.rule, r.n) for r in found.collect())


def test_integrity_rules(spark):
    two = [("entrance", True), ("bedroom", False)]
    assert rules_of(spark, two, [(1, 2, "door")]) == []
    # an open passage or a balcony joins as well as a door
    assert rules_of(spark, two, [(1, 2, "open")]) == []
    assert rules_of(spark, [*two, ("balcony", False)], [(1, 2, "door"), (2, 3, "balcony")]) == []
    # a blocked gap: no way between the two
    assert rules_of(spark, two, []) == [("R1_isolated_component", 2), ("R2_doorless_room", 1), ("R2_doorless_room", 2), ("R3_unreachable_from_entrance", 2)]
    # an isolated third room; the larger part is the main one even if its least room comes later
    assert rules_of(spark, [*two, ("store", False)], [(1, 2, "door")]) == [("R1_isolated_component", 3), ("R2_doorless_room", 3), ("R3_unreachable_from_entrance", 3)]
    assert rules_of(spark, [("store", False), *two], [(2, 3, "door")]) == [("R1_isolated_component", 1), ("R2_doorless_room", 1), ("R3_unreachable_from_entrance", 1)]
    assert rules_of(spark, [("a", False), ("b", False)], [(1, 2, "door")]) == [("R4_no_entrance", None)]
    assert rules_of(spark, two, [(1, 2, "door")], [(1, 2), (2, 0)]) == [("R5_unresolved_doors", None)]


def test_legal_rules(spark):
    shape = "g long, n int, role string, area double, len double, has_window boolean, scale double"
    nd = spark.createDataFrame([(1, 1, "bed", 10.0, 0.0, True, 1.0), (1, 2, "bed", 10.0, 0.5, True, 1.0), (1, 3, "bed", 5.0, 2.0, False, 1.0), (1, 4, "balcony", 50.0, 0.0, False, 1.0), (2, 1, "bed", 5.0, 0.1, True, None), (3, 1, "bed", 8.0, 9.0, True, 1.0), (3, 2, "balcony", 90.0, 0.0, False, 1.0)], shape)
    got = rules.legal(nd, F.col("scale"), F.col("role") == "bed", F.col("role") == "bed", F.lit(False), F.col("len"), F.col("role") == "balcony")
    want = [(1, 2, "L1_daylight_ratio"), (1, 3, "L1_daylight_window"), (1, 3, "L2_ventilation_window"), (1, 3, "L4_bedroom_min_area"), (3, None, "L5_dwelling_min_area")]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_architecture_rules(spark):
    roles = {"unit": "unit", "balcony": "balcony", "dressing": "dressing", "bedrooms": ["bed"], "bath": "bath", "hub": "hub"}
    nd = spark.createDataFrame([(1, 1, "unit"), (1, 2, "balcony"), (1, 3, "dressing"), (1, 4, "bed"), (1, 5, "bath"), (1, 6, "unit"), (2, 1, "dressing"), (2, 2, "bed"), (2, 3, "bath"), (2, 4, "hub")], "g long, n int, role string")
    e = [(1, 1, 2), (1, 3, 4), (1, 3, 5), (1, 4, 5), (1, 4, 2), (2, 1, 2), (2, 1, 3), (2, 1, 4)]
    role = {(r.g, r.n): r.role for r in nd.collect()}
    ed = spark.createDataFrame([(g, a, b, role[g, a], role[g, b], "door") for g, a, b in e], "g long, a int, b int, role_a string, role_b string, via string")
    assert sorted((r.g, r.n, r.rule) for r in rules.architecture(nd, ed, **roles).collect()) == [(1, 3, "A2_master_suite_hub"), (1, 6, "A4_hvac_on_balcony")]
    rooms, links = rules.apply_architecture(nd, ed, **roles, living=["bed"])
    assert sorted(map(tuple, rooms.where("role = 'hub'").select("g", "n").collect())) == [(1, 7), (2, 4)]
    got = sorted((r.g, r.a, r.b, r.via) for r in links.collect())
    assert got == [(1, 1, 2, "door"), (1, 2, 4, "open"), (1, 2, 6, "balcony"), (1, 3, 7, "open"), (1, 4, 7, "open"), (1, 5, 7, "door"), (2, 1, 2, "door"), (2, 1, 3, "door"), (2, 1, 4, "door")]


def test_window_and_egress_repairs(spark):
    boxes = [(1, 1, "hall", True, 0, 0, 4, 4), (1, 2, "bed", False, 4, 0, 8, 4), (1, 3, "bed", False, 8, 0, 12, 4), (1, 4, "bed", False, 40, 0, 44, 4), (2, 1, "bed", False, 0, 0, 4, 4)]
    rooms = spark.createDataFrame([(g, n, r, e, r == "hall", *map(float, b)) for g, n, r, e, *b in boxes], "g long, n int, role string, is_entrance boolean, has_window boolean, x0 double, y0 double, x1 double, y1 double").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    none = spark.createDataFrame([], "g long, a int, b int")
    got = sorted((tuple(r) for r in units.egress_repair(rooms, none, 0.5, 1.0).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 3, 2, True), (1, 4, None, False), (2, None, None, False)], key=repr)
    linked = spark.createDataFrame([(1, 1, 2), (1, 4, 3)], "g long, a int, b int")
    # a new door opens the way to what lies behind it
    assert sorted(tuple(r) for r in units.egress_repair(rooms.where("g = 1"), linked, 0.5, 1.0).collect()) == [(1, 3, 2, True)]
    inner = [(1, 1, 0, 0, 2, 2), (1, 2, 2, 0, 4, 2), (1, 3, -2, 0, 0, 2), (1, 4, 0, 2, 2, 4), (1, 5, 0, -2, 2, 0)]
    dark = spark.createDataFrame([(g, n, False, *map(float, b)) for g, n, *b in inner], "g long, n int, has_window boolean, x0 double, y0 double, x1 double, y1 double").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    fixed = {r.n: (r.ok, r.x, r.y, r.width) for r in units.window_repair(dark, F.col("n").isin(1, 2)).collect()}
    assert fixed == {1: (False, None, None, None), 2: (True, 3.0, 0.0, 24.0)}


def test_verdicts_and_egress(spark):
    nd = spark.createDataFrame([(1, 1, "A", 10.0, 1.0, True, True), (1, 2, "B", 8.0, 1.0, False, True), (2, 1, "A", 10.0, 1.0, False, True)], "g long, n int, role string, area double, price double, is_entrance boolean, has_window boolean")
    ed = spark.createDataFrame([(1, 1, 2, "A", "B", "door")], "g long, a int, b int, role_a string, role_b string, via string")
    solved = graph.solved(nd, ed, F.col("is_entrance"))
    found = rules.integrity(solved, spark.createDataFrame([], "g long, n_unresolved long"))
    assert sorted((r.g, r.rule) for r in found.collect()) == [(2, "R2_doorless_room"), (2, "R4_no_entrance")]
    assert {r.g: r.passed for r in rules.verdicts(found, nd).collect()} == {1: True, 2: False}
    assert sorted((r.g, r.n) for r in rules.egress(solved).collect()) == [(2, None)]


def test_grid_pairs_equal_all_pairs(spark):
    r = random.Random(6)
    boxes = [(1, i, x := r.uniform(-50, 50), y := r.uniform(-50, 50), x + r.uniform(0, 40), y + r.uniform(0, 15)) for i in range(80)]
    df = spark.createDataFrame(boxes, "s int, id int, x0 double, y0 double, x1 double, y1 double").select("s", "id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    for pad in (0.0, 3.0):
        got = sorted((p.id_l, p.id_r) for p in matching.box_pairs(df, df, ["s"], 7.0, pad).collect())
        meet = lambda a, b: a[2] - pad < b[4] and b[2] - pad < a[4] and a[3] - pad < b[5] and b[3] - pad < a[5]
        assert got == sorted((a[1], b[1]) for a, b in itertools.product(boxes, boxes) if meet(a, b))


def test_greedy_matches(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.9), (1, 2, 2, 0.8), (1, 2, 1, 0.1), (2, 1, 1, 0.3)], "g long, a int, b int, score double")
    assert sorted((r.g, r.a, r.b) for r in matching.greedy_by_score(pairs, "g").collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    assert matching.greedy_by_score(pairs.where("false"), "g").count() == 0
    shape = "g long, id int, role string, x double, y double"
    left = spark.createDataFrame([(1, 1, "a", 0.0, 0.0), (1, 2, "a", 1.0, 0.0)], shape)
    right = spark.createDataFrame([(1, 1, "a", 1.0, 0.0), (1, 2, "b", 0.0, 0.0), (1, 3, "a", 9.0, 0.0)], shape)
    # the nearest of any role; of equally near ones the later
    assert [(r.a, r.b, r.same_role) for r in matching.greedy_in_order(left, right, "g", 5.0).collect()] == [(1, 2, False), (2, 1, True)]
    twins = spark.createDataFrame([(1, 1, "a", 1.0, 0.0), (1, 2, "a", -1.0, 0.0)], shape)
    assert [(r.a, r.b) for r in matching.greedy_in_order(left.where("id = 1"), twins, "g", 5.0).collect()] == [(1, 2)]
    same = lambda a, b, t: matching.same_correction(a, b, "g", t).first().same
    assert same(left, left, 0.0) and not same(left, right, 5.0) and not same(left, twins, 0.5) and same(left, twins, 1.5)
    assert [(r.a, r.b, r.role_a, r.role_b) for r in matching.centroid_match(left, right, "g", 2.0).collect()] == [(1, 2, "a", "b"), (2, 1, "a", "a")]
    assert matching.alignment_error(left, twins, "g").first().worst == 2.0 and matching.alignment_error(left, right, "g").first().worst == float("inf")


def test_generator_connects_every_plan(spark):
    programs = spark.createDataFrame([(g, ["A", "B", "B", "C"]) for g in range(300)], "g long, roles array<string>")
    make = generate.GENERATORS.make("statistical", {("B", "A"): 0.5, ("C", "A"): 0.0}, seed=3)
    edges = make(programs).collect()
    assert edges == make(programs).collect()
    share = sum(not e.joined and {e.a, e.b} == {0, 1} for e in edges) / 300
    assert 0.4 < share < 0.6
    for g in range(300):
        label = list(range(4))
        for e in edges:
            if e.g == g:
                label = [label[e.a] if x == label[e.b] else x for x in label]
        assert len(set(label)) == 1
    with pytest.raises(KeyError):
        generate.GENERATORS.make("none")


def test_l1_distance_of_empty_histograms(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "k string, n long")
    assert aggregates.l1_distance(a, a, ["k"]).first().l1 == 0.0
    assert aggregates.l1_distance(a, a.where("false"), ["k"]).first().l1 == 1.0
    assert aggregates.l1_distance(a.where("false"), a.where("false"), ["k"]).first().l1 == 0.0


def test_contamination_does_not_depend_on_the_size_of_the_benchmark(spark, tmp_path, monkeypatch):
    from plangrove.plans import releases

    long = "a passage of more than twenty-four characters"
    spark.createDataFrame([(1, f"x {long} y"), (2, "ab abc"), (3, ""), (4, None), (5, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", long), ("b", "abc"), ("c", "ab"), ("d", ""), ("e", None), ("f", "absent"), ("g", long[:24])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"a": 1, "b": 2, "c": 2, "d": 4, "e": 0, "f": 0, "g": 1}
    for limit in (8_000_000, 1):
        monkeypatch.setattr(releases, "SLICE_BYTES", limit)
        assert {r.item_id: r.n_docs for r in releases.benchmark_contamination(spark, str(tmp_path)).collect()} == want, limit
