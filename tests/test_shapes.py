"""Polygon functions, drawings and topology against plain counts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plangrove.functions import shapes
from plangrove.operators import drawings, manifest, matching, siblings, topology

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
BOW = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]


def box(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


def test_valid_rings():
    assert shapes.is_simple(SQUARE) and not shapes.is_simple(BOW) and not shapes.is_simple(SQUARE[:2])
    assert not shapes.is_simple([(0, 0), (4, 0), (2, 0), (2, 3)])  # runs back over itself
    assert shapes.points([(0, 0), (0, 0), {"x": 1, "y": 0}, (1, None), (1, 1), (0, 0)]) == [(0, 0), (1, 0), (1, 1)]
    fixed = shapes.repair(BOW)
    assert shapes.is_simple(fixed) and abs(shapes.signed_area(fixed)) == 4.0
    assert shapes.repair([(0, 0), (1, 1), (2, 2)]) is None
    assert shapes.largest([[0, 0, 1, 0, 1, 1], [0, 0, 9, 0, 9, 9, 0, 9], [1, 2]]) == box(0, 0, 9, 9)
    assert shapes.largest(None) is None and shapes.largest([[0, 0, 1, 1, 2, 2]]) is None


def test_measures():
    assert shapes.centroid([(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)]) == pytest.approx((1.5, 1.0))
    turned = [(x * math.cos(0.5) - y * math.sin(0.5), x * math.sin(0.5) + y * math.cos(0.5)) for x, y in box(0, 0, 6, 2)]
    assert shapes.aspect_ratio(turned) == 3.0 and shapes.aspect_ratio(SQUARE[:2]) == 0.0
    long, short, normal = shapes.least_box(turned)
    assert (round(long, 9), round(short, 9)) == (6, 2) and abs(abs(normal[0]) - math.sin(0.5)) < 1e-9
    sector = [(0.0, 0.0)] + [(10 * math.cos(a), 10 * math.sin(a)) for a in (0, 0.3, 0.6, 0.9, 1.2, 1.5)]
    assert shapes.door_swing(sector)["degrees"] == pytest.approx(43.0, abs=1) and shapes.door_swing(SQUARE) is None
    assert shapes.simplify([(0, 0), (2, 0.01), (4, 0), (4, 3), (0, 3)], 0.1) == [(0, 0), (4, 0), (4, 3), (0, 3)]
    assert shapes.simplified(SQUARE, 10.0, 0.01) == SQUARE
    assert not shapes.has_diagonal(shapes.rectified([(0, 0), (4, 0), (4, 3), (1, 4)]))
    assert shapes.cleaned([(0, 0), (4, 0), (6, 0), (4, 0), (4, 3), (0, 3)]) == SQUARE
    assert shapes.deburred([(0, 0), (4, 0), (4, 0.2), (8, 0.2), (8, 3), (0, 3)], 0.5) == box(0, 0, 8, 3)


def test_plan_metrics_against_a_grid():
    r = random.Random(3)
    for _ in range(30):
        rings = [box(x := r.randint(0, 12), y := r.randint(0, 12), x + r.randint(2, 8), y + r.randint(2, 8)) for _ in range(r.randint(1, 6))]
        covered = {(i, j) for a, b, *_ in [(q[0], q[2]) for q in rings] for i in range(int(a[0]), int(b[0])) for j in range(int(a[1]), int(b[1]))}
        total = sum((q[2][0] - q[0][0]) * (q[2][1] - q[0][1]) for q in rings)
        seen, pieces = set(), 0
        for c in covered:
            if c not in seen:
                pieces += 1
                todo = [c]
                while todo:
                    i, j = todo.pop()
                    if (i, j) in covered and (i, j) not in seen:
                        seen.add((i, j))
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        m = shapes.plan_metrics(rings)
        assert m["overlap"] == round((total - len(covered)) / total, 4) and m["pieces"] == pieces
        w, h = (max(p[k] for q in rings for p in q) - min(p[k] for q in rings for p in q) for k in (0, 1))
        assert m["fill"] == pytest.approx(len(covered) / (w * h))
    ring = [box(0, 0, 6, 1), box(0, 5, 6, 6), box(0, 0, 1, 6), box(5, 0, 6, 6)]
    m = shapes.plan_metrics(ring)
    assert (m["holes"], m["pieces"], m["corners"], m["convex"]) == (1, 1, 8, pytest.approx(20 / 36))
    assert shapes.plan_metrics([])["pieces"] is None and shapes.plan_metrics([BOW])["selfint"] == 1


def test_plans_of_boxes_are_measured_many_at_a_time():
    """Equal values to plan_metrics, at a small share of its work."""
    r = random.Random(4)
    for n, side in itertools.product((1, 2, 3, 5, 8), (4, 9)):
        x0, y0 = (np.array([[r.randrange(side) for _ in range(n)] for _ in range(60)], float) for _ in range(2))
        x1, y1 = (a + np.array([[r.randrange(2, 2 + side // 2) for _ in range(n)] for _ in range(60)]) for a in (x0, y0))
        got = shapes.box_metrics(x0, y0, x1, y1)
        for k in range(60):
            want = shapes.plan_metrics([box(*b) for b in zip(x0[k], y0[k], x1[k], y1[k], strict=True)])
            assert {c: got[c][k] for c in want} == want


def test_metrics_of_boxes_and_of_other_drawings(spark):
    rows = [(g, "room", i, "", [(x, g % 3), (x + 3, g % 3), (x + 3, 4), (x, 4)]) for g in range(40) for i, x in enumerate((0, 3 + g % 2, 7))]
    rows += [(50, "room", 0, "", [(0, 0), (4, 0), (0, 4)]), (51, "room", 0, "", [(0.5, 0), (4, 0), (4, 4), (0.5, 4)]), (52, "door", 0, "", [(0, 0), (4, 0), (4, 4), (0, 4)])]
    frame = spark.createDataFrame([(g, k, i, n, [{"x": float(x), "y": float(y)} for x, y in ring]) for g, k, i, n, ring in rows], "g long, kind string, i int, name string, ring array<struct<x:double,y:double>>").coalesce(1)
    got = {r.g: tuple(r)[1:] for r in topology.metrics(frame).collect()}
    by = {}
    for g, kind, _, _, ring in rows:
        by.setdefault(g, []).extend([ring] if kind == "room" else [])
    names = ["n_rooms", "selfint", "diagonal", "least_corners", "overlap", "span", "pieces", "fill", "convex", "corners", "holes"]
    assert got == {g: tuple(shapes.plan_metrics(rings)[n] for n in names) for g, rings in by.items()}


def test_boxes_need_no_grid_and_no_corner_by_corner_distance(monkeypatch):
    """Distances of boxes and passages without a wall in the strip take no plane cells and no crossings; the values are those of other rings."""
    r = random.Random(6)
    shift = lambda ring, d: [(x + d, y + d) for x, y in ring]
    draw = lambda side: box(x := r.randrange(40) / 2, y := r.randrange(40) / 2, x + r.randrange(1, side), y + r.randrange(1, side))
    trials = [(draw(9), draw(9), [draw(4) for _ in range(r.randrange(4))]) for _ in range(300)]
    for a, b, walls in trials:
        # off the halves the long way is taken
        assert topology.ring_distance(a, b) == pytest.approx(topology.ring_distance(shift(a, 0.3), shift(b, 0.3)), abs=1e-9)
        got, want = topology.passage_share(a, b, walls), topology.passage_share(shift(a, 0.3), shift(b, 0.3), [shift(w, 0.3) for w in walls])
        assert (got is None) == (want is None) and (got is None or got == pytest.approx(want, abs=1e-9))
        x, y = r.randrange(80) / 4, r.randrange(80) / 4
        assert shapes.inside(a, x, y) == bool(shapes.inside(a, np.array([x]), np.array([y]))[0])
    monkeypatch.setattr(topology.shapes, "Cells", None)
    monkeypatch.setattr(topology.shapes, "crossing", None)
    assert topology.passage_share(box(0, 0, 10, 10), box(20, 0, 30, 10), [box(40, 0, 41, 10)]) == 1.0
    assert topology.ring_distance(box(0, 0, 10, 10), box(13, 14, 30, 20)) == 5.0


def elements(spark, *rows):
    ring = "array<struct<x:double,y:double>>"
    return spark.createDataFrame([(g, kind, i, name, [(float(x), float(y)) for x, y in r]) for g, kind, i, name, r in rows], f"g long, kind string, i int, name string, ring {ring}")


def test_links_of_a_drawing(spark):
    hall, bed, balcony = (1, "room", 0, "hall", box(0, 0, 100, 100)), (1, "room", 1, "bed", box(100, 0, 200, 100)), (1, "room", 2, "balcony", box(200, 0, 260, 100))
    door, window = (1, "door", 0, "", box(95, 40, 105, 60)), (1, "window", 0, "", box(195, 30, 205, 70))
    links = lambda *rows, **kw: sorted((tuple(r) for r in topology.drawing_links(elements(spark, *rows), **kw).collect()), key=repr)
    # a door between two rooms, the entrance to the outside
    assert links(hall, bed, door, entrance="hall") == [(1, 0, 1, "door", 1), (1, 0, None, "entrance", None)]
    # a window is a way only where one side is a passage
    assert links(bed, balcony, window, passages=["balcony"]) == [(1, 1, 2, "balcony", None)] and links(bed, balcony, window) == []
    # a gap between rooms is a passage unless a wall fills it or the pair is forbidden
    left, right, wall = (1, "room", 0, "a", box(0, 0, 90, 100)), (1, "room", 1, "b", box(110, 0, 200, 100)), (1, "wall", 0, "", box(90, 0, 110, 100))
    assert links(left, right) == [(1, 0, 1, "open", None)] and links(left, right, wall) == [] and links(left, right, forbidden=[("b", "a")]) == []
    # two doors count up, a door at one room leads outside, a door far off is unresolved
    assert links(hall, bed, door, (1, "door", 1, "", box(95, 10, 105, 30))) == [(1, 0, 1, "door", 2)]
    assert links((1, "room", 0, "a", box(0, 0, 100, 100)), (1, "door", 0, "", box(95, 40, 105, 60))) == [(1, 0, None, "exterior_door", 1)]
    assert links(hall, (1, "door", 0, "", box(900, 900, 910, 930))) == [(1, None, None, "unresolved", 1)]
    won = {r.n: (r.n_windows, r.length) for r in topology.drawing_windows(elements(spark, bed, balcony, window)).collect()}
    assert won == {1: (1, 40.0), 2: (1, 40.0)}
    got = {r.i: r.n for r in topology.drawing_objects(elements(spark, hall, bed, (1, "object", 0, "sink", box(10, 10, 20, 20)), (1, "object", 1, "x", box(220, 10, 230, 20)), (1, "object", 2, "y", box(900, 10, 910, 20)))).collect()}
    assert got == {0: 0, 1: 1, 2: None}


def test_walls_and_doors_on_them(spark):
    rooms = [(0, box(0, 0, 100, 100)), (1, box(110, 0, 200, 100))]
    walls = topology.derive_walls(rooms)
    assert sorted(w["kind"] for w in walls) == ["exterior"] * 6 + ["interior"]
    (inner,) = [k for k, w in enumerate(walls) if w["kind"] == "interior"]
    assert walls[inner]["rooms"] == [0, 1] and topology.nearest_wall(walls, 104, 50, [0, 1]) == inner and topology.nearest_wall(walls, 400, 400) is None
    assert topology.door_of_edge(walls, [(300, 300), (105, 40)], 0, 1) == 1 and topology.door_of_edge(walls, [(300, 300)], 0, 1, ((0, 0), (590, 590))) == 0
    assert topology.exterior_length(box(0, 0, 10, 10), [box(10, 0, 20, 10)]) == pytest.approx(26, abs=0.5)
    assert topology.same_wall(((0, 0), (10, 0)), ((0, 5), (10, 6))) and not topology.same_wall(((0, 0), (10, 0)), ((0, 0), (0, 10)))
    assert spark.range(1).select(topology.wall_normal(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(5.0)).alias("d")).first().d == 180.0
    assert topology.drawing_walls(elements(spark, *((1, "room", i, "r", r) for i, r in rooms))).where("kind = 'interior'").count() == 1


def test_drawable(spark):
    good = [(1, "room", 0, "a", box(0, 0, 10, 10)), (1, "room", 1, "b", box(10, 0, 20, 10))]
    bad = [(2, "room", 0, "a", box(0, 0, 100, 5)), (2, "room", 1, "b", box(0, 300, 3, 309)), (2, "room", 2, "c", BOW), (3, "room", 0, "a", box(0, 0, 9, 9))]
    d = {r.g: (r.drawable, r.failed) for r in topology.drawable(topology.metrics(elements(spark, *good, *bad))).collect()}
    assert d[1] == (True, []) and d[3] == (None, None)
    assert d[2] == (False, ["selfint", "span", "diagonal", "pieces", "fill", "convex"])


def test_merge_suggestions_and_units(spark):
    e = elements(spark, (1, "room", 0, "a", box(0, 0, 10, 10)), (1, "room", 1, "b", box(12, 0, 20, 10)), (1, "room", 2, "c", box(500, 0, 510, 10)))
    rooms = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, False)], "g long, n int, is_entrance boolean")
    none = spark.createDataFrame([], "g long, a int, b int")
    assert [tuple(r) for r in topology.merge_suggestions(e, none, rooms).collect()] == [(1, 1, 0, "adjacent")]
    members, noise = topology.units(rooms, spark.createDataFrame([(1, 0, 1)], "g long, a int, b int"))
    assert sorted((r.unit, r.n) for r in members.collect()) == [(0, 0), (0, 1)] and [(r.component, r["size"]) for r in noise.collect()] == [(2, 1)]


def test_annotations_to_elements(spark):
    rows = [(1, 1, "room", [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0]], None, 5.0), (1, 2, "room", None, [1.0, 1.0, 2.0, 2.0], 5.0), (1, 3, "door", [[0.0, 0.0, 1.0, 1.0, 2.0, 2.0]], None, 5.0), (1, 4, "paper", None, None, 1.0), (1, 5, "room", [[*BOW[0], *BOW[1], *BOW[2], *BOW[3]]], None, 1.0)]
    a = spark.createDataFrame(rows, "g long, ann_id long, class_name string, segmentation array<array<double>>, bbox array<double>, area double")
    found = drawings.elements(a, {"room": ["room"], "door": ["door"]})
    got = {(r.kind, r.i): (r.area, r.from_box, r.broken) for r in found.collect()}
    assert got == {("room", 0): (12.0, False, False), ("room", 1): (4.0, True, False), ("room", 2): (4.0, False, False), ("door", 0): (5.0, False, True)}
    header = drawings.drawing_header(spark.createDataFrame([(1, 10, 5), (1, 8, 9)], "g long, width int, height int"), found).first()
    assert tuple(header) == (1, 10, 9, 3, 1)


def test_frames_and_moved_corrections(spark):
    shape = "g string, rings array<array<struct<x:double,y:double>>>"
    base = [[(0, 0), (4, 0), (4, 3)], [(5, 5), (9, 5), (9, 6), (5, 6)]]
    place = lambda fx, fy, dx, dy: [[(float(fx * x + dx), float(fy * y + dy)) for x, y in r] for r in base]
    copies = {"a": place(1, 1, 0, 0), "b": place(-1, 1, 70, -3), "c": place(1, -1, 100, 2), "d": place(-1, -1, 0, 9)}
    d = spark.createDataFrame(list(copies.items()), shape).select("g", siblings.frames(F.col("rings")).alias("t"))
    assert d.select("t.sig").distinct().count() == 1
    pairs = spark.createDataFrame([("a", k) for k in "bcd"], "source string, target string")
    rooms = spark.createDataFrame([("a", n, "r", [(float(x), float(y)) for x, y in r]) for n, r in enumerate(base)], "g string, n int, role string, ring array<struct<x:double,y:double>>")
    moved = siblings.moved_rooms(rooms, d, pairs).collect()
    for r in moved:
        assert [(p.x, p.y) for p in r.ring] == copies[r.g][r.n]
    cells = siblings.cells(rooms.select("g", "n", "role", F.lit(2.0).alias("cx"), F.lit(1.0).alias("cy")), d).collect()
    assert len(cells) == 2
    with pytest.raises(ValueError):
        siblings.propagation(rooms, "a", "guess")
    files = spark.createDataFrame([(1, 3, b"abc"), (1, 3, b"abc"), (2, 3, b"abd"), (2, 3, b"xyz"), (3, 1, b"a")], "crc long, size long, content binary")
    assert {r.crc: r.identical for r in siblings.identity_checks(files).collect()} == {1: True, 2: False}


def test_role_normalisation(spark):
    from plangrove.operators import roles

    siblings.derivation("masters")(lambda c: roles.derived_master(c, ("master", "bed")))
    c = spark.range(1).select(F.create_map(F.lit("x"), F.lit(1).cast("long"), F.lit("bed"), F.lit(2).cast("long"), F.lit("y"), F.lit(1).cast("long")).alias("c"))
    got = c.select(siblings.normalised_roles(F.col("c"), {"x": "y", "y": "bed"}, "masters").alias("r")).first().r
    assert [(e.key, e.value) for e in got] == [("bed", 3), ("master", 1)]
    with pytest.raises(ValueError):
        roles.role_id(F.lit("a"), ["a"], {"b": "c"}, "a")
    ids = [spark.range(1).select(roles.role_id(F.lit(r), ["pantry", "other"], {"store": "pantry"}, "other").alias("i")).first().i for r in (" pantry ", "store", "none", None)]
    assert ids == [0, 0, 1, 1]
    assert spark.range(1).select(roles.external_class(F.lit(" Living Room"), {"livingroom": "A"}, "Z").alias("a"), roles.plain_name(F.lit("space_hall"), {"space_": "S_"}).alias("b"), roles.canonical(F.lit("  "), {}).alias("c")).first() == ("A", "S_hall", "(none)")


def test_recipes_and_folders(spark, tmp_path):
    assert manifest.load_recipe("v0")["test_from"] == ["benchmark"] and manifest.load_recipe("v0", {"x": 1}) == {"x": 1}
    (tmp_path / "v7.json").write_text('{"include": []}')
    assert manifest.load_recipe("v7", folder=str(tmp_path)) == {"include": []}
    for path in ("line/v1", "v1", "v2", "line/v3"):
        (tmp_path / path).mkdir(parents=True)
    for path in ("line/v1", "v1", "v2"):
        (tmp_path / path / "manifest.json").write_text("{}")
    assert [(v, l) for v, l, _ in manifest.list_releases(str(tmp_path), ["line"])] == [("v1", "line"), ("v2", "")]
    assert manifest.release_path(str(tmp_path), ["line"], "v3").endswith("line/v3") and manifest.release_path(str(tmp_path), ["line"], "v2").endswith("/v2")
    calls = itertools.count()
    held = manifest.Remembered()
    assert held.get(str(tmp_path), "a", lambda: next(calls)) == held.get(str(tmp_path), "a", lambda: next(calls)) == 0
    (tmp_path / "new").write_text("x")
    assert held.get(str(tmp_path), "a", lambda: next(calls)) == 1 and manifest.weight_fingerprint(str(tmp_path / "new"))["size"] == 1
    assert "spark" in manifest.environment(spark)
    with pytest.raises(ValueError):
        manifest.freeze(spark.range(1), {"include": []})


def test_release_is_replaced_as_a_whole(spark, tmp_path):
    from plangrove.sources import documents

    path = str(tmp_path / "r")
    shape = "unit int, version string, split string"
    documents.write_release(spark.createDataFrame([(1, "v1", "train"), (2, "v1", "val"), (3, "v0", "train")], shape), path)
    documents.write_release(spark.createDataFrame([(1, "v1", "train"), (2, "v1", "train")], shape), path)
    read = lambda v, s: sorted(r.unit for r in documents.read_split(spark, path, v, s).collect())
    assert (read("v1", "train"), read("v1", "val"), read("v0", "train")) == ([1, 2], [], [3])
    # a release may be rewritten from its own rows
    documents.write_release(spark.read.parquet(path).where("version = 'v1' and unit = 1").select("unit", "version", "split"), path)
    assert read("v1", "train") == [1]


def test_entries_and_commands(spark, tmp_path, capsys):
    import zipfile

    from plangrove import api, cli
    from plangrove.sources import archive

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "hello")
    index = spark.createDataFrame([(str(tmp_path / "a.zip"), "x.txt"), (str(tmp_path / "a.zip"), "gone"), ("none.zip", "x"), (None, "x")], "zip string, entry string")
    assert sorted((r.entry, r.content and bytes(r.content)) for r in archive.read_entries(index).collect()) == [("gone", None), ("x", None), ("x", None), ("x.txt", b"hello")]
    cli.main(["doctor"], spark)
    assert "python" in capsys.readouterr().out
    cli.main(["inventory", str(tmp_path)], spark)
    assert "x.txt" in capsys.readouterr().out
    records = spark.createDataFrame([("APT_FP_1_u0", "benchmark", None, 1, 1), ("APT_FP_1_u1", "benchmark", None, 2, 1)], "graph_id string, source string, status string, n_entrances int, n_living int")
    records.write.parquet(str(tmp_path / "records"))
    cli.main(["release", "v1", "--records", str(tmp_path / "records"), "--folder", str(tmp_path / "out")], spark)
    assert "multi_household" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out")).count() == 1
    graphs = spark.createDataFrame([(f"G{k}", "APT", "unit", k % 2 == 0, "s") for k in range(7)], "graph_id string, house string, scope string, hold boolean, sig string")
    assert [r.graph_id for r in api.list_graphs(graphs, q="g", hold=True, n=2, offset=2).collect()] == ["G4", "G6"]
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, sig string")
    assert sorted(r.id for r in api.find_group(members, "a").collect()) == ["a", "b"] and api.get_graph(graphs, "G1").count() == 1


def test_centroid_match_is_greedy_by_distance(spark):
    r = random.Random(1)
    shape = "g long, id int, role string, x double, y double"
    make = lambda: [(1, i, "r", float(r.randint(0, 9)), float(r.randint(0, 9))) for i in range(12)]
    a, b = make(), make()
    want, ua, ub = [], set(), set()
    for d, i, j in sorted((max(abs(p[3] - q[3]), abs(p[4] - q[4])), p[1], q[1]) for p in a for q in b):
        if d <= 3 and i not in ua and j not in ub:
            ua.add(i)
            ub.add(j)
            want.append((i, j))
    got = matching.centroid_match(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), "g", 3.0)
    assert sorted((m.a, m.b) for m in got.collect()) == sorted(want)
