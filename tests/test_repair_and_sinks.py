"""Repairs, edits and sinks on small frames."""

from pyspark.sql import functions as F

from plangrove.operators import graph, repair, units
from plangrove.sources import documents, sinks

from .test_operators import random_plan, ring


def test_clean_ring(spark):
    r = ring((0, 0), (2, 0), (4, 0), (4, 0), (4, 3), (0, 3), (0, 1))
    got = spark.range(1).select(repair.clean_ring(r).alias("r")).first().r
    assert [(p.x, p.y) for p in got] == [(0, 0), (4, 0), (4, 3), (0, 3)]


def test_snap_axis(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 4.0), (1, 2, 5.4, 0.0, 9.0, 4.2), (2, 1, 5.4, 0.0, 9.0, 4.2)], "g int, id int, x0 double, y0 double, x1 double, y1 double").select("g", "id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    got = {(r.g, r.id): tuple(round(v, 6) for v in r.box) for r in repair.snap_axis(boxes, 0.5).collect()}
    assert got == {(1, 1): (0, 0, 5.2, 4.1), (1, 2): (5.2, 0, 9, 4.1), (2, 1): (5.4, 0, 9, 4.2)}


def test_edits(spark):
    _, _, nd, ed = random_plan(spark, 4)
    merges = spark.createDataFrame([(0, 2, 1)], "g long, n int, into int")
    rooms, links = repair.merge_rooms(nd, ed, merges)
    assert rooms.count() == nd.count() - 1 and abs(rooms.agg(F.sum("area")).first()[0] - nd.agg(F.sum("area")).first()[0]) < 1e-9
    assert links.where("a = b or (g = 0 and (a = 2 or b = 2))").count() == 0
    edges = spark.createDataFrame([(1, 1, 2, "door"), (1, 3, 2, "open")], "g long, a int, b int, via string")
    edits = spark.createDataFrame([(1, 2, 1, None), (1, 2, 3, "door"), (1, 5, 4, "open")], "g long, a int, b int, via string")
    assert sorted(tuple(r) for r in repair.set_edges(edges, edits).collect()) == [(1, 2, 3, "door"), (1, 4, 5, "open")]
    members = spark.createDataFrame([(0, 1), (0, 3)], "g long, n int")
    rooms, links = repair.add_connector(nd, ed, members, "HUB")
    assert rooms.where("role = 'HUB'").count() == 1 and links.count() == ed.count() + 2


def test_roles_and_reports(spark):
    nd = spark.createDataFrame([(1, 1, "P", 20.0), (1, 2, "P", 3.0), (1, 3, "B", 9.0), (1, 4, "B", 9.0)], "g long, n int, role string, area double")
    ed = spark.createDataFrame([(1, 1, 2, "P", "P", "door"), (1, 1, 3, "P", "B", "door"), (1, 1, 4, "P", "B", "door")], "g long, a int, b int, role_a string, role_b string, via string")
    assert {r.n: r.role for r in repair.enhanced_roles(nd, ed, "HUB", "WET", "P").collect()} == {1: "HUB", 2: "P", 3: "B", 4: "B"}
    v = spark.createDataFrame([(1, 2, "L1_daylight")], "g long, n int, rule string")
    plans = spark.createDataFrame([(1, 0.5), (2, None)], "g long, s double")
    got = {r.g: r for r in repair.legal_report(v, plans, F.col("s"), ["L4"], ["L1", "L2"]).collect()}
    assert (got[1].applied, got[1].skipped, got[1].violated) == (["L1", "L2", "L4"], [], ["L1_daylight"])
    assert (got[2].applied, got[2].skipped, got[2].violated) == (["L1", "L2"], ["L4"], [])
    assert {r.kind for r in repair.unified(v, v, v).collect()} == {"integrity", "legal", "architecture"}


def test_repair_loop(spark):
    _, _, nd, ed = random_plan(spark, 8)
    rooms, links, used = repair.repair_until_legal(nd, ed, F.col("role") == "A")
    assert used == 1
    assert graph.components(rooms, links).select("g", "component").distinct().count() == 6
    assert rooms.where("role = 'A' and not has_window").count() == 0
    assert repair.repair_until_legal(rooms, links, F.col("role") == "A")[2] == 0


def test_sinks(spark, tmp_path):
    u = spark.createDataFrame([(1, "complete"), (2, "too_few"), (3, "missing_essential:A+B")], "g long, verdict string")
    counts = {r.reason: r.n for r in sinks.route(u, "verdict", str(tmp_path / "q")).collect()}
    assert counts == {"complete": 1, "too_few": 1, "missing_essential": 1}
    assert spark.read.json(str(tmp_path / "q")).where("queue = 'quarantine'").count() == 2
    raw = spark.createDataFrame([("a", "f1", "use", ""), ("b", "f1", "use", ""), ("c", "f2", "fix", "R4")], "entry string, fingerprint string, disposition string, reason string")
    graphs = spark.createDataFrame([("f1", "g2"), ("f1", "g1")], "fingerprint string, graph_id string")
    m = {r.entry: r for r in sinks.manifest(raw, graphs).collect()}
    assert m["b"].dup_of == "a" and m["b"].disposition == "excl" and m["a"].graph_ids == ["g1", "g2"] and not m["c"].became_graph
    rows = spark.createDataFrame([(1, 5, "SPA"), (1, 5, "STR"), (2, 5, "SPA")], "crc long, file_size long, label string")
    both, combos = sinks.linkage(rows)
    assert both.count() == 1 and {r.combination: r.n for r in combos.collect()} == {"SPA+STR": 1, "SPA": 1}
    assert sinks.rule_catalog(spark, "legal").count() == 6
    tokens = spark.createDataFrame([(k, list(range(k % 7))) for k in range(100)], "g long, tokens array<int>")
    stats = sinks.write_tokens(tokens, "g", str(tmp_path / "t"), 5).collect()
    assert sum(r.written for r in stats) == spark.read.json(str(tmp_path / "t")).count() and sum(r.skipped for r in stats) == 14
    xml = spark.createDataFrame([(1, "<law><article><no>1</no><title>t</title><text>x</text></article></law>"), (2, "broken")], "id long, xml string")
    assert [tuple(r) for r in sinks.law_articles(xml).collect()] == [(1, "1", "t", "x")]


def test_svg_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, "A", 0.0, 0.0, 5.0, 4.0), (1, 2, "B", 5.0, 0.0, 9.0, 4.0)], "g long, id int, role string, x0 double, y0 double, x1 double, y1 double").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    text = sinks.svg_text(boxes).first().svg
    (tmp_path / "p.svg").write_text(text)
    back = documents.svg_regions(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r["class"], len(r.ring), r.ring[2].x) for r in back] == [("A", 4, 5.0), ("B", 4, 9.0)]
    labels = spark.createDataFrame([("a.png", 2, "room", [[0.0, 0.0, 5.0, 4.0]], 10, 8), ("a.png", 1, "door", [[1.0, 1.0]], 10, 8), ("a.png", 3, "other", [[1.0, 1.0]], 10, 8)], "file_name string, ann_id long, class_name string, segmentation array<array<double>>, width int, height int")
    assert sinks.label_lines(labels, ["room", "door"]).first().text == "1 0.100000 0.125000\n0 0.000000 0.000000 0.500000 0.500000"
    assert sinks.triples(boxes.withColumnRenamed("id", "n"), spark.createDataFrame([(1, 1, 2, "door")], "g long, a int, b int, via string")).count() == 3


def test_role_maps():
    assert units.resolved_roles({"a": "b", "b": "c", "x": "x", "p": "q", "q": "p"})["a"] == "c"
    assert units.resolved_roles({}) == {}
