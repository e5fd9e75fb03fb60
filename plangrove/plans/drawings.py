"""Queries over drawings: elements, links, units, records, metrics, copies in other frames.

Rooms are the numbered boxes of :func:`units.box_rooms`; a drawing's doors are small boxes on their right sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import drawings, graph, siblings, topology
from ..registry import query
from ..tables import EDGES, HOUSES, NODES, edges, house_types, nodes, table
from .geometry import BOXES, numbered
from .graphs import REACH
from .rules import INTEGRITY, _integrity
from .units import ROOMS


def _elements(spark, sf_dir):
    """The rooms of plans as elements, a door on the right side of rooms whose number is not divisible by 3, a wall left of every fourth."""
    b, box = numbered(spark, sf_dir), F.col("box")
    ring = lambda x0, y0, x1, y1: G.box_ring(x0, y0, x1, y1)
    roles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_type").alias("name"))
    rooms = b.join(roles, "pk", "left").select("g", F.lit("room").alias("kind"), F.col("id").alias("i"), "name", ring(box["x0"], box["y0"], box["x1"], box["y1"]).alias("ring"))
    middle = (box["y0"] + box["y1"]) / 2
    doors = b.where("id % 3 <> 0").select("g", F.lit("door").alias("kind"), F.col("id").alias("i"), F.lit("").alias("name"), ring(box["x1"] - 0.5, middle - 2, box["x1"] + 0.5, middle + 2).alias("ring"))
    walls = b.where("id % 4 = 0").select("g", F.lit("wall").alias("kind"), F.col("id").alias("i"), F.lit("").alias("name"), ring(box["x0"] - 1, box["y0"], box["x0"], box["y1"]).alias("ring"))
    return rooms.unionByName(doors).unionByName(walls)


@query()
def drawing_links(spark, sf_dir):
    """Edges from doors by probes and nearest rooms, and open passages."""
    return topology.drawing_links(_elements(spark, sf_dir), forbidden=[("MEDIUM", "MEDIUM")])


@query()
def drawing_walls(spark, sf_dir):
    """Walls derived from rooms, by kind."""
    return topology.drawing_walls(_elements(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("length"), 1).alias("length"))


@query()
def drawable_reasons(spark, sf_dir):
    """Plans by the requirements that they miss."""
    d = topology.drawable(topology.metrics(_elements(spark, sf_dir).where("kind = 'room'")))
    return d.groupBy(F.array_join("failed", ",").alias("failed"), "drawable").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, p AS (SELECT g, count(*) FILTER (WHERE n % 2 = 1) AS doors, count(*) FILTER (WHERE n % 2 = 1 AND area > 5) AS dw, count(*) FILTER (WHERE n % 2 = 1 AND has_window) AS ds, count(*) FILTER (WHERE n % 2 = 0) AS wins, count(*) FILTER (WHERE n % 2 = 0 AND area > 2) AS ww FROM nodes GROUP BY 1)
SELECT doors > 0 AND dw = doors AND ds = doors AS full_door, ww = wins AS full_win, g % 3 <> 0 AS has_scale, doors > 0 AND dw = doors AND ds = doors AND ww = wins AND g % 3 <> 0 AS realizable, count(*) AS n FROM p GROUP BY 1, 2, 3, 4""")
def realizable_plans(spark, sf_dir):
    """What plans lack to be drawn: door and window widths, swings, a scale."""
    part = F.struct(F.when(F.col("area") > F.when(F.col("n") % 2 == 1, 5).otherwise(2), F.col("area")).alias("width_px"), F.when(F.col("has_window"), 90.0).alias("swing"), F.when(F.col("has_window"), 1.0).alias("hinge"))
    own = nodes(spark, sf_dir).groupBy("g").agg(F.collect_list(F.when(F.col("n") % 2 == 1, part)).alias("doors"), F.collect_list(F.when(F.col("n") % 2 == 0, part)).alias("windows"))
    r = topology.realizability(own.withColumn("scale", F.when(F.col("g") % 3 != 0, 0.6)))
    return r.groupBy("full_door", "full_win", "has_scale", "realizable").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {NODES}, {EDGES}, {REACH}, comp AS (SELECT g, n, min(r) AS c FROM reach GROUP BY 1, 2), p AS (SELECT comp.g, c, count(*) AS size, bool_or(is_entrance) AS e, count(*) FILTER (WHERE role = 'STANDARD') AS l FROM comp JOIN nodes ON nodes.g = comp.g AND nodes.n = comp.n GROUP BY 1, 2)
SELECT g, count(*) FILTER (WHERE e AND size >= 2) AS n_units, count(*) FILTER (WHERE e AND size >= 5 AND size <= 60 AND l > 0) AS n_complete, count(*) FILTER (WHERE NOT e OR size < 2) AS n_noise FROM p GROUP BY 1""")
def unit_summary(spark, sf_dir):
    """Units, complete ones and noise of each plan."""
    rooms = nodes(spark, sf_dir)
    return topology.unit_summary(rooms, edges(rooms), ["STANDARD"])


@query(f"""WITH RECURSIVE {INTEGRITY}, {HOUSES}, v AS (SELECT DISTINCT g FROM integrity), s AS (SELECT g, count(*) AS n_rooms, count(*) FILTER (WHERE role = 'MEDIUM') AS beds FROM nodes GROUP BY 1), d AS (SELECT g, count(*) FILTER (WHERE via = 'door') AS doors FROM (SELECT DISTINCT g, least(a, b) AS a, greatest(a, b) AS b, via FROM edges) GROUP BY 1)
SELECT s.g, house, CAST(n_rooms AS INTEGER) AS n_rooms, CAST(coalesce(doors, 0) AS INTEGER) AS n_doors, CAST(nullif(beds, 0) AS INTEGER) AS beds, v.g IS NULL AS passed FROM s LEFT JOIN d ON d.g = s.g LEFT JOIN v ON v.g = s.g LEFT JOIN houses ON houses.g = s.g""")
def whole_records(spark, sf_dir):
    """Records assembled from rooms, edges, headers and violations, read back by their fields."""
    rooms, links, _, found = _integrity(spark, sf_dir)
    placed = rooms.select("g", "n", "role", "area", "is_entrance", F.lit(1.0).alias("cx"), F.lit(2.0).alias("cy"), F.lit(10.0).alias("width"), F.lit(0.0).alias("height"))
    laid = topology.layout(*topology.graph_of(placed, links))
    none = F.lit(None).cast("string")
    header = house_types(spark, sf_dir).select("g", "house", F.lit(None).cast("double").alias("scale"), none.alias("status"), none.alias("reason"), F.lit("benchmark").alias("role"), F.lit(1).alias("tier"))
    r = topology.record(laid, header, found)
    return r.select("g", "meta.house", "meta.n_rooms", "meta.n_doors", F.try_element_at("program", F.lit("MEDIUM")).alias("beds"), "validation.passed")


@query(f"""WITH {NODES}, {EDGES}, e AS (SELECT DISTINCT g, least(a, b) AS a, greatest(a, b) AS b FROM edges), x AS (SELECT g, count(*) AS k FROM e GROUP BY 1), n AS (SELECT g, count(*) AS rooms, count(*) FILTER (WHERE is_entrance) AS ent FROM nodes GROUP BY 1)
SELECT n.g, rooms, coalesce(k, 0) AS inner_edges, ent AS outer_edges FROM n LEFT JOIN x ON x.g = n.g""")
def record_round_trip(spark, sf_dir):
    """Graphs to records and back: rooms, edges between rooms, and edges to the outside."""
    rooms = nodes(spark, sf_dir)
    placed = rooms.select("g", "n", "role", "area", "is_entrance", F.lit(1.0).alias("cx"), F.lit(2.0).alias("cy"), F.lit(10.0).alias("width"), F.lit(8.0).alias("height"))
    laid = topology.layout(*topology.graph_of(placed, edges(rooms)))
    back, ways = topology.record_graph(laid.select("g", F.struct("nodes", "edges").alias("layout")))
    k = ways.groupBy("g").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("i"), F.count_if(F.col("b").isNull()).alias("o"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return topology.space_nodes(back).groupBy("g").agg(F.count("*").alias("rooms")).join(k, "g", "left").select("g", "rooms", zero("i", "inner_edges"), zero("o", "outer_edges"))


@query(f"""WITH RECURSIVE {NODES}, {EDGES}, {REACH}, comp AS (SELECT g, n, min(r) AS c FROM reach GROUP BY 1, 2), k AS (SELECT g, count(DISTINCT c) AS parts FROM comp GROUP BY 1), o AS (SELECT g, count(*) AS n, list(DISTINCT role) AS roles, bool_or(area <= 3) AS flat, bool_or(role = 'SMALL') AS unknown FROM nodes GROUP BY 1),
w AS (SELECT g, bool_or(via = 'balcony') AS odd FROM edges GROUP BY 1),
r AS (SELECT o.g, concat_ws(',', CASE WHEN flat THEN 'no_area' END, CASE WHEN n < 3 THEN 'few_rooms' END, CASE WHEN NOT list_has_any(roles, ['STANDARD', 'LARGE']) OR NOT list_contains(roles, 'MEDIUM') THEN 'no_essential' END, CASE WHEN parts > 1 THEN 'disconnected' END) AS reasons,
 concat_ws(',', CASE WHEN unknown THEN 'unknown_role' END, CASE WHEN NOT list_contains(roles, 'PROMO') THEN 'no_entrance' END, CASE WHEN odd THEN 'unknown_via' END) AS warnings FROM o JOIN k ON k.g = o.g LEFT JOIN w ON w.g = o.g)
SELECT reasons = '' AS passed, reasons, warnings, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def graph_checks(spark, sf_dir):
    """Geometry graphs by hard reasons and warnings."""
    rooms = nodes(spark, sf_dir)
    flat = rooms.withColumn("area", F.when(F.col("area") > 3, F.col("area")).otherwise(0.0))
    c = topology.graph_check(flat, edges(rooms), [["STANDARD", "LARGE"], ["MEDIUM"]], other="SMALL", entrance="PROMO")
    text = lambda x: F.array_join(x, ",").alias(x)
    return c.select("passed", text("reasons"), text("warnings")).groupBy("passed", "reasons", "warnings").agg(F.count("*").alias("n"))


@query(f"""WITH {ROOMS}, e AS (SELECT g, greatest(x1 - x0, y1 - y0) AS e FROM rooms WHERE n % 2 = 0) SELECT g, round(900.0 / median(e), 4) AS mm_per_px FROM e WHERE e > 1 GROUP BY 1""")
def door_scales(spark, sf_dir):
    """Scales from the middle extent of a plan's doors (the even boxes)."""
    b = numbered(spark, sf_dir).where("id % 2 = 0")
    box = F.col("box")
    return drawings.door_scale(b.select("g", G.box_ring(box["x0"], box["y0"], box["x1"], box["y1"]).alias("ring")))


@query(f"""WITH {ROOMS}, t AS (SELECT g, CASE WHEN n % 3 > 0 THEN (n % 5 + 0.5) * (n % 4) END AS real, (x1 - x0) * (y1 - y0) AS px FROM rooms) SELECT g, sqrt(sum(real) / sum(px)) AS m_per_px FROM t WHERE real > 0 AND px > 0 GROUP BY 1""")
def text_scales(spark, sf_dir):
    """Scales from printed dimensions."""
    d = F.when(F.col("id") % 3 > 0, F.concat((F.col("id") % 5).cast("string"), F.lit(",5 x "), (F.col("id") % 4).cast("string"), F.lit(" m"))).otherwise("hall")
    return drawings.text_scale(numbered(spark, sf_dir).select("g", "box", d.alias("dimension")))


@query(f"""WITH {ROOMS}, a AS (SELECT g, n, x0, y0, x1, y1, CASE WHEN n % 2 = 0 THEN 0 ELSE 90 END AS ang, CASE WHEN g % 2 = 0 THEN 100.0 END AS s FROM rooms), w AS (SELECT CASE WHEN ang = 0 THEN x1 - x0 ELSE y1 - y0 END AS px, s FROM a)
SELECT count(*) AS n, count(*) FILTER (WHERE s IS NULL OR px * s / 1000.0 BETWEEN 0.6 AND 2.0) AS measured, CAST(sum(CASE WHEN s IS NULL OR px * s / 1000.0 BETWEEN 0.6 AND 2.0 THEN px END) AS DOUBLE) AS total FROM w""")
def opening_widths(spark, sf_dir):
    """Openings measured along their wall, within bounds in metres."""
    b = F.col("box")
    w = drawings.opening_width(b["x0"], b["y0"], b["x1"], b["y1"], F.when(F.col("id") % 2 == 0, 0.0).otherwise(90.0), F.when(F.col("g") % 2 == 0, 100.0), 0.6, 2.0)
    return numbered(spark, sf_dir).select(w.alias("w")).agg(F.count("*").alias("n"), F.count("w").alias("measured"), F.sum("w").alias("total"))


@query(f"""WITH {BOXES}, c AS (SELECT g, id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ids) SELECT count(*) AS n, CAST(sum(CASE WHEN g % 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS placed, round(sum(CASE WHEN g % 4 > 0 THEN round(cx / 100.0, 4) + round(cy / (g % 4 * 50.0), 4) END), 4) AS total FROM c""")
def normalised_centres(spark, sf_dir):
    """Centres as shares of a drawing's size; none without a size."""
    b = F.col("box")
    c = drawings.normalised_centre((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, F.lit(100.0), F.col("g") % 4 * 50.0)
    d = numbered(spark, sf_dir).select(c.alias("c"))
    return d.agg(F.count("*").alias("n"), F.count("c").alias("placed"), F.round(F.sum(F.col("c.x") + F.col("c.y")), 4).alias("total"))


@query("""WITH p AS (SELECT l_orderkey AS g, l_partkey % 100 AS x, l_suppkey % 100 AS y, l_linenumber % 3 AS r FROM lineitem), o AS (SELECT g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1),
f AS (SELECT p.g, r, (x - x0) // 2 AS ax, (x1 - x) // 2 AS bx, (y - y0) // 2 AS ay, (y1 - y) // 2 AS by_ FROM (SELECT g, r, x * 2 AS x, y * 2 AS y FROM p) p JOIN (SELECT g, x0 * 2 AS x0, x1 * 2 AS x1, y0 * 2 AS y0, y1 * 2 AS y1 FROM o) o ON o.g = p.g),
t AS (SELECT g, unnest([list_sort(list(lpad(ax::VARCHAR, 3, '0') || ',' || lpad(ay::VARCHAR, 3, '0') || r)), list_sort(list(lpad(bx::VARCHAR, 3, '0') || ',' || lpad(ay::VARCHAR, 3, '0') || r)), list_sort(list(lpad(ax::VARCHAR, 3, '0') || ',' || lpad(by_::VARCHAR, 3, '0') || r)), list_sort(list(lpad(bx::VARCHAR, 3, '0') || ',' || lpad(by_::VARCHAR, 3, '0') || r))]) AS form FROM f GROUP BY 1), s AS (SELECT g, min(form) AS sig FROM t GROUP BY 1)
SELECT min(g) AS first_plan, count(*) AS n FROM s GROUP BY sig HAVING count(*) > 1""")
def centroid_signatures(spark, sf_dir):
    """Groups of plans with equal centres and roles up to shift and mirroring."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 100).cast("double").alias("cx"), (F.col("l_suppkey") % 100).cast("double").alias("cy"), (F.col("l_linenumber") % 3).cast("string").alias("role"))
    return siblings.centroid_signature(p, 1.0).groupBy("sig").agg(F.min("g").alias("first_plan"), F.count("*").alias("n")).where("n > 1").drop("sig")


@query(f"""WITH {BOXES}, o AS (SELECT g, min(x0) AS ax, max(x1) AS bx, min(y0) AS ay, max(y1) AS by_ FROM ids GROUP BY 1) SELECT count(*) AS n, CAST(count(*) FILTER (WHERE true) AS BIGINT) AS same_size, CAST(0 AS BIGINT) AS outside FROM ids JOIN o ON o.g = ids.g""")
def moved_boxes(spark, sf_dir):
    """Boxes moved to a mirrored copy of their drawing keep their size and stay inside its outline."""
    b = numbered(spark, sf_dir)
    out = b.groupBy("g").agg(F.min("box.x0").alias("ax"), F.max("box.x1").alias("bx"), F.min("box.y0").alias("ay"), F.max("box.y1").alias("by"))
    frame = lambda fx, fy, ox, oy: F.struct(F.lit(fx).alias("fx"), F.lit(fy).alias("fy"), ox.alias("ox"), oy.alias("oy"))
    d = b.join(out, "g").withColumn("m", siblings.moved_box(F.col("box"), frame(1, 1, F.col("ax"), F.col("ay")), frame(-1, 1, F.col("bx") + 1000, F.col("ay"))))
    size = lambda c: (F.col(f"{c}.x1") - F.col(f"{c}.x0")) * (F.col(f"{c}.y1") - F.col(f"{c}.y0"))
    outside = (F.col("m.x0") < F.col("ax") + 1000 - 1e-9) | (F.col("m.x1") > F.col("bx") + 1000 + 1e-9)
    return d.agg(F.count("*").alias("n"), F.count_if(F.abs(size("m") - size("box")) < 1e-6).alias("same_size"), F.count_if(outside).alias("outside"))


@query("""SELECT CASE WHEN doc_id = 4 THEN 'skip' WHEN doc_id % 11 = 0 THEN 'skip' WHEN doc_id % 7 = 0 OR doc_id % 7 > 4 THEN 'skip' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'skip' WHEN doc_id % 3 = 0 THEN 'overwrite' ELSE 'write' END AS action,
 CASE WHEN doc_id = 4 THEN 'source' WHEN doc_id % 11 = 0 THEN 'pixels_differ' WHEN doc_id % 7 = 0 OR doc_id % 7 > 4 THEN 'misaligned' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'same_correction' ELSE '' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2""")
def propagation_plan(spark, sf_dir):
    """What a unifying propagation does to each member of a group, and why it skips some."""
    i = F.col("doc_id")
    members = table(spark, sf_dir, "documents").select(i.cast("string").alias("id"), (i % 3 == 0).alias("corrected"), (i % 2 == 0).alias("same"), F.when(i % 7 > 0, (i % 7) * 3.5).alias("error"), (i % 11 == 0).alias("bad_pixels"))
    return siblings.propagation(members, "4", "unify").groupBy("action", "reason").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT doc_id // 50 AS sig, doc_id AS id, CASE WHEN doc_id % 13 > 0 THEN md5(text) END AS p FROM documents), n AS (SELECT sig, p, count(*) AS n FROM m WHERE p IS NOT NULL GROUP BY 1, 2), b AS (SELECT sig, p AS best FROM n QUALIFY row_number() OVER (PARTITION BY sig ORDER BY n DESC, p) = 1)
SELECT m.sig, count(*) AS members, count(*) FILTER (WHERE p <> best) AS bad FROM m LEFT JOIN b ON b.sig = m.sig GROUP BY 1""")
def pixel_verdicts(spark, sf_dir):
    """Members whose content differs from most of their group."""
    d = table(spark, sf_dir, "documents")
    members = d.select(F.floor(F.col("doc_id") / 50).alias("sig"), F.col("doc_id").alias("id"))
    hashes = d.where("doc_id % 13 > 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("pixels"))
    return siblings.pixel_verdicts(members, hashes).groupBy("sig").agg(F.count("*").alias("members"), F.count_if("bad").alias("bad"))


_PIX = "h AS (SELECT doc_id AS id, md5(text) AS p, doc_id // 100 AS sig, doc_id % 4 = 0 AS done FROM documents)"


@query(f"WITH {_PIX} SELECT p AS pixels, count(*) AS n, count(DISTINCT sig) AS n_groups FROM h GROUP BY 1 HAVING count(*) > 1")
def same_pixels(spark, sf_dir):
    """Contents that several drawings have, and in how many groups."""
    h, g, _ = _pixels(spark, sf_dir)
    return siblings.same_pixels(h, g)


@query(f"WITH {_PIX} SELECT a.id AS target, min(b.id) AS source FROM h a JOIN h b ON a.p = b.p AND b.done AND b.sig <> a.sig WHERE NOT a.done GROUP BY 1")
def cross_group_pairs(spark, sf_dir):
    """For drawings without a correction, the least corrected one of another group with the same content."""
    return siblings.cross_pairs(*_pixels(spark, sf_dir)).select("target", "source")


def _pixels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(i.alias("id"), F.md5("text").alias("pixels")), d.select(i.alias("id"), F.floor(i / 100).alias("sig")), d.where("doc_id % 4 = 0").select(i.alias("id"))


@query("WITH f AS (SELECT length(text) AS size, doc_id % 2 AS crc, sha256(text) AS h FROM documents), g AS (SELECT crc, size, count(*) AS n, count(DISTINCT h) AS k FROM f GROUP BY 1, 2 HAVING count(*) > 1) SELECT k = 1 AS identical, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_files FROM g GROUP BY 1")
def identity_checks(spark, sf_dir):
    """Files of equal checksum and size by whether their contents are one."""
    f = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("crc"), F.length("text").alias("size"), F.col("text").alias("content"))
    return siblings.identity_checks(f).groupBy("identical").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_files"))


@query(f"WITH {NODES}, s AS (SELECT g, list_sort(list(role || ':' || round(area, 1))) AS s FROM nodes GROUP BY 1) SELECT a.g AS source, b.g AS target, a.s = b.s AS same FROM s a JOIN s b ON b.g = a.g + 1")
def copies_agree(spark, sf_dir):
    """Neighbouring plans compared by roles and areas."""
    rooms = graph.checkpointed(nodes(spark, sf_dir).select("g", "role", "area"))
    g = rooms.select("g").distinct()
    pairs = g.select(F.col("g").alias("source"), (F.col("g") + 1).alias("target")).join(g.withColumnRenamed("g", "target"), "target", "left_semi")
    return siblings.copies_agree(rooms, pairs)


@query("SELECT doc_id, 'lang' AS field, 'en' AS want, lang AS got FROM documents WHERE doc_id % 10 = 0 AND lang IS DISTINCT FROM 'en' UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars + doc_id % 20 AS VARCHAR), CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 10 = 0 AND doc_id % 20 <> 0")
def overrides_checked(spark, sf_dir):
    """Confirmed values that rows do not have."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    want = d.where("doc_id % 10 = 0").select("doc_id", F.lit("en").alias("lang"), (F.col("n_chars") + F.col("doc_id") % 20).alias("n_chars"))
    return siblings.overrides_checked(d, want, "doc_id", ["lang", "n_chars"])
