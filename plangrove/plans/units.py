"""Queries over units: acceptance, scope, composition, constraints, repairs, proximity, codec."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify, units
from ..registry import query
from ..tables import EDGES, NODES, edges, nodes, table
from .geometry import BOXES, numbered

PLANS = "plans AS (SELECT g, count(*) AS n_rooms, count(*) FILTER (WHERE is_entrance) AS n_entrances, count(*) FILTER (WHERE role = 'STANDARD') AS living, count(*) FILTER (WHERE role = 'MEDIUM') AS bedroom, count(*) FILTER (WHERE role = 'PROMO') AS balcony, count(*) FILTER (WHERE role = 'LARGE') AS etc, count(*) FILTER (WHERE role = 'ECONOMY') AS wet, sum(area) AS total FROM nodes GROUP BY 1)"


def _plans(spark, sf_dir):
    rooms = nodes(spark, sf_dir)
    return units.program_maps(rooms).join(rooms.groupBy("g").agg(F.sum("area").alias("total")), "g")


@query(f"""WITH {NODES}, {PLANS} SELECT g, CASE WHEN living = 0 OR bedroom = 0 THEN 'missing_essential:' || concat_ws(',', CASE WHEN living = 0 THEN 'STANDARD' END, CASE WHEN bedroom = 0 THEN 'MEDIUM' END)
 WHEN n_rooms < 5 THEN 'too_few_rooms:' || n_rooms WHEN n_rooms > 60 THEN 'too_many_rooms:' || n_rooms WHEN n_entrances = 0 THEN 'integrity_failed' ELSE 'complete' END AS verdict FROM plans""")
def unit_acceptance(spark, sf_dir):
    """Units by the first reason that keeps them out; a reason may carry a payload."""
    p = _plans(spark, sf_dir)
    return p.select("g", units.acceptance(F.col("program"), F.col("n_rooms"), F.col("n_entrances") > 0, ["STANDARD", "MEDIUM"]).alias("verdict"))


@query(f"WITH {NODES}, {PLANS} SELECT CASE WHEN n_entrances <> 1 THEN 'entrances=' || n_entrances WHEN living > 1 THEN 'living=' || living ELSE '' END AS reason, n_entrances = 1 AND living <= 1 AS clean, count(*) AS n FROM plans GROUP BY 1, 2")
def single_household(spark, sf_dir):
    """Plans that hold one household, and why others do not."""
    clean, reason = units.household(F.col("program"), F.col("n_entrances"), "STANDARD")
    return _plans(spark, sf_dir).groupBy(reason.alias("reason"), clean.alias("clean")).agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, {PLANS}, r AS (SELECT g, concat_ws(',', CASE WHEN living = 0 THEN 'no_living' END, CASE WHEN bedroom = 0 THEN 'no_bedroom' END, CASE WHEN balcony > 4 THEN 'many_balconies' END, CASE WHEN etc > 3 THEN 'many_other' END, CASE WHEN n_rooms < 3 THEN 'few_rooms' END, CASE WHEN coalesce(total, 0) <= 0 THEN 'no_area' END) AS reasons FROM plans)
SELECT reasons, CASE WHEN reasons = '' THEN 'use' ELSE 'fix' END AS disposition, count(*) AS n FROM r GROUP BY 1, 2""")
def composition_quality(spark, sf_dir):
    """Every failing check of a plan's composition; none means use."""
    reasons = units.composition_reasons(F.col("program"), F.col("n_rooms"), F.col("total"), "PROMO", "LARGE", "STANDARD", "MEDIUM")
    r = _plans(spark, sf_dir).select(F.array_join(reasons, ",").alias("reasons"))
    return r.groupBy("reasons", F.when(F.col("reasons") == "", "use").otherwise("fix").alias("disposition")).agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, {PLANS} SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'unit' WHEN n_entrances = 1 THEN 'unit' WHEN n_entrances > 1 THEN 'floor' ELSE 'unknown' END AS scope,
 CASE WHEN n_entrances = 0 THEN 'T4' WHEN etc > 0 THEN 'T3' WHEN n_rooms <= 3 THEN 'T1' ELSE 'T2' END AS tier, count(*) AS n FROM plans JOIN orders ON o_orderkey = g GROUP BY 1, 2""")
def scope_and_tier(spark, sf_dir):
    """Unit or floor by human verdict, else by entrances; the tier by verdict, master room and size."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.when(F.col("o_orderpriority").startswith("1"), "unit").alias("human"))
    p = _plans(spark, sf_dir).join(o, "g")
    kind = units.tier(F.col("n_entrances") > 0, F.col("n_rooms"), F.map_keys("program"), "LARGE")
    return p.groupBy(units.scope(F.col("n_entrances"), F.col("human")).alias("scope"), kind.alias("tier")).agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, {EDGES}, c AS (SELECT g, role, count(*) AS k FROM nodes GROUP BY 1, 2), p AS (SELECT g, string_agg(role || ':' || k, ';' ORDER BY role) AS program FROM c GROUP BY 1),
a AS (SELECT g, string_agg(pair, ';' ORDER BY pair) AS adjacency FROM (SELECT DISTINCT g, least(role_a, role_b) || '-' || greatest(role_a, role_b) AS pair FROM edges) GROUP BY 1), x AS (SELECT g, string_agg(DISTINCT role, ';' ORDER BY role) AS ext FROM nodes WHERE has_window GROUP BY 1)
SELECT p.g, program, coalesce(adjacency, '') AS adjacency, coalesce(ext, '') AS exterior_access FROM p LEFT JOIN a ON a.g = p.g LEFT JOIN x ON x.g = p.g""")
def constraint_derivation(spark, sf_dir):
    """A plan's constraints: program, adjacency, outside access."""
    rooms = nodes(spark, sf_dir)
    return units.constraints(rooms, edges(rooms))


#: Rooms as numbered boxes: the first one of plans not divisible by 4 is the entrance, every third has a window.
ROOMS = BOXES + """, rooms AS (SELECT ids.g, CAST(ids.id AS INTEGER) AS n, p_type AS role, x0, y0, x1, y1, ids.id = 1 AND ids.g % 4 <> 0 AS is_entrance, ids.id % 3 = 0 AS has_window FROM ids LEFT JOIN part ON p_partkey = pk),
ways AS (SELECT a.g, a.n AS a, b.n AS b FROM rooms a JOIN rooms b ON a.g = b.g AND b.n = a.n + 1 WHERE (a.n + a.g) % 3 = 0)"""


def box_rooms(spark, sf_dir):
    """The rooms of :data:`ROOMS`, and the edges of every third pair of neighbours."""
    roles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_type").alias("role"))
    n, first = F.col("id"), (F.col("id") == 1) & (F.col("g") % 4 != 0)
    rooms = numbered(spark, sf_dir).join(roles, "pk", "left").select("g", n.cast("int").alias("n"), "role", "box", first.alias("is_entrance"), (n % 3 == 0).alias("has_window"))
    most = rooms.groupBy("g").agg(F.max("n").alias("most"))
    ways = rooms.join(most, "g").where((F.col("n") < F.col("most")) & ((F.col("n") + F.col("g")) % 3 == 0)).select("g", F.col("n").alias("a"), (F.col("n") + 1).alias("b"))
    return rooms, ways


@query()
def egress_repair(spark, sf_dir):
    """The doors that bring rooms to an entrance along shared walls, and the rooms that stay cut off."""
    return units.egress_repair(*box_rooms(spark, sf_dir), 1.0, 2.0)


@query(f"""WITH {ROOMS}, s AS (SELECT g, n, unnest([{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y0}}, {{'x0': x1, 'y0': y0, 'x1': x1, 'y1': y1}}, {{'x0': x0, 'y0': y1, 'x1': x1, 'y1': y1}}, {{'x0': x0, 'y0': y0, 'x1': x0, 'y1': y1}}]) AS s FROM rooms),
o AS (SELECT g, s, min(n) AS n FROM s WHERE s.x0 <> s.x1 OR s.y0 <> s.y1 GROUP BY 1, 2 HAVING count(*) = 1), l AS (SELECT g, n, s, sqrt(pow(s.x1 - s.x0, 2) + pow(s.y1 - s.y0, 2)) AS len FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY g, n ORDER BY len DESC, s.x0, s.y0, s.x1, s.y1) AS rn FROM l)
SELECT r.g, r.n, b.g IS NOT NULL AS ok, (s.x0 + s.x1) / 2 AS x, (s.y0 + s.y1) / 2 AS y, round(greatest(24.0, least(80.0, len * 0.6)), 1) + CASE WHEN b.g IS NULL THEN NULL ELSE 0 END AS width
FROM rooms r LEFT JOIN b ON b.g = r.g AND b.n = r.n AND rn = 1 WHERE r.role IN ('STANDARD', 'MEDIUM') AND NOT r.has_window""")
def window_repair(spark, sf_dir):
    """Windows for habitable rooms that lack one, on their longest outer side; rooms without such a side cannot."""
    return units.window_repair(box_rooms(spark, sf_dir)[0], F.col("role").isin("STANDARD", "MEDIUM"))


@query(f"WITH {NODES} SELECT CASE WHEN role IN ('PROMO', 'ECONOMY', 'SMALL') THEN 'STANDARD' ELSE role END AS role, count(*) AS n FROM nodes GROUP BY 1")
def role_map_resolution(spark, sf_dir):
    """Roles through a chained map."""
    rooms = units.normalise_roles(nodes(spark, sf_dir), {"PROMO": "ECONOMY", "ECONOMY": "SMALL", "SMALL": "STANDARD"})
    return rooms.groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, a AS (SELECT g, role, count(*) AS x FROM nodes WHERE n % 2 = 1 GROUP BY 1, 2), b AS (SELECT g, role, count(*) AS y FROM nodes WHERE n % 2 = 0 GROUP BY 1, 2),
d AS (SELECT coalesce(a.g, b.g) AS g, coalesce(a.role, b.role) AS role, coalesce(y, 0) - coalesce(x, 0) AS d FROM a FULL JOIN b ON a.g = b.g AND a.role = b.role), t AS (SELECT g, CASE WHEN d > 0 THEN '+' || role WHEN d < 0 THEN '-' || role END AS t FROM d)
SELECT g, coalesce(string_agg(t, ' ' ORDER BY t), '') AS diff FROM t GROUP BY 1""")
def role_diff_text(spark, sf_dir):
    """What two variants of a plan disagree on."""
    rooms = nodes(spark, sf_dir)
    return units.role_diff(rooms.where("n % 2 = 1"), rooms.where("n % 2 = 0"))


@query(f"""WITH {BOXES}, pts AS (SELECT g, id AS pid, x1 + 1.5 AS x, (y0 + y1) / 2 AS y FROM ids), d AS (SELECT p.g, pid, b.id, pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2) AS d2 FROM pts p JOIN ids b ON b.g = p.g)
SELECT g, CAST(pid AS INTEGER) AS pid, CAST(id AS INTEGER) AS id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g, pid ORDER BY d2, id) AS rank FROM d WHERE d2 <= 9) WHERE rank <= 2""")
def door_to_rooms(spark, sf_dir):
    """The two rooms nearest to a door, within a gap."""
    b = numbered(spark, sf_dir)
    pts = b.select("g", F.col("id").alias("pid"), (F.col("box.x1") + 1.5).alias("x"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("y"))
    return units.nearest_rooms(pts, b, 3.0, 2).select("g", "pid", "id", "rank")


@query(f"""WITH RECURSIVE {BOXES}, e AS (SELECT a.g, a.id AS v, b.id AS w FROM ids a JOIN ids b ON a.g = b.g AND a.id <> b.id AND a.x0 - 2 < b.x1 AND b.x0 - 2 < a.x1 AND a.y0 - 2 < b.y1 AND b.y0 - 2 < a.y1),
r(g, n, c) AS (SELECT g, id, id FROM ids UNION SELECT r.g, r.n, e.w FROM r JOIN e ON e.g = r.g AND e.v = r.c), l AS (SELECT g, n, min(c) AS unit FROM r GROUP BY 1, 2)
SELECT g, CAST(unit AS INTEGER) AS unit, count(*) AS size FROM l GROUP BY 1, 2 HAVING count(*) >= 3""")
def proximity_units(spark, sf_dir):
    """Units as groups of rooms near each other."""
    return units.proximity_units(numbered(spark, sf_dir), 2.0, 3)


@query("""WITH d AS (SELECT text, doc_id FROM documents) SELECT doc_id, regexp_matches(text, '[0-9]+ ?(m|mm|cm)') AND regexp_matches(text, '(must|shall|soll|debe|doit)') AS is_provision, concat_ws(',', CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN contains(text, 'der') THEN 'der' END, CASE WHEN contains(text, 'los') THEN 'los' END) AS tags,
 array_to_string(list_slice(regexp_extract_all(text, '[0-9]+'), 1, 8), ' ') AS numbers, left(text, 50) AS head FROM d""")
def provision_parse(spark, sf_dir):
    """Texts that state a duty with a unit, their tags, first numbers and head."""
    t = F.col("text")
    tags = classify.collected(*((F.contains(t, F.lit(k)), k) for k in ("the", "der", "los")))
    return table(spark, sf_dir, "documents").select("doc_id", (t.rlike("[0-9]+ ?(m|mm|cm)") & t.rlike("(must|shall|soll|debe|doit)")).alias("is_provision"), F.array_join(tags, ",").alias("tags"), F.array_join(F.slice(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), 1, 8), " ").alias("numbers"), F.left(t, F.lit(50)).alias("head"))


@query(f"""WITH {BOXES} SELECT g, CAST(sum(CASE WHEN x1 > 127 OR y1 > 127 THEN 1 ELSE 0 END) AS BIGINT) AS clamped, count(*) AS rooms, CAST(sum(least(127, round_even(x0, 0)) + least(127, round_even(y0, 0)) + least(127, round_even(x1, 0)) + least(127, round_even(y1, 0))) AS DOUBLE) AS corners FROM ids GROUP BY 1""")
def token_round_trip(spark, sf_dir):
    """Plans encoded to tokens and decoded: what comes back is the quantised boxes."""
    b = numbered(spark, sf_dir).withColumn("role_id", F.col("pk") % 6)
    clamped = b.groupBy("g").agg(F.sum(((F.col("box.x1") > 127) | (F.col("box.y1") > 127)).cast("long")).alias("clamped"))
    back = units.decode_tokens(units.encode_tokens(b))
    total = back.groupBy("g").agg(F.count("*").alias("rooms"), F.sum(F.col("box.x0") + F.col("box.y0") + F.col("box.x1") + F.col("box.y1")).alias("corners"))
    return clamped.join(total, "g")


@query()
def variant_clusters(spark, sf_dir):
    """Greedy variants of plans with equal room counts on a sheet of 64 plans, by their sorted areas within a tolerance."""
    plans = nodes(spark, sf_dir).groupBy("g").agg(F.array_sort(F.collect_list(F.col("area").cast("long"))).alias("cells"))
    grouped = plans.select(F.xxhash64(F.size("cells"), F.floor(F.col("g") / 64)).alias("grp"), F.col("g").alias("id"), "cells")
    return units.variants(grouped, 4)


@query(f"""WITH {NODES}, {EDGES}, {PLANS}, d AS (SELECT g, count(*) AS n_edges, count(*) FILTER (WHERE via = 'door') AS doors FROM edges GROUP BY 1), j AS (SELECT n_entrances > 0 AND living > 0 AS drawable, bedroom > 0 AND coalesce(doors, 0) > 0 AS legal FROM plans LEFT JOIN d ON d.g = plans.g)
SELECT count(*) AS n, count(*) FILTER (WHERE drawable) AS drawable, count(*) FILTER (WHERE legal) AS legal, count(*) FILTER (WHERE drawable AND legal) AS joint FROM j""")
def joint_acceptance(spark, sf_dir):
    """Plans that are drawable, legal, and both."""
    rooms = nodes(spark, sf_dir)
    doors = edges(rooms).groupBy("g").agg(F.count_if(F.col("via") == "door").alias("doors"))
    p = units.program_maps(rooms).join(doors, "g", "left")
    count = lambda r: units.count_of(F.col("program"), r) > 0
    j = p.select(((F.col("n_entrances") > 0) & count("STANDARD")).alias("d"), (count("MEDIUM") & (F.coalesce("doors", F.lit(0)) > 0)).alias("l"))
    return j.agg(F.count("*").alias("n"), F.count_if("d").alias("drawable"), F.count_if("l").alias("legal"), F.count_if(F.col("d") & F.col("l")).alias("joint"))


@query("""WITH a AS (SELECT doc_id % 400 AS k, doc_id AS v, 0 AS part FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id % 400 AS k, doc_id AS v, 1 AS part FROM documents WHERE doc_id % 3 <> 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT k, v, part FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, v) AS rn FROM u) WHERE rn = 1""")
def first_wins_union(spark, sf_dir):
    """Two label indexes as one: the first part wins, inside a part the smaller entry."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("k"), F.col("doc_id").alias("v"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("part"))
    return d.groupBy("k").agg(F.min(F.struct("part", "v")).alias("m")).select("k", "m.v", "m.part")


@query("""WITH f AS (SELECT md5(text) AS fp, list(DISTINCT source) AS s, count(*) AS n FROM documents GROUP BY 1) SELECT CASE WHEN len(s) > 1 THEN 'many' ELSE 'one' END AS kind, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(max(n) AS BIGINT) AS largest FROM f GROUP BY 1""")
def fingerprint_link(spark, sf_dir):
    """Entries linked by equal content across sources; the digest groups, a count of distinct sources needs no list."""
    f = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("fp")).agg(F.countDistinct("source").alias("s"), F.count("*").alias("n"))
    return f.groupBy(F.when(F.col("s") > 1, "many").otherwise("one").alias("kind")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"))


@query("""WITH m AS (SELECT CASE WHEN doc_id % 2 = 0 THEN n_chars END AS area, CASE WHEN doc_id % 5 <> 0 THEN 2.5 END AS scale, doc_id FROM documents) SELECT count(*) AS n, count(area * scale * scale / 1e6) AS measured, round(sqrt(30.0 * 1e6 / sum(area)), 9) AS assumed FROM m""")
def scale_estimate(spark, sf_dir):
    """Measured areas with known scale, and the scale that a reference area would give."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("area"), F.when(F.col("doc_id") % 5 != 0, F.lit(2.5)).alias("scale"))
    return d.agg(F.count("*").alias("n"), F.count(S.area_m2(F.col("area"), F.col("scale"))).alias("measured"), F.round(S.assumed_scale(F.lit(30.0), F.sum("area")), 9).alias("assumed"))
