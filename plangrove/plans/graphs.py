"""Queries over plan graphs: programs, adjacency, mining, co-occurrence, novelty, reachability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, graph, windows
from ..functions import scalars as S
from ..registry import query
from ..tables import EDGES, HOUSES, NODES, edges, house_types, nodes, table
from .releases import split_sql

#: Plans are split as units are: training against val and test.
TRAIN = f"({split_sql('g')}) = 'train'"


def _graph(spark, sf_dir):
    rooms = nodes(spark, sf_dir)
    return rooms, edges(rooms)


@query(f"WITH {NODES} SELECT g, role, count(*) AS n_rooms FROM nodes GROUP BY 1, 2")
def program_counts(spark, sf_dir):
    """Rooms of each role in each plan; a role that is missing has no row."""
    return graph.program_counts(nodes(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES} SELECT DISTINCT g, least(role_a, role_b) AS x, greatest(role_a, role_b) AS y FROM edges")
def adjacency_pairs(spark, sf_dir):
    """Distinct unordered role pairs that touch, per plan."""
    return graph.adjacency_pairs(_graph(spark, sf_dir)[1])


@query(f"""WITH {NODES}, {EDGES}, p AS (SELECT DISTINCT g, role FROM nodes), c AS (SELECT g, role, count(*) AS k FROM nodes GROUP BY 1, 2),
present AS (SELECT a.role AS x, b.role AS y, count(*) AS n_both FROM p a JOIN p b ON a.g = b.g AND a.role < b.role GROUP BY 1, 2 UNION ALL SELECT role, role, count(*) FROM c WHERE k >= 2 GROUP BY 1),
adj AS (SELECT x, y, count(*) AS n_adj FROM (SELECT DISTINCT g, least(role_a, role_b) AS x, greatest(role_a, role_b) AS y FROM edges) GROUP BY 1, 2)
SELECT present.x, present.y, n_both, coalesce(n_adj, 0) AS n_adj, coalesce(n_adj, 0) / n_both AS rate,
 CASE WHEN n_both >= 50 AND coalesce(n_adj, 0) / n_both < 0.05 THEN 'forbid' WHEN n_both >= 50 AND coalesce(n_adj, 0) / n_both > 0.90 THEN 'require' ELSE 'none' END AS rule
FROM present LEFT JOIN adj ON present.x = adj.x AND present.y = adj.y""")
def adjacency_mining(spark, sf_dir):
    """How often two roles touch where both occur; rules from a support of 50 (below 0.05 forbid, above 0.90 require)."""
    rooms, links = _graph(spark, sf_dir)
    roles = rooms.groupBy("g", "role").agg(F.count("*").alias("k"))
    # the roles of a plan are a small set (their number is that of the role vocabulary), so pairs are made inside the row
    plans = roles.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("role", "k"))).alias("r"))
    x = plans.select(F.posexplode("r").alias("i", "e"), "r")
    pairs = x.select(F.col("e.role").alias("x"), F.explode(F.concat(F.transform(F.slice("r", F.col("i") + 2, F.size("r")), lambda s: s["role"]), F.when(F.col("e.k") >= 2, F.array("e.role")).otherwise(F.array().cast("array<string>")))).alias("y"))
    both = pairs.groupBy("x", "y").agg(F.count("*").alias("n_both"))
    touching = graph.adjacency_pairs(links).groupBy("x", "y").agg(F.count("*").alias("n_adj"))
    got = both.join(touching, ["x", "y"], "left").withColumn("n_adj", F.coalesce("n_adj", F.lit(0))).withColumn("rate", F.col("n_adj") / F.col("n_both"))
    rule = F.when((F.col("n_both") >= 50) & (F.col("rate") < 0.05), "forbid").when((F.col("n_both") >= 50) & (F.col("rate") > 0.90), "require").otherwise("none")
    return got.withColumn("rule", rule)


COOC = """c AS (SELECT g, role, count(*) AS k FROM nodes GROUP BY 1, 2), chance AS (
  SELECT a.role AS x, b.role AS y, CAST(sum(CASE WHEN a.role = b.role THEN a.k * (a.k - 1) // 2 ELSE a.k * b.k END) AS BIGINT) AS cooc FROM c a JOIN c b ON a.g = b.g AND a.role <= b.role GROUP BY 1, 2),
found AS (SELECT least(role_a, role_b) AS x, greatest(role_a, role_b) AS y, count(*) AS n_edges FROM edges GROUP BY 1, 2)"""


def _cooccurrence(spark, sf_dir):
    rooms, links = _graph(spark, sf_dir)
    plans = rooms.groupBy("g", "role").agg(F.count("*").alias("k")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("role", "k"))).alias("r"))
    x = plans.select(F.posexplode("r").alias("i", "e"), "r").select("e", F.explode(F.slice("r", F.col("i") + 1, F.size("r"))).alias("f"))
    ways = F.when(F.col("e.role") == F.col("f.role"), (F.col("e.k") * (F.col("e.k") - 1) / 2).cast("long")).otherwise(F.col("e.k") * F.col("f.k"))
    chance = x.groupBy(F.col("e.role").alias("x"), F.col("f.role").alias("y")).agg(F.sum(ways).alias("cooc"))
    found = links.groupBy(F.least("role_a", "role_b").alias("x"), F.greatest("role_a", "role_b").alias("y")).agg(F.count("*").alias("n_edges"))
    got = chance.join(found, ["x", "y"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return got.withColumn("p", F.when(F.col("cooc") > 0, F.least(F.lit(1.0), F.col("n_edges") / F.col("cooc"))))


@query(f"WITH {NODES}, {EDGES}, {COOC} SELECT chance.x, chance.y, cooc, coalesce(n_edges, 0) AS n_edges, CASE WHEN cooc > 0 THEN least(1.0, coalesce(n_edges, 0) / cooc) END AS p FROM chance LEFT JOIN found ON chance.x = found.x AND chance.y = found.y")
def cooccurrence_fit(spark, sf_dir):
    """Edge probability of each role pair: edges over possible pairs, at most 1."""
    return _cooccurrence(spark, sf_dir)


@query(f"WITH {NODES}, {EDGES}, {COOC} SELECT chance.x, chance.y, CASE WHEN cooc > 0 THEN least(1.0, coalesce(n_edges, 0) / cooc) END AS p FROM chance LEFT JOIN found ON chance.x = found.x AND chance.y = found.y ORDER BY p DESC, x, y LIMIT 8")
def top_adjacency(spark, sf_dir):
    """The eight likeliest pairs."""
    return _cooccurrence(spark, sf_dir).select("x", "y", "p").orderBy(F.desc("p"), "x", "y").limit(8)


@query(f"WITH {NODES} SELECT role, count(*) AS n, count(*) FILTER (WHERE has_window) AS with_window, count(*) FILTER (WHERE has_window) / count(*) AS p FROM nodes GROUP BY 1")
def window_probability(spark, sf_dir):
    """Share of rooms of each role that have a window."""
    return nodes(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.count_if("has_window").alias("with_window"), (F.count_if("has_window") / F.count("*")).alias("p"))


@query(f"""WITH {NODES}, {EDGES}, h AS (SELECT CASE WHEN {TRAIN} THEN 0 ELSE 1 END AS side, least(role_a, role_b) AS x, greatest(role_a, role_b) AS y, count(*) AS n FROM edges GROUP BY 1, 2, 3),
a AS (SELECT x, y, n / (SELECT greatest(1, sum(n)) FROM h WHERE side = 0) AS p FROM h WHERE side = 0), b AS (SELECT x, y, n / (SELECT greatest(1, sum(n)) FROM h WHERE side = 1) AS p FROM h WHERE side = 1)
SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 9) AS l1 FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y""")
def adjacency_l1(spark, sf_dir):
    """L1 distance of the pair distributions of two populations."""
    links = _graph(spark, sf_dir)[1].select(F.when(S.split_of(F.col("g")) == "train", 0).otherwise(1).alias("side"), F.least("role_a", "role_b").alias("x"), F.greatest("role_a", "role_b").alias("y"))
    h = graph.checkpointed(links.groupBy("side", "x", "y").agg(F.count("*").alias("n")))
    return aggregates.l1_distance(h.where("side = 0").drop("side"), h.where("side = 1").drop("side"), ["x", "y"]).select(F.round("l1", 9).alias("l1"))


SIGNATURES = "sig AS (SELECT g, string_agg(role || ':' || k, ';' ORDER BY role) AS program FROM (SELECT g, role, count(*) AS k FROM nodes GROUP BY 1, 2) GROUP BY 1)"


def signatures(rooms):
    c = rooms.groupBy("g", "role").agg(F.count("*").alias("k"))
    return c.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "k"))), lambda e: F.concat_ws(":", e["role"], e["k"].cast("string"))), ";").alias("program"))


@query(f"""WITH {NODES}, {SIGNATURES}, t AS (SELECT DISTINCT program FROM sig WHERE {TRAIN}), e AS (SELECT sig.program, t.program IS NULL AS fresh FROM sig LEFT JOIN t ON t.program = sig.program WHERE NOT {TRAIN})
SELECT count(*) AS n, count(DISTINCT program) AS n_distinct, count(DISTINCT program) / count(*) AS diversity, count(*) FILTER (WHERE fresh) / count(*) AS novelty FROM e""")
def diversity_novelty(spark, sf_dir):
    """Distinct signatures over all, and the share that training does not hold."""
    s = graph.checkpointed(signatures(nodes(spark, sf_dir)).withColumn("train", S.split_of(F.col("g")) == "train"))
    seen = s.where("train").select("program").distinct().withColumn("seen", F.lit(True))
    e = s.where("not train").join(seen, "program", "left")
    return e.agg(F.count("*").alias("n"), F.countDistinct("program").alias("n_distinct"), (F.countDistinct("program") / F.count("*")).alias("diversity"), (F.count_if(F.col("seen").isNull()) / F.count("*")).alias("novelty"))


@query(f"WITH {NODES}, {SIGNATURES}, t AS (SELECT DISTINCT program FROM sig WHERE {TRAIN}) SELECT CASE WHEN program IN (SELECT program FROM t) THEN 'seen' ELSE 'unseen' END AS part, count(*) AS n FROM sig WHERE NOT {TRAIN} GROUP BY 1")
def seen_unseen_split(spark, sf_dir):
    """Test plans by whether training holds their program."""
    s = graph.checkpointed(signatures(nodes(spark, sf_dir)).withColumn("train", S.split_of(F.col("g")) == "train"))
    seen = s.where("train").select("program").distinct().withColumn("seen", F.lit(True))
    return s.where("not train").join(seen, "program", "left").groupBy(F.when(F.col("seen"), "seen").otherwise("unseen").alias("part")).agg(F.count("*").alias("n"))


@query(f"WITH {NODES}, {EDGES}, d AS (SELECT g, v AS n, count(*) AS degree FROM (SELECT g, a AS v FROM edges UNION ALL SELECT g, b FROM edges) GROUP BY 1, 2) SELECT nodes.g, CAST(nodes.n AS INTEGER) AS n, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d ON d.g = nodes.g AND d.n = nodes.n")
def node_degree(spark, sf_dir):
    """Degree of every room, 0 included."""
    return graph.degrees(*_graph(spark, sf_dir))


REACH = "bi AS (SELECT g, a AS v, b AS w FROM edges UNION ALL SELECT g, b, a FROM edges), reach(g, n, r) AS (SELECT g, n, n FROM nodes UNION SELECT reach.g, reach.n, bi.w FROM reach JOIN bi ON bi.g = reach.g AND bi.v = reach.r)"


@query(f"WITH RECURSIVE {NODES}, {EDGES}, {REACH} SELECT g, CAST(n AS INTEGER) AS n, CAST(min(r) AS INTEGER) AS component FROM reach GROUP BY g, n")
def components(spark, sf_dir):
    """The least room of each component."""
    return graph.components(*_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {NODES}, {EDGES}, {REACH}, e AS (SELECT g, n FROM nodes WHERE is_entrance) SELECT reach.g, count(DISTINCT reach.n) AS n_rooms, count(DISTINCT reach.n) FILTER (WHERE e.n IS NOT NULL) AS reached FROM reach LEFT JOIN e ON e.g = reach.g AND e.n = reach.r GROUP BY 1")
def entrance_reachability(spark, sf_dir):
    """Rooms of each plan and those that some entrance reaches."""
    rooms, links = _graph(spark, sf_dir)
    hops = graph.hop_distance(rooms, links, F.col("is_entrance"))
    return hops.groupBy("g").agg(F.count("*").alias("n_rooms"), F.count("hops").alias("reached"))


@query(f"""WITH RECURSIVE {NODES}, {EDGES}, bi AS (SELECT g, a AS v, b AS w FROM edges UNION ALL SELECT g, b, a FROM edges),
walk(g, n, hops) AS (SELECT g, n, 0 FROM nodes WHERE is_entrance UNION SELECT walk.g, bi.w, hops + 1 FROM walk JOIN bi ON bi.g = walk.g AND bi.v = walk.n WHERE hops < 20)
SELECT nodes.g, CAST(nodes.n AS INTEGER) AS n, CAST(min(hops) AS INTEGER) AS hops FROM nodes LEFT JOIN walk ON walk.g = nodes.g AND walk.n = nodes.n GROUP BY 1, 2""")
def hop_distance(spark, sf_dir):
    """Fewest edges from an entrance; null where none reaches."""
    rooms, links = _graph(spark, sf_dir)
    return graph.hop_distance(rooms, links, F.col("is_entrance"))


@query(f"WITH {NODES}, {EDGES} SELECT least(role_a, role_b) AS x, greatest(role_a, role_b) AS y, count(*) AS n FROM edges WHERE role_a <> role_b GROUP BY 1, 2 ORDER BY n DESC, x, y LIMIT 10")
def confusion_pairs(spark, sf_dir):
    """The ten most frequent unordered pairs of different roles."""
    e = _graph(spark, sf_dir)[1].where("role_a <> role_b")
    return e.groupBy(F.least("role_a", "role_b").alias("x"), F.greatest("role_a", "role_b").alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x", "y").limit(10)


@query(f"""WITH {NODES}, r AS (SELECT role, coalesce(area, 0) / CASE WHEN max(coalesce(area, 0)) OVER (PARTITION BY g) > 0 THEN max(coalesce(area, 0)) OVER (PARTITION BY g) ELSE 1 END AS share FROM nodes)
SELECT role, median(share) AS prior, count(*) AS n FROM r GROUP BY 1""")
def area_priors(spark, sf_dir):
    """Median of a role's area over its plan's largest."""
    area = F.coalesce("area", F.lit(0.0))
    top = F.max(area).over(Window.partitionBy("g"))
    r = nodes(spark, sf_dir).select("role", (area / F.when(top > 0, top).otherwise(F.lit(1.0))).alias("share"))
    # values are counted first, so that no group's values are collected
    counted = r.groupBy("role", "share").agg(F.count("*").alias("c"))
    up = Window.partitionBy("role").orderBy("share").rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumns({"upto": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy("role"))})
    at = lambda pos: F.min(F.when(F.col("upto") > F.floor(pos), F.col("share")))
    n = F.col("n")
    return run.groupBy("role", "n").agg(((at((n - 1) / 2) + at(n / 2)) / 2).alias("prior")).select("role", "prior", "n")


@query(f"""WITH {NODES}, {HOUSES}, s AS (SELECT g, count(*) AS rooms, max(CASE WHEN role = 'PROMO' THEN 1 ELSE 0 END) AS balcony FROM nodes GROUP BY 1)
SELECT 'house' AS section, house AS key, CAST(count(*) AS DOUBLE) AS value FROM houses JOIN s ON s.g = houses.g GROUP BY 2 UNION ALL SELECT 'room', role, CAST(count(*) AS DOUBLE) FROM nodes GROUP BY 2
UNION ALL SELECT 'rooms', 'min', CAST(min(rooms) AS DOUBLE) FROM s UNION ALL SELECT 'rooms', 'max', CAST(max(rooms) AS DOUBLE) FROM s UNION ALL SELECT 'rooms', 'upper_median', CAST(quantile_disc(rooms, 1.0) AS DOUBLE) * 0 + list_sort(list(rooms))[len(list(rooms)) // 2 + 1] FROM s
UNION ALL SELECT 'balcony', 'share', sum(balcony) / count(*) FROM s""")
def dataset_card(spark, sf_dir):
    """A release's card in long form: histograms, least, middle and most rooms, share with a balcony."""
    rooms = nodes(spark, sf_dir)
    s = graph.checkpointed(rooms.groupBy("g").agg(F.count("*").alias("rooms"), F.max((F.col("role") == "PROMO").cast("int")).alias("balcony")))
    row = lambda section, key, value: (F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    house = s.join(house_types(spark, sf_dir), "g").groupBy("house").count().select(*row("house", F.col("house"), F.col("count")))
    role = rooms.groupBy("role").count().select(*row("room", F.col("role"), F.col("count")))
    up = Window.orderBy("rooms").rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct size
    sizes = s.groupBy("rooms").agg(F.count("*").alias("c")).withColumns({"upto": F.sum("c").over(up)})
    total = s.agg(F.count("*").alias("total"), F.sum("balcony").alias("b"), F.min("rooms").alias("lo"), F.max("rooms").alias("hi"))
    middle = sizes.join(F.broadcast(total), F.lit(True)).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("rooms").alias("m"))
    parts = [
        total.select(*row("rooms", F.lit("min"), F.col("lo"))),
        total.select(*row("rooms", F.lit("max"), F.col("hi"))),
        middle.select(*row("rooms", F.lit("upper_median"), F.col("m"))),
        total.select(*row("balcony", F.lit("share"), F.col("b") / F.col("total"))),
    ]
    out = house.unionByName(role)
    for p in parts:
        out = out.unionByName(p)
    return out


@query(f"""WITH n2 AS (SELECT l_orderkey AS g, l_extendedprice AS v, l_partkey AS x, l_suppkey AS s, l_linenumber AS k FROM lineitem), big AS (SELECT g FROM n2 GROUP BY 1 HAVING count(*) >= 3),
p AS (SELECT n2.g, v, x, lead(v) OVER w AS v2, lead(x) OVER w AS x2 FROM n2 JOIN big ON big.g = n2.g WINDOW w AS (PARTITION BY n2.g ORDER BY x, v, s, k))
SELECT g, count(*) AS n_pairs, max((v + v2) / (2 * (x2 - x))) AS most FROM p WHERE x2 - x > 10 GROUP BY 1""")
def adjacent_pair_scale(spark, sf_dir):
    """Scale samples from neighbours on an axis: rows of three or more, gaps above 10, (v1 + v2) / (2 dx)."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_extendedprice").alias("v"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("k"))
    order = ["x", "v", "s", "k"]
    seen = li.withColumn("size", F.count("*").over(Window.partitionBy("g"))).where("size >= 3")
    p = windows.neighbours(windows.neighbours(seen, ["g"], order, "v", "v2"), ["g"], order, "x", "x2").where("x2 - x > 10")
    return p.groupBy("g").agg(F.count("*").alias("n_pairs"), F.max((F.col("v") + F.col("v2")) / (2 * (F.col("x2") - F.col("x")))).alias("most"))


@query("""WITH s AS (SELECT p_partkey AS pk, CASE WHEN p_size % 3 = 0 THEN p_size / 10.0 END AS scale FROM part)
SELECT l_orderkey AS g, count(*) AS rooms, count(scale) AS scaled, round(sum(l_quantity * scale * scale / 1e6), 9) AS area_m2 FROM lineitem LEFT JOIN s ON pk = l_partkey GROUP BY 1""")
def scale_enrichment(spark, sf_dir):
    """Areas by a looked-up scale; rooms without one stay, unscaled."""
    scale = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") / F.lit(10.0)).alias("scale"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(scale, "l_partkey", "left")
    return li.groupBy(F.col("l_orderkey").alias("g")).agg(F.count("*").alias("rooms"), F.count("scale").alias("scaled"), F.round(F.sum(S.area_m2(F.col("l_quantity"), F.col("scale"))), 9).alias("area_m2"))
