"""Queries of evaluation, review lists and samples.

An event is an attempt: its user the plan, its number by time the attempt; ``value`` decides what it passes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate
from ..registry import query
from ..tables import EDGES, NODES, edges, nodes, table


def _attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").cast("long").alias("v"))
    return e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)


ATTEMPTS = "att AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)"


@query(f"""WITH {ATTEMPTS}, p AS (SELECT user_id, max(CASE WHEN k = 0 AND v % 3 = 0 THEN 1 ELSE 0 END) AS raw, max(CASE WHEN v % 5 = 0 THEN 1 ELSE 0 END) AS done, coalesce(min(CASE WHEN v % 5 = 0 THEN k END), max(k)) + 1 AS tries FROM att WHERE k < 5 GROUP BY 1)
SELECT count(*) AS n, round(avg(raw), 3) AS compliance_no_loop, round(avg(done), 3) AS compliance_with_loop, round(avg(tries), 2) AS avg_attempts FROM p""")
def loop_evaluation(spark, sf_dir):
    """The compliance loop of five attempts against a single raw one."""
    a = _attempts(spark, sf_dir).where("k < 5")
    return evaluate.loop_evaluation(a.select(F.col("user_id").alias("g"), F.col("k").alias("attempt"), (F.col("v") % 3 == 0).alias("raw_passed"), (F.col("v") % 5 == 0).alias("passed")))


_CAND = "c AS (SELECT user_id, k, v % 11 <> 0 AS decoded, v % 2 = 0 AS geo, v % 3 = 0 AS leg, v % 7 AS viol FROM att)"


@query(f"""WITH {ATTEMPTS}, {_CAND}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE decoded) AS decoded, count(*) FILTER (WHERE decoded AND geo) AS geom_pass, count(*) FILTER (WHERE decoded AND leg) AS legal_pass, count(*) FILTER (WHERE decoded AND geo AND leg) AS both_pass FROM c)
SELECT *, round(100 * (both_pass / total), 1) AS pass_rate, round(1 / (both_pass / total), 1) AS expected_draws FROM s""")
def acceptance_budget(spark, sf_dir):
    """Stage counts of drawn plans and the draws that a pass takes."""
    v = F.col("v")
    return evaluate.acceptance_budget(_attempts(spark, sf_dir).select((v % 11 != 0).alias("decoded"), (v % 2 == 0).alias("geom_ok"), (v % 3 == 0).alias("legal_ok")))


@query(f"""WITH {ATTEMPTS}, {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY NOT (geo AND leg), CASE WHEN geo AND leg THEN false ELSE NOT geo END, CASE WHEN geo AND leg THEN 0 ELSE viol END, k) AS rn FROM c)
SELECT user_id, CAST(min(CASE WHEN rn = 1 THEN k END) AS INTEGER) AS draw, count(*) FILTER (WHERE geo AND leg) AS accepted FROM r GROUP BY 1""")
def best_of_draws(spark, sf_dir):
    """The best of each plan's draws."""
    v = F.col("v")
    c = _attempts(spark, sf_dir).select("user_id", F.col("k").alias("draw"), (v % 2 == 0).alias("geom_ok"), (v % 3 == 0).alias("legal_ok"), (v % 7).alias("n_violations"))
    return evaluate.best_of(c, "user_id")


_DOORS = "d AS (SELECT g, a, b FROM edges WHERE via = 'door'), w AS (SELECT DISTINCT g, least(a, b) AS a, greatest(a, b) AS b FROM edges WHERE (a + g) % 2 = 0)"


def _doors(spark, sf_dir):
    e = edges(nodes(spark, sf_dir))
    return e.where("via = 'door'").select("g", "a", "b"), e.where((F.col("a") + F.col("g")) % 2 == 0).select("g", F.col("b").alias("a"), F.col("a").alias("b"))


@query(f"WITH {NODES}, {EDGES}, {_DOORS} SELECT d.g, count(w.g) AS realised, count(*) AS total FROM d LEFT JOIN w ON w.g = d.g AND w.a = least(d.a, d.b) AND w.b = greatest(d.a, d.b) GROUP BY 1")
def door_realisation(spark, sf_dir):
    """Doors whose rooms share a wall."""
    return evaluate.realisation(*_doors(spark, sf_dir))


@query(f"""WITH {NODES}, {EDGES}, {_DOORS}, m AS (SELECT d.g, d.a, d.b, w.g IS NOT NULL AS ok FROM d LEFT JOIN w ON w.g = d.g AND w.a = least(d.a, d.b) AND w.b = greatest(d.a, d.b)), e AS (SELECT g, a AS n, ok FROM m UNION ALL SELECT g, b, ok FROM m),
i AS (SELECT 'R6' AS rule FROM m WHERE NOT ok UNION ALL SELECT 'R7' FROM (SELECT g, n FROM e GROUP BY 1, 2 HAVING NOT bool_or(ok)) UNION ALL SELECT 'R8' FROM (SELECT DISTINCT g FROM nodes WHERE g % 3 = 0) UNION ALL SELECT 'R2' FROM nodes WHERE pk % 50 < 3) SELECT rule, count(*) AS n FROM i GROUP BY 1""")
def render_checks(spark, sf_dir):
    """What is wrong with drawn plans, by rule."""
    rooms = nodes(spark, sf_dir).select("g", "n", F.coalesce("role", F.lit("?")).alias("role"), (F.col("pk") % 50).alias("n_corners"))
    scaled = rooms.select("g").distinct().withColumn("scale", F.when(F.col("g") % 3 != 0, 0.6))
    issues = evaluate.render_issues(rooms, *_doors(spark, sf_dir), scaled)
    return issues.groupBy(F.substring_index("issue", " ", 1).alias("rule")).agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, p AS (SELECT g, g % 2 = 0 AS edited, count(*) AS rooms, bool_or(is_entrance) AS ent, count(*) FILTER (WHERE has_window) AS wins FROM nodes GROUP BY 1)
SELECT edited, count(*) AS n, round(avg(CASE WHEN ent THEN 100.0 ELSE 0.0 END), 6) AS pct_ent, round(avg(rooms), 6) AS rooms_mean, round(avg(wins), 6) AS wins_mean, list_sort(list(rooms))[len(list(rooms)) // 2 + 1] AS rooms_median, list_sort(list(wins))[len(list(wins)) // 2 + 1] AS wins_median FROM p GROUP BY 1""")
def arms_compared(spark, sf_dir):
    """Two populations of plans by shares, means and upper middles."""
    p = nodes(spark, sf_dir).groupBy("g").agg(F.count("*").alias("rooms"), F.bool_or("is_entrance").alias("ent"), F.count_if("has_window").alias("wins")).withColumn("edited", F.col("g") % 2 == 0)
    out = evaluate.arms_compared(p, "edited", ["ent"], ["rooms", "wins"])
    return out.withColumns({c: F.round(c, 6) for c in ("pct_ent", "rooms_mean", "wins_mean")})


@query(f"""WITH {NODES}, a AS (SELECT g, bool_or(is_entrance) AS before, bool_or(is_entrance) OR count(*) > 3 AS after FROM nodes GROUP BY 1) SELECT before, after, count(*) AS n FROM a GROUP BY 1, 2""")
def paired_flips(spark, sf_dir):
    """How a verdict on the same plans went."""
    a = nodes(spark, sf_dir).groupBy("g").agg(F.bool_or("is_entrance").alias("x"), F.count("*").alias("k"))
    return evaluate.flips(a.select(F.col("x"), (F.col("x") | (F.col("k") > 3)).alias("y")), "x", "y")


_TRIPS = "e AS (SELECT DISTINCT g, least(a, b) AS a, greatest(a, b) AS b, via FROM edges), u AS (SELECT g, a, b, bool_or(via <> 'open') AS x, bool_or(via <> 'balcony') AS y FROM e GROUP BY 1, 2, 3), j AS (SELECT g, count(*) FILTER (WHERE x AND y) / nullif(count(*) FILTER (WHERE x OR y), 0) AS j FROM u GROUP BY 1)"


@query(f"WITH {NODES}, {EDGES}, {_TRIPS} SELECT g, j AS jaccard FROM j ORDER BY j, g LIMIT 10")
def worst_round_trips(spark, sf_dir):
    """The ten plans whose edges a round trip keeps least."""
    return evaluate.round_trips(_trips(spark, sf_dir))[1].select("g", "jaccard")


@query(f"WITH {NODES}, {EDGES}, {_TRIPS}, s AS (SELECT list_sort(list(j)) AS l, len(list(j)) AS n, avg(CASE WHEN j = 1 THEN 1.0 ELSE 0.0 END) AS loss_free, avg(j) AS mean, max(j) AS max FROM j) SELECT n, round(loss_free, 6) AS loss_free, round(mean, 6) AS mean, max, l[n // 2 + 1] AS median, l[CAST(round_even(0.1 * (n - 1), 0) AS BIGINT) + 1] AS p10 FROM s")
def round_trip_report(spark, sf_dir):
    """Shares and quantiles of round trips."""
    r = evaluate.round_trips(_trips(spark, sf_dir))[0]
    return r.select("n", F.round("loss_free", 6).alias("loss_free"), F.round("mean", 6).alias("mean"), "max", "median", "p10")


def _trips(spark, sf_dir):
    pair = F.struct(F.col("a").alias("x"), F.col("b").alias("y"))
    keep = lambda c: F.collect_list(F.when(c, pair))
    return edges(nodes(spark, sf_dir)).groupBy("g").agg(keep(F.col("via") != "open").alias("edges_before"), keep(F.col("via") != "balcony").alias("edges_after")).withColumns({"n_before": F.lit(1), "n_after": F.lit(1)})


_MATCH = "m AS (SELECT a.g, a.role AS ra, b.role AS rb FROM nodes a JOIN nodes b ON b.g = a.g + 1 AND b.n = a.n), q AS (SELECT a.g, a.k AS l, b.k AS r FROM (SELECT g, count(*) AS k FROM nodes GROUP BY 1) a JOIN (SELECT g, count(*) AS k FROM nodes GROUP BY 1) b ON b.g = a.g + 1)"


def _matches(spark, sf_dir):
    rooms = nodes(spark, sf_dir).select("g", "n", "role")
    other = rooms.select((F.col("g") - 1).alias("g"), "n", F.col("role").alias("role_b"))
    m = rooms.join(other, ["g", "n"]).select(F.col("g").alias("key"), F.col("role").alias("role_a"), "role_b")
    k = rooms.groupBy("g").agg(F.count("*").alias("k"))
    pairs = k.select(F.col("g").alias("key"), F.col("k").alias("n_left")).join(k.select((F.col("g") - 1).alias("key"), F.col("k").alias("n_right")), "key")
    return pairs, m


@query(f"""WITH {NODES}, {_MATCH}, c AS (SELECT g, count(*) AS k, count(*) FILTER (WHERE ra = rb) AS s FROM m GROUP BY 1), d AS (SELECT q.*, coalesce(k, 0) AS k, coalesce(s, 0) AS s FROM q LEFT JOIN c ON c.g = q.g)
SELECT count(*) AS pairs, CAST(sum(l + r) AS BIGINT) AS rooms, CAST(sum(k) AS BIGINT) AS matched, CAST(sum(s) AS BIGINT) AS role_same, count(*) FILTER (WHERE l = r AND k = l AND s = l) AS exact, 2 * sum(k) / sum(l + r) AS room_rate, sum(s) / sum(k) AS role_rate, count(*) FILTER (WHERE l = r AND k = l AND s = l) / count(*) AS exact_rate FROM d""")
def annotator_agreement(spark, sf_dir):
    """Agreement of two annotations of rooms, roles and whole plans."""
    return evaluate.agreement(*_matches(spark, sf_dir))[0]


@query(f"WITH {NODES}, {_MATCH} SELECT least(ra, rb) AS x, greatest(ra, rb) AS y, count(*) AS n FROM m WHERE ra <> rb GROUP BY 1, 2")
def annotator_confusions(spark, sf_dir):
    """Role pairs on which annotations differ."""
    return evaluate.agreement(*_matches(spark, sf_dir))[1]


_PLANS = "p AS (SELECT g, count(*) AS n_rooms, count(*) FILTER (WHERE is_entrance) AS n_entrances FROM nodes GROUP BY 1)"


@query(f"WITH {NODES}, {_PLANS} SELECT g, n_rooms FROM p WHERE n_entrances = 1 AND n_rooms BETWEEN 5 AND 14 ORDER BY g LIMIT 20")
def gate_sample(spark, sf_dir):
    """The first twenty plans that are fit for review."""
    p = nodes(spark, sf_dir).groupBy("g").agg(F.count("*").alias("n_rooms"), F.count_if("is_entrance").alias("n_entrances"))
    return evaluate.gate_sample(p, 20, 5).select("g", "n_rooms")


@query("""WITH m AS (SELECT CASE doc_id % 6 WHEN 0 THEN ' O ' WHEN 1 THEN 'x' WHEN 2 THEN 'OK' WHEN 3 THEN 'wrong' WHEN 4 THEN '' END AS v FROM documents), c AS (SELECT count(*) FILTER (WHERE lower(trim(v)) IN ('o', 'ok', 'x', 'wrong')) AS judged, count(*) FILTER (WHERE lower(trim(v)) IN ('o', 'ok')) AS correct FROM m), k AS (SELECT count(*) AS missing FROM benchmark)
SELECT *, round(correct / judged, 3) AS precision, round(correct / (correct + missing), 3) AS recall FROM c, k""")
def gate_scores(spark, sf_dir):
    """Precision and recall of judged edges."""
    v = F.get(F.array(*map(F.lit, (" O ", "x", "OK", "wrong", "", None))), (F.col("doc_id") % 6).cast("int"))
    return evaluate.gate_score(table(spark, sf_dir, "documents").select(v.alias("verdict")), table(spark, sf_dir, "benchmark"))


_GROUPS = "grp AS (SELECT md5(text) AS sig, min(lang) AS house, CASE WHEN min(doc_id) % 2 = 0 THEN 'unit' ELSE 'floor' END AS scope, CASE WHEN count(DISTINCT source) > 1 THEN 'conflict' ELSE 'agree' END AS status, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS pending, count(DISTINCT source) AS n_variants, count(*) FILTER (WHERE doc_id % 3 <> 0) AS n_corrected FROM documents GROUP BY 1 HAVING count(*) > 1)"


def _groups(spark, sf_dir):
    i = F.col("doc_id")
    g = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("sig")).agg(
        F.min("lang").alias("house"), F.when(F.min(i) % 2 == 0, "unit").otherwise("floor").alias("scope"), F.when(F.countDistinct("source") > 1, "conflict").otherwise("agree").alias("status"),
        F.count("*").alias("n"), F.count_if(i % 3 == 0).alias("pending"), F.countDistinct("source").alias("n_variants"), F.count_if(i % 3 != 0).alias("n_corrected"),
    )
    return g.where("n > 1")


@query(f"WITH {_GROUPS} SELECT sig, scope, pending FROM grp WHERE scope = 'unit' ORDER BY pending DESC, sig LIMIT 10 OFFSET 0")
def review_page(spark, sf_dir):
    """A page of the review list, most pending first."""
    return evaluate.review_list(_groups(spark, sf_dir), scope="unit", sort="pending", limit=10).select("sig", "scope", "pending")


@query(f"WITH {_GROUPS} SELECT * FROM grp WHERE status = 'conflict'")
def conflict_list(spark, sf_dir):
    """Disputed groups in the order of review."""
    return evaluate.conflict_order(_groups(spark, sf_dir))


@query(f"""WITH {NODES}, {_PLANS}, t AS (SELECT g, CASE WHEN n_rooms <= 3 THEN 'T1' ELSE 'T2' END AS tier FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY g) - 1 AS pos, count(*) OVER (PARTITION BY tier) AS n FROM t)
SELECT tier, g FROM r WHERE n <= 15 OR pos IN (SELECT CAST(floor(i * n / 15) AS BIGINT) FROM range(15) x(i))""")
def tiered_sample(spark, sf_dir):
    """Fifteen plans of each tier at even strides."""
    p = nodes(spark, sf_dir).groupBy("g").agg(F.count("*").alias("k")).select("g", F.when(F.col("k") <= 3, "T1").otherwise("T2").alias("tier"))
    return evaluate.tiered_sample(p, 15).select("tier", "g")


@query(f"""WITH {NODES}, t AS (SELECT g, list(pk % 7) AS t FROM nodes GROUP BY 1) SELECT count(*) AS n, round(avg(len(list_filter(t, lambda x: x = 1))), 6) AS doors, round(avg(len(list_filter(t, lambda x: x = 2))), 6) AS windows, round(avg(len(list_filter(t, lambda x: x = 3))), 6) AS passages, round(avg(CASE WHEN list_contains(t, 5) THEN 1.0 ELSE 0.0 END), 6) AS reached FROM t""")
def opening_counts(spark, sf_dir):
    """Openings in token arrays."""
    t = nodes(spark, sf_dir).groupBy("g").agg(F.collect_list((F.col("pk") % 7).cast("int")).alias("tokens"))
    r = evaluate.opening_counts(t, 1, 2, 3, 5)
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("doors", "windows", "passages", "reached")))


@query(f"""WITH {NODES}, o AS (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY md5('7:' || g || ':' || (n - 1))) - 1 AS p, pk FROM nodes) SELECT g, string_agg(CAST(pk AS VARCHAR), ',' ORDER BY p) AS rooms, CAST(max(CASE WHEN n = 1 THEN p END) AS INTEGER) AS first_room FROM o GROUP BY 1""")
def permuted_rooms(spark, sf_dir):
    """Rooms in a seeded order; an edge at the first room follows it."""
    own = nodes(spark, sf_dir).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "pk"))), lambda e: F.array(e["pk"])).alias("rooms"))
    p = evaluate.permuted_rooms(own.withColumn("edges", F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))), 7)
    return p.select("g", F.array_join(F.flatten("rooms").cast("array<string>"), ",").alias("rooms"), F.col("edges")[0]["x"].alias("first_room"))


@query(f"""WITH {NODES}, {EDGES}, t AS (SELECT g, string_agg(CASE role WHEN 'STANDARD' THEN '0' WHEN 'MEDIUM' THEN '1' ELSE '2' END, '' ORDER BY n) AS types FROM nodes GROUP BY 1), l AS (SELECT g, count(*) AS links FROM (SELECT DISTINCT g, least(a, b), greatest(a, b) FROM edges) GROUP BY 1) SELECT t.g, types, links FROM t LEFT JOIN l ON l.g = t.g""")
def plan_features(spark, sf_dir):
    """Role ids in order and linked places: what a model learns from."""
    rooms = nodes(spark, sf_dir)
    f = evaluate.features(rooms, edges(rooms), ["STANDARD", "MEDIUM"])
    return f.select("g", F.array_join(F.col("types").cast("array<string>"), "").alias("types"), F.when(F.col("links").isNotNull(), F.size("links").cast("long")).alias("links"))


@query("""WITH l AS (SELECT event_type AS version, value FROM events) SELECT version, count(*) AS n, round(avg(value), 6) AS value FROM l GROUP BY 1""")
def version_means(spark, sf_dir):
    """Means of a metric by version."""
    l = table(spark, sf_dir, "events").select(F.col("event_type").alias("version"), "value")
    return evaluate.by_version(l, ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT event_type, printf('%.2f±%.2f (%d)', avg(floor(value)), coalesce(stddev_samp(floor(value)), 0.0), count(*)) AS v FROM events GROUP BY 1")
def seed_texts(spark, sf_dir):
    """Mean and deviation as text."""
    e = table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("double").alias("v"))
    return evaluate.seeds_text(e, ["event_type"], ["v"], 2)
