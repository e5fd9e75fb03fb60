"""Queries of the rule engine.

Roles: STANDARD and MEDIUM are habitable, MEDIUM the bedroom, ECONOMY the bathroom, PROMO the balcony, LARGE the outdoor unit, SMALL the refuge and the dressing room, STANDARD the hub
of a suite.  Areas of plans whose number is divisible by 3 have no scale; all others 0.6 m a unit.  A window is as long as the price's remainder by 5, in metres.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, graph, rules
from ..registry import query
from ..tables import EDGES, NODES, UNRESOLVED, edges, nodes, unresolved
from .graphs import REACH

INTEGRITY = f"""{NODES}, {EDGES}, {UNRESOLVED}, {REACH}, comp AS (SELECT g, n, min(r) AS c FROM reach GROUP BY 1, 2), sizes AS (SELECT g, c, count(*) AS k FROM comp GROUP BY 1, 2),
main AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY k DESC, c) AS rn FROM sizes), ent AS (SELECT g, bool_or(is_entrance) AS e FROM nodes GROUP BY 1),
ok AS (SELECT DISTINCT reach.g, reach.n FROM reach JOIN nodes e ON e.g = reach.g AND e.n = reach.r AND e.is_entrance),
integrity AS (
  SELECT g, CAST(c AS INTEGER) AS n, 'R1_isolated_component' AS rule FROM main WHERE rn > 1
  UNION ALL SELECT g, CAST(n AS INTEGER), 'R2_doorless_room' FROM nodes WHERE NOT EXISTS (SELECT 1 FROM bi WHERE bi.g = nodes.g AND bi.v = nodes.n)
  UNION ALL SELECT nodes.g, CAST(nodes.n AS INTEGER), 'R3_unreachable_from_entrance' FROM nodes JOIN ent ON ent.g = nodes.g AND ent.e WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.g = nodes.g AND ok.n = nodes.n)
  UNION ALL SELECT g, NULL, 'R4_no_entrance' FROM ent WHERE NOT e
  UNION ALL SELECT g, NULL, 'R5_unresolved_doors' FROM unresolved WHERE n_unresolved > 0)"""

MEASURED = """measured AS (SELECT *, CASE WHEN g % 3 <> 0 THEN area * 0.6 * 0.6 END AS m2, role IN ('STANDARD', 'MEDIUM') AS hab, (CAST(floor(price) AS BIGINT) % 5) * 1.2 AS light FROM nodes)"""
LEGAL = f"""{MEASURED},
legal AS (
  SELECT g, CAST(n AS INTEGER) AS n, 'L1_daylight_window' AS rule FROM measured WHERE hab AND NOT has_window
  UNION ALL SELECT g, CAST(n AS INTEGER), 'L1_daylight_ratio' FROM measured WHERE hab AND has_window AND light > 0 AND m2 > 0 AND light / m2 < 0.10
  UNION ALL SELECT g, CAST(n AS INTEGER), 'L2_ventilation_window' FROM measured WHERE hab AND NOT has_window
  UNION ALL SELECT g, CAST(n AS INTEGER), 'L4_bedroom_min_area' FROM measured WHERE role = 'MEDIUM' AND m2 < 7.0
  UNION ALL SELECT g, NULL, 'L5_dwelling_min_area' FROM measured WHERE role NOT IN ('PROMO', 'LARGE') GROUP BY g HAVING sum(m2) > 0 AND sum(m2) < 14.0
  UNION ALL SELECT g, CAST(n AS INTEGER), 'L6_refuge_area' FROM measured WHERE role = 'SMALL' AND m2 < 2.0)"""

EGRESS = """egress AS (SELECT reach_c.g, CAST(reach_c.n AS INTEGER) AS n, 'L3_egress_reachable' AS rule FROM (SELECT g, n, min(r) AS c FROM reach GROUP BY 1, 2) reach_c
  WHERE EXISTS (SELECT 1 FROM nodes e WHERE e.g = reach_c.g AND e.is_entrance) AND NOT EXISTS (SELECT 1 FROM reach r2 JOIN nodes e ON e.g = r2.g AND e.n = r2.r AND e.is_entrance WHERE r2.g = reach_c.g AND r2.n = reach_c.n)
  UNION ALL SELECT g, NULL, 'L3_egress_reachable' FROM nodes GROUP BY g HAVING NOT bool_or(is_entrance))"""

ARCH = """near AS (SELECT g, a AS n, role_b AS r FROM edges UNION ALL SELECT g, b, role_a FROM edges),
arch AS (SELECT g, CAST(n AS INTEGER) AS n, 'A4_hvac_on_balcony' AS rule FROM nodes WHERE role = 'LARGE' AND NOT EXISTS (SELECT 1 FROM near WHERE near.g = nodes.g AND near.n = nodes.n AND r = 'PROMO')
  UNION ALL SELECT g, CAST(n AS INTEGER), 'A2_master_suite_hub' FROM nodes WHERE role = 'SMALL' AND EXISTS (SELECT 1 FROM near WHERE near.g = nodes.g AND near.n = nodes.n AND r = 'MEDIUM')
    AND EXISTS (SELECT 1 FROM near WHERE near.g = nodes.g AND near.n = nodes.n AND r = 'ECONOMY') AND NOT EXISTS (SELECT 1 FROM near WHERE near.g = nodes.g AND near.n = nodes.n AND r = 'STANDARD'))"""

#: The parts that roles play in the architecture rules.
ARCH_ROLES = {"unit": "LARGE", "balcony": "PROMO", "dressing": "SMALL", "bedrooms": ["MEDIUM"], "bath": "ECONOMY", "hub": "STANDARD"}


def _parts(spark, sf_dir):
    rooms = graph.checkpointed(nodes(spark, sf_dir))
    return rooms, edges(rooms)


def _integrity(spark, sf_dir):
    rooms, links = _parts(spark, sf_dir)
    found = graph.solved(rooms, links, F.col("is_entrance"))
    return rooms, links, found, rules.integrity(found, unresolved(rooms))


def _legal(rooms):
    return rules.legal(
        rooms,
        F.when(F.col("g") % 3 != 0, F.lit(0.6)),
        F.col("role").isin("STANDARD", "MEDIUM"),
        F.col("role") == "MEDIUM",
        F.col("role") == "SMALL",
        (F.floor("price") % 5).cast("double"),
        F.col("role").isin("PROMO", "LARGE"),
    )


@query(f"WITH RECURSIVE {INTEGRITY} SELECT * FROM integrity")
def integrity_rules(spark, sf_dir):
    """R1 to R5 as one table of violations."""
    return _integrity(spark, sf_dir)[3]


@query(f"""WITH RECURSIVE {INTEGRITY}, v AS (SELECT nodes.g, coalesce(list(DISTINCT rule) FILTER (WHERE rule IS NOT NULL), []) AS r FROM (SELECT DISTINCT g FROM nodes) nodes LEFT JOIN integrity i ON i.g = nodes.g GROUP BY 1),
d AS (SELECT CASE WHEN len(r) = 0 THEN 'use' ELSE 'fix' END AS disposition, CASE WHEN len(r) = 0 THEN 'accepted' WHEN list_contains(r, 'R4_no_entrance') THEN 'R4_no_entrance' WHEN list_contains(r, 'R1_isolated_component') THEN 'R1_isolated_component'
  WHEN list_contains(r, 'R3_unreachable_from_entrance') THEN 'R3_unreachable_from_entrance' WHEN list_contains(r, 'R2_doorless_room') THEN 'R2_doorless_room' ELSE 'R5_unresolved_doors' END AS reason FROM v)
SELECT disposition, reason, count(*) AS n FROM d GROUP BY 1, 2""")
def plan_dispositions(spark, sf_dir):
    """Plans by the one disposition that their violated rules give."""
    rooms, _, _, found = _integrity(spark, sf_dir)
    v = rules.verdicts(found, rooms)
    status = F.when(F.col("passed"), "success").otherwise("quarantine")
    group, label = classify.disposition_of(status, F.array_join("rules", ","))
    return v.select(group.alias("disposition"), label.alias("reason")).groupBy("disposition", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {NODES}, {LEGAL} SELECT * FROM legal")
def legal_rules(spark, sf_dir):
    """Area, daylight and ventilation rules; a plan without scale skips area rules."""
    return _legal(nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {NODES}, {EDGES}, {REACH}, {EGRESS} SELECT * FROM egress")
def egress_rule(spark, sf_dir):
    """Rooms without a way out."""
    rooms, links = _parts(spark, sf_dir)
    return rules.egress(graph.solved(rooms, links, F.col("is_entrance")))


@query(f"WITH {NODES}, {EDGES}, {ARCH} SELECT * FROM arch")
def arch_rules(spark, sf_dir):
    """Rules on the roles around a room."""
    return rules.architecture(*_parts(spark, sf_dir), **ARCH_ROLES)


@query(f"""WITH RECURSIVE {INTEGRITY}, {LEGAL}, {ARCH}, v AS (SELECT * FROM integrity UNION ALL SELECT * FROM legal UNION ALL SELECT * FROM arch), p AS (SELECT count(DISTINCT g) AS plans FROM nodes)
SELECT rule, count(*) AS n_rows, count(DISTINCT g) AS n_plans, ((SELECT plans FROM p) - count(DISTINCT g)) / (SELECT plans FROM p) AS pass_share FROM v GROUP BY 1""")
def violation_summary(spark, sf_dir):
    """All rule kinds together: rows and plans per rule, and the share that passes."""
    rooms, links, _, found = _integrity(spark, sf_dir)
    every = rules.union(found, _legal(rooms), rules.architecture(rooms, links, **ARCH_ROLES))
    return rules.summary(every, rooms)


@query(f"""WITH RECURSIVE {INTEGRITY}, p AS (SELECT DISTINCT g FROM nodes), s AS (SELECT g, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM integrity GROUP BY 1)
SELECT p.g, coalesce(rules, '') AS rules, rules IS NULL AS passed FROM p LEFT JOIN s ON s.g = p.g""")
def plan_verdicts(spark, sf_dir):
    """Each plan's violated integrity rules and its verdict."""
    rooms, _, _, found = _integrity(spark, sf_dir)
    return rules.verdicts(found, rooms).select("g", F.array_join("rules", ",").alias("rules"), "passed")


@query(f"""WITH {NODES}, {LEGAL}, b AS (SELECT rule, count(DISTINCT g) AS n FROM legal GROUP BY 1),
lit AS (SELECT *, has_window OR hab AS w FROM measured), a AS (SELECT 'L1_daylight_ratio' AS rule, count(DISTINCT g) AS n FROM lit WHERE hab AND w AND light > 0 AND m2 > 0 AND light / m2 < 0.10)
SELECT b.rule, b.n AS before_repair, CAST(CASE WHEN b.rule IN ('L1_daylight_window', 'L2_ventilation_window') THEN 0 WHEN b.rule = 'L1_daylight_ratio' THEN a.n ELSE b.n END AS BIGINT) AS after_repair FROM b CROSS JOIN a""")
def rule_compliance(spark, sf_dir):
    """Plans that violate each rule before and after every habitable room has been given a window."""
    rooms = graph.checkpointed(nodes(spark, sf_dir))
    count = lambda v, name: v.groupBy("rule").agg(F.countDistinct("g").alias(name))
    lit = F.col("has_window") | F.col("role").isin("STANDARD", "MEDIUM")
    before, after = count(_legal(rooms), "before_repair"), count(_legal(rooms.withColumn("has_window", lit)), "after_repair")
    return before.join(after, "rule", "left").withColumn("after_repair", F.coalesce("after_repair", F.lit(0)))


@query(f"""WITH {NODES}, {EDGES}, {ARCH}, e AS (SELECT DISTINCT g, least(a, b) AS a, greatest(a, b) AS b, via, role_a, role_b FROM edges),
m AS (SELECT g, a, b, CASE WHEN (role_a = 'PROMO' AND role_b IN ('STANDARD', 'MEDIUM')) OR (role_b = 'PROMO' AND role_a IN ('STANDARD', 'MEDIUM')) THEN 'open' ELSE via END AS via FROM e),
two AS (SELECT g, a AS n, b AS m, role_b AS r FROM e UNION ALL SELECT g, b, a, role_a FROM e), bal AS (SELECT g, min(n) AS t FROM nodes WHERE role = 'PROMO' GROUP BY 1),
added AS (SELECT arch.g, least(n, t) AS a, greatest(n, t) AS b, 'balcony' AS via FROM arch JOIN bal ON bal.g = arch.g WHERE rule = 'A4_hvac_on_balcony'),
suite AS (SELECT s.g, s.n, min(CASE WHEN r = 'MEDIUM' THEN m END) AS bed, min(CASE WHEN r = 'ECONOMY' THEN m END) AS wet FROM arch s JOIN two ON two.g = s.g AND two.n = s.n WHERE rule = 'A2_master_suite_hub' GROUP BY 1, 2),
cut AS (SELECT g, least(n, wet) AS a, greatest(n, wet) AS b FROM suite UNION SELECT g, least(bed, n), greatest(bed, n) FROM suite UNION SELECT g, least(bed, wet), greatest(bed, wet) FROM suite),
k AS (SELECT * FROM m UNION ALL SELECT * FROM added), kept AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.g = k.g AND cut.a = k.a AND cut.b = k.b)),
f AS (SELECT via FROM kept UNION ALL SELECT 'open' FROM suite UNION ALL SELECT 'open' FROM suite UNION ALL SELECT 'door' FROM suite)
SELECT via, count(*) AS n FROM f GROUP BY 1""")
def arch_applied(spark, sf_dir):
    """Edges by kind after the balcony policy, the added balcony links and the suite hubs."""
    _, links = rules.apply_architecture(*_parts(spark, sf_dir), **ARCH_ROLES, living=["STANDARD", "MEDIUM"])
    return links.groupBy("via").agg(F.count("*").alias("n"))
