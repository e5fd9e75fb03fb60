"""Rule engine: violation queries over room and edge tables, unioned into one report.

A violation is a row ``(g, n, rule)``; ``n`` is null for a rule about the whole plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the regulatory rules: window area per floor area; window height in metres; least areas in square metres.
DAYLIGHT_RATIO = 0.10
WINDOW_HEIGHT_M = 1.2
BEDROOM_M2 = 7.0
DWELLING_M2 = 14.0
REFUGE_M2 = 2.0


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rows(df: DataFrame, rule: str, node: str | None = "n") -> DataFrame:
    return df.select("g", (F.col(node) if node else F.lit(None)).cast("int").alias("n"), F.lit(rule).alias("rule"))


def integrity(found: DataFrame, unresolved: DataFrame) -> DataFrame:
    """R1 parts beside a plan's largest (named by their least room), R2 rooms without any edge, R3 rooms that no entrance reaches,
    R4 plans without an entrance, R5 plans with unresolved doors.

    ``found`` is :func:`graph.solved` with the entrances as sources, ``unresolved`` holds ``g, n_unresolved``. One pass: no shuffle beyond that of ``found``.
    """
    n = F.col("n").cast("int")
    check = lambda rule, hit, node: F.when(hit, F.struct(node.alias("n"), F.lit(rule).alias("rule")))
    checks = F.array(
        check("R1_isolated_component", (F.col("n") == F.col("component")) & ~F.col("main"), n),
        check("R2_doorless_room", F.col("degree") == 0, n),
        check("R3_unreachable_from_entrance", F.col("entered") & F.col("hops").isNull(), n),
        check("R4_no_entrance", F.col("first") & ~F.col("entered"), F.lit(None).cast("int")),
    )
    per_room = found.select("g", F.explode(F.filter(checks, lambda v: v.isNotNull())).alias("v")).select("g", "v.n", "v.rule")
    return union(per_room, rows(unresolved.where("n_unresolved > 0"), "R5_unresolved_doors", None))


def legal(nodes: DataFrame, scale: Column, habitable: Column, bedroom: Column, refuge: Column, window_m: Column, outdoor: Column) -> DataFrame:
    """L1 daylight (a window, and its area), L2 ventilation, L4 bedroom, L5 dwelling and L6 refuge areas; area rules are skipped without a scale.

    ``scale`` is metres per unit of length, null if unknown; a window without a length has no area to compare.  ``outdoor`` rooms do not count for the dwelling's area.
    """
    measured = nodes.withColumns({"m2": F.col("area") * scale * scale, "hab": habitable, "bed": bedroom, "ref": refuge, "light": window_m * WINDOW_HEIGHT_M, "out": F.coalesce(outdoor, F.lit(True))})
    total = measured.groupBy("g").agg(F.sum(F.when(~F.col("out"), F.col("m2"))).alias("total"))
    n, window = F.col("n").cast("int"), F.col("has_window")
    check = lambda rule, hit: F.when(hit, F.struct(n.alias("n"), F.lit(rule).alias("rule")))
    checks = F.array(
        check("L1_daylight_window", F.col("hab") & ~window),
        check("L1_daylight_ratio", F.col("hab") & window & (F.col("light") > 0) & (F.col("m2") > 0) & (F.col("light") / F.col("m2") < DAYLIGHT_RATIO)),
        check("L2_ventilation_window", F.col("hab") & ~window),
        check("L4_bedroom_min_area", F.col("bed") & (F.col("m2") < BEDROOM_M2)),
        check("L6_refuge_area", F.col("ref") & (F.col("m2") < REFUGE_M2)),
    )
    per_room = measured.select("g", F.explode(F.filter(checks, lambda v: v.isNotNull())).alias("v")).select("g", "v.n", "v.rule")
    return union(per_room, rows(total.where((F.col("total") > 0) & (F.col("total") < DWELLING_M2)), "L5_dwelling_min_area", None))


def egress(found: DataFrame) -> DataFrame:
    """L3: rooms that are not connected to the outside, going through it; one row for a plan without any way out.

    ``found`` is :func:`graph.solved` with the rooms that lead outside as sources.
    """
    return union(
        rows(found.where(F.col("entered") & F.col("hops").isNull()), "L3_egress_reachable"),
        rows(found.where(F.col("first") & ~F.col("entered")), "L3_egress_reachable", None),
    )


def neighbour_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every room with the sorted distinct roles of its neighbours."""
    near = edges.select("g", F.col("a").alias("n"), F.col("role_b").alias("r")).unionByName(edges.select("g", F.col("b").alias("n"), F.col("role_a").alias("r")))
    sets = near.groupBy("g", "n").agg(F.array_sort(F.collect_set("r")).alias("around"))
    return nodes.join(sets, ["g", "n"], "left").withColumn("around", F.coalesce("around", F.array().cast("array<string>")))


def architecture(nodes: DataFrame, edges: DataFrame, unit: str, balcony: str, dressing: str, bedrooms: list[str], bath: str, hub: str) -> DataFrame:
    """A4: an outdoor-unit room must touch a balcony.  A2: a dressing room that touches a bedroom and a bathroom needs a hub beside it."""
    seen = neighbour_roles(nodes, edges)
    has = lambda *roles: F.arrays_overlap("around", F.array(*map(F.lit, roles)))
    check = lambda rule, hit: F.when(hit, F.struct(F.col("n").cast("int").alias("n"), F.lit(rule).alias("rule")))
    checks = F.array(
        check("A4_hvac_on_balcony", (F.col("role") == unit) & ~has(balcony)),
        check("A2_master_suite_hub", (F.col("role") == dressing) & has(*bedrooms) & has(bath) & ~has(hub)),
    )
    return seen.select("g", F.explode(F.filter(checks, lambda v: v.isNotNull())).alias("v")).select("g", "v.n", "v.rule")


def apply_architecture(nodes: DataFrame, edges: DataFrame, unit: str, balcony: str, dressing: str, bedrooms: list[str], bath: str, hub: str, living: list[str], extend: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rooms and edges (``g, a, b, via``) after the policies of A5, A4 and A2, in this order.

    A5: edges between a balcony and a living room become open (extended) or balcony.  A4: an outdoor-unit room beside no balcony is joined to its plan's first one.
    A2: a dressing room with a bedroom and a bathroom but no hub beside it gets one; the hub is joined to the first of either and to the dressing room, and the direct
    edges among the three go.  New hubs are numbered after the plan's last room, in the order of the dressing rooms.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    ways = edges.groupBy("g", a.alias("a"), b.alias("b")).agg(F.min("via").alias("via"))
    role = nodes.select("g", "n", "role")

    def named(e: DataFrame) -> DataFrame:
        return e.join(role.withColumnRenamed("n", "a").withColumnRenamed("role", "ra"), ["g", "a"]).join(role.withColumnRenamed("n", "b").withColumnRenamed("role", "rb"), ["g", "b"])

    met = named(ways)
    touches = ((F.col("ra") == balcony) & F.col("rb").isin(living)) | ((F.col("rb") == balcony) & F.col("ra").isin(living))
    met = met.withColumn("via", F.when(touches, F.lit("open" if extend else "balcony")).otherwise(F.col("via")))
    near = met.select("g", F.col("a").alias("n"), F.col("b").alias("m"), F.col("rb").alias("r")).unionByName(met.select("g", F.col("b").alias("n"), F.col("a").alias("m"), F.col("ra").alias("r")))
    first = role.where(F.col("role") == balcony).groupBy("g").agg(F.min("n").alias("to"))
    alone = role.where(F.col("role") == unit).join(near.where(F.col("r") == balcony).select("g", "n"), ["g", "n"], "left_anti").join(first, "g")
    added = alone.select("g", F.least("n", "to").alias("a"), F.greatest("n", "to").alias("b"), F.lit("balcony").alias("via"))
    around = near.groupBy("g", "n").agg(F.min(F.when(F.col("r").isin(bedrooms), F.col("m"))).alias("bed"), F.min(F.when(F.col("r") == bath, F.col("m"))).alias("wet"), F.max((F.col("r") == hub).cast("int")).alias("hubs"))
    suite = role.where(F.col("role") == dressing).join(around, ["g", "n"]).where("bed is not null and wet is not null and hubs = 0")
    last = nodes.groupBy("g").agg(F.max("n").alias("last"))
    order = F.row_number().over(Window.partitionBy("g").orderBy("n"))
    suite = suite.join(last, "g").withColumn("hub", (F.col("last") + order).cast("int")).select("g", "n", "bed", "wet", "hub")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    cut = suite.select("g", F.explode(F.array(pair("n", "wet"), pair("bed", "n"), pair("bed", "wet"))).alias("e")).select("g", "e.a", "e.b").distinct()
    link = lambda x, via: F.struct(F.col(x).alias("a"), F.col("hub").alias("b"), F.lit(via).alias("via"))
    new = suite.select("g", F.explode(F.array(link("bed", "open"), link("n", "open"), link("wet", "door"))).alias("e")).select("g", "e.a", "e.b", "e.via")
    kept = met.select("g", "a", "b", "via").unionByName(added).join(cut, ["g", "a", "b"], "left_anti")
    hubs = suite.select("g", F.col("hub").alias("n"), F.lit(hub).alias("role"))
    return role.unionByName(hubs), kept.unionByName(new)


def has_prefix(rules_column: Column, *prefixes: str) -> Column:
    """Whether some violated rule of a plan (an array of ids) begins with one of the prefixes."""
    return F.exists(rules_column, lambda r: F.array_contains(F.array(*(r.startswith(p) for p in prefixes)), True))


def summary(violations: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and rooms that violate each rule, and the share of plans that pass it."""
    n = plans.select("g").distinct().agg(F.count("*").alias("plans"))
    per = violations.groupBy("rule").agg(F.count("*").alias("n_rows"), F.countDistinct("g").alias("n_plans"))
    return per.join(F.broadcast(n), F.lit(True)).select("rule", "n_rows", "n_plans", ((F.col("plans") - F.col("n_plans")) / F.col("plans")).alias("pass_share"))


def verdicts(violations: DataFrame, plans: DataFrame, hard_prefix: str = "R") -> DataFrame:
    """Each plan's rules in order, and whether it passes (only rules of the hard kind count)."""
    sets = violations.groupBy("g").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    out = plans.select("g").distinct().join(sets, "g", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    return out.withColumn("passed", ~F.exists("rules", lambda r: r.startswith(hard_prefix)))
