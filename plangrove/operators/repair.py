"""Edits and repairs: ring clean-up, axis snapping, edge and room edits, ordered role rules, the repair loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, rules, units


def clean_ring(ring: Column, tol: float = 1e-9) -> Column:
    """A ring without repeated corners and corners on a straight line."""
    same = lambda p, q: (F.abs(p["x"] - q["x"]) <= tol) & (F.abs(p["y"] - q["y"]) <= tol)
    before = lambda r: F.concat(F.slice(r, F.greatest(F.size(r), F.lit(1)), F.lit(1)), F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))))
    after = lambda r: F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(1), F.lit(1)))
    seen = F.zip_with(ring, before(ring), lambda p, q: F.struct(p.alias("p"), (~same(p, q)).alias("keep")))
    distinct = F.transform(F.filter(seen, lambda s: s["keep"]), lambda s: s["p"])
    three = F.zip_with(F.zip_with(before(distinct), distinct, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), after(distinct), lambda s, c: F.struct(s["a"].alias("a"), s["b"].alias("b"), c.alias("c")))
    turn = lambda s: (s["b"]["x"] - s["a"]["x"]) * (s["c"]["y"] - s["b"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (s["c"]["x"] - s["b"]["x"])
    return F.transform(F.filter(three, lambda s: F.abs(turn(s)) > tol), lambda s: s["b"])


def snap_axis(boxes: DataFrame, tol: float) -> DataFrame:
    """Moves box sides of a plan that lie within ``tol`` of each other to the mean of their cluster (``g, id, box``)."""

    def snapped(axis: str) -> DataFrame:
        ends = boxes.select("g", F.explode(F.array(F.col(f"box.{axis}0"), F.col(f"box.{axis}1"))).alias("v")).distinct()
        w = Window.partitionBy("g").orderBy("v")
        jump = F.when(F.col("v") - F.lag("v").over(w) > tol, 1).otherwise(0)
        named = ends.withColumn("jump", jump).withColumn("island", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        mean = F.avg("v").over(Window.partitionBy("g", "island"))
        return named.select("g", "v", mean.alias("to"))

    out = boxes
    for axis in "xy":
        table = snapped(axis)
        for end in "01":
            column = f"{axis}{end}"
            moved = table.select("g", F.col("v").alias(f"v_{column}"), F.col("to").alias(f"to_{column}"))
            out = out.withColumn(f"v_{column}", F.col(f"box.{column}")).join(moved, ["g", f"v_{column}"]).drop(f"v_{column}")
    return out.select("g", "id", F.struct(*(F.col(f"to_{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))).alias("box"))


def merge_rooms(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rooms ``n`` of ``merges (g, n, into)`` go into others: areas add up, edges move, loops and parallels vanish."""
    to = nodes.join(merges, ["g", "n"], "left").withColumn("n2", F.coalesce("into", "n"))
    kept = to.groupBy("g", F.col("n2").alias("n")).agg(F.min_by("role", F.when(F.col("into").isNull(), 0).otherwise(1)).alias("role"), F.sum("area").alias("area"), F.bool_or("is_entrance").alias("is_entrance"), F.bool_or("has_window").alias("has_window"))
    name = to.select("g", "n", "n2", "role")
    left = edges.join(name.select("g", F.col("n").alias("a"), F.col("n2").alias("a2")), ["g", "a"]).join(name.select("g", F.col("n").alias("b"), F.col("n2").alias("b2")), ["g", "b"])
    moved = left.where("a2 <> b2").groupBy("g", F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).agg(F.min("via").alias("via"))
    roles = kept.select("g", "n", "role")
    named = moved.join(roles.select("g", F.col("n").alias("a"), F.col("role").alias("role_a")), ["g", "a"]).join(roles.select("g", F.col("n").alias("b"), F.col("role").alias("role_b")), ["g", "b"])
    return kept, named.select("g", "a", "b", "role_a", "role_b", "via")


def set_edges(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Applies edge edits (``g, a, b, via``): an unordered pair is replaced, added, or removed where via is null."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    new = edits.select("g", a.alias("a"), b.alias("b"), F.col("via").alias("new"), F.lit(True).alias("edited"))
    old = edges.select("g", a.alias("a"), b.alias("b"), "via").dropDuplicates(["g", "a", "b"])
    both = old.join(new, ["g", "a", "b"], "full")
    return both.select("g", "a", "b", F.when(F.col("edited"), F.col("new")).otherwise(F.col("via")).alias("via")).where("via is not null")


def add_connector(nodes: DataFrame, edges: DataFrame, members: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """A new room of a plan, numbered after its last, linked by open passages to ``members (g, n)``."""
    number = nodes.groupBy("g").agg((F.max("n") + 1).alias("hub"))
    hubs = number.join(members.select("g").distinct(), "g", "left_semi")
    room = hubs.select("g", F.col("hub").alias("n"), F.lit(role).alias("role"))
    links = members.join(hubs, "g").select("g", F.col("n").alias("a"), F.col("hub").alias("b"), F.lit("open").alias("via"))
    return nodes.select("g", "n", "role").unionByName(room), edges.select("g", "a", "b", "via").unionByName(links)


def enhanced_roles(nodes: DataFrame, edges: DataFrame, hub: str, wet: str, plain: str) -> DataFrame:
    """Ordered rules on a room's degree and neighbours: a plain room of degree 3 or more is the hub; a small one beside the hub only is wet."""
    seen = rules.neighbour_roles(nodes, edges).join(graph.degrees(nodes, edges), ["g", "n"])
    role = F.when((F.col("role") == plain) & (F.col("degree") >= 3), hub).when((F.col("role") == plain) & (F.col("area") < 4) & (F.col("around") == F.array(F.lit(hub))), wet).otherwise(F.col("role"))
    return seen.select("g", "n", role.alias("role"))


def legal_report(violations: DataFrame, plans: DataFrame, scale: Column, area_rules: list[str], other_rules: list[str]) -> DataFrame:
    """Each plan's applied and skipped rules (area rules need a scale) and its violated ones."""
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    found = violations.groupBy("g").agg(F.array_sort(F.collect_set("rule")).alias("violated"))
    out = plans.select("g", scale.alias("scale")).join(found, "g", "left")
    applied = F.when(F.col("scale").isNull(), lit(other_rules)).otherwise(lit(sorted(area_rules + other_rules)))
    skipped = F.when(F.col("scale").isNull(), lit(area_rules)).otherwise(F.array().cast("array<string>"))
    return out.select("g", applied.alias("applied"), skipped.alias("skipped"), F.coalesce("violated", F.array().cast("array<string>")).alias("violated"))


def unified(integrity: DataFrame, legal: DataFrame, architecture: DataFrame) -> DataFrame:
    """All violations with the kind of their rule."""
    tag = lambda d, kind: d.withColumn("kind", F.lit(kind))
    return tag(integrity, "integrity").unionByName(tag(legal, "legal")).unionByName(tag(architecture, "architecture"))


def repair_until_legal(nodes: DataFrame, edges: DataFrame, habitable: Column, tries: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """Checks, repairs windows and ways, checks again: at most ``tries`` rounds. Returns rooms, edges and rounds used."""
    used = 0
    while used < tries:
        ways = graph.checkpointed(units.joined_parts(graph.solved(nodes, edges)))
        blind = graph.checkpointed(nodes.where(habitable & ~F.col("has_window")).select("g", "n"))
        if ways.limit(1).count() == 0 and blind.limit(1).count() == 0:
            break
        used += 1
        role = nodes.select("g", "n", "role")
        new = ways.join(role.select("g", F.col("n").alias("a"), F.col("role").alias("role_a")), ["g", "a"]).join(role.select("g", F.col("n").alias("b"), F.col("role").alias("role_b")), ["g", "b"])
        edges = graph.checkpointed(edges.unionByName(new.select(*edges.columns)))
        lit = blind.withColumn("fixed", F.lit(True))
        nodes = graph.checkpointed(nodes.join(lit, ["g", "n"], "left").withColumn("has_window", F.col("has_window") | F.coalesce("fixed", F.lit(False))).select(*nodes.columns))
    return nodes, edges, used
