"""Units of a plan: acceptance, scope, composition, constraints, repairs, variants, codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import graph
from .classify import collected, waterfall

#: Least and most rooms of a unit.
MIN_ROOMS = 5
MAX_ROOMS = 60


def program_maps(nodes: DataFrame) -> DataFrame:
    """``g, program, n_rooms, n_entrances``: a map of counts per plan; its size is that of the role vocabulary."""
    counts = nodes.groupBy("g", "role").agg(F.count("*").alias("k"), F.count_if("is_entrance").alias("e"))
    return counts.groupBy("g").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "k")))).alias("program"), F.sum("k").alias("n_rooms"), F.sum("e").alias("n_entrances"))


def count_of(program: Column, role: str) -> Column:
    return F.coalesce(F.try_element_at(program, F.lit(role)), F.lit(0))


def acceptance(program: Column, n_rooms: Column, passed: Column, essential: list[str], least: int = MIN_ROOMS, most: int = MAX_ROOMS) -> Column:
    """missing_essential, too_few_rooms, too_many_rooms, integrity_failed, else complete; the missing roles or the number of rooms follow a colon."""
    missing = F.filter(F.array(*map(F.lit, essential)), lambda r: F.coalesce(F.try_element_at(program, r), F.lit(0)) == 0)
    _, label = waterfall((F.size(missing) > 0, "q", "missing_essential"), (n_rooms < least, "q", "too_few_rooms"), (n_rooms > most, "q", "too_many_rooms"), (~passed, "q", "integrity_failed"), otherwise=("a", "complete"))
    payload = F.when(label == "missing_essential", F.array_join(missing, ",")).when(label.startswith("too_"), n_rooms.cast("string"))
    return F.concat_ws(":", label, payload)


def household(program: Column, n_entrances: Column, living: str) -> tuple[Column, Column]:
    """Whether a plan is one household (one entrance, at most one living room), and why not."""
    reason = F.when(n_entrances != 1, F.concat(F.lit("entrances="), n_entrances.cast("string"))).when(count_of(program, living) > 1, F.concat(F.lit("living="), count_of(program, living).cast("string"))).otherwise("")
    return reason == "", reason


def composition_reasons(program: Column, n_rooms: Column, total_area: Column, balcony: str, etc: str, living: str, bedroom: str) -> Column:
    """All failing checks of a plan's composition in fixed order (more than 4 balconies, more than 3 other rooms, ...)."""
    return collected(
        (count_of(program, living) == 0, "no_living"),
        (count_of(program, bedroom) == 0, "no_bedroom"),
        (count_of(program, balcony) > 4, "many_balconies"),
        (count_of(program, etc) > 3, "many_other"),
        (n_rooms < 3, "few_rooms"),
        (F.coalesce(total_area, F.lit(0.0)) <= 0, "no_area"),
    )


def scope(n_entrances: Column, human: Column) -> Column:
    """A human verdict, else unit for one entrance, floor for several, unknown for none."""
    return F.coalesce(human, F.when(n_entrances == 1, "unit").when(n_entrances > 1, "floor").otherwise("unknown"))


def tier(passed: Column, n_rooms: Column, roles: Column, master: str) -> Column:
    """T4 noise, T3 with a master bedroom, T1 simple, T2 canonical."""
    return F.when(~passed, "T4").when(F.array_contains(roles, master), "T3").when(n_rooms <= 3, "T1").otherwise("T2")


def constraints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per plan: program, distinct sorted adjacency, rooms with outside access, as texts in order."""
    program = program_maps(nodes).select("g", F.array_join(F.transform(F.array_sort(F.map_entries("program")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";").alias("program"))
    pairs = graph.adjacency_pairs(edges).groupBy("g").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "x", "y"))), ";").alias("adjacency"))
    access = nodes.where("has_window").groupBy("g").agg(F.array_join(F.array_sort(F.collect_set("role")), ";").alias("exterior_access"))
    fill = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return program.join(pairs, "g", "left").join(access, "g", "left").select("g", "program", fill("adjacency"), fill("exterior_access"))


def outer_sides(rooms: DataFrame) -> DataFrame:
    """``g, n, x0, y0, x1, y1``: sides of the boxes (rounded to 0.1) that no other room of the plan has too."""
    r = lambda c: F.round(F.col(f"box.{c}"), 1)
    x0, y0, x1, y1 = r("x0"), r("y0"), r("x1"), r("y1")
    side = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    sides = rooms.select("g", "n", F.explode(F.array(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x0, y1, x1, y1), side(x0, y0, x0, y1))).alias("s")).select("g", "n", "s.*")
    sides = sides.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    return sides.groupBy("g", "x0", "y0", "x1", "y1").agg(F.count("*").alias("k"), F.min("n").alias("n")).where("k = 1").select("g", "n", "x0", "y0", "x1", "y1")


def window_repair(rooms: DataFrame, habitable: Column) -> DataFrame:
    """Habitable rooms without a window (``g, n, box, has_window``): ``g, n, ok, x, y, width``.

    The window goes to the middle of the longest outer side (of equal ones the first by its corners), 0.6 of it wide within 24 and 80; a room without an outer side cannot have one.
    """
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    longest = outer_sides(rooms).groupBy("g", "n").agg(F.min(F.struct((-length).alias("l"), "x0", "y0", "x1", "y1")).alias("s"))
    dark = rooms.where(habitable & ~F.col("has_window")).select("g", "n").join(longest, ["g", "n"], "left")
    width = F.greatest(F.lit(24.0), F.least(F.lit(80.0), -F.col("s.l") * 0.6))
    return dark.select("g", "n", F.col("s").isNotNull().alias("ok"), ((F.col("s.x0") + F.col("s.x1")) / 2).alias("x"), ((F.col("s.y0") + F.col("s.y1")) / 2).alias("y"), F.when(F.col("s").isNotNull(), F.round(width, 1)).alias("width"))


def egress_repair(rooms: DataFrame, edges: DataFrame, tolerance: float, least: float) -> DataFrame:
    """New doors ``g, a, b, ok`` that bring rooms without a way to an entrance to one, only between rooms that share a wall.

    ``rooms`` hold ``g, n, is_entrance, box``. Rooms that cannot be reached are taken in order, each joined to the first reached room along a wall (sides within ``tolerance``, more than ``least``
    in common); a new door may open the way to others. Rooms that stay cut off give rows that are not ``ok``, with their own number; a plan without an entrance gives one without any.
    """
    b = F.col("box")
    mine = rooms.select(F.col("g").cast("long").alias("g"), F.col("n").cast("int").alias("n"), F.lit(None).cast("int").alias("m"), "is_entrance", *(b[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    none = F.lit(None).cast("double")
    links = edges.select(F.col("g").cast("long").alias("g"), F.col("a").cast("int").alias("n"), F.col("b").cast("int").alias("m"), F.lit(False).alias("is_entrance"), *(none.alias(c) for c in ("x0", "y0", "x1", "y1")))

    def touch(p, q) -> bool:
        across, along = min(p[3], q[3]) - max(p[1], q[1]), min(p[2], q[2]) - max(p[0], q[0])
        upright = min(abs(p[2] - q[0]), abs(q[2] - p[0])) <= tolerance and across > least
        return upright or (min(abs(p[3] - q[1]), abs(q[3] - p[1])) <= tolerance and along > least)

    def run(group):
        import pyarrow as pa

        box, starts, near, out = {}, [], {}, []
        for n, m, entrance, *corners in zip(*(group.column(c).to_pylist() for c in ("n", "m", "is_entrance", "x0", "y0", "x1", "y1")), strict=True):
            if m is None:
                box[n] = corners
                starts += [n] if entrance else []
            else:
                near.setdefault(n, set()).add(m)
                near.setdefault(m, set()).add(n)
        reached: set[int] = set()

        def spread(todo: list[int]) -> None:
            while todo:
                at = todo.pop()
                if at in box and at not in reached:
                    reached.add(at)
                    todo += near.get(at, ())

        spread(list(starts))
        if starts:
            while True:
                door = next(((n, m) for n in sorted(box) if n not in reached for m in sorted(reached) if touch(box[n], box[m])), None)
                if door is None:
                    break
                out.append((door[0], door[1], True))
                spread([door[0]])
            out += [(n, None, False) for n in sorted(box) if n not in reached]
        elif box:
            out.append((None, None, False))
        a, c, ok = zip(*out, strict=True) if out else ((), (), ())
        plan = group.column("g")[0].as_py()
        return pa.table({"g": pa.array([plan] * len(out), pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(c, pa.int32()), "ok": pa.array(ok, pa.bool_())})

    return mine.unionByName(links).groupBy("g").applyInArrow(run, "g long, a int, b int, ok boolean")


def joined_parts(found: DataFrame) -> DataFrame:
    """Open edges ``g, a, b, via`` that join each part of a plan to its largest, room by least room (``found``: :func:`graph.solved`): the repair of graphs without geometry."""
    parts = found.where(F.col("n") == F.col("component"))
    main = parts.where("main").select("g", F.col("n").alias("a"))
    return parts.where("not main").select("g", F.col("n").alias("b")).join(main, "g").select("g", "a", "b", F.lit("open").alias("via"))


def resolved_roles(mapping: dict[str, str], depth: int = 8) -> dict[str, str]:
    """A role map followed through its chains, at most ``depth`` steps; a cycle ends where it is."""
    out = {}
    for role in mapping:
        at, steps = role, 0
        while at in mapping and steps < depth and mapping[at] != at:
            at, steps = mapping[at], steps + 1
        out[role] = at
    return out


def normalise_roles(df: DataFrame, mapping: dict[str, str], column: str = "role") -> DataFrame:
    closed = resolved_roles(mapping)
    if not closed:
        return df
    table = F.create_map(*(F.lit(x) for pair in closed.items() for x in pair))
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def role_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """``g, diff``: '+A -B' for roles that only or more often occur right (+) or left (-)."""
    a, b = left.groupBy("g", "role").agg(F.count("*").alias("x")), right.groupBy("g", "role").agg(F.count("*").alias("y"))
    both = a.join(b, ["g", "role"], "full").select("g", "role", (F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))).alias("d"))
    sign = F.when(F.col("d") > 0, F.lit("+")).otherwise("-")
    return both.groupBy("g").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("d") != 0, F.concat(sign, "role")))), " ").alias("diff"))


def nearest_rooms(points: DataFrame, boxes: DataFrame, gap: float, k: int) -> DataFrame:
    """The k rooms of its plan that lie nearest to each point (``g, pid, x, y``) within ``gap``; 0 inside a room."""
    b = F.col("box")
    dx = F.greatest(b["x0"] - F.col("x"), F.lit(0.0), F.col("x") - b["x1"])
    dy = F.greatest(b["y0"] - F.col("y"), F.lit(0.0), F.col("y") - b["y1"])
    met = points.join(boxes.select("g", "id", "box"), "g").withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= gap * gap)
    w = Window.partitionBy("g", "pid").orderBy("d2", "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("g", "pid", "id", "rank", "d2")


def proximity_units(boxes: DataFrame, margin: float, least: int) -> DataFrame:
    """Groups of boxes of a plan that overlap when widened, with at least ``least`` members: ``g, unit, size``."""
    a, b = boxes.select("g", F.col("id").alias("a"), F.col("box").alias("p")), boxes.select("g", F.col("id").alias("b"), F.col("box").alias("q"))
    near = a.join(b, "g").where("a < b").where(G.boxes_overlap(F.col("p"), F.col("q"), margin)).select("g", "a", "b", F.lit("near").alias("via"))
    comp = graph.components(boxes.select("g", F.col("id").alias("n")), near)
    return comp.groupBy("g", F.col("component").alias("unit")).agg(F.count("*").alias("size")).where(F.col("size") >= least)


def variants(members: DataFrame, tolerance: int) -> DataFrame:
    """Greedy variants of each group (``grp, id, cells`` as sorted numbers): the first representative within tolerance takes a member."""

    def run(table):
        import pyarrow as pa

        rows = sorted(zip(table.column("id").to_pylist(), table.column("cells").to_pylist(), strict=True))
        reps, out = [], []
        for i, cells in rows:
            for k, (_, other) in enumerate(reps):
                if len(cells) == len(other) and all(abs(x - y) <= tolerance for x, y in zip(cells, other, strict=True)):
                    out.append((i, k))
                    break
            else:
                out.append((i, len(reps)))
                reps.append((i, cells))
        grp = table.column("grp")[0].as_py()
        return pa.table({"grp": pa.array([grp] * len(out), pa.int64()), "id": pa.array([o[0] for o in out], pa.int64()), "variant": pa.array([o[1] for o in out], pa.int32())})

    shape = members.select(F.col("grp").cast("long").alias("grp"), F.col("id").cast("long").alias("id"), F.col("cells").cast("array<long>").alias("cells"))
    return shape.groupBy("grp").applyInArrow(run, "grp long, id long, variant int")


def encode_tokens(boxes: DataFrame, grid: int = 127, size: float = 128.0) -> DataFrame:
    """A plan's boxes as one token array: begin, then type and four quantised corners for each room in order, then end."""
    q = lambda v: G.quantise(v, 0.0, size / (grid + 1), grid) + 10
    b = F.col("box")
    room = F.array((F.col("role_id") + 140).cast("int"), q(b["x0"]), q(b["y0"]), q(b["x1"]), q(b["y1"]))
    rooms = boxes.select("g", F.struct("id", room.alias("t")).alias("r")).groupBy("g").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rooms.select("g", F.concat(F.array(F.lit(1)), F.flatten(F.transform("r", lambda e: e["t"])), F.array(F.lit(2))).alias("tokens"))


def decode_tokens(tokens: DataFrame, grid: int = 127, size: float = 128.0) -> DataFrame:
    """The boxes of token arrays: ``g, id, role_id, box``. What follows an incomplete room is left out."""
    body = F.filter("tokens", lambda t: t > 2)
    n = F.floor(F.size(body) / 5).cast("int")
    rooms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(body, i * 5 + 1, F.lit(5)))
    rows = tokens.where(n > 0).select("g", F.posexplode(rooms).alias("i", "t"))
    v = lambda k: G.dequantise((F.get("t", F.lit(k)) - 10).cast("double"), 0.0, size / (grid + 1))
    return rows.select("g", (F.col("i") + 1).alias("id"), (F.get("t", F.lit(0)) - 140).alias("role_id"), F.struct(v(1).alias("x0"), v(2).alias("y0"), v(3).alias("x1"), v(4).alias("y1")).alias("box"))
