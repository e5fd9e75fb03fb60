"""Graph operators over node and edge tables: degree, components, hop distances, constraints.

Plans are small, so :func:`solved` brings each plan's rooms and edges together in one shuffle and solves all plans of a batch at once
in numpy.  A plan of more than ``PLAN_ROWS`` rows leaves that task as it came and is solved through tables, round by round; results are equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows (rooms and edges) of a plan that are solved inside one task.
PLAN_ROWS = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without the setting a local master gets a folder of its own and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/plangrove-checkpoints"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes to the shared folder named by ``spark.checkpoint.dir`` and reads back, so that lost executors cost no history."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plangrove-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every undirected edge as two rows (g, v, w, via)."""
    return edges.select("g", F.col("a").alias("v"), F.col("b").alias("w"), "via").unionByName(edges.select("g", F.col("b").alias("v"), F.col("a").alias("w"), "via"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node, 0 included."""
    d = both_ways(edges).groupBy("g", F.col("v").alias("n")).agg(F.count("*").alias("degree"))
    return nodes.select("g", "n").join(d, ["g", "n"], "left").select("g", "n", F.coalesce("degree", F.lit(0)).alias("degree"))


def components_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, n, component) of large plans, by least labels with pointer jumping until nothing changes."""
    near = checkpointed(both_ways(edges).select("g", "v", "w").distinct())
    first = near.groupBy("g", F.col("v").alias("n")).agg(F.min("w").alias("w"))
    label = nodes.select("g", "n").join(first, ["g", "n"], "left").select("g", "n", F.least("n", F.coalesce("w", "n")).alias("component"))
    label = checkpointed(label)
    while True:
        seen = near.join(label.select("g", F.col("n").alias("w"), F.col("component").alias("c")), ["g", "w"]).groupBy("g", F.col("v").alias("n")).agg(F.min("c").alias("c"))
        hop = label.select("g", F.col("n").alias("component"), F.col("component").alias("hop"))
        new = label.join(seen, ["g", "n"], "left").join(hop, ["g", "component"], "left")
        new = checkpointed(new.select("g", "n", F.least("component", F.coalesce("c", "component"), F.coalesce("hop", "component")).alias("next"), "component"))
        if new.where("next <> component").limit(1).count() == 0:
            return label
        label = new.select("g", "n", F.col("next").alias("component"))


def hops_by_rounds(nodes: DataFrame, edges: DataFrame, source: Column) -> DataFrame:
    """(g, n, hops) of large plans. A frontier grows until it is empty."""
    near = checkpointed(both_ways(edges).select("g", "v", "w").distinct())
    known = checkpointed(nodes.where(source).select("g", "n", F.lit(0).alias("hops")))
    frontier, hops = known, 0
    while frontier.limit(1).count():
        hops += 1
        step = near.join(frontier.select("g", F.col("n").alias("v")), ["g", "v"]).select("g", F.col("w").alias("n")).distinct()
        frontier = checkpointed(step.join(known, ["g", "n"], "left_anti").select("g", "n", F.lit(hops).alias("hops")))
        known = known.unionByName(frontier)
    return nodes.select("g", "n").join(known, ["g", "n"], "left")


_SOLVED = "g long, n int, component int, hops int, degree int, main boolean, entered boolean, first boolean, open int, b int, source boolean"


def _solve(g: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    """Rooms (kind 0) and edges (kind 1) of whole plans, sorted by plan, to one row a room."""
    plan = np.cumsum(np.concatenate(([True], g[1:] != g[:-1]))) - 1
    low = int(min(a.min(), b.min()))
    span = int(max(a.max(), b.max())) - low + 1
    room = kind == 0
    keys, inverse = np.unique(plan[room] * span + (a[room] - low), return_inverse=True)
    n, of = len(keys), keys // span
    starts = np.zeros(n, bool)
    np.logical_or.at(starts, inverse, source[room])
    ends = []
    for x in (a, b):
        at = plan[~room] * span + (x[~room] - low)
        place = np.minimum(np.searchsorted(keys, at), max(n - 1, 0))
        ends.append((place, keys[place] == at if n else np.zeros(len(at), bool)))
    fine = ends[0][1] & ends[1][1]
    u, v = ends[0][0][fine], ends[1][0][fine]
    label = np.arange(n)
    while True:  # least labels with pointer jumping: keys rise with the room's number
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = n + 1
    hops = np.where(starts, 0, far)
    while True:
        new = hops.copy()
        np.minimum.at(new, u, hops[v] + 1)
        np.minimum.at(new, v, hops[u] + 1)
        new = np.minimum(new, far)
        if (new == hops).all():
            break
        hops = new
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    size = np.bincount(label, minlength=n)[label]
    plans = int(plan[-1]) + 1
    most = np.zeros(plans, np.int64)
    np.maximum.at(most, of, size)
    largest = np.full(plans, n)
    np.minimum.at(largest, of[size == most[of]], label[size == most[of]])
    entered = np.zeros(plans, bool)
    np.logical_or.at(entered, of, starts)
    plan_of = np.zeros(plans, np.int64)
    plan_of[plan] = g
    number = (keys % span + low).astype(np.int32)
    columns = [
        pa.array(plan_of[of]), pa.array(number), pa.array(number[label]), pa.array(hops.astype(np.int32), mask=hops == far), pa.array(degree.astype(np.int32)),
        pa.array(label == largest[of]), pa.array(entered[of]), pa.array(np.diff(of, prepend=-1) > 0), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, _SOLVED.replace(",", "").split()[::2])


def _solver(limit: int):
    """Rows (g, kind, a, b, source) sorted by plan; a plan beyond the limit passes through with ``open`` 1 for rooms, 2 for edges."""

    def through(g, kind, a, b, source) -> pa.RecordBatch:
        n = len(g)
        none = lambda t: pa.nulls(n, t)
        columns = [pa.array(g), pa.array(a.astype(np.int32)), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.bool_()), none(pa.bool_()), none(pa.bool_()), pa.array((kind + 1).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(source)]
        return pa.RecordBatch.from_arrays(columns, _SOLVED.replace(",", "").split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        passing = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            if passing is not None:
                k = int(np.searchsorted(cols[0], passing, side="right"))
                if k:
                    yield through(*(c[:k] for c in cols))
                if k == len(cols[0]):
                    continue
                cols, passing = tuple(c[k:] for c in cols), None
            if rest is not None:
                cols = tuple(np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True))
                rest = None
            edge = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
            size = np.diff(np.concatenate((edge, [len(cols[0])])))
            wide = np.repeat(size > limit, size)
            last = int(edge[-1])
            if size[-1] > limit:
                passing = cols[0][-1]
            else:
                rest = tuple(c[last:] for c in cols)
                wide[last:] = False
            done = ~wide
            if rest is not None:
                done[last:] = False
            if done.any():
                yield _solve(*(c[done] for c in cols))
            if wide.any():
                yield through(*(c[wide] for c in cols))
        if rest is not None:
            yield _solve(*rest)

    return run


def solved(nodes: DataFrame, edges: DataFrame, source: Column | None = None, limit: int = PLAN_ROWS) -> DataFrame:
    """One row a room: ``g, n, component, hops, degree, main, entered, first``.

    ``component``: the least room that edges reach; ``hops``: fewest edges from a room that ``source`` selects, null if there is no way; ``main``: whether the room's
    component is its plan's largest (of equal ones that of the least room); ``entered``: whether the plan has a source; ``first``: the plan's least room.  A room given twice counts once, a source if one of its rows is;
    edges to rooms that are not given do not count.  Plan and room numbers must not be null.
    """
    mark = F.lit(False) if source is None else F.coalesce(source, F.lit(False))
    rooms = nodes.select(F.col("g").cast("long").alias("g"), F.lit(0).alias("kind"), F.col("n").cast("long").alias("a"), F.col("n").cast("long").alias("b"), mark.alias("source"))
    links = edges.select(F.col("g").cast("long").alias("g"), F.lit(1).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(False).alias("source"))
    # by a hash of the plan: an exchange by the plan itself is left out where rooms and edges come dealt by it already, and AQE then coalesces
    # the two sides of the union apart, so that a plan's rooms and edges lie in different tasks
    rows = rooms.unionByName(links).repartition(F.xxhash64("g")).sortWithinPartitions("g")
    got = checkpointed(rows.mapInArrow(_solver(limit), _SOLVED))
    out = ["g", "n", "component", "hops", "degree", "main", "entered", "first"]
    small = got.where("open = 0").select(*out)
    if not got.where("open > 0").limit(1).count():
        return small
    big = got.where("open = 1").groupBy("g", "n").agg(F.max("source").alias("source"))
    ways = got.where("open = 2").select("g", F.col("n").alias("a"), "b", F.lit("").alias("via"))
    met = big.select("g", F.col("n"))
    ways = ways.join(met.withColumnRenamed("n", "a"), ["g", "a"], "left_semi").join(met.withColumnRenamed("n", "b"), ["g", "b"], "left_semi").select("g", "a", "b", "via")
    by = components_by_rounds(big, ways).join(hops_by_rounds(big, ways, F.col("source")), ["g", "n"]).join(degrees(big, ways), ["g", "n"]).join(big, ["g", "n"])
    size = by.groupBy("g", "component").agg(F.count("*").alias("size"), F.max("source").alias("own"))
    plan = size.groupBy("g").agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("m"), F.max("own").alias("entered"), F.min("component").alias("least"))
    large = by.join(plan, "g").withColumn("main", F.col("component") == -F.col("m.c")).withColumn("first", F.col("n") == F.col("least")).withColumn("degree", F.col("degree").cast("int"))
    return small.unionByName(large.select(*out))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, n, component): the least node of each component."""
    return solved(nodes, edges).select("g", "n", "component")


def hop_distance(nodes: DataFrame, edges: DataFrame, source: Column) -> DataFrame:
    """(g, n, hops): fewest edges from any source; null where none reaches."""
    return solved(nodes, edges, source).select("g", "n", "hops")


def program_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("g", "role").agg(F.count("*").alias("n_rooms"))


def adjacency_pairs(edges: DataFrame) -> DataFrame:
    """Distinct unordered role pairs of each plan; a pair of equal roles is kept."""
    return edges.select("g", F.least("role_a", "role_b").alias("x"), F.greatest("role_a", "role_b").alias("y")).distinct()


def upsert_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges as one with their number and the least connection."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return edges.groupBy("g", a.alias("a"), b.alias("b")).agg(F.count("*").alias("n_doors"), F.min("via").alias("via"))
