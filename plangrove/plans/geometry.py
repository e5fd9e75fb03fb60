"""Geometric queries: boxes from line items, spatial joins, matches.

A room is a box: its corner from part and supplier keys, its width from the quantity, its height from the line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import generate, graph, matching
from ..registry import query
from ..tables import NODES, nodes, table


def boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    corner = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("int").alias("k"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 4 + F.col("l_linenumber")).alias("y1"))
    return corner.groupBy("g", "pk", "sk", "k").agg(F.min(F.struct("x0", "y0", "x1", "y1")).alias("box"))


BOXES = """boxes AS (SELECT l_orderkey AS g, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS k, CAST(l_partkey % 40 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0, min(l_partkey % 40 + l_quantity) AS x1, CAST(l_suppkey % 40 + 4 + l_linenumber AS DOUBLE) AS y1 FROM lineitem GROUP BY ALL),
ids AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k, pk, sk) AS id FROM boxes)"""


def numbered(spark, sf_dir):
    """``g, id, box, k``: boxes numbered within their plan."""
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("k", "pk", "sk")
    return boxes(spark, sf_dir).withColumn("id", F.row_number().over(w)).select("g", "id", "k", "pk", "box")


@query(f"WITH {BOXES} SELECT g, CAST(id AS INTEGER) AS id, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS around, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, 4 AS corners FROM ids")
def polygon_area(spark, sf_dir):
    """Shoelace area, perimeter, centre and corners of rings."""
    b = F.col("box")
    ring = G.box_ring(b["x0"], b["y0"], b["x1"], b["y1"])
    d = numbered(spark, sf_dir).select("g", "id", ring.alias("ring"))
    m, n = d.withColumn("m", G.measures(F.col("ring"))), F.size("ring")
    return m.select("g", "id", (F.abs("m.a2") / 2).alias("area"), F.col("m.len").alias("around"), (F.col("m.sx") / n).alias("cx"), (F.col("m.sy") / n).alias("cy"), G.corner_count(F.col("ring")).alias("corners"))


@query(f"""WITH {BOXES}, pts AS (SELECT g, id AS pid, (x0 + x1) / 2 AS x, y1 - 1 AS y FROM ids)
SELECT p.g, CAST(p.pid AS INTEGER) AS pid, CAST(min(b.id) AS INTEGER) AS hit FROM pts p LEFT JOIN ids b ON b.g = p.g AND b.id <> p.pid AND p.x > b.x0 AND p.x < b.x1 AND p.y > b.y0 AND p.y < b.y1 GROUP BY 1, 2""")
def point_in_box_join(spark, sf_dir):
    """The first other room that holds a room's door point; its edges do not."""
    b = numbered(spark, sf_dir)
    pts = b.select("g", F.col("id").alias("pid"), ((F.col("box.x0") + F.col("box.x1")) / 2).alias("x"), (F.col("box.y1") - 1).alias("y"))
    met = pts.join(b.select("g", "id", "box"), "g").where("id <> pid")
    inside = (F.col("x") > F.col("box.x0")) & (F.col("x") < F.col("box.x1")) & (F.col("y") > F.col("box.y0")) & (F.col("y") < F.col("box.y1"))
    hit = met.where(inside).groupBy("g", "pid").agg(F.min("id").alias("hit"))
    return pts.select("g", "pid").join(hit, ["g", "pid"], "left")


@query(f"""WITH {BOXES} SELECT a.g, CAST(a.id AS INTEGER) AS a, CAST(b.id AS INTEGER) AS b FROM ids a JOIN ids b ON a.g = b.g AND a.id < b.id WHERE
 (least(abs(a.x1 - b.x0), abs(b.x1 - a.x0)) <= 2 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 1) OR (least(abs(a.y1 - b.y0), abs(b.y1 - a.y0)) <= 2 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1)""")
def box_adjacency(spark, sf_dir):
    """Rooms of a plan that share a wall, within a tolerance and above a length."""
    b = numbered(spark, sf_dir)
    pairs = b.select("g", F.col("id").alias("a"), F.col("box").alias("p")).join(b.select("g", F.col("id").alias("b"), F.col("box").alias("q")), "g").where("a < b")
    return pairs.where(G.shared_wall(F.col("p"), F.col("q"), 2.0, 1.0)).select("g", "a", "b")


@query(f"WITH {BOXES} SELECT a.pk AS sheet, count(*) AS n_pairs FROM ids a JOIN ids b ON a.pk = b.pk AND (a.g, a.id) < (b.g, b.id) AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY 1")
def overlapping_boxes(spark, sf_dir):
    """Overlaps among all boxes of a sheet (those of one part), by a grid."""
    b = numbered(spark, sf_dir).select(F.col("pk").alias("sheet"), F.struct("g", "id").alias("id"), "box")
    return matching.box_pairs(b, b, ["sheet"], cell=16.0).where("id_l < id_r").groupBy("sheet").agg(F.count("*").alias("n_pairs"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0), d AS (
 SELECT q.vec_id AS lid, e.vec_id AS rid, list_sum(list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id)
SELECT lid, rid, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d2, rid) AS rank FROM d) WHERE rank <= 2""")
def knn_assign(spark, sf_dir):
    """The two nearest vectors of the same label for each query vector (every id divisible by 50), by exact distance; the label is the plan they share."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    left = e.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("lid"), F.col("v").alias("p"))
    right = e.select("label", F.col("vec_id").alias("rid"), F.col("v").alias("q"))
    d2 = F.aggregate(F.zip_with("p", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    met = left.join(right, "label").where("lid <> rid").withColumn("distance", d2)
    from pyspark.sql import Window

    w = Window.partitionBy("lid").orderBy("distance", "rid")
    return met.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("lid", "rid", "rank")


@query()
def iou_box_match(spark, sf_dir):
    """Greedy one-to-one matches of the odd and even rooms of a plan by overlap, the best first."""
    b = numbered(spark, sf_dir)
    left, right = b.where("id % 2 = 1").select("g", F.col("id").alias("a"), F.col("box").alias("p")), b.where("id % 2 = 0").select("g", F.col("id").alias("b"), F.col("box").alias("q"))
    pairs = left.join(right, "g").where(G.boxes_overlap(F.col("p"), F.col("q"))).select("g", "a", "b", G.iou(F.col("p"), F.col("q")).alias("score")).where("score >= 0.05")
    return matching.greedy_by_score(pairs, "g")


@query()
def greedy_match(spark, sf_dir):
    """Odd rooms in order take the nearest unused even room of a like role."""
    b = numbered(spark, sf_dir).select("g", "id", (F.col("pk") % 3).cast("string").alias("role"), F.col("box.x0").alias("x"), F.col("box.y0").alias("y"))
    return matching.greedy_in_order(b.where("id % 2 = 1"), b.where("id % 2 = 0"), "g", 15.0)


@query()
def baseline_generate(spark, sf_dir):
    """Plans drawn from fitted pair probabilities; the fit is a table over role pairs, small by the vocabulary."""
    from .graphs import _cooccurrence

    fit = {(r["x"], r["y"]): r["p"] for r in _cooccurrence(spark, sf_dir).where("p is not null").toLocalIterator()}
    programs = nodes(spark, sf_dir).groupBy("g").agg(F.array_sort(F.collect_list("role")).alias("roles"))
    return generate.GENERATORS.make("statistical", fit, seed=0)(programs)
