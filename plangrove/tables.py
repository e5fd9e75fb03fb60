"""Table loading and the domain views that queries share.

The provided tables play these parts: an order is a plan, its line items are the rooms, ``p_type`` is the room's role,
``l_quantity`` its area in square metres at scale 1, ``o_orderstatus`` the house type; a document is a raw entry and its
text's digest the fingerprint; an event is a ledger row.

Two neighbouring rooms of a plan (by room number) are joined unless their part keys sum to a multiple of 4; the remainder
says how: 1 door, 2 open passage, 3 balcony; remainder 0 is a door whose rooms were not found.  A room with return flag R is an entrance, one with line status O has a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``g, n, pk, role, area, price, is_entrance, has_window``: the rooms of every plan, numbered from 1."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_type").alias("role"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    rooms = li.select(
        F.col("l_orderkey").alias("g"),
        F.row_number().over(w).alias("n"),
        F.col("l_partkey").alias("pk"),
        F.col("l_quantity").alias("area"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_returnflag") == "R").alias("is_entrance"),
        (F.col("l_linestatus") == "O").alias("has_window"),
    )
    return rooms.join(part, "pk", "left")


NODES = """nodes AS (
  SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS n,
         l_partkey AS pk, p_type AS role, l_quantity AS area, l_extendedprice AS price, l_returnflag = 'R' AS is_entrance, l_linestatus = 'O' AS has_window
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
)"""


def edges(rooms: DataFrame) -> DataFrame:
    """``g, a, b, role_a, role_b, via`` between neighbouring rooms, from the same sorted window that numbered them."""
    w = Window.partitionBy("g").orderBy("n")
    step = rooms.withColumns({"b": F.lead("n").over(w), "pk_b": F.lead("pk").over(w), "role_b": F.lead("role").over(w)}).where("b is not null")
    kind = F.pmod(F.col("pk") + F.col("pk_b"), F.lit(4))
    via = F.when(kind == 1, "door").when(kind == 2, "open").when(kind == 3, "balcony")
    return step.select("g", F.col("n").alias("a"), "b", F.col("role").alias("role_a"), "role_b", via.alias("via")).where("via is not null")


EDGES = """edges AS (
  SELECT g, a, b, role_a, role_b, CASE k WHEN 1 THEN 'door' WHEN 2 THEN 'open' WHEN 3 THEN 'balcony' END AS via FROM (
    SELECT g, n AS a, lead(n) OVER w AS b, role AS role_a, lead(role) OVER w AS role_b, (pk + lead(pk) OVER w) % 4 AS k
    FROM nodes WINDOW w AS (PARTITION BY g ORDER BY n)) WHERE b IS NOT NULL AND k <> 0
)"""


def unresolved(rooms: DataFrame) -> DataFrame:
    """``g, n_unresolved``: neighbouring rooms that no door could be resolved between (remainder 0)."""
    w = Window.partitionBy("g").orderBy("n")
    step = rooms.select("g", F.pmod(F.col("pk") + F.lead("pk").over(w), F.lit(4)).alias("k"))
    return step.groupBy("g").agg(F.count_if(F.col("k") == 0).alias("n_unresolved"))


UNRESOLVED = "unresolved AS (SELECT g, count(*) FILTER (WHERE k = 0) AS n_unresolved FROM (SELECT g, (pk + lead(pk) OVER (PARTITION BY g ORDER BY n)) % 4 AS k FROM nodes) GROUP BY 1)"


def house_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.col("o_orderstatus").alias("house"))


HOUSES = "houses AS (SELECT o_orderkey AS g, o_orderstatus AS house FROM orders)"
