"""Window-style operators: copies, latest rows, ranked picks, gaps and islands, paging, strided samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key; all order columns descend."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def hash_ranked(df: DataFrame, group: str, key: Column, k: int, seed: str) -> DataFrame:
    """The k rows of each group whose md5('seed:key') is least, with their rank."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def islands(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Runs of sorted distinct values with gaps of at most ``tolerance``: ``island, n_values, low, high, total``."""
    w = Window.partitionBy(*keys).orderBy(value)
    jump = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    named = df.select(*keys, value).distinct().withColumn("__jump", jump).withColumn("island", F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*keys, "island").agg(F.count("*").alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of the sorted rows; an offset beyond the end shows the last page.

    Rows are picked by their position in a range-partitioned order, so a late page brings no more rows to one place than an early one.
    """
    n = df.count()
    start = min(max(offset, 0), max(0, (n - 1) // limit * limit))
    at = positioned(df, order, "__at")
    return at.where(F.col("__at").between(start, start + limit - 1)).orderBy("__at").drop("__at")


def strided_sample(df: DataFrame, order: list, k: int) -> DataFrame:
    """k rows at positions floor(i n / k) of the sorted rows.

    The sort is a range partition; a position is the partition's start plus the row's number inside it, so no task holds all rows.
    """
    ranked = positioned(df, order, "__pos")
    n = df.count()
    if n <= k:
        return ranked.drop("__pos")
    wanted = df.sparkSession.range(k).select(F.expr(f"cast(floor(id * {n} / {k}) as bigint)").alias("__pos"))
    return ranked.join(F.broadcast(wanted), "__pos", "left_semi").drop("__pos")


def positioned(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds each row's position from 0 in the whole order: a range partition, counts per partition, numbers inside it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    ranged = checkpointed(ranged)  # both uses below must see the same partitions
    ranged = ranged.withColumn("__part", F.shiftright("__mid", 33).cast("int")).withColumn("__in", F.expr("__mid & 8589934591"))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranged.join(starts, "__part").withColumn(out, F.col("__start") + F.col("__in")).drop("__mid", "__part", "__in", "__start")


def neighbours(df: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """Adds the next row's value inside each key."""
    return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
