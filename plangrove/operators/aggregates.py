"""Aggregations that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_std(value: Column) -> tuple[Column, Column, Column]:
    """Mean, sample deviation (0 for one value) and count of the numeric values."""
    return F.avg(value), F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, F.lit(0.0))), F.count(value)


def arg_min(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the least order tuple of each key, as one aggregation."""
    least = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("m")
    got = df.groupBy(*keys).agg(least) if keys else df.agg(least)
    return got.select(*keys, *(F.col(f"m.{c}").alias(c) for c in columns))


def share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each key and their share of all rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("total")), F.lit(True)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def l1_distance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of absolute differences of two normalised histograms (``n`` per key); an empty one counts with sum 1."""
    total = lambda d: d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    lt, rt = total(left).withColumnRenamed("t", "lt"), total(right).withColumnRenamed("t", "rt")
    both = left.withColumnRenamed("n", "ln").join(right.withColumnRenamed("n", "rn"), keys, "full")
    scaled = both.join(F.broadcast(lt), F.lit(True)).join(F.broadcast(rt), F.lit(True))
    norm = lambda n, t: F.coalesce(F.col(n), F.lit(0)) / F.greatest(F.col(t), F.lit(1))
    return scaled.agg(F.coalesce(F.sum(F.abs(norm("ln", "lt") - norm("rn", "rt"))), F.lit(0.0)).alias("l1"))


def running_total(df: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def rates(hit: Column, judged: Column, missed: Column) -> tuple[Column, Column]:
    """Precision and recall over judged rows; null without a denominator."""
    tp = F.count_if(hit & judged)
    return F.try_divide(tp, F.count_if(judged)), F.try_divide(tp, tp + F.sum(missed))
