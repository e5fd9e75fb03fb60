"""Shards by best-fit-decreasing bin packing over indivisible groups.

All copies of one text form a group that must stay in one shard.  Groups enter in order of
falling size, each into the bin with the tightest remaining capacity that still takes it,
found in a balanced tree.  Only the histogram of group sizes reaches the driver (its length is
the number of distinct sizes, which the longest text bounds, not the corpus); equal sizes are placed
together, which gives what placing them one by one gives: a bin just used stays the tightest.  For a
given number of shards the smallest capacity that suffices is searched, so sizes come out near
equal; a group above the mean shard gets a shard of its own.

Everything else is DataFrame work: ranks inside a size or a shard come from a count per hash bucket,
a running total over buckets and a row number inside each bucket, so no task holds a whole shard.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prefix_totals

#: Rows that one ranking window holds about.
BUCKET_ROWS = 50_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, and take the least that holds a size, in O(log n)."""

    def __init__(self):
        self._root = None
        self._random = random.Random(7)

    def insert(self, key: tuple[int, int]) -> None:
        a, b = self._split(self._root, key)
        self._root = self._merge(self._merge(a, [key, self._random.random(), None, None]), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the smallest entry of at least ``size``."""
        a, b = self._split(self._root, (size, -1))
        if b is None:
            self._root = a
            return None
        least = b
        while least[2] is not None:
            least = least[2]
        _, rest = self._split(b, (least[0][0], least[0][1] + 1))
        self._root = self._merge(a, rest)
        return least[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, limit: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Packs ``count`` groups of each ``size`` into bins of ``capacity``.

    Returns runs (size, bin, how many) and the number of bins; None as soon as more than ``limit`` are needed.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for size, count in sorted(classes, reverse=True):
        if size > capacity:
            raise ValueError(f"a group of {size} exceeds the capacity {capacity}")
        while count:
            found = tree.take(size)
            if found is None:
                if limit is not None and bins == limit:
                    return None
                found, bins = (capacity, bins), bins + 1
            free, k = found
            n = min(count, free // size) if size else count
            runs.append((size, k, n))
            count -= n
            tree.insert((free - n * size, k))
    return runs, bins


def pack(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, bin, how many) over at most ``shards`` bins of near equal size."""
    rest = {s: c for s, c in classes}
    total, alone, runs = sum(s * c for s, c in rest.items()), 0, []
    for size in sorted(rest, reverse=True):  # groups above the mean of what remains stand alone
        while rest[size] and alone < shards - 1 and size * (shards - alone) > total:
            runs.append((size, alone, 1))
            rest[size] -= 1
            total -= size
            alone += 1
        if rest[size]:
            break
    left = [(s, c) for s, c in rest.items() if c]
    if not left:
        return runs
    bins = shards - alone
    low = max(math.ceil(total / bins), max(s for s, _ in left))
    high, best = low, None
    while (best := best_fit_decreasing(left, high, bins)) is None:
        high += max(1, high >> 6)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(left, mid, bins)
        if tried is None:
            low = mid + 1
        else:
            high, best = mid, tried
    return runs + [(s, b + alone, n) for s, b, n in best[0]]


def _ranked(df: DataFrame, key: str, ids: list[str], buckets: int, out: str) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 among the rows of each ``key``, no window over more than a bucket."""
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*ids), F.lit(buckets)).cast("int"))
    counts = df.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    starts = prefix_totals(counts, key, ["__bucket"], "__n", "__start").drop("__n")
    local = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*ids))
    return df.withColumn("__local", local).join(starts, [key, "__bucket"]).withColumn(out, F.col("__start") + F.col("__local") - 1).drop("__bucket", "__local", "__start")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, group_size, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus ``overhead``.  A null text counts as the empty one and shares its group.  Equal
    texts share a shard; ``slot`` is gapless from 0 within a shard.  Repeated ids keep one row each (equal rows
    take neighbouring slots).  An empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("group_key"),
    )
    rows = materialise(rows, "shard-rows")
    groups = materialise(rows.groupBy("group_key").agg(F.sum("size").alias("group_size")), "shard-groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("group_size").count().toLocalIterator()]
    runs, filled = [], {}
    for size, k, n in pack(classes, shards):
        first = filled.get(size, 0)
        runs.append((size, k, first, first + n))
        filled[size] = first + n
    spark = docs.sparkSession
    run_table = spark.createDataFrame(runs or [(0, 0, 0, 0)], "group_size long, shard int, first long, until long")
    by_size = run_table.groupBy("group_size").agg(F.collect_list(F.struct("shard", "first", "until")).alias("__runs"))
    n_groups = sum(c for _, c in classes)
    ranked = _ranked(groups, "group_size", ["group_key"], max(8, n_groups // BUCKET_ROWS), "__rank")
    mine = F.filter("__runs", lambda r: (r["first"] <= F.col("__rank")) & (F.col("__rank") < r["until"]))[0]["shard"]
    placed = ranked.join(by_size, "group_size").select("group_key", "group_size", mine.alias("shard"))
    dealt = rows.join(placed, "group_key").drop("group_key")
    buckets = max(8, rows.count() // (shards * BUCKET_ROWS))
    return _ranked(dealt, "shard", ["doc_id", "text_crc32", "size"], buckets, "slot")
