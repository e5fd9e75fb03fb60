"""Listings and edits as functions: what a service over the engine would call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import evaluate, repair, windows


def list_graphs(graphs: DataFrame, q: str = "", house: str | None = None, scope: str | None = None, hold: bool | None = None, group: str | None = None, offset: int = 0, n: int = 50) -> DataFrame:
    """A page of graphs (``graph_id, house, scope, hold, sig``) by id; ``q`` is a part of the id without case, ``group`` a signature."""
    rows = graphs.where(F.contains(F.lower("graph_id"), F.lit(q.lower()))) if q else graphs
    for name, value in (("house", house), ("scope", scope), ("hold", hold), ("sig", group)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    return windows.page(rows, ["graph_id"], offset, n)


def get_graph(records: DataFrame, graph_id: str) -> DataFrame:
    """One record; the filter reaches the scan."""
    return records.where(F.col("graph_id") == graph_id)


def get_image(binary: DataFrame, graph_id: str) -> DataFrame:
    """The content of one image of a ``binaryFile`` listing."""
    return binary.where(F.element_at(F.split("path", "/"), -1) == f"{graph_id}.png").select("path", "content")


def merge(nodes: DataFrame, edges: DataFrame, g: int, n: int, into: int) -> tuple[DataFrame, DataFrame]:
    """One room of one plan goes into another."""
    one = nodes.sparkSession.createDataFrame([(g, n, into)], "g long, n int, into int")
    return repair.merge_rooms(nodes, edges, one)


def set_scales(records: DataFrame, scales: DataFrame) -> DataFrame:
    """Records with the scales of a batch (``graph_id, mm_per_px``); others keep theirs."""
    return records.join(scales.withColumnRenamed("mm_per_px", "__s"), "graph_id", "left").withColumn("scale", F.coalesce("__s", "scale")).drop("__s")


def duplicate_groups(groups: DataFrame, **query) -> tuple[DataFrame, DataFrame]:
    """(a page of groups, groups by status): see :func:`evaluate.review_list`."""
    return evaluate.review_list(groups, **query), groups.groupBy("status").agg(F.count("*").alias("n"), F.sum("n").alias("members"))


def find_group(members: DataFrame, graph_id: str) -> DataFrame:
    """All members of the group that holds a graph."""
    return members.join(members.where(F.col("id") == graph_id).select("sig").distinct(), "sig", "left_semi")
