"""Sinks: accepted and quarantined units, manifests, linkage, rule catalogs, mined registries, token files, label files, drawings as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The rule catalog (id, kind, subject).
RULES = [
    ("R1", "integrity", "isolated room"),
    ("R2", "integrity", "room without a door"),
    ("R3", "integrity", "room that no entrance reaches"),
    ("R4", "integrity", "plan without an entrance"),
    ("R5", "integrity", "part beside the largest"),
    ("L1", "legal", "daylight"),
    ("L2", "legal", "ventilation"),
    ("L3", "legal", "way out"),
    ("L4", "legal", "bedroom area"),
    ("L5", "legal", "dwelling area"),
    ("L6", "legal", "refuge area"),
    ("A2", "architecture", "private room beside hub or wet room"),
    ("A4", "architecture", "chain of wet rooms"),
]


def rule_catalog(spark: SparkSession, kind: str | None = None) -> DataFrame:
    rows = spark.createDataFrame(RULES, "rule string, kind string, subject string")
    return rows.where(F.col("kind") == kind) if kind else rows


def route(units: DataFrame, verdict: str, path: str) -> DataFrame:
    """Writes units below ``accepted`` or ``quarantine`` in one pass; returns the counts by reason without its payload."""
    routed = units.withColumn("queue", F.when(F.col(verdict) == "complete", "accepted").otherwise("quarantine"))
    routed.write.mode("overwrite").partitionBy("queue").json(path)
    return units.groupBy(S.first_reason(F.col(verdict)).alias("reason")).agg(F.count("*").alias("n"))


def manifest(raw: DataFrame, graphs: DataFrame) -> DataFrame:
    """One row per raw entry, copies included: fingerprint, disposition, the graphs of its picture, and whose copy it is.

    ``raw``: entry, fingerprint, disposition, reason; ``graphs``: fingerprint, graph_id.
    """
    of = graphs.groupBy("fingerprint").agg(F.array_sort(F.collect_set("graph_id")).alias("graph_ids"))
    first = raw.groupBy("fingerprint").agg(F.min("entry").alias("kept"))
    both = raw.join(first, "fingerprint").join(of, "fingerprint", "left")
    copy = F.col("entry") != F.col("kept")
    return both.select(
        "entry",
        "fingerprint",
        F.when(copy, "excl").otherwise(F.col("disposition")).alias("disposition"),
        F.when(copy, "duplicate").otherwise(F.col("reason")).alias("reason"),
        F.col("graph_ids").isNotNull().alias("became_graph"),
        F.coalesce("graph_ids", F.array().cast("array<string>")).alias("graph_ids"),
        F.when(copy, F.col("kept")).alias("dup_of"),
    )


def linkage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pictures with both label kinds, number of pictures for each combination of labels)."""
    g = rows.groupBy("crc", "file_size").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    both = g.where(F.array_contains("labels", "SPA") & F.array_contains("labels", "STR"))
    return both, g.groupBy(F.array_join("labels", "+").alias("combination")).agg(F.count("*").alias("n"))


def write_mined(pairs: DataFrame, release: str, path: str) -> None:
    """Mined rules of a release, one JSON line each, the release in the path."""
    pairs.where("rule <> 'none'").withColumn("release", F.lit(release)).write.mode("overwrite").partitionBy("release").json(path)


def write_tokens(tokens: DataFrame, key: str, path: str, longest: int) -> DataFrame:
    """Token arrays below their split, those beyond ``longest`` left out; returns counts and lengths by split."""
    t = tokens.withColumn("split", S.split_mod20(F.col(key))).withColumn("n", F.size("tokens"))
    t.where(F.col("n") <= longest).drop("n").write.mode("overwrite").partitionBy("split").json(path)
    return t.groupBy("split").agg(F.count_if(F.col("n") <= longest).alias("written"), F.count_if(F.col("n") > longest).alias("skipped"), F.max("n").alias("longest"))


def label_lines(annotations: DataFrame, classes: list[str]) -> DataFrame:
    """One text per picture: class number and polygon in shares of width and height, a line for each annotation."""
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("class_name")) - 1
    ring = F.get("segmentation", F.lit(0))
    share = F.transform(ring, lambda v, i: F.format_number(v / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")), 6))
    lines = annotations.where(F.col("class_name").isin(*classes)).select("file_name", "ann_id", F.concat_ws(" ", number.cast("string"), F.array_join(share, " ")).alias("line"))
    return lines.groupBy("file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ann_id", "line"))), lambda e: e["line"]), "\n").alias("text"))


def svg_text(boxes: DataFrame) -> DataFrame:
    """A plan's boxes (``g, id, role, box``) as SVG."""
    b = F.col("box")
    part = F.concat(F.lit('<polygon class="'), "role", F.lit('" points="'), F.concat_ws(" ", *(F.concat_ws(",", b[x].cast("string"), b[y].cast("string")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))), F.lit('"/>'))
    rows = boxes.select("g", F.struct("id", part.alias("p")).alias("r")).groupBy("g").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("g", F.concat(F.lit("<svg>"), F.array_join(F.transform("r", lambda e: e["p"]), ""), F.lit("</svg>")).alias("svg"))


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rooms and edges as subject, predicate, object."""
    name = lambda n: F.concat(F.lit("room:"), F.col("g").cast("string"), F.lit("/"), F.col(n).cast("string"))
    kind = nodes.select(name("n").alias("s"), F.lit("type").alias("p"), F.col("role").alias("o"))
    link = edges.select(name("a").alias("s"), F.concat(F.lit("via_"), F.col("via")).alias("p"), name("b").alias("o"))
    return kind.unionByName(link)


def law_articles(pages: DataFrame) -> DataFrame:
    """Articles (no, title, text) of law documents given as XML text in ``xml``; a document that does not parse gives none."""
    schema = "article array<struct<no: string, title: string, text: string>>"
    parsed = F.from_xml("xml", schema, {"mode": "PERMISSIVE"})
    return pages.select("id", F.explode(parsed["article"]).alias("a")).select("id", "a.*")
