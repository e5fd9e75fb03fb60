"""Document sources: annotation JSON, ledgers in JSON lines and CSV, drawings in SVG, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed

#: Annotation documents in the common object-detection layout; segmentation is read as text, since it is flat or nested.
ANNOTATIONS = """categories array<struct<id: long, name: string>>, images array<struct<file_name: string, width: int, height: int>>,
annotations array<struct<id: long, category_id: long, segmentation: string, bbox: array<double>, area: double, attributes: map<string, string>>>"""
LEDGER = "logged string, kind string, run_id string, generator string, version string, house_type string, n long, integrity double, legal double, adj_L1 double, diversity double, novelty double"
EDIT_LOG = "ts string, actor string, kind string, plan_id string, target string, field string, before string, after string, rule string, n long, note string"


def annotation_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ANNOTATIONS}, _corrupt_record string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("path", F.col("_metadata.file_path"))


def annotations(docs: DataFrame) -> DataFrame:
    """One row per annotation with its class name by the document's own categories; segmentations as lists of rings."""
    names = F.map_from_entries(F.transform("categories", lambda c: F.struct(c["id"], c["name"])))
    rows = docs.select("path", F.col("images")[0].alias("image"), names.alias("names"), F.explode("annotations").alias("a"))
    nested = F.from_json("a.segmentation", "array<array<double>>")
    flat = F.from_json("a.segmentation", "array<double>")
    rings = F.when(F.col("a.segmentation").rlike(r"^\s*\[\s*\["), nested).otherwise(F.array(flat))
    class_name = F.coalesce(F.try_element_at("names", F.col("a.category_id")), F.col("a.category_id").cast("string"))
    return rows.select("path", "image.file_name", "image.width", "image.height", F.col("a.id").alias("ann_id"), class_name.alias("class_name"), rings.alias("segmentation"), "a.bbox", "a.area", "a.attributes")


def ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, a field that a kind lacks is null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def broken_lines(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """The lines that :func:`ledger` skips."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed["_corrupt_record"].alias("_corrupt_record")).where("_corrupt_record is not null")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds the time of logging and appends."""
    rows.withColumn("logged", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").json(path)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


def append_decisions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def checked_edits(log: DataFrame, actors: list[str], kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edits whose actor and kind are known, the others)."""
    fine = F.col("actor").isin(*actors) & F.col("kind").isin(*kinds)
    return log.where(F.coalesce(fine, F.lit(False))), log.where(~F.coalesce(fine, F.lit(False)))


def svg_regions(binary: DataFrame) -> DataFrame:
    """Rooms of SVG drawings as rows (path, class, points); a drawing that cannot be parsed gives one quarantine row."""
    text = F.decode("content", "UTF-8")
    polygon = r'<polygon[^>]*class="([^"]*)"[^>]*points="([^"]*)"'
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(polygon), F.lit(1)).alias("class"), F.regexp_extract_all(text, F.lit(polygon), F.lit(2)).alias("points"))
    rows = binary.select("path", F.contains(text, F.lit("<svg")).alias("ok"), F.explode_outer(both).alias("r"))
    numbers = F.transform(F.regexp_extract_all("r.points", F.lit(r"(-?[\d.]+)[, ](-?[\d.]+)"), F.lit(0)), lambda p: F.struct(F.split(p, "[, ]")[0].try_cast("double").alias("x"), F.split(p, "[, ]")[1].try_cast("double").alias("y")))
    status = F.when(~F.col("ok"), "svg_parse_error").when(F.col("r").isNull(), "empty_svg").otherwise("success")
    return rows.select("path", F.col("r.class").alias("class"), numbers.alias("ring"), status.alias("status"))


def write_release(graphs: DataFrame, path: str) -> None:
    """A frozen release: rows by version and split. An existing version is replaced as a whole, splits that the new one lacks included; others stay."""
    graphs = checkpointed(graphs)  # it may be read from the folder it is written to
    for r in graphs.select("version").distinct().toLocalIterator():
        rows = graphs.where(F.col("version") == r["version"]).drop("version")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split").parquet(f"{path}/version={r['version']}")


def read_split(spark: SparkSession, path: str, version: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("version") == version) & (F.col("split") == split))


def migrate(records: DataFrame) -> DataFrame:
    """Brings records to the current schema: fills role, tier, status and reason, bumps the version, tells what changed."""
    new = {"role": F.coalesce("role", F.lit("benchmark")), "tier": F.coalesce("tier", F.lit(1)), "status": F.coalesce("status", F.lit("success")), "reason": F.coalesce("reason", F.lit("")), "schema_version": F.lit("0.2")}
    changed = ~(F.col("role").isNotNull() & F.col("tier").isNotNull() & F.col("status").isNotNull() & F.col("reason").isNotNull() & F.col("schema_version").eqNullSafe(F.lit("0.2")))
    return records.withColumn("changed", changed).withColumns(new)
