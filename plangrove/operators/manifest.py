"""Entries, labels and manifests: indexes, joins with labels, raw dispositions, provenance, combinations, recipes."""

from __future__ import annotations

import hashlib
import os
import platform
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .roles import lookup

#: Raw dispositions and their display groups by (disposition, reason).
RAW_LABELS = {
    ("use", "dual"): "use: dual",
    ("use", "dual_dedup_merge"): "use: dual",
    ("use", "v2v_str_recovered"): "use: rooms only, structure recovered",
    ("use", "v2v_spa_recovered"): "use: structure only, rooms recovered",
    ("fix", "convert_failed"): "fix: conversion failed",
    ("fix", "spa_only_pending"): "fix: rooms only, pending",
    ("fix", "str_only_pending"): "fix: structure only, pending",
    ("fix", "objocr"): "fix: objects and text only",
    ("excl", "nonfp"): "excl: no floor plan",
    ("excl", "duplicate"): "excl: duplicate",
}


def label_index(entries: DataFrame, labels: list[str], order: list[str]) -> DataFrame:
    """``label, key, zip, entry``: where each label of floor plans lies; of entries that share a key the last in order counts."""
    rows = entries.where((F.col("drawing") == "FP") & F.col("label").isin(*labels))
    return rows.groupBy("label", "key").agg(F.max_by(F.struct("zip", "entry"), F.struct(*order)).alias("at")).select("label", "key", "at.zip", "at.entry")


def first_of(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of parts by key: the first part that holds a key wins, inside a part the least row."""
    tagged = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in parts[0].columns if c not in keys]
    return both.groupBy(*keys).agg(F.min(F.struct("__part", *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def predicted_index(files: DataFrame) -> DataFrame:
    """``label, key, path`` of prediction files named ``LABEL_key.json``; other names are passed over, of equal keys the last path counts."""
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    rows = files.select("path", F.regexp_extract(name, r"^([A-Z]+)_(.+)$", 1).alias("label"), F.regexp_extract(name, r"^([A-Z]+)_(.+)$", 2).alias("key")).where("label <> ''")
    return rows.groupBy("label", "key").agg(F.max("path").alias("path"))


def corpus(drawings: DataFrame, index: DataFrame, predicted: DataFrame, labels: list[str], house: str | None = None) -> DataFrame:
    """One row a drawing (``drawing, house, key_<label>...``) with where each label lies: the real one, else the predicted one; ``kind_<label>`` says which (label, v2v) or is null."""
    out = drawings if house is None else drawings.where(F.col("house") == house)
    for name in labels:
        real = index.where(F.col("label") == name).select(F.col("key").alias(f"key_{name}"), F.struct("zip", "entry").alias("__real"))
        guess = predicted.where(F.col("label") == name).select(F.col("key").alias("drawing"), F.col("path").alias("__guess"))
        out = out.join(real, f"key_{name}", "left").join(guess, "drawing", "left")
        out = out.withColumns({f"at_{name}": F.when(F.col("__real").isNotNull(), F.concat_ws("!", F.col("__real.zip"), F.col("__real.entry"))).otherwise(F.col("__guess")), f"kind_{name}": F.when(F.col("__real").isNotNull(), "label").when(F.col("__guess").isNotNull(), "v2v")}).drop("__real", "__guess")
    return out


def paired(pairs: DataFrame, index: DataFrame, labels: list[str]) -> DataFrame:
    """Pairs (``gid, key_<label>...``) all of whose labels are indexed; of rows that share a gid the least keys stay."""
    out = pairs
    for name in labels:
        at = index.where(F.col("label") == name).select(F.col("key").alias(f"key_{name}"), F.col("zip").alias(f"zip_{name}"), F.col("entry").alias(f"entry_{name}"))
        out = out.join(at, f"key_{name}")
    rest = [f"{c}_{name}" for name in labels for c in ("key", "zip", "entry")]
    return out.groupBy("gid").agg(F.min(F.struct(*rest)).alias("m")).select("gid", *(F.col(f"m.{c}").alias(c) for c in rest))


def provenance(spa: Column, structure: Column) -> Column:
    """dual, spa_only, str_only or objocr from the kinds (label, v2v, null) of the two labels; only real labels count."""
    a, b = F.coalesce(spa == "label", F.lit(False)), F.coalesce(structure == "label", F.lit(False))
    return F.when(a & b, "dual").when(a, "spa_only").when(b, "str_only").otherwise("objocr")


def raw_disposition(category: Column, became_graph: Column, merged: Column, at: str) -> Column:
    """A struct ``disposition, reason, corrected`` of a raw entry from its label category and whether a graph came of it; ``corrected`` says how a use was recovered."""
    how = "struct<from:string,method:string,at:string,by:string>"

    def made(disposition: str, reason: str, start: str | None = None, method: str | None = None, by: str | None = None) -> Column:
        note = F.struct(F.lit(start).alias("from"), F.lit(method).alias("method"), F.lit(at).alias("at"), F.lit(by).alias("by")) if method else F.lit(None)
        return F.struct(F.lit(disposition).alias("disposition"), F.lit(reason).alias("reason"), note.cast(how).alias("corrected"))

    done, joined = F.coalesce(became_graph, F.lit(False)), F.coalesce(merged, F.lit(False))
    return (
        F.when(category == "nonfp", made("excl", "nonfp"))
        .when(category == "objocr", made("fix", "objocr"))
        .when((category == "dual") & done & joined, made("use", "dual_dedup_merge", "convert_failed", "fingerprint_label_union(SPA+STR)", "recover_dedup_merge"))
        .when((category == "dual") & done, made("use", "dual"))
        .when(category == "dual", made("fix", "convert_failed"))
        .when((category == "spa_only") & done, made("use", "v2v_str_recovered", "spa_only", "v2v_str", "v2v"))
        .when(category == "spa_only", made("fix", "spa_only_pending"))
        .when((category == "str_only") & done, made("use", "v2v_spa_recovered", "str_only", "v2v_spa", "v2v"))
        .when(category == "str_only", made("fix", "str_only_pending"))
        .otherwise(made("fix", "other"))
    )


def graph_origin(category: Column) -> Column:
    """Whether a graph came straight from labels or through a predicted one."""
    return F.when(category.isin("spa_only", "str_only"), "v2v").otherwise("direct")


def raw_label(disposition: Column, reason: Column, labels: Mapping[tuple[str, str], str] = RAW_LABELS) -> Column:
    """The display group of a manifest row; a pair without one is written out."""
    key = F.concat_ws("\x00", disposition, reason)
    return lookup({"\x00".join(k): v for k, v in labels.items()}, key, F.concat_ws("/", disposition, reason))


def row_units(graph_ids: Column) -> Column:
    """Units of a manifest row: its graphs; copies and rows without any have none."""
    return F.coalesce(F.size(graph_ids), F.lit(0))


def provenance_map(manifest: DataFrame) -> DataFrame:
    """``graph_id, reason`` of every graph that a manifest row (``graph_ids, reason``) lists."""
    return manifest.select(F.explode("graph_ids").alias("graph_id"), "reason")


def corrected_combo(manifest: DataFrame, graphs: DataFrame, labels: Mapping[str, str], missing: str = "fix: not built") -> DataFrame:
    """``label, drawings, units``: manifest rows (``fingerprint, reason``) by what the built graphs (``fingerprint, source``) say; copies and drawings of other kinds count no units."""
    built = graphs.groupBy("fingerprint").agg(F.min("source").alias("source"), F.count("*").alias("units"))
    rows = manifest.join(built, "fingerprint", "left")
    out = F.col("reason").isin("duplicate", "nonfp")
    label = F.when(out, F.concat(F.lit("excl: "), "reason")).when(F.col("source").isNotNull(), lookup(labels, F.col("source"), missing)).otherwise(F.lit(missing))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("drawings"), F.sum(F.when(out, 0).otherwise(F.coalesce("units", F.lit(0)))).alias("units"))


def scaled_sheet(records: DataFrame, sheet: str, scale: float | None) -> DataFrame:
    """Records with one sheet's scale set: its units become usable, or go to quarantine if the scale is null."""
    mine = S.sheet_key(F.col("graph_id")) == sheet
    value = F.lit(scale).cast("double")
    return records.withColumns({"scale": F.when(mine, value).otherwise(F.col("scale")), "status": F.when(mine, "success" if scale else "quarantine").otherwise(F.col("status")), "reason": F.when(mine, "" if scale else "scale_missing").otherwise(F.col("reason"))})


def categories(groups: DataFrame) -> DataFrame:
    """``category, house, n`` of fingerprint groups (``labels, house``)."""
    from .classify import label_category

    return groups.groupBy(label_category(F.col("labels")).alias("category"), "house").agg(F.count("*").alias("n"))


def coverage(index: DataFrame, required: list[str]) -> DataFrame:
    """``key, labels, complete``: the labels that each key has, and whether all required ones are among them."""
    sets = index.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    need = F.array(*map(F.lit, required))
    return sets.withColumn("complete", F.size(F.array_intersect("labels", need)) == len(set(required)))


# recipes and releases


def load_recipe(version: str, recipe: dict | None = None, folder: str | None = None) -> dict:
    """A recipe: the one given, else the file ``<folder>/<version>.json``, else the default (accepted benchmark rows of one household)."""
    if recipe is not None:
        return recipe
    if folder:
        import json

        path = os.path.join(folder, f"{version}.json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return json.load(f)
    return {"version": version, "include": [{"source": "benchmark", "status": "success"}], "test_from": ["benchmark"], "clean_filter": "entrances==1"}


def collect(records: DataFrame, entry: Mapping, reasons: DataFrame | None = None) -> DataFrame:
    """The records (``graph_id, source, status, ...``) that a recipe's entry asks for: source, status and, where it names any, reasons of the provenance map."""
    status = entry.get("status", "success")
    rows = records.where((F.col("source") == entry["source"]) & (F.coalesce("status", F.lit("success")) == status))
    if entry.get("provenance"):
        wanted = reasons.where(F.col("reason").isin(*entry["provenance"])).select("graph_id").distinct()
        rows = rows.join(wanted, "graph_id", "left_semi")
    return rows


def freeze(records: DataFrame, recipe: Mapping, reasons: DataFrame | None = None, test_sheets: DataFrame | None = None, roles: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(release rows ``graph_id, source, sheet, split``, left out rows ``source, reason, n``) of a recipe over records with ``n_entrances, n_living``.

    Benchmark sources keep plans of one household and have a test split: the frozen sheets if given, else by the sheet's bucket.  Other sources keep all rows and have train and val only.
    """
    test_from, roles = set(recipe.get("test_from", ())), roles or {}
    kept, out = [], []
    for entry in recipe["include"]:
        rows = collect(records, entry, reasons).withColumn("sheet", S.sheet_key(F.col("graph_id")))
        bucket = S.split_of(F.col("sheet"))
        role = entry.get("role") or roles.get(entry["source"], "pretrain")
        if entry["source"] in test_from or role == "benchmark":
            why = F.when(F.col("n_entrances") == 0, "no_entrance").when((F.col("n_entrances") >= 2) | (F.col("n_living") >= 2), "multi_household").otherwise("")
            rows = rows.withColumn("__why", why)
            out.append(rows.where("__why <> ''").groupBy("source", F.col("__why").alias("reason")).agg(F.count("*").alias("n")))
            rows = rows.where("__why = ''")
            if test_sheets is not None:
                rows = rows.join(test_sheets.select("sheet").distinct().withColumn("__t", F.lit(True)), "sheet", "left")
                split = F.when(F.col("__t"), "test").when(bucket == "val", "val").otherwise("train")
            else:
                split = bucket
        else:
            split = F.when(bucket == "val", "val").otherwise("train")
        kept.append(rows.select("graph_id", "source", "sheet", split.alias("split")))
    if not kept:
        raise ValueError("the recipe includes nothing")
    none = kept[0].sparkSession.createDataFrame([], "source string, reason string, n long")
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, out, none)


def release_counts(release: DataFrame) -> DataFrame:
    """``source, n_graphs, n_sheets, train, val, test`` of a frozen release."""
    count = lambda s: F.count_if(F.col("split") == s).alias(s)
    return release.groupBy("source").agg(F.count("*").alias("n_graphs"), F.countDistinct("sheet").alias("n_sheets"), count("train"), count("val"), count("test"))


def list_releases(folder: str, lines: list[str]) -> list[tuple[str, str, str]]:
    """(version, line, path) of all releases with a manifest: those in line folders, then older ones beside them whose version no line holds."""
    found: dict[str, tuple[str, str, str]] = {}
    for line in [*lines, ""]:
        base = os.path.join(folder, line)
        for name in sorted(os.listdir(base)) if os.path.isdir(base) else ():
            path = os.path.join(base, name)
            if name not in lines and name not in found and os.path.exists(os.path.join(path, "manifest.json")):
                found[name] = (name, line, path)
    return list(found.values())


def release_path(folder: str, lines: list[str], version: str) -> str:
    """Where a release lies: in the first line folder that has it, else beside them."""
    return next((p for line in lines if os.path.exists(p := os.path.join(folder, line, version))), os.path.join(folder, version))


def environment(spark: SparkSession) -> dict[str, str]:
    """What a run was made with."""
    return {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "system": platform.system()}


def weight_fingerprint(path: str) -> dict:
    """A file's digest (16 digits of sha256), size and time, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    info = os.stat(path)
    return {"sha256": digest.hexdigest()[:16], "size": info.st_size, "mtime": int(info.st_mtime)}


def folder_key(folder: str) -> tuple[int, int]:
    """(number of files, latest time) of a folder: the key under which results over it are kept."""
    files = [e for e in os.scandir(folder) if e.is_file()]
    return len(files), int(max((e.stat().st_mtime for e in files), default=0))


class Remembered:
    """Results of computations over folders, made again only when a folder's :func:`folder_key` or the extra key has changed."""

    def __init__(self):
        self._held: dict[str, tuple] = {}

    def get(self, folder: str, name: str, compute: Callable, extra: tuple = ()):
        key = (folder, *folder_key(folder), *extra)
        if name not in self._held or self._held[name][0] != key:
            self._held[name] = (key, compute())
        return self._held[name][1]
