"""Row classifiers: ordered waterfalls, collected reasons, registry lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in order of priority, each with its disposition.
DISPOSITION_PRIORITY = [
    ("duplicate", "excl"),
    ("svg_parse_error", "excl"),
    ("empty_svg", "excl"),
    ("empty_layout", "excl"),
    ("untyped_rooms", "fix"),
    ("R4_no_entrance", "fix"),
    ("R1_isolated_component", "fix"),
    ("R3_unreachable_from_entrance", "fix"),
    ("R2_doorless_room", "fix"),
    ("R5_unresolved_doors", "fix"),
]


def waterfall(*steps: tuple[Column, str, str], otherwise: tuple[str, str]) -> tuple[Column, Column]:
    """(group, label): the first step whose condition holds."""
    group, label = F.lit(otherwise[0]), F.lit(otherwise[1])
    for condition, g, name in reversed(steps):
        hit = F.coalesce(condition, F.lit(False))
        group, label = F.when(hit, g).otherwise(group), F.when(hit, name).otherwise(label)
    return group, label


def disposition_of(status: Column, reasons: Column) -> tuple[Column, Column]:
    """A record's disposition from its status and comma list of reasons; a success is used."""
    parts = F.transform(F.split(F.coalesce(reasons, F.lit("")), ","), lambda r: F.substring_index(F.trim(r), ":", 1))
    group, label = waterfall(*((F.array_contains(parts, r), g, r) for r, g in DISPOSITION_PRIORITY), otherwise=("fix", "other"))
    done = F.coalesce(status, F.lit("success")) == "success"
    return F.when(done, "use").otherwise(group), F.when(done, "accepted").otherwise(label)


def collected(*checks: tuple[Column, str]) -> Column:
    """All failing checks in fixed order."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in checks)), lambda x: x.isNotNull())


def corrected_disposition(corrected: Column, passed: Column, status: Column, n_warnings: Column) -> Column:
    """corrected -> done, failed -> excl, warnings -> fix, else use; an unset verdict falls back to the status."""
    ok = F.coalesce(passed, F.coalesce(status, F.lit("success")) == "success")
    return F.when(corrected, "done").when(~ok, "excl").when(n_warnings > 0, "fix").otherwise("use")


def label_category(labels: Column) -> Column:
    """dual / spa_only / str_only / objocr / other from a set of label kinds."""
    has = lambda k: F.array_contains(labels, k)
    return F.when(has("SPA") & has("STR"), "dual").when(has("SPA"), "spa_only").when(has("STR"), "str_only").when(has("OBJ") | has("OCR"), "objocr").otherwise("other")


def with_representatives(df: DataFrame, key: str, order: list, out: str = "first") -> DataFrame:
    """Adds ``out``: whether a row is the least of its key in an order that tells all rows apart.

    The least row is aggregated and joined back: partial sums and the skew join take a key of any size, no window holds it. A null key is a key.
    """
    least = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__least"))
    back = df.join(least.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")))
    return back.withColumn(out, F.struct(*order).eqNullSafe(F.col("__least"))).drop("__key", "__least")


def resolve_prefix(df: DataFrame, column: str, registry: list[tuple[str, str]], out: str) -> DataFrame:
    """A source's registered name: exact, else the first registered prefix in order, else null."""
    exact = F.create_map(*(F.lit(x) for pair in registry for x in pair))
    prefixed = F.coalesce(*(F.when(F.col(column).startswith(prefix), F.lit(name)) for prefix, name in registry))
    return df.withColumn(out, F.coalesce(F.get(F.array(exact[F.col(column)]), F.lit(0)), prefixed))


def filename_parts(stem: Column) -> Column:
    """house, drawing, label, 9-digit key of ``HOUSE_DRAWING_LABEL_KEY``; null if any part is invalid."""
    p = F.split(stem, "_")
    fine = (F.size(p) == 4) & F.get(p, F.lit(0)).isin("APT", "DEH", "ROW") & F.get(p, F.lit(1)).isin("FP", "CS", "EP", "SD") & F.get(p, F.lit(2)).isin("STR", "SPA", "OBJ", "OCR") & F.get(p, F.lit(3)).rlike(r"^\d{9}$")
    return F.when(fine, F.struct(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("house", "drawing", "label", "key")))))
