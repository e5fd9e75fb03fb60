"""Copies of one drawing in other places of sheets: frames, moved corrections, propagation, identity checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def frames(rings: Column, quantum: float = 1.0) -> Column:
    """A struct ``sig, fx, fy, ox, oy``: the signature of a set of rings and the mirroring and origin that give its canonical form.

    Of the four mirror forms, each from its own corner and quantised, corners sorted within a ring and rings sorted, the least counts (of equal ones the plainest).
    """
    xs, ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"]))), F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))

    def form(k: int, fx: int, fy: int) -> Column:
        ox, oy = (F.array_min if fx == 1 else F.array_max)(xs), (F.array_min if fy == 1 else F.array_max)(ys)
        cells = F.array_sort(F.transform(rings, lambda r: F.array_sort(F.transform(r, lambda p: F.struct(F.bround(fx * (p["x"] - ox) / quantum).cast("long").alias("x"), F.bround(fy * (p["y"] - oy) / quantum).cast("long").alias("y"))))))
        return F.struct(cells.alias("cells"), F.lit(k).alias("k"), F.lit(fx).alias("fx"), F.lit(fy).alias("fy"), ox.alias("ox"), oy.alias("oy"))

    least = F.array_min(F.array(*(form(k, fx, fy) for k, (fx, fy) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1))))))
    return F.when(F.size(xs) > 0, F.struct(F.substring(F.sha1(F.to_json(least["cells"])), 1, 16).alias("sig"), least["fx"].alias("fx"), least["fy"].alias("fy"), least["ox"].alias("ox"), least["oy"].alias("oy")))


def to_frame(x: Column, y: Column, t: Column, quantum: float | None = None) -> Column:
    """A point in the canonical frame, quantised if asked."""
    u, v = t["fx"] * (x - t["ox"]), t["fy"] * (y - t["oy"])
    return F.struct(u.alias("x"), v.alias("y")) if quantum is None else F.struct(F.bround(u / quantum).cast("long").alias("x"), F.bround(v / quantum).cast("long").alias("y"))


def moved(x: Column, y: Column, source: Column, target: Column) -> Column:
    """A point of the source drawing in the target drawing."""
    at = to_frame(x, y, source)
    return F.struct((target["fx"] * at["x"] + target["ox"]).alias("x"), (target["fy"] * at["y"] + target["oy"]).alias("y"))


def moved_ring(ring: Column, source: Column, target: Column) -> Column:
    return F.transform(ring, lambda p: moved(p["x"], p["y"], source, target))


def moved_box(box: Column, source: Column, target: Column) -> Column:
    """A box (x0, y0, x1, y1): both corners moved, then ordered."""
    a, b = moved(box["x0"], box["y0"], source, target), moved(box["x1"], box["y1"], source, target)
    return F.struct(F.least(a["x"], b["x"]).alias("x0"), F.least(a["y"], b["y"]).alias("y0"), F.greatest(a["x"], b["x"]).alias("x1"), F.greatest(a["y"], b["y"]).alias("y1"))


def cells(rooms: DataFrame, framed: DataFrame) -> DataFrame:
    """Corrected rooms (``g, n, role, cx, cy``) in their drawing's frame (``g, t``), not quantised: ``g, id, role, x, y``."""
    at = to_frame(F.col("cx"), F.col("cy"), F.col("t"))
    return rooms.where("cx is not null").join(framed.select("g", "t"), "g").select("g", F.col("n").alias("id"), F.coalesce("role", F.lit("?")).alias("role"), at["x"].alias("x"), at["y"].alias("y"))


def centroid_signature(rooms: DataFrame, quantum: float) -> DataFrame:
    """``g, sig``: a signature of a plan's centres and roles that no shift and no mirroring changes."""
    whole = rooms.groupBy("g").agg(F.collect_list(F.struct("cx", "cy", F.coalesce("role", F.lit("")).alias("role"))).alias("c"))

    def form(fx: int, fy: int) -> Column:
        ox, oy = F.array_min(F.transform("c", lambda e: fx * e["cx"])), F.array_min(F.transform("c", lambda e: fy * e["cy"]))
        return F.array_sort(F.transform("c", lambda e: F.struct(F.bround((fx * e["cx"] - ox) / quantum).cast("long").alias("x"), F.bround((fy * e["cy"] - oy) / quantum).cast("long").alias("y"), e["role"].alias("role"))))

    least = F.array_min(F.array(*(form(fx, fy) for fx in (1, -1) for fy in (1, -1))))
    return whole.select("g", F.substring(F.sha1(F.to_json(least)), 1, 16).alias("sig"))


def moved_rooms(rooms: DataFrame, framed: DataFrame, pairs: DataFrame) -> DataFrame:
    """A correction carried to siblings: rooms (``g, n, role, ring``) of ``source`` for every row of ``pairs (source, target)``, in the target's coordinates, under its id."""
    s, t = framed.select(F.col("g").alias("source"), F.col("t").alias("ts")), framed.select(F.col("g").alias("target"), F.col("t").alias("tt"))
    both = pairs.join(s, "source").join(t, "target").join(rooms.withColumnRenamed("g", "source"), "source")
    return both.select(F.col("target").alias("g"), "n", "role", moved_ring(F.col("ring"), F.col("ts"), F.col("tt")).alias("ring"), F.col("source").alias("propagated_from"))


def propagation(members: DataFrame, source: str, mode: str = "fill", tolerance: float = 15.0, force: bool = False) -> DataFrame:
    """What is to happen to each member (``id, corrected, same, error, bad_pixels``) of a source's group: ``id, action, reason``.

    ``fill`` writes to members without a correction; ``unify`` also overwrites different ones, and with ``force`` equal ones too.  Members whose drawing does not line up with the source's (``error``
    above the tolerance) or whose pixels were found to differ are skipped, and say why.
    """
    if mode not in ("fill", "unify"):
        raise ValueError(f"no mode {mode!r}")
    has, same = F.coalesce("corrected", F.lit(False)), F.coalesce("same", F.lit(False))
    reason = (
        F.when(F.col("id") == source, "source")
        .when(F.coalesce("bad_pixels", F.lit(False)), "pixels_differ")
        .when(F.coalesce("error", F.lit(float("inf"))) > tolerance, "misaligned")
        .when(has & F.lit(mode == "fill"), "already_corrected")
        .when(has & same & F.lit(not force), "same_correction")
        .otherwise("")
    )
    action = F.when(reason != "", "skip").when(has, "overwrite").otherwise("write")
    return members.select("id", action.alias("action"), reason.alias("reason"))


def pixel_verdicts(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """``sig, id, bad``: members (``sig, id``) whose pixels (``id, pixels``) differ from most of their group; without a hash nothing is said, of equally frequent ones the least is right."""
    m = members.join(hashes, "id", "left")
    n = m.where("pixels is not null").groupBy("sig", "pixels").agg(F.count("*").alias("n"))
    best = n.groupBy("sig").agg(F.min(F.struct((-F.col("n")).alias("n"), "pixels"))["pixels"].alias("best"))
    return m.join(best, "sig", "left").select("sig", "id", F.coalesce(F.col("pixels") != F.col("best"), F.lit(False)).alias("bad"))


def same_pixels(hashes: DataFrame, groups: DataFrame) -> DataFrame:
    """``pixels, n, n_groups``: contents (``id, pixels``) that more than one drawing has, and in how many groups (``id, sig``) they lie."""
    return hashes.join(groups, "id", "left").groupBy("pixels").agg(F.count("*").alias("n"), F.countDistinct("sig").alias("n_groups")).where("n > 1")


def cross_pairs(hashes: DataFrame, groups: DataFrame, corrected: DataFrame) -> DataFrame:
    """``source, target``: for drawings without a correction, the least corrected one of another group with the same pixels."""
    all_of = hashes.join(groups, "id").join(corrected.select("id").distinct().withColumn("done", F.lit(True)), "id", "left")
    sources = all_of.where("done").groupBy("pixels", "sig").agg(F.min("id").alias("source"))
    two = sources.groupBy("pixels").agg(F.min(F.struct("source", "sig")).alias("a"), F.count("*").alias("k"))
    rest = sources.join(two.where("k > 1"), "pixels").where(F.col("sig") != F.col("a.sig")).groupBy("pixels").agg(F.min("source").alias("b"))
    best = two.join(rest, "pixels", "left")
    open_ones = all_of.where("done is null").join(best, "pixels")
    source = F.when(F.col("a.sig") != F.col("sig"), F.col("a.source")).otherwise(F.col("b"))
    return open_ones.select(source.alias("source"), F.col("id").alias("target")).where("source is not null")


def identity_checks(files: DataFrame) -> DataFrame:
    """``crc, size, n, n_digests, identical``: whether files of equal checksum and size have one content (``crc, size, content``)."""
    g = files.groupBy("crc", "size").agg(F.count("*").alias("n"), F.countDistinct(F.sha2("content", 256)).alias("n_digests"))
    return g.where("n > 1").withColumn("identical", F.col("n_digests") == 1)


def copies_agree(rooms: DataFrame, copies: DataFrame) -> DataFrame:
    """``source, target, same``: whether copies (``source, target``) hold the same roles and areas as their source."""
    sig = rooms.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.round("area", 1).alias("area")))).alias("s"))
    a, b = sig.select(F.col("g").alias("source"), F.col("s").alias("sa")), sig.select(F.col("g").alias("target"), F.col("s").alias("sb"))
    return copies.join(a, "source", "left").join(b, "target", "left").select("source", "target", F.col("sa").eqNullSafe(F.col("sb")).alias("same"))


def overrides_checked(rows: DataFrame, confirmed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, want, got``: confirmed values that a row does not have (``got`` null if the row is gone)."""
    want = confirmed.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("want")) for f in fields))).alias("c")).select(key, "c.*").where("want is not null")
    got = rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("got")) for f in fields))).alias("c")).select(key, "c.*")
    return want.join(got, [key, "field"], "left").where(~F.col("want").eqNullSafe(F.col("got")))


DERIVATIONS: dict = {}


def derivation(name: str):
    """Registers a function of a map of role counts by name."""

    def add(f):
        DERIVATIONS[name] = f
        return f

    return add


def normalised_roles(counts: Column, mapping: Mapping[str, str], derive: str | None = None) -> Column:
    """Role counts after a (closed) role map and, if named, a registered derivation: an array of (role, n) in order."""
    from .roles import lookup
    from .units import resolved_roles

    closed = resolved_roles(dict(mapping))
    entries = F.transform(F.map_entries(counts), lambda e: F.struct(lookup(closed, e["key"], e["key"]).alias("key"), e["value"].cast("long").alias("value")))
    merged = F.aggregate(entries, F.create_map().cast("map<string,bigint>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(F.coalesce(F.try_element_at(acc, e["key"]), F.lit(0).cast("long")) + e["value"]))))
    return F.array_sort(F.map_entries(DERIVATIONS[derive](merged) if derive else merged))
