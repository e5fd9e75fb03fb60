"""Annotations to typed elements, drawings and scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from .roles import element_kind

RING = "array<struct<x:double,y:double>>"
_ELEMENT = f"struct<ring:{RING},area:double,cx:double,cy:double,from_box:boolean,broken:boolean>"


def element(segmentation, bbox, area) -> dict:
    """The largest valid ring of a segmentation, else the rectangle of its box (x, y, width, height); broken if a segmentation gave neither."""
    ring, from_box = shapes.largest(segmentation), False
    if ring is None and bbox and len(bbox) == 4 and bbox[2] > 0 and bbox[3] > 0:
        x, y, w, h = bbox
        ring, from_box = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], True
    if ring is None:
        return {"ring": None, "area": area, "cx": None, "cy": None, "from_box": False, "broken": bool(segmentation)}
    cx, cy = shapes.centroid(ring)
    return {"ring": [{"x": x, "y": y} for x, y in ring], "area": abs(shapes.signed_area(ring)), "cx": cx, "cy": cy, "from_box": from_box, "broken": False}


def elements(annotations: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Annotations (``g, class_name, segmentation, bbox, area``) as elements ``g, kind, i, name, ring, area, cx, cy, from_box, broken``; classes of no kind are left out.

    Elements of a kind are numbered from 0 by ``ann_id`` and corners.
    """
    from pyspark.sql import Window

    rows = annotations.withColumn("kind", element_kind(F.col("class_name"), kinds)).where("kind is not null")
    shaped = rows.withColumn("e", shapes.column(lambda seg, box, area: element(seg, box, area), _ELEMENT)(F.coalesce("segmentation", F.array().cast("array<array<double>>")), "bbox", F.col("area").cast("double")))
    number = F.row_number().over(Window.partitionBy("g", "kind").orderBy("ann_id", "e.cx", "e.cy")) - 1
    return shaped.select("g", "kind", number.alias("i"), F.col("class_name").alias("name"), "e.*")


def drawing_header(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``g, width, height, broken`` and the number of elements of each drawing whose documents (``g, width, height``) may be several."""
    size = docs.groupBy("g").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    n = found.groupBy("g").agg(F.count_if(~F.col("broken")).alias("n_elements"), F.count_if("broken").alias("broken"))
    return size.join(n, "g", "left").select("g", "width", "height", F.coalesce("n_elements", F.lit(0)).alias("n_elements"), F.coalesce("broken", F.lit(0)).alias("broken"))


def door_scale(doors: DataFrame, millimetres: float = 900.0) -> DataFrame:
    """``g, mm_per_px``: a standard door's width over the middle of the longest extents of a plan's doors (``g, ring``); extents of a pixel or less do not count."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    extent = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    sizes = doors.select("g", extent.alias("e")).where("e > 1").groupBy("g").agg(F.median("e").alias("m"))
    return sizes.select("g", F.round(millimetres / F.col("m"), 4).alias("mm_per_px"))


def text_scale(rooms: DataFrame) -> DataFrame:
    """``g, m_per_px``: the root of the real areas printed as ``a x b`` (metres) over the areas of the rooms' boxes; rooms without a print do not count."""
    found = F.regexp_extract_all(F.replace("dimension", F.lit(","), F.lit(".")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    real = F.get(found, F.lit(0)).try_cast("double") * F.get(found, F.lit(1)).try_cast("double")
    box = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    sums = rooms.select("g", real.alias("real"), box.alias("px")).where("real > 0 and px > 0").groupBy("g").agg(F.sum("real").alias("r"), F.sum("px").alias("p"))
    return sums.select("g", F.sqrt(F.col("r") / F.col("p")).alias("m_per_px"))


def normalised_centre(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A centre as shares of the drawing's size, 4 digits; null if anything is missing or the size is 0."""
    ok = x.isNotNull() & y.isNotNull() & (width > 0) & (height > 0)
    return F.when(ok, F.struct(F.round(x / width, 4).alias("x"), F.round(y / height, 4).alias("y")))


def opening_width(x0: Column, y0: Column, x1: Column, y1: Column, angle: Column, scale: Column, low_m: float, high_m: float) -> Column:
    """Extent of a box along a wall's direction (degrees), null outside the bounds in metres (``scale``: millimetres a pixel; without it there are no bounds)."""
    level = F.abs(F.cos(F.radians(angle))) >= F.abs(F.sin(F.radians(angle)))
    px = F.when(level, x1 - x0).otherwise(y1 - y0)
    metres = px * scale / 1000.0
    return F.when(scale.isNull() | metres.between(low_m, high_m), px)
