"""Boxes: centre form and corners, overlap, pixels, size buckets.

A centre-form box is a struct with cx, cy, w, h; corners are a struct with
x1, y1, x2, y2.  Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Buckets of plate width in pixels, with their lower bounds, and the width below which a plate can't be read.
SIZE_BUCKETS = (("tiny (<32px)", 0.0), ("small (32-64px)", 32.0), ("medium (64-128px)", 64.0), ("large (>=128px)", 128.0))
MIN_READABLE_PX = 32.0
#: Tolerance of the bounds of normalised boxes, and the smallest side after clipping.
EPS = 1e-6
IOU_THRESHOLD = 0.5


def corners(box: Column) -> Column:
    """Corners of a centre-form box."""
    half_w, half_h = box["w"] / 2, box["h"] / 2
    return F.struct((box["cx"] - half_w).alias("x1"), (box["cy"] - half_h).alias("y1"), (box["cx"] + half_w).alias("x2"), (box["cy"] + half_h).alias("y2"))


def box_area(box: Column) -> Column:
    return box["w"] * box["h"]


def pixel_size(box: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(width, height) of a centre-form box in pixels, not rounded."""
    return box["w"] * width, box["h"] * height


def clipped(box: Column) -> Column:
    """The box cut to the image, in centre form; no side below EPS."""
    c = corners(box)
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    x1, y1, x2, y2 = (clamp(c[k]) for k in ("x1", "y1", "x2", "y2"))
    return F.struct(((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), F.greatest(F.lit(EPS), x2 - x1).alias("w"), F.greatest(F.lit(EPS), y2 - y1).alias("h"))


def valid_box(box: Column) -> Column:
    """Whether a box lies in the image: sides in (0, 1], centre in [0, 1], within EPS; false for nulls and NaN."""
    inside = lambda k: box[k].between(-EPS, 1 + EPS)
    side = lambda k: (box[k] > 0) & (box[k] <= 1 + EPS)
    return F.coalesce(inside("cx") & inside("cy") & side("w") & side("h"), F.lit(False))


def corner_area(box: Column) -> Column:
    """Area of corners; sides that are turned round count as 0."""
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"]) * F.greatest(F.lit(0.0), box["y2"] - box["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes in corners; 0 where they only touch, lie apart or have no area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = w * h
    union = corner_area(a) + corner_area(b) - both
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(both / F.when(union != 0, union))


def pixel_corners(box: Column, width: Column, height: Column) -> Column:
    """Corners in whole pixels, cut toward zero."""
    return F.struct(*((box[k] * size).cast("int").alias(k) for k, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height))))


def crop_rectangle(box: Column, width: Column, height: Column, padding: float = 0.08) -> Column:
    """The padded pixel rectangle to cut out for a box in corners, kept inside the image; null where nothing is left."""
    pad_x, pad_y = (box["x2"] - box["x1"]) * width * padding, (box["y2"] - box["y1"]) * height * padding
    x1 = F.greatest(F.lit(0), (box["x1"] * width - pad_x).cast("int"))
    y1 = F.greatest(F.lit(0), (box["y1"] * height - pad_y).cast("int"))
    x2 = F.least(width.cast("int"), (box["x2"] * width + pad_x).cast("int"))
    y2 = F.least(height.cast("int"), (box["y2"] * height + pad_y).cast("int"))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def size_bucket(width_px: Column) -> Column:
    """The size bucket of a width; negative widths, NaN and null fall into the last one."""
    names = [n for n, _ in SIZE_BUCKETS]
    low = [b for _, b in SIZE_BUCKETS]
    out = None
    for name, a, b in zip(names, low, low[1:]):
        hit = (width_px >= a) & (width_px < b)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(names[-1])


def primary_region(boxes: Column) -> Column:
    """The most frequent known region of an image's boxes (ties: the lowest code); XX if none is known."""
    known = F.filter(F.transform(boxes, lambda b: b["region"]), lambda r: r.isNotNull() & (r != "XX"))
    counted = F.transform(F.array_distinct(known), lambda r: F.struct(F.size(F.filter(known, lambda x: x == r)).alias("n"), r.alias("r")))
    best = F.array_sort(counted, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["r"] < b["r"], -1).when(a["r"] > b["r"], 1).otherwise(0))
    return F.coalesce(F.try_element_at(best, F.lit(1))["r"], F.lit("XX"))
