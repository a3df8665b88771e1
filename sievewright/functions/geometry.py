"""Boxes and crops as Column arithmetic. A box is a struct<x, y, w, h: int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    return F.struct(*(c.cast("int").alias(n) for n, c in zip("xywh", (x, y, w, h), strict=True)))


def area(b: Column) -> Column:
    return F.greatest(b["w"], F.lit(0)) * F.greatest(b["h"], F.lit(0))


def center(b: Column) -> tuple[Column, Column]:
    return b["x"] + b["w"] / 2.0, b["y"] + b["h"] / 2.0


def corners(b: Column) -> Column:
    return F.struct(b["x"].alias("x1"), b["y"].alias("y1"), (b["x"] + b["w"]).alias("x2"), (b["y"] + b["h"]).alias("y2"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def normalised_box(x, y, w, h) -> Column:
    """A detector's box: corner not below 0, sides not below 1, fractions cut off."""
    return box(F.greatest(x.cast("int"), F.lit(0)), F.greatest(y.cast("int"), F.lit(0)), F.greatest(w.cast("int"), F.lit(1)), F.greatest(h.cast("int"), F.lit(1)))


def _round(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def landmark_crop(b: Column, width: Column, height: Column, pad: float = 0.7) -> Column:
    """Padded square around the box, clamped to the frame; the box itself where nothing is left."""
    cx, cy = center(b)
    half = F.greatest(b["w"], b["h"]) * (1.0 + pad) / 2.0
    x1, y1 = F.greatest(F.lit(0.0), cx - half).cast("int"), F.greatest(F.lit(0.0), cy - half).cast("int")
    x2, y2 = F.least(width.cast("double"), cx + half).cast("int"), F.least(height.cast("double"), cy + half).cast("int")
    bad = (x2 <= x1) | (y2 <= y1)
    pick = lambda own, raw: F.when(bad, raw).otherwise(own)
    return F.struct(pick(x1, b["x"]).alias("x1"), pick(y1, b["y"]).alias("y1"), pick(x2, b["x"] + b["w"]).alias("x2"), pick(y2, b["y"] + b["h"]).alias("y2"))


def face_crop(b: Column, expand: float = 2.6) -> Column:
    """Square around head, hair and neck; may reach over the frame's border, where the image is mirrored."""
    cx, cy = center(b)
    side, cy = F.greatest(b["w"], b["h"]) * expand, cy - b["h"] * 0.15
    return F.struct(_round(cx - side / 2).alias("x1"), _round(cy - side / 2).alias("y1"), _round(cx + side / 2).alias("x2"), _round(cy + side / 2).alias("y2"))


def portrait_crop(b: Column, height: Column, expand: float = 2.4, least: float = 0.7) -> Column:
    """4:5 crop of head and shoulders; null if the frame shows less than `least` of its height."""
    cx, _ = center(b)
    w = b["w"] * expand
    h = w * 5 / 4
    top = b["y"] - b["h"] * 0.9
    seen = F.least(top + h, height.cast("double")) - F.greatest(top, F.lit(0.0))
    crop = F.struct(_round(cx - w / 2).alias("x1"), _round(top).alias("y1"), _round(cx + w / 2).alias("x2"), _round(top + h).alias("y2"))
    return F.when((h > 0) & (seen / h >= least), crop)


def body_crop(b: Column, width: Column, height: Column) -> Column:
    """Wide crop over the frame's whole height."""
    cx, _ = center(b)
    half = F.least(width.cast("double"), b["w"] * 4.0) / 2
    return F.struct(_round(cx - half).alias("x1"), F.lit(0).alias("y1"), _round(cx + half).alias("x2"), height.cast("int").alias("y2"))


def clothing_region(b: Column, width: Column, height: Column) -> Column:
    """The region under the face; null if the frame has none of it."""
    y1 = F.least(height.cast("int"), b["y"] + (b["h"] * 1.3).cast("int"))
    y2 = F.least(height.cast("int"), y1 + (b["h"] * 1.2).cast("int"))
    side = (b["w"] * 0.3).cast("int")
    x1, x2 = F.greatest(F.lit(0), b["x"] - side), F.least(width.cast("int"), b["x"] + b["w"] + side)
    return F.when((y2 > y1) & (x2 > x1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def working_size(width: Column, height: Column, target: int = 512) -> Column:
    """Size whose longer side is target; never larger than the image, no side under 1."""
    longest = F.greatest(width, height)
    scale = F.lit(float(target)) / longest
    fit = F.struct(F.greatest(F.lit(1), _round(width * scale)).alias("w"), F.greatest(F.lit(1), _round(height * scale)).alias("h"))
    return F.when(longest <= target, F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))).otherwise(fit)
