"""Sub-scores of an image's quality and their weighted mean."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import QualityWeights
from .geometry import area


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def sharpness(variance: Column, midpoint: float = 350.0) -> Column:
    """Of the variance of the Laplacian: saturates towards 1; null (an empty image) is 0."""
    return F.coalesce(variance / (variance + midpoint), F.lit(0.0))


def exposure_of(low: Column, high: Column, mean: Column) -> Column:
    """From the shares of pixels under 5 and from 251, and the mean luminance; null (an empty image) is 0."""
    clipped = F.least(F.lit(1.0), (low + high) * 3.0)
    off = F.least(F.lit(1.0), F.abs(mean - 128.0) / 128.0)
    known = low.isNotNull() & high.isNotNull() & mean.isNotNull()  # least and greatest pass nulls over
    return F.when(known, clip01(1.0 - 0.7 * clipped - 0.3 * off)).otherwise(0.0)


def exposure(gray: Column) -> Column:
    """Of an array of luminances 0 to 255."""
    n = F.nullif(F.size(gray), F.lit(0))
    low, high = F.size(F.filter(gray, lambda x: x < 5)) / n, F.size(F.filter(gray, lambda x: x >= 251)) / n
    total = F.aggregate(gray, F.lit(0).cast("long"), lambda a, x: a + x)
    return exposure_of(low, high, total / n)


def face_resolution(b: Column, target: int = 220) -> Column:
    return clip01(area(b) / float(target * target)) if target > 0 else F.lit(0.0)


def obstruction(b: Column, width: Column, height: Column, plausibility: Column, margin: int = 2) -> Column:
    touches = (b["x"] <= margin) | (b["y"] <= margin) | (b["x"] + b["w"] >= width - margin) | (b["y"] + b["h"] >= height - margin)
    return clip01(0.5 * (1.0 - F.when(touches, 0.4).otherwise(0.0)) + 0.5 * plausibility)


def plausibility(points: Column, slack: float = 0.05) -> Column:
    """Share of points (struct x, y) inside the slightly padded unit square; 0 without points."""
    ok = F.filter(points, lambda p: p["x"].between(-slack, 1 + slack) & p["y"].between(-slack, 1 + slack))
    return F.coalesce(F.size(ok) / F.nullif(F.size(points), F.lit(0)), F.lit(0.0))


def landmark_confidence(detection: Column, plausible: Column) -> Column:
    return clip01(detection * (0.5 + 0.5 * plausible))


def overall(parts: dict[str, Column], weights: QualityWeights = QualityWeights()) -> Column:
    """Weighted mean of the six sub-scores, named as the weights are."""
    by = vars(weights)
    total = sum(by.values())
    score = sum((F.lit(by[k]) * parts[k] for k in by), F.lit(0.0))
    return clip01(score / total if total > 0 else score)


def histogram(gray: Column, bins: int = 256) -> Column:
    """Counts of each luminance in an array of them, in one pass over it; null for a null array."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else np.bincount(np.clip(np.asarray(a, np.int64), 0, bins - 1), minlength=bins).tolist() for a in arrays], dtype=object)

    return run(gray)
