"""Measures that need pixels: Arrow-batched pandas functions over rows of luminance or colour arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _image(flat, width) -> np.ndarray:
    w = int(width) if width is not None and width == width else 0
    if flat is None or not len(flat) or w < 1:
        return np.zeros((0, 0))
    a = np.asarray(flat, np.float64)
    return a[: len(a) // w * w].reshape(-1, w)


def laplacian_variance(img: np.ndarray) -> float | None:
    """Variance of the 4-neighbour Laplacian, borders mirrored; None for an empty image."""
    if not img.size:
        return None
    p = np.pad(img, 1, mode="reflect") if min(img.shape) > 1 else np.pad(img, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img).var())


def blockiness_score(img: np.ndarray, grid: int = 8) -> float:
    """1 for an image without visible 8 by 8 blocks, less as steps at block borders exceed those elsewhere; 1 under 16 pixels."""
    if not img.size or min(img.shape) < 16:
        return 1.0
    ratio = 0.0
    for axis in (0, 1):
        step = np.abs(np.diff(img, axis=axis))
        at_border = np.take(step, range(grid - 1, img.shape[axis] - 1, grid), axis=axis)
        ratio += 0.5 * at_border.mean() / (step.mean() + 1e-6)
    return float(np.clip(1.0 - max(0.0, ratio - 1.0), 0.0, 1.0))


def laplacian(gray: Column, width: Column) -> Column:
    """Of a row-major array of luminances and its width."""

    @F.pandas_udf(T.DoubleType())
    def run(g: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([laplacian_variance(_image(x, y)) for x, y in zip(g, w, strict=True)], dtype="float64")

    return run(gray, width)


def artifact(gray: Column, width: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(g: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([blockiness_score(_image(x, y)) for x, y in zip(g, w, strict=True)], dtype="float64")

    return run(gray, width)


def mean_colour(rgb: Column) -> Column:
    """struct<r, g, b> of an array of struct<r, g, b>: plain Column arithmetic; null for an empty region."""
    n = F.nullif(F.size(rgb), F.lit(0))
    mean = lambda c: F.aggregate(rgb, F.lit(0).cast("long"), lambda a, x: a + x[c]) / n
    return F.struct(*(mean(c).alias(c) for c in "rgb"))


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def _shrink(img: np.ndarray, side: int) -> np.ndarray:
    """Means over a side by side grid; rows or columns repeat where the image is smaller."""
    for axis in (0, 1):
        n = img.shape[axis]
        at = np.minimum(np.arange(side + 1) * n // side, n)
        ran = np.concatenate([np.zeros_like(np.take(img, [0], axis)), np.cumsum(img, axis)], axis)
        lo, hi = at[:-1], np.maximum(at[1:], at[:-1] + 1)
        span = (hi - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        img = (np.take(ran, np.minimum(hi, n), axis) - np.take(ran, np.minimum(lo, n - 1), axis)) / span
    return img


def hash_bits(img: np.ndarray, side: int = 32, keep: int = 8) -> int | None:
    """64 bits, as a signed long, that say which of the lowest frequencies of the shrunk image are over their median; None for an empty image."""
    if not img.size:
        return None
    c = _cosines(side)
    low = (c @ _shrink(img, side) @ c.T)[:keep, :keep]
    bits = (low > np.median(low)).ravel()
    value = int(np.packbits(bits).view(">u8")[0])
    return value - 2**64 if value >= 2**63 else value


def perceptual_hash(gray: Column, width: Column) -> Column:
    """Of a row-major array of luminances: alike images differ in few bits; null for what is no image."""

    @F.pandas_udf(T.LongType())
    def run(g: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([hash_bits(_image(x, y)) for x, y in zip(g, w, strict=True)], dtype="Int64")

    return run(gray, width)
