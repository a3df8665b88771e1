"""Models plugged in by the user: one load for each task's worker, Arrow batches through it, bad rows left out.

A factory returns a callable; both run on the executors. Nothing here knows a particular model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NothingDetected
from ..functions import pixels
from ..functions.geometry import normalised_box
from ..shipping import ship
from ..sources.readers import ingest

Detector = Callable[[bytes], list[tuple[float, float, float, float, float]]]
Embedder = Callable[[bytes, tuple[int, int, int, int]], "np.ndarray | None"]

#: An image's bytes to rows of luminances or of (r, g, b); None or an error for what is no image.
Decoder = Callable[[bytes], "np.ndarray | None"]
#: An image's bytes and a box to {"blendshapes": {name: weight}, "points": [(x, y)], "transform": rows of a matrix}, None for a face without landmarks.
Analyser = Callable[[bytes, tuple[int, int, int, int]], "dict | None"]
#: An image's bytes to poses, each 33 of (x, y, visibility).
Poser = Callable[[bytes], list[list[tuple[float, float, float]]]]

DETECTION = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h", "score")]))


def _try(f, *args):
    """None where a single row can't be worked on; a long run isn't lost for one bad frame."""
    try:
        return f(*args)
    except (ValueError, ArithmeticError, OSError, IndexError, TypeError):
        return None


def detect(frames: DataFrame, factory: Callable[[], Detector], least_score: float = 0.8) -> DataFrame:
    """A row for each detection of frames (video_id, frame_number, timestamp, content), with bbox, detection_confidence, position, candidate_id and ord."""
    ship(frames.sparkSession)
    keep = [f for f in frames.schema.fields if f.name != "content"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in parts:
            found = [_try(model, c) or [] for c in pdf["content"]]
            yield pdf.drop(columns="content").assign(detections=pd.Series([[dict(zip(("x", "y", "w", "h", "score"), map(float, d), strict=True)) for d in one] for one in found], index=pdf.index, dtype=object))

    rows = frames.select(*(f.name for f in keep), "content").mapInPandas(run, T.StructType([*keep, T.StructField("detections", DETECTION)]))
    each = rows.select("*", F.posexplode("detections").alias("position", "d")).drop("detections").where(F.col("d.score") >= least_score)
    box = normalised_box(*(F.col(f"d.{c}") for c in "xywh"))
    return ingest(each.withColumns({"bbox": box, "detection_confidence": F.col("d.score")}).drop("d"))


def embed(rows: DataFrame, factory: Callable[[], Embedder]) -> DataFrame:
    """rows (content, bbox) with embedding; rows whose face can't be embedded are left out."""
    ship(rows.sparkSession)
    out = T.StructType([*(f for f in rows.schema.fields if f.name != "content"), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in parts:
            boxes = [tuple(b[c] for c in "xywh") for b in pdf["bbox"]]
            vectors = [_try(model, c, b) for c, b in zip(pdf["content"], boxes, strict=True)]
            made = pdf.drop(columns="content").assign(embedding=pd.Series([None if v is None else np.asarray(v, np.float32).ravel() for v in vectors], index=pdf.index, dtype=object))
            yield made[made["embedding"].notna()]

    return rows.mapInPandas(run, out)


def _with_results(rows: DataFrame, factory: Callable, fields: list[T.StructField], call: Callable) -> DataFrame:
    """rows without content, with the fields that call(model, row) names for each row; nulls where it fails."""
    ship(rows.sparkSession)
    keep = [f for f in rows.schema.fields if f.name != "content" and f.name not in {x.name for x in fields}]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in parts:
            got = [_try(call, model, row) or {} for row in pdf.to_dict("records")]
            yield pdf[[f.name for f in keep]].assign(**{f.name: pd.Series([g.get(f.name) for g in got], index=pdf.index, dtype=object) for f in fields})

    return rows.mapInPandas(run, T.StructType([*keep, *fields]))


def _box(row: dict, name: str = "bbox") -> tuple[int, ...]:
    return tuple(row[name][c] for c in "xywh")


POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"])
LOOK = [T.StructField("blendshapes", T.MapType(T.StringType(), T.DoubleType())), T.StructField("points", T.ArrayType(POINT)), T.StructField("transform", T.ArrayType(T.ArrayType(T.DoubleType())))]


def analyse(rows: DataFrame, factory: Callable[[], Analyser]) -> DataFrame:
    """rows (content, bbox) with blendshapes, points and transform of the face; null where no landmarks are found."""

    def call(model: Analyser, row: dict) -> dict | None:
        got = model(bytes(row["content"]), _box(row))
        if got is None:
            return None
        matrix = got.get("transform")
        return {
            "blendshapes": {k: float(v) for k, v in got["blendshapes"].items()},
            "points": [{"x": float(x), "y": float(y)} for x, y in got["points"]],
            "transform": None if matrix is None else [[float(v) for v in r] for r in matrix],
        }

    return _with_results(rows, factory, LOOK, call)


RGB = T.StructType([T.StructField(c, T.DoubleType()) for c in "rgb"])
MEASURES = [T.StructField(c, T.DoubleType()) for c in ("laplacian", "low", "high", "mean", "artifact")]
MEASURES += [T.StructField("phash", T.LongType()), T.StructField("shirt", RGB), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]


def luminance(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image


def measure(rows: DataFrame, factory: Callable[[], Decoder]) -> DataFrame:
    """rows (content, bbox) with measures of the face's pixels, a hash of it, the mean colour under it, and the image's size.

    The image is decoded and measured in one pass on the executor, so that no pixels come back to the JVM. Rows that
    can't be decoded, and boxes outside the image, have nulls; without colours, or without an image under the face, shirt is null.
    """

    def call(model: Decoder, row: dict) -> dict | None:
        image = model(bytes(row["content"]))
        if image is None:
            return None
        image = np.asarray(image, np.float64)
        height, width = image.shape[:2]
        x, y, w, h = _box(row)
        size = {"width": width, "height": height}
        face = luminance(image[max(0, y) : y + h, max(0, x) : x + w])
        if not face.size:
            return size
        top, bottom = min(height, y + int(h * 1.3)), min(height, min(height, y + int(h * 1.3)) + int(h * 1.2))
        under = image[top:bottom, max(0, x - int(w * 0.3)) : x + w + int(w * 0.3)]
        mean = under.reshape(-1, 3).mean(0) if image.ndim == 3 and under.size else None
        return size | {
            "laplacian": pixels.laplacian_variance(face), "low": float((face < 5).mean()), "high": float((face >= 251).mean()), "mean": float(face.mean()),
            "artifact": pixels.blockiness_score(face), "phash": pixels.hash_bits(face), "shirt": None if mean is None else dict(zip("rgb", map(float, mean), strict=True)),
        }

    return _with_results(rows, factory, MEASURES, call)


def poses(frames: DataFrame, factory: Callable[[], Poser]) -> DataFrame:
    """(keys of frames, pose_no, pose) for each pose in each frame (content and keys); frames that fail have none."""
    landmark = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "visibility")])

    def call(model: Poser, row: dict) -> dict:
        return {"poses": [[dict(zip(("x", "y", "visibility"), map(float, p), strict=True)) for p in pose] for pose in model(bytes(row["content"]))]}

    got = _with_results(frames, factory, [T.StructField("poses", T.ArrayType(T.ArrayType(landmark)))], call)
    return got.select("*", F.posexplode("poses").alias("pose_no", "pose")).drop("poses")


def reference_vector(content: bytes, detector: Detector, embedder: Embedder, least_score: float = 0.3) -> list[float]:
    """The embedding of the largest face of one image, found with a lenient threshold; on the driver, for one image."""
    found = [d for d in detector(content) if d[4] >= least_score]
    if not found:
        raise NothingDetected("the reference image shows no face")
    x, y, w, h, _ = max(found, key=lambda d: d[2] * d[3])
    vector = embedder(content, (max(0, int(x)), max(0, int(y)), max(1, int(w)), max(1, int(h))))
    if vector is None:
        raise NothingDetected("the reference image's face can't be embedded")
    return [float(v) for v in np.asarray(vector).ravel()]
