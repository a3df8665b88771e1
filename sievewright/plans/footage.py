"""From frames to a report: sample, detect, embed, cluster, choose, look closely at the chosen person only, and curate.

Models are plugged in (see operators.inference). Frames are a table with their bytes; sampled frames are joined to it by key, so
that only what a stage looks at is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import Checkpoints, cut, exists, parameter_key
from ..errors import NothingDetected
from ..functions import body, geometry, pose, quality, text
from ..functions.expressions import with_expressions
from ..operators import dedup, inference, reports, sampling
from ..params import ExpressionThresholds, PoseThresholds, QualityWeights, Sampling
from .curate import Curation, Result, identify, selected

FRAME = ["video_id", "frame_number"]


@dataclass(frozen=True)
class Models:
    """Factories, called once in each worker. Without a poser no body is looked for."""

    detector: Callable[[], inference.Detector]
    embedder: Callable[[], inference.Embedder]
    decoder: Callable[[], inference.Decoder]
    analyser: Callable[[], inference.Analyser]
    poser: Callable[[], inference.Poser] | None = None


@dataclass(frozen=True)
class Footage:
    sampling: Sampling = field(default_factory=Sampling)
    curation: Curation = field(default_factory=Curation)
    poses: PoseThresholds = field(default_factory=PoseThresholds)
    expressions: ExpressionThresholds = field(default_factory=ExpressionThresholds)
    weights: QualityWeights = field(default_factory=QualityWeights)
    trigger: str = "person"


@dataclass
class Report:
    """What a run gives: the curation, and sheets (key, id, row, col, rows) by name."""

    result: Result
    sheets: dict[str, DataFrame]


def sampled(videos: DataFrame, frames: DataFrame, p: Sampling) -> DataFrame:
    """frames (video_id, frame_number, frame_path, content) that the plan for videos (video_id, fps, total_frames) looks at, with their timestamp."""
    return frames.drop("timestamp").join(sampling.sample_frames(videos, p), FRAME)


def detections(spark: SparkSession, videos: DataFrame, frames: DataFrame, models: Models, p: Footage, checkpoints: Checkpoints | None = None, source: str = "") -> DataFrame:
    """A row for each face of the sampled frames that is large enough and can be embedded: the columns of a candidate, without pixels.

    A checkpoint is taken up if it was made with the same sampling of the same source and frames that it names are still
    there; if they aren't, it is dropped, and with it the clusters made of it.
    """

    def build() -> DataFrame:
        looked = sampled(videos, frames, p.sampling)
        found = inference.detect(looked, models.detector)
        large = sampling.keep_large(found, FRAME, ["position"], least=p.sampling.min_side)
        faces = inference.embed(large.join(frames.select(*FRAME, "content"), FRAME), models.embedder)
        return faces.withColumn("id", F.concat_ws("/", F.col("video_id").cast("string"), "candidate_id", F.col("position").cast("string")))

    if checkpoints is None:
        return cut(build())
    key = parameter_key(p.sampling, source)
    if checkpoints.has("frames", key) and not exists(spark, checkpoints.stage("frames", key, build).select("frame_path")):
        checkpoints.drop("frames", "identity")
    return checkpoints.stage("frames", key, build)


def closely(chosen: DataFrame, frames: DataFrame, models: Models, p: Footage) -> DataFrame:
    """chosen with landmarks, pixel measures, quality, pose, expressions, hash, shirt colour and crops."""
    with_content = lambda rows: rows.join(frames.select(*FRAME, "content"), FRAME)
    rows = cut(inference.analyse(with_content(chosen), models.analyser))
    rows = cut(inference.measure(with_content(rows), models.decoder))
    b, width, height, plausible = F.col("bbox"), F.col("width"), F.col("height"), quality.plausibility(F.col("points"))
    parts = {
        "sharpness": quality.sharpness(F.col("laplacian")),
        "exposure": quality.exposure_of(F.col("low"), F.col("high"), F.col("mean")),
        "face_resolution": quality.face_resolution(b),
        "landmark_confidence": quality.landmark_confidence(F.col("detection_confidence"), plausible),
        "artifact": F.coalesce("artifact", F.lit(1.0)),
        "obstruction": quality.obstruction(b, width, height, plausible),
    }
    rows = rows.withColumns(parts).withColumn("head", pose.head_pose(F.col("transform"), p.poses))
    rows = rows.withColumns({"quality": quality.overall({k: F.col(k) for k in parts}, p.weights), "pose": F.col("head.pose"), "yaw": F.col("head.yaw")}).drop("head")
    rows = with_expressions(rows, t=p.expressions)
    colour = text.nearest_colour(F.col("shirt.r"), F.col("shirt.g"), F.col("shirt.b"))
    crops = F.struct(geometry.face_crop(b).alias("face"), geometry.portrait_crop(b, height).alias("portrait"), geometry.body_crop(b, width, height).alias("body"))
    stem = text.stem(F.col("frame_number"), F.col("candidate_id"))
    return rows.withColumns({"caption": text.caption(F.lit(p.trigger), F.col("expressions"), colour), "crops": crops, "file": stem})


def with_bodies(rows: DataFrame, frames: DataFrame, models: Models) -> DataFrame:
    """rows with body_visibility, of the pose of their frame whose nose is nearest; only frames of these rows are looked at."""
    if models.poser is None:
        return rows.withColumn("body_visibility", F.lit("none"))
    frame = F.struct(*FRAME).alias("frame")
    looked = frames.join(rows.select(*FRAME).distinct(), FRAME).select(frame, "content")
    cx, cy = geometry.center(F.col("bbox"))
    faces = rows.select(frame, F.col("id").alias("face_id"), (cx / F.col("width")).alias("cx"), (cy / F.col("height")).alias("cy"))
    seen = body.nearest_pose(faces, inference.poses(looked, models.poser)).select(F.col("face_id").alias("id"), body.visibility(F.col("pose")).alias("body_visibility"))
    return rows.join(seen, "id")


def run(spark: SparkSession, videos: DataFrame, frames: DataFrame, models: Models, p: Footage = Footage(), checkpoints: Checkpoints | None = None, source: str = "", ask: Callable[[list], int] | None = None) -> Report:
    """The whole run over one video's frames (video_id, frame_number, frame_path, content)."""
    faces = detections(spark, videos, frames, models, p, checkpoints, source)
    if faces.isEmpty():
        raise NothingDetected("no face was found in the sampled frames")
    known, target, why = identify(spark, faces, p.curation, checkpoints, parameter_key(p.sampling, source), ask)
    looks = cut(closely(known.where(F.col("identity_cluster") == target), frames, models, p))
    marked = cut(dedup.deduplicate(looks, p.curation.dedup))
    survivors = cut(with_bodies(marked.where("kept"), frames, models))
    counts = {"frames_examined": sampling.sample_frames(videos, p.sampling).count(), "faces_found": faces.count(), "identities_found": known.where("identity_cluster is not null").select("identity_cluster").distinct().count(), "identity_cluster_id": target, "after_dedup": survivors.count()}
    shown = ("file", "frame_path", "caption", "yaw", "body_visibility", "crops", "sharpness", "exposure", "face_resolution", "landmark_confidence", "artifact", "obstruction")
    result = selected(survivors, p.curation, target, why, counts, {"source": source}, shown)
    first = survivors.withColumn("place", F.col("sel_ord"))
    of_pose = reports.best_by(first, "pose", order="place")
    of_tag = reports.best_by(first.withColumn("tag", F.explode("expressions")), "tag", order="place")
    sheets = {"identity": reports.sheet(of_pose, "pose", reports.IDENTITY_SHEET, 5), "expressions": reports.sheet(of_tag, "tag", reports.EXPRESSION_SHEET, 4), "poses": reports.sheet(of_pose, "pose", reports.POSE_SHEET, 4)}
    return Report(result, sheets)
