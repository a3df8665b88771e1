"""Which frames to look at, and which detections in them to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area
from ..params import Sampling


def probe(total_frames: Column, fps: Column) -> Column:
    """struct<fps, total_frames, duration>; an unknown or zero rate is 30."""
    rate = F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(30.0))
    return F.struct(rate.alias("fps"), total_frames.cast("long").alias("total_frames"), (total_frames / rate).alias("duration"))


def stride_plan(videos: DataFrame, p: Sampling = Sampling()) -> DataFrame:
    """videos (video_id, fps, total_frames) with first, last (exclusive) and stride of the frames to sample.

    The stride grows where the range would give more than max_frames.
    """
    rate = F.coalesce(F.nullif(F.col("fps").cast("double"), F.lit(0.0)), F.lit(30.0))
    total = F.col("total_frames").cast("long")
    length = total / rate
    end = F.lit(float(p.end)) if p.end is not None else length
    if p.max_duration is not None:
        end = F.least(end, F.lit(float(p.start + p.max_duration)))
    whole = lambda c: F.bround(c, 0).cast("long")  # noqa: E731  halves to even
    first = F.greatest(F.lit(0).cast("long"), whole(F.lit(float(p.start)) * rate))
    last = F.when(F.coalesce(end, F.lit(0.0)) != 0, whole(end * rate)).otherwise(total)
    last = F.when(F.coalesce(total, F.lit(0)) != 0, F.least(last, total)).otherwise(last)
    stride = F.greatest(F.lit(1).cast("long"), whole(rate / float(p.fps)))
    with_range = videos.withColumns({"rate": rate, "first": first, "last": last, "_stride": stride}).withColumn("_span", F.greatest(F.lit(1).cast("long"), F.col("last") - F.col("first")))
    wide = F.greatest(F.col("_stride"), F.ceil(F.col("_span") / p.max_frames))
    return with_range.withColumn("stride", F.when(F.floor(F.col("_span") / F.col("_stride")) > p.max_frames, wide).otherwise(F.col("_stride"))).drop("_stride", "_span")


def sample_frames(videos: DataFrame, p: Sampling = Sampling()) -> DataFrame:
    """(video_id, frame_number, timestamp) of the sampled frames, at most max_frames a video. No frame list is read: the plan is exploded."""
    plan = stride_plan(videos, p)
    stop = F.least(F.col("last") - 1, F.col("first") + F.col("stride") * (p.max_frames - 1))
    frames = plan.where("last > first").withColumn("frame_number", F.explode(F.sequence("first", stop, "stride")))
    return frames.select("video_id", "frame_number", (F.col("frame_number") / F.col("rate")).alias("timestamp"))


def keep_large(detections: DataFrame, keys: list[str], order: list[str], b: str = "bbox", least: int = 40) -> DataFrame:
    """Detections whose shorter side is at least `least`; in a frame that has none, its largest one, the first in ties."""
    side = F.least(F.col(f"{b}.w"), F.col(f"{b}.h"))
    of_frame = Window.partitionBy(*keys)
    ranked = detections.withColumns({"_ok": side >= least, "_area": area(F.col(b))})
    ranked = ranked.withColumns({"_any": F.max("_ok").over(of_frame), "_rn": F.row_number().over(of_frame.orderBy(F.desc("_area"), *order))})
    return ranked.where("_ok or (not _any and _rn = 1)").drop("_ok", "_area", "_any", "_rn")


def explode_detections(frames: DataFrame, column: str = "detections", least_score: float = 0.8) -> DataFrame:
    """A row for each detection struct of a frame that reaches the score, with its place as `position`."""
    rows = frames.select("*", F.posexplode(column).alias("position", "detection")).drop(column)
    return rows.where(F.col("detection.score") >= least_score)
