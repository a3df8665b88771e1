"""What of a body is seen, from pose landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of landmarks in a pose of 33, and the visibility that counts. Fixed values.
NOSE, SHOULDERS, HIPS, KNEES_ANKLES, SEEN = 0, (11, 12), (23, 24), (25, 26, 27, 28), 0.5


def visibility(pose: Column) -> Column:
    """full_body, half_body, upper_body or none, of an array of struct<x, y, visibility>; a null visibility is 0, a null pose none."""
    best = lambda at: F.greatest(*(F.coalesce(F.get(pose, i)["visibility"], F.lit(0.0)) for i in at)) >= SEEN
    return F.when(best(KNEES_ANKLES), "full_body").when(best(HIPS), "half_body").when(best(SHOULDERS), "upper_body").otherwise("none")


def nearest_pose(faces: DataFrame, poses: DataFrame, frame: str = "frame", face: str = "face_id", order: str = "pose_no") -> DataFrame:
    """faces (frame, face_id, cx, cy in shares of the image) with `pose`, the pose of the frame whose nose is nearest.

    A nose with visibility under SEEN is passed over, one of unknown visibility isn't; of equal distances the first pose in
    `order`. Faces without a pose have null. An equi-join on the frame: only poses of the own frame are compared.
    """
    nose = F.get("pose", NOSE)
    usable = poses.where(nose["visibility"].isNull() | (nose["visibility"] >= SEEN))
    dist = (F.get("pose", NOSE)["x"] - F.col("cx")) * (F.get("pose", NOSE)["x"] - F.col("cx")) + (F.get("pose", NOSE)["y"] - F.col("cy")) * (F.get("pose", NOSE)["y"] - F.col("cy"))
    first = F.row_number().over(Window.partitionBy(frame, face).orderBy(F.col("_d").asc_nulls_last(), order))
    joined = faces.join(usable.select(frame, order, "pose"), frame, "left").withColumn("_d", dist)
    return joined.withColumn("_rn", first).where("_rn = 1").drop("_rn", "_d", order)
