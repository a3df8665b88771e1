"""The driver's tables as candidates: columns that both Spark and plain SQL can derive stand in for what inference would give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import categories, geometry, pose, quality, vectors
from .functions.expressions import BLENDSHAPES, with_expressions

FRAME = (1920, 1080)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, e): the embeddings in double."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def e(i: int) -> Column:
    """The i-th entry of e, from 0."""
    return F.col("e")[i]


def box_of() -> Column:
    return geometry.box(F.abs(e(54)) * 1500, F.abs(e(55)) * 800, 20 + (F.abs(e(56)) * 400).cast("int"), 20 + (F.abs(e(57)) * 400).cast("int"))


def with_looks(df: DataFrame) -> DataFrame:
    """df (e, confidence) with bbox, sub-scores, quality, pose, blendshapes, expressions and categories."""
    blend = F.map_from_arrays(F.array(*map(F.lit, BLENDSHAPES)), F.transform(F.slice("e", 1, len(BLENDSHAPES)), lambda x: F.least(F.lit(1.0), 2.5 * F.abs(x))))
    out = df.withColumns({"bbox": box_of(), "yaw": 300.0 * e(52), "pitch": 100.0 * e(53), "blendshapes": blend})
    b, w, h = F.col("bbox"), F.lit(FRAME[0]), F.lit(FRAME[1])
    parts = {
        "sharpness": quality.sharpness(4000.0 * F.abs(e(58))),
        "exposure": quality.exposure_of(F.abs(e(59)) / 4.0, F.abs(e(60)) / 4.0, 128.0 + 400.0 * e(61)),
        "face_resolution": quality.face_resolution(b),
        "landmark_confidence": F.col("confidence"),
        "artifact": 1.0 - F.least(F.lit(1.0), F.abs(e(62))),
        "obstruction": quality.obstruction(b, w, h, F.col("confidence")),
    }
    out = out.withColumns(parts)
    out = out.withColumns({"quality": quality.overall({k: F.col(k) for k in parts}), "pose": pose.bucket(F.col("yaw"), F.col("pitch"))})
    out = with_expressions(out)
    return out.withColumn("categories", categories.categories_for(F.col("pose"), F.col("expressions")))


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each embedding."""
    return with_looks(dims(spark, sf_dir).withColumn("confidence", F.lit(0.9)))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each event: id, video_id, identity_cluster, timestamp, ord, embedding e of the vector that the event maps to."""
    vectors_ = dims(spark, sf_dir)
    n = vectors_.count()
    when = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1000000.0
    ev = read(spark, sf_dir, "events").withColumn("vec_id", (F.col("user_id") * 31 + F.floor(F.col("value") / 20)) % F.lit(n))
    ev = ev.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("video_id"), F.col("user_id").alias("identity_cluster"), when.alias("timestamp"), F.col("event_id").alias("ord"), F.least(F.lit(1.0), F.col("value") / 490.0).alias("confidence"), "vec_id")
    return ev.join(vectors_.select(F.col("id").alias("vec_id"), "e"), "vec_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sightings with looks and a hash, as the dedup, selection and report operators take them."""
    rows = with_looks(sightings(spark, sf_dir))
    return rows.withColumns({"embedding": F.col("e"), "phash": vectors.sign_hash(F.col("e")), "detection_confidence": F.col("confidence"), "frame_number": F.col("ord"), "frame_path": F.format_string("frame_%08d.jpg", F.col("ord"))})
