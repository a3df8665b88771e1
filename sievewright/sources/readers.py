"""Sources: candidates, cached JSON, image files and a single reference image's vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import candidate_id
from ..schema import CANDIDATE


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates from Parquet, in the declared schema; missing columns are null, none is inferred."""
    return spark.read.schema(CANDIDATE).parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cached JSON rows; rows that can't be parsed are left out, whole documents over several lines are read."""
    broken = "_broken"
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(broken, T.StringType())])).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=broken)
    return rows.where(F.col(broken).isNull()).drop(broken)


def read_images(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """(path, modificationTime, length, content) of image files. Without a use of content, Spark doesn't read the files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def parse_hash(text: Column) -> Column:
    """A 64-bit hash from 16 hexadecimal digits; null from what is none."""
    t = F.lower(F.trim(text))
    ok = t.rlike("^[0-9a-f]{1,16}$")
    return F.when(ok, F.conv(F.lpad(t, 16, "0"), 16, -10).cast("long"))


def ingest(detections: DataFrame) -> DataFrame:
    """detections (video_id, frame_number, timestamp, position, bbox) with candidate_id and ord, the one order that ties go by."""
    return detections.withColumn("candidate_id", candidate_id(F.col("frame_number"), F.col("bbox"))).withColumn("ord", F.struct("timestamp", "frame_number", "position", "candidate_id"))
