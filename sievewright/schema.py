"""Record types and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: Vocabularies. Fixed values.
POSES = ["front", "three_quarter_left", "three_quarter_right", "profile_left", "profile_right", "looking_up", "looking_down"]
BODY_VISIBILITY = ["none", "upper_body", "half_body", "full_body"]
EXPRESSIONS = ["neutral", "slight_smile", "confident_smile", "big_smile", "laughing", "serious", "focused", "surprised", "mouth_open", "talking", "looking_down", "looking_up", "eyes_left", "eyes_right", "eyes_closed", "raised_eyebrows", "frowning"]

BBOX = T.StructType([T.StructField(c, T.IntegerType()) for c in "xywh"])
QUALITY = T.StructType([T.StructField(c, T.DoubleType()) for c in ("quality", "sharpness", "exposure", "face_resolution", "landmark_confidence", "artifact", "obstruction")])
POSE = T.StructType([T.StructField("yaw", T.DoubleType()), T.StructField("pitch", T.DoubleType()), T.StructField("roll", T.DoubleType()), T.StructField("pose", T.StringType())])

#: One row for each detection; null is "not computed".
CANDIDATE = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("candidate_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("frame_path", T.StringType()),
        T.StructField("frame_number", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("bbox", BBOX),
        T.StructField("detection_confidence", T.DoubleType()),
        T.StructField("detector_row", T.ArrayType(T.FloatType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("identity_cluster", T.IntegerType()),
        T.StructField("blendshapes", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("landmark_confidence", T.DoubleType()),
        T.StructField("transform", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("quality", QUALITY),
        T.StructField("pose", POSE),
        T.StructField("expressions", T.ArrayType(T.StringType())),
        T.StructField("body_visibility", T.StringType()),
        T.StructField("phash", T.LongType()),
        T.StructField("duplicate_of", T.StringType()),
    ]
)
