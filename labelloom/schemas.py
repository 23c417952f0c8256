"""Fixed schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("sample_id", T.StringType(), False),
        T.StructField("dataset_name", T.StringType(), False),
        T.StructField("subject_id", T.StringType()),
        T.StructField("raw_gesture_label", T.StringType()),
        T.StructField("gesture_label", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("capture_context", T.MapType(T.StringType(), T.StringType())),
    ]
)

FEATURE_MATRIX = T.StructType(
    [
        T.StructField("sample_id", T.StringType(), False),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("gesture_label", T.StringType()),
        T.StructField("feature_family", T.StringType()),
        T.StructField("feature_version", T.StringType()),
        T.StructField("vector_path", T.StringType()),
        T.StructField("vector_inline", T.ArrayType(T.DoubleType())),
        T.StructField("quality_flags", T.MapType(T.StringType(), T.BooleanType())),
        T.StructField("extraction_ok", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source_families", T.ArrayType(T.StringType())),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("sample_id", T.StringType(), False),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("subject_id", T.StringType()),
        T.StructField("true_label", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("correct", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("domain", T.StringType()),
        T.StructField("capture_context", T.MapType(T.StringType(), T.StringType())),
    ]
)

RUN_RECORD = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("config_fingerprint", T.StringType()),
        T.StructField("config_snapshot", T.StringType()),
        T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("inputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("outputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("algorithm", T.StringType()),
        T.StructField("feature_family", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

FRAME = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("frame_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

LANDMARKS = T.ArrayType(T.ArrayType(T.DoubleType()))
