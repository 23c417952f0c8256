"""Library tables derived from the given star-schema tables.

The given tables hold no images. Each function reads one of them whole and
renames or derives columns, so that the operators run on real volumes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.clock import with_micros
from labelloom.functions.geometry import N
from labelloom.functions.labels import sample_id
from labelloom.functions.quality import flag_when, merge_flags
from labelloom.functions.vectors import zeros
from labelloom.session import materialize, spread

# Debounce and vote settings for `events`, whose frames are hours apart.
VOTE = {"window_size": 5, "min_consensus_ratio": 0.4, "confidence_threshold": 0.4}
DAY_US = 86_400_000_000
DEBOUNCE_MS = 86_400_000.0
KEYMAP = {"click": "space", "purchase": "enter", "view": "up"}
KEY_ALIASES = {"signup": "view"}

GEOMETRIC, APPEARANCE = "geometric", "hog"
CLASSES = ["de", "en", "es", "fr", "none"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as image files: (path, relative_path)."""
    relative = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/data/"), relative).alias("path"), relative.alias("relative_path")
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a manifest: label = language, subject = source."""
    relative = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    return table(spark, sf_dir, "documents").select(
        sample_id(F.lit("documents"), relative).alias("sample_id"),
        F.lit("documents").alias("dataset_name"),
        F.col("source").alias("subject_id"),
        F.col("lang").alias("raw_gesture_label"),
        F.col("lang").alias("gesture_label"),
        F.concat(F.lit("/data/"), relative).alias("image_path"),
        F.lit(None).cast("string").alias("split"),
        F.create_map(F.lit("relative_path"), relative, F.lit("source"), F.col("source")).alias("capture_context"),
    )


def _doubles() -> Column:
    return F.col("embedding").cast("array<double>")


def matrix(spark: SparkSession, sf_dir: str, family: str = GEOMETRIC) -> DataFrame:
    """`embeddings` as a feature matrix.

    Component values decide which rows failed: a low second component is a failed
    detection (zero vector), a high third one a missing vector, a high fourth one
    a missing confidence.
    """
    v = _doubles()
    failed = F.get(v, F.lit(1)) < -0.2
    absent = F.get(v, F.lit(2)) > 0.3
    confidence = F.when(F.get(v, F.lit(3)) <= 0.25, F.least(F.lit(1.0), F.abs(F.get(v, F.lit(0))) * 4))
    if family == GEOMETRIC:
        vector = F.when(failed, zeros(64)).when(~absent, v)
        flags = merge_flags(flag_when("detection_failed", failed), flag_when("low_confidence", confidence < 0.2))
        ok = ~failed
    else:
        vector = F.concat(F.transform(v, lambda x: x * x), F.array(F.lit(1.0)))
        flags = flag_when("landmark_crop_fallback", failed)
        ok = F.lit(True)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.lit("embeddings").alias("dataset_name"),
        F.col("label").cast("string").alias("gesture_label"),
        F.lit(family).alias("feature_family"),
        F.lit("v1").alias("feature_version"),
        F.lit(None).cast("string").alias("vector_path"),
        vector.alias("vector_inline"),
        flags.alias("quality_flags"),
        ok.alias("extraction_ok"),
        confidence.alias("confidence"),
        F.lit(None).cast("array<string>").alias("source_families"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as plain labelled vectors (all rows valid)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.col("label").cast("string").alias("gesture_label"),
        _doubles().alias("vector_inline"),
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as hand landmarks: the first 63 components as 21 x 3."""
    points = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.slice(_doubles(), i * 3 + 1, 3))
    last = F.get(_doubles(), F.lit(63))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.lit("embeddings").alias("dataset_name"),
        F.col("label").cast("string").alias("gesture_label"),
        F.when(last < 0.2, points).alias("landmarks"),
        F.abs(last).alias("confidence"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
    )


def _count(*letters: str) -> Column:
    lost = [F.length("text") - F.length(F.replace(F.col("text"), F.lit(x))) for x in letters]
    total = lost[0]
    for part in lost[1:]:
        total = total + part
    return total


def letter_scores() -> Column:
    """One score per class from letters typical of its language, over the whole text."""
    marks = {"de": "äöüß", "es": "ñáíó", "fr": "éèêç"}
    scores = {name: _count(*letters) for name, letters in marks.items()}
    scores["en"] = F.floor(F.length("text") / 400).cast("int")
    scores["none"] = F.lit(0)
    return F.array(*[(scores[c] + 1).cast("double") for c in CLASSES])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as predictions of their language from letter counts.

    Texts of 2000 characters or more are the second domain; those of more than
    10000 form classes of their own there. Scoring reads every text in full, so
    the narrow result is written once for all that evaluates it.
    """
    scores = letter_scores()
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, x: acc + x)
    names = F.array(*[F.lit(c) for c in CLASSES])
    position = F.array_position("_scores", F.array_max("_scores")).cast("int")
    long = F.col("n_chars") > 10_000
    scored = (
        spread(table(spark, sf_dir, "documents"))
        .select("doc_id", "lang", "source", "n_chars", scores.alias("_scores"))
        .select(
            F.col("doc_id").cast("string").alias("sample_id"),
            F.lit("documents").alias("dataset_name"),
            F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("image_path"),
            F.col("source").alias("subject_id"),
            F.when(long, F.concat("lang", F.lit("_long"))).otherwise(F.col("lang")).alias("true_label"),
            F.element_at(names, position).alias("predicted_label"),
            F.transform("_scores", lambda x: x / total).alias("probability"),
            F.when(F.col("n_chars") >= 2000, "ood").otherwise("in_domain").alias("domain"),
            F.create_map(
                F.lit("source"), F.when(F.col("n_chars") >= 500, "scan").otherwise("note")
            ).alias("capture_context"),
        )
        .withColumn("correct", F.col("true_label") == F.col("predicted_label"))
        .withColumn("confidence", F.array_max("probability"))
    )
    return materialize(scored, "predictions")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as frames: session = user, label = event type."""
    events = with_micros(table(spark, sf_dir, "events"))
    return frames_of(events)


def frames_of(events: DataFrame) -> DataFrame:
    """Frame columns of an events table or stream (with `us`)."""
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("frame_id"),
        "us",
        F.col("event_type").alias("label"),
        (F.col("value") / (F.col("value") + 50.0)).alias("confidence"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as stage timings of frames (seconds)."""
    start = F.col("us") / 1_000_000.0
    return with_micros(table(spark, sf_dir, "events")).select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("frame_id"),
        "us",
        (F.col("value") * 0.6).alias("capture_to_prediction_ms"),
        (F.col("value") * 0.4).alias("prediction_to_dispatch_ms"),
        F.col("value").alias("end_to_end_ms"),
        start.alias("frame_start"),
        (F.col("event_type") == "click").alias("action_emitted"),
        (F.col("event_type") != "click").alias("action_suppressed"),
        (F.col("event_type") != "error").alias("detection_ok"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as run records: one run per supplier, return flag and line status.

    Metrics are exact integer sums divided once.
    """
    cents = lambda c, f: F.sum(F.round(F.col(c) * f).cast("bigint"))
    n = F.count(F.lit(1))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(
        (cents("l_discount", 100) / (n * 10)).alias("accuracy"),
        (cents("l_tax", 100) / (n * 8)).alias("f1_macro"),
        (cents("l_quantity", 1) / n).alias("per_sample_inference_ms"),
        n.alias("n"),
    )
    text = lambda c: F.col(c).cast("string")
    return grouped.select(
        F.concat_ws("-", text("l_suppkey"), "l_returnflag", "l_linestatus").alias("run_id"),
        F.concat(F.lit("EXP-"), F.col("l_linestatus")).alias("experiment_id"),
        F.when(F.col("n") >= 90, "completed").otherwise("running").alias("status"),
        F.concat(F.lit("algo_"), F.col("l_returnflag")).alias("algorithm"),
        F.col("l_linestatus").alias("feature_family"),
        F.create_map(
            F.lit("accuracy"), F.col("accuracy"),
            F.lit("f1_macro"), F.col("f1_macro"),
            F.lit("per_sample_inference_ms"), F.col("per_sample_inference_ms"),
        ).alias("metrics"),
        F.create_map(F.lit("metrics_path"), F.concat(F.lit("/runs/"), text("l_suppkey"))).alias("outputs"),
    )
