"""Readers and writers of the library's tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schemas
from labelloom.functions.names import stored_family
from labelloom.operators.matrices import exclude_invalid, sidecar
from labelloom.session import materialize


# --- configuration -----------------------------------------------------------


def config_fingerprint(config: Mapping[str, Any]) -> str:
    """16 hex digits over the configuration as sorted JSON, without `_meta`."""
    kept = {k: v for k, v in config.items() if k != "_meta"}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


# --- manifests ---------------------------------------------------------------


def _format_of(path: str, fmt: str | None) -> str:
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported table format '{fmt}'")
    return fmt


def write_manifest(manifest: DataFrame, path: str, fmt: str | None = None, mode: str = "error") -> None:
    """Manifest as Parquet, or as CSV with the context as JSON."""
    if _format_of(path, fmt) == "parquet":
        manifest.write.mode(mode).parquet(path)
    else:
        flat = manifest.withColumn("capture_context", F.to_json("capture_context"))
        flat.write.mode(mode).csv(path, header=True)


def read_manifest(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Manifest written by `write_manifest`."""
    if _format_of(path, fmt) == "parquet":
        return spark.read.parquet(path)
    text = ", ".join(f"{f.name} string" for f in schemas.MANIFEST.fields)
    return spark.read.schema(text).csv(path, header=True).withColumn(
        "capture_context", F.from_json("capture_context", "map<string,string>")
    )


def count_rows(spark: SparkSession, path: str, fmt: str | None = None) -> int:
    """Row count; for Parquet from the file footers."""
    return read_manifest(spark, path, fmt).count()


# --- feature matrices --------------------------------------------------------

MATRIX_KEYS = ("dataset_name", "feature_family", "feature_version")


def append_matrix(matrix: DataFrame, path: str) -> None:
    """Add rows to the matrix table, partitioned by dataset, family and version."""
    matrix.write.mode("append").partitionBy(*MATRIX_KEYS).parquet(path)


def replace_parts(matrix: DataFrame, path: str) -> None:
    """Write rows in place of what the table holds for their (dataset, family, version); other keys stay."""
    (
        matrix.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MATRIX_KEYS).parquet(path)
    )


def write_matrix_csv(matrix: DataFrame, path: str) -> None:
    """Matrix as CSV, nested columns as JSON."""
    nested = ("vector_inline", "quality_flags", "source_families")
    matrix.withColumns({c: F.to_json(c) for c in nested if c in matrix.columns}).write.csv(path, header=True)


def read_matrix(
    spark: SparkSession,
    path: str,
    *,
    dataset: str | None = None,
    family: str | None = None,
    version: str | None = None,
    sample_ids: DataFrame | None = None,
    valid_only: bool = True,
) -> DataFrame:
    """Matrix rows; key filters prune partitions, ids are a semi join."""
    rows = spark.read.schema(schemas.FEATURE_MATRIX).parquet(path)
    wanted = {
        "dataset_name": dataset,
        "feature_family": stored_family(family) if family else None,
        "feature_version": version,
    }
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if sample_ids is not None:
        rows = rows.join(sample_ids.select("sample_id"), "sample_id", "left_semi")
    return exclude_invalid(rows) if valid_only else rows


def write_sidecar(matrix: DataFrame, path: str, config: Mapping[str, Any], stats: Mapping[str, Any] | None = None) -> None:
    """Metadata rows of a matrix, appended to the sidecar table."""
    (
        sidecar(matrix, config_fingerprint(config))
        .withColumn("extraction_stats", F.lit(json.dumps(dict(stats or {}), sort_keys=True, default=str)))
        .withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
        .write.mode("append")
        .parquet(path)
    )


def read_sidecar(spark: SparkSession, path: str, dataset: str, family: str, version: str = "v1") -> DataFrame:
    """Newest metadata row of one matrix."""
    keys = (
        (F.col("dataset_name") == dataset)
        & (F.col("feature_family") == stored_family(family))
        & (F.col("feature_version") == version)
    )
    return spark.read.parquet(path).filter(keys).orderBy(F.desc("created_at")).limit(1)


def read_matrix_and_sidecar(
    spark: SparkSession, matrix_path: str, sidecar_path: str, dataset: str, family: str, version: str = "v1"
) -> tuple[DataFrame, DataFrame]:
    """Matrix of (dataset, family, version) with its metadata row."""
    return (
        read_matrix(spark, matrix_path, dataset=dataset, family=family, version=version),
        read_sidecar(spark, sidecar_path, dataset, family, version),
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that *df* itself may be reading.

    The new content is written in full to the shared folder first; should the
    second write fail, it is still there.
    """
    copy = materialize(df, "replacement")
    writer = copy.write.mode("overwrite")
    if set(MATRIX_KEYS) <= set(df.columns):
        writer = writer.partitionBy(*MATRIX_KEYS)
    writer.parquet(path)


# --- splits and folds --------------------------------------------------------


def write_splits(splits: DataFrame, path: str) -> None:
    """Split table, partitioned by split so that readers prune."""
    splits.select("sample_id", "gesture_label", "split").write.partitionBy("split").parquet(path)


def write_folds(folds: DataFrame, path: str) -> None:
    """Fold table, partitioned by fold."""
    folds.select("sample_id", "gesture_label", "fold").write.partitionBy("fold").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, split) from a split table or from a JSON file of id lists."""
    if not path.endswith(".json"):
        return spark.read.parquet(path).select("sample_id", "split")
    text = spark.read.text(path, wholetext=True)
    lists = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(lists).alias("split", "ids")).select(
        F.explode("ids").alias("sample_id"), "split"
    )


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, fold) from a fold table or from a JSON file of fold lists."""
    if not path.endswith(".json"):
        return spark.read.parquet(path).select("sample_id", "fold")
    text = spark.read.text(path, wholetext=True)
    kind = "struct<folds:array<struct<fold:int,train:array<string>,val:array<string>>>>"
    return text.select(F.inline(F.from_json("value", kind)["folds"])).select(
        F.explode("val").alias("sample_id"), "fold"
    )


# --- run records -------------------------------------------------------------


def new_run(
    spark: SparkSession,
    experiment_id: str,
    config: Mapping[str, Any],
    *,
    status: str = "initialized",
    algorithm: str | None = None,
    feature_family: str | None = None,
    metrics: Mapping[str, float] | None = None,
    artifacts: Mapping[str, str] | None = None,
    outputs: Mapping[str, str] | None = None,
) -> DataFrame:
    """One run record with a fresh id."""
    now = datetime.now(UTC).isoformat()
    inputs = {k: json.dumps(config[k], default=str) for k in ("datasets", "features", "models") if k in config}
    numbers = {k: float(v) for k, v in (metrics or {}).items() if v is not None}
    row = (
        str(uuid.uuid4()), experiment_id, status, now, now, config_fingerprint(config),
        json.dumps(dict(config), sort_keys=True, default=str), dict(artifacts or {}), inputs,
        dict(outputs or {}), algorithm, feature_family, numbers,
    )
    return spark.createDataFrame([row], schemas.RUN_RECORD)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add run records, one JSON object per line."""
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Completed run records below *path*; other JSON objects are skipped."""
    reader = spark.read.schema(schemas.RUN_RECORD).option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", "*.json").json(path).filter(
        "run_id is not null and experiment_id is not null and status = 'completed'"
    )


# --- predictions, reports, events --------------------------------------------


def write_predictions_csv(predictions: DataFrame, path: str) -> None:
    """Predictions as CSV, context and probabilities as JSON."""
    nested = ("capture_context", "probability")
    flat = predictions.withColumns({c: F.to_json(c) for c in nested if c in predictions.columns})
    flat.write.mode("overwrite").csv(path, header=True)


def write_confusion_csv(matrix: DataFrame, path: str) -> None:
    """Square confusion matrix as CSV; the first column is the true label."""
    matrix.orderBy("true_label").write.mode("overwrite").csv(path, header=True)


def read_confusion_csv(spark: SparkSession, path: str) -> DataFrame:
    """Confusion matrix from CSV; row labels must equal column labels."""
    matrix = spark.read.csv(path, header=True)
    columns = matrix.columns[1:]
    rows = matrix.select(F.collect_set(matrix.columns[0]).alias("r")).first()["r"]
    if sorted(rows) != sorted(columns):
        raise ValueError("row labels of the confusion matrix differ from its column labels")
    return matrix.select(
        F.col(matrix.columns[0]).alias("true_label"), *[F.col(f"`{c}`").cast("bigint").alias(c) for c in columns]
    )


def write_report(table: DataFrame, path: str, fmt: str = "json") -> None:
    """A report table (leaderboard, summary, coverage) as JSON or CSV, in its order; an earlier one is replaced."""
    if fmt == "csv":
        table.write.mode("overwrite").csv(path, header=True)
    else:
        table.write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Add session events as JSON lines, stamped with the time of writing."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    stamped = events if "timestamp_iso" in events.columns else events.withColumn("timestamp_iso", stamp)
    stamped.write.mode("append").json(path)


def session_document(events: DataFrame, summary: DataFrame, log_path: str) -> DataFrame:
    """Per session: number of logged events and the summary as JSON."""
    counts = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"))
    return counts.join(summary, "session_id", "left").select(
        "session_id",
        F.lit(log_path).alias("session_log"),
        "event_count",
        F.to_json(F.struct(*[c for c in summary.columns if c != "session_id"])).alias("summary"),
    )
