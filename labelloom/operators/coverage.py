"""Extraction coverage, quality counts and label coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.quality import coverage_label, has_flag, is_valid_row

COUNTS = (
    "total_samples",
    "successful_extractions",
    "detection_failures",
    "low_confidence_count",
    "missing_vectors",
)


def partial_coverage(matrix: DataFrame) -> DataFrame:
    """Mergeable counts per label; partial tables add up by plain sums."""
    ok = is_valid_row(
        F.col("extraction_ok"), F.col("quality_flags"), F.col("feature_family"), F.col("vector_inline")
    )
    flags = F.col("quality_flags")
    return matrix.groupBy(coverage_label(F.col("gesture_label")).alias("gesture_label")).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(ok).alias("successful_extractions"),
        F.count_if(has_flag(flags, "detection_failed")).alias("detection_failures"),
        F.count_if(has_flag(flags, "low_confidence")).alias("low_confidence_count"),
        F.count_if(F.coalesce(F.size("vector_inline"), F.lit(0)) <= 0).alias("missing_vectors"),
    )


def merge_coverage(*partials: DataFrame) -> DataFrame:
    """Sum of partial coverage tables (of chunks, days or datasets)."""
    merged = partials[0]
    for other in partials[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("gesture_label").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _rates(counts: DataFrame) -> DataFrame:
    total, good = F.col("total_samples"), F.col("successful_extractions")
    return counts.withColumn("failed_extractions", total - good).withColumn(
        "success_rate", F.when(total > 0, good / total).otherwise(F.lit(0.0))
    )


def coverage_by_label(partial: DataFrame) -> DataFrame:
    """Totals, successes, failures and success rate of each label."""
    return _rates(partial).select(
        "gesture_label", "total_samples", "successful_extractions", "failed_extractions", "success_rate"
    )


def overall_coverage(partial: DataFrame) -> DataFrame:
    """The same over all labels, with failure causes."""
    return _rates(partial.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]))


def flag_counts(matrix: DataFrame) -> DataFrame:
    """Rows carrying each flag as true."""
    return (
        matrix.select(F.explode("quality_flags").alias("flag", "is_set"))
        .filter("is_set")
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def coverage_violations(
    partial: DataFrame, min_samples: int | None = None, min_success_rate: float | None = None
) -> DataFrame:
    """Labels below a threshold: (rule, gesture_label, total, successes, rate, threshold)."""
    rows = coverage_by_label(partial)
    rules = []
    if min_samples:
        rules.append(("min_samples", F.col("total_samples") < min_samples, float(min_samples)))
    if min_success_rate is not None:
        rules.append(("success_rate", F.col("success_rate") < min_success_rate, float(min_success_rate)))
    broken = [
        F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(threshold).alias("threshold")))
        for name, hit, threshold in rules
    ]
    found = F.array_compact(F.array(*broken).cast("array<struct<rule:string,threshold:double>>"))
    return rows.select(
        F.inline(found), "gesture_label", "total_samples", "successful_extractions", "success_rate"
    )


def low_confidence_ids(matrix: DataFrame, threshold: float) -> DataFrame:
    """Samples below the confidence threshold; without a confidence the flag decides."""
    low = F.coalesce(F.col("confidence") < threshold, has_flag(F.col("quality_flags"), "low_confidence"))
    return matrix.filter(low).select("sample_id", "confidence")


def observed_labels(df: DataFrame, label: str = "gesture_label") -> DataFrame:
    """Distinct non-empty labels."""
    return df.filter(F.col(label).isNotNull() & (F.col(label) != "")).select(label).distinct()


def label_coverage(manifest: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Each observed or expected label with its count and standing.

    `standing` is aligned, outside_reference or missing_reference; without a
    reference every label is aligned.
    """
    counts = manifest.groupBy(F.coalesce("gesture_label", F.lit("")).alias("gesture_label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if not reference:
        return counts.withColumn("standing", F.lit("aligned"))
    expected = manifest.sparkSession.createDataFrame(
        [(str(x),) for x in sorted(set(reference))], "gesture_label string"
    ).withColumn("_expected", F.lit(True))
    standing = (
        F.when(F.col("n").isNull(), "missing_reference")
        .when(F.col("_expected").isNull(), "outside_reference")
        .otherwise("aligned")
    )
    return counts.join(expected, "gesture_label", "full").select(
        "gesture_label", F.coalesce("n", F.lit(0)).alias("n"), standing.alias("standing")
    )


def aligned_ratio(coverage: DataFrame) -> DataFrame:
    """One row: samples, and the share of them with a label of the reference."""
    aligned = F.sum(F.when(F.col("standing") == "aligned", F.col("n")).otherwise(F.lit(0)))
    return coverage.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"),
        F.when(F.sum("n") > 0, aligned / F.sum("n")).otherwise(F.lit(0.0)).alias("aligned_with_reference_ratio"),
    )


def dataset_summary(manifest: DataFrame) -> DataFrame:
    """Counts in long form (section, key, n).

    Sections: total, class, subject (null as `unknown`) and duplicate_sample_id.
    """
    fact = lambda section, key: F.struct(
        F.lit(section).alias("section"), key.cast("string").alias("key")
    )
    facts = F.array(
        fact("total", F.lit("")),
        fact("class", F.col("gesture_label")),
        fact("subject", F.coalesce("subject_id", F.lit("unknown"))),
    )
    counts = manifest.select(F.inline(facts)).groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(
        duplicate_ids(manifest).select(
            F.lit("duplicate_sample_id").alias("section"), F.col("sample_id").alias("key"), "n"
        )
    )


def duplicate_ids(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose image is not in the file listing (column `path`)."""
    return manifest.join(
        listing.select(F.col("path").alias("image_path")), "image_path", "left_anti"
    ).select("sample_id", "image_path")
