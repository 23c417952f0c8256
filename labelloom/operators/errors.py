"""Misclassification tables and the join of predictions with their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.ranking import top_n


def is_error(df: DataFrame) -> Column:
    """Wrong prediction, by the `correct` column where there is one."""
    if "correct" in df.columns:
        return ~F.col("correct")
    return F.col("true_label").cast("string") != F.col("predicted_label").cast("string")


def errors_of(predictions: DataFrame, domain: str | None = None) -> DataFrame:
    """Wrong predictions, optionally of one domain."""
    rows = predictions
    if domain is not None and "domain" in predictions.columns:
        rows = rows.filter(F.col("domain") == domain)
    return rows.filter(is_error(predictions))


def misclassified_pairs(predictions: DataFrame) -> DataFrame:
    """Confused label pairs, most frequent first, with their shares of all errors and of those of the true label."""
    counts = (
        errors_of(predictions)
        .groupBy(F.col("true_label").cast("string"), F.col("predicted_label").cast("string"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per pair of labels
    every, same = Window.partitionBy(), Window.partitionBy("true_label")
    return counts.select(
        "true_label", "predicted_label", "n",
        F.sum("n").over(every).alias("total_errors"),
        (F.col("n") / F.sum("n").over(every)).alias("share"),
        (F.col("n") / F.sum("n").over(same)).alias("share_of_label"),
    ).orderBy(F.desc("n"), "true_label", "predicted_label")


def errors_by_context(predictions: DataFrame) -> DataFrame:
    """Errors counted by capture source, by subject and by label pair.

    Long form (dimension, key, other_key, n) plus the `total`, in one pass.
    """
    has_context = "capture_context" in predictions.columns
    context = lambda key: F.try_element_at("capture_context", F.lit(key))
    subject = F.col("subject_id") if "subject_id" in predictions.columns else F.lit(None).cast("string")
    if has_context:
        source = F.coalesce(context("source"), F.lit("unknown"))
        subject = F.coalesce(subject, context("subject_id"))
    else:
        source = F.col("domain") if "domain" in predictions.columns else F.lit("ood")
        subject = F.coalesce(subject, F.lit("unknown"))
    none = F.lit(None).cast("string")
    fact = lambda kind, key, other: F.struct(
        F.lit(kind).alias("dimension"), key.cast("string").alias("key"), other.cast("string").alias("other_key")
    )
    facts = F.array(
        fact("total", none, none),
        fact("source", source, none),
        fact("subject", subject, none),
        fact("pair", F.col("true_label"), F.col("predicted_label")),
    )
    return (
        errors_of(predictions)
        .select(F.inline(facts))
        .groupBy("dimension", "key", "other_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def failure_samples(predictions: DataFrame, n_per_class: int = 3, domain: str | None = "ood") -> DataFrame:
    """The most confident errors of each true class, ties by sample id."""
    order = [F.col("confidence").desc_nulls_last()] if "confidence" in predictions.columns else []
    return top_n(errors_of(predictions, domain), ["true_label"], [*order, F.col("sample_id")], n_per_class)


def with_metadata_defaults(predictions: DataFrame, domain: str, dataset_name: str) -> DataFrame:
    """Predictions without a manifest, with the same columns as `with_metadata`."""
    return _prediction_columns(
        predictions.withColumns({f"_{c}": F.lit(None).cast("string") for c in ("dataset_name", "image_path", "subject_id")})
        .withColumn("_capture_context", F.lit(None).cast("map<string,string>")),
        domain,
        dataset_name,
    )


def with_metadata(predictions: DataFrame, manifest: DataFrame, domain: str, dataset_name: str) -> DataFrame:
    """Predictions joined with path, subject and context of their manifest row.

    Samples the manifest lacks keep defaults; a repeated id takes one of its rows.
    """
    wanted = ("dataset_name", "image_path", "subject_id", "capture_context")
    # maps have no order, so the row is chosen by the other columns and the map's text
    order = F.struct(*[F.col(c) for c in wanted[:-1]], F.to_json("capture_context"))
    meta = manifest.groupBy("sample_id").agg(F.max_by(F.struct(*wanted), order).alias("_m")).select(
        "sample_id", *[F.col("_m")[c].alias(f"_{c}") for c in wanted]
    )
    return _prediction_columns(predictions.join(meta, "sample_id", "left"), domain, dataset_name)


def _prediction_columns(joined: DataFrame, domain: str, dataset_name: str) -> DataFrame:
    true, predicted = F.col("true_label").cast("string"), F.col("predicted_label").cast("string")
    confidence = F.col("confidence") if "confidence" in joined.columns else F.lit(None).cast("double")
    return joined.select(
        "sample_id",
        F.coalesce("_dataset_name", F.lit(dataset_name)).alias("dataset_name"),
        F.coalesce("_image_path", F.lit("")).alias("image_path"),
        F.col("_subject_id").alias("subject_id"),
        true.alias("true_label"),
        predicted.alias("predicted_label"),
        (true == predicted).alias("correct"),
        confidence.alias("confidence"),
        F.lit(domain).alias("domain"),
        F.coalesce("_capture_context", F.expr("cast(map() as map<string,string>)")).alias("capture_context"),
        *[c for c in ("probability",) if c in joined.columns],
    )


def all_predictions(in_domain: DataFrame, ood: DataFrame) -> DataFrame:
    """Rows of both domains; columns only one of them has become null in the other."""
    return in_domain.unionByName(ood, allowMissingColumns=True)


