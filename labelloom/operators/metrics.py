"""Classification metrics from pair counts.

Everything starts from one aggregation of the predictions into
(true_label, predicted_label, n); all that follows works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALARS = (
    "accuracy",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "precision_micro",
    "recall_micro",
    "f1_micro",
)


def pair_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (by..., true_label, predicted_label)."""
    return predictions.groupBy(
        *by, F.col("true_label").cast("string"), F.col("predicted_label").cast("string")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion(pairs: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts over *labels* in long form, zero cells included.

    Pairs with either side outside the list are left out.
    """
    names = F.array(*[F.lit(str(label)) for label in labels])
    keys = pairs.select(*by).distinct() if by else pairs.sparkSession.range(1).select()
    grid = (
        keys.select("*", F.explode(names).alias("true_label"))
        .select("*", F.explode(names).alias("predicted_label"))
    )
    on = [*by, "true_label", "predicted_label"]
    return grid.join(pairs, on, "left").select(*on, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Square matrix: one row per true label, one column per predicted label."""
    cells = confusion(pairs, labels)
    return cells.groupBy("true_label").pivot("predicted_label", [str(label) for label in labels]).agg(F.sum("n"))


def label_stats(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label: support, predicted and correct counts."""
    n, hit = F.col("n"), F.col("true_label") == F.col("predicted_label")
    sides = F.array(
        F.struct(
            F.col("true_label").alias("label"),
            n.alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(hit, n).otherwise(F.lit(0)).alias("correct"),
        ),
        F.struct(
            F.col("predicted_label").alias("label"),
            F.lit(0).cast("bigint").alias("support"),
            n.alias("predicted"),
            F.lit(0).cast("bigint").alias("correct"),
        ),
    )
    return (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _f1(correct: Column, support: Column, predicted: Column) -> Column:
    return _ratio(2 * correct, support + predicted)


def classification_metrics(
    pairs: DataFrame, labels: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and macro/micro precision, recall and F1, one row per *by* key.

    With a label list, averages run over exactly these labels: labels nobody has
    count as zero, and false positives from rows whose true label is not listed
    still count. Accuracy ignores the list. No rows give zeros.
    """
    c, s, p = F.col("correct"), F.col("support"), F.col("predicted")
    if labels is None:
        listed, n_labels = F.lit(True), F.count(F.lit(1))
    else:
        listed, n_labels = F.col("label").isin([str(x) for x in labels]), F.lit(len(labels))

    def macro(value: Column) -> Column:
        return _ratio(F.coalesce(F.sum(F.when(listed, value)), F.lit(0.0)), n_labels)

    def listed_sum(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(listed, value)), F.lit(0))

    stats = label_stats(pairs, by)
    aggregates = [
        _ratio(F.sum(c), F.sum(s)).alias("accuracy"),
        macro(_ratio(c, p)).alias("precision_macro"),
        macro(_ratio(c, s)).alias("recall_macro"),
        macro(_f1(c, s, p)).alias("f1_macro"),
        _ratio(listed_sum(c), listed_sum(p)).alias("precision_micro"),
        _ratio(listed_sum(c), listed_sum(s)).alias("recall_micro"),
        _f1(listed_sum(c), listed_sum(s), listed_sum(p)).alias("f1_micro"),
        F.coalesce(F.sum(s), F.lit(0)).alias("n_samples"),
    ]
    return stats.groupBy(*by).agg(*aggregates)


def per_class_accuracy(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples, hits and accuracy of each true label."""
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(F.lit(0))
    return (
        pairs.groupBy(*by, F.col("true_label").alias("gesture_label"))
        .agg(F.sum("n").alias("n_samples"), F.sum(hit).alias("n_correct"))
        .withColumn("accuracy", F.col("n_correct") / F.col("n_samples"))
    )


def metrics_long(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metric columns as rows (by..., metric, value)."""
    values = [F.col(c).cast("double").alias(c) for c in metrics.columns if c not in by]
    return metrics.select(*by, *values).unpivot(
        list(by), [c for c in metrics.columns if c not in by], "metric", "value"
    )
