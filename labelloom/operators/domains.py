"""Comparison of an in-domain with an out-of-domain dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import vocab
from labelloom.functions.scoring import deployment_recommendation, mask_unknown, restricted_argmax
from labelloom.operators.metrics import classification_metrics, pair_counts, per_class_accuracy
from labelloom.session import materialize

IN_DOMAIN, OOD = "in_domain", "ood"


def labels_of(df: DataFrame, label: str = "gesture_label") -> list[str]:
    """Sorted label vocabulary of a table (aggregated before it is fetched)."""
    rows = df.select(F.col(label).cast("string").alias("l")).filter("l is not null and l <> ''").distinct().collect()
    return sorted(r["l"] for r in rows)


def label_overlap(left: DataFrame, right: DataFrame, label: str = "gesture_label") -> DataFrame:
    """Each label with where it occurs: `shared`, `left_only` or `right_only`."""
    sides = [
        df.select(F.col(label).cast("string").alias("gesture_label"))
        .filter("gesture_label is not null and gesture_label <> ''")
        .groupBy("gesture_label")
        .agg(F.lit(bit).alias("bit"))
        for df, bit in ((left, 1), (right, 2))
    ]
    both = sides[0].unionByName(sides[1]).groupBy("gesture_label").agg(F.sum("bit").alias("bits"))
    place = F.when(F.col("bits") == 3, "shared").when(F.col("bits") == 1, "left_only").otherwise("right_only")
    return both.select("gesture_label", place.alias("occurrence"))


def domain_drop(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and F1 of both domains side by side, drop and retention.

    *metrics* has a `domain` column with `in_domain` and `ood` rows.
    """
    at = lambda c, d: F.coalesce(F.max(F.when(F.col("domain") == d, F.col(c))), F.lit(0.0))
    id_acc, ood_acc = F.col("in_domain_accuracy"), F.col("ood_accuracy")
    return (
        metrics.groupBy(*keys)
        .agg(
            at("accuracy", IN_DOMAIN).alias("in_domain_accuracy"),
            at("accuracy", OOD).alias("ood_accuracy"),
            at("f1_macro", IN_DOMAIN).alias("in_domain_f1_macro"),
            at("f1_macro", OOD).alias("ood_f1_macro"),
        )
        .withColumn("absolute_accuracy_drop", id_acc - ood_acc)
        .withColumn(
            "relative_performance_retention", F.when(id_acc > 0, ood_acc / id_acc).otherwise(F.lit(0.0))
        )
        .withColumn("absolute_f1_macro_drop", F.col("in_domain_f1_macro") - F.col("ood_f1_macro"))
    )


def per_class_shift(predictions: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Per label: accuracy in each domain and the drop, null without support.

    Without a label list, every true or predicted label of either domain is listed.
    """
    pairs = pair_counts(predictions, ["domain"])
    if labels is None:
        listed = pairs.select(
            F.explode(F.array("true_label", "predicted_label")).alias("gesture_label")
        ).distinct()
    else:
        listed = predictions.sparkSession.createDataFrame(
            [(str(x),) for x in labels], "gesture_label string"
        )
    by_domain = per_class_accuracy(pairs, ["domain"])
    at = lambda d: F.max(F.when(F.col("domain") == d, F.col("accuracy")))
    wide = by_domain.groupBy("gesture_label").agg(
        at(IN_DOMAIN).alias("in_domain_accuracy"), at(OOD).alias("ood_accuracy")
    )
    return listed.join(wide, "gesture_label", "left").withColumn(
        "absolute_drop", F.col("in_domain_accuracy") - F.col("ood_accuracy")
    )


def domain_report(predictions: DataFrame, vocabulary: Sequence[str], map_other: bool = True) -> dict[str, DataFrame]:
    """Report of one domain over its vocabulary.

    `per_class`: n, hits and accuracy of each vocabulary label. `pairs`: counts
    with predictions outside the vocabulary as `_other_`. `summary`: metrics over
    vocabulary plus `_other_`, and number and rate of predictions outside.
    """
    vocabulary = [str(x) for x in vocabulary]
    spark = predictions.sparkSession
    pairs = pair_counts(predictions)
    listed = spark.createDataFrame([(x,) for x in vocabulary], "gesture_label string")
    zero = F.lit(0).cast("bigint")
    per_class = listed.join(per_class_accuracy(pairs), "gesture_label", "left").select(
        "gesture_label",
        F.coalesce("n_samples", zero).alias("n_samples"),
        F.coalesce("n_correct", zero).alias("n_correct"),
        "accuracy",
    )
    labels = list(vocabulary)
    if map_other:
        masked = mask_unknown(F.col("predicted_label"), vocabulary, vocab.OTHER_PREDICTION)
        pairs = (
            pairs.withColumn("predicted_label", masked)
            .groupBy("true_label", "predicted_label")
            .agg(F.sum("n").alias("n"))
        )
        labels.append(vocab.OTHER_PREDICTION)
    outside = F.col("predicted_label") == vocab.OTHER_PREDICTION
    tagged = pairs.withColumn("domain", F.lit(OOD))
    counts = tagged.groupBy("domain").agg(
        F.sum(F.when(outside & F.lit(map_other), F.col("n")).otherwise(zero)).alias("n_out_of_vocab_predictions")
    )
    summary = (
        classification_metrics(tagged, labels, ["domain"])
        .join(counts, "domain")
        .withColumn(
            "out_of_vocab_prediction_rate",
            F.col("n_out_of_vocab_predictions") / F.greatest(F.col("n_samples"), F.lit(1)),
        )
    )
    return {"per_class": per_class, "pairs": pairs, "summary": summary}


def schema_compatibility(
    train: DataFrame, test: DataFrame, train_labels: Sequence[str], test_labels: Sequence[str]
) -> DataFrame:
    """One row: do two feature tables fit together, and if not, why.

    *train* and *test* are one-row sidecars with vector_dim, feature_family and
    feature_version.
    """
    a, b = set(map(str, train_labels)), set(map(str, test_labels))
    reference = set(vocab.CANONICAL_LABELS)

    def names(values: set[str]):
        return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")

    side = lambda df, p: df.select(
        F.lit(1).alias("_pair"),
        *[F.col(c).alias(f"{p}_{c}") for c in ("vector_dim", "feature_family", "feature_version")],
    )
    differs = lambda c: ~F.col(f"train_{c}").eqNullSafe(F.col(f"test_{c}"))
    issue = lambda c: F.when(
        differs(c),
        F.format_string(
            f"{c} mismatch: train=%s test=%s", F.col(f"train_{c}").cast("string"), F.col(f"test_{c}").cast("string")
        ),
    )
    disjoint = bool(a and b and not a & b)
    issues = F.array_compact(
        F.array(
            issue("vector_dim"),
            issue("feature_family"),
            issue("feature_version"),
            F.when(F.lit(disjoint), F.lit("no overlapping gesture labels between train and test domains")),
        )
    )
    return (
        side(train, "train")
        .join(side(test, "test"), "_pair")
        .drop("_pair")
        .withColumn("issues", issues)
        .withColumn("compatible", F.size("issues") == 0)
        .withColumn("shared", names(a & b if a and b else set()))
        .withColumn("train_only", names(a - b))
        .withColumn("test_only", names(b - a))
        .withColumn("n_shared", F.size("shared"))
        .withColumn("outside_reference_train", names(a - reference))
        .withColumn("outside_reference_test", names(b - reference))
    )


def _tagged(df: DataFrame, protocol: str) -> DataFrame:
    return df.withColumn("protocol", F.lit(protocol))


def evaluation_protocols(
    predictions: DataFrame,
    shared: Sequence[str],
    ood_only: Sequence[str],
    classes: Sequence[str] | None = None,
    probabilities: str | None = None,
) -> DataFrame:
    """Metrics per (protocol, domain) under three ways of scoring the second domain.

    ``shared_subset``: only rows whose true label is shared, both domains.
    ``masked_unknown``: predictions outside the second domain's vocabulary become
    `unknown`. ``masked_shared_argmax``: the best shared class by probability, on
    all rows and (`..._subset`) on rows with a shared label; needs *probabilities*.
    Columns n_excluded, unknown_rate and n_unknown_predictions are null where they mean nothing.
    """
    shared = [str(x) for x in shared]
    vocabulary = sorted({*shared, *map(str, ood_only)})
    narrow = [predictions["true_label"].cast("string"), predictions["predicted_label"].cast("string")]
    by_probability = bool(probabilities and classes and set(shared) & set(map(str, classes)))
    forced_label = restricted_argmax(F.col(probabilities), classes, shared) if by_probability else F.lit(None).cast("string")
    # One row per domain and labels: every protocol is derived from this table.
    counts = materialize(
        predictions.select("domain", narrow[0].alias("true_label"), narrow[1].alias("predicted_label"), forced_label.alias("forced"))
        .groupBy("domain", "true_label", "predicted_label", "forced").agg(F.count(F.lit(1)).alias("n")),
        "label-counts",
    )
    in_shared = F.col("true_label").isin(shared)
    by = ["protocol", "domain"]

    labels = ["domain", "true_label", "predicted_label"]
    pairs = counts.groupBy(*labels).agg(F.sum("n").alias("n"))
    ood_pairs = pairs.filter(F.col("domain") == OOD)
    parts = []
    if shared:
        kept = classification_metrics(_tagged(pairs.filter(in_shared), "shared_subset"), shared, by)
        left_out = (
            _tagged(ood_pairs, "shared_subset")
            .groupBy(*by)
            .agg(F.sum(F.when(in_shared, F.lit(0)).otherwise(F.col("n"))).cast("bigint").alias("n_excluded"))
        )
        parts.append(kept.join(left_out, by, "left"))

    masked = (
        _tagged(ood_pairs, "masked_unknown")
        .withColumn("predicted_label", mask_unknown(F.col("predicted_label"), vocabulary))
        .groupBy(*by, "true_label", "predicted_label")
        .agg(F.sum("n").alias("n"))
    )
    unknown = F.col("predicted_label") == vocab.UNKNOWN_LABEL
    rate = masked.groupBy(*by).agg(
        (F.sum(F.when(unknown, F.col("n")).otherwise(F.lit(0))) / F.sum("n")).alias("unknown_rate"),
        F.sum(F.when(unknown, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias("n_unknown_predictions"),
    )
    parts.append(
        classification_metrics(masked, [*vocabulary, vocab.UNKNOWN_LABEL], by).join(rate, by, "left")
    )

    if by_probability:
        forced = (
            counts.filter(F.col("domain") == OOD).drop("predicted_label").withColumnRenamed("forced", "predicted_label")
            .groupBy(*labels).agg(F.sum("n").alias("n"))
        )
        subset = pairs.filter((F.col("domain") == IN_DOMAIN) & in_shared).unionByName(forced.filter(in_shared))
        parts.append(classification_metrics(_tagged(forced, "masked_shared_argmax"), shared, by))
        parts.append(classification_metrics(_tagged(subset, "masked_shared_argmax_subset"), shared, by))

    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    for name, kind in (("n_excluded", "bigint"), ("unknown_rate", "double"), ("n_unknown_predictions", "bigint")):
        if name not in result.columns:
            result = result.withColumn(name, F.lit(None).cast(kind))
    return result


def protocol_availability(shared: Sequence[str], classes: Sequence[str] | None, has_probabilities: bool) -> tuple[bool, str]:
    """Whether the restricted argmax can be computed, and the reason if not."""
    if not has_probabilities or not classes:
        return False, "no class probabilities were kept with the predictions"
    if not set(map(str, shared)) & set(map(str, classes)):
        return False, "no shared label among the classes of the model"
    return True, ""


def protocol_drops(protocols: DataFrame) -> DataFrame:
    """Drop and retention of each protocol that scores both domains."""
    both = protocols.filter(F.col("protocol").isin("shared_subset", "masked_shared_argmax_subset"))
    return domain_drop(both, ["protocol"])


def with_recommendation(drop: DataFrame, compatible: bool = True) -> DataFrame:
    """Drop table plus the deployment recommendation code."""
    code = deployment_recommendation(
        F.col("relative_performance_retention"), F.col("absolute_accuracy_drop"), F.lit(compatible)
    )
    return drop.withColumn("recommendation", code)
