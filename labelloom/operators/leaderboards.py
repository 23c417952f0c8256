"""Run tables: leaderboards, suites, pivots and chart profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom import vocab
from labelloom.functions.names import algorithm_name, primary_metric, report_metrics

RUN_COLUMNS = ("run_id", "experiment_id", "algorithm", "feature_family", "status")


def completed_runs(runs: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Completed runs, optionally of one experiment."""
    rows = runs.filter(F.col("status") == "completed")
    return rows if experiment_id is None else rows.filter(F.col("experiment_id") == experiment_id)


def leaderboard(runs: DataFrame, metrics_config: Mapping[str, Any] | None = None) -> DataFrame:
    """Runs with their report metrics as columns, best primary metric first, nulls last."""
    names = report_metrics(metrics_config)
    primary = primary_metric(metrics_config)
    if "algorithm" in runs.columns and "config_snapshot" in runs.columns:
        stored = F.get_json_object("config_snapshot", "$.algorithm")
        runs = runs.withColumn("algorithm", F.coalesce("algorithm", stored))
    wide = runs.select(
        *RUN_COLUMNS, *[F.try_element_at("metrics", F.lit(name)).alias(name) for name in names]
    )
    if primary not in names:
        return wide.orderBy("run_id")
    return wide.orderBy(F.col(primary).desc_nulls_last(), "run_id")


def suite_table(runs: DataFrame) -> DataFrame:
    """Comparison of robustness runs, best second-domain accuracy first.

    Metrics are keys such as `in_domain.accuracy` in the metrics map.
    """
    keys = {
        "in_domain_accuracy": "in_domain.accuracy",
        "ood_accuracy": "ood.accuracy",
        "absolute_accuracy_drop": "robustness.absolute_accuracy_drop",
        "relative_performance_retention": "robustness.relative_performance_retention",
        "ood_shared_subset_accuracy": "shared_subset.ood.accuracy",
    }
    columns = [F.try_element_at("metrics", F.lit(k)).alias(c) for c, k in keys.items()]
    path = F.try_element_at("outputs", F.lit("metrics_path")).alias("metrics_path")
    return (
        completed_runs(runs)
        .select("run_id", "algorithm", "feature_family", *columns, path)
        .orderBy(
            F.col("ood_accuracy").desc_nulls_last(), F.col("in_domain_accuracy").desc_nulls_last(), "run_id"
        )
    )


def metric_pivot(
    runs: DataFrame, value: str, rows: str = "algorithm", columns: str = "feature_family",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Mean of a metric per algorithm (rows) and family (columns)."""
    return runs.groupBy(rows).pivot(columns, list(names) if names else None).agg(F.avg(value))


def metric_profile(
    runs: DataFrame,
    metrics: Sequence[str] = ("accuracy", "f1_macro", "per_sample_inference_ms"),
    top_n: int = 12,
) -> DataFrame:
    """Metrics of the best configurations scaled to [0, 1], latency inverted.

    A metric with one value only becomes 0.5. The chart label is `algorithm / family`.
    """
    best = runs.orderBy(F.col(metrics[0]).desc_nulls_last(), "run_id").limit(top_n)
    everything = Window.partitionBy(F.lit(0))

    def scaled(name: str):
        low, high = F.min(name).over(everything), F.max(name).over(everything)
        share = (F.col(name) - low) / (high - low)
        share = 1.0 - share if name == "per_sample_inference_ms" else share
        return F.when(high > low, share).otherwise(F.lit(0.5)).alias(name)

    label = F.concat_ws(" / ", "algorithm", "feature_family").alias("label")
    return best.select("run_id", label, *[scaled(name) for name in metrics])


def top_rows(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The *n* rows with the greatest *by*; Spark keeps only n rows per task."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def suite_specs(
    algorithms: Sequence[str],
    families: Sequence[str],
    pairs: Sequence[Mapping[str, str]] | None = None,
) -> list[tuple[str, str]]:
    """Distinct (algorithm, family) runs: the given pairs, else all combinations."""
    wanted = (
        [(p["algorithm"], p["feature_family"]) for p in pairs]
        if pairs
        else [(a, f) for f in families for a in algorithms]
    )
    return list(dict.fromkeys((algorithm_name(str(a)), str(f)) for a, f in wanted))


def grid(space: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations of a search space."""
    return [dict(zip(space, values)) for values in product(*space.values())]


def candidates(name: str, space: Mapping[str, Sequence[Any]] | None = None) -> list[dict[str, Any]]:
    """Parameter maps to try for an algorithm, from its default space or a given one."""
    return grid(search_space(name) if space is None else space)


def search_space(name: str) -> dict[str, list[Any]]:
    """Default search space of an algorithm."""
    key = algorithm_name(name)
    if key not in vocab.SEARCH_SPACES:
        raise KeyError(f"no search space for algorithm '{name}'")
    return {k: list(v) for k, v in vocab.SEARCH_SPACES[key].items()}
