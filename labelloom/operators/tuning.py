"""Candidates of naive Bayes scored over all folds with one pass for statistics and one for scores.

The statistics of the rows outside a fold are those of the other folds put together, so the
rows are read once for all folds: counts, means and squared deviations per fold and class. Scaling
is a change of the same numbers. A second pass scores each row by the models of its own fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.bayes import GaussianBayes
from labelloom.operators.metrics import classification_metrics
from labelloom.operators.scaling import EPS, moments


@dataclass(frozen=True)
class Moments:
    """Rows, means and sums of squared deviations of some rows."""

    n: float
    mean: np.ndarray
    squares: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        """Those of both parts together, without the loss of digits of differences of sums."""
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.squares + other.squares + apart**2 * (self.n * other.n / n))

    @property
    def variance(self) -> np.ndarray:
        return self.squares / self.n


def joined(parts: Sequence[Moments]) -> Moments:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def fold_moments(rows: DataFrame, vector: str = "vector_inline", label: str = "gesture_label") -> dict[tuple[int, str], Moments]:
    """Moments of each (fold, class): folds x classes x dimensions numbers, whatever the rows."""
    stats = moments(rows.withColumn("label", F.col(label).cast("string")), vector, ("fold", "label"))
    found = {}
    for r in stats.collect():
        n = float(r["n"])
        found[int(r["fold"]), r["label"]] = Moments(n, np.array(r["mean"]), np.array(r["var_pop"]) * n)
    return found


def bayes_outside(parts: dict[tuple[int, str], Moments], fold: int, smoothing: float, scale: bool) -> tuple[GaussianBayes, np.ndarray, np.ndarray]:
    """Model of the rows outside a fold, with centre and width of its scaler."""
    outside = {key: part for key, part in parts.items() if key[0] != fold}
    labels = sorted({label for _, label in outside})
    by_label = [joined([part for (_, name), part in outside.items() if name == label]) for label in labels]
    every = joined(by_label)
    centre, width = np.zeros_like(every.mean), np.ones_like(every.mean)
    if scale:
        deviation = np.sqrt(every.variance)
        centre, width = every.mean, np.where(deviation < EPS, 1.0, deviation)
    counts = np.array([m.n for m in by_label])
    model = GaussianBayes(
        classes=tuple(labels),
        log_prior=np.log(counts / counts.sum()),
        mean=np.array([(m.mean - centre) / width for m in by_label]),
        var=np.array([m.variance / width**2 + smoothing for m in by_label]),
    )
    return model, centre, width


def fold_pairs(matrix: DataFrame, folds: DataFrame, smoothings: Sequence[float], scale: bool = False) -> DataFrame:
    """Rows per (var_smoothing, fold, true_label, predicted_label), each row scored by the models of its fold.

    *folds* has sample_id and fold. Counts are summed in the task before the shuffle. A
    fold outside of which there are no rows is not scored.
    """
    rows = matrix.select("sample_id", F.col("gesture_label").cast("string").alias("gesture_label"), F.col("vector_inline").cast("array<double>").alias("vector_inline"))
    rows = rows.join(folds.select("sample_id", F.col("fold").cast("int").alias("fold")), "sample_id")
    parts = fold_moments(rows)
    numbers = sorted({fold for fold, _ in parts})
    models = {
        fold: [(s, *bayes_outside(parts, fold, s, scale)) for s in smoothings] for fold in numbers if any(f != fold for f, _ in parts)
    }

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("vector_inline").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            fold, truth = batch.column("fold").to_numpy(), np.array(batch.column("gesture_label").to_pylist(), dtype=object)
            for number in np.unique(fold).tolist():
                own = fold == number
                for smoothing, model, centre, width in models.get(number, ()):
                    best = model.log_likelihood((x[own] - centre) / width).argmax(axis=1)
                    for t, y in zip(truth[own], best):
                        key = (smoothing, number, t, model.classes[y])
                        counts[key] = counts.get(key, 0) + 1
        if counts:
            columns = [*zip(*counts), tuple(counts.values())]
            kinds = (pa.float64(), pa.int32(), pa.string(), pa.string(), pa.int64())
            names = ["var_smoothing", "fold", "true_label", "predicted_label", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = rows.select("gesture_label", "vector_inline", "fold").mapInArrow(
        score, "var_smoothing double, fold int, true_label string, predicted_label string, n bigint"
    )
    return found.groupBy("var_smoothing", "fold", "true_label", "predicted_label").agg(F.sum("n").alias("n"))


def tuning_scores(matrix: DataFrame, folds: DataFrame, smoothings: Sequence[float], scale: bool = False) -> DataFrame:
    """Metrics of each candidate on each fold: var_smoothing, fold and those of `classification_metrics`."""
    return classification_metrics(fold_pairs(matrix, folds, smoothings, scale), None, ["var_smoothing", "fold"])


def best_candidate(scores: DataFrame, metric: str = "f1_macro") -> float | None:
    """Candidate with the best mean over the folds, the smallest of equals."""
    means = scores.groupBy("var_smoothing").agg(F.avg(metric).alias("mean")).orderBy(F.desc("mean"), "var_smoothing").first()
    return means["var_smoothing"] if means else None
