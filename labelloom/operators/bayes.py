"""Gaussian naive Bayes: one aggregation to fit, matrix products to score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.arrow_scores import with_scores
from labelloom.operators.scaling import moments


@dataclass(frozen=True)
class GaussianBayes:
    """Parameters: one row of means and variances per class."""

    classes: tuple[str, ...]
    log_prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        """Joint log likelihood, rows x classes."""
        constant = self.log_prior - 0.5 * np.log(2.0 * np.pi * self.var).sum(axis=1)
        distance = [(((x - m) ** 2) / v).sum(axis=1) for m, v in zip(self.mean, self.var)]
        return constant - 0.5 * np.column_stack(distance)

    def transform(self, df: DataFrame, vector: str = "vector_inline") -> DataFrame:
        """Add predicted_label and probability (in class order)."""
        return with_scores(df, vector, self.classes, self.log_likelihood)


def fit_parameters(df: DataFrame, vector: str = "vector_inline", label: str = "gesture_label", var_smoothing: float = 1e-9) -> DataFrame:
    """Parameter table: one row (label, n, mean, var) per class.

    The smoothing is added to the population variance as it is.
    """
    stats = moments(df.withColumn("label", F.col(label).cast("string")), vector, ("label",))
    return stats.select(
        "label", "n", "mean", F.transform("var_pop", lambda v: v + F.lit(float(var_smoothing))).alias("var")
    )


def model_of(parameters: DataFrame) -> GaussianBayes:
    """Model from its parameter table (classes x dimensions numbers)."""
    rows = sorted(parameters.collect(), key=lambda r: r["label"])
    counts = np.array([r["n"] for r in rows], dtype=np.float64)
    return GaussianBayes(
        classes=tuple(r["label"] for r in rows),
        log_prior=np.log(counts / counts.sum()),
        mean=np.array([r["mean"] for r in rows]),
        var=np.array([r["var"] for r in rows]),
    )


def fit(df: DataFrame, vector: str = "vector_inline", label: str = "gesture_label", var_smoothing: float = 1e-9) -> GaussianBayes:
    """Fit on a labelled vector table."""
    return model_of(fit_parameters(df, vector, label, var_smoothing))
