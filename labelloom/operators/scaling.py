"""Standard scaling with population deviations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def moments(df: DataFrame, vector: str = "vector_inline", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean vector and population variance vector, optionally per group.

    One vectorised aggregation, combined per task before the shuffle; vectors
    are never exploded into rows.
    """
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vector)))
    n = F.col("s.count")
    return (
        df.groupBy(*by)
        .agg(stats.alias("s"))
        .select(
            *by,
            n.alias("n"),
            vector_to_array("s.mean").alias("mean"),
            # The summary divides by n - 1; a single row has variance 0 either way.
            F.transform(vector_to_array("s.variance"), lambda v: v * (n - 1) / n).alias("var_pop"),
        )
    )


def scaler_stats(df: DataFrame, vector: str = "vector_inline") -> DataFrame:
    """Mean and scale per dimension in long form (dim, mean, scale).

    A deviation below 1e-8 counts as scale 1.
    """
    deviation = F.sqrt(F.col("var"))
    return moments(df, vector).select(
        F.posexplode(F.arrays_zip("mean", "var_pop")).alias("dim", "m")
    ).select("dim", F.col("m.mean").alias("mean"), F.col("m.var_pop").alias("var")).select(
        "dim", "mean", F.when(deviation < EPS, F.lit(1.0)).otherwise(deviation).alias("scale")
    )


def fit_scaler(df: DataFrame, input_col: str = "features", output_col: str = "scaled") -> PipelineModel:
    """Scaler as a model of built-in stages: subtract the mean, divide by the deviation."""
    centred = f"{output_col}_centred"
    summary = Summarizer.metrics("variance", "count").summary(F.col(input_col))
    row = df.agg(summary.alias("s")).select("s.variance", "s.count").first()
    n = row["count"]
    deviations = [(v * (n - 1) / n) ** 0.5 for v in row["variance"]]
    scales = Vectors.dense([1.0 if d < EPS else 1.0 / d for d in deviations])
    return Pipeline(
        stages=[
            StandardScaler(withMean=True, withStd=False, inputCol=input_col, outputCol=centred),
            ElementwiseProduct(scalingVec=scales, inputCol=centred, outputCol=output_col),
        ]
    ).fit(df)


def scale_parameters(df: DataFrame, vector: str = "vector_inline") -> tuple[list[float], list[float]]:
    """Means and scales of the dimensions, from one pass over the rows."""
    row = moments(df, vector).first()
    deviations = [math.sqrt(v) for v in row["var_pop"]]
    return list(row["mean"]), [1.0 if d < EPS else d for d in deviations]


def scaled(vector: Column, mean: list[float], scale: list[float]) -> Column:
    """Array vector scaled by known parameters, by numpy over Arrow batches."""
    centre, width = np.asarray(mean, dtype=np.float64), np.asarray(scale, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def scale_batch(vectors: pd.Series) -> pd.Series:
        known = [v for v in vectors if v is not None]
        done = iter((np.stack(known) - centre) / width) if known else iter(())
        return pd.Series([None if v is None else next(done) for v in vectors], dtype=object)

    return scale_batch(vector)
