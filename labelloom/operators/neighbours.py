"""Exact k-nearest-neighbour classification as a blocked join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_BLOCK_ROWS = 8_192
QUERY_CHUNK_ROWS = 5_000
_BATCH = 512


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def best_of_block(q_pdf: pd.DataFrame, t_pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The *k* rows of *t_pdf* nearest to each row of *q_pdf*, ties to the smaller id."""
    columns = ["sample_id", "neighbour_id", "label", "distance"]
    if not len(q_pdf) or not len(t_pdf):
        return pd.DataFrame(columns=columns)
    out = []
    t_pdf = t_pdf.sort_values("neighbour_id", ignore_index=True)
    points = _matrix(t_pdf["vector"])
    norms = np.einsum("ij,ij->i", points, points)
    top = min(k, len(points))
    for start in range(0, len(q_pdf), _BATCH):
        part = q_pdf.iloc[start : start + _BATCH]
        x = _matrix(part["vector"])
        square = np.einsum("ij,ij->i", x, x)[:, None] + norms[None, :] - 2.0 * (x @ points.T)
        picks, distance = _least(square, x, points, top)
        flat, distance = picks.ravel(), distance.ravel()
        out.append(
            pd.DataFrame(
                {
                    "sample_id": np.repeat(part["sample_id"].to_numpy(), top),
                    "neighbour_id": t_pdf["neighbour_id"].to_numpy()[flat],
                    "label": t_pdf["label"].to_numpy()[flat],
                    "distance": distance,
                }
            )
        )
    return pd.concat(out)


def _least(square: np.ndarray, x: np.ndarray, points: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and distances of the *top* points nearest to each row of *x*, the first of equally near ones.

    *square* has the squared distances from a matrix product. All within its error of the
    last place are compared again by differences, which are the same for equal points.
    """
    limit = np.partition(square, top - 1, axis=1)[:, top - 1]
    error = 1e-12 * (np.einsum("ij,ij->i", x, x) + np.einsum("ij,ij->i", points, points).max()) * x.shape[1]
    within = square <= (limit + 2 * error)[:, None]
    picks = np.empty((len(x), top), dtype=np.int64)
    distance = np.empty((len(x), top))
    for i, columns in enumerate(np.split(np.nonzero(within)[1], np.cumsum(within.sum(axis=1))[:-1])):
        exact = ((points[columns] - x[i]) ** 2).sum(axis=1)
        order = np.argsort(exact, kind="stable")[:top]  # columns ascend
        picks[i], distance[i] = columns[order], np.sqrt(exact[order])
    return picks, distance


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int = 5,
    *,
    train_block_rows: int = TRAIN_BLOCK_ROWS,
    query_chunk_rows: int = QUERY_CHUNK_ROWS,
    least_chunks: int | None = None,
) -> DataFrame:
    """The *k* nearest train rows of each query: (sample_id, neighbour_id, label, distance).

    *queries* and *train* have sample_id and vector; *train* also label. Both are
    hashed into even blocks. Each (query chunk, train block) cell is one group
    whose size is fixed by the block sizes; it finds the k best of its block by
    matrix products and emits those only. The best of all blocks are then merged
    per query. Nothing is broadcast, and ties go to the smaller id.
    """
    spark = queries.sparkSession
    sides = queries.select(F.lit(1).alias("q")).unionByName(train.select(F.lit(0).alias("q")))
    sizes = sides.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("queries")).first()
    n_queries, n_train = sizes["queries"], sizes["n"] - sizes["queries"]
    blocks = max(1, math.ceil(n_train / train_block_rows))
    chunks = max(1, math.ceil(n_queries / query_chunk_rows), least_chunks or 1)
    if least_chunks is None and blocks == 1:
        # With a single train block only the query side can be spread over cores.
        chunks = max(chunks, min(spark.sparkContext.defaultParallelism, math.ceil(n_queries / 64) or 1))

    def side(df: DataFrame, own: str, n_own: int, other: str, n_other: int, *columns: str) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("sample_id"), F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
            *columns,
        )

    q = side(queries, "chunk", chunks, "block", blocks, "sample_id", F.col("vector").cast("array<double>").alias("vector"))
    t = side(
        train, "block", blocks, "chunk", chunks,
        F.col("sample_id").alias("neighbour_id"),
        F.col("label").cast("string").alias("label"),
        F.col("vector").cast("array<double>").alias("vector"),
    )

    def best(q_pdf: pd.DataFrame, t_pdf: pd.DataFrame) -> pd.DataFrame:
        return best_of_block(q_pdf, t_pdf, k)

    found = (
        q.groupBy("chunk", "block")
        .cogroup(t.groupBy("chunk", "block"))
        .applyInPandas(best, "sample_id string, neighbour_id string, label string, distance double")
    )
    order = Window.partitionBy("sample_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """Majority label of each query's neighbours, the lowest label on ties.

    Adds `votes`, the share of each label among the neighbours.
    """
    counts = neighbours.groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("n"))
    ballot = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label")))
    total = F.col("total")
    return (
        counts.groupBy("sample_id")
        .agg(ballot.alias("ballot"), F.sum("n").alias("total"))
        .select(
            "sample_id",
            F.col("ballot")[0]["label"].alias("predicted_label"),
            (-F.col("ballot")[0]["n"] / total).alias("confidence"),
            F.map_from_entries(
                F.transform("ballot", lambda b: F.struct(b["label"], (-b["n"] / total)))
            ).alias("votes"),
        )
    )


def knn_predict(queries: DataFrame, train: DataFrame, k: int = 5, **sizes: int) -> DataFrame:
    """Predicted label, confidence and vote shares of each query."""
    return vote(nearest(queries, train, k, **sizes))
