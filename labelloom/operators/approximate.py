"""Approximate nearest neighbours: random-projection buckets, several probes, exact distances.

Orthonormal random directions, each cut at the median of a bounded sample, give every
train row one bucket. A query looks into its own bucket and into those that lie nearest
behind the cuts: the squared distances to the cuts crossed add up to a lower bound of the
squared distance to any row of the bucket. Distances to the rows found are exact, and the
bound of the nearest bucket left out tells which results are surely complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.neighbours import best_of_block, vote
from labelloom.session import materialize

#: Rows of which directions, cuts and the number of probes are fitted.
SAMPLE_ROWS = 4_096
SAMPLE_QUERIES = 256
#: Mean rows of a bucket, and rows of a part of a bucket that meet in one task with a part of its queries.
BUCKET_ROWS = 1_024
#: Rows whose comparison with a query takes as long as one more copy of the query and its results.
PROBE_ROWS = 1_000
PART_ROWS = 8_192
PART_QUERIES = 5_000
#: Cuts that a query may cross, those nearest to it; their subsets are the probes.
MOST_CROSSED = 12
MOST_CUTS = 20


@dataclass(frozen=True)
class Buckets:
    """Directions (columns), cuts, and how many buckets a query looks into."""

    directions: np.ndarray
    cuts: np.ndarray
    probes: int
    estimated_recall: float

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions - self.cuts if len(self.cuts) else np.zeros((len(vectors), 0))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket of each row."""
        return (self.margins(vectors) > 0) @ (1 << np.arange(len(self.cuts), dtype=np.int64))

    def probed(self, vectors: np.ndarray, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets to look into for each row, the nearest first, and a bound on squared distances in the others."""
        probes = probes or self.probes
        m = self.margins(vectors)
        square = m**2
        crossed = min(len(self.cuts), MOST_CROSSED)
        nearest = np.argsort(square, axis=1, kind="stable")
        some = nearest[:, :crossed]
        subsets = (np.arange(1 << crossed)[:, None] >> np.arange(crossed)) & 1
        cost = np.take_along_axis(square, some, axis=1) @ subsets.T
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        flips = np.einsum("qtj,qj->qt", subsets[order], 1 << some)
        if probes < cost.shape[1]:
            bound = np.partition(cost, probes, axis=1)[:, probes]
        else:
            bound = np.full(len(vectors), np.inf)
        if crossed < len(self.cuts):
            bound = np.minimum(bound, np.take_along_axis(square, nearest[:, crossed : crossed + 1], axis=1)[:, 0])
        return self.codes(vectors)[:, None] ^ flips, bound


def fit_buckets(
    train: DataFrame, k: int = 5, *, recall: float = 0.95, bucket_rows: int = BUCKET_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 42
) -> Buckets:
    """Buckets whose probes find the *k* nearest rows with about the given recall, at the least work.

    Fitted on at most *sample_rows* rows (those first in a hashed order). For each number of
    cuts, up to buckets of *bucket_rows* rows, the number of probes doubles until the nearest
    rows within the sample, which lie farther away than those among all rows, are found.
    A probe costs a copy of the query as well as the rows of the bucket: of the choices that
    reach the recall, the one with the least of both is taken. Rows that no cuts part, so that
    nearly all buckets would be probed, stay in few buckets; with none the search is exact.
    """
    n = train.count()
    first = train.select("sample_id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id").limit(sample_rows)
    rows = [np.asarray(r["vector"]) for r in first.select("vector").collect()]
    if not rows:
        return Buckets(np.zeros((0, 0)), np.zeros(0), 1, 1.0)
    x = np.vstack(rows)
    dims = x.shape[1]
    draw = np.random.default_rng(seed)
    basis = np.linalg.qr(draw.normal(size=(dims, dims)))[0]
    queries = np.arange(min(len(x), SAMPLE_QUERIES))
    square = (x[queries] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2.0 * x[queries] @ x.T
    square[queries, queries] = np.inf
    near = np.argsort(square, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    cuts = min(MOST_CUTS, dims, max(0, math.ceil(math.log2(max(n, 1) / bucket_rows))))
    best, least = Buckets(basis[:, :0], np.zeros(0), 1, 1.0), n + PROBE_ROWS
    for some in range(1, cuts + 1):
        directions = basis[:, :some]
        made = Buckets(directions, np.median(x @ directions, axis=0), 1, 1.0)
        codes = made.codes(x)
        probes, most, each = 1, 1 << min(some, MOST_CROSSED), n / (1 << some) + PROBE_ROWS
        while probes <= most and probes * each < least:
            looked, _ = made.probed(x[queries], probes)
            found = (codes[near][:, :, None] == looked[:, None, :]).any(axis=2).mean() if near.size else 1.0
            if found >= recall:
                best, least = Buckets(directions, made.cuts, probes, float(found)), probes * each
            probes *= 2
    return best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_approximate(queries: DataFrame, train: DataFrame, k: int = 5, buckets: Buckets | None = None, **fit: float) -> DataFrame:
    """About the *k* nearest train rows of each query: (sample_id, neighbour_id, label, distance, rank, complete).

    *queries* and *train* have sample_id and vector, *train* also label. Train rows are
    shuffled once, uncopied, by their bucket; each query goes to its probed buckets that hold
    rows. Buckets with more than PART_ROWS rows, or looked into by more than PART_QUERIES
    queries, are dealt out in parts that meet pairwise, so copies of one vector stay
    spread. Each part emits its k best. `complete` tells that no row left out can be nearer
    than the last returned; ties go to the smaller id.
    """
    buckets = buckets or fit_buckets(train, k, **fit)

    def code_train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = buckets.codes(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), *batch.columns], names=["code", *batch.schema.names])

    def code_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) >> min(len(buckets.cuts), MOST_CROSSED))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                looked, bound = buckets.probed(_matrix(part.column("vector")))
                offsets = pa.array(np.arange(0, looked.size + 1, looked.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(looked.ravel(), pa.int64())), pa.array(bound)],
                    names=[*part.schema.names, "codes", "bound"],
                )

    vector = F.col("vector").cast("array<double>").alias("vector")
    t = train.select(F.col("sample_id").alias("neighbour_id"), F.col("label").cast("string").alias("label"), vector)
    t = materialize(t.mapInArrow(code_train, "code long, neighbour_id string, label string, vector array<double>"), "bucket-rows")
    q = queries.select("sample_id", vector)
    q = materialize(q.mapInArrow(code_queries, "sample_id string, vector array<double>, codes array<bigint>, bound double"), "bucket-queries")
    # at most one row per bucket
    rows_in = t.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    asked = q.select(F.explode("codes").alias("code")).groupBy("code").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("shares"))
    plan = materialize(rows_in.join(asked, "code"), "bucket-plan")

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str, key: str) -> DataFrame:
        """Rows in their own part of a bucket, once for each part of the other side."""
        return (
            df.join(F.broadcast(plan), "code")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
            .drop("parts", "shares")
        )

    t = dealt(t, "part", "parts", "share", "shares", "neighbour_id")
    q = dealt(q.select("sample_id", "vector", "bound", F.explode("codes").alias("code")), "share", "shares", "part", "parts", "sample_id")

    def best(q_pdf: pd.DataFrame, t_pdf: pd.DataFrame) -> pd.DataFrame:
        found = best_of_block(q_pdf, t_pdf, k)
        return found.merge(q_pdf[["sample_id", "bound"]].drop_duplicates("sample_id"), on="sample_id")

    found = (
        q.groupBy("code", "share", "part")
        .cogroup(t.groupBy("code", "share", "part"))
        .applyInPandas(best, "sample_id string, neighbour_id string, label string, distance double, bound double")
    )
    order = Window.partitionBy("sample_id").orderBy("distance", "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    last = F.max("distance").over(Window.partitionBy("sample_id"))
    many = F.count(F.lit(1)).over(Window.partitionBy("sample_id")) == k
    return ranked.withColumn("complete", many & (last * last <= F.col("bound")) | (F.col("bound") == float("inf"))).drop("bound")


def knn_predict_approximate(queries: DataFrame, train: DataFrame, k: int = 5, buckets: Buckets | None = None, **fit: float) -> DataFrame:
    """Predicted label, confidence and vote shares of each query by its approximate neighbours."""
    return vote(nearest_approximate(queries, train, k, buckets, **fit))


def recall_against(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (sample_id, neighbour_id) that were found."""
    hits = exact.select("sample_id", "neighbour_id").join(found.select("sample_id", "neighbour_id", F.lit(1).alias("hit")), ["sample_id", "neighbour_id"], "left")
    row = hits.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")).first()
    return (row["hits"] or 0) / row["n"] if row["n"] else 1.0
