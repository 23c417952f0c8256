"""Whitening of embeddings from exact cross-products, counted over bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.session import materialize

#: Embedding entries are multiplied by this and rounded down.
SCALE = 256.0
COMPONENTS = 4
#: Vectors whose bit planes are counted at a time.
ROWS = 8192
#: Products are handed over in digits of this many bits, so that their sums fit a long.
DIGIT = 30
#: Eigenvalues below this share of their sum count as zero.
LEAST_SHARE = 1e-12


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * entry) of each entry, as longs; null for a vector that is null, empty or has null or non-finite entries."""
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf")))
    numbers = F.transform(vector, lambda e: F.floor(e.cast("double") * F.lit(SCALE)).cast("long"))
    return F.when((F.size(vector) > 0) & ~F.exists(vector, bad), numbers)


def matrix_of(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """Rows of an array column of one length as a matrix."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def plane_products(x: np.ndarray) -> list[list[int]]:
    """Exact cross-products of the columns of a matrix of longs, as Python integers.

    Each column is shifted by its least value. Every bit of the shifted values becomes a
    plane: one bit per row, packed into 64-bit words. The number of common bits of two planes,
    weighted by the places of the two bits, sums to the product of the columns.
    """
    rows, dims = x.shape
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, right for any spread
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-rows // 64)
    planes = np.zeros((bits, dims, words * 8), dtype=np.uint8)
    for bit in range(bits):
        plane = ((shifted >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8).T
        planes[bit, :, : -(-rows // 8)] = np.packbits(plane, axis=1)
    packed = planes.view(np.uint64).reshape(bits, dims, words)
    small = 2 * bits + rows.bit_length() < 63
    total = np.zeros((dims, dims), dtype=np.int64 if small else object)
    for a in range(bits):
        for b in range(a + 1):
            counts = np.empty((dims, dims), dtype=np.int64)
            for i in range(dims):
                counts[i] = np.bitwise_count(packed[a, i] & packed[b]).sum(axis=1, dtype=np.int64)
            both = counts if a == b else counts + counts.T
            total = total + (both.astype(total.dtype) << (a + b) if small else both.astype(object) * (1 << (a + b)))
    # back from shifted values: sum of (u_i + m_i)(u_j + m_j)
    m = [int(v) for v in low]
    s = [int(v) - rows * m[j] for j, v in enumerate(column_sums(x))]
    return [[int(total[i, j]) + m[i] * s[j] + m[j] * s[i] + rows * m[i] * m[j] for j in range(dims)] for i in range(dims)]


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns, as Python integers."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def digits(value: int) -> list[int]:
    """Digits of |value| from the lowest (one at least), with the sign of value."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out or [0]


def moments(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors (column x), sums and cross-products of their entries, exact.

    Each task sums its own vectors and hands over one row per pair of entries and digit,
    which are summed again; the driver gets one number per pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                x = matrix_of(batch.slice(low, ROWS))
                part, own = plane_products(x), column_sums(x)
                n += len(x)
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
                products = part if products is None else [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(products, part, strict=True)]
        if n == 0:
            return
        # row -1 holds the sums, its entry -1 the number of vectors
        values = {(-1, -1): n, **{(-1, j): v for j, v in enumerate(sums)}}
        values.update({(i, j): products[i][j] for i in range(len(sums)) for j in range(i, len(sums))})
        rows = [(i, j, k, v) for (i, j), value in values.items() for k, v in enumerate(digits(value))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "place", "v"])

    found = vectors.select("x").mapInArrow(count, "i int, j int, place int, v long").groupBy("i", "j", "place").agg(F.sum("v").alias("v")).collect()
    values: dict[tuple[int, int], int] = {}
    for r in found:
        values[r.i, r.j] = values.get((r.i, r.j), 0) + (r.v << (DIGIT * r.place) if r.v >= 0 else -(-r.v << (DIGIT * r.place)))
    n = values.get((-1, -1), 0)
    dims = 1 + max((j for _, j in values), default=-1)
    products = [[values.get((min(i, j), max(i, j)), 0) for j in range(dims)] for i in range(dims)]
    return n, [values.get((-1, j), 0) for j in range(dims)], products


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance from the largest on, their shares of the trace and their unit vectors (columns).

    The covariance is centred in integers, n * products - sums * sums, before it is divided by n^2.
    """
    dims = len(sums)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    covariance = np.array([[v / (n * n) for v in row] for row in centred])
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > LEAST_SHARE * trace, values, 0.0)
    return values, values / trace if trace > 0 else np.zeros(len(values)), vectors


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Whitened components of every vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(256 * entry). The covariance (divisor n) is that of the n distinct
    x vectors, so that copies count once; its products are exact. Component k is the unit
    eigenvector of the k-th largest eigenvalue e; whitened is the centred x along it over
    sqrt(e), explained is e over the trace. deviation is the exact sum over the entries of
    (n * x - sum)^2, null where it passes a long. identity_error is the largest absolute entry
    of the covariance of whitened, as measured over the distinct vectors, less the identity.

    Rows whose vector is null, empty or has null, infinite or NaN entries are left out, and
    those of another length than most distinct vectors (of equally many, the longer). A
    component without variance has null in whitened and 0 in explained. Entries beyond a long
    become its ends. Repeated rows are returned each; extra columns are ignored. A table
    without a vector gives no rows. The driver gets a number per pair of entries.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    usable = rows.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x is not null")
    distinct = materialize(usable.select("x").distinct(), "whitening-vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    alike = F.size("x") == lengths["d"]
    n, sums, products = moments(distinct.where(alike))
    values, shares, vectors = components(n, sums, products, most)
    some = values > 0
    kept = int(some.sum())
    # centring by n * x - sum is exact while it fits 53 bits
    scale = vectors[:, some] / np.sqrt(values[some]) / n
    total = np.array(sums, dtype=object)

    def centred(x: np.ndarray) -> np.ndarray:
        """n * x - sum of each row: longs where they fit, else Python integers."""
        largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
        return n * x - total.astype(np.int64) if largest < 1 << 62 else n * x.astype(object) - total

    def spread_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crossed = np.zeros((kept, kept))
        for batch in batches:
            if batch.num_rows:
                w = centred(matrix_of(batch)).astype(np.float64) @ scale
                crossed += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(crossed.size, dtype=np.int32)), pa.array(crossed.ravel())], names=["at", "v"])

    measured = np.zeros(kept**2)
    for r in distinct.where(alike).mapInArrow(spread_of, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        measured[r["at"]] = r["v"] / n
    error = float(np.abs(measured.reshape(kept, kept) - np.eye(kept)).max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = centred(matrix_of(batch))
            if c.dtype == object or lengths["d"] * float(max(abs(int(c.max())), abs(int(c.min())))) ** 2 >= 2.0**62:
                squares = [sum(int(v) ** 2 for v in row) for row in c]
            else:
                squares = (c**2).sum(axis=1).tolist()
            w = np.full((len(c), len(values)), np.nan)
            w[:, some] = c.astype(np.float64) @ scale
            each = len(values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(c)), each))),
                    pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(c))),
                    pa.array(np.full(len(c) * each, n, dtype=np.int64)),
                    pa.array([s if s < 1 << 63 else None for s in squares for _ in range(each)], pa.int64()),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(shares, len(c))),
                    pa.array(np.full(len(c) * each, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.where(alike).mapInArrow(project, schema)
