"""Row handling and numpy helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a class for JVM and Python patterns.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text handled by one block of numpy work: bounds the memory of a Python worker.
BLOCK_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text_col: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Id and text under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), *more)


def row_key() -> list[Column]:
    """Columns that tell rows apart even where ids repeat or are null: equal keys are equal rows.

    The id is replaced by -1 where null, with a flag, so that keys join by equality.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("k2"),
    ]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts hold about *limit* bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(byte_lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def byte_lengths(values: pa.Array) -> np.ndarray:
    """Bytes of each string, null as 0."""
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, a line feed after each; and the n + 1 starts."""
    lengths = byte_lengths(values)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = b"\n".join((v or "").encode("utf-8", "surrogatepass") for v in values.to_pylist()) + b"\n"
    return np.frombuffer(data, dtype=np.uint8), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits (an invertible finaliser of shifts and odd factors)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Random value of each byte, so that the polynomial hash mixes well.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
BASE = np.uint64(0xA0761D6478BD642F)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    size, factor = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while size < n:
            take = min(size, n - size)
            out[size : size + take] = out[:take] * factor
            size += take
            factor = factor * factor
    return out


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty byte segment [start, end); segments ascend and don't overlap."""
    lengths = ends - starts
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
    at = within + np.repeat(starts, lengths)
    values = BYTE_VALUES[data[at]] * powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))


SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than white space."""
    inside = ~SPACE_BYTE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[0::2], edges[1::2]
