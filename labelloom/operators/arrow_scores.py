"""Scoring of vectors with numpy models inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows of which a task makes features or scores at a time; they may be far wider than their vectors.
BLOCK_ROWS = 1_024


def blocks(batch: pa.RecordBatch, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most *rows* rows; nothing if it is empty."""
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def softmax_rows(scores: np.ndarray) -> np.ndarray:
    """Exponentials of each row, shifted by its maximum, normalised to sum 1."""
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def with_scores(
    df: DataFrame, vector: str, classes: Sequence[str], scores: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """Add predicted_label and probability (softmax of *scores*, in class order).

    *scores* maps a matrix of vectors to rows x classes. Batches pass through as
    they are, in blocks of few rows, with two columns appended.
    """
    names = list(classes)
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("predicted_label", T.StringType()),
            T.StructField("probability", T.ArrayType(T.DoubleType())),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (block for whole in batches for block in blocks(whole)):
            flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False)
            raw = scores(flat.astype(np.float64).reshape(batch.num_rows, -1))
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(names), pa.int32())
            added = {
                "predicted_label": pa.array([names[i] for i in raw.argmax(axis=1)], pa.string()),
                "probability": pa.ListArray.from_arrays(offsets, pa.array(softmax_rows(raw).ravel())),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return df.mapInArrow(score, schema)
