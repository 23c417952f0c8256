"""Array expressions for feature vectors and score vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import vocab

DOUBLES = "array<double>"


def vector(inline: Column) -> Column:
    """The vector as doubles; a missing vector is an error."""
    return F.coalesce(inline.cast(DOUBLES), F.raise_error(F.lit("row has no vector_inline")).cast(DOUBLES))


def is_zero_vector(inline: Column) -> Column:
    """True when the vector is missing, empty or all zeros."""
    return (F.coalesce(F.size(inline), F.lit(0)) <= 0) | ~F.exists(inline, lambda x: x != 0)


def concat_blocks(blocks: Mapping[str, Column], order: Sequence[str] | None = None) -> Column:
    """Blocks joined in family order; every family of the order must be there."""
    order = tuple(order or vocab.FAMILY_ORDER)
    missing = [name for name in order if name not in blocks]
    extra = sorted(set(blocks) - set(order))
    if missing:
        raise KeyError(f"missing feature blocks: {missing}")
    if extra:
        raise ValueError(f"feature blocks outside the order: {extra}")

    def checked(name: str) -> Column:
        block = blocks[name].cast(DOUBLES)
        error = F.raise_error(F.lit(f"empty feature block '{name}'")).cast(DOUBLES)
        return F.when(F.coalesce(F.size(block), F.lit(0)) > 0, block).otherwise(error)

    return F.concat(*[checked(name) for name in order])


def zeros(dim: int) -> Column:
    """Placeholder vector of *dim* zeros."""
    return F.array_repeat(F.lit(0.0), dim)


def block_sequence(inline: Column, grid: tuple[int, int, int]) -> Column:
    """Flat block-raster vector as a sequence of blocks: rows*cols x features."""
    rows, cols, width = grid
    return F.transform(
        F.sequence(F.lit(0), F.lit(rows * cols - 1)),
        lambda i: F.slice(inline, i * width + 1, width),
    )


def block_channels(inline: Column, grid: tuple[int, int, int]) -> Column:
    """Flat block-raster vector as channels-first maps: features x rows x cols."""
    rows, cols, width = grid
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda c: F.transform(
            F.sequence(F.lit(0), F.lit(rows - 1)),
            lambda y: F.transform(
                F.sequence(F.lit(0), F.lit(cols - 1)),
                lambda x: F.get(inline, (y * cols + x) * width + c),
            ),
        ),
    )


def feature_layout(dim: int, grid: tuple[int, int, int], family: str = "", head: int = 260) -> tuple[str, int]:
    """Layout of a vector: kind (`hybrid`, `hog`, `flat`) and length of its geometric head."""
    rows, cols, width = grid
    blocks = rows * cols * width
    if dim == head + blocks or "hybrid" in family:
        return "hybrid", head
    return ("hog" if dim == blocks or family == "hog" else "flat"), 0


def argmax(scores: Column) -> Column:
    """1-based position of the greatest score, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def softmax(scores: Column) -> Column:
    """Exponentials shifted by the maximum, normalised to sum 1."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)


def as_probabilities(scores: Column) -> Column:
    """Scores unchanged when they already are a distribution, else their softmax."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    is_distribution = (F.array_min(scores) >= 0) & (F.abs(total - 1.0) <= 0.01)
    return F.when(is_distribution, scores).otherwise(softmax(scores))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equally long vectors."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d
    )
