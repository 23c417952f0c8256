"""Landmark geometry as column expressions (no Python workers involved)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import vocab

N = vocab.LANDMARK_COUNT
COORD_DIM = 2 * N
PAIR_DIM = N * (N - 1) // 2
ANGLE_DIM = len(vocab.ANGLE_TRIPLETS)


def geometric_dim(include_angles: bool = True) -> int:
    """Length of the geometric vector."""
    return COORD_DIM + PAIR_DIM + (ANGLE_DIM if include_angles else 0)


def _axis(points: Column, axis: int) -> Column:
    return F.transform(points, lambda p: p[axis])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of *value*, with the value computed once per row.

    A lambda variable cannot be inlined, whereas a plain column is copied to
    every place it is used in when the optimizer merges projections.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _scale(landmarks: Column) -> Column:
    xs, ys = _axis(landmarks, 0), _axis(landmarks, 1)
    diagonal = F.hypot(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return let(diagonal, lambda d: F.when(d < 1e-6, F.lit(1.0)).otherwise(d))


def normalize_landmarks(landmarks: Column) -> Column:
    """xy points relative to the wrist, divided by the bounding-box diagonal.

    Points are structs (x, y), so that later expressions read plain fields. A
    diagonal below 1e-6 counts as 1; another number of points is an error, and no
    landmarks give null.
    """

    def moved(pts: Column, scale: Column, wrist: Column) -> Column:
        return F.transform(
            pts,
            lambda p: F.struct(
                ((p[0] - wrist[0]) / scale).alias("x"), ((p[1] - wrist[1]) / scale).alias("y")
            ),
        )

    def points(pts: Column) -> Column:
        inner = let(
            F.struct(_scale(pts).alias("scale"), F.get(pts, F.lit(vocab.WRIST)).alias("wrist")),
            lambda b: moved(pts, b["scale"], b["wrist"]),
        )
        error = F.raise_error(F.lit(f"expected {N} landmarks")).cast("array<struct<x:double,y:double>>")
        return F.when(pts.isNull(), F.lit(None)).when(F.size(pts) == N, inner).otherwise(error)

    return let(landmarks, points)


def flat_points(points: Column) -> Column:
    """(x, y) structs as one flat array."""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def pairwise_distances(points: Column) -> Column:
    """Distances of all point pairs i < j, row by row."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(N - 2)),
            lambda i: F.transform(
                F.slice(points, i + 2, F.lit(N - 1) - i),
                lambda q: F.hypot(F.get(points, i)["x"] - q["x"], F.get(points, i)["y"] - q["y"]),
            ),
        )
    )


def _joint_angle(points: Column, a: int, vertex: int, c: int) -> Column:
    ax, ay = points[a]["x"] - points[vertex]["x"], points[a]["y"] - points[vertex]["y"]
    cx, cy = points[c]["x"] - points[vertex]["x"], points[c]["y"] - points[vertex]["y"]
    norms = F.sqrt(ax * ax + ay * ay) * F.sqrt(cx * cx + cy * cy)
    cosine = (ax * cx + ay * cy) / norms
    return F.when(norms < 1e-8, F.lit(0.0)).otherwise(
        F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    )


def joint_angles(points: Column) -> Column:
    """Angles in radians at the fixed joints; 0 where a limb has no length."""
    return F.array(*[_joint_angle(points, *triplet) for triplet in vocab.ANGLE_TRIPLETS])


def geometric_vector(points: Column, include_angles: bool = True) -> Column:
    """Coordinates, pair distances and (optionally) joint angles of normalised points."""
    blocks = [flat_points(points), pairwise_distances(points)]
    if include_angles:
        blocks.append(joint_angles(points))
    return F.concat(*blocks)


def with_geometric_vector(
    df: DataFrame,
    landmarks: str = "landmarks",
    output: str = "vector_inline",
    include_angles: bool = True,
) -> DataFrame:
    """Add the geometric vector; rows without landmarks get null."""
    computed = let(normalize_landmarks(F.col(landmarks)), lambda pts: geometric_vector(pts, include_angles))
    return df.withColumn(output, F.when(F.col(landmarks).isNotNull(), computed))


def raw_keypoints(landmarks: Column) -> Column:
    """All landmark coordinates, flattened."""
    return F.flatten(landmarks)


def to_pixels(landmarks: Column, width: Column, height: Column) -> Column:
    """Normalised landmarks in pixels: x*width, y*height, z as it is."""
    return F.transform(landmarks, lambda p: F.array(p[0] * width, p[1] * height, p[2]))


def crop_box(landmarks: Column, width: Column, height: Column, padding: float = 0.15) -> Column:
    """Crop rectangle struct(x0, y0, x1, y1, from_landmarks).

    The padded landmark box clamped to the image, or the centred square when
    there are no usable landmarks; an empty box becomes the whole image.
    Coordinates within [0, 1] are taken as fractions of the image size.
    """
    usable = landmarks.isNotNull() & (F.size(landmarks) >= N)
    xs, ys = _axis(landmarks, 0), _axis(landmarks, 1)
    low = F.least(F.array_min(xs), F.array_min(ys))
    high = F.greatest(F.array_max(xs), F.array_max(ys))
    fractional = (high <= 1.0) & (low >= 0.0)
    wide = F.when(fractional, width.cast("double")).otherwise(F.lit(1.0))
    tall = F.when(fractional, height.cast("double")).otherwise(F.lit(1.0))

    def bounds(values: Column, unit: Column, limit: Column) -> tuple[Column, Column]:
        first, last = F.array_min(values) * unit, F.array_max(values) * unit
        pad = (last - first) * padding
        return (
            F.greatest(F.lit(0.0), first - pad).cast("int"),
            F.least(limit.cast("double"), last + pad).cast("int"),
        )

    x0, x1 = bounds(xs, wide, width)
    y0, y1 = bounds(ys, tall, height)
    side = F.least(width, height)
    left = F.floor((width - side) / 2).cast("int")
    top = F.floor((height - side) / 2).cast("int")
    box = [
        F.when(usable, hand).otherwise(square)
        for hand, square in ((x0, left), (y0, top), (x1, left + side), (y1, top + side))
    ]
    empty = (box[2] <= box[0]) | (box[3] <= box[1])
    whole = (F.lit(0), F.lit(0), width, height)
    fields = [
        F.when(empty, full).otherwise(part).cast("int").alias(name)
        for name, part, full in zip(("x0", "y0", "x1", "y1"), box, whole)
    ]
    return F.struct(*fields, usable.alias("from_landmarks"))
