"""Pixel work on Arrow batches: colour, crop, resize, gradient histograms.

Spark partitions the images; the numpy helpers below see one image or a few of one size at a time.
Images are rows with `height`, `width`, `nChannels` and `data` (row by row,
channels interleaved in the order of `spark.read.format("image")`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.geometry import crop_box
from labelloom.session import spread

# Luma weights, clipping and regularisation of the block norm.
LUMA = np.array([0.2125, 0.7154, 0.0721])
CLIP = 0.2
NORM_EPS = 1e-5

# Images are large: at most this many of them share an Arrow batch.
IMAGE_BATCH_ROWS = 256
# Crops whose gradients are taken at once; their arrays stay in the processor's cache.
CROPS = 16
# Weight matrices that a task keeps.
WEIGHTS = 256
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass(frozen=True)
class HogSettings:
    """Parameters of the descriptor; the defaults give 7 x 7 blocks of 36 values."""

    orientations: int = 9
    cell: tuple[int, int] = (8, 8)
    block: tuple[int, int] = (2, 2)
    crop: tuple[int, int] = (64, 64)
    padding: float = 0.15
    square_root: bool = True

    def grid(self) -> tuple[int, int, int]:
        """Block rows, block columns, values per block."""
        cells = [size // c for size, c in zip(self.crop, self.cell)]
        rows, cols = (n - b + 1 for n, b in zip(cells, self.block))
        return rows, cols, self.block[0] * self.block[1] * self.orientations

    def dim(self) -> int:
        """Length of the descriptor."""
        rows, cols, width = self.grid()
        return rows * cols * width


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels as height x width x channels."""
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def three_channels(image: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Grey repeated, alpha dropped; *reverse* swaps the channel order of colour images."""
    if image.shape[2] == 1:
        return np.repeat(image, 3, axis=2)
    if image.shape[2] == 4:
        return image[:, :, :3]
    return image[:, :, ::-1] if reverse else image


def half(image: np.ndarray, side: str) -> np.ndarray:
    """Left or right half of the image; any other side is the whole image."""
    middle = image.shape[1] // 2
    return {"left_half": image[:, :middle], "right_half": image[:, middle:]}.get(side, image)


def _area_weights(n_in: int, n_out: int) -> np.ndarray:
    """Overlap of each output cell with each input pixel, rows summing to 1."""
    edges = np.arange(n_out + 1) * (n_in / n_out)
    pixels = np.arange(n_in)
    overlap = np.minimum(edges[1:, None], pixels + 1) - np.maximum(edges[:-1, None], pixels)
    return np.clip(overlap, 0.0, None) / (n_in / n_out)


def _linear_weights(n_in: int, n_out: int) -> np.ndarray:
    """Weights for enlarging: a blend only where an output cell straddles two pixels."""
    step = n_in / n_out
    weights = np.zeros((n_out, n_in))
    for i in range(n_out):
        left = min(int(i * step), n_in - 1)
        share = (i + 1) - (left + 1) / step
        share = 0.0 if share <= 0 else share - np.floor(share)
        weights[i, left] += 1.0 - share
        weights[i, min(left + 1, n_in - 1)] += share
    return weights


def resize(image: np.ndarray, height: int, width: int, known: dict | None = None) -> np.ndarray:
    """Area resize, as a pair of weight matrices; 8-bit result. *known* keeps the matrices of a task."""
    rows, cols = image.shape[:2]
    if (rows, cols) == (height, width):
        return image
    weights = _area_weights if rows >= height and cols >= width else _linear_weights
    known = {} if known is None else known
    if len(known) >= WEIGHTS:
        known.clear()
    for sizes in ((rows, height), (cols, width)):
        if (weights, *sizes) not in known:
            known[weights, *sizes] = weights(*sizes)
    down, across = known[weights, rows, height], known[weights, cols, width]
    scaled = np.stack([down @ image[:, :, i].astype(np.float64) @ across.T for i in range(image.shape[2])], axis=2)
    return np.clip(np.rint(scaled), 0, 255).astype(np.uint8)


def crop_and_resize(image: np.ndarray, box: tuple[int, int, int, int], size: tuple[int, int], known: dict | None = None) -> np.ndarray:
    """Box (x0, y0, x1, y1) of the image at *size* (width, height)."""
    x0, y0, x1, y1 = box
    return resize(image[y0:y1, x0:x1], size[1], size[0], known)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma in [0, 1]."""
    return (image[:, :, :3] / 255.0) @ LUMA


def luma(image: np.ndarray, box: tuple[int, int, int, int], size: tuple[int, int], known: dict) -> np.ndarray:
    """Luma of the box (x0, y0, x1, y1) of an image at *size* (width, height); *known* keeps what all images of a task need."""
    if image.shape[2] != 1:
        return grey(crop_and_resize(three_channels(image), box, size, known))
    levels = known.get("levels")
    if levels is None:  # three equal channels have one of 256 values
        levels = known["levels"] = grey(three_channels(np.arange(256, dtype=np.uint8).reshape(256, 1, 1))).ravel()
    return levels[crop_and_resize(image, box, size, known)[:, :, 0]]


def hogs(lumas: np.ndarray, settings: HogSettings) -> np.ndarray:
    """Histograms of oriented gradients of images of one size, blocks in raster order, clipped L2 norm.

    Unsigned orientations without interpolation; a cell holds the mean magnitude
    of each orientation bin.
    """
    pixels = np.sqrt(lumas) if settings.square_root else lumas
    dy, dx = np.zeros_like(pixels), np.zeros_like(pixels)
    dy[:, 1:-1] = pixels[:, 2:] - pixels[:, :-2]
    dx[:, :, 1:-1] = pixels[:, :, 2:] - pixels[:, :, :-2]
    magnitude = np.sqrt(dx * dx + dy * dy)
    angle = np.rad2deg(np.arctan2(dy, dx))
    angle[angle == 180.0] = 0.0
    angle[angle < 0] += 180.0
    n = settings.orientations
    bins = np.minimum((angle / (180.0 / n)).astype(int), n - 1)

    (cell_h, cell_w), (block_h, block_w) = settings.cell, settings.block
    count, rows, cols = len(pixels), pixels.shape[1] // cell_h, pixels.shape[2] // cell_w
    inner = slice(None), slice(0, rows * cell_h), slice(0, cols * cell_w)
    y, x = np.indices((rows * cell_h, cols * cell_w))
    cell = (y // cell_h) * cols + x // cell_w + (np.arange(count) * (rows * cols))[:, None, None]
    sums = np.bincount((cell * n + bins[inner]).ravel(), weights=magnitude[inner].ravel(), minlength=count * rows * cols * n)
    cells = sums.reshape(count, rows, cols, n) / (cell_h * cell_w)

    blocks = np.lib.stride_tricks.sliding_window_view(cells, (block_h, block_w), axis=(1, 2))
    blocks = blocks.transpose(0, 1, 2, 4, 5, 3).reshape(count, rows - block_h + 1, cols - block_w + 1, -1)
    for limit in (CLIP, None):
        blocks = blocks / np.sqrt((blocks**2).sum(axis=3, keepdims=True) + NORM_EPS**2)
        if limit is not None:
            blocks = np.minimum(blocks, limit)
    return blocks.reshape(count, -1)


def hog(luma: np.ndarray, settings: HogSettings) -> np.ndarray:
    """`hogs` of one image."""
    return hogs(luma[None], settings)[0]


def bound_batches(images: DataFrame) -> None:
    """Lower the session's Arrow batch size to one that suits images."""
    conf = images.sparkSession.conf
    rows = int(conf.get(BATCH_CONF))
    if rows <= 0 or rows > IMAGE_BATCH_ROWS:
        conf.set(BATCH_CONF, str(IMAGE_BATCH_ROWS))


def with_hog(images: DataFrame, settings: HogSettings = HogSettings(), output: str = "vector_inline") -> DataFrame:
    """Add the descriptor of each image's hand crop and the crop box.

    *images* may have a `landmarks` column; the box is computed by column
    expressions, and only the pixels go through Arrow.
    """
    bound_batches(images)
    images = images if images.isStreaming else spread(images)
    if "landmarks" in images.columns:
        landmarks = F.col("landmarks")
    else:
        landmarks = F.lit(None).cast("array<array<double>>")
    boxed = images.withColumn("crop", crop_box(landmarks, F.col("width"), F.col("height"), settings.padding))

    @F.pandas_udf("array<double>")
    def describe(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known: dict = {}
        for batch in batches:
            vectors, images = [], list(zip(*batch))
            for low in range(0, len(images), CROPS):
                crops = [luma(decode(data, h, w, c), box, settings.crop, known) for data, h, w, c, *box in images[low : low + CROPS]]
                vectors.extend(hogs(np.stack(crops), settings))
            yield pd.Series(vectors)

    inputs = ["data", "height", "width", "nChannels", "crop.x0", "crop.y0", "crop.x1", "crop.y1"]
    return boxed.withColumn(output, describe(*[F.col(c) for c in inputs]))


def prepare_frames(
    images: DataFrame, size: tuple[int, int] | None = None, region: str = "none"
) -> DataFrame:
    """Images as three channels in RGB order, cut to a half and resized (width, height)."""
    bound_batches(images)
    schema = images.schema

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"]):
                image = half(three_channels(decode(data, h, w, c), reverse=True), region)
                if size and (image.shape[1], image.shape[0]) != tuple(size):
                    image = resize(image, size[1], size[0])
                rows.append((image.shape[0], image.shape[1], 3, np.ascontiguousarray(image).tobytes()))
            new = pd.DataFrame(rows, columns=["height", "width", "nChannels", "data"], index=pdf.index)
            yield pdf.assign(**{c: new[c] for c in new.columns})

    return images.mapInPandas(work, schema)


def image_columns(images: DataFrame) -> DataFrame:
    """Flatten the struct of `spark.read.format("image")`."""
    rest = [c for c in images.columns if c != "image"]
    return images.select(
        *rest,
        F.regexp_replace("image.origin", r"^file:/+", "/").alias("image_path"),
        "image.height",
        "image.width",
        "image.nChannels",
        "image.data",
    )
