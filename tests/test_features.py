import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom import vocab
from labelloom.functions import geometry, pixels, quality, vectors
from labelloom.plans.jobs import extract_features

RNG = np.random.default_rng(42)


def hand():
    xy = RNG.uniform(0.2, 0.8, (21, 2))
    return np.column_stack([xy, RNG.uniform(-0.05, 0.05, 21)])


def frame(spark, *hands):
    rows = [(str(i), None if h is None else h.tolist()) for i, h in enumerate(hands)]
    return spark.createDataFrame(rows, "sample_id string, landmarks array<array<double>>")


def brute_geometry(h):
    xy = h[:, :2]
    scale = np.linalg.norm(xy.max(axis=0) - xy.min(axis=0))
    p = (xy - xy[0]) / (scale if scale >= 1e-6 else 1.0)
    pairs = [math.dist(p[i], p[j]) for i in range(21) for j in range(i + 1, 21)]
    angles = []
    for a, b, c in vocab.ANGLE_TRIPLETS:
        u, w = p[a] - p[b], p[c] - p[b]
        norm = np.linalg.norm(u) * np.linalg.norm(w)
        angles.append(0.0 if norm < 1e-8 else math.acos(max(-1.0, min(1.0, float(u @ w) / norm))))
    return np.concatenate([p.ravel(), pairs, angles])


def test_geometric_vector_equals_brute_force(spark):
    hands = [hand() for _ in range(5)] + [np.zeros((21, 3))]
    rows = geometry.with_geometric_vector(frame(spark, *hands)).orderBy("sample_id").collect()
    for row, h in zip(rows, hands):
        assert len(row["vector_inline"]) == geometry.geometric_dim() == 260
        np.testing.assert_allclose(row["vector_inline"], brute_geometry(h), atol=1e-12)


def test_geometry_without_angles_and_without_hand(spark):
    rows = geometry.with_geometric_vector(frame(spark, hand(), None), include_angles=False).orderBy("sample_id").collect()
    assert len(rows[0]["vector_inline"]) == geometry.geometric_dim(False) == 252
    assert rows[1]["vector_inline"] is None


def test_wrong_number_of_landmarks_is_an_error(spark):
    with pytest.raises(Exception, match="expected 21 landmarks"):
        geometry.with_geometric_vector(frame(spark, hand()[:20])).collect()


def test_raw_keypoints(spark):
    h = hand()
    row = frame(spark, h).select(geometry.raw_keypoints(F.col("landmarks")).alias("v")).first()
    np.testing.assert_array_equal(row["v"], h.ravel())


def box(spark, h, width=640, height=480):
    df = frame(spark, h).select(geometry.crop_box(F.col("landmarks"), F.lit(width), F.lit(height)).alias("b"))
    return df.first()["b"].asDict()


def test_crop_boxes(spark):
    h = hand()
    h[:, :2] = [[0.25, 0.5]]
    h[1, :2] = [0.5, 0.75]
    b = box(spark, h)
    assert (b["x0"], b["y0"], b["x1"], b["y1"]) == (136, 222, 344, 378)
    h[:, :2] *= [640, 480]
    assert box(spark, h) == b
    assert tuple(box(spark, None).values()) == (80, 0, 560, 480, False)
    h[:, :2] = 700.0
    assert tuple(box(spark, h).values())[:4] == (0, 0, 640, 480)


def test_extraction_flags(spark):
    df = frame(spark, hand(), None, hand()).withColumn(
        "confidence", F.when(F.col("sample_id") == "0", 0.4).otherwise(0.9)
    ).withColumn("height", F.when(F.col("sample_id") < "2", 480)).withColumn("width", F.lit(640))
    rows = extract_features(df, "geometric").orderBy("sample_id").collect()
    assert [r["extraction_ok"] for r in rows] == [True, False, False]
    assert rows[0]["quality_flags"] == {"low_confidence": True}
    assert rows[1]["quality_flags"] == {"detection_failed": True} and rows[1]["confidence"] is None
    assert rows[2]["quality_flags"] == {"missing_image": True}
    assert set(rows[1]["vector_inline"]) == {0.0} and len(rows[1]["vector_inline"]) == 260


def test_flags_merge_without_duplicate_keys(spark):
    a, b = F.create_map(F.lit("x"), F.lit(True)), F.create_map(F.lit("x"), F.lit(False))
    row = spark.range(1).select(quality.merge_flags(a, b).alias("m"), quality.merge_flags(None or F.lit(None).cast("map<string,boolean>"), a).alias("n")).first()
    assert row["m"] == {"x": False} and row["n"] == {"x": True}


def test_blocks_are_checked():
    with pytest.raises(KeyError):
        vectors.concat_blocks({"hog": F.lit(None)}, ("geometric", "hog"))
    with pytest.raises(ValueError):
        vectors.concat_blocks({"hog": F.lit(None), "x": F.lit(None)}, ("hog",))


def test_empty_block_and_missing_vector_are_errors(spark):
    empty = F.array().cast("array<double>")
    with pytest.raises(Exception, match="empty feature block"):
        spark.range(1).select(vectors.concat_blocks({"hog": empty}, ("hog",))).collect()
    with pytest.raises(Exception, match="no vector_inline"):
        spark.range(1).select(vectors.vector(F.lit(None).cast("array<double>"))).collect()


def test_layouts():
    grid = pixels.HogSettings().grid()
    assert grid == (7, 7, 36) and pixels.HogSettings().dim() == 1764
    assert vectors.feature_layout(2024, grid) == ("hybrid", 260)
    assert vectors.feature_layout(1764, grid) == ("hog", 0)
    assert vectors.feature_layout(100, grid) == ("flat", 0)


def brute_hog(image):
    """Loop version on a 64 x 64 grey image."""
    g = np.sqrt(image / 255.0)
    cells = np.zeros((8, 8, 9))
    for y in range(64):
        for x in range(64):
            dy = g[y + 1, x] - g[y - 1, x] if 0 < y < 63 else 0.0
            dx = g[y, x + 1] - g[y, x - 1] if 0 < x < 63 else 0.0
            angle = math.degrees(math.atan2(dy, dx)) % 180.0
            cells[y // 8, x // 8, min(int(angle // 20), 8)] += math.hypot(dx, dy) / 64
    out = []
    for by in range(7):
        for bx in range(7):
            v = cells[by : by + 2, bx : bx + 2].ravel()
            v = v / math.sqrt((v**2).sum() + 1e-10)
            v = np.minimum(v, 0.2)
            out.append(v / math.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(out)


def test_hog_equals_brute_force(spark):
    pictures = [RNG.integers(0, 256, (64, 64), dtype=np.uint8), np.zeros((64, 64), dtype=np.uint8)]
    pictures[1][16:48, 16:48] = 200
    rows = [(str(i), 64, 64, 1, p.tobytes()) for i, p in enumerate(pictures)]
    df = spark.createDataFrame(rows, "sample_id string, height int, width int, nChannels int, data binary")
    got = pixels.with_hog(df).orderBy("sample_id").collect()
    for row, picture in zip(got, pictures):
        v = np.array(row["vector_inline"])
        assert v.shape == (1764,) and np.isfinite(v).all() and v.max() <= 1.0
        np.testing.assert_allclose(v, brute_hog(picture.astype(float)), atol=1e-9)


def test_resize_keeps_means_and_enlarges():
    image = RNG.integers(0, 256, (128, 96, 3), dtype=np.uint8)
    small = pixels.resize(image, 32, 32)
    exact = image.reshape(32, 4, 32, 3, 3).mean(axis=(1, 3))
    assert np.abs(small - exact).max() <= 0.5
    flat = np.full((5, 5, 1), 7, dtype=np.uint8)
    assert set(pixels.resize(flat, 12, 9).ravel()) == {7}


def test_frame_preparation(spark):
    grey = RNG.integers(0, 256, (240, 640), dtype=np.uint8)
    colour = RNG.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    rows = [("g", 240, 640, 1, grey.tobytes()), ("c", 4, 6, 3, colour.tobytes())]
    df = spark.createDataFrame(rows, "sample_id string, height int, width int, nChannels int, data binary")
    out = {r["sample_id"]: r for r in pixels.prepare_frames(df).collect()}
    assert (out["g"]["height"], out["g"]["width"], out["g"]["nChannels"]) == (240, 640, 3)
    back = np.frombuffer(out["c"]["data"], dtype=np.uint8).reshape(4, 6, 3)
    np.testing.assert_array_equal(back, colour[:, :, ::-1])
    right = {r["sample_id"]: r for r in pixels.prepare_frames(df, (2, 2), "right_half").collect()}
    assert (right["c"]["height"], right["c"]["width"]) == (2, 2)


def png(image):
    """A grey PNG of *image*."""
    def chunk(kind, data):
        body = kind + data
        return len(data).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big")

    h, w = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_hog_from_image_files(spark, tmp_path):
    picture = RNG.integers(0, 256, (64, 64), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(picture))
    df = pixels.image_columns(spark.read.format("image").load(str(tmp_path)))
    samples = df.select("*", F.col("image_path").alias("sample_id"), F.lit(None).cast("array<array<double>>").alias("landmarks"), F.lit(None).cast("double").alias("confidence"))
    row = extract_features(samples, "hog").first()
    assert row["extraction_ok"] and row["quality_flags"] == {"landmark_crop_fallback": True}
    np.testing.assert_allclose(row["vector_inline"], brute_hog(picture.astype(float)), atol=1e-9)


def test_descriptors_of_many_images_equal_those_one_by_one_and_weights_are_kept(monkeypatch):
    draw = np.random.default_rng(3)
    settings, known, made = pixels.HogSettings(), {}, []
    linear = pixels._linear_weights
    monkeypatch.setattr(pixels, "_linear_weights", lambda *sizes: made.append(sizes) or linear(*sizes))
    sides = (5, 17, 64, 17, 63, 5)
    images = [draw.integers(0, 256, (side, 64, 1), dtype=np.uint8) for side in sides]
    boxes = [(0, 0, side, side) for side in sides]
    lumas = [pixels.luma(i, b, settings.crop, known) for i, b in zip(images, boxes)]
    assert sorted(made) == [(5, 64), (17, 64), (63, 64)]
    for image, box, luma in zip(images, boxes, lumas):
        np.testing.assert_allclose(luma, pixels.grey(pixels.crop_and_resize(pixels.three_channels(image), box, settings.crop)), atol=1e-12)
    many = pixels.hogs(np.stack(lumas), settings)
    np.testing.assert_array_equal(many, [pixels.hog(luma, settings) for luma in lumas])
