"""Operators on feature matrices: validity, hybrid join, label sync, records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import vocab
from labelloom.functions.labels import normalize_labels_by_dataset, repaired_raw_label
from labelloom.functions.names import stored_family
from labelloom.functions.quality import EMPTY_FLAGS, flag_when, is_filtered_family, is_valid_row, merge_flags
from labelloom.functions.vectors import concat_blocks, vector, zeros

RECORD_COLUMNS = (
    "sample_id",
    "dataset_name",
    "gesture_label",
    "feature_family",
    "feature_version",
    "vector_path",
    "vector_inline",
    "quality_flags",
    "extraction_ok",
    "confidence",
    "source_families",
)


def valid(df: DataFrame) -> Column:
    """Validity of a matrix row."""
    return is_valid_row(
        F.col("extraction_ok"), F.col("quality_flags"), F.col("feature_family"), F.col("vector_inline")
    )


def exclude_invalid(matrix: DataFrame) -> DataFrame:
    """Rows of geometric and hybrid families only when they are valid; others as they are."""
    return matrix.filter(~is_filtered_family(F.col("feature_family")) | valid(matrix))


def validity_counts(matrix: DataFrame) -> DataFrame:
    """Kept and dropped rows per family."""
    return matrix.groupBy("feature_family").agg(
        F.count_if(valid(matrix)).alias("kept"), F.count_if(~valid(matrix)).alias("dropped")
    )


def rows_of_family(matrix: DataFrame, family: str, strict: bool = False) -> DataFrame:
    """Rows of one family (alias or stored name).

    When no row of the table matches, all rows are kept unless *strict*.
    """
    match = F.coalesce(F.col("feature_family").isin(stored_family(family), family), F.lit(False))
    if not strict and matrix.filter(match).select(F.lit(1)).isEmpty():
        return matrix
    return matrix.filter(match)


def feature_records(
    df: DataFrame,
    family: str,
    *,
    version: str = "v1",
    detection_failed: Column | None = None,
    low_confidence: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows in the matrix layout, missing columns filled with defaults, behind the columns *keep*.

    Failure and confidence conditions are folded into the quality flags.
    """
    have = set(df.columns)
    pick = lambda name, default: F.col(name) if name in have else default
    flags = F.coalesce(pick("quality_flags", F.expr(EMPTY_FLAGS)), F.expr(EMPTY_FLAGS))
    if detection_failed is not None:
        flags = merge_flags(flags, flag_when("detection_failed", detection_failed))
    if low_confidence is not None:
        flags = merge_flags(flags, flag_when("low_confidence", low_confidence))
    none = lambda kind: F.lit(None).cast(kind)
    values = {
        "sample_id": F.col("sample_id").cast("string"),
        "dataset_name": pick("dataset_name", none("string")),
        "gesture_label": pick("gesture_label", none("string")),
        "feature_family": F.lit(family),
        "feature_version": F.lit(version),
        "vector_path": pick("vector_path", none("string")),
        "vector_inline": F.col("vector_inline").cast("array<double>"),
        "quality_flags": flags,
        "extraction_ok": F.coalesce(pick("extraction_ok", F.lit(True)), F.lit(True)),
        "confidence": pick("confidence", none("double")).cast("double"),
        "source_families": pick("source_families", none("array<string>")),
    }
    return df.select(*keep, *[values[c].alias(c) for c in RECORD_COLUMNS])


def extracted(
    df: DataFrame,
    family: str,
    computed: Column,
    dim: int,
    *,
    detected: Column,
    readable: Column | None = None,
    min_confidence: float = 0.5,
    version: str = "v1",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Extraction result of each sample with failure flags.

    *computed* is the vector where it could be computed. An unreadable image is
    flagged `missing_image`; without a detection a geometric row fails with
    `detection_failed` and a zero vector, an appearance row falls back to the
    centred crop (`landmark_crop_fallback`).
    """
    readable = F.lit(True) if readable is None else readable
    appearance = family == "hog"
    ok = readable & (F.lit(True) if appearance else detected)
    failed = readable & ~detected
    confidence = F.when(readable & detected, F.col("confidence"))
    flags = merge_flags(
        flag_when("missing_image", ~readable),
        flag_when("landmark_crop_fallback" if appearance else "detection_failed", failed),
    )
    rows = (
        df.withColumn("extraction_ok", ok)
        .withColumn("vector_inline", F.when(ok, computed).otherwise(zeros(dim)))
        .withColumn("confidence", confidence)
        .withColumn("quality_flags", flags)
    )
    return feature_records(rows, family, version=version, low_confidence=F.col("confidence") < min_confidence, keep=keep)


# --- hybrid join -------------------------------------------------------------


def hybrid_guards(keypoints: DataFrame, hog: DataFrame) -> DataFrame:
    """One row: duplicate ids per side, ids missing in the second, label mismatches.

    Reads ids and labels only and groups both sides in one shuffle, with counts
    combined before it, so that copies of an id do no harm.
    """
    tag = lambda df, side: df.select(
        "sample_id", "gesture_label", F.lit(side).alias("side")
    )
    of = lambda side, value: F.when(F.col("side") == side, value)
    per_id = (
        tag(keypoints, "k")
        .unionByName(tag(hog, "h"))
        .groupBy("sample_id")
        .agg(
            F.count(of("k", F.lit(1))).alias("k"),
            F.count(of("h", F.lit(1))).alias("h"),
            F.max(of("k", F.col("gesture_label"))).alias("k_label"),
            F.max(of("h", F.col("gesture_label"))).alias("h_label"),
        )
    )
    both = (F.col("k") > 0) & (F.col("h") > 0)
    return per_id.agg(
        F.count_if(F.col("k") > 1).alias("duplicate_keypoint_ids"),
        F.count_if(F.col("h") > 1).alias("duplicate_hog_ids"),
        F.count_if((F.col("k") > 0) & (F.col("h") == 0)).alias("missing_in_hog"),
        F.count_if(both & ~F.col("k_label").eqNullSafe(F.col("h_label"))).alias("label_mismatches"),
        F.count_if((F.col("k") == 0) & (F.col("h") > 0)).alias("skipped_without_keypoints"),
    )


def hybrid_join(keypoints: DataFrame, hog: DataFrame, version: str = "v1", validate: bool = True) -> DataFrame:
    """Hybrid matrix: keypoint and appearance vectors of each sample concatenated.

    Invalid keypoint rows take no part. Flags are merged (appearance wins), the
    confidence is the smaller one with null as 1, extraction must have worked on
    both sides. With *validate*, duplicate ids, missing rows and differing labels
    are errors before anything is joined.
    """
    left = exclude_invalid(keypoints)
    if validate:
        counts = hybrid_guards(left, hog).first().asDict()
        counts.pop("skipped_without_keypoints")
        broken = {name: n for name, n in counts.items() if n}
        if broken:
            raise ValueError(f"feature tables cannot be combined: {broken}")
    side = lambda df, p: df.select(
        "sample_id",
        *[
            F.col(c).alias(f"{p}_{c}")
            for c in (
                "dataset_name", "gesture_label", "feature_family", "vector_inline",
                "quality_flags", "extraction_ok", "confidence",
            )
        ],
    )
    joined = side(left, "k").join(side(hog, "h"), "sample_id")
    blocks = {"k": vector(F.col("k_vector_inline")), "h": vector(F.col("h_vector_inline"))}
    one = F.lit(1.0)
    rows = joined.select(
        "sample_id",
        F.col("k_dataset_name").alias("dataset_name"),
        F.col("k_gesture_label").alias("gesture_label"),
        concat_blocks(blocks, ("k", "h")).alias("vector_inline"),
        merge_flags(F.col("k_quality_flags"), F.col("h_quality_flags")).alias("quality_flags"),
        (F.col("k_extraction_ok") & F.col("h_extraction_ok")).alias("extraction_ok"),
        F.least(F.coalesce("k_confidence", one), F.coalesce("h_confidence", one)).alias("confidence"),
        F.array("k_feature_family", "h_feature_family").alias("source_families"),
    )
    return feature_records(rows, vocab.HYBRID_FAMILY, version=version)


# --- labels ------------------------------------------------------------------


def repaired_labels(
    df: DataFrame,
    *,
    label_aliases: Mapping[str, str] | None = None,
    canonical_labels: Sequence[str] | None = None,
    align_to_canonical: bool = False,
) -> DataFrame:
    """Rows with raw label recovered from their paths and label normalised."""
    have = set(df.columns)
    text = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    relative = (
        F.try_element_at("capture_context", F.lit("relative_path"))
        if "capture_context" in have
        else F.lit(None).cast("string")
    )
    raw = F.coalesce(F.nullif(text("raw_gesture_label"), F.lit("")), F.col("gesture_label"))
    dataset = text("dataset_name")
    repaired = repaired_raw_label(F.coalesce(dataset, F.lit("")), raw, relative, text("image_path"))
    return df.withColumn("raw_gesture_label", repaired).withColumn(
        "gesture_label",
        normalize_labels_by_dataset(
            F.col("raw_gesture_label"),
            dataset,
            label_aliases=label_aliases,
            canonical_labels=canonical_labels,
            align_to_canonical=align_to_canonical,
        ),
    )


def sync_labels(matrix: DataFrame, manifest: DataFrame) -> DataFrame:
    """Matrix with the labels of the manifest, plus `updated` for rows it knows.

    The manifest side is grouped to one row per id first.
    """
    source = repaired_labels(manifest.filter("sample_id is not null and sample_id <> ''"))
    fresh = source.groupBy("sample_id").agg(
        F.max(F.struct("gesture_label", "raw_gesture_label")).alias("_new")
    )
    joined = matrix.join(fresh, "sample_id", "left").withColumn("updated", F.col("_new").isNotNull())
    for name in ("gesture_label", "raw_gesture_label"):
        if name in matrix.columns:
            joined = joined.withColumn(name, F.coalesce(F.col(f"_new.{name}"), F.col(name)))
    return joined.select(*matrix.columns, "updated")


def sidecar(matrix: DataFrame, fingerprint: str = "") -> DataFrame:
    """Row count, vector length and source families of each (dataset, family, version).

    vector_dim is the longest vector; more than one of vector_dims tells of a mixed matrix.
    """
    size = F.col("vector_inline")
    families = F.col("source_families") if "source_families" in matrix.columns else F.lit(None).cast("array<string>")
    return (
        matrix.groupBy("dataset_name", "feature_family", "feature_version")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.coalesce(F.max(F.when(F.size(size) > 0, F.size(size))), F.lit(0)).alias("vector_dim"),
            F.count_distinct(F.when(F.size(size) > 0, F.size(size))).alias("vector_dims"),
            F.max(families).alias("source_families"),
        )
        .withColumn("config_fingerprint", F.lit(fingerprint))
    )
