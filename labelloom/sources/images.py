"""Scans of image trees and annotation files into manifest rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import vocab
from labelloom.functions.labels import sample_id
from labelloom.operators.splits import cap_per_class, filter_labels, seeded_order
from labelloom.sources.json_documents import split_records


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the image files below *root*: (path, relative_path).

    Only the path column is selected, so no file content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return (
        files.select(_local(F.col("path")).alias("path"))
        .filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*vocab.IMAGE_SUFFIXES))
        .withColumn("relative_path", _relative(F.col("path"), root))
    )


def _local(path: Column) -> Column:
    """Path without the `file:` scheme; other schemes stay."""
    return F.regexp_replace(path, r"^file:/+", "/")


def _relative(path: Column, root: str) -> Column:
    prefix = root.rstrip("/").removeprefix("file://") + "/"
    return F.substring(path, F.lit(len(prefix) + 1), F.length(path))


def _context(base: Mapping[str, Any] | None, **extra: Column) -> Column:
    fixed = {k: v for k, v in (base or {}).items() if v is not None and k not in extra}
    entries = [x for k, v in fixed.items() for x in (F.lit(str(k)), F.lit(str(v)))]
    entries += [x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*entries)


def _manifest(df: DataFrame, dataset: str, subject: Column, label: Column, context: Column, split: Column | None = None) -> DataFrame:
    return df.select(
        sample_id(F.lit(dataset), F.col("relative_path")).alias("sample_id"),
        F.lit(dataset).alias("dataset_name"),
        subject.cast("string").alias("subject_id"),
        label.alias("raw_gesture_label"),
        label.alias("gesture_label"),
        F.col("path").alias("image_path"),
        (F.lit(None) if split is None else split).cast("string").alias("split"),
        context.alias("capture_context"),
    )


def scan_label_folders(
    spark: SparkSession,
    root: str,
    dataset: str = vocab.ANNOTATED_DATASET,
    *,
    target_labels: Sequence[str] | None = None,
    max_per_class: int | None = None,
    capture_context: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Manifest of a tree whose top folders are labels."""
    return label_folder_manifest(
        list_images(spark, root),
        dataset,
        target_labels=target_labels,
        max_per_class=max_per_class,
        capture_context=capture_context,
    )


def label_folder_manifest(
    files: DataFrame,
    dataset: str = vocab.ANNOTATED_DATASET,
    *,
    target_labels: Sequence[str] | None = None,
    max_per_class: int | None = None,
    capture_context: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Manifest from a file listing (path, relative_path): the top folder is the label."""
    files = files.filter(F.contains("relative_path", F.lit("/")))
    label = F.element_at(F.split("relative_path", "/"), 1)
    context = _context(
        capture_context or {"source": "in_the_wild"},
        relative_path=F.col("relative_path"),
        format=F.lit("folder_by_label"),
    )
    rows = _manifest(files, dataset, F.lit(None), label, context)
    return cap_per_class(filter_labels(rows, list(target_labels or [])), max_per_class)


def scan_subject_tree(
    spark: SparkSession,
    root: str,
    dataset: str = vocab.TREE_DATASET,
    *,
    capture_context: Mapping[str, Any] | None = None,
    label_map: Mapping[str, str] | None = None,
) -> DataFrame:
    """Manifest of a tree with subject and label folders in either order."""
    return subject_tree_manifest(
        list_images(spark, root), dataset, capture_context=capture_context, label_map=label_map
    )


def subject_tree_manifest(
    files: DataFrame,
    dataset: str = vocab.TREE_DATASET,
    *,
    capture_context: Mapping[str, Any] | None = None,
    label_map: Mapping[str, str] | None = None,
) -> DataFrame:
    """Manifest from a file listing with subject and label folders.

    A folder beginning with `subject` or `s_` names the subject and the last
    other folder the label; else the last folder is the label and the one above
    it the subject. Files without a folder are left out.
    """
    files = files.withColumn("_parts", F.split("relative_path", "/"))
    folders = F.slice("_parts", 1, F.size("_parts") - 1)
    files = files.filter(F.size("_parts") >= 2).withColumn("_dirs", folders)
    named = F.filter("_dirs", lambda p: F.lower(p).rlike("^(subject|s_)"))
    first = F.array_position("_dirs", F.get(named, F.lit(0)))
    others = F.filter("_dirs", lambda p, i: i != first - 1)
    single = F.size("_dirs") == 1
    has_subject = ~single & (F.size(named) > 0)
    parent = F.try_element_at("_dirs", F.lit(-2))
    subject = F.when(has_subject, F.get(named, F.lit(0))).when(~single, parent)
    label = F.when(has_subject, F.try_element_at(others, F.lit(-1))).otherwise(F.element_at("_dirs", -1))
    extra = {"relative_path": F.col("relative_path")}
    if label_map:
        pairs = [F.lit(x) for pair in sorted(label_map.items()) for x in map(str, pair)]
        extra["label_map"] = F.to_json(F.create_map(*pairs))
    context = _context(capture_context or {"source": "static_images"}, **extra)
    return _manifest(files, dataset, subject, label, context)


_RECORD = T.MapType(T.StringType(), T.StringType())


def read_annotations(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records of annotation files as string maps: (record, annotation_file, position).

    Each file is a JSON list of objects, an object of objects, or one object; files of
    any size are read in byte ranges, see `split_records`. Records that can't be parsed
    are left out.
    """
    return split_records(spark, paths).select(
        _local(F.col("file")).alias("annotation_file"), "position", F.from_json("json", _RECORD).alias("record")
    ).filter("record is not null")


def _first_key(record: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_element_at(record, F.lit(k)) for k in keys])


def scan_annotations(
    spark: SparkSession,
    root: str,
    dataset: str = vocab.ANNOTATED_DATASET,
    *,
    annotation_file: str | None = None,
    target_labels: Sequence[str] | None = None,
    max_per_class: int | None = None,
    capture_context: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Manifest from an annotation file below *root*."""
    file = annotation_file or find_annotation_file(spark, root)
    if file is None:
        raise FileNotFoundError(f"no annotation file under {root}")
    return annotation_manifest(
        read_annotations(spark, [file]),
        list_images(spark, root),
        root,
        dataset,
        target_labels=target_labels,
        max_per_class=max_per_class,
        capture_context=capture_context,
    )


def annotation_manifest(
    records: DataFrame,
    files: DataFrame,
    root: str,
    dataset: str = vocab.ANNOTATED_DATASET,
    *,
    target_labels: Sequence[str] | None = None,
    max_per_class: int | None = None,
    capture_context: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Manifest from annotation records and a file listing.

    Records without an existing image are dropped. An image is looked for at the recorded path, below *root*, and below the usual
    image folders, in this order, for each path key the record has.
    """
    root = root.rstrip("/")
    roots = ["", f"{root}/", *[f"{root}/{sub}/" for sub in vocab.ANNOTATION_IMAGE_FOLDERS]]

    def places(key: str) -> list[Column]:
        raw = F.try_element_at("record", F.lit(key))
        return [F.concat(F.lit(prefix), raw) for prefix in roots]

    candidates = F.filter(
        F.array(*[c for key in vocab.ANNOTATION_PATH_KEYS for c in places(key)]), lambda c: c.isNotNull()
    )
    # Every candidate path of a record looks for its file; the first existing one wins.
    tried = records.select("record", "annotation_file", "position", F.posexplode(candidates).alias("rank", "path"))
    rows = (
        tried.join(files, "path")
        .groupBy("annotation_file", "position")
        .agg(F.min_by(F.struct("record", "path", "relative_path"), "rank").alias("found"))
        .select("annotation_file", "position", "found.*")
    )
    record = F.col("record")
    label = F.coalesce(_first_key(record, vocab.ANNOTATION_LABEL_KEYS), F.lit("unknown"))
    filled = lambda *keys: F.coalesce(
        *[F.nullif(F.try_element_at(record, F.lit(k)), F.lit("")) for k in keys]
    )
    context = _context(
        capture_context or {"source": "in_the_wild"},
        relative_path=F.col("relative_path"),
        annotation_file=_relative(F.col("annotation_file"), root),
        background=filled("background", "bg", "scene"),
        format=F.lit("annotations"),
    )
    subject = F.coalesce(filled("user_id", "subject_id"), F.lit(""))
    split = F.try_element_at(record, F.lit("split"))
    manifest = _manifest(rows, dataset, subject, label, context, split)
    return cap_per_class(
        filter_labels(manifest, list(target_labels or []), fold_case=True), max_per_class
    )


def find_annotation_file(spark: SparkSession, root: str) -> str | None:
    """Annotation file directly below *root*, else the first one deeper down."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(root)
        .select(_local(F.col("path")).alias("path"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*[F.lit(n) for n in vocab.ANNOTATION_FILES]), name)
    deep = F.col("path") != F.concat(F.lit(root.rstrip("/").removeprefix("file://") + "/"), name)
    row = files.withColumn("rank", rank).filter("rank > 0").orderBy(deep, "rank", "path").limit(1).first()
    return row["path"] if row else None


def scan_annotated(spark: SparkSession, root: str, dataset: str = vocab.ANNOTATED_DATASET, layout: str | None = None, **options: Any) -> DataFrame:
    """Annotation scan when there is an annotation file, else label folders."""
    if layout != "folder_by_label":
        file = find_annotation_file(spark, root)
        if file is not None or layout == "annotations":
            return scan_annotations(spark, root, dataset, annotation_file=file, **options)
    return scan_label_folders(spark, root, dataset, **options)


# --- registry ----------------------------------------------------------------

Scanner = Callable[[SparkSession, Mapping[str, Any]], DataFrame]


def _tree_from_config(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    return scan_subject_tree(
        spark,
        config["root_path"],
        config["dataset_name"],
        capture_context=config.get("capture_context"),
        label_map=config.get("label_aliases"),
    )


def _annotated_from_config(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    sampling = config.get("sampling") or {}
    return scan_annotated(
        spark,
        config["root_path"],
        config["dataset_name"],
        config.get("layout"),
        target_labels=config.get("label_filter"),
        max_per_class=sampling.get("max_samples_per_class"),
        capture_context=config.get("capture_context"),
    )


SCANNERS: dict[str, Scanner] = {
    vocab.TREE_DATASET: _tree_from_config,
    vocab.ANNOTATED_DATASET: _annotated_from_config,
}


def register_scanner(dataset_name: str, scanner: Scanner) -> None:
    """Make a further dataset known to `index_dataset`."""
    SCANNERS[dataset_name.strip().lower()] = scanner


def index_dataset(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """Manifest of the dataset a configuration describes."""
    name = config["dataset_name"].strip().lower()
    if name not in SCANNERS:
        raise ValueError(f"unsupported dataset '{name}', known: {sorted(SCANNERS)}")
    if not config.get("root_path"):
        raise ValueError("dataset configuration lacks 'root_path'")
    manifest = SCANNERS[name](spark, config)
    if (config.get("sampling") or {}).get("shuffle"):
        manifest = seeded_order(manifest, int((config.get("split_strategy") or {}).get("seed", 42)))
    return manifest
