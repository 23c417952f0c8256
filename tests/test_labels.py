import pytest
from pyspark.sql import functions as F

from labelloom.functions import labels, names
from labelloom.operators.matrices import repaired_labels


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    row = tuple(values.values()) or ("x",)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, label",
    [("01_palm", "stop"), ("10_down", "palm"), ("05_thumb", "like"), ("04_fist_moved", "fist"), ("02_l", "thumb_index"),
     (" Thumb-Up ", "like"), ("Some New-One", "some_new_one")],
)
def test_tree_aliases(spark, raw, label):
    assert one(spark, labels.normalize_label(F.col("l"), "leapgestrecog"), l=raw) == label


def test_annotated_labels_stay(spark):
    assert one(spark, labels.normalize_label(F.col("l"), "hagrid_subset"), l="like") == "like"
    aligned = labels.normalize_label(F.col("l"), "hagrid_subset", align_to_canonical=True)
    assert one(spark, aligned, l="thumb") == "like"


def test_precedence(spark):
    column = labels.normalize_label(
        F.col("l"), "x", label_aliases={"Big Cat": "lion"}, canonical_labels=["big cat", "Wild Dog"]
    )
    assert one(spark, column, l="big cat") == "big cat"
    assert one(spark, column, l="BIG-CAT") == "lion"
    assert one(spark, column, l="wild_dog") == "Wild Dog"


@pytest.mark.parametrize("raw", ["", "  ", None])
def test_empty_label_is_an_error(spark, raw):
    with pytest.raises(Exception, match="empty raw label"):
        one(spark, labels.normalize_label(F.col("l"), "x"), l=raw)


def test_repair_from_path(spark):
    row = ("leapgestrecog", "00", "/data/tree/00/01_palm/frame_00_01_0001.jpg")
    df = spark.createDataFrame([row], "dataset_name string, gesture_label string, image_path string")
    fixed = repaired_labels(df).first()
    assert (fixed["raw_gesture_label"], fixed["gesture_label"]) == ("01_palm", "stop")


def test_repair_prefers_relative_path(spark):
    df = spark.createDataFrame(
        [("leapgestrecog", "99", "/x/03_fist/a.jpg", {"relative_path": "s\\07_ok\\a.jpg"})],
        "dataset_name string, gesture_label string, image_path string, capture_context map<string,string>",
    )
    assert repaired_labels(df).first()["gesture_label"] == "ok"


def test_context(spark):
    parse = lambda text: one(spark, labels.parse_context(F.col("t")), t=text)
    assert parse('{"source": "a", "n": 1}') == {"source": "a", "n": "1"}
    assert parse("not json") == {"raw": "not json"}
    assert parse(" ") == {} and parse(None) == {}


def test_metric_names():
    config = {"report": ["acc", "f1_macro", "recall_macro", "inference_seconds", "confusion_matrix", "accuracy"]}
    assert names.report_metrics(config) == ["accuracy", "f1_macro", "recall_macro", "inference_seconds"]
    assert names.primary_metric({"primary": "acc"}) == "accuracy"
    assert names.primary_metric({"secondary": ["f1", "labels"]}) == "f1_macro"
    assert len(names.report_metrics(None)) == 10
    assert names.stored_family("hybrid") == "hybrid_keypoints_hog"
    assert names.algorithm_name("svm_rbf") == "svm"
