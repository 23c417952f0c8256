import json

import pytest

from labelloom.operators.coverage import duplicate_ids, missing_files
from labelloom.operators.matrices import repaired_labels
from labelloom.sources import images, tables
from labelloom.sources.json_documents import split_records


def touch(root, *paths):
    for path in paths:
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")


@pytest.fixture
def subject_tree(tmp_path):
    folders = ["subject_01/01_palm", "subject_01/03_fist", "subject_02/05_thumb", "subject_02/07_ok", "subject_02/10_down"]
    touch(tmp_path, *[f"{f}/img_{i}.jpg" for f in folders for i in (1, 2)], "notes.txt", "top.jpg")
    return tmp_path


def test_subject_tree_and_labels(spark, subject_tree):
    rows = images.scan_subject_tree(spark, str(subject_tree))
    assert rows.count() == 10
    assert duplicate_ids(rows).count() == 0
    fixed = repaired_labels(rows).collect()
    labels = {r["gesture_label"] for r in fixed}
    assert labels == {"stop", "fist", "like", "ok", "palm"}
    assert {r["subject_id"] for r in fixed} == {"subject_01", "subject_02"}
    assert all(r["capture_context"]["relative_path"] in r["image_path"] for r in fixed)


def test_nested_layout_names_subject_and_label(spark, tmp_path):
    touch(tmp_path, "nested/00/01_palm/frame_00_01_0001.jpg", "05_thumb/a.PNG")
    rows = {r["raw_gesture_label"]: r for r in images.scan_subject_tree(spark, str(tmp_path)).collect()}
    assert rows["01_palm"]["subject_id"] == "00"
    assert rows["05_thumb"]["subject_id"] is None


def test_label_folders_are_not_filtered_by_vocabulary(spark, tmp_path):
    touch(tmp_path, *[f"{x}/1.jpg" for x in ("palm", "fist", "like", "peace", "mute")])
    config = {"dataset_name": "hagrid_subset", "root_path": str(tmp_path), "label_vocabulary": ["palm", "fist"]}
    rows = images.index_dataset(spark, config)
    assert rows.count() == 5
    assert {r["capture_context"]["format"] for r in rows.collect()} == {"folder_by_label"}
    config["label_filter"] = ["palm", "fist"]
    assert images.index_dataset(spark, config).count() == 2


def test_class_cap_takes_first_paths(spark, tmp_path):
    touch(tmp_path, *[f"{x}/{i}.jpg" for x in "ab" for i in range(5)])
    rows = images.scan_label_folders(spark, str(tmp_path), max_per_class=2)
    assert sorted(r["image_path"].rsplit("/", 1)[1] for r in rows.collect()) == ["0.jpg", "0.jpg", "1.jpg", "1.jpg"]


@pytest.mark.parametrize("as_object", [False, True])
def test_annotations(spark, tmp_path, as_object):
    names = ["a.jpg", "b.jpg", "c.jpg", "d.jpg"]
    touch(tmp_path, "a.jpg", "b.jpg", "images/c.jpg", "data/d.jpg")
    records = [{"file_name": n, "label": "palm", "user_id": f"u{i}", "bg": ""} for i, n in enumerate(names)]
    records.append({"file_name": "lost.jpg", "label": "fist"})
    records.append({"path": "b.jpg", "gesture": "Two Words", "scene": "indoor", "split": "val"})
    payload = {str(i): r for i, r in enumerate(records)} if as_object else records
    (tmp_path / "annotations.json").write_text(json.dumps(payload))
    rows = images.scan_annotated(spark, str(tmp_path)).collect()
    assert len(rows) == 5
    assert {r["capture_context"]["format"] for r in rows} == {"annotations"}
    assert {r["capture_context"]["annotation_file"] for r in rows} == {"annotations.json"}
    last = next(r for r in rows if r["raw_gesture_label"] == "Two Words")
    assert (last["split"], last["capture_context"]["background"], last["subject_id"]) == ("val", "indoor", "")
    only = images.scan_annotated(spark, str(tmp_path), target_labels=["two-words"])
    assert only.count() == 1


AWKWARD = [
    {"file_name": "a}{.jpg", "label": 'say "hi\\\\" } ]', "nested": {"deep": [{"x": "}"}, {}]}, "n": None},
    {"file_name": "\u00e9\u4e16 }, {", "label": "", "boxes": [[1, 2], [3]]},
    {},
    {"file_name": "end\\\\", "label": "}" * 300, "line": "one\ntwo"},
]


@pytest.mark.parametrize("block", [1500, 1 << 27])
def test_documents_are_read_in_ranges(spark, tmp_path, block):
    many = [{**AWKWARD[i % 4], "id": i} for i in range(60)]
    documents = {
        "list.json": many,
        "pretty.json": many,
        "members.json": {f'k"{i}': r for i, r in enumerate(many)},
        "one.json": {"label": "a", "more": {"b": 1}, "list": [{"c": "}"}, 2]},
        "mixed.json": {"first": {"b": 1}, "label": "z"},
        "scalars.json": [1, "x{", {"label": "only"}, None, [2, 3]],
        "none.json": [],
        "nothing.json": {},
    }
    for name, value in documents.items():
        text = json.dumps(value, indent=2 if name == "pretty.json" else None) + ("\n" if name in ("one.json", "list.json") else "")
        (tmp_path / name).write_text(text)
    (tmp_path / "blank.json").write_text(" \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        paths = [str(tmp_path / n) for n in [*documents, "blank.json"]]
        rows = split_records(spark, paths).collect()
        parsed = {(r["annotation_file"].rsplit("/", 1)[1], r["position"]): r["record"] for r in images.read_annotations(spark, paths).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["json"]))
    assert got == {
        "list.json": many, "pretty.json": many, "members.json": many, "one.json": [documents["one.json"]],
        "mixed.json": [documents["mixed.json"]], "scalars.json": [{"label": "only"}],
    }
    assert [r["position"] for r in sorted(rows, key=lambda r: r["position"]) if r["file"].endswith("/list.json")] == list(range(60))
    assert parsed["list.json", 4]["label"] == AWKWARD[0]["label"] and json.loads(parsed["list.json", 4]["nested"]) == AWKWARD[0]["nested"]
    assert parsed["members.json", 3]["id"] == "3" and parsed["scalars.json", 0] == {"label": "only"}


def test_nested_annotation_file_is_found(spark, tmp_path):
    touch(tmp_path, "deep/a.jpg")
    (tmp_path / "deep" / "annotations_val.json").write_text(json.dumps([{"img": "deep/a.jpg", "class": "ok"}]))
    rows = images.scan_annotated(spark, str(tmp_path)).collect()
    assert [r["raw_gesture_label"] for r in rows] == ["ok"]


def test_unknown_dataset_is_an_error(spark):
    with pytest.raises(ValueError):
        images.index_dataset(spark, {"dataset_name": "other", "root_path": "/tmp"})
    with pytest.raises(ValueError):
        images.index_dataset(spark, {"dataset_name": "hagrid_subset"})


def test_shuffle_is_seeded(spark, tmp_path):
    touch(tmp_path, *[f"a/{i}.jpg" for i in range(20)])
    config = {"dataset_name": "hagrid_subset", "root_path": str(tmp_path), "sampling": {"shuffle": True}}
    first = [r["sample_id"] for r in images.index_dataset(spark, config).collect()]
    again = [r["sample_id"] for r in images.index_dataset(spark, config).collect()]
    assert first == again != sorted(first)


def test_missing_files(spark, subject_tree):
    rows = images.scan_subject_tree(spark, str(subject_tree)).persist()
    assert rows.count() == 10
    (subject_tree / "subject_01/01_palm/img_1.jpg").unlink()
    lost = missing_files(rows, images.list_images(spark, str(subject_tree))).collect()
    assert [r["image_path"] for r in lost] == [str(subject_tree / "subject_01/01_palm/img_1.jpg")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_manifest_round_trip(spark, subject_tree, tmp_path_factory, fmt):
    path = str(tmp_path_factory.mktemp("out") / f"manifest.{fmt}")
    rows = images.scan_subject_tree(spark, str(subject_tree))
    tables.write_manifest(rows, path)
    assert tables.count_rows(spark, path) == 10
    key = lambda r: r["sample_id"]
    assert sorted(tables.read_manifest(spark, path).collect(), key=key) == sorted(rows.collect(), key=key)


def test_manifest_format_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_manifest(spark.range(1), str(tmp_path / "manifest.txt"))


def test_json_splits_and_folds(spark, tmp_path):
    (tmp_path / "splits.json").write_text(json.dumps({"train": ["a", "b"], "val": ["c"], "test": []}))
    (tmp_path / "folds.json").write_text(json.dumps({"folds": [{"fold": 0, "train": ["b"], "val": ["a"]}]}))
    rows = tables.read_splits(spark, str(tmp_path / "splits.json")).collect()
    assert sorted(map(tuple, rows)) == [("a", "train"), ("b", "train"), ("c", "val")]
    assert list(map(tuple, tables.read_folds(spark, str(tmp_path / "folds.json")).collect())) == [("a", 0)]


def test_run_records_are_found_recursively(spark, tmp_path):
    run = tables.new_run(spark, "EXP-03", {"a": 1, "_meta": {"x": 2}}, status="completed", metrics={"accuracy": 0.5})
    tables.append_runs(run, str(tmp_path / "metrics/exp03"))
    tables.append_runs(tables.new_run(spark, "EXP-03", {}, status="running"), str(tmp_path / "metrics/exp03"))
    (tmp_path / "metrics/exp03/other.json").write_text(json.dumps({"hello": 1}))
    rows = tables.read_runs(spark, str(tmp_path / "metrics")).collect()
    assert [(r["experiment_id"], r["metrics"]["accuracy"]) for r in rows] == [("EXP-03", 0.5)]
    assert rows[0]["config_fingerprint"] == tables.config_fingerprint({"a": 1})
    (tmp_path / "metrics/empty").mkdir()
    assert tables.read_runs(spark, str(tmp_path / "metrics/empty"), recursive=False).count() == 0


def test_confusion_csv_labels_must_agree(spark, tmp_path):
    bad = spark.createDataFrame([("a", 1, 2), ("c", 0, 1)], "true_label string, a int, b int")
    tables.write_confusion_csv(bad, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        tables.read_confusion_csv(spark, str(tmp_path / "m"))


def test_replace_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    tables.replace_table(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]
