import pytest
from pyspark.sql import functions as F

from labelloom import schemas
from labelloom.operators import coverage, matrices
from labelloom.plans import jobs
from labelloom.sources import tables, versions


def records(spark, *rows):
    """Rows (id, label, family, vector, flags, ok, confidence)."""
    full = [(i, "d", label, family, "v1", None, v, flags, ok, c, None) for i, label, family, v, flags, ok, c in rows]
    return spark.createDataFrame(full, schemas.FEATURE_MATRIX)


def test_invalid_rows_are_dropped(spark):
    m = records(
        spark,
        ("a", "Palm", "geometric", [0.0, 0.0], {"detection_failed": True}, False, None),
        ("b", "Palm", "geometric", [0.1, 0.0], {}, True, 0.9),
        ("c", "Palm", "geometric", [0.0, 0.0], {}, True, 0.9),
        ("d", "Palm", "hog", [0.0, 0.0], {}, True, None),
        ("e", "Palm", "hybrid_keypoints_hog", [1.0], {}, False, None),
        ("f", "Palm", "geometric", None, None, True, None),
    )
    assert sorted(r["sample_id"] for r in matrices.exclude_invalid(m).collect()) == ["b", "d"]
    counts = {r["feature_family"]: (r["kept"], r["dropped"]) for r in matrices.validity_counts(m).collect()}
    assert counts == {"geometric": (1, 3), "hog": (1, 0), "hybrid_keypoints_hog": (0, 1)}


def test_hybrid_join(spark):
    geo = records(spark, *[(f"s_{x}", "Palm", "geometric", [1.0, float(i)], {"low_confidence": True}, True, 0.9 - i / 10) for i, x in enumerate("abc")])
    hog = records(spark, *[(f"s_{x}", "Palm", "hog", [5.0, 6.0, 7.0], {"low_confidence": False, "crop": True}, True, None) for x in "abcd"])
    rows = matrices.hybrid_join(geo, hog).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in rows] == ["s_a", "s_b", "s_c"]
    assert rows[1]["vector_inline"] == [1.0, 1.0, 5.0, 6.0, 7.0]
    assert rows[1]["quality_flags"] == {"low_confidence": False, "crop": True}
    assert rows[2]["confidence"] == pytest.approx(0.7) and rows[2]["source_families"] == ["geometric", "hog"]
    assert {r["feature_family"] for r in rows} == {"hybrid_keypoints_hog"}


@pytest.mark.parametrize("case", ["missing", "label", "duplicate"])
def test_hybrid_guards_raise(spark, case):
    geo = records(spark, ("a", "x", "geometric", [1.0], {}, True, None))
    hog = {
        "missing": [("b", "x", "hog", [1.0], {}, True, None)],
        "label": [("a", "y", "hog", [1.0], {}, True, None)],
        "duplicate": [("a", "x", "hog", [1.0], {}, True, None)] * 2,
    }[case]
    with pytest.raises(ValueError, match=case):
        matrices.hybrid_join(geo, records(spark, *hog))


def test_coverage_and_thresholds(spark):
    m = records(
        spark,
        ("a", "Palm", "geometric", [1.0], {}, True, 0.9),
        ("b", "Fist", "geometric", [], {"detection_failed": True, "low_confidence": True}, False, 0.2),
        ("c", "Palm", "geometric", [1.0], {"other": False}, True, 0.8),
    )
    partial = coverage.partial_coverage(m)
    total = coverage.overall_coverage(partial).first()
    assert (total["total_samples"], total["failed_extractions"], total["missing_vectors"]) == (3, 1, 1)
    by_label = {r["gesture_label"]: (r["successful_extractions"], r["success_rate"]) for r in coverage.coverage_by_label(partial).collect()}
    assert by_label == {"Palm": (2, 1.0), "Fist": (0, 0.0)}
    broken = {(r["rule"], r["gesture_label"]) for r in coverage.coverage_violations(partial, 2, 0.75).collect()}
    assert broken == {("min_samples", "Fist"), ("success_rate", "Fist")}
    assert [r["sample_id"] for r in coverage.low_confidence_ids(m, 0.5).collect()] == ["b"]
    assert {r["flag"]: r["n"] for r in coverage.flag_counts(m).collect()} == {"detection_failed": 1, "low_confidence": 1}


def test_low_confidence_falls_back_to_flag(spark):
    m = records(spark, ("a", "x", "geometric", [1.0], {"low_confidence": True}, True, None), ("b", "x", "geometric", [1.0], None, True, None))
    assert [r["sample_id"] for r in coverage.low_confidence_ids(m, 0.5).collect()] == ["a"]


def test_coverage_merge(spark):
    parts = [
        coverage.partial_coverage(records(spark, ("a", "Palm", "geometric", [1.0], {}, True, 0.9))),
        coverage.partial_coverage(records(spark, ("b", " ", "geometric", [0.0], {}, False, 0.9))),
    ]
    merged = coverage.merge_coverage(*parts)
    total = coverage.overall_coverage(merged).first()
    assert (total["total_samples"], total["failed_extractions"], total["success_rate"]) == (2, 1, 0.5)
    assert {r["gesture_label"] for r in merged.collect()} == {"Palm", "_unknown_"}


def test_matrix_append_and_pruned_read(spark, tmp_path):
    path = str(tmp_path / "m")
    tables.append_matrix(records(spark, ("a", "x", "geometric", [1.0], {}, True, 0.9)), path)
    tables.append_matrix(records(spark, ("b", "x", "hog", [0.0], {}, True, None), ("c", "x", "geometric", [0.0], {}, True, None)), path)
    assert tables.read_matrix(spark, path).count() == 2
    rows = tables.read_matrix(spark, path, family="keypoints_only", valid_only=False)
    assert sorted(r["sample_id"] for r in rows.collect()) == ["a", "c"]
    plan = rows.select("sample_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(feature_family" in plan
    ids = spark.createDataFrame([("b",)], "sample_id string")
    assert [r["sample_id"] for r in tables.read_matrix(spark, path, sample_ids=ids).collect()] == ["b"]
    assert rows.schema["vector_inline"].dataType.simpleString() == "array<double>"


def test_sidecar(spark, tmp_path):
    m = records(spark, ("a", "x", "hog", [], {}, True, None), ("b", "x", "hog", [1.0, 2.0], {}, True, None))
    tables.write_sidecar(m, str(tmp_path / "s"), {"b": 1, "a": 2, "_meta": 3}, {"n": 1})
    row = tables.read_sidecar(spark, str(tmp_path / "s"), "d", "hog_only").first()
    assert (row["n_samples"], row["vector_dim"]) == (2, 2)
    assert row["config_fingerprint"] == tables.config_fingerprint({"a": 2, "b": 1})


def test_family_filter_keeps_all_without_match(spark):
    m = records(spark, ("a", "x", "geometric", [1.0], {}, True, None))
    assert matrices.rows_of_family(m, "hog_only").count() == 1
    assert matrices.rows_of_family(m, "hog_only", strict=True).count() == 0


def test_label_sync(spark):
    m = records(spark, ("a", "old", "geometric", [1.0], {}, True, None), ("z", "kept", "geometric", [1.0], {}, True, None))
    manifest = spark.createDataFrame(
        [("a", "leapgestrecog", "01_palm"), ("a", "leapgestrecog", "01_palm"), ("q", "leapgestrecog", "c")],
        "sample_id string, dataset_name string, gesture_label string",
    )
    rows = {r["sample_id"]: (r["gesture_label"], r["updated"]) for r in matrices.sync_labels(m, manifest).collect()}
    assert rows == {"a": ("stop", True), "z": ("kept", False)}


def test_label_coverage(spark):
    manifest = spark.createDataFrame([("a",), ("a",), ("b",)], "gesture_label string")
    rows = {r["gesture_label"]: (r["n"], r["standing"]) for r in coverage.label_coverage(manifest, ["a", "c"]).collect()}
    assert rows == {"a": (2, "aligned"), "b": (1, "outside_reference"), "c": (0, "missing_reference")}
    ratio = coverage.aligned_ratio(coverage.label_coverage(manifest, ["a", "c"])).first()
    assert ratio["aligned_with_reference_ratio"] == pytest.approx(2 / 3)
    assert coverage.aligned_ratio(coverage.label_coverage(manifest, [])).first()[1] == 1.0


def test_csv_matrix(spark, tmp_path):
    m = records(spark, ("a", "x", "hog", [1.5], {"f": True}, True, None))
    tables.write_matrix_csv(m, str(tmp_path / "c"))
    row = spark.read.csv(str(tmp_path / "c"), header=True).first()
    assert (row["vector_inline"], row["quality_flags"].replace('\\', "")) == ("[1.5]", '{"f":true}')


def test_session_document(spark):
    events = spark.createDataFrame([("s", 1), ("s", 2)], "session_id string, frame_id int")
    summary = events.groupBy("session_id").agg(F.max("frame_id").alias("last"))
    row = tables.session_document(events, summary, "/log").first()
    assert (row["event_count"], row["summary"], row["session_log"]) == (2, '{"last":2}', "/log")


def test_versions_are_replaced_atomically(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    read = lambda number=None: {r["sample_id"]: r["gesture_label"] for r in versions.read_version(spark, path, schemas.FEATURE_MATRIX, number).collect()}
    ok = lambda *rows: records(spark, *[(i, label, family, [1.0], {}, True, 0.9) for i, label, family in rows])
    assert read() == {} and versions.commit_numbers(spark, path) == []
    assert versions.commit_parts(ok(("a", "x", "geometric"), ("b", "x", "hog")), path) == 1
    # a writer that dies before its commit leaves the table as it was
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", lambda *args: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            versions.commit_parts(ok(("a", "lost", "geometric")), path)
    assert read() == {"a": "x", "b": "x"}
    # a taken number is not overwritten; the other writer's part is kept
    real, calls = versions.publish, []

    def slow(spark_, path_, number, parts):
        if not calls:
            calls.append(number)
            versions.commit_parts(ok(("b", "other", "hog")), path)
        return real(spark_, path_, number, parts)

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", slow)
        assert versions.commit_parts(ok(("c", "y", "geometric")), path) == 3
    assert calls == [2] and read() == {"c": "y", "b": "other"}
    assert read(1) == {"a": "x", "b": "x"} and read(2) == {"a": "x", "b": "other"}
    # a table may be rewritten from itself
    stored = versions.read_version(spark, path, schemas.FEATURE_MATRIX)
    assert versions.commit_parts(stored.withColumn("gesture_label", F.upper("gesture_label")), path) == 4
    assert read() == {"c": "Y", "b": "OTHER"}
    assert [tuple(r) for r in versions.commits(spark, path).orderBy("number").collect()] == [(1, 2, 1), (2, 2, 2), (3, 2, 2), (4, 2, 1)]


def test_label_sync_of_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    versions.commit_parts(records(spark, ("a", "old", "geometric", [1.0], {}, True, 0.9), ("b", "keep", "geometric", [1.0], {}, True, 0.9)), path)
    manifest = spark.createDataFrame([("a", "new")], "sample_id string, gesture_label string")
    assert jobs.sync_labels_job(spark, path, manifest) == 1
    found = versions.read_version(spark, path, schemas.FEATURE_MATRIX)
    assert {(r["sample_id"], r["gesture_label"]) for r in found.collect()} == {("a", "new"), ("b", "keep")}
