import pytest
from pyspark.sql import functions as F

from labelloom.functions import scoring
from labelloom.operators import domains, errors, leaderboards, metrics


def predictions(spark, true, predicted, domain="ood", **extra):
    n = len(true)
    rows = [(str(i), t, p, domain, *[extra[k][i] for k in extra]) for i, (t, p) in enumerate(zip(true, predicted))]
    kinds = {"probability": "array<double>", "confidence": "double", "subject_id": "string", "capture_context": "map<string,string>"}
    more = "".join(f", {k} {kinds[k]}" for k in extra)
    assert n == len(rows)
    return spark.createDataFrame(rows, "sample_id string, true_label string, predicted_label string, domain string" + more)


def scores(df, *args, **kwargs):
    return metrics.classification_metrics(metrics.pair_counts(df), *args, **kwargs).first().asDict()


def test_metrics_by_hand(spark):
    df = predictions(spark, ["a", "a", "b", "c"], ["a", "b", "b", "a"])
    got = scores(df)
    assert got["accuracy"] == 0.5 and got["f1_micro"] == 0.5
    assert got["precision_macro"] == pytest.approx((1 / 2 + 1 / 2 + 0) / 3)
    assert got["recall_macro"] == pytest.approx((1 / 2 + 1 + 0) / 3)
    assert got["f1_macro"] == pytest.approx((1 / 2 + 2 / 3 + 0) / 3)


def test_metrics_over_a_label_list(spark):
    """False positives from unlisted rows count, accuracy ignores the list."""
    df = predictions(spark, ["a", "a", "b", "c"], ["a", "b", "b", "a"])
    got = scores(df, ["a", "zzz"])
    assert got["accuracy"] == 0.5
    assert got["precision_macro"] == pytest.approx((1 / 2 + 0) / 2)
    assert got["precision_micro"] == pytest.approx(1 / 2) and got["recall_micro"] == pytest.approx(1 / 2)


def test_empty_predictions_give_zeros(spark):
    got = scores(predictions(spark, ["a"], ["a"]).filter("false"), ["a"])
    assert got["accuracy"] == 0 and got["f1_macro"] == 0 and got["n_samples"] == 0


def test_domain_report(spark):
    df = predictions(spark, ["Palm", "Palm", "Fist", "Down"], ["Palm", "dislike", "Fist", "dislike"])
    report = domains.domain_report(df, ["Palm", "Fist", "Down", "Thumb"])
    palm = {r["gesture_label"]: r for r in report["per_class"].collect()}
    assert (palm["Palm"]["n_correct"], palm["Palm"]["accuracy"]) == (1, 0.5)
    assert palm["Thumb"]["n_samples"] == 0 and palm["Thumb"]["accuracy"] is None
    summary = report["summary"].first()
    assert summary["n_out_of_vocab_predictions"] == 2 and summary["out_of_vocab_prediction_rate"] == 0.5
    matrix = metrics.confusion_matrix(report["pairs"], ["Palm", "Fist", "Down", "Thumb", "_other_"])
    assert matrix.count() == len(matrix.columns) - 1 == 5


PROBA = [[0.5, 0.4, 0.1], [0.6, 0.3, 0.1], [0.8, 0.1, 0.1], [0.1, 0.2, 0.7]]


def test_protocols(spark):
    df = predictions(spark, ["Palm", "Palm", "Down", "Fist"], ["Palm", "dislike", "Down", "Fist"], probability=PROBA)
    rows = domains.evaluation_protocols(df, ["Palm", "Fist", "Thumb"], ["Down"], ["dislike", "Palm", "Fist"], "probability")
    got = {(r["protocol"], r["domain"]): r for r in rows.collect()}
    shared = got[("shared_subset", "ood")]
    assert (shared["n_samples"], shared["n_excluded"]) == (3, 1)
    assert got[("masked_unknown", "ood")]["unknown_rate"] == 0.25
    assert got[("masked_shared_argmax", "ood")]["accuracy"] == 0.75
    assert got[("masked_shared_argmax_subset", "ood")]["accuracy"] == 1.0
    forced = df.select(scoring.restricted_argmax(F.col("probability"), ["dislike", "Palm", "Fist"], ["Palm", "Fist", "Thumb"]))
    assert [r[0] for r in forced.collect()] == ["Palm", "Palm", "Palm", "Fist"]
    assert domains.protocol_availability(["x"], ["y"], True)[0] is False
    with pytest.raises(ValueError):
        scoring.restricted_argmax(F.col("probability"), ["a"], ["b"])


def test_protocols_without_probabilities(spark):
    df = predictions(spark, ["x"], ["y"])
    rows = domains.evaluation_protocols(df, [], ["x"]).collect()
    assert [r["protocol"] for r in rows] == ["masked_unknown"] and rows[0]["unknown_rate"] == 1.0


def test_drop(spark):
    rows = spark.createDataFrame([("in_domain", 0.9, 0.8), ("ood", 0.7, 0.5)], "domain string, accuracy double, f1_macro double")
    row = domains.with_recommendation(domains.domain_drop(rows)).first()
    assert row["absolute_accuracy_drop"] == pytest.approx(0.2)
    assert row["relative_performance_retention"] == pytest.approx(0.7 / 0.9)
    assert row["recommendation"] == "deploy_with_caution"
    only = domains.domain_drop(rows.filter("domain = 'ood'")).first()
    assert only["relative_performance_retention"] == 0.0


def test_shift(spark):
    both = predictions(spark, ["A", "B"], ["A", "B"], "in_domain").unionByName(predictions(spark, ["A", "A", "B", "B"], ["A", "B", "B", "A"]))
    rows = {r["gesture_label"]: r["absolute_drop"] for r in domains.per_class_shift(both, ["A", "B"]).collect()}
    assert rows == {"A": 0.5, "B": 0.5}
    assert errors.misclassified_pairs(both.filter("domain = 'ood'")).agg(F.sum("n")).first()[0] == 2
    none = domains.per_class_shift(both, ["A", "Z"]).filter("gesture_label = 'Z'").first()
    assert none["absolute_drop"] is None


def side(spark, dim, family="hog"):
    return spark.createDataFrame([(dim, family, "v1")], "vector_dim int, feature_family string, feature_version string")


def test_schema_check(spark):
    row = domains.schema_compatibility(side(spark, 64), side(spark, 32), ["a"], ["a", "b"]).first()
    assert not row["compatible"] and row["issues"] == ["vector_dim mismatch: train=64 test=32"]
    assert (row["shared"], row["train_only"], row["test_only"]) == (["a"], [], ["b"])
    apart = domains.schema_compatibility(side(spark, 64), side(spark, 64), ["a"], ["palm"]).first()
    assert apart["issues"] == ["no overlapping gesture labels between train and test domains"]
    assert apart["outside_reference_train"] == ["a"] and apart["outside_reference_test"] == []
    assert domains.schema_compatibility(side(spark, 64), side(spark, 64), [], []).first()["compatible"]


def test_failures(spark):
    df = predictions(spark, ["a", "a", "b"], ["x", "x", "b"], confidence=[0.3, 0.8, 0.9])
    rows = errors.failure_samples(df, 1).collect()
    assert [r["sample_id"] for r in rows] == ["1"]
    two = predictions(spark, ["a", "b", "b"], ["x", "x", "b"])
    assert errors.failure_samples(two, 1).count() == 2


def test_errors_by_context(spark):
    df = predictions(
        spark, ["a", "a", "b"], ["x", "y", "b"], subject_id=["s1", None, None],
        capture_context=[{"source": "lab"}, {"subject_id": "s9"}, {}],
    )
    rows = {(r["dimension"], r["key"], r["other_key"]): r["n"] for r in errors.errors_by_context(df).collect()}
    assert rows[("total", None, None)] == 2
    assert rows[("source", "lab", None)] == rows[("source", "unknown", None)] == 1
    assert rows[("subject", "s1", None)] == rows[("subject", "s9", None)] == 1
    assert rows[("pair", "a", "x")] == 1
    bare = {r["key"] for r in errors.errors_by_context(df.drop("capture_context", "subject_id")).collect()}
    assert {"ood", "unknown"} <= bare


def test_metadata_defaults(spark):
    df = predictions(spark, ["a"], ["a"], confidence=[0.5])
    manifest = spark.createDataFrame([], "sample_id string, dataset_name string, image_path string, subject_id string, capture_context map<string,string>")
    row = errors.with_metadata(df, manifest, "ood", "name").first()
    assert (row["dataset_name"], row["image_path"], row["subject_id"], row["correct"]) == ("name", "", None, True)
    assert row["capture_context"] == {}


RUNS = "run_id string, experiment_id string, status string, algorithm string, feature_family string, metrics map<string,double>, outputs map<string,string>"


def test_leaderboard(spark):
    rows = [
        ("1", "E", "completed", "knn", "hog", {"accuracy": 0.5}, {}),
        ("2", "E", "completed", "svm", "hog", {}, {}),
        ("3", "E", "completed", "mlp", "hog", {"accuracy": 0.9, "f1_macro": 0.1}, {}),
        ("4", "E", "running", "mlp", "hog", {"accuracy": 1.0}, {}),
    ]
    runs = leaderboards.completed_runs(spark.createDataFrame(rows, RUNS), "E")
    board = leaderboards.leaderboard(runs, {"report": ["acc", "f1"]})
    assert [r["run_id"] for r in board.collect()] == ["3", "1", "2"]
    assert board.columns[-2:] == ["accuracy", "f1_macro"]


def test_profile_of_constant_metric(spark):
    rows = [("1", "a", "f", 0.5, 10.0), ("2", "b", "f", 0.5, 30.0)]
    df = spark.createDataFrame(rows, "run_id string, algorithm string, feature_family string, accuracy double, per_sample_inference_ms double")
    got = {r["label"]: (r["accuracy"], r["per_sample_inference_ms"]) for r in leaderboards.metric_profile(df, ("accuracy", "per_sample_inference_ms")).collect()}
    assert got == {"a / f": (0.5, 1.0), "b / f": (0.5, 0.0)}


def test_plans_and_specs():
    assert len(leaderboards.grid(leaderboards.search_space("svm"))) == 6
    assert leaderboards.grid({}) == [{}]
    with pytest.raises(KeyError):
        leaderboards.search_space("nope")
    assert leaderboards.candidates("svm_rbf", {"C": [2]}) == [{"C": 2}]
    assert len(leaderboards.candidates("knn")) == 3
    specs = leaderboards.suite_specs(["svm", "svm_rbf", "knn"], ["hog_only", "hybrid"])
    assert specs == [("svm", "hog_only"), ("knn", "hog_only"), ("svm", "hybrid"), ("knn", "hybrid")]
    assert leaderboards.suite_specs([], [], [{"algorithm": "knn", "feature_family": "hybrid"}]) == [("knn", "hybrid")]
