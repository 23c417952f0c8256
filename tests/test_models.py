from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import approximate, bayes, classifiers, matrices, neighbours, scaling, splits, tuning
from labelloom.plans import jobs
from labelloom.streaming import live

RNG = np.random.default_rng(0)
ROWS = "sample_id string, gesture_label string, vector_inline array<double>"


def blobs(n=90, dim=6, spread=0.4, offset=0.0):
    labels = ["A", "B", "C"]
    centres = {c: RNG.normal(0, 1, dim) * 3 for c in labels}
    return [
        (f"r{i}", labels[i % 3], (centres[labels[i % 3]] + offset + RNG.normal(0, spread, dim)).tolist())
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def data(spark):
    rows = blobs()
    return spark.createDataFrame(rows[:60], ROWS), spark.createDataFrame(rows[60:], ROWS)


@pytest.mark.parametrize("sizes", [{}, {"train_block_rows": 7, "query_chunk_rows": 4}, {"least_chunks": 3}])
def test_neighbours_equal_brute_force(spark, sizes):
    points = [(f"t{i:03d}", str(i % 4), RNG.integers(0, 4, 3).astype(float).tolist()) for i in range(60)]
    queries = [(f"q{i}", RNG.integers(0, 4, 3).astype(float).tolist()) for i in range(20)]
    train = spark.createDataFrame(points, "sample_id string, label string, vector array<double>")
    query = spark.createDataFrame(queries, "sample_id string, vector array<double>")
    got = {}
    for r in neighbours.nearest(query, train, 5, **sizes).collect():
        got.setdefault(r["sample_id"], []).append((r["rank"], r["neighbour_id"]))
    for qid, q in queries:
        order = sorted((np.linalg.norm(np.array(v) - q), tid) for tid, _, v in points)[:5]
        assert [t for _, t in sorted(got[qid])] == [t for _, t in order]
    votes = {r["sample_id"]: r for r in neighbours.knn_predict(query, train, 5, **sizes).collect()}
    label = {tid: lab for tid, lab, _ in points}
    for qid, _ in queries:
        names = sorted(label[t] for _, t in got[qid])
        best = max(dict.fromkeys(names), key=names.count)
        assert votes[qid]["predicted_label"] == best and votes[qid]["confidence"] == names.count(best) / 5


def test_fewer_train_rows_than_neighbours(spark, data):
    one = data[0].limit(1).select("sample_id", F.col("gesture_label").alias("label"), F.col("vector_inline").alias("vector"))
    got = neighbours.knn_predict(data[1].select("sample_id", F.col("vector_inline").alias("vector")), one).collect()
    assert len(got) == 30 and {r["confidence"] for r in got} == {1.0}


def test_scaler_uses_population_deviation(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [6.0, 5.0]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vector_inline array<double>")
    rows = scaling.scaler_stats(df).orderBy("dim").collect()
    assert rows[0]["mean"] == pytest.approx(3.0) and rows[0]["scale"] == pytest.approx(x[:, 0].std())
    assert rows[1]["scale"] == 1.0


def test_bayes_equals_numpy(spark, data):
    train, test = (df.collect() for df in data)
    model = bayes.fit(data[0], var_smoothing=1e-3)
    x = np.array([r["vector_inline"] for r in test])
    columns = []
    for c in model.classes:
        part = np.array([r["vector_inline"] for r in train if r["gesture_label"] == c])
        m, v = part.mean(axis=0), part.var(axis=0) + 1e-3
        columns.append(np.log(len(part) / 60) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1))
    joint = np.column_stack(columns)
    np.testing.assert_allclose(model.log_likelihood(x), joint)
    scored = {r["sample_id"]: r for r in model.transform(data[1]).collect()}
    for r, row in zip(test, joint):
        assert scored[r["sample_id"]]["predicted_label"] == model.classes[int(row.argmax())]
        assert sum(scored[r["sample_id"]]["probability"]) == pytest.approx(1.0)


FAST = {
    "knn": {}, "naive_bayes": {}, "decision_tree": {}, "random_forest": {"n_estimators": 10},
    "logistic_regression": {"C": 100.0, "max_iter": 50}, "mlp": {"hidden_dims": [8]},
    "svm": {"max_iter": 10, "num_features": 64},
}


@pytest.mark.parametrize("name", sorted(FAST))
def test_every_algorithm_learns_saves_and_loads(spark, data, tmp_path, name):
    model = classifiers.train(data[0], name, FAST[name])
    scored = jobs.predict(model, data[1])
    assert scored.filter("true_label = predicted_label").count() / 30 >= 0.9
    first = scored.first()
    assert len(first["probability"]) == 3 and sum(first["probability"]) == pytest.approx(1.0)
    path = classifiers.model_path(str(tmp_path), "EXP-01", name, "hybrid")
    model.save(spark, path, {"note": "x"})
    again, meta = classifiers.load(spark, path)
    assert meta == {"note": "x"} and again.classes == ["A", "B", "C"]
    pick = lambda df: sorted((r["sample_id"], r["predicted_label"]) for r in df.collect())
    assert pick(jobs.predict(again, data[1])) == pick(scored)


def test_linear_svm(spark, data):
    model = classifiers.train(data[0], "svm", {"kernel": "linear", "max_iter": 10})
    assert model.own.kernel is None and model.own.weights.shape == (3, 6)
    assert jobs.predict(model, data[1]).filter("true_label = predicted_label").count() >= 27


def test_registry():
    assert "knn" in classifiers.algorithms() and len(classifiers.algorithms()) == 7
    with pytest.raises(KeyError):
        classifiers.build_estimator("nope")
    with pytest.raises(KeyError):
        classifiers.train(None, "nope")
    assert classifiers.build_estimator("decision_tree_cart", {"max_depth": None}).getMaxDepth() == 30


def matrix(spark, rows, family="geometric"):
    return spark.createDataFrame(rows, ROWS).select(
        "*", F.lit("d").alias("dataset_name"), F.lit(family).alias("feature_family"), F.lit("v1").alias("feature_version")
    )


def test_experiment_suite_and_report(spark, tmp_path):
    m = matrix(spark, blobs())
    table = splits.stratified_split(m)
    runs = jobs.benchmark_suite(m, table, ["naive_bayes", "decision_tree_cart"], ["keypoints_only"], models=str(tmp_path / "models"))
    rows = runs.collect()
    assert [r["algorithm"] for r in rows] == ["naive_bayes", "decision_tree"]
    assert all(r["metrics"]["accuracy"] >= 0.9 and r["metrics"]["fit_seconds"] > 0 for r in rows)
    board = jobs.benchmark_report(runs, "EXP-02", None, str(tmp_path / "board"))
    assert board.count() == 2 and spark.read.csv(str(tmp_path / "board"), header=True).count() == 2
    assert jobs.best_run(runs).count() == 1
    model, _ = classifiers.load(spark, rows[0]["artifacts"]["model_path"])
    assert model.algorithm == "naive_bayes"
    dry, none, _ = jobs.run_experiment(m, table, "knn", "hybrid", dry_run=True)
    assert dry.first()["status"] == "dry_run" and none is None


def test_robustness_suite(spark):
    rows = blobs()
    m, ood = matrix(spark, rows), matrix(spark, [(f"o{i}", lab, [x + 2.0 for x in v]) for i, (_, lab, v) in enumerate(rows)])
    manifest = ood.select(
        "sample_id", "dataset_name", F.lit("/p").alias("image_path"), F.lit("s1").alias("subject_id"),
        F.create_map(F.lit("source"), F.lit("lab")).alias("capture_context"),
    )
    table = splits.stratified_split(m)
    model = classifiers.train(splits.rows_of_split(m, table, "train"), "naive_bayes")
    result = jobs.robustness_run(model, m, ood, test_ids=table.filter("split = 'test'"), ood_manifest=manifest)
    assert result["predictions"].groupBy("domain").count().count() == 2
    assert result["schema"].first()["compatible"]
    assert result["drop"].first()["in_domain_accuracy"] >= 0.9
    assert {r["protocol"] for r in result["protocols"].collect()} == {
        "shared_subset", "masked_unknown", "masked_shared_argmax", "masked_shared_argmax_subset",
    }
    nobody = spark.createDataFrame([("zzz",)], "sample_id string")
    fallback = jobs.robustness_run(model, m, ood, test_ids=nobody)
    assert fallback["predictions"].filter("domain = 'in_domain'").count() == 90
    suite = jobs.robustness_suite({("naive_bayes", "geometric"): model, ("svm", "geometric"): None}, m, ood)
    assert [r["algorithm"] for r in suite.collect()] == ["naive_bayes"]
    with pytest.raises(ValueError):
        jobs.robustness_suite({("svm", "hog"): None}, m, ood)


def test_stream_scoring_equals_batch(spark, tmp_path):
    hands = [(f"h{i}", "AB"[i % 2], (RNG.uniform(0.2, 0.8, (21, 3)) * (1 + i % 2 * np.arange(21)[:, None] / 30)).tolist()) for i in range(24)]
    df = spark.createDataFrame(hands, "sample_id string, gesture_label string, landmarks array<array<double>>").select(
        "*", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(0.9).alias("confidence"),
        F.lit("s").alias("session_id"), F.xxhash64("sample_id").alias("frame_id"), F.lit(0).cast("bigint").alias("us"),
    )
    model = classifiers.train(jobs.extract_features(df, "geometric"), "naive_bayes", {"var_smoothing": 0.1})
    df.write.parquet(str(tmp_path / "in"))
    stream = live.frame_stream(spark, str(tmp_path / "in"), df.schema)
    got = live.drained(live.score_stream(stream, model, "geometric"), "scores").collect()
    batch = {r["sample_id"]: r["predicted_label"] for r in model.transform(jobs.extract_features(df, "geometric")).collect()}
    assert {r["sample_id"]: r["label"] for r in got} == batch
    assert {r["session_id"] for r in got} == {"s"} and all(r["extraction_ok"] for r in got)
    # The whole live pipeline as one query: features, score, vote, debounce, action.
    settings = live.LiveSettings(window_size=1, confidence_threshold=0.0, keymap={"a": "up"}, aliases={})
    acted = live.drained(live.live_sessions(live.score_stream(stream, model, "geometric"), settings), "acted").collect()
    assert len(acted) == 24 and {r["reason"] for r in acted} == {"dry_run", "unmapped_gesture", "not_eligible"}
    assert sum(r["would_emit"] for r in acted) == 1
    with pytest.raises(ValueError):
        live.score_stream(stream, classifiers.Trained("knn", [], {}), "geometric")


def test_extraction_job(spark, tmp_path):
    hands = [(f"h{i}", "A", RNG.uniform(0.2, 0.8, (21, 3)).tolist() if i else None, 0.4 + i / 10) for i in range(4)]
    df = spark.createDataFrame(hands, "sample_id string, gesture_label string, landmarks array<array<double>>, confidence double").select(
        "*", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("d").alias("dataset_name")
    )
    config = {"quality_flags": {"min_detection_confidence": 0.55, "min_samples_per_class": 5}}
    result = jobs.extraction_job(df, "geometric", str(tmp_path), config)
    assert result["matrix"].count() == 4
    assert result["overall"].first()["failed_extractions"] == 1
    assert [r["rule"] for r in result["violations"].collect()] == ["min_samples"]
    assert [r["sample_id"] for r in result["low_confidence"].collect()] == ["h1"]


def test_svm_strength_follows_the_rows():
    few, many = (classifiers.build_estimator("svm", {"C": 2.0, "max_iter": 250}, n_train=n).getClassifier() for n in (10, 1000))
    assert few.getRegParam() == pytest.approx(1 / 20) and many.getRegParam() == pytest.approx(1 / 2000)
    assert few.getMaxIter() == 250


def test_unknown_hyperparameters_are_refused(spark):
    rows = spark.createDataFrame([("a", "x", [1.0])], "sample_id string, gesture_label string, vector_inline array<double>")
    with pytest.raises(ValueError, match="learning_rate"):
        classifiers.train(rows, "mlp", {"learning_rate": 0.1})


def test_tune_prefers_the_better_candidate(spark):
    rows = [(f"s{i}", "ab"[i % 2], [float(i % 2) + (i % 7) / 100, 0.0]) for i in range(40)]
    matrix = spark.createDataFrame(rows, "sample_id string, gesture_label string, vector_inline array<double>")
    best, tried = jobs.tune(matrix, splits.stratified_folds(matrix, 2), "knn", {"n_neighbors": [20, 1]}, "accuracy")
    assert best == {"n_neighbors": 1} and len(tried) == 2 and all(len(t["scores"]) == 2 for t in tried)


def clustered(n: int, dims: int = 16, seed: int = 1) -> list[tuple]:
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dims)) * 3
    which = draw.integers(0, 12, n)
    return [(f"r{i:05d}", f"c{w}", (centres[w] + draw.normal(size=dims)).tolist()) for i, w in enumerate(which)]


def test_approximate_neighbours(spark, monkeypatch):
    rows = clustered(3000)
    copies = [(f"z{i:05d}", "copy", rows[0][2]) for i in range(900)]  # one vector holds a quarter of all rows
    train = spark.createDataFrame(rows + copies, "sample_id string, label string, vector array<double>").repartition(5)
    queries = train.filter("sample_id like 'r%0'").select("sample_id", "vector")
    monkeypatch.setattr(approximate, "PART_ROWS", 200)
    monkeypatch.setattr(approximate, "PART_QUERIES", 40)
    buckets = approximate.fit_buckets(train, bucket_rows=64)
    assert 1 < buckets.probes < 1 << len(buckets.cuts) and buckets.estimated_recall >= 0.95
    found = approximate.nearest_approximate(queries, train, 5, buckets).cache()
    exact = neighbours.nearest(queries, train, 5).cache()
    assert approximate.recall_against(found, exact) >= 0.9
    assert {r["n"] for r in found.groupBy("sample_id").agg(F.count("*").alias("n")).collect()} == {5}
    # distances are exact, complete results too
    true = {(r["sample_id"], r["neighbour_id"]): r["distance"] for r in exact.collect()}
    whole = found.filter("complete").collect()
    assert whole and all((r["sample_id"], r["neighbour_id"]) in true for r in whole)
    mine = {(r["sample_id"], r["neighbour_id"]): r["distance"] for r in found.collect()}
    assert all(abs(mine[k] - true[k]) < 1e-9 for k in mine.keys() & true.keys())


def test_approximate_neighbours_of_few_rows_are_exact(spark):
    kind = "sample_id string, label string, vector array<double>"
    train = spark.createDataFrame(clustered(40), kind)
    found = approximate.nearest_approximate(train.limit(9), train, 3).collect()
    exact = neighbours.nearest(train.limit(9), train, 3).collect()
    assert {(r["sample_id"], r["neighbour_id"], r["rank"]) for r in found} == {(r["sample_id"], r["neighbour_id"], r["rank"]) for r in exact}
    assert all(r["complete"] for r in found)
    nothing = spark.createDataFrame([], kind)
    assert approximate.nearest_approximate(train, nothing, 3).count() == 0
    assert approximate.nearest_approximate(nothing, train, 3).count() == 0
    assert approximate.knn_predict_approximate(train.limit(2), train, 3).count() == 2


def test_probes_are_the_nearest_buckets():
    draw = np.random.default_rng(4)
    made = approximate.Buckets(np.linalg.qr(draw.normal(size=(9, 9)))[0][:, :5], draw.normal(size=5) / 3, 7, 1.0)
    x = draw.normal(size=(50, 9))
    looked, bound = made.probed(x)
    margins = made.margins(x)
    for i in range(50):
        cost = {int(made.codes(x[i : i + 1])[0]) ^ flip: sum(margins[i, j] ** 2 for j in range(5) if flip >> j & 1) for flip in range(32)}
        order = sorted(cost.values())
        assert np.allclose([cost[c] for c in looked[i].tolist()], order[:7]) and np.isclose(bound[i], order[7])


@pytest.mark.parametrize("scale", [False, True])
def test_folds_at_once_equal_one_by_one(spark, scale):
    rows = spark.createDataFrame(blobs(120, spread=3.0), ROWS)
    folds = rows.select("sample_id", (F.substring("sample_id", 2, 9).cast("int") % 4).alias("fold"))
    smoothings = [1e-9, 0.5]
    got = {(r["var_smoothing"], r["fold"]): r for r in tuning.tuning_scores(rows, folds, smoothings, scale).collect()}
    assert set(got) == {(s, f) for s in smoothings for f in range(4)}
    for s in smoothings:
        for f in range(4):
            member = splits.fold_members(folds, f).withColumnRenamed("role", "split")
            model = classifiers.train(splits.rows_of_split(rows, member, "train"), "naive_bayes", {"var_smoothing": s}, scale=scale)
            scored = jobs.predict(model, splits.rows_of_split(rows, member, "val"))
            right = scored.filter("true_label = predicted_label").count() / scored.count()
            assert got[s, f]["accuracy"] == pytest.approx(right) and got[s, f]["n_samples"] == scored.count()
    means = {s: sum(got[s, f]["f1_macro"] for f in range(4)) for s in smoothings}
    assert tuning.best_candidate(tuning.tuning_scores(rows, folds, smoothings, scale)) == max(smoothings, key=lambda s: (means[s], -s))


def test_folds_at_once_of_odd_tables(spark):
    rows = spark.createDataFrame(blobs(9), ROWS)
    one = rows.select("sample_id", F.lit(0).alias("fold"))
    assert tuning.tuning_scores(rows, one, [0.1]).count() == 0  # nothing outside the only fold
    assert tuning.best_candidate(tuning.tuning_scores(rows.limit(0), one, [0.1])) is None


def test_failed_rows_are_left_out_and_counted(spark):
    kind = "sample_id string, dataset_name string, gesture_label string, feature_family string, feature_version string, vector_path string, vector_inline array<double>, quality_flags map<string,boolean>, extraction_ok boolean, confidence double, source_families array<string>"
    good = [(i, "d", label, "geometric", "v1", None, x, {}, True, 0.9, None) for i, label, x in blobs(30)]
    bad = [("n1", "d", "A", "geometric", "v1", None, None, {}, True, 0.9, None), ("f1", "d", "B", "geometric", "v1", None, [0.0] * 6, {"detection_failed": True}, False, 0.1, None)]
    matrix = spark.createDataFrame(good + bad, kind)
    usable = matrices.exclude_invalid(matrix).filter("vector_inline is not null")
    model = classifiers.train(usable, "naive_bayes")
    result = jobs.robustness_run(model, matrix, matrix.filter("sample_id <> 'n1'"), family="geometric")
    assert {(r["domain"], r["kept"], r["left_out"]) for r in result["left_out"].collect()} == {("in_domain", 30, 2), ("ood", 30, 1)}
    assert result["predictions"].count() == 60
    numbers = result["run"].first()["metrics"]
    assert numbers["n_scored"] == 60 and numbers["inference_seconds"] > 0 and numbers["per_sample_inference_ms"] > 0


def test_rows_that_no_cuts_part_stay_in_few_buckets(spark):
    """Where nearly all of many buckets would be probed, each query is copied to few of them."""
    draw = np.random.default_rng(8)
    rows = [(f"r{i:05d}", "x", v) for i, v in enumerate(draw.normal(size=(3000, 32)).tolist())]
    train = spark.createDataFrame(rows, "sample_id string, label string, vector array<double>").repartition(4)
    buckets = approximate.fit_buckets(train, bucket_rows=64)
    assert buckets.probes <= 2 and buckets.estimated_recall >= 0.95
    queries = train.filter("sample_id like 'r%00'").select("sample_id", "vector")
    found = approximate.nearest_approximate(queries, train, 5, buckets)
    assert approximate.recall_against(found, neighbours.nearest(queries, train, 5)) >= 0.9


def test_features_and_scores_are_made_in_small_blocks():
    """A batch of any size gives the same rows, with few of the wide features at a time."""
    draw = np.random.default_rng(9)
    kernel = classifiers.FourierKernel(0.1, 6, 32)
    x = draw.normal(size=(5000, 6))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(5001) * 6, pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000.0)), vectors], names=["label", "vector_inline"])
    out = list(kernel.batches(iter([batch.slice(0, 0), batch.slice(7, 2500), batch.slice(2507)])))
    assert max(b.num_rows for b in out) <= 1024
    table = pa.Table.from_batches(out)
    assert table.column("label").to_pylist() == list(range(7, 5000))
    got = np.array(table.column("features").to_pylist())
    np.testing.assert_allclose(got, kernel.features(x[7:]), atol=1e-12)
    shown = []
    machine = classifiers.LinearScores(("a", "b"), draw.normal(size=(2, 32)), np.zeros(2), kernel)
    mapper = SimpleNamespace(schema=T.StructType(), mapInArrow=lambda score, schema: shown.extend(score(iter([batch]))))
    machine.transform(mapper)
    assert max(b.num_rows for b in shown) <= 1024 and sum(b.num_rows for b in shown) == 5000
