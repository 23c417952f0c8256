import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.operators import ranking, splits


def manifest(spark, sizes):
    rows = [(f"{label}{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, gesture_label string")


def counts(df, column="split"):
    return Counter((r[column], r["gesture_label"]) for r in df.collect())


def test_split_sizes_and_determinism(spark):
    m = manifest(spark, {x: 6 for x in "abcde"})
    first = splits.stratified_split(m).collect()
    assert sorted(first) == sorted(splits.stratified_split(m.orderBy(F.rand())).collect())
    assert sorted(first) != sorted(splits.stratified_split(m, seed=7).collect())
    assert Counter(r["split"] for r in first) == {"train": 20, "val": 5, "test": 5}
    assert len({r["sample_id"] for r in first}) == 30


def test_published_split_sizes():
    # 34 classes of 500: train 11899, val 2550, test 2551.
    n, holdout = 17000, splits._ceil((1.0 - 0.7) * 17000)
    test = splits._ceil((1.0 - 0.15 / 0.3) * holdout)
    assert (n - holdout, holdout - test, test) == (11899, 2550, 2551)
    seats = splits.apportion({f"c{i:02d}": 500 for i in range(34)}, holdout)
    assert sum(seats.values()) == holdout and set(seats.values()) == {150, 151}


def test_proportions_hold_per_class(spark):
    got = counts(splits.stratified_split(manifest(spark, {"big": 200, "small": 20})))
    assert sum(n for (s, _), n in got.items() if s == "train") == 153
    assert abs(got[("train", "big")] - 140) <= 1 and abs(got[("train", "small")] - 14) <= 1


@pytest.mark.parametrize(
    "sizes, strategy, expected",
    [
        ({"a": 2}, None, {"train": 2}),
        ({"a": 3}, None, {"train": 2, "val": 1}),
        ({"a": 9, "b": 1}, None, {"train": 6, "val": 2, "test": 2}),
        ({"a": 10}, {"train_ratio": 0, "val_ratio": 0, "test_ratio": 1}, {"test": 10}),
        ({"a": 10}, {"train_ratio": 1, "val_ratio": 0, "test_ratio": 0}, {"train": 10}),
        ({"a": 10}, {"train_ratio": 0.5, "val_ratio": 0.5, "test_ratio": 0}, {"train": 5, "val": 5}),
        ({"a": 10}, {"train_ratio": 0, "val_ratio": 0.5, "test_ratio": 0.5}, {"val": 5, "test": 5}),
    ],
)
def test_small_sets_and_odd_ratios(spark, sizes, strategy, expected):
    rows = splits.stratified_split(manifest(spark, sizes), strategy=strategy).collect()
    assert Counter(r["split"] for r in rows) == expected


def test_ratios_must_sum_to_one():
    with pytest.raises(ValueError):
        splits.split_ratios({"train_ratio": 0.9})


def test_copies_share_a_split(spark):
    m = manifest(spark, {"a": 30, "b": 30})
    rows = splits.stratified_split(m.unionByName(m)).collect()
    assert len(rows) == 60


def test_folds(spark):
    m = manifest(spark, {"a": 23, "b": 11, "c": 7})
    folds = splits.stratified_folds(m, 2).collect()
    assert Counter(r["fold"] for r in folds) == {0: 21, 1: 20}
    assert {r["fold"] for r in splits.stratified_folds(m, 9).collect()} == {0, 1, 2}
    per_class = defaultdict(list)
    for (fold, label), n in counts(splits.stratified_folds(m, 3), "fold").items():
        per_class[label].append(n)
    assert all(max(ns) - min(ns) <= 1 for ns in per_class.values())
    assert splits.stratified_folds(manifest(spark, {"a": 5})).count() == 0
    roles = Counter(r["role"] for r in splits.fold_members(splits.stratified_folds(m, 2), 0).collect())
    assert roles == {"val": 21, "train": 20}


def test_distribution_knows_unknown_ids(spark):
    m = manifest(spark, {"a": 2})
    table = spark.createDataFrame([("a0", "train"), ("x", "train")], "sample_id string, split string")
    rows = {(r["split"], r["gesture_label"]): r["n"] for r in splits.split_distribution(m, table).collect()}
    assert rows == {("train", "a"): 1, ("train", "unknown"): 1}


def test_filter_labels(spark):
    df = spark.createDataFrame([("Two Words",), ("one",)], "raw_gesture_label string")
    assert splits.filter_labels(df, ["two-words"], fold_case=True).count() == 1
    assert splits.filter_labels(df, ["two-words"]).count() == 0
    assert splits.filter_labels(df, None).count() == 2


def test_quota_parts_equal_full_ranking(spark):
    """A stratum with most rows, few buckets, cuts at every odd place."""
    m = manifest(spark, {"hot": 300, "cold": 7})
    cuts = {"hot": [0, 1, 1, 150, 299, 300], "cold": [2, 5, 9, 9, 9, 9]}
    got = ranking.assign_by_quota(m, cuts, stratum="gesture_label", digits=1).collect()
    ordered = m.orderBy("gesture_label", ranking.hash_order(42, F.col("sample_id"))).collect()
    expected, seen = {}, Counter()
    for r in ordered:
        rank = seen[r["gesture_label"]]
        expected[r["sample_id"]] = sum(c <= rank for c in cuts[r["gesture_label"]])
        seen[r["gesture_label"]] += 1
    assert {r["sample_id"]: r["part"] for r in got} == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from("ab"), st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0])), min_size=1, max_size=60), q=st.sampled_from([0.0, 0.5, 0.95, 1.0]))
def test_quantile_equals_sorted_interpolation(spark, data, q):
    df = spark.createDataFrame(data, "g string, x double")
    got = {r["g"]: r["quantile"] for r in ranking.exact_quantile(df, ["g"], "x", q).collect()}
    for g in {g for g, _ in data}:
        values = sorted(x for h, x in data if h == g)
        rank = (len(values) - 1) * q
        low = int(rank)
        high = min(low + 1, len(values) - 1)
        assert got[g] == pytest.approx(values[low] * (1 - (rank - low)) + values[high] * (rank - low), abs=1e-6)


@pytest.mark.parametrize("q", [0.37, 1.0])
def test_quantile_by_radix_rounds(spark, q):
    """Ranges of all kinds narrowed down to two values at most."""
    rnd = random.Random(4)
    groups = {
        "tails": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(150)],
        "close": [1.0 + i * 2.0**-52 for i in range(90)],
        "negative": [-rnd.expovariate(1.0) for _ in range(120)] + [-0.5] * 40,
        "ends": [float("-inf"), float("inf"), 0.0, -0.0, 5e-324, -5e-324, 1.0],
        "one": [3.0],
    }
    rows = [(g, x) for g, values in groups.items() for x in values]
    df = spark.createDataFrame([*rows, ("one", None), ("empty", None)], "g string, x double")
    got = {r["g"]: r["quantile"] for r in ranking.exact_quantile(df, ["g"], "x", q, in_task=2).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        values = sorted(values)
        rank = (len(values) - 1) * q
        low = int(rank)
        weight = rank - low
        expected = values[low] if weight == 0 else values[low] * (1 - weight) + values[low + 1] * weight
        assert got[g] == pytest.approx(expected, rel=1e-15), g


def test_top_n_with_hot_group(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 else "cold", rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    got = {(r["g"], r["id"]) for r in ranking.top_n(df, ["g"], [F.desc("x"), F.col("id")], 7, salts=5).collect()}
    for g in ("hot", "cold"):
        best = sorted((r for r in rows if r[1] == g), key=lambda r: -r[2])[:7]
        assert {i for h, i in got if h == g} == {r[0] for r in best}
