"""Stratified train/val/test splits, folds, class caps and seeded order."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.ranking import assign_by_quota, hash_order, top_n
from labelloom.session import materialize

SPLITS = ("train", "val", "test")


def split_ratios(strategy: Mapping[str, Any] | None = None) -> tuple[float, float, float]:
    """Train, val and test ratio; they must sum to 1."""
    strategy = strategy or {}
    ratios = tuple(
        float(strategy.get(f"{name}_ratio", default)) for name, default in zip(SPLITS, (0.7, 0.15, 0.15))
    )
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios)}")
    return ratios


def _ceil(x: float) -> int:
    return -int(-x // 1)


def _ids(manifest: DataFrame) -> DataFrame:
    """One row per sample id, so that copies of a sample share a split."""
    return manifest.groupBy("sample_id").agg(F.max("gesture_label").alias("gesture_label"))


def _class_sizes(ids: DataFrame) -> dict[str, int]:
    """Rows per label: one number per word of the label vocabulary."""
    rows = ids.groupBy("gesture_label").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gesture_label"]: r["n"] for r in sorted(rows, key=lambda r: r["gesture_label"])}


def apportion(sizes: Mapping[str, int], seats: int) -> dict[str, int]:
    """Share *seats* among classes in proportion to their size, by largest remainder.

    Integer arithmetic only; equal remainders go to the first class by name.
    """
    total = sum(sizes.values())
    shares = {name: divmod(n * seats, total) for name, n in sizes.items()}
    left = seats - sum(share for share, _ in shares.values())
    favoured = sorted(shares, key=lambda name: (-shares[name][1], name))[:left]
    return {name: share + (name in favoured) for name, (share, _) in shares.items()}


def _can_stratify(sizes: Mapping[str, int], n_second: int) -> bool:
    """Every class needs two rows, and both parts a row for each class."""
    n_first = sum(sizes.values()) - n_second
    return min(sizes.values()) >= 2 and min(n_first, n_second) >= len(sizes)


def _halve(ids: DataFrame, n_second: int, sizes: Mapping[str, int], seed: int) -> DataFrame:
    """Tag rows with `part` 0 or 1, *n_second* rows in part 1, by class where possible."""
    n = sum(sizes.values())
    if not _can_stratify(sizes, n_second):
        whole = ids.withColumn("stratum", F.lit(""))
        return assign_by_quota(whole, {"": [n - n_second]}, seed=seed).drop("stratum")
    seats = apportion(sizes, n_second)
    cuts = {name: [size - seats[name]] for name, size in sizes.items()}
    return assign_by_quota(ids, cuts, stratum="gesture_label", seed=seed)


def stratified_split(
    manifest: DataFrame, seed: int = 42, strategy: Mapping[str, Any] | None = None
) -> DataFrame:
    """Split table (sample_id, gesture_label, split), the same for the same seed.

    The holdout takes ceil((1 - train) * n) samples, its test share is rounded up
    too, and both are spread over the classes in proportion. Fewer than three
    samples, or no holdout, put everything into train; a holdout of one goes to
    val. A train ratio of zero is allowed. Where classes are too small, the split
    is random over all rows instead.

    The table is narrow and read again by every later step, so it is written to
    the shared folder.
    """
    train, val, test = split_ratios(strategy)
    ids = materialize(_ids(manifest), "split-ids")
    sizes = _class_sizes(ids)
    n = sum(sizes.values())
    n_holdout = min(n, _ceil((1.0 - train) * n))
    if n < 3 or n_holdout == 0:
        return ids.withColumn("split", F.lit("train"))
    n_test = 0 if n_holdout < 2 else min(n_holdout, _ceil((1.0 - val / (val + test)) * n_holdout))

    name = lambda *parts: F.element_at(F.array(*map(F.lit, parts)), F.col("part") + 1).alias("split")
    columns = ["sample_id", "gesture_label"]
    rest = "test" if n_test == n_holdout else "val"
    if n_test in (0, n_holdout):
        if n_holdout == n:
            return ids.withColumn("split", F.lit(rest))
        split = _halve(ids, n_holdout, sizes, seed).select(*columns, name("train", rest))
    elif n_holdout == n:
        split = _halve(ids, n_test, sizes, seed).select(*columns, name("val", "test"))
    else:
        seats = apportion(sizes, n_holdout)
        if _can_stratify(sizes, n_holdout) and _can_stratify(seats, n_test):
            # Both steps go by class: one pass with two cuts per class.
            tests = apportion(seats, n_test)
            cuts = {c: [size - seats[c], size - tests[c]] for c, size in sizes.items()}
            parts = assign_by_quota(ids, cuts, stratum="gesture_label", seed=seed)
            split = parts.select(*columns, name("train", "val", "test"))
        else:
            halves = materialize(_halve(ids, n_holdout, sizes, seed), "split-halves")
            held = halves.filter("part = 1").drop("part")
            inner = _halve(held, n_test, _class_sizes(held), seed + 1).select(*columns, name("val", "test"))
            kept = halves.filter("part = 0").select(*columns, F.lit("train").alias("split"))
            split = kept.unionByName(inner)
    return materialize(split, "split")


def stratified_folds(
    manifest: DataFrame,
    n_folds: int = 5,
    seed: int = 42,
    splits: DataFrame | None = None,
    split: str = "train",
) -> DataFrame:
    """Fold table (sample_id, gesture_label, fold) over the rows of one split.

    The number of folds is capped by rows and by classes; below two there is no
    fold. Classes laid out one after another are dealt to the folds in turn, so
    fold sizes differ by one at most, in total and per class.
    """
    if splits is not None:
        ids = splits.filter(F.col("split") == split).select("sample_id", "gesture_label")
    else:
        ids = manifest
    ids = materialize(_ids(ids), "fold-ids")
    sizes = _class_sizes(ids)
    n = sum(sizes.values())
    k = min(n_folds, n, len(sizes))
    if k < 2:
        return ids.limit(0).withColumn("fold", F.lit(0))
    cuts, start = {}, 0
    for label, size in sizes.items():
        # Seats of fold f: positions p in [start, start + size) with p % k == f.
        seats = [len(range(start + (f - start) % k, start + size, k)) for f in range(k)]
        cuts[label] = [sum(seats[: f + 1]) for f in range(k - 1)]
        start += size
    return assign_by_quota(ids, cuts, stratum="gesture_label", output="fold", seed=seed)


def fold_members(folds: DataFrame, fold: int) -> DataFrame:
    """Rows of one fold's run: role `val` inside the fold, `train` outside."""
    return folds.withColumn("role", F.when(F.col("fold") == fold, "val").otherwise("train"))


def split_distribution(manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """Samples per split and label; ids the manifest lacks count as `unknown`.

    Ids are unique on both sides, so the join keys are evenly spread.
    """
    labels = _ids(manifest)
    return (
        splits.select("sample_id", "split")
        .join(labels, "sample_id", "left")
        .groupBy("split", F.coalesce("gesture_label", F.lit("unknown")).alias("gesture_label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rows_of_split(df: DataFrame, splits: DataFrame, *names: str) -> DataFrame:
    """Rows whose sample id belongs to one of the named splits."""
    wanted = splits.filter(F.col("split").isin(*names)).select("sample_id")
    return df.join(wanted, "sample_id", "left_semi")


def cap_per_class(
    manifest: DataFrame, limit: int | None, label: str = "raw_gesture_label", path: str = "image_path"
) -> DataFrame:
    """At most *limit* samples of each class, the first ones by path."""
    if limit is None:
        return manifest
    return top_n(manifest, [label], [F.col(path), F.col("sample_id")], int(limit))


def seeded_order(manifest: DataFrame, seed: int = 42) -> DataFrame:
    """Manifest in a seeded random order (a distributed range sort)."""
    return manifest.orderBy(hash_order(seed, F.col("sample_id")), "sample_id")


def filter_labels(
    df: DataFrame, targets: list[str] | None, label: str = "raw_gesture_label", fold_case: bool = False
) -> DataFrame:
    """Rows with a target label; no targets keep everything.

    With *fold_case* both sides are compared in lower case with `-` and blank as `_`.
    """
    if not targets:
        return df
    value = F.col(label)
    if fold_case:
        value = F.translate(F.lower(value), "- ", "__")
        targets = [t.lower().replace("-", "_").replace(" ", "_") for t in targets]
    return df.filter(value.isin(targets))
