"""Whole jobs: manifests, splits, extraction, training, robustness, sessions."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schemas, vocab
from labelloom.functions.geometry import geometric_dim, raw_keypoints, to_pixels, with_geometric_vector
from labelloom.functions.names import algorithm_name, primary_metric
from labelloom.functions.pixels import HogSettings, with_hog
from labelloom.functions.quality import apply_quality_flags, is_filtered_family
from labelloom.functions.scoring import prediction_confidence
from labelloom.operators import classifiers, coverage, domains, errors, leaderboards, metrics, sessions, splits
from labelloom.operators.matrices import (
    extracted, hybrid_join, repaired_labels, rows_of_family, sidecar, sync_labels, valid,
)
from labelloom.operators.telemetry import runtime_summary
from labelloom.session import materialize
from labelloom.sources import tables, versions
from labelloom.sources.images import index_dataset

IN_DOMAIN, OOD = domains.IN_DOMAIN, domains.OOD


# --- data --------------------------------------------------------------------


def manifest_tables(manifest: DataFrame, config: Mapping[str, Any]) -> dict[str, DataFrame]:
    """Normalised manifest with label coverage and dataset summary."""
    reference = list(config.get("label_vocabulary") or [])
    rows = repaired_labels(
        manifest,
        label_aliases=config.get("label_aliases"),
        canonical_labels=reference,
        align_to_canonical=config.get("align_to") in ("canonical", vocab.TREE_DATASET),
    )
    return {
        "manifest": rows,
        "label_coverage": coverage.label_coverage(rows, reference),
        "dataset_summary": coverage.dataset_summary(rows),
    }


def dataset_report(
    manifest: DataFrame, reference: DataFrame | None = None, listing: DataFrame | None = None, vocabulary: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Summary, label coverage, share of aligned rows, label overlap with a second manifest and missing files.

    Tables whose input isn't given are left out.
    """
    covered = coverage.label_coverage(manifest, list(vocabulary))
    report = {
        "dataset_summary": coverage.dataset_summary(manifest),
        "label_coverage": covered,
        "aligned_ratio": coverage.aligned_ratio(covered),
    }
    if reference is not None:
        report["label_overlap"] = domains.label_overlap(manifest, reference)
    if listing is not None:
        report["missing_files"] = coverage.missing_files(manifest, listing)
    return report


def manifest_job(
    spark: SparkSession, config: Mapping[str, Any], output: str, reference: DataFrame | None = None, listing: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Index a dataset, normalise its labels, write manifest and reports below *output*."""
    result = manifest_tables(index_dataset(spark, config), config)
    return write_manifest_reports(result["manifest"], config, output, reference, listing)


def write_manifest_reports(
    manifest: DataFrame, config: Mapping[str, Any], output: str, reference: DataFrame | None = None, listing: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Write a manifest and the reports on what was written."""
    tables.write_manifest(manifest, f"{output}/manifest.parquet", mode="overwrite")
    written = tables.read_manifest(manifest.sparkSession, f"{output}/manifest.parquet")
    reports = dataset_report(written, reference, listing, config.get("label_vocabulary") or [])
    for name, report in reports.items():
        tables.write_report(report, f"{output}/{name}")
    return {"manifest": written, **reports}


def sync_labels_job(spark: SparkSession, matrix_path: str, manifest: DataFrame) -> int:
    """Bring the labels of a stored matrix up to its manifest; returns how many rows it knew.

    A table of versions gets a new version of all its parts in one commit.
    """
    if versions.commit_numbers(spark, matrix_path):
        stored = versions.read_version(spark, matrix_path, schemas.FEATURE_MATRIX)
        synced = materialize(sync_labels(stored, manifest), "synced-labels")
        versions.commit_parts(synced.drop("updated"), matrix_path)
        return synced.where("updated").count()
    synced = materialize(sync_labels(tables.read_matrix(spark, matrix_path, valid_only=False), manifest), "synced-labels")
    tables.replace_table(synced.drop("updated"), matrix_path)
    return synced.where("updated").count()


def split_job(
    manifest: DataFrame, output: str, seed: int = 42, strategy: Mapping[str, Any] | None = None, n_folds: int = 5
) -> dict[str, DataFrame]:
    """Write split and fold tables; return them with the class distribution."""
    spark = manifest.sparkSession
    tables.write_splits(splits.stratified_split(manifest, seed, strategy), f"{output}/splits")
    table = spark.read.parquet(f"{output}/splits")
    tables.write_folds(splits.stratified_folds(manifest, n_folds, seed, table), f"{output}/folds")
    return {
        "splits": table,
        "folds": spark.read.parquet(f"{output}/folds"),
        "distribution": splits.split_distribution(manifest, table),
    }


def extract_features(
    samples: DataFrame,
    family: str,
    *,
    min_confidence: float = 0.5,
    include_angles: bool = True,
    hog: HogSettings = HogSettings(),
    version: str = "v1",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Feature records of one family from samples with landmarks (and pixels), behind the columns *keep*.

    Samples have `landmarks` in fractions of the image (null: no detection),
    `width`, `height`, `confidence`; the appearance family also needs `data` and
    `nChannels`. A null height marks an unreadable image.
    """
    detected, readable = F.col("landmarks").isNotNull(), F.col("height").isNotNull()
    options = {"detected": detected, "readable": readable, "min_confidence": min_confidence, "version": version, "keep": keep}
    if family == "keypoints_raw":
        return extracted(samples, family, raw_keypoints(F.col("landmarks")), vocab.RAW_DIM, **options)
    pixels = samples.withColumn("landmarks", to_pixels(F.col("landmarks"), F.col("width"), F.col("height")))
    if family == "geometric":
        rows = with_geometric_vector(pixels, output="_vector", include_angles=include_angles)
        return extracted(rows, family, F.col("_vector"), geometric_dim(include_angles), **options)
    if family == vocab.HYBRID_FAMILY:
        # Both blocks come from the same detection of the same row.
        rows = with_geometric_vector(pixels, output="_keypoints", include_angles=include_angles)
        described = with_hog(rows.filter(readable), hog, "_appearance").unionByName(rows.filter(~readable), allowMissingColumns=True)
        dim = geometric_dim(include_angles) + hog.dim()
        vector = F.concat("_keypoints", "_appearance")
        return extracted(described, family, vector, dim, **options).withColumn("source_families", F.array(F.lit("geometric"), F.lit("hog")))
    if family == "hog":
        # Unreadable images never reach the pixel stage.
        described = with_hog(pixels.filter(readable), hog, "_vector")
        rows = described.unionByName(pixels.filter(~readable), allowMissingColumns=True)
        return extracted(rows, family, F.col("_vector"), hog.dim(), **options)
    raise ValueError(f"unsupported feature family '{family}'")


def quality_tables(
    matrix: DataFrame,
    *,
    min_confidence: float = 0.5,
    min_samples: int | None = None,
    min_success_rate: float | None = None,
) -> dict[str, DataFrame]:
    """Coverage, flag counts, violations and low-confidence ids of a matrix."""
    partial = coverage.partial_coverage(matrix)
    return {
        "overall": coverage.overall_coverage(partial),
        "by_label": coverage.coverage_by_label(partial),
        "flags": coverage.flag_counts(matrix),
        "violations": coverage.coverage_violations(partial, min_samples, min_success_rate),
        "low_confidence": coverage.low_confidence_ids(matrix, min_confidence),
    }


def extraction_job(
    samples: DataFrame, family: str, output: str, config: Mapping[str, Any] | None = None
) -> dict[str, DataFrame]:
    """Extract one family, write matrix, sidecar and quality reports.

    What the table holds of the same dataset, family and version is replaced, so a run
    can be repeated; reports lie below quality/family/version.
    """
    spark, config = samples.sparkSession, dict(config or {})
    quality = config.get("quality_flags") or {}
    threshold = float(quality.get("min_detection_confidence", 0.5))
    version = str(config.get("feature_version", "v1"))
    rows = extract_features(samples, family, min_confidence=threshold, version=version)
    flagged = rows.withColumn(
        "quality_flags", apply_quality_flags(F.col("quality_flags"), F.col("confidence"), threshold)
    )
    written = store_matrix(flagged, output, family, version, config)
    reports = quality_tables(
        written,
        min_confidence=threshold,
        min_samples=quality.get("min_samples_per_class"),
        min_success_rate=quality.get("min_class_success_rate"),
    )
    for name, report in reports.items():
        tables.write_report(report, f"{output}/quality/{family}/{version}/{name}")
    return {"matrix": written, **reports}


def store_matrix(rows: DataFrame, output: str, family: str, version: str, config: Mapping[str, Any]) -> DataFrame:
    """Write matrix and sidecar of one family and version; returns the rows of the datasets just written."""
    spark = rows.sparkSession
    rows = materialize(rows, "extracted")
    tables.replace_parts(rows, f"{output}/matrix")
    stored = tables.read_matrix(spark, f"{output}/matrix", family=family, version=version, valid_only=False)
    written = stored.join(rows.select("dataset_name").distinct(), "dataset_name", "left_semi").select(*stored.columns)
    tables.write_sidecar(written, f"{output}/sidecars", config)
    return written


def hybrid_job(keypoints: DataFrame, appearance: DataFrame, output: str, config: Mapping[str, Any] | None = None, version: str = "v1") -> DataFrame:
    """Join two matrices after their guards, write the hybrid matrix and its sidecar."""
    return store_matrix(hybrid_join(keypoints, appearance, version), output, vocab.HYBRID_FAMILY, version, dict(config or {}))


# --- training ----------------------------------------------------------------


def run_experiment(
    matrix: DataFrame,
    split_table: DataFrame,
    algorithm: str,
    family: str,
    *,
    experiment_id: str = "EXP-01",
    config: Mapping[str, Any] | None = None,
    hyperparameters: Mapping[str, Any] | None = None,
    models: str | None = None,
    output: str | None = None,
    dry_run: bool = False,
) -> tuple[DataFrame, DataFrame | None, classifiers.Trained | None]:
    """Train on the train rows, score the val rows: (run record, predictions, model).

    With *output*, predictions, confusion matrix and metrics are written below it and
    the run record, which names them, is added to its `runs`.
    """
    spark, name = matrix.sparkSession, algorithm_name(algorithm)
    config = dict(config or {})
    run = {"algorithm": name, "feature_family": family}
    if dry_run:
        return tables.new_run(spark, experiment_id, config, status="dry_run", **run), None, None
    rows = rows_of_family(matrix, family)
    train = splits.rows_of_split(rows, split_table, "train")
    val = splits.rows_of_split(rows, split_table, "val")

    begun = time.perf_counter()
    model = classifiers.train(train, name, hyperparameters)
    fitted = time.perf_counter()
    scored = materialize(predict(model, val), "val-predictions")
    scored_at = time.perf_counter()

    summary = metrics.classification_metrics(metrics.pair_counts(scored)).first().asDict()
    n = max(int(summary.pop("n_samples")), 1)
    summary["fit_seconds"] = fitted - begun
    summary["inference_seconds"] = scored_at - fitted
    summary["per_sample_inference_ms"] = (scored_at - fitted) * 1000.0 / n
    artifacts = {}
    if models:
        path = classifiers.model_path(models, experiment_id, name, family)
        model.save(spark, path, {"experiment_id": experiment_id, "feature_family": family, "metrics": summary})
        artifacts["model_path"] = path
    outputs = {}
    if output:
        place = f"{output}/{experiment_id}_{name}_{family}"
        outputs = {"metrics_path": f"{place}/metrics", "predictions_path": f"{place}/predictions", "confusion_path": f"{place}/confusion"}
        tables.write_predictions_csv(scored, outputs["predictions_path"])
        square = metrics.confusion_matrix(metrics.pair_counts(scored), model.classes)
        tables.write_confusion_csv(square, outputs["confusion_path"])
        numbers = spark.createDataFrame([(k, float(v)) for k, v in summary.items() if v is not None], "metric string, value double")
        tables.write_report(numbers, outputs["metrics_path"])
    record = tables.new_run(
        spark, experiment_id, config, status="completed", metrics=summary, artifacts=artifacts, outputs=outputs, **run
    )
    if output:
        tables.append_runs(record, f"{output}/runs")
    return record, scored, model


def tune(
    matrix: DataFrame, folds: DataFrame, algorithm: str, space: Mapping[str, Sequence[Any]] | None = None, metric: str = "f1_macro"
) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """Try the candidates of an algorithm over all folds: the best parameters, and the scores of each.

    Every candidate is trained on the rows outside a fold and scored on those in it;
    its score is the mean over the folds. Of equals the first is best.
    """
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    tried = []
    for params in leaderboards.candidates(algorithm, space):
        scores = []
        for fold in numbers:
            roles = splits.fold_members(folds, fold).withColumnRenamed("role", "split")
            model = classifiers.train(splits.rows_of_split(matrix, roles, "train"), algorithm, params)
            scored = predict(model, splits.rows_of_split(matrix, roles, "val"))
            scores.append(metrics.classification_metrics(metrics.pair_counts(scored)).first()[metric])
        tried.append({"hyperparameters": params, "scores": scores, "mean": sum(scores) / max(len(scores), 1)})
    best = max(tried, key=lambda t: t["mean"])
    return best["hyperparameters"], tried


def predict(model: classifiers.Trained, rows: DataFrame, with_probability: bool = True) -> DataFrame:
    """Predictions of labelled rows: ids, both labels, confidence (and probabilities)."""
    kept = rows.select("sample_id", F.col("gesture_label").cast("string").alias("true_label"), "vector_inline")
    scored = model.transform(kept).withColumn(
        "confidence", prediction_confidence(F.col("probability"), F.col("predicted_label"), model.classes)
    )
    columns = ["sample_id", "true_label", "predicted_label", "confidence"]
    return scored.select(*columns, *(["probability"] if with_probability else []))


def benchmark_suite(
    matrix: DataFrame,
    split_table: DataFrame,
    algorithms: Sequence[str],
    families: Sequence[str],
    *,
    experiment_id: str = "EXP-02",
    config: Mapping[str, Any] | None = None,
    models: str | None = None,
) -> DataFrame:
    """Run all (algorithm, family) pairs; each family's rows are kept in memory over its runs."""
    records = None
    for family in families:
        rows = rows_of_family(matrix, family).persist()
        for algorithm, _ in leaderboards.suite_specs(algorithms, [family]):
            record, _, _ = run_experiment(
                rows, split_table, algorithm, family, experiment_id=experiment_id, config=config, models=models
            )
            records = record if records is None else records.unionByName(record)
        rows.unpersist()
    return records


def benchmark_report(runs: DataFrame, experiment_id: str | None, config: Mapping[str, Any] | None, output: str | None = None) -> DataFrame:
    """Leaderboard of completed runs, optionally written as CSV."""
    board = leaderboards.leaderboard(leaderboards.completed_runs(runs, experiment_id), config)
    if output:
        tables.write_report(board, output, "csv")
    return board


def best_run(runs: DataFrame, config: Mapping[str, Any] | None = None) -> DataFrame:
    """The completed run with the best primary metric."""
    key = F.lit(primary_metric(config))
    ranked = leaderboards.completed_runs(runs).withColumn("_m", F.try_element_at("metrics", key))
    return ranked.orderBy(F.col("_m").desc_nulls_last(), "run_id").limit(1).drop("_m")


# --- robustness --------------------------------------------------------------


def robustness_tables(
    predictions: DataFrame,
    *,
    train_labels: Sequence[str],
    ood_labels: Sequence[str],
    classes: Sequence[str] | None = None,
    probabilities: str | None = None,
    compatible: bool = True,
) -> dict[str, DataFrame]:
    """All comparison tables of two scored domains (column `domain`)."""
    shared = sorted(set(train_labels) & set(ood_labels))
    ood_only = sorted(set(ood_labels) - set(train_labels))
    pairs = metrics.pair_counts(predictions, ["domain"])
    by_domain = metrics.classification_metrics(pairs, classes, ["domain"])
    drop = domains.domain_drop(by_domain)
    ood = predictions.filter(F.col("domain") == OOD)
    protocols = domains.evaluation_protocols(predictions, shared, ood_only, classes, probabilities)
    available, reason = domains.protocol_availability(shared, classes, probabilities is not None)
    availability = predictions.sparkSession.createDataFrame(
        [("masked_shared_argmax", available, reason)], "protocol string, available boolean, reason string"
    )
    report = domains.domain_report(ood, sorted(set(shared) | set(ood_only)))
    return {
        "metrics": by_domain,
        "drop": domains.with_recommendation(drop, compatible),
        "per_class_shift": domains.per_class_shift(predictions, classes),
        "protocols": protocols,
        "protocol_drop": domains.protocol_drops(protocols),
        "protocol_availability": availability,
        "ood_per_class": report["per_class"],
        "ood_pairs": report["pairs"],
        "ood_summary": report["summary"],
        "misclassified": errors.misclassified_pairs(ood),
        "errors_by_context": errors.errors_by_context(ood),
        "failures": errors.failure_samples(predictions),
    }


def usable(matrix: DataFrame) -> Column:
    """Rows with a vector that `exclude_invalid` keeps; a matrix without quality columns has no failed rows."""
    there = F.col("vector_inline").isNotNull()
    if not {"extraction_ok", "quality_flags", "feature_family"} <= set(matrix.columns):
        return there
    return there & F.coalesce(~is_filtered_family(F.col("feature_family")) | valid(matrix), F.lit(False))


def left_out_rows(matrix: DataFrame, domain: str) -> DataFrame:
    """Rows of a domain that are scored and rows left out as failed or without a vector: domain, kept, left_out."""
    kept = F.count_if(usable(matrix))
    return matrix.agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("left_out")).select(F.lit(domain).alias("domain"), "kept", "left_out")


def robustness_run(
    model: classifiers.Trained,
    in_domain: DataFrame,
    ood: DataFrame,
    *,
    test_ids: DataFrame | None = None,
    in_domain_manifest: DataFrame | None = None,
    ood_manifest: DataFrame | None = None,
    names: tuple[str, str] = (vocab.ANNOTATED_DATASET, vocab.TREE_DATASET),
    experiment_id: str = "EXP-03",
    config: Mapping[str, Any] | None = None,
    family: str = "hybrid",
    output: str | None = None,
) -> dict[str, DataFrame]:
    """Score both domains with one model and compare them.

    Rows of failed extractions or without a vector are left out and counted per domain in
    `left_out`. The in-domain test rows are scored; if none match, all in-domain rows are.
    The run record also has the seconds of scoring, all and per row. With *output*, all
    tables and the run record are written below it.
    """
    spark = in_domain.sparkSession
    left_out = left_out_rows(in_domain, IN_DOMAIN).unionByName(left_out_rows(ood, OOD))
    in_domain, ood = in_domain.filter(usable(in_domain)), ood.filter(usable(ood))
    train_labels, ood_labels = domains.labels_of(in_domain), domains.labels_of(ood)
    schema = domains.schema_compatibility(sidecar(in_domain), sidecar(ood), train_labels, ood_labels)
    compatible = bool(schema.select("compatible").first()[0])
    test = in_domain if test_ids is None else in_domain.join(test_ids.select("sample_id"), "sample_id", "left_semi")
    if test_ids is not None and test.select("sample_id").isEmpty():
        test = in_domain

    def scored(rows: DataFrame, manifest: DataFrame | None, domain: str, name: str) -> DataFrame:
        predicted = predict(model, rows)
        if manifest is None:
            return errors.with_metadata_defaults(predicted, domain, name)
        return errors.with_metadata(predicted, manifest, domain, name)

    begun = time.perf_counter()
    predictions = materialize(
        errors.all_predictions(
            scored(test, in_domain_manifest, IN_DOMAIN, names[0]), scored(ood, ood_manifest, OOD, names[1])
        ),
        "domain-predictions",
    )
    seconds = time.perf_counter() - begun
    result = robustness_tables(
        predictions,
        train_labels=train_labels,
        ood_labels=ood_labels,
        classes=model.classes,
        probabilities="probability",
        compatible=compatible,
    )
    drop = result["drop"].first().asDict()
    numbers = {
        "in_domain.accuracy": drop["in_domain_accuracy"],
        "ood.accuracy": drop["ood_accuracy"],
        "robustness.absolute_accuracy_drop": drop["absolute_accuracy_drop"],
        "robustness.relative_performance_retention": drop["relative_performance_retention"],
    }
    n_scored = predictions.count()
    numbers["inference_seconds"] = seconds
    numbers["per_sample_inference_ms"] = seconds * 1000.0 / max(n_scored, 1)
    numbers["n_scored"] = float(n_scored)
    shared = result["protocols"].filter("protocol = 'shared_subset' and domain = 'ood'").first()
    if shared:
        numbers["shared_subset.ood.accuracy"] = shared["accuracy"]
    record = tables.new_run(
        spark, experiment_id, dict(config or {}), status="completed",
        algorithm=model.algorithm, feature_family=family, metrics=numbers,
        outputs={"metrics_path": f"{output}/metrics"} if output else {},
    )
    result = {"predictions": predictions, "schema": schema, "left_out": left_out, **result}
    if output:
        tables.write_predictions_csv(predictions, f"{output}/predictions")
        for name, table in result.items():
            if name != "predictions":
                tables.write_report(table, f"{output}/{name}")
        tables.append_runs(record, f"{output}/runs")
    return {"run": record, **result}


def robustness_suite(
    models: Mapping[tuple[str, str], classifiers.Trained | None], in_domain: DataFrame, ood: DataFrame, **options: Any
) -> DataFrame:
    """Suite table over (algorithm, family) models; missing models are skipped."""
    records = None
    for (_, family), model in models.items():
        if model is None:
            continue
        run = robustness_run(
            model, rows_of_family(in_domain, family), rows_of_family(ood, family), family=family, **options
        )["run"]
        records = run if records is None else records.unionByName(run)
    if records is None:
        raise ValueError("no model of the suite is available")
    return leaderboards.suite_table(records)


# --- sessions ----------------------------------------------------------------


def session_tables(
    frames: DataFrame,
    *,
    vote: Mapping[str, Any] | None = None,
    debounce_ms: float = 300.0,
    keymap: Mapping[str, str] | None = None,
    aliases: Mapping[str, str] | None = None,
    dry_run: bool = True,
    enable_dispatch: bool = False,
) -> dict[str, DataFrame]:
    """Votes, actions and label changes of stored sessions."""
    voted = sessions.rolling_vote(frames, chunk_us=None, **dict(vote or {}))
    acted = sessions.actions(
        voted,
        dict(vocab.DEFAULT_KEYMAP if keymap is None else keymap),
        dict(vocab.RUNTIME_LABEL_ALIASES if aliases is None else aliases),
        debounce_ms=debounce_ms,
        dry_run=dry_run,
        enable_dispatch=enable_dispatch,
        chunk_us=None,
    )
    return {"votes": voted, "actions": acted, "changes": sessions.label_changes(voted)}


def session_run_record(summary: DataFrame, experiment_id: str = "EXP-04", config: Mapping[str, Any] | None = None) -> DataFrame:
    """Run records of live sessions from their summaries, one per session."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    pairs = {
        "primary": F.col("end_to_end_avg"),
        "fps": F.col("avg_fps"),
        "end_to_end_p95_ms": F.col("end_to_end_p95"),
        "frames_processed": F.col("frame_count").cast("double"),
        "actions_emitted": F.col("actions_emitted").cast("double"),
        "actions_suppressed": F.col("actions_suppressed").cast("double"),
        "detections_ok": F.col("detections_ok").cast("double"),
    }
    return summary.select(
        F.sha2(F.concat_ws(":", F.lit(experiment_id), "session_id"), 256).alias("run_id"),
        F.lit(experiment_id).alias("experiment_id"),
        F.lit("completed").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(tables.config_fingerprint(config or {})).alias("config_fingerprint"),
        F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("metrics"),
    )


def telemetry_tables(samples: DataFrame) -> dict[str, DataFrame]:
    """Frame intervals and the session summaries built on them."""
    intervals = sessions.frame_intervals(samples, sessions.fit_chunk(samples))
    return {"intervals": intervals, "summary": runtime_summary(intervals)}
