"""Queries on predictions, domains and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import scoring
from labelloom.operators import domains, errors, leaderboards, matrices, metrics
from labelloom.plans import jobs, stand_ins as given
from labelloom.plans.registry import big, query, r6
from labelloom.plans.sql_views import MATRIX, PREDICTIONS, RUNS, SCORES, rounded
from labelloom.plans.sql_views import metrics as metric_sql
from labelloom.session import scratch_path
from labelloom.sources import tables

SHARED = ["de", "en", "es", "fr"]
OOD_ONLY = ["de_long", "en_long", "es_long", "fr_long"]
LABELS = sorted([*SHARED, *OOD_ONLY])
_SQL_SHARED = "('de', 'en', 'es', 'fr')"
_SQL_LABELS = "('de', 'en', 'es', 'fr', 'de_long', 'en_long', 'es_long', 'fr_long')"


def _rounded_scores(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[r6(c) for c in SCORES], big("n_samples"))


# --- predictions -------------------------------------------------------------


@query("predictions", f"""WITH {PREDICTIONS} SELECT sample_id, true_label, predicted_label, domain,
        true_label = predicted_label AS correct, {rounded('confidence')} FROM pred""")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.predictions(spark, sf_dir)
    return rows.select("sample_id", "true_label", "predicted_label", "domain", "correct", r6("confidence"))


@query("prediction_confidence", f"""WITH {PREDICTIONS} SELECT sample_id, {rounded('confidence')},
        CASE WHEN true_label LIKE '%_long' THEN round(confidence, 6)
             ELSE round(probability[list_position(['de', 'en', 'es', 'fr', 'none'], true_label)], 6) END AS true_confidence FROM pred""")
def prediction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the predicted and of the true class (the greatest if unknown)."""
    rows = given.predictions(spark, sf_dir)
    own = lambda c: scoring.prediction_confidence(F.col("probability"), F.col(c), given.CLASSES)
    return rows.select("sample_id", r6(own("predicted_label"), "confidence"), r6(own("true_label"), "true_confidence"))


@query("mask_unknown", f"""WITH {PREDICTIONS} SELECT sample_id,
        CASE WHEN predicted_label IN ('de', 'fr') THEN predicted_label ELSE 'unknown' END AS masked FROM pred""")
def mask_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = scoring.mask_unknown(F.col("predicted_label"), ["de", "fr"])
    return given.predictions(spark, sf_dir).select("sample_id", masked.alias("masked"))


_FORCED = "(['de', 'es', 'fr'])[list_position([probability[1], probability[3], probability[4]], greatest(probability[1], probability[3], probability[4]))]"


@query("restricted_argmax", f"WITH {PREDICTIONS} SELECT sample_id, {_FORCED} AS forced FROM pred")
def restricted_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = scoring.restricted_argmax(F.col("probability"), given.CLASSES, ["fr", "es", "de", "other"])
    return given.predictions(spark, sf_dir).select("sample_id", choice.alias("forced"))


@query("prediction_errors", f"""WITH {PREDICTIONS} SELECT sample_id, true_label, predicted_label FROM pred
        WHERE domain = 'ood' AND true_label <> predicted_label""")
def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the second domain, with and without the `correct` column."""
    rows = given.predictions(spark, sf_dir)
    bare = errors.errors_of(rows.drop("correct"), "ood").select("sample_id")
    return errors.errors_of(rows, "ood").join(bare, "sample_id", "left_semi").select(
        "sample_id", "true_label", "predicted_label"
    )


@query("true_label_subset", f"WITH {PREDICTIONS} SELECT domain, count(*) AS n FROM pred WHERE true_label IN {_SQL_SHARED} GROUP BY 1")
def true_label_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.predictions(spark, sf_dir).filter(F.col("true_label").isin(SHARED))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("prediction_metadata", f"""WITH {PREDICTIONS} SELECT p.sample_id, coalesce(l.image_path, '') AS image_path, l.subject_id,
          p.true_label = p.predicted_label AS correct, coalesce(l.source, 'none') AS context_source
        FROM pred p LEFT JOIN (SELECT doc_id::VARCHAR AS sample_id, '/img/' || doc_id AS image_path,
          'q' || quality AS subject_id, 't' || toxic AS source FROM labels) l USING (sample_id)""")
def prediction_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined with `labels` as their manifest, which lacks most samples."""
    text = lambda c: F.col(c).cast("string")
    manifest = given.table(spark, sf_dir, "labels").select(
        text("doc_id").alias("sample_id"), F.lit("labels").alias("dataset_name"),
        F.concat(F.lit("/img/"), text("doc_id")).alias("image_path"),
        F.concat(F.lit("q"), text("quality")).alias("subject_id"),
        F.create_map(F.lit("source"), F.concat(F.lit("t"), text("toxic"))).alias("capture_context"),
    )
    rows = given.predictions(spark, sf_dir).select("sample_id", "true_label", "predicted_label", "confidence")
    joined = errors.with_metadata(rows, manifest, "ood", "documents")
    source = F.coalesce(F.try_element_at("capture_context", F.lit("source")), F.lit("none"))
    return joined.select("sample_id", "image_path", "subject_id", "correct", source.alias("context_source"))


@query("all_predictions", f"""WITH {PREDICTIONS} SELECT sample_id, domain,
        CASE WHEN domain = 'ood' THEN context_source END AS note FROM pred""")
def all_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both domains put together, one of them with a column of its own."""
    rows = given.predictions(spark, sf_dir)
    ood = rows.filter("domain = 'ood'").select("sample_id", "domain", F.col("capture_context")["source"].alias("note"))
    return errors.all_predictions(rows.filter("domain = 'in_domain'").select("sample_id", "domain"), ood)


# --- metrics -----------------------------------------------------------------

_PAIRS = f"""{PREDICTIONS},
pc AS (SELECT domain AS grp, true_label AS t, predicted_label AS y, count(*) AS n FROM pred GROUP BY 1, 2, 3)"""


@query("confusion", f"""WITH {_PAIRS}, l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS label)
        SELECT a.label AS true_label, b.label AS predicted_label, coalesce(sum(n), 0)::BIGINT AS n
        FROM l a CROSS JOIN l b LEFT JOIN pc ON pc.t = a.label AND pc.y = b.label GROUP BY 1, 2""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(metrics.pair_counts(given.predictions(spark, sf_dir)), SHARED)


@query("confusion_csv", f"""WITH {_PAIRS} SELECT l.label AS true_label,
          {', '.join(f"coalesce(sum(n) FILTER (y = '{c}'), 0)::BIGINT AS {c}" for c in SHARED)}
        FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS label) l LEFT JOIN pc ON pc.t = l.label GROUP BY 1""")
def confusion_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square matrix, written as CSV and read back with its labels checked."""
    path = scratch_path(spark, "confusion")
    pairs = metrics.pair_counts(given.predictions(spark, sf_dir))
    tables.write_confusion_csv(metrics.confusion_matrix(pairs, SHARED), path)
    return tables.read_confusion_csv(spark, path)


@query("classification_metrics", f"""WITH {PREDICTIONS},
        pc AS (SELECT 1 AS grp, true_label AS t, predicted_label AS y, count(*) AS n FROM pred GROUP BY 2, 3),
        {metric_sql('pc', 'true', 'NULL')} SELECT {rounded(*SCORES)}, n_samples FROM scores""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = metrics.pair_counts(given.predictions(spark, sf_dir))
    return _rounded_scores(metrics.classification_metrics(pairs))


@query("metrics_of_labels", f"""WITH {_PAIRS}, {metric_sql('pc', "label IN ('de', 'en', 'xx')", '3')}
        SELECT grp AS domain, {rounded(*SCORES)}, n_samples FROM scores""")
def metrics_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per domain over a label list, one label of which nobody has."""
    pairs = metrics.pair_counts(given.predictions(spark, sf_dir), ["domain"])
    return _rounded_scores(metrics.classification_metrics(pairs, ["de", "en", "xx"], ["domain"]), "domain")


@query("metrics_long", f"""WITH {_PAIRS}, {metric_sql('pc', 'true', 'NULL')}
        SELECT grp AS domain, metric, round(value, 6) AS value FROM
          (SELECT grp, accuracy, f1_macro, n_samples::DOUBLE AS n_samples FROM scores)
        UNPIVOT (value FOR metric IN (accuracy, f1_macro, n_samples))""")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = metrics.pair_counts(given.predictions(spark, sf_dir), ["domain"])
    wide = metrics.classification_metrics(pairs, by=["domain"]).select("domain", "accuracy", "f1_macro", "n_samples")
    return metrics.metrics_long(wide, ["domain"]).withColumn("value", r6("value"))


# --- domains -----------------------------------------------------------------


@query("per_class_shift", f"""WITH {PREDICTIONS}, l AS (SELECT true_label AS g FROM pred UNION SELECT predicted_label FROM pred),
        acc AS (SELECT true_label AS g, avg((true_label = predicted_label)::INT) FILTER (domain = 'in_domain') AS a,
                       avg((true_label = predicted_label)::INT) FILTER (domain = 'ood') AS b FROM pred GROUP BY 1)
        SELECT l.g AS gesture_label, round(a, 6) AS in_domain_accuracy, round(b, 6) AS ood_accuracy, round(a - b, 6) AS absolute_drop
        FROM l LEFT JOIN acc USING (g)""")
def per_class_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domains.per_class_shift(given.predictions(spark, sf_dir))
    return rows.select("gesture_label", r6("in_domain_accuracy"), r6("ood_accuracy"), r6("absolute_drop"))


_DROP = f"""WITH {_PAIRS}, {metric_sql('pc', f'label IN {_SQL_LABELS}', '8')},
drops AS (SELECT a.accuracy AS ia, b.accuracy AS oa, a.f1_macro AS f, b.f1_macro AS g
          FROM scores a, scores b WHERE a.grp = 'in_domain' AND b.grp = 'ood')"""


@query("domain_drop", f"""{_DROP} SELECT round(ia, 6) AS in_domain_accuracy, round(oa, 6) AS ood_accuracy,
        round(f, 6) AS in_domain_f1_macro, round(g, 6) AS ood_f1_macro, round(ia - oa, 6) AS absolute_accuracy_drop,
        round(oa / ia, 6) AS relative_performance_retention, round(f - g, 6) AS absolute_f1_macro_drop,
        CASE WHEN oa / ia >= 0.85 AND ia - oa <= 0.10 THEN 'deploy_and_monitor' WHEN oa / ia >= 0.70 THEN 'deploy_with_caution'
             ELSE 'do_not_deploy' END AS recommendation FROM drops""")
def domain_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = metrics.pair_counts(given.predictions(spark, sf_dir), ["domain"])
    drop = domains.domain_drop(metrics.classification_metrics(pairs, LABELS, ["domain"]))
    rows = domains.with_recommendation(drop)
    return rows.select(*[r6(c) for c in drop.columns], "recommendation")


@query("recommendation", f"""WITH {PREDICTIONS}, s AS (SELECT subject_id,
          avg((true_label = predicted_label)::INT) FILTER (domain = 'in_domain') AS a,
          avg((true_label = predicted_label)::INT) FILTER (domain = 'ood') AS b FROM pred GROUP BY 1)
        SELECT subject_id, CASE WHEN subject_id = 'src0' THEN 'resolve_mismatch'
          WHEN a > 0 AND b >= 0.85 * a AND a - b <= 0.10 THEN 'deploy_and_monitor' WHEN a > 0 AND b >= 0.70 * a THEN 'deploy_with_caution'
          ELSE 'do_not_deploy' END AS recommendation FROM s""")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation per subject; one subject counts as incompatible."""
    hit = F.col("correct").cast("int")
    rows = given.predictions(spark, sf_dir).groupBy("subject_id").agg(
        F.avg(F.when(F.col("domain") == "in_domain", hit)).alias("a"),
        F.avg(F.when(F.col("domain") == "ood", hit)).alias("b"),
    )
    code = scoring.deployment_recommendation(F.when(F.col("a") > 0, F.col("b") / F.col("a")), F.col("a") - F.col("b"), F.col("subject_id") != "src0")
    return rows.select("subject_id", code.alias("recommendation"))


def _ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.predictions(spark, sf_dir).filter("domain = 'ood'")


@query("ood_per_class", f"""WITH {PREDICTIONS} SELECT l.g AS gesture_label, count(true_label) AS n_samples,
          count(*) FILTER (true_label = predicted_label) AS n_correct,
          round(avg((true_label = predicted_label)::INT), 6) AS accuracy
        FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS g) l LEFT JOIN pred ON domain = 'ood' AND true_label = l.g GROUP BY 1""")
def ood_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = domains.domain_report(_ood(spark, sf_dir), [*SHARED, "it"])["per_class"]
    return report.withColumn("accuracy", r6("accuracy"))


@query("ood_summary", f"""WITH {PREDICTIONS}, pc AS (SELECT domain AS grp, true_label AS t,
          CASE WHEN predicted_label IN ('de', 'fr') THEN predicted_label ELSE '_other_' END AS y, count(*) AS n
          FROM pred WHERE domain = 'ood' GROUP BY 1, 2, 3), {metric_sql('pc', "label IN ('de', 'fr', '_other_')", '3')},
        o AS (SELECT sum(n) FILTER (y = '_other_') AS k, sum(n) AS m FROM pc)
        SELECT {rounded(*SCORES)}, n_samples, k::BIGINT AS n_out_of_vocab_predictions,
               round(k::DOUBLE / m, 6) AS out_of_vocab_prediction_rate FROM scores, o""")
def ood_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domains.domain_report(_ood(spark, sf_dir), ["de", "fr"])["summary"]
    return _rounded_scores(
        rows.withColumn("out_of_vocab_prediction_rate", r6("out_of_vocab_prediction_rate")),
        big("n_out_of_vocab_predictions"), "out_of_vocab_prediction_rate",
    )


@query("ood_pairs", f"""WITH {PREDICTIONS} SELECT true_label,
          CASE WHEN predicted_label IN ('de', 'fr') THEN predicted_label ELSE '_other_' END AS predicted_label, count(*) AS n
        FROM pred WHERE domain = 'ood' GROUP BY 1, 2""")
def ood_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.domain_report(_ood(spark, sf_dir), ["de", "fr"])["pairs"].select("true_label", "predicted_label", big("n"))


def _protocols(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = domains.evaluation_protocols(
        given.predictions(spark, sf_dir), SHARED, OOD_ONLY, given.CLASSES, "probability"
    ).filter(F.col("protocol").startswith(name))
    return rows.select(
        "protocol", "domain", *[r6(c) for c in SCORES], big("n_samples"), big("n_excluded"), r6("unknown_rate")
    )


@query("protocol_shared", f"""WITH {_PAIRS}, sub AS (SELECT * FROM pc WHERE t IN {_SQL_SHARED}),
        {metric_sql('sub', f'label IN {_SQL_SHARED}', '4')}
        SELECT 'shared_subset' AS protocol, grp AS domain, {rounded(*SCORES)}, n_samples,
          CASE WHEN grp = 'ood' THEN (SELECT sum(n)::BIGINT FROM pc WHERE grp = 'ood' AND t NOT IN {_SQL_SHARED}) END AS n_excluded,
          NULL::DOUBLE AS unknown_rate FROM scores""")
def protocol_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protocols(spark, sf_dir, "shared_subset")


@query("protocol_unknown", f"""WITH {_PAIRS}, m AS (SELECT grp, t, CASE WHEN y IN {_SQL_LABELS} THEN y ELSE 'unknown' END AS y, sum(n) AS n
          FROM pc WHERE grp = 'ood' GROUP BY 1, 2, 3),
        {metric_sql('m', f"label IN {_SQL_LABELS} OR label = 'unknown'", '9')}
        SELECT 'masked_unknown' AS protocol, grp AS domain, {rounded(*SCORES)}, n_samples, NULL::BIGINT AS n_excluded,
          round((SELECT coalesce(sum(n) FILTER (y = 'unknown'), 0)::DOUBLE / sum(n) FROM m), 6) AS unknown_rate FROM scores""")
def protocol_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protocols(spark, sf_dir, "masked_unknown")


_FORCED_SHARED = "(['de', 'en', 'es', 'fr'])[list_position(probability[1:4], list_max(probability[1:4]))]"


@query("protocol_argmax", f"""WITH {PREDICTIONS}, f AS (SELECT domain, true_label AS t, {_FORCED_SHARED} AS y FROM pred WHERE domain = 'ood'),
        fp AS (SELECT 'masked_shared_argmax|ood' AS grp, t, y, count(*) AS n FROM f GROUP BY 2, 3
          UNION ALL SELECT 'masked_shared_argmax_subset|ood', t, y, count(*) FROM f WHERE t IN {_SQL_SHARED} GROUP BY 2, 3
          UNION ALL SELECT 'masked_shared_argmax_subset|in_domain', true_label, predicted_label, count(*) FROM pred
            WHERE domain = 'in_domain' AND true_label IN {_SQL_SHARED} GROUP BY 2, 3),
        {metric_sql('fp', f'label IN {_SQL_SHARED}', '4')}
        SELECT split_part(grp, '|', 1) AS protocol, split_part(grp, '|', 2) AS domain, {rounded(*SCORES)}, n_samples,
               NULL::BIGINT AS n_excluded, NULL::DOUBLE AS unknown_rate FROM scores""")
def protocol_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protocols(spark, sf_dir, "masked_shared_argmax")


@query("schema_compatibility", f"""WITH {MATRIX}
        SELECT false AS compatible, 'vector_dim mismatch: train=64 test=65; feature_family mismatch: train=geometric test=hog' AS issues,
          (SELECT count(DISTINCT gesture_label) FROM geo) AS n_shared, 0::BIGINT AS n_train_only, 1::BIGINT AS n_test_only,
          (SELECT count(DISTINCT gesture_label) FROM geo) + 1 AS n_outside_test""")
def schema_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric against appearance features, with one label more on that side."""
    train, test = given.matrix(spark, sf_dir), given.matrix(spark, sf_dir, given.APPEARANCE)
    rows = domains.schema_compatibility(
        matrices.sidecar(train), matrices.sidecar(test), domains.labels_of(train), [*domains.labels_of(test), "extra"]
    )
    return rows.select(
        "compatible", F.array_join("issues", "; ").alias("issues"), big("n_shared"),
        big(F.size("train_only"), "n_train_only"), big(F.size("test_only"), "n_test_only"),
        big(F.size("outside_reference_test"), "n_outside_test"),
    )


_PAIRS = f"""WITH {PREDICTIONS}, e AS (SELECT true_label, predicted_label, count(*) AS n FROM pred WHERE true_label <> predicted_label GROUP BY 1, 2)
        SELECT true_label, predicted_label, n, (sum(n) OVER ())::BIGINT AS total_errors, round(n / sum(n) OVER (), 6) AS share,
               round(n / sum(n) OVER (PARTITION BY true_label), 6) AS share_of_label FROM e"""


@query("misclassified_pairs", _PAIRS)
def misclassified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = errors.misclassified_pairs(given.predictions(spark, sf_dir))
    return rows.select("true_label", "predicted_label", "n", big("total_errors"), r6("share"), r6("share_of_label"))


@query("errors_by_context", f"""WITH {PREDICTIONS}, e AS (SELECT * FROM pred WHERE true_label <> predicted_label)
        SELECT 'total' AS dimension, NULL AS key, NULL AS other_key, count(*) AS n FROM e
        UNION ALL SELECT 'source', context_source, NULL, count(*) FROM e GROUP BY 2
        UNION ALL SELECT 'subject', subject_id, NULL, count(*) FROM e GROUP BY 2
        UNION ALL SELECT 'pair', true_label, predicted_label, count(*) FROM e GROUP BY 2, 3""")
def errors_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.errors_by_context(given.predictions(spark, sf_dir))


@query("failure_samples", f"""WITH {PREDICTIONS} SELECT true_label, sample_id, round(confidence, 6) AS confidence FROM (
          SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY confidence DESC, sample_id) AS r
          FROM pred WHERE domain = 'ood' AND true_label <> predicted_label) WHERE r <= 3""")
def failure_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = errors.failure_samples(given.predictions(spark, sf_dir), 3)
    return rows.select("true_label", "sample_id", r6("confidence"))


@query("domain_shift_report", f"""{_DROP}
        SELECT 'drop' AS part, 'absolute_accuracy_drop' AS key, round(ia - oa, 6) AS value FROM drops
        UNION ALL SELECT 'errors', true_label || '>' || predicted_label, count(*)::DOUBLE FROM pred
          WHERE domain = 'ood' AND true_label <> predicted_label GROUP BY 2
        UNION ALL SELECT 'ood_n', true_label, count(*)::DOUBLE FROM pred WHERE domain = 'ood' GROUP BY 2
        UNION ALL SELECT 'failures', true_label, least(3, count(*))::DOUBLE FROM pred
          WHERE domain = 'ood' AND true_label <> predicted_label GROUP BY 2""")
def domain_shift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the domain-shift report put in long form."""
    parts = jobs.robustness_tables(
        given.predictions(spark, sf_dir), train_labels=SHARED, ood_labels=LABELS, classes=LABELS
    )
    fact = lambda df, part, key, value: df.select(
        F.lit(part).alias("part"), key.alias("key"), value.cast("double").alias("value")
    )
    drop = fact(parts["drop"], "drop", F.lit("absolute_accuracy_drop"), r6("absolute_accuracy_drop"))
    pairs = fact(parts["misclassified"], "errors", F.concat_ws(">", "true_label", "predicted_label"), F.col("n"))
    classes = fact(parts["ood_per_class"].filter("n_samples > 0"), "ood_n", F.col("gesture_label"), F.col("n_samples"))
    failures = fact(
        parts["failures"].groupBy("true_label").agg(F.count(F.lit(1)).alias("n")), "failures", F.col("true_label"), F.col("n")
    )
    return drop.unionByName(pairs).unionByName(classes).unionByName(failures)


# --- run tables --------------------------------------------------------------


@query("leaderboard", f"WITH {RUNS} SELECT run_id, experiment_id, algorithm, feature_family, status, {rounded('accuracy', 'f1_macro')} FROM runs WHERE status = 'completed'")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed runs ranked by accuracy, metrics named by aliases."""
    config = {"report": ["acc", "f1", "confusion_matrix", "accuracy"]}
    board = leaderboards.leaderboard(leaderboards.completed_runs(given.runs(spark, sf_dir)), config)
    return board.withColumns({"accuracy": r6("accuracy"), "f1_macro": r6("f1_macro")})


@query("leaderboard_top", f"""WITH {RUNS} SELECT run_id, {rounded('accuracy')} FROM runs WHERE status = 'completed'
        ORDER BY runs.accuracy DESC, run_id LIMIT 15""")
def leaderboard_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = leaderboards.leaderboard(leaderboards.completed_runs(given.runs(spark, sf_dir)))
    return leaderboards.top_rows(board, "accuracy", 15, "run_id").select("run_id", r6("accuracy"))


@query("leaderboard_csv", f"WITH {RUNS} SELECT run_id, algorithm, {rounded('accuracy')} FROM runs WHERE status = 'completed' AND experiment_id = 'EXP-O'")
def leaderboard_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark report of one experiment as CSV, read back."""
    path = scratch_path(spark, "leaderboard")
    jobs.benchmark_report(given.runs(spark, sf_dir), "EXP-O", {"report": ["acc"]}, path)
    rows = spark.read.csv(path, header=True)
    return rows.select("run_id", "algorithm", r6(F.col("accuracy").cast("double"), "accuracy"))


@query("run_records", f"WITH {RUNS} SELECT run_id, experiment_id, {rounded('accuracy')} FROM runs WHERE status = 'completed'")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records appended to nested folders and loaded recursively."""
    path = scratch_path(spark, "runs")
    runs = given.runs(spark, sf_dir)
    for family in ("O", "F"):
        tables.append_runs(runs.filter(F.col("feature_family") == family), f"{path}/{family}")
    rows = tables.read_runs(spark, path)
    return rows.select("run_id", "experiment_id", r6(F.col("metrics")["accuracy"], "accuracy"))


@query("run_filter", f"WITH {RUNS} SELECT run_id FROM runs WHERE status = 'completed' AND experiment_id = 'EXP-F'")
def run_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboards.completed_runs(given.runs(spark, sf_dir), "EXP-F").select("run_id")


@query("metric_pivot", f"""WITH {RUNS} SELECT algorithm, round(avg(accuracy) FILTER (feature_family = 'F'), 6) AS F,
        round(avg(accuracy) FILTER (feature_family = 'O'), 6) AS O FROM runs GROUP BY 1""")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = given.runs(spark, sf_dir).withColumn("accuracy", F.col("metrics")["accuracy"])
    rows = leaderboards.metric_pivot(runs, "accuracy", names=["F", "O"])
    return rows.select("algorithm", r6("F"), r6("O"))


@query("metric_profile", f"""WITH {RUNS}, best AS (SELECT * FROM runs WHERE status = 'completed' ORDER BY accuracy DESC, run_id LIMIT 12),
        b AS (SELECT *, min(accuracy) OVER () AS a0, max(accuracy) OVER () AS a1, min(f1_macro) OVER () AS f0, max(f1_macro) OVER () AS f1,
                min(per_sample_inference_ms) OVER () AS p0, max(per_sample_inference_ms) OVER () AS p1 FROM best)
        SELECT run_id, algorithm || ' / ' || feature_family AS label,
          round(CASE WHEN a1 > a0 THEN (accuracy - a0) / (a1 - a0) ELSE 0.5 END, 6) AS accuracy,
          round(CASE WHEN f1 > f0 THEN (f1_macro - f0) / (f1 - f0) ELSE 0.5 END, 6) AS f1_macro,
          round(CASE WHEN p1 > p0 THEN 1 - (per_sample_inference_ms - p0) / (p1 - p0) ELSE 0.5 END, 6) AS per_sample_inference_ms FROM b""")
def metric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("accuracy", "f1_macro", "per_sample_inference_ms")
    board = leaderboards.leaderboard(leaderboards.completed_runs(given.runs(spark, sf_dir)), {"report": list(names)})
    rows = leaderboards.metric_profile(board, names)
    return rows.select("run_id", "label", *[r6(c) for c in names])


@query("suite_table", f"""WITH {RUNS} SELECT run_id, algorithm, feature_family, round(accuracy, 6) AS in_domain_accuracy,
        round(f1_macro, 6) AS ood_accuracy, round(accuracy - f1_macro, 6) AS absolute_accuracy_drop,
        CASE WHEN accuracy > 0 THEN round(f1_macro / accuracy, 6) END AS relative_performance_retention,
        '/runs/' || split_part(run_id, '-', 1) AS metrics_path FROM runs WHERE status = 'completed'""")
def suite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robustness suite table from runs whose two metrics stand for the two domains."""
    m = F.col("metrics")
    a, b = m["accuracy"], m["f1_macro"]
    keyed = F.create_map(
        F.lit("in_domain.accuracy"), a, F.lit("ood.accuracy"), b,
        F.lit("robustness.absolute_accuracy_drop"), a - b,
        F.lit("robustness.relative_performance_retention"), F.when(a > 0, b / a),
    )
    rows = leaderboards.suite_table(given.runs(spark, sf_dir).withColumn("metrics", keyed))
    numbers = ("in_domain_accuracy", "ood_accuracy", "absolute_accuracy_drop", "relative_performance_retention")
    return rows.select("run_id", "algorithm", "feature_family", *[r6(c) for c in numbers], "metrics_path")


@query("report_json", f"""WITH {PREDICTIONS} SELECT true_label, predicted_label, count(*) AS n FROM pred
        WHERE true_label <> predicted_label GROUP BY 1, 2""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report table written as JSON and read back."""
    path = scratch_path(spark, "report")
    tables.write_report(errors.misclassified_pairs(given.predictions(spark, sf_dir)), path)
    return spark.read.schema("true_label string, predicted_label string, n bigint").json(path)
