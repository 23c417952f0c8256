"""Queries that train and score models."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import approximate, bayes, classifiers, matrices, metrics, neighbours, scaling, splits, tuning
from labelloom.plans import jobs, stand_ins as given
from labelloom.plans.registry import big, query, r6
from labelloom.plans.sql_views import MATRIX, SCORES, rounded, split
from labelloom.plans.sql_views import metrics as metric_sql
from labelloom.session import materialize

_VECTORS = f"""vecs AS (
  SELECT vec_id::VARCHAR AS sample_id, label::VARCHAR AS gesture_label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
{split('vecs')},
tr AS (SELECT v.* FROM vecs v JOIN split s USING (sample_id) WHERE s.split = 'train'),
te AS (SELECT v.* FROM vecs v JOIN split s USING (sample_id) WHERE s.split = 'test')"""

_KNN = f"""{_VECTORS},
d AS (SELECT te.sample_id, te.gesture_label AS true_label, tr.gesture_label AS label,
        row_number() OVER (PARTITION BY te.sample_id ORDER BY list_distance(te.v, tr.v), tr.sample_id) AS r FROM te, tr),
ballot AS (SELECT sample_id, true_label, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY 1, 2, 3),
knn AS (SELECT sample_id, true_label, label AS predicted_label, n / 5.0 AS confidence FROM (
          SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, label) AS k FROM ballot) WHERE k = 1)"""


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = given.vectors(spark, sf_dir)
    table = splits.stratified_split(rows)
    return splits.rows_of_split(rows, table, "train"), splits.rows_of_split(rows, table, "test")


def knn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test vectors classified by their five nearest train vectors."""
    train, test = _train_test(spark, sf_dir)
    found = neighbours.knn_predict(
        test.select("sample_id", F.col("vector_inline").alias("vector")),
        train.select("sample_id", F.col("gesture_label").alias("label"), F.col("vector_inline").alias("vector")),
    )
    truth = test.select("sample_id", F.col("gesture_label").alias("true_label"))
    return truth.join(found, "sample_id")


@query("knn_predict", f"WITH {_KNN} SELECT sample_id, true_label, predicted_label, round(confidence, 6) AS confidence FROM knn")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_predictions(spark, sf_dir).select("sample_id", "true_label", "predicted_label", r6("confidence"))


@query("knn_holdout_metrics", f"""WITH {_KNN}, pc AS (SELECT 1 AS grp, true_label AS t, predicted_label AS y, count(*) AS n FROM knn GROUP BY 2, 3),
        {metric_sql('pc', 'true', 'NULL')} SELECT {rounded(*SCORES)}, n_samples FROM scores""")
def knn_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of nearest neighbours on the stratified hold-out (the flagship query)."""
    scores = metrics.classification_metrics(metrics.pair_counts(knn_predictions(spark, sf_dir)))
    return scores.select(*[r6(c) for c in SCORES], big("n_samples"))


@query("knn_approximate", f"""WITH {_KNN}, hits AS (SELECT sample_id, count(*) AS n FROM d WHERE r <= 5 GROUP BY 1)
        SELECT sample_id, true_label, n AS neighbours, true AS label_known, true AS recall_reached, true AS complete_ones_exact FROM knn JOIN hits USING (sample_id)""")
def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test vectors by their approximate neighbours, with what must hold for these.

    `recall_reached` tells whether the neighbours of all test vectors hold 0.9 of the exact
    ones, `complete_ones_exact` whether those marked complete are the exact ones.
    """
    train, test = _train_test(spark, sf_dir)
    q = test.select("sample_id", F.col("vector_inline").alias("vector"))
    t = train.select("sample_id", F.col("gesture_label").alias("label"), F.col("vector_inline").alias("vector"))
    q, t = materialize(q, "approximate-queries"), materialize(t, "approximate-rows")
    # small buckets, so that small tables have several
    buckets = approximate.fit_buckets(t, bucket_rows=64)
    found = materialize(approximate.nearest_approximate(q, t, buckets=buckets), "approximate-neighbours")
    exact = materialize(neighbours.nearest(q, t), "exact-neighbours")
    recall = approximate.recall_against(found, exact)
    wrong = found.where("complete").join(exact, ["sample_id", "neighbour_id"], "left_anti").isEmpty()
    facts = found.groupBy("sample_id").agg(F.count(F.lit(1)).alias("neighbours"))
    labels = [r[0] for r in t.select("label").distinct().collect()]
    voted = neighbours.vote(found).select("sample_id", F.col("predicted_label").isin(labels).alias("label_known"))
    truth = test.select("sample_id", F.col("gesture_label").alias("true_label"))
    return truth.join(facts, "sample_id").join(voted, "sample_id").select(
        "sample_id", "true_label", "neighbours", "label_known", F.lit(recall >= 0.9).alias("recall_reached"), F.lit(wrong).alias("complete_ones_exact")
    )


@query("scaler_stats", """SELECT i AS dim, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean,
        round(stddev_pop(embedding[i + 1]::DOUBLE), 6) AS scale FROM embeddings, range(64) t(i) GROUP BY 1""")
def scaler_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaling.scaler_stats(given.vectors(spark, sf_dir))
    return rows.select(big("dim"), r6("mean"), r6("scale"))


@query("scaled_vectors", """WITH s AS (SELECT i, avg(embedding[i + 1]::DOUBLE) AS m, stddev_pop(embedding[i + 1]::DOUBLE) AS sd
          FROM embeddings, range(64) t(i) GROUP BY 1)
        SELECT vec_id::VARCHAR AS sample_id, i AS pos, round((embedding[i + 1]::DOUBLE - m) / sd, 5) AS value FROM embeddings, s""")
def scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after the fitted scaler stages."""
    rows = given.vectors(spark, sf_dir).withColumn("features", array_to_vector("vector_inline"))
    model = scaling.fit_scaler(rows)
    out = model.transform(rows).select("sample_id", F.posexplode(vector_to_array("scaled")).alias("pos", "v"))
    return out.select("sample_id", big("pos"), F.round("v", 5).alias("value"))


_BAYES = f"""{_VECTORS},
par AS (SELECT gesture_label, i, avg(v[i + 1]) AS m, var_pop(v[i + 1]) + 1e-9 AS s FROM tr, range(64) t(i) GROUP BY 1, 2),
prior AS (SELECT gesture_label, ln(count(*)::DOUBLE / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY 1),
ll AS (SELECT te.sample_id, te.gesture_label AS true_label, p.gesture_label AS c,
         any_value(lp) - 0.5 * sum(ln(2 * pi() * s) + power(v[i + 1] - m, 2) / s) AS j
       FROM te, par p JOIN prior USING (gesture_label) GROUP BY 1, 2, 3),
nb AS (SELECT sample_id, true_label, c AS predicted_label, 1 / sum(exp(j - best)) OVER (PARTITION BY sample_id) AS confidence, r FROM (
         SELECT *, max(j) OVER (PARTITION BY sample_id) AS best, row_number() OVER (PARTITION BY sample_id ORDER BY j DESC, c) AS r FROM ll))"""


@query("bayes_parameters", """SELECT label::VARCHAR AS label, i AS dim, count(*) AS n, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean,
        round(var_pop(embedding[i + 1]::DOUBLE) + 0.01, 6) AS var FROM embeddings, range(64) t(i) GROUP BY 1, 2""")
def bayes_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bayes.fit_parameters(given.vectors(spark, sf_dir), var_smoothing=0.01)
    long = rows.select("label", "n", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "p"))
    return long.select("label", big("dim"), big("n"), r6(F.col("p.mean"), "mean"), r6(F.col("p.var"), "var"))


@query("bayes_predict", f"WITH {_BAYES} SELECT sample_id, true_label, predicted_label, round(confidence, 5) AS confidence FROM nb WHERE r = 1")
def bayes_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    model = bayes.fit(train)
    return model.transform(test).select(
        "sample_id", F.col("gesture_label").alias("true_label"), "predicted_label",
        F.round(F.array_max("probability"), 5).alias("confidence"),
    )


@query("label_encode", """SELECT event_id, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::BIGINT AS code, event_type AS decoded FROM events""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as positions in sorted order, and back."""
    events = given.table(spark, sf_dir, "events").select("event_id", "event_type")
    indexer = StringIndexer(inputCol="event_type", outputCol="code", stringOrderType="alphabetAsc").fit(events)
    decoder = IndexToString(inputCol="code", outputCol="decoded", labels=indexer.labels)
    return decoder.transform(indexer.transform(events)).select("event_id", "event_type", big("code"), "decoded")


# Labels that the vectors determine: which of four components is the largest.
_LEADERS = f"""leaders AS (SELECT vec_id::VARCHAR AS sample_id, list_transform([1, 17, 33, 49], lambda a: embedding[a]) AS q FROM embeddings),
vecs AS (SELECT sample_id, 'q' || list_position(q, list_max(q)) AS gesture_label FROM leaders),
{split('vecs')}"""


def _facts_sql() -> str:
    """What must hold for every scored test row."""
    return f"""WITH {_LEADERS} SELECT sample_id, gesture_label AS true_label, true AS label_known, true AS confidence_in_range, true AS accurate
               FROM split WHERE split = 'test'"""


def _facts(spark: SparkSession, sf_dir: str, algorithm: str, floor: float) -> DataFrame:
    """Test rows of a learnable task with what must hold for their predictions.

    `accurate` tells whether the share of right predictions reaches *floor* (chance: a quarter).
    """
    v = F.col("vector_inline")
    four = F.array(*[F.element_at(v, a) for a in (1, 17, 33, 49)])
    rows = given.vectors(spark, sf_dir).withColumn("_q", four).withColumn(
        "gesture_label", F.concat(F.lit("q"), F.array_position("_q", F.array_max("_q")).cast("string"))
    ).drop("_q")
    table = splits.stratified_split(rows)
    model = classifiers.train(splits.rows_of_split(rows, table, "train"), algorithm)
    scored = materialize(jobs.predict(model, splits.rows_of_split(rows, table, "test")), f"{algorithm}-scores")
    right = scored.agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double"))).first()[0]
    least = 1.0 / len(model.classes) - 1e-9
    return scored.select(
        "sample_id", "true_label", F.col("predicted_label").isin(model.classes).alias("label_known"),
        F.col("confidence").between(least, 1.0 + 1e-9).alias("confidence_in_range"), F.lit(bool(right is not None and right >= floor)).alias("accurate"),
    )


@query("tree_scores", _facts_sql())
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "decision_tree", 0.6)


@query("forest_scores", _facts_sql())
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "random_forest", 0.5)


@query("logistic_scores", _facts_sql())
def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "logistic_regression", 0.5)


@query("svm_scores", _facts_sql())
def svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "svm", 0.38)


@query("perceptron_scores", _facts_sql())
def perceptron_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, "mlp", 0.5)


# Both domains have all labels, so every protocol counts the same pairs.
_ROBUST = f"""WITH {MATRIX}, vecs AS (SELECT sample_id, gesture_label, vec AS v FROM geo_valid),
{split('vecs')},
tr AS (SELECT v.* FROM vecs v JOIN split s USING (sample_id) WHERE s.split = 'train'),
par AS (SELECT gesture_label, i, avg(v[i + 1]) AS m, var_pop(v[i + 1]) AS s FROM tr, range(64) t(i) GROUP BY 1, 2),
prior AS (SELECT gesture_label, ln(count(*)::DOUBLE / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY 1),
te AS (SELECT 'in_domain' AS domain, v.* FROM vecs v JOIN split s USING (sample_id) WHERE s.split = 'test'
  UNION ALL SELECT 'ood', sample_id, gesture_label, list_concat([-v[1]], v[2:]) FROM vecs),
ll AS (SELECT te.domain, te.sample_id, te.gesture_label AS t, p.gesture_label AS c, any_value(lp) - 0.5 * sum(ln(2 * pi() * s) + power(v[i + 1] - m, 2) / s) AS j
       FROM te, par p JOIN prior USING (gesture_label) GROUP BY 1, 2, 3, 4),
best AS (SELECT domain, t, c AS y FROM (SELECT *, row_number() OVER (PARTITION BY domain, sample_id ORDER BY j DESC, c) AS r FROM ll) WHERE r = 1),
pc AS (SELECT protocol || '|' || domain AS grp, t, y, count(*) AS n
  FROM best, (VALUES ('shared_subset'), ('masked_unknown'), ('masked_shared_argmax'), ('masked_shared_argmax_subset')) p(protocol)
  WHERE domain = 'ood' OR protocol IN ('shared_subset', 'masked_shared_argmax_subset') GROUP BY 1, 2, 3),
{metric_sql('pc', 'true', "((SELECT count(DISTINCT gesture_label) FROM vecs) + (grp LIKE 'masked_unknown%')::BIGINT)")}
SELECT split_part(grp, '|', 1) AS protocol, split_part(grp, '|', 2) AS domain, {rounded(*SCORES)}, n_samples,
  CASE WHEN grp LIKE 'masked_unknown%' THEN 0.0::DOUBLE END AS unknown_rate,
  (SELECT count(*) FROM geo) - (SELECT count(*) FROM geo_valid) AS left_out FROM scores"""


@query("robustness_run", _ROBUST)
def robustness_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train in one domain, score both, compare: protocols and their metrics, and the rows left out.

    The second domain is the same vectors mirrored in their first component.
    """
    matrix = given.matrix(spark, sf_dir)
    usable = matrices.exclude_invalid(matrix).filter("vector_inline is not null")
    table = splits.stratified_split(usable)
    model = classifiers.train(splits.rows_of_split(usable, table, "train"), "naive_bayes")
    shifted = matrix.withColumn(
        "vector_inline", F.transform("vector_inline", lambda x, i: F.when(i == 0, -x).otherwise(x))
    ).withColumn("dataset_name", F.lit("mirrored"))
    result = jobs.robustness_run(
        model, matrix, shifted, test_ids=table.filter("split = 'test'"), family="keypoints_only"
    )
    rows = result["protocols"].join(F.broadcast(result["left_out"]), "domain")  # two rows
    return rows.select("protocol", "domain", *[r6(c) for c in SCORES], big("n_samples"), r6("unknown_rate"), big("left_out"))


_SMOOTHINGS = (0.0001, 0.01, 1.0)
_TUNING = f"""WITH vecs AS (SELECT vec_id % 5 AS fold, vec_id, label::VARCHAR AS t, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
other AS (SELECT f.f AS fold, t, v FROM vecs, range(5) f(f) WHERE fold <> f.f),
par AS (SELECT fold, t AS c, i, avg(v[i + 1]) AS m, var_pop(v[i + 1]) AS s FROM other, range(64) d(i) GROUP BY 1, 2, 3),
prior AS (SELECT fold, t AS c, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY fold)) AS lp FROM other GROUP BY 1, 2),
ll AS (SELECT e.e, v.fold, vec_id, v.t, p.c, any_value(lp) - 0.5 * sum(ln(2 * pi() * (s + e.e)) + power(v[i + 1] - m, 2) / (s + e.e)) AS j
       FROM vecs v JOIN par p USING (fold) JOIN prior q ON q.fold = p.fold AND q.c = p.c, (VALUES (0.0001::DOUBLE), (0.01), (1.0)) e(e) GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT e, fold, t, c AS y FROM (SELECT *, row_number() OVER (PARTITION BY e, vec_id ORDER BY j DESC, c) AS r FROM ll) WHERE r = 1),
pc AS (SELECT e || '|' || fold AS grp, t, y, count(*) AS n FROM best GROUP BY 1, 2, 3),
{metric_sql('pc', 'true', 'NULL')}
SELECT split_part(grp, '|', 1)::DOUBLE AS var_smoothing, split_part(grp, '|', 2)::BIGINT AS fold, {rounded(*SCORES)}, n_samples FROM scores"""


@query("tuning_scores", _TUNING)
def tuning_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes with three smoothings over five folds, from one scan for all models."""
    rows = given.vectors(spark, sf_dir)
    folds = rows.select("sample_id", F.pmod(F.col("sample_id").cast("bigint"), F.lit(5)).alias("fold"))
    scores = tuning.tuning_scores(rows, folds, _SMOOTHINGS)
    return scores.select("var_smoothing", big("fold"), *[r6(c) for c in SCORES], big("n_samples"))
