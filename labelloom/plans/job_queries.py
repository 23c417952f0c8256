"""Queries that run whole jobs and read what they have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import splits
from labelloom.plans import jobs, stand_ins as given
from labelloom.plans.model_queries import _BAYES
from labelloom.plans.registry import big, query
from labelloom.plans.sql_views import LANDMARKS, MANIFEST, MATRIX
from labelloom.session import scratch_path
from labelloom.sources import tables


@query(
    "dataset_report",
    f"""WITH {MANIFEST}, ref AS (SELECT unnest(['de', 'en', 'es', 'fr', 'none']) AS l)
        SELECT 'total' AS report, '' AS key, count(*) AS n FROM manifest
        UNION ALL SELECT 'class', gesture_label, count(*) FROM manifest GROUP BY 2
        UNION ALL SELECT 'subject', subject_id, count(*) FROM manifest GROUP BY 2
        UNION ALL SELECT 'aligned', gesture_label, count(*) FROM manifest WHERE gesture_label IN (SELECT l FROM ref) GROUP BY 2
        UNION ALL SELECT 'missing_reference', l, 0 FROM ref WHERE l NOT IN (SELECT gesture_label FROM manifest)
        UNION ALL SELECT 'shared', gesture_label, 1 FROM manifest WHERE gesture_label IN (SELECT l FROM ref) GROUP BY 2
        UNION ALL SELECT 'right_only', l, 1 FROM ref WHERE l NOT IN (SELECT gesture_label FROM manifest)
        UNION ALL SELECT 'missing_files', '', count(*) FROM manifest WHERE n_chars >= 5000""",
)
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest written with its reports; images of long documents are missing from the listing."""
    docs = given.table(spark, sf_dir, "documents")
    listing = docs.where("n_chars < 5000").select(
        F.concat(F.lit("/data/"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))).alias("path")
    )
    reference = spark.createDataFrame([(c,) for c in given.CLASSES], "gesture_label string")
    path = scratch_path(spark, "dataset-report")
    jobs.write_manifest_reports(given.manifest(spark, sf_dir), {"label_vocabulary": given.CLASSES}, path, reference, listing)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    one = F.lit(1).cast("bigint").alias("n")
    parts = [
        read("dataset_summary", "section string, key string, n bigint").select(F.col("section").alias("report"), "key", "n"),
        read("label_coverage", "gesture_label string, n bigint, standing string").select(F.col("standing").alias("report"), F.col("gesture_label").alias("key"), "n"),
        read("label_overlap", "gesture_label string, occurrence string").select(F.col("occurrence").alias("report"), F.col("gesture_label").alias("key"), one),
        read("missing_files", "sample_id string").agg(F.count("*").alias("n")).select(F.lit("missing_files").alias("report"), F.lit("").alias("key"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "extraction_job",
    f"""WITH {LANDMARKS} SELECT gesture_label, count(*) AS stored, count(*) FILTER (seen) AS extracted,
        count(*) FILTER (NOT seen) AS failed, count(*) FILTER (seen AND confidence < 0.05) AS low FROM lm GROUP BY 1""",
)
def extraction_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix, sidecar and reports of an extraction that is run twice."""
    path = scratch_path(spark, "extraction-job")
    config = {"quality_flags": {"min_detection_confidence": 0.05}}
    samples = given.landmarks(spark, sf_dir)
    jobs.extraction_job(samples, "keypoints_raw", path, config)
    jobs.extraction_job(samples, "keypoints_raw", path, config)
    stored = tables.read_matrix(spark, f"{path}/matrix", family="keypoints_raw", version="v1", valid_only=False)
    return stored.groupBy("gesture_label").agg(
        F.count("*").alias("stored"), F.count_if("extraction_ok").alias("extracted"), F.count_if(~F.col("extraction_ok")).alias("failed"),
        F.count_if(F.col("confidence") < 0.05).alias("low"),
    )


@query(
    "hybrid_job",
    f"""WITH {MATRIX} SELECT g.sample_id, g.gesture_label, len(list_concat(g.vec, h.vec))::BIGINT AS dim, 'geometric+hog' AS sources
        FROM geo_valid g JOIN hog h USING (sample_id)""",
)
def hybrid_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid matrix as the job stores it."""
    path = scratch_path(spark, "hybrid-job")
    rows = jobs.hybrid_job(given.matrix(spark, sf_dir), given.matrix(spark, sf_dir, given.APPEARANCE), path)
    return rows.select("sample_id", "gesture_label", big(F.size("vector_inline"), "dim"), F.array_join("source_families", "+").alias("sources"))


_RUN = _BAYES.replace("s.split = 'test'", "s.split = 'val'")


@query(
    "run_outputs",
    f"""WITH {_RUN}, best AS (SELECT true_label, predicted_label FROM nb WHERE r = 1),
        names AS (SELECT DISTINCT gesture_label AS l FROM tr)
        SELECT a.l AS true_label, b.l AS predicted_label, count(best.true_label) AS n FROM names a CROSS JOIN names b
        LEFT JOIN best ON best.true_label = a.l AND best.predicted_label = b.l GROUP BY 1, 2
        UNION ALL SELECT 'accuracy', 'right', count(*) FILTER (true_label = predicted_label) FROM best
        UNION ALL SELECT 'predictions', 'rows', count(*) FROM best
        UNION ALL SELECT 'runs', 'with a metrics path', 1""",
)
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix, predictions, metrics and record of a run, read back from its files."""
    path = scratch_path(spark, "run-outputs")
    rows = given.vectors(spark, sf_dir).withColumn("feature_family", F.lit(given.GEOMETRIC))
    table = splits.stratified_split(rows)
    record, _, _ = jobs.run_experiment(rows, table, "naive_bayes", given.GEOMETRIC, output=path)
    place = record.first()["outputs"]
    square = tables.read_confusion_csv(spark, place["confusion_path"])
    names = square.columns[1:]
    cells = square.select("true_label", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`"))])).alias("predicted_label", "n"))
    scored = spark.read.csv(place["predictions_path"], header=True)
    accuracy = spark.read.schema("metric string, value double").json(place["metrics_path"]).where("metric = 'accuracy'")
    fact = lambda df, a, b, n: df.select(F.lit(a).alias("true_label"), F.lit(b).alias("predicted_label"), n.cast("bigint").alias("n"))
    count = scored.count()
    return (
        cells.unionByName(fact(accuracy, "accuracy", "right", F.round(F.col("value") * count)))
        .unionByName(fact(scored.agg(F.count("*").alias("c")), "predictions", "rows", F.col("c")))
        .unionByName(fact(tables.read_runs(spark, f"{path}/runs").where(F.col("outputs")["metrics_path"].isNotNull()).agg(F.count("*").alias("c")), "runs", "with a metrics path", F.col("c")))
    )
