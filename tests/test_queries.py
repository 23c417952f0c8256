import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of

ALWAYS = [
    "annotation_scan", "coverage_by_label", "hybrid_join", "label_sync", "stratified_folds", "classification_metrics",
    "protocol_argmax", "failure_samples", "metric_profile", "actions", "runtime_summary", "knn_predict", "bayes_predict",
    "tree_scores", "logistic_scores", "debounce", "hog_features", "config_fingerprint", "dataset_report", "extraction_job", "run_outputs", "stream_fps",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("LABELLOOM_ALL_QUERIES") else ALWAYS


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    result = con.execute(entry.oracle_sql()[name])
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs


def test_entry(spark, small):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
