from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from check_queries import rows_of
from labelloom.llm import queries
from labelloom.session import materialize
from tests.llm.test_exact_and_mix import normal
from tests.llm.test_similar_texts import brute_links
from tests.llm.test_text_figures import figures


def test_stages_equal_brute_force(spark, awkward):
    rows, name = awkward, awkward.columns
    kept = [r for r in awkward.collect() if figures(r.text)[-1]]
    first: dict[str, tuple] = {}
    for r in kept:
        key = normal(r.text)
        if key not in first or (r.doc_id is None, r.doc_id) < (first[key].doc_id is None, first[key].doc_id):
            first[key] = r
    left = list(first.values())
    classes = brute_links([(r.doc_id, r.text) for r in left])
    alone = Counter((r.doc_id, r.text) for r, c in zip(left, classes, strict=True) if c[0] == c[1])
    for stage, expected in ((corpus_pipeline.quality, Counter((r.doc_id, r.text) for r in kept)), (corpus_pipeline.exact_dedup, None), (corpus_pipeline.near_dedup, alone)):
        rows = materialize(stage(spark, rows, ""), "test")
        assert rows.columns == name
        found = rows.collect()
        if expected is None:
            assert Counter((r.doc_id, normal(r.text)) for r in found) == Counter((r.doc_id, k) for k, r in first.items())
        else:
            assert Counter((r.doc_id, r.text) for r in found) == expected
    mixed = materialize(corpus_pipeline.mix(spark, rows, ""), "test")
    assert mixed.columns == name and max(Counter((r.doc_id, r.text) for r in mixed.collect()).values()) <= 3
    assert corpus_pipeline.encode(spark, mixed, "").count() == mixed.count()


def test_stages_on_an_empty_table(spark, nothing):
    rows = nothing
    for _, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, ""), "test")
        assert rows.count() == 0


def test_run(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert {"doc_id", "n_tokens", "ids"} <= set(found.columns)
    assert 0 < found.count() < 3 * spark.read.parquet(f"{small}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet')")
    result = con.execute(queries.CHECKS[name])
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    mine = queries.QUERIES[name](spark, small)
    assert rows_of(mine.columns, [tuple(r) for r in mine.collect()]) == theirs
