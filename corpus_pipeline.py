"""A corpus pipeline over the documents table: quality, copies, near copies, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm.bpe import bpe_encode
from labelloom.llm.common import documents
from labelloom.llm.exact_dedup import drop_exact_duplicates
from labelloom.llm.jaccard_join import drop_near_duplicates
from labelloom.llm.mixing import mixed_documents
from labelloom.llm.quality_rules import keep_good
from labelloom.llm.queries import vocabulary
from labelloom.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the one with the smallest id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar shingle sets the one with the smallest id stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents left out or repeated so that every source meets its target."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, with digests of ids and decoded text."""
    return bpe_encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: The near-duplicate stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written before the next reads them."""
    rows = documents(spark, sf_dir)
    for name, stage in STAGES:
        rows = stage(spark, rows, sf_dir)
        if (name, stage) != STAGES[-1]:
            rows = materialize(rows, "pipeline-" + name.replace(" ", "-"))
    return rows
