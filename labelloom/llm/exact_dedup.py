"""Exact deduplication by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import SPACE, whole_text
from labelloom.session import materialize

PREFIX_CHARS = 64


def normalised(text_col: str = "text"):
    """Text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(whole_text(text_col), f"[{SPACE}]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the document that stays for it.

    Returns doc_id, keep_id, group_size, kept and text_sha256. Texts are compared after
    `normalised`. Rows are refined step by step: rows alone with their length are done;
    of the others, rows alone with their prefix hash are done; only the survivors are
    grouped by the digest of the whole text. Every step is a count with map-side
    combine and a join on its key, so a group may hold any share of the rows. The
    digest is a result of its own, hence taken in the one scan that also reads lengths
    and prefixes; what the refinement saves is moving it.

    The row with the smallest id stays (a null id only if all ids of a group are null;
    of rows with one id, one stays). Null and empty texts are equal. Extra columns are
    ignored; an empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("text"))
    rows = materialize(
        text.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.length("text").alias("chars"),
            F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"),
            F.sha2("text", 256).alias("text_sha256"),
        ),
        "exact-dedup-rows",
    )
    narrow = rows.select("chars", "prefix")
    lengths = narrow.groupBy("chars").agg(F.count("*").alias("n")).where("n > 1").select("chars")
    prefixes = (
        narrow.groupBy("chars", "prefix").agg(F.count("*").alias("n")).where("n > 1")
        .join(lengths, "chars", "left_semi").select("chars", "prefix")
    )
    survivors = rows.join(prefixes, ["chars", "prefix"], "left_semi")
    groups = (
        survivors.groupBy("chars", "prefix", "text_sha256")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
        .where("n > 1")
    )
    found = rows.join(groups, ["chars", "prefix", "text_sha256"], "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; see `exact_duplicates`.

    Rows that share an id and a text come out once.
    """
    verdict = (
        exact_duplicates(docs, id_col, text_col).where("kept")
        .select(F.xxhash64("doc_id").alias("__key"), F.col("text_sha256").alias("__sha"))
    )
    marked = docs.withColumns({"__key": F.xxhash64(id_col), "__sha": F.sha2(normalised(text_col), 256)})
    once = marked.join(verdict, ["__key", "__sha"], "left_semi").dropDuplicates(["__key", "__sha"])
    return once.select(*[f"`{c}`" for c in docs.columns])
