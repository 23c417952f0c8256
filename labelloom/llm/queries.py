"""Registered queries of the text operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.bpe import bpe_encode
from labelloom.llm.common import documents
from labelloom.llm.exact_dedup import exact_duplicates
from labelloom.llm.jaccard_join import near_duplicates
from labelloom.llm.language_id import identify, train
from labelloom.llm.lm_scoring import score_texts
from labelloom.llm.mixing import mix_sources, word_count
from labelloom.llm.piece_bpe import piece_encode
from labelloom.llm.prefix_trie import prefix_trie
from labelloom.llm.quality_rules import quality_rules
from labelloom.llm.suffix_dedup import repeated_spans
from labelloom.llm.token_files import read_token_files, token_folder, write_token_files
from labelloom.llm.toxicity import labelled_sample, score_toxicity
from labelloom.llm.whitening import whiten
from labelloom.session import materialize


def fold(parts: int) -> Column:
    """Part of a row by the checksum of its id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows if there is any."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


@query("op1_bpe_encode")
def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    return bpe_encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents."""
    return near_duplicates(documents(spark, sf_dir)).drop("k1", "k2")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 400 bytes that occur twice."""
    return repeated_spans(documents(spark, sf_dir)).drop("spans")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from three quarters of the labels."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    known = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels.where(fold(4) != 2))), "doc_id")  # at most SAMPLE_ROWS rows
    return score_toxicity(docs, known).select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


@query("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    sized = materialize(documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size")), "mix-input")
    return mix_sources(sized, size_col="size").select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict for all documents."""
    return quality_rules(documents(spark, sf_dir))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from four fifths of them."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold(5) != 0))
    return identify(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from four fifths of them."""
    scored = score_texts(documents(spark, sf_dir), fold(5) != 1, vocabulary("piece_bpe_32k.model"))
    return scored.withColumn("held_out", fold(5) == 1)


@query(
    "op9_exact_dedup",
    r"""SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1 AS kept, sha AS text_sha256
        FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
        WINDOW g AS (PARTITION BY sha)""",
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for each document."""
    return exact_duplicates(documents(spark, sf_dir))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored in token files, read back from them."""
    index = write_token_files(documents(spark, sf_dir), token_folder(spark), vocabulary("word_bpe_49k.json"))
    return read_token_files(index).select("doc_id", "start", "n_tokens", "ids_crc32")


@query(
    "op11_prefix_trie",
    r"""WITH turns AS (
            SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
                   len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'t': token, 'w': words} ORDER BY turn NULLS FIRST, token) AS turns FROM turns GROUP BY conv_id),
        sized AS (
            SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
                   xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                       lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h
            FROM own),
        rebuilt AS (
            SELECT s.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1 : s.h] END, s.turns[s.h + 1 :]) AS turns
            FROM sized s LEFT JOIN own b ON b.conv_id = s.base),
        beginnings AS (
            SELECT conv_id, depth, array_to_string(list_transform(turns[1 : depth], lambda x: x.t), '') AS name,
                   CASE WHEN depth = 0 THEN 0 ELSE turns[depth].w END AS words, depth = len(turns) AS ends
            FROM rebuilt, unnest(range(0, len(turns) + 1)) AS d(depth)),
        nodes AS (
            SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM beginnings GROUP BY depth, name),
        children AS (SELECT depth - 1 AS depth, left(name, 64 * (depth - 1)) AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
        facts AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, name)),
        totals AS (
            SELECT a.depth, left(name, 64 * a.depth) AS name, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
            FROM facts, unnest(range(0, facts.depth + 1)) AS a(depth) GROUP BY 1, 2)
        SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
               n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM facts f JOIN totals USING (depth, name)
        LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.name = left(f.name, 64 * (f.depth - 1))""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shared beginnings of the rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("name")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_piece_encode")
def op13_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts and digests of all documents."""
    return piece_encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), with_ids=False)
