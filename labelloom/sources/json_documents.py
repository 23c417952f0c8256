"""Records of large JSON documents, read in byte ranges by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.session import materialize

# One JSON string, and what may stand before an object of a list (commas, brackets,
# values that are no objects) or before an object of an object (comma, brace, key).
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BEFORE_ITEM = rf"(?s)^(?:[\s\uFEFF,\[\]]|{_STRING}|[^\s,\[\]{{}}\"])*+"
_BEFORE_MEMBER = rf"(?s)^[\s\uFEFF,{{]*+{_STRING}\s*+:\s*+"


def split_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The objects inside JSON documents, as text: (file, position, json).

    A document is a list of objects, an object whose members are all objects, or one
    object, which is its own only record. *position* counts the records of a document
    from 0. Values of a list that are no objects, empty documents and blank files give
    no rows; an object with any other member is one record. A document cut off in the
    middle gives the records up to there, the last one perhaps incomplete.

    No task needs a whole document. Spark's text source cuts files at closing braces,
    in byte ranges of `spark.sql.files.maxPartitionBytes`. Whether a piece starts inside
    a string is the parity of the quotes before it, and its depth is the sum of the
    brackets before it that are outside of strings; both are running sums inside a
    byte range, started from the totals of the ranges before (one row per range). A
    record ends where a brace leads back to depth 1, and only its own pieces are put
    together. Single objects are put together whole, as they are one record. Files
    that can't be split (compressed ones) are one range.
    """
    lines = spark.read.option("lineSep", "}").text(list(paths))
    pieces = materialize(
        lines.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("piece"),
        ),
        "json-pieces",
    )
    marked = _structure(pieces)
    return _records(marked)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _depth_change(parts: Column, inside_first: bool) -> Column:
    """Brackets opened minus closed in the parts outside of strings.

    *parts* is a piece cut at its quotes; every other part is outside.
    """
    outside = F.concat_ws("", F.filter(parts, lambda p, i: i % 2 == int(inside_first)))
    return _count(outside, "{[") - _count(outside, "]}")


def _structure(pieces: DataFrame) -> DataFrame:
    """Pieces with the depth before and after each, and the number of records before."""
    inside_block = Window.partitionBy("file", "block").orderBy("seq")
    before = inside_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda value, window: F.coalesce(F.sum(value).over(window), F.lit(0))

    # Escaped characters only stand in strings and never are the closing brace of a piece.
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    parts = F.split(plain, '"', -1)
    quotes = _count(plain, '"')
    scanned = pieces.select(
        "file", "block", "seq",
        F.pmod(quotes, F.lit(2)).alias("odd"),
        # The brace that ends the piece counts when the piece ends outside of a string.
        *[
            (_depth_change(parts, bool(s)) - F.when(F.pmod(quotes + s, F.lit(2)) == 0, 1).otherwise(0)).alias(f"change{s}")
            for s in (0, 1)
        ],
    ).withColumn("parity", F.pmod(so_far("odd", before), F.lit(2)))
    change = lambda start: F.when(F.pmod(F.col("parity") + start, F.lit(2)) == 0, F.col("change0")).otherwise(F.col("change1"))
    scanned = scanned.withColumns({"from0": change(F.lit(0)), "from1": change(F.lit(1))})

    # One row per byte range: what it does to parity and depth from either start.
    blocks = (
        scanned.groupBy("file", "block")
        .agg(F.sum("odd").alias("odd"), F.sum("from0").alias("from0"), F.sum("from1").alias("from1"))
        .withColumn("start", F.pmod(so_far("odd", blocks_before), F.lit(2)))
        .withColumn("change", F.when(F.col("start") == 0, F.col("from0")).otherwise(F.col("from1")))
        .select("file", "block", "start", so_far("change", blocks_before).alias("base"))
    )
    deep = (
        scanned.join(blocks, ["file", "block"])
        .withColumn("change", F.when(F.col("start") == 0, F.col("from0")).otherwise(F.col("from1")))
        .withColumn("ends_outside", F.pmod(F.col("start") + F.col("parity") + F.col("odd"), F.lit(2)) == 0)
        .withColumn("after", F.col("base") + F.sum("change").over(inside_block))
        # The brace at the end closes a record: one level down to depth 1.
        .withColumn("closes", (F.col("ends_outside") & (F.col("after") == 1)).cast("long"))
        .withColumn("closed", so_far("closes", before))
    )
    deep = materialize(deep.select("file", "block", "seq", "after", "closes", "closed"), "json-depths")
    earlier = (
        deep.groupBy("file", "block").agg(F.sum("closes").alias("n"))
        .select("file", "block", so_far("n", blocks_before).alias("records"))
    )
    numbered = deep.join(earlier, ["file", "block"]).select(
        "file", "block", "seq", "after", "closes", (F.col("records") + F.col("closed")).alias("position")
    )
    return pieces.join(numbered, ["file", "block", "seq"])


def _records(marked: DataFrame) -> DataFrame:
    """Records put together from their pieces, by the kind of their document."""
    in_order = F.array_sort(F.collect_list(F.struct("block", "seq", "piece")))
    texts = materialize(
        marked.groupBy("file", "position")
        .agg(in_order.alias("pieces"), F.max("closes").alias("whole"), F.max_by("after", F.struct("block", "seq")).alias("last"))
        .select(
            "file", "position", F.concat_ws("}", "pieces.piece").alias("text"),
            (F.col("whole") == 1).alias("whole"), (F.col("last") == 0).alias("at_end"),
        ),
        "json-records",
    )
    # The last text of a document is what stands behind its last record. Where the document
    # ends with the brace of its root object (at_end), no piece follows that brace.
    member = F.regexp_replace("text", _BEFORE_MEMBER, "").startswith("{")
    rest = ~F.col("whole") & (F.regexp_replace("text", r"[\s{}]", "") != "")
    first = F.min_by(F.substring(F.regexp_replace("text", r"^[\s\uFEFF]+", ""), 1, 1), "position")
    kinds = texts.groupBy("file").agg(
        first.alias("root"), (F.bool_or(rest) | F.bool_or(F.col("whole") & ~member)).alias("mixed")
    )
    kinds = kinds.withColumn("kind", F.when(F.col("root") == "[", "list").when(~F.col("mixed"), "members").otherwise("single"))
    typed = texts.join(kinds.select("file", "kind"), "file")
    item = F.when(F.col("kind") == "list", F.regexp_replace("text", _BEFORE_ITEM, "")).otherwise(
        F.regexp_replace("text", _BEFORE_MEMBER, "")
    )
    many = typed.filter("whole and kind != 'single'").select("file", "position", F.concat(item, F.lit("}")).alias("json"))
    single = (
        typed.filter("kind = 'single'").groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("texts"), F.max_by("at_end", "position").alias("at_end"))
        .select("file", F.lit(0).cast("long").alias("position"), F.concat(F.concat_ws("}", "texts.text"), F.when(F.col("at_end"), "}").otherwise("")).alias("json"))
    )
    return many.unionByName(single.filter(F.trim("json") != ""))
