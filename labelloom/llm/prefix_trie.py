"""Trie of the shared beginnings of conversations, built by halving its depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import SPACE
from labelloom.session import materialize

#: Conversation ids of a range of this size are joined to one string before they are hashed.
IDS = 1024


def turn_token() -> Column:
    """Digest of a turn: equal for equal role and text, null read as empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def words_in(text: Column) -> Column:
    """Number of words of a text, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"), F.lit(0).cast("long"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, token, words) with their place in the conversation from 1, null turns first.

    Equal turn numbers are ordered by digest. The table is sorted by ranges, so that one
    endless conversation is spread over tasks; counts of the ranges give the places.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("token"), F.col("line")]
    lined = turns.withColumn("line", F.monotonically_increasing_id())
    ordered = lined.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select("conv_id", "token", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    ordered = materialize(ordered, "trie-turns")
    # a conversation has a row for each range that it crosses
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ordered.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = before.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    placed = ordered.join(before, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("depth"), "token", "words")


def rebuilt_conversations(numbered: DataFrame, group: int = 20, most_shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, token, words) and lengths (conv_id, length) of the rebuilt conversations.

    Conversation c takes the first h turns of conversation c - c % *group*, with h the crc32
    of its decimal id modulo *most_shared*, then its own turns after its first h.
    """
    lengths = materialize(numbered.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-lengths")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("long")
    plan = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_length")), "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("base_length", F.lit(0).cast("long"))))
    plan = materialize(plan.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))), "trie-plan")
    wanted = plan.where("head > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), "head")).alias("depth"))
    firsts = numbered.where(F.col("depth") < most_shared).withColumnRenamed("conv_id", "base")
    heads = wanted.join(firsts, ["base", "depth"]).select("conv_id", "depth", "token", "words")
    tails = numbered.join(plan.select("conv_id", "h", "head"), "conv_id").where("depth > h")
    tails = tails.select("conv_id", (F.col("depth") - F.col("h") + F.col("head")).alias("depth"), "token", "words")
    return heads.unionByName(tails), plan.select("conv_id", "length")


def named_prefixes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, int]:
    """Name of every beginning of every conversation: conv_id, depth, words, name; and the number of halvings.

    Depths from 0 (the empty beginning) are cut in halves again and again. A piece of
    depth 1 is named by its turn. Pieces of double height join two of these, all at the same
    time: names in the upper half stay, those in the lower half get the name at the cut in
    front. At last each is the name of a whole beginning, equal for equal ones.
    """
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.sha2(F.lit("root"), 256)).alias("token"), F.lit(0).cast("long").alias("words"))
    names = materialize(root.unionByName(turns).withColumnRenamed("token", "name"), "trie-names")
    deepest = names.agg(F.max("depth")).first()[0] or 0
    halvings = int(deepest).bit_length()
    for k in range(halvings):
        half = 1 << k
        lower = F.col("depth").bitwiseAND(F.lit(half)) != 0
        cut = F.col("depth") - F.col("depth") % half - 1
        cuts = names.where(~lower & ((F.col("depth") + 1) % half == 0)).select("conv_id", F.col("depth").alias("cut"), F.col("name").alias("front"))
        joined = names.where(lower).withColumn("cut", cut).join(cuts, ["conv_id", "cut"])
        joined = joined.select("conv_id", "depth", "words", F.unhex(F.sha2(F.concat("front", "name"), 256)).alias("name"))
        names = materialize(names.where(~lower).select("conv_id", "depth", "words", "name").unionByName(joined), "trie-names")
    return names, halvings


def grafted_totals(nodes: DataFrame, names: DataFrame, halvings: int, columns: list[str]) -> DataFrame:
    """Sums of *columns* of nodes (depth, name, conv_id, front, ...) over their subtrees: depth, name, sums.

    Goes through the halvings from the shortest pieces on. In each, the totals of the trees
    that hang below a cut are added to all nodes on the way from the top of the piece to the
    cut, which the node's smallest member names: a way is read once for each node at a cut.
    """
    sums = [F.sum(c).alias(c) for c in columns]
    totals = nodes.select("depth", "name", *columns)
    where = nodes.select("depth", "name", "conv_id", "front")
    for k in range(halvings):
        half = 1 << k
        tops = where.where(F.col("depth") % (2 * half) == half).join(totals, ["depth", "name"])
        below = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("front").alias("name")).agg(*sums)
        cuts = below.join(where, ["depth", "name"]).select("conv_id", (F.col("depth") - F.col("depth") % (2 * half)).alias("top"), *columns)
        ways = names.where(F.col("depth") % (2 * half) < half).select("conv_id", (F.col("depth") - F.col("depth") % (2 * half)).alias("top"), "depth", "name")
        added = ways.join(cuts, ["conv_id", "top"]).select("depth", "name", *columns)
        totals = materialize(totals.unionByName(added).groupBy("depth", "name").agg(*sums), "trie-totals")
    return totals


def hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the strings of each node, joined by commas, from rows ordered by node and place."""
    at, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.binary()), pa.array([state.hexdigest()])], names=["depth", "name", "ends_sha256"])

    for batch in batches:
        for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids")), strict=True):
            if (depth, name) == at:
                state.update(b",")
            else:
                if at is not None:
                    yield row()
                at, state = (depth, name), hashlib.sha256()
            state.update(ids.encode())
    if at is not None:
        yield row()


def ends_of_nodes(names: DataFrame, lengths: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node: depth, name, ends_sha256.

    A digest needs the ids of a node in order; at most IDS of them form one row first, then
    the rows of a node pass through one task as a stream, which holds one row at a time.
    """
    ends = names.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    packed = ends.groupBy("depth", "name", F.expr(f"conv_id div {IDS}").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    packed = packed.repartition("depth", "name").sortWithinPartitions("depth", "name", "block")
    return packed.select("depth", "name", "ids").mapInArrow(hash_lists, "depth long, name binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations (see `rebuilt_conversations`).

    Columns: conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and name, the digest of the beginning.
    n_leaves counts the childless nodes of the subtree, saved_tokens sums (n_convs - 1) times
    the words of the last text over it; a node is in its own subtree. ends_sha256 is the digest
    of the ids, joined by commas, of the conversations that end there.

    Turns are ordered by number, null first, equal ones by the digest of role and text, so
    that repeated rows count as turns each. Null roles and texts are empty. Rows without an id
    are left out, as they belong to no conversation. An empty table gives no rows; extra
    columns are ignored. Turns are told apart by SHA-256.
    """
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    ).where("conv_id is not null")
    numbered = numbered_turns(rows.select("conv_id", "turn", turn_token().alias("token"), words_in(F.col("text")).alias("words")))
    turns, lengths = rebuilt_conversations(numbered)
    names, halvings = named_prefixes(turns, lengths)

    members = names.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    fronts = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("front"))
    nodes = materialize(members.join(fronts, ["conv_id", "depth"], "left"), "trie-members")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("front").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = materialize(nodes, "trie-nodes")
    totals = grafted_totals(nodes, names, halvings, ["n_leaves", "saved_tokens"])

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("front"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, ["depth", "name"])
    out = out.join(parents, ["depth", "front"], "left").join(ends_of_nodes(names, lengths), ["depth", "name"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "name",
    )
