"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import blocks, joined_bytes, keyed, mixed, row_key, segment_hashes, word_spans
from labelloom.llm.components import components
from labelloom.session import materialize

WORDS = 5
#: Jaccard similarity that links two sets: 4/5, held exactly in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
TARGET_RECALL = 0.9999
#: Buckets up to this many sets are compared in one task; larger ones are split.
BRUTE_SETS = 6_000
#: Sets of a large bucket that tell whether it is dense; a dense one is cut into blocks at once.
PROBE_SETS = 32
DENSE = 0.4
#: Rows of a comparison worked on together.
ROWS = 512
#: Levels of splitting; what is still large then is compared in blocks.
MOST_LEVELS = 3
#: Expected shared picks of a pair at the threshold: at the first level per run, and deeper.
FIRST_RATE, DEEP_RATE = 1.0, 4.0
BATCH_TOKENS = 3_000_000


def runs() -> int:
    """Runs after which a pair at the threshold has met with probability TARGET_RECALL.

    Such a pair shares NUMERATOR / DENOMINATOR of its larger set, of whose tokens
    FIRST_RATE are picked by both on average; so it misses a run with probability
    exp(-FIRST_RATE).
    """
    return math.ceil(-math.log(1 - TARGET_RECALL) / FIRST_RATE)


def shingles(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted by text, and the n + 1 offsets of the texts.

    A shingle is WORDS consecutive words; a text with fewer words is one shingle.
    """
    data, starts = joined_bytes(values)
    begins, ends = word_spans(data)
    texts = len(starts) - 1
    owner = np.searchsorted(starts, begins, side="right") - 1
    words = segment_hashes(data, begins, ends)
    counts = np.bincount(owner, minlength=texts)[:texts] if len(owner) else np.zeros(texts, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    here = np.maximum(counts - WORDS + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(texts), here)
    at = np.arange(len(of)) - np.repeat(np.cumsum(here) - here, here) + first[of]
    h = np.zeros(len(of), dtype=np.uint64)
    last = first[of + 1]
    for j in range(WORDS):
        there = at + j < last
        h[there] = h[there] * np.uint64(0xC2B2AE3D27D4EB4F) + words[(at + j)[there]]
    h = mixed(h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(texts + 1))


def picked(h: np.ndarray, sizes: np.ndarray, seed, rate: float) -> np.ndarray:
    """Which tokens a node picks; *sizes* holds for each token the size of its set."""
    with np.errstate(over="ignore"):
        draw = mixed(h ^ np.uint64(seed)) >> np.uint64(11)
    return draw.astype(np.float64) * 2.0**-53 < rate * DENOMINATOR / (NUMERATOR * sizes)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity and picked paths of the set of each text."""
    seeds = mixed(np.arange(1, 2 * runs() + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    for batch in batches:
        for block in blocks(batch):
            h, offsets = shingles(block.column("text"))
            size = np.diff(offsets)
            of = np.repeat(np.arange(len(size)), size)
            whole = np.zeros(len(size), dtype=np.uint64)
            filled = size > 0
            if len(h):
                whole[filled] = np.add.reduceat(mixed(h ^ np.uint64(0xD1B54A32D192ED03)), offsets[:-1][filled])
            whole = mixed(whole + size.astype(np.uint64))
            paths, owners = [], []
            for k in range(runs()):
                hit = picked(h, size[of], seeds[2 * k], FIRST_RATE)
                paths.append(mixed(h[hit] ^ seeds[2 * k + 1]))
                owners.append(of[hit])
            paths, owners = np.concatenate(paths), np.concatenate(owners)
            order = np.argsort(owners, kind="stable")
            ends = np.searchsorted(owners[order], np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("k1"), block.column("k2"),
                 pa.array(whole.view(np.int64), mask=~filled), pa.array(size), pa.ListArray.from_arrays(pa.array(ends), pa.array(paths[order].view(np.int64)))],
                names=["doc_id", "k1", "k2", "sid", "size", "paths"],
            )


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the set of each text, as bytes."""
    for batch in batches:
        for block in blocks(batch):
            h, offsets = shingles(block.column("text"))
            parts = [h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("sid"), pa.array(parts, pa.binary())], names=["sid", "tokens"])


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set with its tokens once for each of its buckets, and with the list of these."""
    for batch in batches:
        for block in blocks(batch, limit=1_000_000):
            h, offsets = shingles(block.column("text"))
            out: list[tuple] = []
            for sid, buckets, a, b in zip(block.column("sid").to_pylist(), block.column("buckets").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                raw = h[a:b].tobytes()
                out += [(bucket, sid, raw, buckets) for bucket in buckets]
            for at in range(0, len(out), 1000):
                columns = zip(*out[at : at + 1000], strict=True)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "sid", "tokens", "buckets"])


def split_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Child buckets of each set of a large bucket."""
    for batch in batches:
        for block in blocks(batch, "tokens"):
            for bucket, sid, raw in zip(*(block.column(c).to_pylist() for c in ("bucket", "sid", "tokens")), strict=True):
                h = np.frombuffer(raw, dtype=np.uint64)
                node = np.uint64(bucket & (2**64 - 1))
                with np.errstate(over="ignore"):
                    child = mixed(h[picked(h, np.full(len(h), len(h)), mixed(node + np.uint64(1)), DEEP_RATE)] + mixed(node))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array([sid] * len(child), pa.int64())], names=["bucket", "sid"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of some sorted sets."""
    m = len(sets)
    if m == 2:
        common = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), dtype=np.float32)
    often = counts > max(4, m // 24)
    column = np.cumsum(often) - 1
    dense = often[token]
    token_of, owner_of = column[token[dense]], owner[dense]
    order = np.argsort(token_of, kind="stable")
    token_of, owner_of = token_of[order], owner_of[order]
    width = 2048
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(token_of, [low, low + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[owner_of[a:b], token_of[a:b] - low] = 1
        out += x @ x.T
    some = ~dense & (counts[token] > 1)
    token, owner = token[some], owner[some]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for shift in range(1, max(5, m // 24 + 1)):  # partners further along the same token
        if shift >= len(token):
            break
        same = token[shift:] == token[:-shift]
        if not same.any():
            break
        np.add.at(out, (owner[:-shift][same], owner[shift:][same]), 1)
        np.add.at(out, (owner[shift:][same], owner[:-shift][same]), 1)
    return out


def overlap_rows(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """The same, as blocks of consecutive rows: first row and counts."""
    m = len(sets)
    if m <= ROWS:
        yield 0, overlaps(sets)
        return
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > m // 8
    column = np.cumsum(often) - 1
    x = np.zeros((m, int(often.sum())), dtype=np.float32)
    dense = often[token]
    x[owner[dense], column[token[dense]]] = 1
    some = ~dense & (counts[token] > 1)
    rare, of = token[some], owner[some]
    order = np.argsort(rare, kind="stable")
    holders, ends = of[order], np.cumsum(np.bincount(rare, minlength=len(counts)))
    first = np.searchsorted(of, np.arange(m + 1))
    for low in range(0, m, ROWS):
        out = x[low : low + ROWS] @ x.T
        for i in range(len(out)):
            tokens = rare[first[low + i] : first[low + i + 1]]
            if len(tokens):
                out[i] += np.bincount(np.concatenate([holders[ends[t] - counts[t] : ends[t]] for t in tokens]), minlength=m)
        yield low, out


def compare(bucket: int, sids: list[int], sets: list[np.ndarray], others: list[list[int]]) -> tuple[list[int], list[int], list[int]] | None:
    """Links within a bucket: for each linked set its id, the smallest id connected to it here, and its links first met here.

    A pair that shares several buckets is counted in the one with the smallest number.
    """
    m = len(sids)
    size = np.array([len(s) for s in sets])
    linked = np.zeros((m, m), dtype=bool)
    for low, common in overlap_rows(sets):
        linked[low : low + len(common)] = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (size[low : low + len(common), None] + size[None, :]) - 1e-3
    np.fill_diagonal(linked, False)
    at = np.flatnonzero(linked.any(axis=1))
    if not len(at):
        return None
    linked = linked[np.ix_(at, at)]
    number = np.zeros(len(at), dtype=np.int64)
    for low, shared in overlap_rows([np.array(sorted(x for x in others[i] if x < bucket), dtype=np.int64) for i in at]):
        number[low : low + len(shared)] = (linked[low : low + len(shared)] & (shared == 0)).sum(axis=1)
    root, before = np.array(sids, dtype=np.int64)[at], None
    while before is None or (root != before).any():
        before = root
        least = [np.where(linked[i : i + ROWS], root[None, :], np.iinfo(np.int64).max).min(axis=1) for i in range(0, len(at), ROWS)]
        root = np.minimum(root, np.concatenate(least))
    return [sids[i] for i in at], root.tolist(), number.tolist()


def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean similarity of the probed sets of each bucket; rows come bucket by bucket."""
    held: list[np.ndarray] = []
    now, out = None, []

    def close() -> None:
        if len(held) > 1:
            size = np.array([len(s) for s in held])
            common = overlaps(held)
            share = common / (size[:, None] + size[None, :] - common)
            np.fill_diagonal(share, 0)
            out.append((now, float(share.sum() / (len(held) * (len(held) - 1)))))
        held.clear()

    for batch in batches:
        for bucket, tokens in zip(batch.column("bucket").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            if bucket != now:
                close()
                now = bucket
            held.append(np.frombuffer(tokens, dtype=np.uint64))
    close()
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.float64())], names=["bucket", "alike"])


def compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in consecutive rows of one bucket each; a bucket has a bounded number of sets."""
    held: list[tuple] = []
    now = None

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            found = compare(now, [h[0] for h in held], [np.frombuffer(h[1], dtype=np.uint64) for h in held], [h[2] for h in held])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "links"])
        held.clear()

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sid", "tokens", "buckets")), strict=True):
            if row[0] != now:
                yield from flush()
                now = row[0]
            held.append(row[1:])
    yield from flush()


def merged(rows: DataFrame, brute_sets: int) -> DataFrame:
    """Buckets (bucket, sid) with their sizes n, those of like sets merged: bucket, sid, n.

    Sets that are alike meet in many buckets of nearly the same sets. Buckets with one
    smallest set become one, then those with one largest set, unless that would make a
    bucket too large. No pair of sets is parted by this.
    """
    for lead in (F.min, F.max):
        leaders = rows.groupBy("bucket").agg(lead("sid").alias("leader"))
        led = rows.join(leaders, "bucket")
        together = led.select("leader", "sid").distinct().groupBy("leader").agg(F.count("*").alias("m"))
        fits = F.col("m") <= brute_sets
        rows = materialize(led.join(together, "leader").select(F.when(fits, F.xxhash64("leader")).otherwise(F.col("bucket")).alias("bucket"), "sid").distinct(), "jaccard-merged")
    return materialize(rows.join(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket"), "jaccard-merged")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", brute_sets: int = BRUTE_SETS) -> DataFrame:
    """The result of `near_classes` without the numbers of the classes."""
    return near_classes(docs, id_col, text_col, brute_sets).drop("root")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", brute_sets: int = BRUTE_SETS) -> DataFrame:
    """Documents joined by shingle sets of Jaccard similarity 0.8 or more.

    One row per document: doc_id, class_id (smallest id of all documents connected by
    links or equal sets), copy_id (smallest id with the same set), n_links (other sets
    linked to the set of this document), n_shingles; the row's key k1, k2; and root, the
    number of the class, null for rows without shingles.

    Equal sets are merged first. Each run picks tokens of a set at random, so that two
    sets at the threshold pick one in common FIRST_RATE times on average; sets that pick
    a token share a bucket. Buckets with one set are dropped, buckets of nearly the same
    sets are merged (see `merged`), larger ones than *brute_sets* are split again by
    tokens picked at DEEP_RATE. Splitting doesn't part sets that are alike: if a probe of PROBE_SETS sets
    of a large bucket says so, or after MOST_LEVELS levels, it is cut into pairs of
    blocks instead, which are compared each. So every bucket is compared in one task of bounded size, by exact
    similarities, no bucket is capped, and links are counted where they are met, never
    listed. Pairs at the threshold meet with probability TARGET_RECALL or more.

    Null and empty texts have no shingle: they are alone, also if there are several.
    Repeated rows are copies of each other. Ids are whole numbers or null; extra columns
    are ignored; an empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col).select("doc_id", "text", *row_key())
    kind = dict(rows.dtypes)["doc_id"]
    members = materialize(rows.mapInArrow(signatures, f"doc_id {kind}, k1 long, k2 long, sid long, size long, paths array<long>"), "jaccard-sets")
    sets = members.where("sid is not null").groupBy("sid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("copy_id"), F.min(F.struct("k1", "k2", "paths")).alias("first")
    )
    sets = materialize(sets.select("sid", "copies", "copy_id", "first.k1", "first.k2", "first.paths"), "jaccard-distinct")
    met = sets.select(F.explode("paths").alias("bucket"), "sid").distinct()
    counted = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = merged(materialize(met.join(counted, "bucket").select("bucket", "sid"), "jaccard-met"), brute_sets)
    source = rows.select("k1", "k2", "text")
    done, large = placed.where(F.col("n") <= brute_sets).select("bucket", "sid"), placed.where(F.col("n") > brute_sets)
    if not large.isEmpty():
        wanted = large.select("sid").distinct().join(sets.select("sid", "k1", "k2"), "sid")
        # rows with one key are equal
        texts = source.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        tokens = materialize(texts.select("sid", "text").mapInArrow(token_rows, "sid long, tokens binary"), "jaccard-tokens")
    for level in range(MOST_LEVELS + 1):
        if large.isEmpty():
            break
        # splitting parts unlike sets; buckets of like ones, and what is left in the end, are cut into pairs of blocks
        probed = large.where(F.pmod(F.xxhash64("sid"), F.ceil(F.col("n") / PROBE_SETS)) == 0).join(tokens, "sid")
        alike = probed.select("bucket", "tokens").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(probe, "bucket long, alike double")
        judged = materialize(large.join(alike, "bucket", "left").withColumn("dense", (F.coalesce("alike", F.lit(0.0)) >= DENSE) | F.lit(level == MOST_LEVELS)), "jaccard-judged")
        count = F.ceil(F.col("n") * 2 / brute_sets).cast("int")
        paired = (
            judged.where("dense").withColumn("count", count).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("count")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, count - 1)")))
        )
        done = done.unionByName(paired.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "sid"))
        children = judged.where("not dense").select("bucket", "sid").join(tokens, "sid").mapInArrow(split_paths, "bucket long, sid long").distinct()
        children = materialize(children, "jaccard-split")
        counted = children.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        children = merged(materialize(children.join(counted, "bucket").select("bucket", "sid"), "jaccard-split"), brute_sets)
        done = done.unionByName(children.where(F.col("n") <= brute_sets).select("bucket", "sid"))
        large = children.where(F.col("n") > brute_sets)
    done = materialize(done.distinct(), "jaccard-done")
    buckets_of = done.groupBy("sid").agg(F.collect_list("bucket").alias("buckets")).join(sets.select("sid", "k1", "k2"), "sid")
    ready = (
        source.join(buckets_of, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("sid", "buckets", "text")
        .mapInArrow(bucket_rows, "bucket long, sid long, tokens binary, buckets array<long>")
        .repartition("bucket").sortWithinPartitions("bucket")
    )
    links = materialize(ready.select("bucket", "sid", "tokens", "buckets").mapInArrow(compare_buckets, "a long, b long, links long"), "jaccard-links")

    roots = components(links.select("a", "b"))
    number = links.groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "sid")
    found = (
        sets.select("sid", "copy_id").join(number, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
        .withColumn("root", F.coalesce("root", "sid"))
    )
    found = materialize(found, "jaccard-found")
    classes = found.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    found = found.join(classes, "root")
    alone = F.col("sid").isNull()
    return members.drop("paths").join(found, "sid", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("size").alias("n_shingles"),
        "k1", "k2", "root",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class the document with the smallest id, with all its columns; see `near_classes`.

    One row of a class stays, also where ids are null (these come last) or repeat (then
    the hash of the text decides). Rows that share an id and a text come out once.
    """
    alone = F.col("root").isNull()
    classes = near_classes(docs, id_col, text_col).groupBy("root", F.when(alone, F.col("k1")).alias("a1"), F.when(alone, F.col("k2")).alias("a2"))
    stay = classes.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "k1", "k2")).alias("first"))
    verdict = stay.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2"))
    k1, k2 = keyed_columns(id_col, text_col)
    marked = docs.withColumns({"__k1": k1, "__k2": k2})
    once = marked.join(verdict, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return once.select(*[f"`{c}`" for c in docs.columns])


def keyed_columns(id_col: str, text_col: str):
    """The columns of `row_key` over a table's own columns."""
    identity, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return F.coalesce(identity.cast("long"), F.lit(-1)), F.xxhash64(identity.isNull(), text)
