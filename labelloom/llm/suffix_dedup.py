"""Removal of long repeated byte strings, over a sparse suffix array and its common-prefix intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import BASE, BYTE_VALUES, blocks, joined_bytes, keyed, mixed, powers, row_key
from labelloom.session import materialize

#: Length in bytes of the strings that count as repeated.
LENGTH = 400
#: Length of the strings that fix where suffixes are taken.
GRAM = 64
#: Suffixes with the same first GRAM bytes that are sorted in one task; larger groups are split.
MOST_SUFFIXES = 20_000


def inverse(base: int) -> int:
    """Inverse of an odd number modulo 2^64."""
    return pow(base, -1, 1 << 64)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position, n a power of two, by doubling."""
    h, factor, size = BYTE_VALUES[data], int(BASE), 1
    while size < n:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % (1 << 64), size * 2
    return mixed(h)


def sampled(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sampled suffixes and the hashes of their first *gram* bytes.

    Every string of *length* bytes within a text contains the first bytes of at least one
    of them, its smallest gram (the leftmost of equals): so equal strings contain equal
    ones at the same place.
    """
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if len(data) < length:
        return none
    h = gram_hashes(data, gram)
    bits = np.uint64(max(len(data) - 1, 1).bit_length())
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    window, size = length - gram + 1, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    text_end = np.repeat(starts[1:] - 1, np.diff(starts))
    inside = np.arange(len(least)) + length <= text_end[: len(least)]
    at = np.unique(least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at, h[at]


def sample_rows(length: int, gram: int):
    """Sampled suffixes of each text with a hash of all that a repeat around them can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.uint64(inverse(int(BASE)))
        for batch in batches:
            for block in blocks(batch):
                data, starts = joined_bytes(block.column("text"))
                at, h = sampled(data, starts, length, gram)
                owner = np.searchsorted(starts, at, side="right") - 1
                before = np.minimum(at - starts[owner], length - gram)
                after = np.minimum(starts[owner + 1] - 1 - at, length)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * powers(len(data)))])
                around = (sums[at + after] - sums[at - before]) * powers(len(data) + 1, step)[at - before]
                around = mixed(around + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h)
                k1, k2 = (block.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(at - starts[owner]),
                     pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))],
                    names=["h", "around", "k1", "k2", "at", "before", "after"],
                )

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def sorted_prefixes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of some strings, and the common prefix of each with the one before it (0 for the first)."""
    order = sorted(range(len(values)), key=values.__getitem__)
    prefixes = np.array([0] + [common(values[a], values[b]) for a, b in zip(order[:-1], order[1:], strict=True)], dtype=np.int64)
    return np.array(order, dtype=np.int64), prefixes


def intervals(prefixes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Intervals of the common-prefix tree by a stack scan: (prefix, first, last + 1) in the sorted order."""
    stack = [(0, 0)]
    for i, value in enumerate([*prefixes[1:].tolist(), -1], start=1):
        low = i - 1
        while stack and stack[-1][0] > value:
            depth, low = stack.pop()
            yield depth, low, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, low))


def extents(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeats of *length* bytes around each suffix of a group reach: bytes before and after its start.

    *rights* are the suffixes, *lefts* the texts before them. Each interval of the
    common-prefix tree is a set of suffixes with a common prefix. Sorted by what stands
    before them, read backwards, neighbours show how diverse the left extensions are:
    a suffix whose longest common left extension and the interval's prefix make up
    *length* bytes lies in a repeat. All of its repeats hold its start, so the furthest
    ends to both sides describe their union.
    """
    count = len(rights)
    before, after = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    if count < 2:
        return before, after
    backwards = [left[::-1] for left in lefts]
    if count == 2:
        left, right = common(*backwards), common(*rights)
        if left + right >= length:
            before[:], after[:] = left, right
        return before, after
    order, prefixes = sorted_prefixes(rights)
    left_order, left_prefixes = sorted_prefixes(backwards)
    rank = np.empty(count, dtype=np.int64)
    rank[left_order] = np.arange(count)
    most = int(left_prefixes.max())
    for depth, low, high in intervals(prefixes):
        if depth + most < length:
            continue
        ranks = np.sort(rank[order[low:high]])
        shared = np.minimum.reduceat(left_prefixes[: ranks[-1] + 1], ranks[:-1] + 1)
        longest = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
        repeats = longest + depth >= length
        who = left_order[ranks[repeats]]
        before[who] = np.maximum(before[who], longest[repeats])
        after[who] = np.maximum(after[who], depth)
    return before, after


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before and after the suffixes wanted of each text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("h", "around", "left", "right")}
        held = 0
        for packed, wanted in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            text = unpack.decompress(packed)
            for w in wanted:
                at = w["at"]
                for c, v in (("h", w["h"]), ("around", w["around"]), ("left", text[at - w["before"] : at]), ("right", text[at : at + w["after"]])):
                    out[c].append(v)
                held += w["before"] + w["after"]
            if held > 8_000_000:
                yield context_batch(out)
                out, held = {c: [] for c in out}, 0
        yield context_batch(out)


def context_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"left": pa.binary(), "right": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))


def compare_groups(length: int):
    """Extents within consecutive rows of one key each; a key has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        done: dict[str, list] = {c: [] for c in ("h", "around", "before", "after")}

        def close() -> None:
            before, after = extents([x[2] for x in held], [x[3] for x in held], length)
            for row, b, a in zip(held, before.tolist(), after.tolist(), strict=True):
                if a:
                    for c, v in zip(done, (row[0], row[1], b, a), strict=True):
                        done[c].append(v)
            held.clear()

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "around", "left", "right")), strict=True):
                if key != now:
                    close()
                    now = key
                held.append(row)
            if len(done["h"]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in done.values()], names=list(done))
                for v in done.values():
                    v.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in done.values()], names=list(done))

    return run


def halves(length: int):
    """Each context of a large group, cut to the repeats that begin in either half of its range of starts.

    A row stands for the repeats that begin from `low` to `high` bytes before the suffix.
    All strings in that range share the bytes from `low` before to length - high after it;
    these make the new key, so that a group parts into many.
    """

    def digest(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(len(p).to_bytes(4, "little") + p for p in parts), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "content", "low", "high", "h", "around", "left", "right"]
        for batch in batches:
            out: list[tuple] = []
            for key, low, high, h, around, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "h", "around", "left", "right")), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if a > b or len(left) < a or len(right) < length - b:
                        continue
                    some_left, some_right = left[max(0, len(left) - b) :], right[: length - a]
                    inner = digest(key.to_bytes(8, "little", signed=True), bytes([a % 256, a // 256, b % 256, b // 256]), left[len(left) - a :], right[: length - b])
                    out.append((inner, digest(some_left, some_right), a, b, h, around, some_left, some_right))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


FOUND = "h long, around long, before long, after long"


def group_extents(rows: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """Extents of all distinct contexts (h, around, left, right), whatever the size of their groups.

    Groups up to *most* rows are handled in one task each. Larger ones are split by
    `halves` until they are small; contexts that become equal on the way are repeats of
    each other in that range and only one of them goes on. At the latest with one start
    left, all contexts of a group are equal. Rows of a large group stay where they are
    read: its key is broadcast (there is at most one for every *most* rows).
    """
    tasks = materialize(rows.select(F.col("h").alias("key"), F.lit(0).alias("low"), F.lit(length - gram).alias("high"), "h", "around", "left", "right"), "suffix-groups")
    found = None
    while True:
        large = materialize(tasks.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > most).select("key"), "suffix-large")
        small = tasks.join(F.broadcast(large), "key", "left_anti")
        near = small.repartition("key").sortWithinPartitions("key").select("key", "h", "around", "left", "right").mapInArrow(compare_groups(length), FOUND)
        found = near if found is None else found.unionByName(near)
        if large.isEmpty():
            return found
        parts = materialize(
            tasks.join(F.broadcast(large), "key").select("key", "low", "high", "h", "around", "left", "right")
            .mapInArrow(halves(length), "key long, content long, low int, high int, h long, around long, left binary, right binary"),
            "suffix-halves",
        )
        # written, so that a join with it can be split where one key has many rows
        alike = materialize(parts.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("h", "around")).alias("one")), "suffix-contents")
        repeats = parts.join(alike.where("n > 1").select("key", "content"), ["key", "content"]).select(
            "h", "around",
            F.least("high", F.length("left")).cast("long").alias("before"),
            (length - F.greatest("low", length - F.length("right"))).cast("long").alias("after"),
        )
        found = found.unionByName(repeats)
        ones = alike.select("key", "content", "one.h", "one.around")
        tasks = materialize(parts.join(ones, ["key", "content", "h", "around"], "left_semi").drop("content"), "suffix-groups")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, to move less."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for block in blocks(batch):
            packed = [zip_.compress(t.encode("utf-8", "surrogatepass")) for t in block.column("text").to_pylist()]
            others = [n for n in block.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(block.column(n) for n in others), pa.array(packed, pa.binary())], names=[*others, "packed"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the marked spans."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for packed, marked in zip(batch.column("packed").to_pylist(), batch.column("marked").to_pylist(), strict=True):
            text = unpack.decompress(packed)
            spans: list[list[int]] = []
            for m in sorted(marked or [], key=lambda m: m["start"]):
                if spans and m["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m["end"])
                else:
                    spans.append([m["start"], m["end"]])
            digest, at = hashlib.sha256(), 0
            for start, end in spans:
                digest.update(text[at:start])
                at = end
            digest.update(text[at:])
            values = (len(text), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans])
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST_SUFFIXES) -> DataFrame:
    """Bytes of every document that lie in a string of *length* bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) and
    spans (start, end in bytes of the UTF-8 text). Elsewhere is any other place, in the
    same or another document; overlaps count; strings don't cross documents.

    Only some suffixes are kept, so chosen that every string of *length* bytes holds the
    start of one and equal strings hold equal ones (see `sampled`). Counts by the first
    bytes drop those that are alone. Of the others, those with equal surroundings are
    repeats at once; the different surroundings of one start are sorted to a suffix
    array, whose common-prefix intervals tell how far each one is repeated (see
    `extents`, and `group_extents` for groups of any size). All else is by joins on keys.

    Null and empty texts, and texts shorter than *length*, lose nothing. Repeated rows
    are copies of each other. Extra columns are ignored; an empty table gives an empty
    result. *gram* is a power of two not above *length*.
    """
    rows = keyed(docs, id_col, text_col).select("doc_id", "text", *row_key())
    kind = dict(rows.dtypes)["doc_id"]
    suffixes = materialize(
        rows.select("k1", "k2", "text").mapInArrow(sample_rows(length, gram), "h long, around long, k1 long, k2 long, at long, before int, after int"), "suffixes"
    )
    counts = suffixes.groupBy("h", "around").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    starts = materialize(counts.where("n > 1").select("h", "m"), "suffix-starts")  # written, so that the join can be split where one start has many rows
    met = materialize(suffixes.join(starts, "h"), "suffixes-met")
    alike = materialize(
        met.groupBy("h", "around").agg(F.count("*").alias("n"), F.max("m").alias("m"), F.min(F.struct("k1", "k2", "at", "before", "after")).alias("one")), "suffixes-alike"
    )
    packed = rows.mapInArrow(pack, f"doc_id {kind}, k1 long, k2 long, packed binary")
    wanted = alike.where("m > 1").select("one.*", "h", "around").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "around", "at", "before", "after")).alias("wanted"))
    # equal rows have equal contexts
    around = packed.select("k1", "k2", "packed").join(wanted, ["k1", "k2"]).mapInArrow(contexts, "h long, around long, left binary, right binary").dropDuplicates(["h", "around"])
    found = group_extents(around, length, gram, most).groupBy("h", "around").agg(F.max("before").alias("b"), F.max("after").alias("a"))
    whole = F.col("n") > 1
    reach = materialize(
        alike.join(found, ["h", "around"], "left").where(whole | F.col("a").isNotNull()).select("h", "around", whole.alias("whole"), "b", "a"), "suffixes-reach"
    )
    marked = (
        met.join(reach, ["h", "around"])
        .select(
            "k1", "k2",
            F.struct(
                (F.col("at") - F.when(F.col("whole"), F.col("before")).otherwise(F.col("b"))).cast("long").alias("start"),
                (F.col("at") + F.when(F.col("whole"), F.col("after")).otherwise(F.col("a"))).cast("long").alias("end"),
            ).alias("span"),
        )
        .groupBy("k1", "k2").agg(F.collect_set("span").alias("marked"))
    )
    return packed.join(marked, ["k1", "k2"], "left").select("doc_id", "packed", "marked").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    )
