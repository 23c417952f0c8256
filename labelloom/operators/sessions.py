"""Frame-session operators: rolling vote, label changes, intervals, debounce.

A session may hold a large share of all frames, so no operator windows over a
whole session. Sessions are cut into time chunks; each chunk gets the last few
frames before it ("carried" frames) and is then processed on its own.

Input frames have `session_id`, `frame_id` (unique in a session), `us` (time in
microseconds) and the operator's own columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.labels import label_key
from labelloom.session import materialize

HOUR_US = 3_600_000_000
# One chunk per session unless `fit_chunk` finds sessions too dense for that.
WHOLE_SESSION_US = 24 * 3650 * HOUR_US


def in_chunk() -> Window:
    """Frames of one chunk of a session in event order."""
    return Window.partitionBy("session_id", "chunk").orderBy("us", "frame_id")


def fit_chunk(
    frames: DataFrame, chunk_us: int = WHOLE_SESSION_US, least_us: int = 1_000_000, max_frames: int = 100_000
) -> int:
    """Chunk length at which no (session, chunk) holds more than *max_frames* frames.

    One counting pass over two columns per try; dense sessions shorten the chunks.
    Results do not depend on the chunk length, only the size of tasks does.
    """
    while chunk_us > least_us:
        most = (
            frames.groupBy("session_id", F.expr(f"us div {int(chunk_us)}L").alias("chunk"))
            .count()
            .agg(F.max("count"))
            .first()[0]
        )
        if most is None or most <= max_frames:
            break
        chunk_us = max(least_us, chunk_us * max_frames // (2 * most))
    return int(chunk_us)


#: Frames of a session that form a chunk, and length of the slots by which they are counted.
MOST_FRAMES = 100_000
SLOT_US = 1_000_000


def even_chunks(frames: DataFrame, max_frames: int = MOST_FRAMES, slot_us: int = SLOT_US) -> DataFrame:
    """Frames with `chunk`: each session cut for itself where its frames reach the next *max_frames*.

    Chunks of a session are numbered from 0 without gaps. Cuts are between slots, so a chunk
    may exceed the number by the frames of one slot. Frames per slot are added up along each
    session: slots are sorted by ranges, summed within a range, and the sums of the ranges are
    added up per session, so no session is gathered. Frames find their chunk by session and
    slot. If no session is larger than a chunk, all is chunk 0 after one count.
    """
    most = frames.groupBy("session_id").count().agg(F.max("count")).first()[0]
    if most is None or most <= max_frames:
        return frames.withColumn("chunk", F.lit(0).cast("bigint"))
    slot = F.expr(f"us div {int(slot_us)}L - CAST(us < 0 AND us % {int(slot_us)}L <> 0 AS BIGINT)")
    counts = frames.groupBy("session_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(
        counts.repartitionByRange("session_id", "slot").withColumn("part", F.spark_partition_id()), "slot-counts"
    )
    inside = Window.partitionBy("part", "session_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # one row per session and range that it crosses
    earlier = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("session_id", "part").agg(F.sum("n").alias("n")).select(
        "session_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    slots = (
        ranged.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(sums, ["session_id", "part"])
        .select("session_id", "slot", F.expr(f"(before + within) div {int(max_frames)}").alias("_number"))
    )
    slots = materialize(slots, "slot-chunks")
    # one row per chunk; a slot with more frames than a chunk leaves numbers out
    dense = slots.groupBy("session_id", "_number").agg(F.lit(1).alias("one")).select(
        "session_id", "_number", (F.row_number().over(Window.partitionBy("session_id").orderBy("_number")) - 1).cast("bigint").alias("chunk")
    )
    chunks = slots.join(dense, ["session_id", "_number"]).select("session_id", "slot", "chunk")
    return frames.withColumn("slot", slot).join(chunks, ["session_id", "slot"]).select(*frames.columns, "chunk")


def chunked(frames: DataFrame, chunk_us: int | None) -> DataFrame:
    """Frames with `chunk`, by time or, without a length, by `even_chunks`."""
    if chunk_us is None:
        return even_chunks(frames)
    return frames.withColumn("chunk", F.expr(f"us div {int(chunk_us)}L"))


def with_carried_frames(frames: DataFrame, depth: int, chunk_us: int | None = 24 * HOUR_US) -> DataFrame:
    """Frames with `chunk`, plus copies of the *depth* frames before each chunk.

    Copies have `carried = true` and belong to the chunk they are carried into.
    At most *depth* frames per chunk are gathered per session for this, whatever
    the number of frames.
    """
    columns = frames.columns
    parts = chunked(frames, chunk_us)
    # Chunks are of bounded size, and Spark keeps *depth* frames of each per task
    # before it shuffles them.
    latest = Window.partitionBy("session_id", "chunk").orderBy(F.desc("us"), F.desc("frame_id"))
    tails = (
        parts.withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= depth)
        .groupBy("session_id", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("us", "frame_id", *_rest(columns)))).alias("tail"))
    )
    before = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(-depth, -1)
    gathered = F.flatten(F.collect_list("tail").over(before))
    carried = (
        tails.select("session_id", "chunk", gathered.alias("past"))
        .filter(F.size("past") > 0)
        .withColumn("past", F.slice("past", F.greatest(F.lit(1), F.size("past") - depth + 1), depth))
        .select("session_id", "chunk", F.inline("past"))
        .select(*columns, "chunk", F.lit(True).alias("carried"))
    )
    return parts.select(*columns, "chunk", F.lit(False).alias("carried")).unionByName(carried)


def _rest(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in ("session_id", "us", "frame_id")]


def majority(labels: Column) -> Column:
    """struct(n, label) of the most frequent label, the earliest one on ties."""
    ranked = F.transform(
        F.array_distinct(labels),
        lambda name, i: F.struct(
            F.size(F.filter(labels, lambda other: other == name)).alias("n"),
            (-i).alias("earlier"),
            name.alias("label"),
        ),
    )
    return F.array_max(ranked)


def rolling_vote(
    frames: DataFrame,
    window_size: int = 5,
    min_consensus_ratio: float = 0.6,
    confidence_threshold: float = 0.6,
    chunk_us: int | None = 24 * HOUR_US,
) -> DataFrame:
    """Smoothed state of each frame over the last *window_size* frames.

    Adds stable_label, consensus_ratio, avg_confidence, window_size, the two
    threshold flags, and previous_stable_label (of the frame before).
    """
    recent = in_chunk().rowsBetween(-(window_size - 1), 0)
    filled = frames.withColumn("label", F.coalesce(F.col("label"), F.lit(""))).withColumn(
        "confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    )
    voted = (
        with_carried_frames(filled, window_size, chunk_us)
        .withColumn("_labels", F.collect_list("label").over(recent))
        .withColumn("avg_confidence", F.avg("confidence").over(recent))
        .withColumn("_top", majority(F.col("_labels")))
        .withColumn("stable_label", F.col("_top.label"))
        .withColumn("window_size", F.size("_labels"))
        .withColumn("consensus_ratio", F.col("_top.n") / F.col("window_size"))
        .withColumn("previous_stable_label", F.lag("stable_label").over(in_chunk()))
    )
    return (
        voted.filter(~F.col("carried"))
        .withColumn("meets_confidence", F.col("avg_confidence") >= confidence_threshold)
        .withColumn("meets_consensus", F.col("consensus_ratio") >= min_consensus_ratio)
        .drop("_labels", "_top", "carried", "chunk")
    )


def label_changes(voted: DataFrame) -> DataFrame:
    """Frames whose stable label differs from that of the frame before."""
    return voted.filter(~F.col("stable_label").eqNullSafe(F.col("previous_stable_label")))


def frame_intervals(frames: DataFrame, chunk_us: int | None = 24 * HOUR_US) -> DataFrame:
    """Milliseconds since the frame before and the frame rate they imply.

    The first frame of a session has neither; equal times have no rate.
    """
    gap = (F.col("us") - F.lag("us").over(in_chunk())) / 1000.0
    return (
        with_carried_frames(frames, 1, chunk_us)
        .withColumn("frame_interval_ms", gap)
        .filter(~F.col("carried"))
        .withColumn(
            "fps", F.when(F.col("frame_interval_ms") > 0, 1000.0 / F.col("frame_interval_ms"))
        )
        .drop("carried", "chunk")
    )


def stage_timings(frames: DataFrame) -> DataFrame:
    """Stage durations from `frame_start`, `preprocess_end`, `predict_end`, `dispatch_end` (seconds)."""
    start, pre, pred, disp = (
        F.col(c) for c in ("frame_start", "preprocess_end", "predict_end", "dispatch_end")
    )
    return (
        frames.withColumn("capture_to_prediction_ms", (pre - start) * 1000.0)
        .withColumn("prediction_ms", (pred - pre) * 1000.0)
        .withColumn("prediction_to_dispatch_ms", (disp - pred) * 1000.0)
        .withColumn("end_to_end_ms", (F.coalesce(disp, pred) - start) * 1000.0)
    )


def gap_sessions(frames: DataFrame, gap: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Runs of frames of a session with less than *gap* between neighbours, in batch or as a stream.

    Columns session_id, start_us, end_us (of the first and last frame), frames,
    avg_confidence. Spark merges runs by their borders, in each task before the shuffle,
    so no run of frames is sorted in one place. A stream needs a watermark on *ts*; a run is put
    out once the watermark has passed its end by the gap.
    """
    runs = frames.groupBy("session_id", F.session_window(ts, gap).alias("run")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("frames"), F.avg("confidence").alias("avg_confidence")
    )
    return runs.select(
        "session_id", F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("end_us"), "frames", "avg_confidence"
    )


# --- debounce ----------------------------------------------------------------
#
# A frame is emitted unless the last emitted label is the same and less than the
# debounce time has passed since. After any candidate frame the last emitted
# label is that frame's label, so a change of label always emits, and so does a
# gap of the debounce time. Between such resets the emissions form a chain:
# each is the first frame at least the debounce time after the one before.


def _chain_ends(us: np.ndarray, wait: int) -> np.ndarray:
    """Index of the last emission of the chain that begins at each frame."""
    following = np.searchsorted(us, us + wait, side="left")
    ends = np.where(following < len(us), following, np.arange(len(us)))
    while True:  # the jumps double in length
        farther = ends[ends]
        if (farther == ends).all():
            return ends
        ends = farther


def _last_reset(us: np.ndarray, labels: np.ndarray, wait: int) -> int:
    """Index of the last frame that emits whatever came before, 0 if none but the first."""
    resets = np.flatnonzero((labels[1:] != labels[:-1]) | (np.diff(us) >= wait))
    return int(resets[-1]) + 1 if len(resets) else 0


def _summarize(us: np.ndarray, labels: np.ndarray, wait: int) -> dict:
    """What a chunk does to the debounce state.

    With a reset inside, the state after the chunk is fixed. Without, it depends
    on where the chain begins: `starts` lists the times at which it may begin and
    `ends` the emission each beginning leads to. Chains soon meet, so neighbouring
    beginnings with the same end are kept as one, under the latest of them.
    """
    first = _last_reset(us, labels, wait)
    ends = _chain_ends(us[first:], wait)
    facts = {"label": labels[-1], "first_label": labels[0], "first_us": int(us[0]), "fixed": first > 0}
    if first > 0:
        return {**facts, "starts": [], "ends": [int(us[first:][ends[0]])]}
    n_starts = min(len(us), int(np.searchsorted(us, us[0] + wait, side="left")) + 1)
    last_emission = us[ends[:n_starts]]
    kept = np.append(np.flatnonzero(np.diff(last_emission)), n_starts - 1)
    return {**facts, "starts": us[kept].tolist(), "ends": last_emission[kept].tolist()}


def _composed(first: dict, second: dict, wait: int) -> dict:
    """What two pieces of a session do one after the other, the second not fixed and of the first's last label.

    A step function of the time of the last emission, as in `_summarize`: a chain that begins
    at a start of the first piece goes on behind its end, one that begins behind the first
    piece begins in the second.
    """
    starts, ends = np.asarray(second["starts"]), np.asarray(second["ends"])
    emitted = np.asarray(first["ends"])
    at = np.searchsorted(starts, emitted + wait, side="left")
    after = np.where(at < len(starts), ends[np.minimum(at, len(starts) - 1)], emitted)
    facts = {"label": second["label"], "first_label": first["first_label"], "first_us": first["first_us"], "fixed": first["fixed"]}
    if first["fixed"]:
        return {**facts, "starts": [], "ends": after.tolist()}
    starts, ends = np.append(first["starts"], starts), np.append(after, ends)
    # the last emission before is older than the first frame, so later starts are never asked for
    needed = int(np.searchsorted(starts, first["first_us"] + wait, side="left")) + 1
    starts, ends = starts[:needed], ends[:needed]
    kept = np.append(np.flatnonzero(np.diff(ends)), len(ends) - 1)
    return {**facts, "starts": starts[kept].tolist(), "ends": ends[kept].tolist()}


def emission_flags(us: np.ndarray, labels: np.ndarray, state: tuple | None, wait: int) -> np.ndarray:
    """Emission flag of each frame of ordered frames, given the state (label, time) before them.

    Goes from emission to emission: the next one is at the next change of label or at the
    first frame after the debounce time.
    """
    n = len(us)
    emitted = np.zeros(n, dtype=bool)
    if n == 0:
        return emitted
    changes = np.append(np.flatnonzero(labels[1:] != labels[:-1]) + 1, n)
    change = changes[np.searchsorted(changes, np.arange(n), side="right")]
    following = np.minimum(np.maximum(np.searchsorted(us, us + wait, side="left"), np.arange(1, n + 1)), change)
    at = 0
    if state is not None and state[0] == labels[0]:
        at = min(int(np.searchsorted(us, state[1] + wait, side="left")), int(change[0]))
    while at < n:
        emitted[at] = True
        at = int(following[at])
    return emitted


_SUMMARY = (
    "struct<label:string,first_label:string,first_us:bigint,fixed:boolean,"
    "starts:array<bigint>,ends:array<bigint>>"
)


def states_after(facts: DataFrame, wait: int) -> DataFrame:
    """Debounce state after each chunk: (session_id, chunk, label, us).

    *facts* has session_id, chunk and the summary of the chunk, one row per chunk that has
    frames. A chunk whose number is not preceded begins anew, so numbers may only be missing
    where no frame lies within the debounce time. What chunks do is composed in doubling steps: after round r a row stands for
    2^r chunks, or for all chunks before it if the state after it is known, and joins the row
    2^r chunks before. Only rows whose state is open are joined, on the key of one chunk, so
    no session is gathered however many chunks it has.
    """

    @F.pandas_udf(_SUMMARY)
    def compose(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_composed(a, b, wait) for a, b in zip(first.to_dict("records"), second.to_dict("records"))])

    # A chunk begins anew if there is none before it or that ends with another label.
    before = facts.select("session_id", (F.col("chunk") + 1).alias("chunk"), F.col("facts.label").alias("_label"))
    f = F.col("facts")
    anew = ~f["fixed"] & ~F.col("_label").eqNullSafe(f["first_label"])
    fixed = f.withField("fixed", F.lit(True)).withField("starts", F.array().cast("array<bigint>")).withField("ends", F.slice(f["ends"], 1, 1))
    rows = facts.join(before, ["session_id", "chunk"], "left").withColumn("facts", F.when(anew, fixed).otherwise(f)).drop("_label")
    distance = 1
    while True:
        rows = materialize(rows, "debounce-states")
        still_open = rows.filter(~F.col("facts.fixed"))
        if still_open.isEmpty():
            return rows.select("session_id", "chunk", F.col("facts.label").alias("label"), F.col("facts.ends")[0].alias("us"))
        earlier = rows.select("session_id", (F.col("chunk") + distance).alias("chunk"), F.col("facts").alias("_first"))
        joined = still_open.join(earlier, ["session_id", "chunk"]).select("session_id", "chunk", compose("_first", "facts").alias("facts"))
        rows = rows.filter(F.col("facts.fixed")).unionByName(joined)
        distance *= 2


def debounce(
    candidates: DataFrame, debounce_ms: float = 300.0, label: str = "stable_label", chunk_us: int | None = HOUR_US
) -> DataFrame:
    """Flag `emitted` on candidate frames, with the debounce state kept per session.

    Chunks of a session are summarised in parallel, the state before each chunk is found
    by composing the summaries (`states_after`), and the chunks are then replayed in
    parallel.
    """
    wait = int(round(debounce_ms * 1000))
    # chunks by time are at least as long as the debounce time, so that one without frames
    # makes the next begin anew; even chunks have no gaps
    chunk_us = chunk_us and max(chunk_us, wait)

    @F.pandas_udf(_SUMMARY)
    def summary(times: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [_summarize(np.asarray(t), np.asarray(n), wait) for t, n in zip(times, names)]
        return pd.DataFrame(rows)

    @F.pandas_udf("array<boolean>")
    def replay(times: pd.Series, names: pd.Series, state: pd.DataFrame) -> pd.Series:
        known = [None if pd.isna(u) else (l, int(u)) for l, u in zip(state["label"], state["us"])]
        return pd.Series([emission_flags(np.asarray(t), np.asarray(n), k, wait) for t, n, k in zip(times, names, known)])

    columns = candidates.columns
    ordered = (
        chunked(candidates, chunk_us).select("session_id", "chunk", F.struct("us", "frame_id", *_rest(columns)).alias("_frame"))
        .groupBy("session_id", "chunk")
        .agg(F.array_sort(F.collect_list("_frame")).alias("frames"))
    )
    ordered = materialize(ordered, "debounce-chunks")
    facts = ordered.select("session_id", "chunk", summary(F.col("frames.us"), F.col(f"frames.{label}")).alias("facts"))
    before = states_after(facts, wait).select(
        "session_id", (F.col("chunk") + 1).alias("chunk"), F.struct("label", F.col("us").cast("string").alias("us")).alias("_state")
    )
    nothing = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("us"))
    flags = replay(F.col("frames.us"), F.col(f"frames.{label}"), F.coalesce("_state", nothing))
    return (
        ordered.join(before, ["session_id", "chunk"], "left")
        .withColumn("_flags", flags)
        .select("session_id", F.inline(F.arrays_zip(F.col("frames").alias("frame"), F.col("_flags").alias("emitted"))))
        .select("session_id", "frame.*", "emitted")
        .select(*columns, "emitted")
    )


# --- actions -----------------------------------------------------------------


def mapped_key(label: Column, keymap: dict[str, str], aliases: dict[str, str]) -> tuple[Column, Column]:
    """(normalised label, key of the keymap or null) of a label."""

    def lookup(table: dict[str, str], key: Column) -> Column:
        if not table:
            return F.lit(None).cast("string")
        flat = [F.lit(part) for pair in sorted(table.items()) for part in pair]
        return F.try_element_at(F.create_map(*flat), key)

    key = label_key(label)
    normalized = F.coalesce(lookup(aliases, key), key)
    return normalized, F.coalesce(lookup(keymap, normalized), lookup(keymap, label))


def actions(
    voted: DataFrame,
    keymap: dict[str, str],
    aliases: dict[str, str],
    *,
    debounce_ms: float = 300.0,
    dry_run: bool = True,
    enable_dispatch: bool = False,
    chunk_us: int | None = HOUR_US,
) -> DataFrame:
    """Action row of each voted frame: what would be sent, and why not.

    `not_eligible` frames miss a threshold or are debounced, `unmapped_gesture`
    frames have no key and leave the debounce state alone. Others are
    `dry_run`, `dispatch_disabled` or `dispatched`. Nothing is sent anywhere.
    """
    normalized, key = mapped_key(F.col("stable_label"), keymap, aliases)
    eligible = F.col("meets_confidence") & F.col("meets_consensus") & (F.col("stable_label") != "")
    marked = materialize(
        voted.withColumn("normalized_gesture_label", normalized)
        .withColumn("mapped_key", key)
        .withColumn("_eligible", eligible),
        "voted-frames",
    )
    # Unmapped frames never mark the state, but the state still debounces them:
    # the last emitted label is always a mapped one, so it never equals theirs.
    candidate = F.col("_eligible") & F.col("mapped_key").isNotNull()
    live = enable_dispatch and not dry_run
    sent = "dispatched" if live else ("dry_run" if dry_run else "dispatch_disabled")
    fired = debounce(marked.filter(candidate), debounce_ms, chunk_us=chunk_us).withColumn(
        "reason", F.when(F.col("emitted"), F.lit(sent)).otherwise(F.lit("not_eligible"))
    )
    others = marked.filter(~candidate).withColumn("emitted", F.lit(False)).withColumn(
        "reason", F.when(F.col("_eligible"), F.lit("unmapped_gesture")).otherwise(F.lit("not_eligible"))
    )
    return (
        fired.unionByName(others)
        .withColumnRenamed("emitted", "would_emit")
        .withColumn("emitted", F.col("would_emit") & F.lit(live))
        .withColumn("mapped_key", F.when(F.col("reason") != "not_eligible", F.col("mapped_key")))
        .drop("_eligible")
    )
