"""Structured Streaming twins of the session operators.

Sessions are spread over the cluster by key. State per session is the last few frames, the
last emission and the last stable label. `live_sessions` takes the frames of a session in
the order of their arrival, sorted within a micro-batch; `ordered_sessions` holds them back
until the watermark has passed, so that frames may arrive in any order within the delay, and
deals the sessions to lanes, whose sessions share the calls of the state store.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, groupby, islice, repeat
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from labelloom import vocab
from labelloom.operators.classifiers import Trained
from labelloom.operators.sessions import emission_flags
from labelloom.operators.telemetry import tumbling_fps
from labelloom.plans.jobs import extract_features
from labelloom.session import RECOMMENDED_CONF, STATE_STORE, scratch_path

OUTPUT = (
    "session_id string, frame_id bigint, us bigint, label string, confidence double, stable_label string, "
    "consensus_ratio double, avg_confidence double, window_size bigint, label_changed boolean, "
    "normalized_gesture_label string, mapped_key string, would_emit boolean, emitted boolean, reason string"
)
STATE = (
    "recent_labels array<string>, recent_confidences array<double>, "
    "emitted_label string, emitted_us bigint, stable_label string"
)


@dataclass(frozen=True)
class LiveSettings:
    """Smoothing, debounce and key settings of live sessions."""

    window_size: int = 5
    min_consensus_ratio: float = 0.6
    confidence_threshold: float = 0.6
    debounce_ms: float = 300.0
    keymap: Mapping[str, str] = field(default_factory=lambda: dict(vocab.DEFAULT_KEYMAP))
    aliases: Mapping[str, str] = field(default_factory=lambda: dict(vocab.RUNTIME_LABEL_ALIASES))
    dry_run: bool = True
    enable_dispatch: bool = False
    # A session without frames for this long is forgotten; for continuous queries
    # only, since clean-up by the clock never lets a query over fixed input end.
    idle_ms: int | None = None


#: Keys of the state store that the sessions of a stream in event-time order are dealt to.
LANES = 1_024
#: Frames of a lane that wait for the watermark as one value of the state store.
PIECE_FRAMES = 2_000
#: Arriving frames of a lane that are sorted at a time.
ARRIVING_FRAMES = 50_000
#: Frames of a lane that go through the step at a time, and at most a piece more.
THROUGH_FRAMES = 20_000
#: Frames whose windows are compared at a time.
_FRAMES = 50_000


def _votes(codes: np.ndarray, confidences: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winner, its votes, number of frames and mean confidence of each window of *size* frames.

    Missing frames in front are -1. Of equal counts the label that comes first in the window wins.
    """
    out = []
    for low in range(0, len(codes) - size + 1, _FRAMES):
        part = slice(low, min(low + _FRAMES + size - 1, len(codes)))
        window = np.lib.stride_tricks.sliding_window_view(codes[part], size)
        sums = np.lib.stride_tricks.sliding_window_view(confidences[part], size).sum(axis=1)
        counts = (window[:, :, None] == window[:, None, :]).sum(axis=2)
        counts[window < 0] = 0
        best = counts.argmax(axis=1)
        frames = (window >= 0).sum(axis=1)
        rows = np.arange(len(window))
        out.append((window[rows, best], counts[rows, best], frames, sums / frames))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def act_on_sessions(sizes: Sequence[int], ids: Sequence[int], times: Sequence[int], labels: Sequence[str], confidences: Sequence[float], states: Sequence[tuple], s: LiveSettings) -> tuple[dict, list[tuple]]:
    """Columns of the action rows of the ordered frames of some sessions (labels and confidences not null), and their new states.

    The frames of a session follow those of the one before it; *sizes* has the number of each.
    """
    keep = s.window_size - 1
    ids, labels, confidences, us = list(ids), list(labels), list(confidences), np.array(times, dtype=np.int64)
    ends = np.cumsum(sizes)
    places: dict[str, int] = {}
    codes: list[int] = []
    known: list[float] = []
    firsts: list[int] = []  # where the known frames of a session begin; those missing in front are -1
    for low, high, (past_labels, past_confidences, *_) in zip((ends - sizes).tolist(), ends.tolist(), states, strict=True):
        past = min(keep, len(past_labels))
        firsts.append(len(codes) + keep - past)
        codes += [-1] * (keep - past)
        codes += [places.setdefault(n, len(places)) for n in [*past_labels[len(past_labels) - past :], *labels[low:high]]]
        known += [0.0] * (keep - past)
        known += [*past_confidences[len(past_confidences) - past :], *confidences[low:high]]
    codes, known = np.array(codes, dtype=np.int64), np.array(known, dtype=np.float64)
    names = np.array(list(places), dtype=object)
    # windows that reach over two sessions are left out
    own = np.arange(len(us)) + np.repeat(np.arange(len(sizes)) * keep, sizes)
    winner, votes, size, mean = (c[own] for c in _votes(codes, known, s.window_size))
    ratio = votes / size

    keys = [n.strip().lower().replace("-", "_").replace(" ", "_") for n in names]
    normalized = np.array([s.aliases.get(k, k) for k in keys], dtype=object)
    mapped = np.array([s.keymap.get(n) or s.keymap.get(w) for n, w in zip(normalized, names)], dtype=object)
    has_key = np.array([m is not None for m in mapped], dtype=bool)
    winners = names[winner]
    eligible = (mean >= s.confidence_threshold) & (ratio >= s.min_consensus_ratio) & (winners != "")
    candidate = np.flatnonzero(eligible & has_key[winner])
    fires = np.zeros(len(us), dtype=bool)
    before = np.concatenate([[None], winners[:-1]])
    after = []
    begin = 0
    for i, (end, stop, (_, _, last_label, last_us, stable)) in enumerate(zip(ends.tolist(), np.searchsorted(candidate, ends).tolist(), states, strict=True)):
        before[end - sizes[i]] = stable
        if stop > begin:
            part = candidate[begin:stop]
            last = None if last_us is None else (last_label, last_us)
            flags = emission_flags(us[part], winners[part], last, int(round(s.debounce_ms * 1000)))
            fires[part] = flags
            if flags.any():
                at = part[np.flatnonzero(flags)[-1]]
                last_label, last_us = winners[at], int(us[at])
        high = end + (i + 1) * keep
        recent = slice(max(firsts[i], high - s.window_size), high)
        after.append((names[codes[recent]].tolist(), known[recent].tolist(), last_label, last_us, winners[end - 1]))
        begin = stop

    live = s.enable_dispatch and not s.dry_run
    sent = "dispatched" if live else ("dry_run" if s.dry_run else "dispatch_disabled")
    out = {
        "frame_id": ids, "us": us, "label": labels, "confidence": confidences,
        "stable_label": winners, "consensus_ratio": ratio, "avg_confidence": mean, "window_size": size,
        "label_changed": winners != before, "normalized_gesture_label": normalized[winner],
        "mapped_key": np.where(fires, mapped[winner], None), "would_emit": fires, "emitted": fires & live,
        "reason": np.where(fires, sent, np.where(eligible & ~has_key[winner], "unmapped_gesture", "not_eligible")),
    }
    return out, after


def act_on_frames(session: str, frames: pd.DataFrame, state: tuple, s: LiveSettings) -> tuple[pd.DataFrame, tuple]:
    """Action rows of ordered frames (frame_id, us, label, confidence) of a session, and its new state."""
    labels, confidences = frames["label"].fillna("").tolist(), frames["confidence"].fillna(0.0).to_numpy(dtype=np.float64)
    out, (state,) = act_on_sessions([len(frames)], frames["frame_id"], frames["us"].to_numpy(dtype=np.int64), labels, confidences, [state], s)
    return pd.DataFrame({"session_id": session, **out}), state


class SessionProcessor(StatefulProcessor):
    """Votes, debounces and maps the frames of one session in the order of their arrival."""

    def __init__(self, settings: LiveSettings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value per session: one read and one write per micro-batch.
        self.state = handle.getValueState("session", STATE, self.settings.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True).sort_values(["us", "frame_id"], kind="stable")
        out, state = act_on_frames(key[0], frames, self.state.get() or ([], [], None, None, None), self.settings)
        self.state.update(state)
        yield out

    def close(self) -> None:
        pass


class OrderedProcessor(StatefulProcessor):
    """Votes, debounces and maps the frames of the sessions of a lane in the order of their times.

    The key is a lane, or a session if the rows don't name theirs. Frames wait in pieces of at
    most PIECE_FRAMES frames (more only of one time), each for a range of times: the value of
    the lane lists the times at which pieces begin and the states of its sessions, a map
    holds the frames. A batch reads and writes the pieces that its frames fall into, so its
    calls of the state store go with lanes and pieces, however many sessions there are and
    however far apart their frames. An event-time timer at the first waiting frame calls when
    the watermark has passed it; all frames up to the watermark then go some pieces at a time through
    the same step as in `SessionProcessor`. A frame that comes before one of its session that
    has gone through is put out with the reason `late` and changes nothing. Frames without a
    time are left out. A row that is put out holds the columns of a piece as arrays.
    """

    def __init__(self, settings: LiveSettings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        per_session = ", ".join(f"{c} array<{t}>" for c, t in (part.split() for part in f"session_id string, {STATE}, done_us bigint, done_id bigint".split(", ")))
        self.state = handle.getValueState("lane", f"starts array<bigint>, timer_ms bigint, {per_session}")
        self.waiting = handle.getMapState(
            "waiting", "start bigint", "us array<bigint>, session_id array<string>, frame_id array<bigint>, label array<string>, confidence array<double>"
        )

    def _read(self, start: int) -> list[tuple]:
        return list(zip(*self.waiting.getValue((start,))))

    def _write(self, frames: list[tuple]) -> list[int]:
        """Keep ordered frames as pieces of even size, cut between different times; where these begin."""
        size = -(-len(frames) // -(-len(frames) // PIECE_FRAMES))
        starts, low = [], 0
        while low < len(frames):
            high = min(low + size, len(frames))
            while high < len(frames) and frames[high][0] == frames[high - 1][0]:
                high += 1
            starts.append(frames[low][0])
            self.waiting.updateValue((frames[low][0],), tuple(list(c) for c in zip(*frames[low:high])))
            low = high
        return starts

    def _put(self, starts: list[int], frames: list[tuple]) -> list[int]:
        """Add arriving frames to the pieces of their times; where all pieces begin then."""
        if not starts:
            return self._write(sorted(frames))
        parts: dict[int, list[tuple]] = {}
        for frame in frames:
            parts.setdefault(starts[max(bisect_right(starts, frame[0]) - 1, 0)], []).append(frame)
        kept = set(starts)
        for start, part in parts.items():
            made = self._write(sorted(self._read(start) + part))
            if start not in made:
                self.waiting.removeKey((start,))
                kept.remove(start)
            kept.update(made)
        return sorted(kept)

    def _act(self, frames: list[tuple], states: dict[str, tuple]) -> dict:
        """Columns of the action rows of ordered frames; brings the states of their sessions up to date."""
        us, names, ids, labels, confidences = zip(*sorted(frames, key=itemgetter(1)))
        groups = [(name, sum(1 for _ in group)) for name, group in groupby(names)]
        sizes = [n for _, n in groups]
        out, after = act_on_sessions(sizes, ids, us, labels, confidences, [states.get(name, NO_STATE)[:5] for name, _ in groups], self.settings)
        for (name, _), end, state in zip(groups, accumulate(sizes), after, strict=True):
            states[name] = (*state, us[end - 1], ids[end - 1])
        return {"session_id": list(names), **out}

    def _step(self, arriving: Iterator[list[tuple]], watermark_ms: int, fired_ms: int | None) -> Iterator[dict]:
        """Take in arriving frames, let through those up to the watermark, set the timer for the next ones."""
        starts, timer_ms, *columns = self.state.get() or ([], None, *([] for _ in range(8)))
        states = {name: state for name, *state in zip(*columns, strict=True)}
        limit, starts = watermark_ms * 1000, list(starts)
        for part in arriving:
            frames, late = [], []
            for frame in part:
                *_, done_us, done_id = states.get(frame[1], NO_STATE)
                (frames if done_us is None or (frame[0], frame[2]) > (done_us, done_id) else late).append(frame)
            if late:
                known = dict(zip(("us", "session_id", "frame_id", "label", "confidence"), map(list, zip(*late))))
                never = [False] * len(late)
                yield {c: [None] * len(late) for c in COLUMNS} | known | {"would_emit": never, "emitted": never, "reason": ["late"] * len(late)}
            if frames:
                starts = self._put(starts, frames)
        through: list[tuple] = []
        while starts and starts[0] <= limit:
            start = starts.pop(0)
            frames = self._read(start)
            ready = bisect_right(frames, limit, key=itemgetter(0))
            self.waiting.removeKey((start,))
            if ready < len(frames):
                starts = self._write(frames[ready:]) + starts
            through += frames[:ready]
            if len(through) >= THROUGH_FRAMES:
                yield self._act(through, states)
                through = []
        if through:
            yield self._act(through, states)
        next_ms = starts[0] // 1000 + 1 if starts else None
        # the timer that has called is removed by Spark
        if timer_ms not in (None, fired_ms, next_ms):
            self.handle.deleteTimer(timer_ms)
        if next_ms is not None and (next_ms != timer_ms or timer_ms == fired_ms):
            self.handle.registerTimer(next_ms)
        columns = map(list, zip(*((name, *state) for name, state in states.items()))) if states else ([] for _ in range(8))
        self.state.update((starts, next_ms, *columns))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        parts = iter(lambda: list(islice(rows, ARRIVING_FRAMES)), [])
        yield from map(piece_of_columns, self._step((frames_of_rows(part, key[0]) for part in parts), timerValues.getCurrentWatermarkInMs(), None))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from map(piece_of_columns, self._step(iter(()), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


class LaneProcessor(OrderedProcessor):
    """`OrderedProcessor` for data frames in and out, which are several times cheaper to move than rows.

    They have no nulls in `us` and `frame_id`, since these would turn the numbers into floats:
    `ts` and `numbered` tell where one is missing.
    """

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from map(data_of_columns, self._step(frames_of_data(rows), timerValues.getCurrentWatermarkInMs(), None))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from map(data_of_columns, self._step(iter(()), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))


COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]
PIECE = Row(*COLUMNS)
#: State of a session without frames: as STATE, then time and number of the last frame that has gone through.
NO_STATE = ([], [], None, None, None, None, None)


def frames_of_rows(rows: list[Row], session: Any) -> list[tuple]:
    """Frames with a time as (us, session, frame_id, label, confidence); rows that don't name a session are of *session*."""
    fields, values = list(rows[0].__fields__), list(map(tuple, rows))
    names = map(itemgetter(fields.index("session_id")), values) if "session_id" in fields else repeat(session)
    pick = itemgetter(*(fields.index(c) for c in ("us", "frame_id", "label", "confidence")))
    return [
        (us, name, frame_id, label or "", confidence if confidence and confidence == confidence else 0.0)
        for name, (us, frame_id, label, confidence) in zip(names, map(pick, values)) if us is not None
    ]


def frames_of_data(parts: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Frames with a time as in `frames_of_rows`, some ARRIVING_FRAMES at a time."""
    frames: list[tuple] = []
    for part in parts:
        part = part[part["ts"].notna()]
        ids = part["frame_id"].tolist() if part["numbered"].all() else [n if known else None for n, known in zip(part["frame_id"].tolist(), part["numbered"])]
        labels = part["label"].where(part["label"].notna(), "").tolist()
        frames += zip(part["us"].tolist(), part["session_id"].tolist(), ids, labels, part["confidence"].astype("float64").fillna(0.0).tolist())
        if len(frames) >= ARRIVING_FRAMES:
            yield frames
            frames = []
    if frames:
        yield frames


def piece_of_columns(columns: dict) -> Row:
    """Action rows as one row of arrays."""
    return PIECE(*(columns[c] if isinstance(columns[c], list) else columns[c].tolist() for c in COLUMNS))


def data_of_columns(columns: dict) -> pd.DataFrame:
    """Action rows as a data frame, with missing values as None."""
    return pd.DataFrame({c: np.array(columns[c], dtype=object) if isinstance(columns[c], list) else columns[c] for c in COLUMNS}, copy=False)


def live_sessions(frames: DataFrame, settings: LiveSettings = LiveSettings()) -> DataFrame:
    """Smoothed, debounced action rows of a stream of classified frames.

    Frames have session_id, frame_id, us, label and confidence. The state of this
    operator needs the RocksDB state store, so the session is set to it.
    """
    frames.sparkSession.conf.set(STATE_STORE, RECOMMENDED_CONF[STATE_STORE])
    narrow = frames.select("session_id", "frame_id", "us", "label", "confidence")
    return narrow.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(settings),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="none" if settings.idle_ms is None else "processingTime",
    )


def ordered_sessions(frames: DataFrame, settings: LiveSettings = LiveSettings(), delay: str = "10 seconds", lanes: int = LANES) -> DataFrame:
    """`live_sessions` for frames that arrive out of order by less than *delay*.

    A frame is put out once the watermark, *delay* behind the latest time of all sessions,
    has passed it. Frames behind the watermark on arrival are dropped before they reach
    a session and counted by the query (`dropped_frames`). Frames without a session only move
    the watermark, as `closing_frame` does.

    Sessions are dealt to *lanes* by their hash; a checkpoint goes on with the number it began
    with. The frames of a lane wait in pieces of bounded size. The states of its sessions are one
    value, read and written by each batch that has frames of the lane: many millions of sessions want more lanes.
    """
    frames.sparkSession.conf.set(STATE_STORE, RECOMMENDED_CONF[STATE_STORE])
    timed = frames.select("session_id", "frame_id", "us", "label", "confidence", F.timestamp_micros("us").alias("ts"))
    # the condition names ts, else it would be moved in front of the watermark
    timed = timed.withWatermark("ts", delay).filter(F.col("session_id").isNotNull() | F.col("ts").isNull())
    zero = F.lit(0).cast("bigint")
    dealt = timed.withColumns({
        "lane": F.pmod(F.xxhash64("session_id"), F.lit(lanes)), "numbered": F.col("frame_id").isNotNull(),
        "us": F.coalesce("us", zero), "frame_id": F.coalesce("frame_id", zero),
    })
    return dealt.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=LaneProcessor(settings), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime",
    )


def closing_frame(frames: DataFrame, us: int) -> DataFrame:
    """One row in the layout of *frames* without a session, at a time that closes all before it."""
    kinds = dict(frames.dtypes)
    empty = [F.lit(us).cast(kinds[c]) if c == "us" else F.lit(None).cast(kinds[c]) for c in frames.columns]
    return frames.sparkSession.range(1).select(*[e.alias(c) for e, c in zip(empty, frames.columns)])


def dropped_frames(query: StreamingQuery) -> DataFrame:
    """Frames that a query dropped behind the watermark: (batch_id, dropped) of each micro-batch that did."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    counts: dict[int, int] = {}
    for progress in query.recentProgress:
        dropped = sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
        if dropped:
            counts[progress["batchId"]] = dropped
    return spark.createDataFrame(sorted(counts.items()), "batch_id bigint, dropped bigint")


def frame_stream(spark: SparkSession, path: str, schema: Any, fmt: str = "parquet", **options: Any) -> DataFrame:
    """Frames arriving as files of a folder (or image files with `binaryFile`).

    *path* is read as a pattern, which lets it also name a single file.
    """
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.format(fmt).options(**options)
    return (reader if fmt == "binaryFile" else reader.schema(schema)).load(path)


def fps_stream(frames: DataFrame, seconds: int = 5, late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Frame rate per session and window; a window closes *late* after its end."""
    return tumbling_fps(frames.withWatermark(ts, late), seconds, ts)


def score_stream(samples: DataFrame, model: Trained, family: str, **options: Any) -> DataFrame:
    """Features and prediction of each arriving sample, flags kept alongside.

    The same column functions as in batch. session_id, frame_id and us are passed through
    if there. Nearest neighbours need a join with the whole training table and are for
    batch scoring only.
    """
    if model.algorithm == "knn":
        raise ValueError("nearest-neighbour models score in batch only")
    passed = tuple(c for c in ("session_id", "frame_id", "us") if c in samples.columns)
    scored = model.transform(extract_features(samples, family, keep=passed, **options))
    return scored.select(
        *passed,
        "sample_id",
        F.col("predicted_label").alias("label"),
        F.array_max("probability").alias("confidence"),
        F.col("probability").alias("scores"),
        "extraction_ok",
        "quality_flags",
    )


def write_events(events: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Append a stream to a folder of files; the checkpoint makes it exactly once.

    All input present at the start is processed, then the query ends.
    """
    return (
        events.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_per_batch(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One folder per micro-batch, overwritten when the batch is repeated.

    Splits each batch into the event log and the actions that would be sent.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # else the stateful operator runs once for each of the two writes
        for name, rows in (("events", batch), ("actions", batch.filter("would_emit"))):
            rows.write.mode("overwrite").json(f"{path}/{name}/batch_id={batch_id}")
        batch.unpersist()

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_end(query: StreamingQuery) -> None:
    """Wait for a query over the input at hand."""
    query.awaitTermination()


def run_for(query: StreamingQuery, seconds: float) -> None:
    """Let a continuous query run for a limited time."""
    query.awaitTermination(seconds)
    query.stop()


def drained(events: DataFrame, name: str) -> DataFrame:
    """Run a stream over the input at hand into the shared folder; read the result."""
    spark = events.sparkSession
    path = scratch_path(spark, name)
    run_to_end(write_events(events, path, scratch_path(spark, f"{name}-checkpoint"), "parquet"))
    return spark.read.schema(events.schema).parquet(path)


def drained_totals(totals: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over the input at hand; read its last complete result.

    Every micro-batch replaces the whole result, so no window is held back at the end.
    """
    spark = totals.sparkSession
    path = scratch_path(spark, name)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run_to_end(
        totals.writeStream.foreachBatch(replace).outputMode("complete")
        .option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    )
    return spark.read.schema(totals.schema).parquet(path)
