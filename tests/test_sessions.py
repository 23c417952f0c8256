import random
import statistics
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from labelloom import vocab
from labelloom.operators import sessions
from labelloom.operators.telemetry import runtime_summary, tumbling_fps
from labelloom.streaming import live

FRAMES = "session_id string, frame_id bigint, us bigint, label string, confidence double"


class Reference:
    """Vote and debounce of one session, frame by frame."""

    def __init__(self, size, ratio, threshold, wait_ms, keymap, aliases):
        self.args = size, ratio, threshold, wait_ms * 1000, keymap, aliases
        self.window, self.last = [], None

    def step(self, us, label, confidence):
        size, ratio, threshold, wait, keymap, aliases = self.args
        self.window = (self.window + [(label, confidence)])[-size:]
        names = [w[0] for w in self.window]
        stable = max(dict.fromkeys(names), key=names.count)
        share = names.count(stable) / len(names)
        mean = sum(w[1] for w in self.window) / len(names)
        if not (mean >= threshold and share >= ratio and stable):
            return stable, "not_eligible"
        if self.last and self.last[0] == stable and us - self.last[1] < wait:
            return stable, "not_eligible"
        if keymap.get(aliases.get(stable, stable)) is None:
            return stable, "unmapped_gesture"
        self.last = (stable, us)
        return stable, "dry_run"


def random_frames(seed, n=600, sessions_=4, step=400_000, sticky=0.8):
    rnd = random.Random(seed)
    rows, us, label = [], 0, "palm"
    for i in range(n):
        us += rnd.choice([0, 1, step // 4, step, 3 * step])
        if rnd.random() > sticky:
            label = rnd.choice(["palm", "fist", "thumb", "wave", ""])
        # Half of all frames belong to one session.
        session = "hot" if rnd.random() < 0.5 else f"s{rnd.randrange(sessions_)}"
        rows.append((session, i, us, label, rnd.choice([0.3, 0.6, 0.9])))
    return rows


SETTINGS = {"window_size": 4, "min_consensus_ratio": 0.5, "confidence_threshold": 0.5}


def expected(rows, wait_ms):
    out, states = {}, {}
    for session, frame, us, label, confidence in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        state = states.setdefault(
            session, Reference(4, 0.5, 0.5, wait_ms, vocab.DEFAULT_KEYMAP, vocab.RUNTIME_LABEL_ALIASES)
        )
        out[frame] = state.step(us, label, confidence)
    return out


@pytest.mark.parametrize("seed, chunk_us, sticky", [(1, 1_000_000, 0.8), (2, 7_000_000, 0.99), (3, 10**12, 0.5), (4, 900_000, 1.0)])
def test_batch_sessions_equal_frame_by_frame(spark, seed, chunk_us, sticky):
    """Chunks cut sessions anywhere, also inside chains of emissions."""
    rows = random_frames(seed, sticky=sticky)
    df = spark.createDataFrame(rows, FRAMES)
    voted = sessions.rolling_vote(df, chunk_us=chunk_us, **SETTINGS)
    acted = sessions.actions(voted, vocab.DEFAULT_KEYMAP, vocab.RUNTIME_LABEL_ALIASES, debounce_ms=900, chunk_us=chunk_us)
    got = {r["frame_id"]: (r["stable_label"], r["reason"]) for r in acted.collect()}
    assert got == expected(rows, 900)


def test_vote_and_debounce_timeline(spark):
    times = [0, 50, 100, 200, 1000]
    rows = [("s", i, 1_000_000_000 + t * 1000, "Palm", 0.9) for i, t in enumerate(times)]
    voted = sessions.rolling_vote(spark.createDataFrame(rows, FRAMES), 3, 0.67, 0.5)
    flags = sessions.debounce(voted.filter("frame_id >= 2"), 500.0)
    assert [r["emitted"] for r in flags.orderBy("frame_id").collect()] == [True, False, True]


def test_changes_and_intervals_across_chunks(spark):
    rows = random_frames(5)
    df = spark.createDataFrame(rows, FRAMES)
    voted = sessions.rolling_vote(df, chunk_us=1_500_000, **SETTINGS)
    changed = {r["frame_id"] for r in sessions.label_changes(voted).collect()}
    stable, before, want, gaps = expected(rows, 900), {}, set(), {}
    last = {}
    for session, frame, us, _, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if before.get(session) != stable[frame][0]:
            want.add(frame)
        before[session] = stable[frame][0]
        gaps[frame] = None if session not in last else (us - last[session]) / 1000
        last[session] = us
    assert changed == want
    got = {r["frame_id"]: (r["frame_interval_ms"], r["fps"]) for r in sessions.frame_intervals(df, 1_500_000).collect()}
    assert {k: v[0] for k, v in got.items()} == gaps
    assert all((fps is None) == (not gap) for gap, fps in got.values())


def test_chunk_fits_dense_sessions(spark):
    df = spark.range(5000).select(F.lit("s").alias("session_id"), (F.col("id") * 1000).alias("us"))
    chunk = sessions.fit_chunk(df, 10**9, 10_000, 500)
    most = df.groupBy((F.col("us") / chunk).cast("bigint")).count().agg(F.max("count")).first()[0]
    assert most <= 500
    assert sessions.fit_chunk(df, 10**9, 10_000, 10**6) == 10**9


def act(spark, label, keymap=vocab.DEFAULT_KEYMAP, **mode):
    row = spark.createDataFrame([("s", 0, 0, label, 1.0)], FRAMES)
    acted = sessions.actions(sessions.rolling_vote(row), keymap, vocab.RUNTIME_LABEL_ALIASES, **mode)
    return acted.first()


def test_action_reasons(spark):
    row = act(spark, "Thumb", dry_run=False, enable_dispatch=True)
    assert (row["normalized_gesture_label"], row["mapped_key"], row["emitted"], row["reason"]) == ("like", "up", True, "dispatched")
    row = act(spark, "palm", enable_dispatch=True)
    assert (row["emitted"], row["would_emit"], row["reason"], row["mapped_key"]) == (False, True, "dry_run", "space")
    row = act(spark, "fist", dry_run=False)
    assert (row["emitted"], row["reason"]) == (False, "dispatch_disabled")
    row = act(spark, "Wave Bye")
    assert (row["reason"], row["mapped_key"]) == ("unmapped_gesture", None)
    assert act(spark, "Odd One", {"Odd One": "x"})["mapped_key"] == "x"


SAMPLES = "session_id string, end_to_end_ms double, capture_to_prediction_ms double, prediction_to_dispatch_ms double, frame_interval_ms double, fps double, action_emitted boolean, action_suppressed boolean, detection_ok boolean"


def test_runtime_summary(spark):
    rows = [
        ("s", e, None, 1.0, i, f, e == 10.0, e != 10.0, True)
        for e, i, f in [(10.0, 33.0, 30.0), (20.0, 40.0, 25.0), (30.0, 50.0, 20.0), (40.0, 66.0, 15.0)]
    ] + [("t", 5.0, None, None, None, None, None, None, None)]
    got = {r["session_id"]: r for r in runtime_summary(spark.createDataFrame(rows, SAMPLES)).collect()}
    s = got["s"]
    assert (s["frame_count"], s["avg_fps"], s["end_to_end_avg"]) == (4, 22.5, 25.0)
    assert s["end_to_end_p95"] == pytest.approx(38.5) and s["capture_to_prediction_p95"] == 0.0
    assert s["fps_jitter_ms"] == pytest.approx(statistics.pstdev([33, 40, 50, 66]))
    assert (s["actions_emitted"], s["actions_suppressed"], s["detections_ok"]) == (1, 3, 4)
    assert (got["t"]["end_to_end_p95"], got["t"]["fps_jitter_ms"], got["t"]["detections_ok"]) == (5.0, 0.0, 0)


def test_stage_timings(spark):
    row = spark.createDataFrame([(1.0, 1.25, 1.5, None)], "frame_start double, preprocess_end double, predict_end double, dispatch_end double")
    got = sessions.stage_timings(row).first()
    assert (got["capture_to_prediction_ms"], got["prediction_ms"], got["end_to_end_ms"]) == (250.0, 250.0, 500.0)
    assert got["prediction_to_dispatch_ms"] is None


# --- streams -----------------------------------------------------------------


def stream_of(spark, rows, tmp_path, parts):
    """Frames as a stream of several files, in event order."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    size = -(-len(rows) // parts)
    folder = tmp_path / "in"
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], FRAMES)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return live.frame_stream(spark, str(folder), schema, maxFilesPerTrigger="1")


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    rows = random_frames(6, n=300)
    settings = live.LiveSettings(**SETTINGS, debounce_ms=900)
    out = live.drained(live.live_sessions(stream_of(spark, rows, tmp_path, 3), settings), "live").collect()
    assert {r["frame_id"]: (r["stable_label"], r["reason"]) for r in out} == expected(rows, 900)


def test_event_log_and_actions_per_batch(spark, tmp_path):
    rows = random_frames(7, n=100)
    events = live.live_sessions(stream_of(spark, rows, tmp_path, 1), live.LiveSettings(**SETTINGS, debounce_ms=900))
    live.run_to_end(live.write_per_batch(events, str(tmp_path / "out"), str(tmp_path / "check")))
    logged = spark.read.schema(live.OUTPUT).json(str(tmp_path / "out/events"))
    sent = spark.read.schema(live.OUTPUT).json(str(tmp_path / "out/actions"))
    assert logged.count() == 100
    assert sent.count() == sum(reason == "dry_run" for _, reason in expected(rows, 900).values())


def test_fps_stream_equals_batch_but_for_the_open_window(spark, tmp_path):
    rows = random_frames(8, n=200)
    ts = F.timestamp_micros("us").alias("ts")
    stream = stream_of(spark, rows, tmp_path, 1).select("session_id", ts)
    got = live.drained(live.fps_stream(stream, 5, "1 second"), "fps").collect()
    batch = tumbling_fps(spark.createDataFrame(rows, FRAMES).select("session_id", ts), 5)
    end = max(r[2] for r in rows) - 1_000_000
    closed = batch.filter(F.unix_micros("window_start") + 5_000_000 <= end).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, closed)) and got


def test_run_for_a_limited_time(spark, tmp_path):
    rows = random_frames(9, n=10)
    query = (
        stream_of(spark, rows, tmp_path, 1).writeStream.format("memory").queryName("limited")
        .option("checkpointLocation", str(tmp_path / "c")).start()
    )
    live.run_for(query, 3)
    assert not query.isActive


def test_debounce_state_passes_through_many_chunks(spark):
    """Chunks as short as the debounce time, without any gap or change that would begin anew."""
    rnd, rows = random.Random(11), []
    for session, n in (("long", 1500), ("short", 40), ("one", 1)):
        us = 0
        for i in range(n):
            us += rnd.choice([0, 50_000, 120_000, 333_000])
            rows.append((session, i, us, "palm", 1.0))
    rows.append(("long", 1500, 10**10, "palm", 1.0))
    flagged = sessions.debounce(spark.createDataFrame(rows, FRAMES), 900.0, "label", chunk_us=900_000)
    got = {(r["session_id"], r["frame_id"]): r["emitted"] for r in flagged.collect()}
    last, want = {}, {}
    for session, frame, us, _, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[session, frame] = session not in last or us - last[session] >= 900_000
        if want[session, frame]:
            last[session] = us
    assert got == want
    assert sessions.debounce(spark.createDataFrame([], FRAMES), 900.0, "label").count() == 0


def test_disordered_stream_equals_batch(spark, tmp_path):
    rows = random_frames(12, n=240)
    rnd = random.Random(13)
    arrived = sorted(rows, key=lambda r: r[2] + rnd.randrange(5_000_000))
    folder, out, check = (str(tmp_path / name) for name in ("in", "out", "check"))
    settings = live.LiveSettings(**SETTINGS, debounce_ms=900)
    end = max(r[2] for r in rows) + 60_000_000
    late = [(s, -1 - f, u, label, c) for s, f, u, label, c in rows[:7]]
    dropped = []
    frame = lambda part: spark.createDataFrame(part, FRAMES)
    for part in (frame(arrived[:100]), frame(arrived[100:]), live.closing_frame(frame(rows), end), frame(late)):
        part.coalesce(1).write.mode("append").parquet(folder)
        acted = live.ordered_sessions(live.frame_stream(spark, folder, frame(rows).schema), settings, "5 seconds")
        query = live.write_events(acted, out, check, "parquet")
        live.run_to_end(query)
        dropped.append(sum(r["dropped"] for r in live.dropped_frames(query).collect()))
    found = spark.read.schema(live.OUTPUT).parquet(out).collect()
    assert {r["frame_id"]: (r["stable_label"], r["reason"]) for r in found} == expected(rows, 900)
    assert len(found) == len(rows) and dropped == [0, 0, 0, 7]


def test_gap_sessions_in_batch_and_as_a_stream(spark, tmp_path):
    rows = random_frames(14, n=200, step=900_000)
    runs = {}
    for session, _, us, _, c in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine = runs.setdefault(session, [])
        if not mine or us - mine[-1][1] >= 2_000_000:
            mine.append([us, us, 0, 0.0])
        mine[-1][1:] = [us, mine[-1][2] + 1, mine[-1][3] + c]
    want = {(s, a, b, n): total / n for s, mine in runs.items() for a, b, n, total in mine}
    ts = F.timestamp_micros("us")
    found = sessions.gap_sessions(spark.createDataFrame(rows, FRAMES).withColumn("ts", ts), "2 seconds").collect()
    assert {tuple(r)[:4]: pytest.approx(r["avg_confidence"]) for r in found} == want
    stream = stream_of(spark, [*rows, ("", -1, 10**10, "", 0.0)], tmp_path, 3).withColumn("ts", ts).withWatermark("ts", "5 seconds")
    found = live.drained(sessions.gap_sessions(stream, "2 seconds"), "gaps").filter("session_id <> ''").collect()
    assert {tuple(r)[:4]: pytest.approx(r["avg_confidence"]) for r in found} == want


@pytest.mark.parametrize("most", [7, 40])
def test_even_chunks_of_dense_and_sparse_sessions(spark, monkeypatch, most):
    rows = random_frames(15, n=400, step=30_000, sticky=0.97) + [(f"sparse{i}", 1000 + i, i * 10**9, "palm", 0.9) for i in range(5)]
    rows += [("burst", 2000 + i, -5_000_000 + i % 3, "palm", 0.9) for i in range(60)]  # a slot with more frames than a chunk
    df = spark.createDataFrame(rows, FRAMES).repartition(4)
    sizes = {}
    for r in sessions.even_chunks(df, most, 100_000).collect():
        sizes.setdefault(r["session_id"], {}).setdefault(r["chunk"], []).append((r["us"], r["frame_id"]))
    assert sum(len(f) for chunks in sizes.values() for f in chunks.values()) == len(rows)
    for session, chunks in sizes.items():
        assert sorted(chunks) == list(range(len(chunks)))
        for number in range(1, len(chunks)):
            assert max(chunks[number - 1])[0] < min(chunks[number])[0]
        slots = max(sum(1 for s, _, us, *_ in rows if s == session and us // 100_000 == u // 100_000) for name, _, u, *_ in rows if name == session)
        assert all(len(f) < most + slots for f in chunks.values())
    assert all(len(sizes[f"sparse{i}"]) == 1 for i in range(5)) and len(sizes["hot"]) > 3
    # results don't depend on the cuts
    monkeypatch.setattr(sessions.even_chunks, "__defaults__", (most, 100_000))
    voted = sessions.rolling_vote(df, chunk_us=None, **SETTINGS)
    acted = sessions.actions(voted, vocab.DEFAULT_KEYMAP, vocab.RUNTIME_LABEL_ALIASES, debounce_ms=900, chunk_us=None)
    assert {r["frame_id"]: (r["stable_label"], r["reason"]) for r in acted.collect()} == expected(rows, 900)
    assert sessions.even_chunks(df.limit(0)).count() == 0


class StateInMemory:
    """Value, map and timers of one session, with the number of calls."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, name, schema, ttl=None):
        return self

    def getMapState(self, name, key, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def run(self, processor, frames, watermark_ms):
        """Rows of one micro-batch: the arriving frames, then the timers that the watermark has passed."""
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
        rows = list(processor.handleInputRows(("s",), iter([Row(**f) for f in frames]), values)) if frames else []
        for ms in sorted(t for t in self.timers if t <= watermark_ms):
            if ms in self.timers:
                rows += processor.handleExpiredTimer(("s",), values, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))
                self.timers.remove(ms)
        return [dict(zip(live.COLUMNS[1:], row)) for piece in rows for row in zip(*piece[1:])]


def frames_of(rows):
    return [dict(zip(("frame_id", "us", "label", "confidence"), r[1:])) for r in rows]


def test_waiting_frames_far_apart_cost_few_calls_of_the_state():
    """As many calls for frames a day apart as for those of one second."""
    rows = [("s", i, (i + 1) * 86_400_000_000, "palm", 0.9) for i in range(300)]
    state, processor = StateInMemory(), live.OrderedProcessor(live.LiveSettings(**SETTINGS))
    processor.init(state)
    assert state.run(processor, frames_of(rows), 0) == []
    assert state.calls <= 2
    out = state.run(processor, [], 10**12)
    assert [r["frame_id"] for r in out] == list(range(300)) and state.calls <= 6
    assert not state.map and not state.timers


@pytest.mark.parametrize("size", [3, 11, 10_000])
def test_pieces_of_waiting_frames_keep_the_order(monkeypatch, size):
    monkeypatch.setattr(live, "PIECE_FRAMES", size)
    monkeypatch.setattr(live, "ARRIVING_FRAMES", 2 * size)
    rows = [("s", *r[1:]) for r in random_frames(16, n=400)]
    rows += [("s", 1000 + i, rows[50][2], "palm", 0.9) for i in range(9)]  # one time with more frames than a piece
    rnd = random.Random(17)
    arrived = sorted(rows, key=lambda r: r[2] + rnd.randrange(5_000_000))
    state, processor = StateInMemory(), live.OrderedProcessor(live.LiveSettings(**SETTINGS, debounce_ms=900))
    processor.init(state)
    out, watermark = [], 0
    for low in range(0, len(arrived), 30):
        part = arrived[low : low + 30]
        out += state.run(processor, frames_of(part), watermark)
        watermark = max(watermark, max(r[2] for r in part) // 1000 - 5_000)
        out += state.run(processor, [], watermark)
        assert len(state.timers) == bool(state.map)
        assert all(len(set(piece[0])) == 1 or len(piece[0]) <= size + 9 for piece in state.map.values())
    out += state.run(processor, [], 10**9)
    assert [(r["us"], r["frame_id"]) for r in out] == sorted((r[2], r[1]) for r in rows)
    assert {r["frame_id"]: (r["stable_label"], r["reason"]) for r in out} == expected(rows, 900)
    late = state.run(processor, frames_of(rows[:3]), 10**9)
    assert [r["reason"] for r in late] == ["late"] * 3 and not state.map


def data_of(rows):
    """Frames of a lane as the data frames that Spark hands over."""
    frames = pd.DataFrame(rows, columns=["session_id", "frame_id", "us", "label", "confidence"])
    return frames.assign(lane=0, ts=pd.to_datetime(frames["us"], unit="us"), numbered=True)


def run_lane(processor, state, rows, watermark_ms):
    values = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
    data = data_of(rows)
    out = list(processor.handleInputRows((0,), iter([data[i : i + 500] for i in range(0, len(data), 500)]), values)) if rows else []
    for ms in sorted(t for t in state.timers if t <= watermark_ms):
        out += processor.handleExpiredTimer((0,), values, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))
        state.timers.remove(ms)
    return [r for part in out for r in part.to_dict("records")]


def test_sessions_of_a_lane_share_calls_of_the_state():
    """Hundreds of sessions cost as many calls, timers and batches of rows as one."""
    rows = [(f"s{i % 300}", i, (i + 1) * 1_000_000, "palm", 0.9) for i in range(1500)]
    state, processor = StateInMemory(), live.LaneProcessor(live.LiveSettings(**SETTINGS))
    processor.init(state)
    assert run_lane(processor, state, rows, 0) == []
    assert state.calls == 1 and len(state.timers) == 1
    out = run_lane(processor, state, [], 10**9)
    assert state.calls == 3 and not state.map and not state.timers
    assert {r["frame_id"]: (r["stable_label"], r["reason"]) for r in out} == expected(rows, 300)


@pytest.mark.parametrize("piece, through", [(7, 5), (50, 40), (2_000, 20_000)])
def test_lane_keeps_the_sessions_apart(monkeypatch, piece, through):
    """Windows, debounce, changes and lateness are those of each session, over pieces and batches."""
    monkeypatch.setattr(live, "PIECE_FRAMES", piece)
    monkeypatch.setattr(live, "THROUGH_FRAMES", through)
    rows = random_frames(18, n=500, sessions_=40)
    rnd = random.Random(19)
    arrived = sorted(rows, key=lambda r: r[2] + rnd.randrange(5_000_000))
    state, processor = StateInMemory(), live.LaneProcessor(live.LiveSettings(**SETTINGS, debounce_ms=900))
    processor.init(state)
    out, watermark = [], 0
    for low in range(0, len(arrived), 60):
        part = arrived[low : low + 60]
        out += run_lane(processor, state, part, watermark)
        watermark = max(watermark, max(r[2] for r in part) // 1000 - 5_000)
        out += run_lane(processor, state, [], watermark)
    out += run_lane(processor, state, [], 10**9)
    assert {r["frame_id"]: (r["stable_label"], r["reason"]) for r in out} == expected(rows, 900) and len(out) == len(rows)
    stable = {}
    for r in out:
        assert r["label_changed"] == (stable.get(r["session_id"]) != r["stable_label"])
        stable[r["session_id"]] = r["stable_label"]
    last = max(rows, key=lambda r: r[2])
    late = run_lane(processor, state, [(last[0], -1, 1, "palm", 0.9), ("new", -2, 1, "palm", 0.9)], 10**9)
    assert {r["frame_id"]: r["reason"] for r in late} == {-1: "late", -2: "dry_run"}


def test_ordered_stream_takes_frames_without_number_or_time(spark, tmp_path):
    rows = [("a", 2**60 + 1, 1_000_000, None, None), ("a", None, 2_000_000, "palm", 0.9), ("b", 5, None, "palm", 0.9), ("b", 6, 3_000_000, "fist", float("nan"))]
    frames = spark.createDataFrame(rows, FRAMES)
    folder = str(tmp_path / "in")
    frames.union(live.closing_frame(frames, 10**9)).coalesce(1).write.parquet(folder)
    acted = live.ordered_sessions(live.frame_stream(spark, folder, frames.schema), live.LiveSettings(**SETTINGS), "1 second")
    found = {(r["session_id"], r["frame_id"], r["us"], r["label"], r["confidence"]) for r in live.drained(acted, "odd").collect()}
    assert found == {("a", 2**60 + 1, 1_000_000, "", 0.0), ("a", None, 2_000_000, "palm", 0.9), ("b", 6, 3_000_000, "fist", 0.0)}
