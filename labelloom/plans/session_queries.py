"""Queries on frame sessions, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.clock import with_micros
from labelloom.operators import sessions
from labelloom.operators.telemetry import tumbling_fps
from labelloom.plans import jobs, stand_ins as given
from labelloom.plans.registry import big, query, r6
from labelloom.plans.sql_views import ACTIONS, FRAMES, VOTES
from labelloom.session import scratch_path
from labelloom.sources import tables

_INTERVALS = f"""{FRAMES}, gaps AS (
  SELECT *, (us - lag(us) OVER (PARTITION BY session_id ORDER BY us, frame_id)) / 1000.0 AS frame_interval_ms FROM frames)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = given.frames(spark, sf_dir)
    return sessions.rolling_vote(frames, chunk_us=None, **given.VOTE)


@query("rolling_vote", f"""WITH {VOTES} SELECT session_id, frame_id, stable_label, window_size, round(consensus_ratio, 6) AS consensus_ratio,
        round(avg_confidence, 6) AS avg_confidence FROM votes""")
def rolling_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _votes(spark, sf_dir)
    return rows.select(
        "session_id", "frame_id", "stable_label", big("window_size"), r6("consensus_ratio"), r6("avg_confidence")
    )


@query("label_changes", f"""WITH {VOTES}, p AS (SELECT *, lag(stable_label) OVER (PARTITION BY session_id ORDER BY us, frame_id) AS prev FROM votes)
        SELECT session_id, frame_id, stable_label FROM p WHERE stable_label IS DISTINCT FROM prev""")
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.label_changes(_votes(spark, sf_dir)).select("session_id", "frame_id", "stable_label")


@query("frame_intervals", f"""WITH {_INTERVALS} SELECT session_id, frame_id, round(frame_interval_ms, 6) AS frame_interval_ms,
        CASE WHEN frame_interval_ms > 0 THEN round(1000.0 / frame_interval_ms, 6) END AS fps FROM gaps""")
def frame_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = given.frames(spark, sf_dir)
    rows = sessions.frame_intervals(frames, None)
    return rows.select("session_id", "frame_id", r6("frame_interval_ms"), r6("fps"))


@query("stage_timings", """SELECT event_id AS frame_id, round(value, 6) AS capture_to_prediction_ms, round(value / 2, 6) AS prediction_ms,
        round(value / 4, 6) AS prediction_to_dispatch_ms, round(value * 1.75, 6) AS end_to_end_ms FROM events""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage durations from clock readings derived from the event values."""
    value = F.col("value") / 1000.0
    clock = given.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("frame_id"),
        F.lit(0.0).alias("frame_start"),
        value.alias("preprocess_end"),
        (value * 1.5).alias("predict_end"),
        (value * 1.75).alias("dispatch_end"),
    )
    names = ("capture_to_prediction_ms", "prediction_ms", "prediction_to_dispatch_ms", "end_to_end_ms")
    return sessions.stage_timings(clock).select("frame_id", *[r6(c) for c in names])


def _session_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return jobs.session_tables(
        given.frames(spark, sf_dir), vote=given.VOTE, debounce_ms=given.DEBOUNCE_MS,
        keymap=given.KEYMAP, aliases=given.KEY_ALIASES,
    )


@query("debounce", f"WITH RECURSIVE {ACTIONS} SELECT session_id, frame_id, would_emit FROM acts WHERE eligible AND key IS NOT NULL")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission flags of the eligible frames with a mapped key."""
    _, key = sessions.mapped_key(F.col("stable_label"), given.KEYMAP, given.KEY_ALIASES)
    candidates = _votes(spark, sf_dir).filter(F.col("meets_confidence") & F.col("meets_consensus") & key.isNotNull())
    rows = sessions.debounce(candidates, given.DEBOUNCE_MS, chunk_us=None)
    return rows.select("session_id", "frame_id", F.col("emitted").alias("would_emit"))


@query("actions", f"""WITH RECURSIVE {ACTIONS} SELECT session_id, frame_id, stable_label, would_emit, false AS emitted, reason,
        CASE WHEN reason = 'dry_run' THEN key END AS mapped_key FROM acts""")
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _session_tables(spark, sf_dir)["actions"]
    return rows.select("session_id", "frame_id", "stable_label", "would_emit", "emitted", "reason", "mapped_key")


@query("action_counts", f"WITH RECURSIVE {ACTIONS} SELECT reason, count(*) AS n, count(DISTINCT session_id) AS sessions FROM acts GROUP BY 1")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _session_tables(spark, sf_dir)["actions"]
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


_SUMMARY_COLUMNS = (
    "avg_fps", "fps_jitter_ms", "capture_to_prediction_avg", "capture_to_prediction_p95", "prediction_to_dispatch_avg",
    "prediction_to_dispatch_p95", "end_to_end_avg", "end_to_end_p95",
)
# Means of short decimals often end in an exact 5; a small offset before rounding
# keeps the order of summation from deciding such ties. Intervals are of the order
# of 1e7 ms, so their deviation is compared to fewer digits.
_TIE = 1e-9
_DIGITS = {c: 3 if c == "fps_jitter_ms" else 6 for c in _SUMMARY_COLUMNS}
_SUMMARY = f"""WITH {_INTERVALS}, s AS (
  SELECT g.session_id, frame_interval_ms AS gap, value * 0.6::DOUBLE AS c, value * 0.4::DOUBLE AS d, value AS e, event_type AS kind
  FROM gaps g JOIN events ON event_id = frame_id),
t AS (SELECT session_id, count(*) AS frame_count, coalesce(avg(CASE WHEN gap > 0 THEN 1000.0 / gap END), 0) AS avg_fps,
  CASE WHEN count(gap) >= 2 THEN stddev_pop(gap) ELSE 0 END AS fps_jitter_ms,
  avg(c) AS capture_to_prediction_avg, quantile_cont(c, 0.95) AS capture_to_prediction_p95,
  avg(d) AS prediction_to_dispatch_avg, quantile_cont(d, 0.95) AS prediction_to_dispatch_p95,
  avg(e) AS end_to_end_avg, quantile_cont(e, 0.95) AS end_to_end_p95,
  count(*) FILTER (kind = 'click') AS actions_emitted, count(*) FILTER (kind <> 'click') AS actions_suppressed,
  count(*) FILTER (kind <> 'error') AS detections_ok FROM s GROUP BY 1)"""


@query("runtime_summary", f"""{_SUMMARY} SELECT session_id, frame_count, {', '.join(f'round({c} + 1e-9, {d}) AS {c}' for c, d in _DIGITS.items())},
        actions_emitted, actions_suppressed, detections_ok FROM t""")
def runtime_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = given.telemetry(spark, sf_dir)
    rows = jobs.telemetry_tables(samples)["summary"]
    return rows.select(
        "session_id", "frame_count", *[F.round(F.col(c) + _TIE, d).alias(c) for c, d in _DIGITS.items()],
        "actions_emitted", "actions_suppressed", "detections_ok",
    )


@query("session_run_records", f"""{_SUMMARY} SELECT sha256('EXP-04:' || session_id) AS run_id, round(end_to_end_avg + 1e-9, 6) AS primary_ms,
        round(end_to_end_p95 + 1e-9, 6) AS end_to_end_p95_ms, frame_count::DOUBLE AS frames_processed FROM t""")
def session_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session summaries appended as run records and loaded again."""
    path = scratch_path(spark, "session-runs")
    summary = jobs.telemetry_tables(given.telemetry(spark, sf_dir))["summary"]
    tables.append_runs(jobs.session_run_record(summary), path)
    m = F.col("metrics")
    return tables.read_runs(spark, path).select(
        "run_id", F.round(m["primary"] + _TIE, 6).alias("primary_ms"),
        F.round(m["end_to_end_p95_ms"] + _TIE, 6).alias("end_to_end_p95_ms"), m["frames_processed"].alias("frames_processed"),
    )


@query("session_log", """SELECT user_id::VARCHAR AS session_id, count(*) AS event_count, round(avg(value) + 1e-9, 6) AS end_to_end_avg
        FROM events GROUP BY 1""")
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log appended as JSON lines, and the session documents made from it."""
    path = scratch_path(spark, "session-log")
    samples = given.telemetry(spark, sf_dir)
    tables.append_events(samples.select("session_id", "frame_id", "end_to_end_ms"), path)
    events = spark.read.schema("session_id string, frame_id bigint, end_to_end_ms double, timestamp_iso string").json(path)
    summary = events.groupBy("session_id").agg(F.avg("end_to_end_ms").alias("end_to_end_avg"))
    rows = tables.session_document(events, summary, path)
    mean = F.get_json_object("summary", "$.end_to_end_avg").cast("double")
    return rows.select("session_id", "event_count", F.round(mean + _TIE, 6).alias("end_to_end_avg"))


@query("fps_tumbling", """SELECT user_id::VARCHAR AS session_id, (epoch_us(ts) // 3600000000) * 3600000000 AS window_us, count(*) AS frames,
        round(count(*) / 3600.0, 6) AS fps FROM events GROUP BY 1, 2""")
def fps_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rate in one-hour windows (the batch twin of the stream)."""
    events = given.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts")
    rows = with_micros(tumbling_fps(events, 3600), "window_start", "window_us")
    return rows.select("session_id", "window_us", "frames", r6("fps"))


GAP = "12 hours"
GAP_SESSIONS = f"""WITH {FRAMES}, cut AS (SELECT *, coalesce(us - lag(us) OVER w >= 43200000000, true)::BIGINT AS new FROM frames
          WINDOW w AS (PARTITION BY session_id ORDER BY us, frame_id)),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us, frame_id) AS run FROM cut)
        SELECT session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS frames, round(avg(confidence), 6) AS avg_confidence
        FROM runs GROUP BY session_id, run"""


@query("session_gaps", GAP_SESSIONS)
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames without a gap of half a day."""
    frames = given.frames(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    return sessions.gap_sessions(frames, GAP).select("session_id", "start_us", "end_us", big("frames"), r6("avg_confidence"))
