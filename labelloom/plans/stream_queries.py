"""Queries that run as streams over the given event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.clock import with_micros
from labelloom.operators import classifiers, sessions
from labelloom.plans import jobs, stand_ins as given
from labelloom.plans.registry import big, query, r6
from labelloom.plans.session_queries import GAP, GAP_SESSIONS
from labelloom.plans.sql_views import ACTIONS
from labelloom.session import materialize, scratch_path
from labelloom.streaming import live

SETTINGS = live.LiveSettings(
    **given.VOTE, debounce_ms=given.DEBOUNCE_MS, keymap=given.KEYMAP, aliases=given.KEY_ALIASES
)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return live.frame_stream(spark, path, spark.read.parquet(path).schema)


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = given.frames_of(with_micros(_event_stream(spark, sf_dir)))
    return live.live_sessions(frames, SETTINGS)


@query("stream_sessions", f"""WITH RECURSIVE {ACTIONS}
        SELECT a.session_id, a.frame_id, a.stable_label, round(v.consensus_ratio, 6) AS consensus_ratio,
               round(v.avg_confidence, 6) AS avg_confidence, a.would_emit, a.reason
        FROM acts a JOIN votes v USING (session_id, frame_id)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful vote and debounce; equal to the batch operators."""
    rows = live.drained(_acted(spark, sf_dir), "stream-sessions")
    return rows.select(
        "session_id", "frame_id", "stable_label", r6("consensus_ratio"), r6("avg_confidence"), "would_emit", "reason"
    )


@query("stream_actions", f"""WITH RECURSIVE {ACTIONS}
        SELECT 'events' AS sink, count(*) AS n, count(DISTINCT session_id) AS sessions FROM acts
        UNION ALL SELECT 'actions', count(*), count(DISTINCT session_id) FROM acts WHERE would_emit""")
def stream_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log and actions written per micro-batch, then counted."""
    path = scratch_path(spark, "stream-actions")
    live.run_to_end(
        live.write_per_batch(_acted(spark, sf_dir), path, scratch_path(spark, "stream-actions-checkpoint"))
    )
    counts = [
        spark.read.schema("session_id string").json(f"{path}/{name}").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions")
        ).select(F.lit(name).alias("sink"), "n", "sessions")
        for name in ("events", "actions")
    ]
    return counts[0].unionByName(counts[1])


@query("stream_fps", """WITH w AS (SELECT user_id::VARCHAR AS session_id, epoch_us(ts) // 86400000000 AS d, count(*) AS frames FROM events GROUP BY 1, 2)
        SELECT session_id, d * 86400000000 AS window_us, frames, round(frames / 86400.0, 6) AS fps FROM w""")
def stream_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily frame rate of all days, the last one included."""
    events = with_micros(_event_stream(spark, sf_dir))
    frames = events.select(
        F.col("user_id").cast("string").alias("session_id"), F.timestamp_micros("us").alias("ts")
    )
    rows = live.drained_totals(live.tumbling_fps(frames, 86_400), "stream-fps")
    return rows.select("session_id", F.unix_micros("window_start").alias("window_us"), big("frames"), r6("fps"))


def _disordered(spark: SparkSession, sf_dir: str, pieces: int = 2) -> tuple[DataFrame, DataFrame]:
    """Action rows of frames that arrive up to a day late, and the frames dropped as later than that.

    The frames are written to a folder in the order of their arrival; after each piece the
    query goes on from its checkpoint. A closing frame lets the last ones through. A copy of
    every fiftieth frame comes after that.
    """
    frames = given.frames(spark, sf_dir)
    arrival = F.col("us") + F.pmod(F.xxhash64("frame_id"), F.lit(given.DAY_US))
    span = frames.agg(F.min("us").alias("first"), F.max("us").alias("last")).first()
    if span["first"] is None:
        return spark.createDataFrame([], live.OUTPUT), spark.createDataFrame([], "batch_id bigint, dropped bigint")
    length = (span["last"] + given.DAY_US - span["first"]) // pieces + 1
    piece = F.floor((arrival - span["first"]) / length)
    parts = [frames.filter(piece == i) for i in range(pieces)]
    parts += [live.closing_frame(frames, span["last"] + 2 * given.DAY_US), frames.filter("frame_id % 50 = 0")]
    folder, out, checkpoint = (scratch_path(spark, f"stream-disordered{part}") for part in ("", "-rows", "-checkpoint"))
    dropped = None
    for part in parts:
        part.write.mode("append").parquet(folder)
        acted = live.ordered_sessions(live.frame_stream(spark, folder, frames.schema), SETTINGS, "1 day")
        running = live.write_events(acted, out, checkpoint, "parquet")
        live.run_to_end(running)
        counted = live.dropped_frames(running)
        dropped = counted if dropped is None else dropped.unionByName(counted)
    return spark.read.schema(live.OUTPUT).parquet(out), dropped


@query("stream_disordered", f"""WITH RECURSIVE {ACTIONS}
        SELECT a.session_id, a.frame_id, a.stable_label, round(v.consensus_ratio, 6) AS consensus_ratio,
               round(v.avg_confidence, 6) AS avg_confidence, a.would_emit, a.reason
        FROM acts a JOIN votes v USING (session_id, frame_id)""")
def stream_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in any order of arrival within the delay give the rows of the ordered ones."""
    rows, _ = _disordered(spark, sf_dir)
    return rows.select(
        "session_id", "frame_id", "stable_label", r6("consensus_ratio"), r6("avg_confidence"), "would_emit", "reason"
    )


@query("stream_late", """SELECT 'put out' AS kind, count(*) AS n FROM events
        UNION ALL SELECT 'dropped', count(*) FROM events WHERE event_id % 50 = 0""")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames put out in order, and those counted as too late."""
    rows, dropped = _disordered(spark, sf_dir, pieces=1)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("put out").alias("kind"), "n").unionByName(
        dropped.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("n")).select(F.lit("dropped").alias("kind"), "n")
    )


LIVE_SETTINGS = live.LiveSettings(window_size=5, min_consensus_ratio=0.4, confidence_threshold=0.3, debounce_ms=2_000, keymap={str(i): f"key{i}" for i in range(8)}, aliases={"8": "1"})


@query("stream_live", """SELECT (vec_id % 7)::VARCHAR AS session_id, vec_id AS frame_id, true AS equals_batch,
        embedding[64]::DOUBLE < 0.2 AS detected FROM embeddings""")
def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks to actions in one stream that is stopped and started again, compared with batch.

    Each arriving sample gets its features, its prediction and the state step of its session
    in one query. The second half of the samples arrives after the query has ended; it goes
    on from its checkpoint. `equals_batch` compares all columns with those of the batch jobs.
    """
    number = F.col("sample_id").cast("bigint")
    samples = materialize(
        given.landmarks(spark, sf_dir).select(
            (number % 7).cast("string").alias("session_id"), number.alias("frame_id"), (number * 250_000).alias("us"), "*"
        ),
        "live-samples",
    )
    keys = ("session_id", "frame_id", "us")
    features = materialize(jobs.extract_features(samples, "geometric", keep=keys), "live-features")
    model = classifiers.train(features.filter("extraction_ok"), "naive_bayes")
    scored = model.transform(features).select(
        *keys, F.col("predicted_label").alias("label"), F.array_max("probability").alias("confidence"), "extraction_ok"
    )
    s = LIVE_SETTINGS
    voted = sessions.rolling_vote(
        scored, s.window_size, s.min_consensus_ratio, s.confidence_threshold, None
    )
    batch = sessions.actions(voted, dict(s.keymap), dict(s.aliases), debounce_ms=s.debounce_ms, chunk_us=None)
    folder, out, checkpoint = (scratch_path(spark, f"stream-live{part}") for part in ("", "-rows", "-checkpoint"))
    half = (samples.agg(F.max("frame_id")).first()[0] or 0) // 2
    for part in (samples.filter(F.col("frame_id") <= half), samples.filter(F.col("frame_id") > half)):
        part.write.mode("append").parquet(folder)
        acted = live.live_sessions(live.score_stream(live.frame_stream(spark, folder, samples.schema), model, "geometric"), s)
        live.run_to_end(live.write_events(acted, out, checkpoint, "parquet"))
    rows = spark.read.schema(live.OUTPUT).parquet(out)
    same = ["stable_label", "normalized_gesture_label", "mapped_key", "would_emit", "emitted", "reason"]
    near = ["consensus_ratio", "avg_confidence"]
    b = batch.select("session_id", "frame_id", "extraction_ok", *[F.col(c).alias(f"_{c}") for c in same + near])
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for c in near:
        equal = equal & (F.abs(F.col(c) - F.col(f"_{c}")) < 1e-9)
    joined = rows.join(b, ["session_id", "frame_id"], "full")
    return joined.select("session_id", "frame_id", F.coalesce(equal, F.lit(False)).alias("equals_batch"), F.col("extraction_ok").alias("detected"))


@query("stream_gaps", GAP_SESSIONS)
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames as a stream with a watermark; a closing frame lets the last ones end."""
    frames = given.frames(spark, sf_dir)
    last = frames.agg(F.max("us")).first()[0] or 0
    folder = scratch_path(spark, "stream-gaps")
    frames.write.parquet(folder)
    live.closing_frame(frames, last + 4 * given.DAY_US).write.mode("append").parquet(folder)
    arriving = live.frame_stream(spark, folder, frames.schema).withColumn("ts", F.timestamp_micros("us"))
    rows = live.drained(sessions.gap_sessions(arriving.withWatermark("ts", "1 day"), GAP), "stream-gaps-rows")
    return rows.filter("session_id is not null").select("session_id", "start_us", "end_us", big("frames"), r6("avg_confidence"))
