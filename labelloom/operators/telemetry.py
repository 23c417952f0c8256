"""Latency and frame-rate summaries of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.ranking import exact_quantile

LATENCIES = ("capture_to_prediction", "prediction_to_dispatch", "end_to_end")


def runtime_summary(samples: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session: frames, mean fps, interval jitter, mean and p95 latencies, event counts.

    Absent values count as 0, as does the jitter of fewer than two intervals.
    """
    keys = list(keys)
    zero = F.lit(0.0)
    flag = lambda name: F.count_if(F.coalesce(F.col(name), F.lit(False)))
    aggregates = [
        F.count(F.lit(1)).alias("frame_count"),
        F.coalesce(F.avg("fps"), zero).alias("avg_fps"),
        F.when(F.count("frame_interval_ms") >= 2, F.stddev_pop("frame_interval_ms"))
        .otherwise(zero)
        .alias("fps_jitter_ms"),
        *[F.coalesce(F.avg(f"{name}_ms"), zero).alias(f"{name}_avg") for name in LATENCIES],
        flag("action_emitted").alias("actions_emitted"),
        flag("action_suppressed").alias("actions_suppressed"),
        flag("detection_ok").alias("detections_ok"),
    ]
    p95 = [f"{name}_p95" for name in LATENCIES]
    stages = [F.struct(F.lit(name).alias("stage"), F.col(f"{name}_ms").alias("ms")) for name in LATENCIES]
    long = samples.select(*keys, F.inline(F.array(*stages)))
    wide = exact_quantile(long, [*keys, "stage"], "ms", 0.95).groupBy(*keys).agg(
        *[F.max(F.when(F.col("stage") == name, F.col("quantile"))).alias(f"{name}_p95") for name in LATENCIES]
    )
    summary = samples.groupBy(*keys).agg(*aggregates).join(wide, keys, "left")
    means = [c for name in LATENCIES for c in (f"{name}_avg", f"{name}_p95")]
    return summary.select(
        *keys,
        "frame_count",
        "avg_fps",
        "fps_jitter_ms",
        *[F.coalesce(c, zero).alias(c) if c in p95 else F.col(c) for c in means],
        "actions_emitted",
        "actions_suppressed",
        "detections_ok",
    )


def tumbling_fps(frames: DataFrame, seconds: int = 5, ts: str = "ts") -> DataFrame:
    """Frames per second of each session in tumbling windows (batch or stream)."""
    window = F.window(ts, f"{seconds} seconds")
    return (
        frames.groupBy("session_id", window.alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"))
        .select(
            "session_id",
            F.col("w.start").alias("window_start"),
            "frames",
            (F.col("frames") / F.lit(float(seconds))).alias("fps"),
        )
    )
