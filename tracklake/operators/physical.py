"""Distance, speed, sprints and track quality."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import distance
from tracklake.operators.windows import centred_average, islands, runs_of


@dataclass(frozen=True)
class MotionLimits:
    max_speed_kmh: float = 40.0
    max_acceleration: float = 8.0
    max_gap_ms: float = 1500.0
    min_confidence: float = 0.2
    shot_types: tuple[str, ...] = ("wide", "tactical")
    smoothing_ms: float = 1000.0
    sprint_kmh: float = 25.0
    sprint_ms: float = 1000.0
    min_samples: int = 3


def usable(limits: MotionLimits = MotionLimits()) -> Column:
    """x_field and y_field known, calibrated, good track, live shot, confident."""
    ok = F.col("x_field").isNotNull() & F.col("y_field").isNotNull() & F.col("calibration_valid") & F.col("quality_ok")
    return F.coalesce(ok & F.col("shot_type").isin(*limits.shot_types) & (F.col("confidence") >= limits.min_confidence), F.lit(False))


def accept_samples(rows: Iterable[tuple[float, float, float]], limits: MotionLimits = MotionLimits()) -> tuple[float, int, list[tuple[float, float]]]:
    """Distance, samples used and (time, km/h) from usable samples in order of time.

    A gap re-anchors without credit; an impossible speed or acceleration drops the sample, and the
    next is measured from the last accepted one, which is why no lag will do.
    """
    total, used, series = 0.0, 0, []
    at = speed = None
    for t, x, y in rows:
        if at is None:
            at, used = (t, x, y), 1
            continue
        gap = t - at[0]
        if gap <= 0:
            continue
        seconds = max(gap / 1000.0, 1e-3)
        far = math.hypot(x - at[1], y - at[2])
        now = far / seconds
        if gap > limits.max_gap_ms:
            at, speed, used = (t, x, y), None, used + 1
        elif now * 3.6 <= limits.max_speed_kmh and (speed is None or abs(now - speed) / seconds <= limits.max_acceleration):
            total, used = total + far, used + 1
            series.append((t, now * 3.6))
            at, speed = (t, x, y), now
    return total, used, series


def accepted_motion(samples: DataFrame, keys: list[str], limits: MotionLimits = MotionLimits()) -> DataFrame:
    """(keys, sample_count, usable_count, mean_confidence, coverage, dist, used, series) of each track;
    a track's samples of one match, which its length bounds, are folded in one group."""
    span = F.max("timestamp_ms") - F.min("timestamp_ms")
    good = F.when(usable(limits), F.col("timestamp_ms"))
    tracks = samples.groupBy(*keys).agg(
        F.count("*").alias("sample_count"), F.count(good).alias("usable_count"), F.avg(F.when(usable(limits), F.col("confidence"))).alias("mean_confidence"),
        F.when(span > 0, F.least((F.max(good) - F.min(good)) / span, F.lit(1.0))).otherwise(F.lit(0.0)).alias("coverage"),
    )
    kinds = ", ".join(f"{k} {dict(samples.dtypes)[k]}" for k in keys)

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("timestamp_ms")
        total, used, series = accept_samples(zip(*(t[c].to_pylist() for c in ("timestamp_ms", "x_field", "y_field")), strict=True), limits)
        rows = [{"timestamp_ms": a, "speed_kmh": b} for a, b in series]
        return pa.table({**{k: t[k][:1] for k in keys}, "dist": [total], "used": pa.array([used], pa.int64()), "series": pa.array([rows], pa.list_(pa.struct([("timestamp_ms", pa.float64()), ("speed_kmh", pa.float64())])))})

    motion = samples.where(usable(limits)).select(*keys, "timestamp_ms", "x_field", "y_field").groupBy(*keys).applyInArrow(fold, f"{kinds}, dist double, used long, series array<struct<timestamp_ms:double,speed_kmh:double>>")
    return tracks.join(motion, keys, "left")


def speed_series(motion: DataFrame, keys: list[str], limits: MotionLimits = MotionLimits()) -> DataFrame:
    """(keys, timestamp_ms, speed_kmh, smoothed_kmh)."""
    rows = motion.where(F.col("usable_count") >= limits.min_samples).select(*keys, F.inline("series"))
    return centred_average(rows, keys, "timestamp_ms", "speed_kmh", limits.smoothing_ms / 2, "smoothed_kmh")


def sprints(series: DataFrame, keys: list[str], limits: MotionLimits = MotionLimits()) -> DataFrame:
    """(keys, start_ms, end_ms, peak_kmh): runs at sprint speed that last long enough."""
    w = Window.partitionBy(*keys).orderBy("timestamp_ms")
    fast = series.withColumn("fast", F.col("smoothed_kmh") >= limits.sprint_kmh)
    fast = islands(fast, keys, ["timestamp_ms"], F.col("fast") != F.lag("fast").over(w), "run").where("fast")
    out = fast.groupBy(*keys, "run").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.max("smoothed_kmh").alias("peak_kmh")).drop("run")
    return out.where(F.col("end_ms") - F.col("start_ms") >= limits.sprint_ms)


def reported_max(series: DataFrame, keys: list[str], limits: MotionLimits = MotionLimits()) -> DataFrame:
    """(keys, max_speed_kmh, mean_speed_kmh): the peak if three samples in a row are within 2 km/h of it, else the 95th percentile."""
    w = Window.partitionBy(*keys)
    near = series.withColumn("peak", F.max("smoothed_kmh").over(w)).withColumn("near", F.col("peak") - F.col("smoothed_kmh") <= 2.0)
    o = w.orderBy("timestamp_ms").rowsBetween(-2, 0)
    near = near.withColumn("three", (F.count("*").over(o) == 3) & F.min("near").over(o))
    agg = near.groupBy(*keys).agg(F.max("peak").alias("peak"), F.max("three").alias("three"), F.percentile("smoothed_kmh", 0.95).alias("p95"), F.avg("smoothed_kmh").alias("mean_speed_kmh"))
    return agg.select(*keys, F.when(F.col("three") & (F.col("peak") <= limits.max_speed_kmh), F.col("peak")).otherwise(F.col("p95")).alias("max_speed_kmh"), "mean_speed_kmh")


def player_metrics(samples: DataFrame, keys: list[str], limits: MotionLimits = MotionLimits()) -> DataFrame:
    """One row per track: valid, invalid_reason, total_distance_m, max and mean speed, sprint_count and coverage; NULL, not 0, where invalid."""
    motion = accepted_motion(samples, keys, limits)
    series = speed_series(motion, keys, limits)
    runs = sprints(series, keys, limits).groupBy(*keys).agg(F.count("*").alias("sprint_count"))
    out = motion.join(reported_max(series, keys, limits), keys, "left").join(runs, keys, "left")
    reason = F.when(F.col("usable_count") < limits.min_samples, F.lit("insufficient_usable_samples")).when(F.size("series") == 0, F.lit("no_valid_motion_segments"))
    ok = reason.isNull()
    return out.select(
        *keys, ok.alias("valid"), reason.alias("invalid_reason"), F.when(ok, F.col("dist")).alias("total_distance_m"), F.when(ok, F.col("max_speed_kmh")).alias("max_speed_kmh"),
        F.when(ok, F.col("mean_speed_kmh")).alias("mean_speed_kmh"), F.when(ok, F.coalesce("sprint_count", F.lit(0))).alias("sprint_count"), "sample_count",
        F.when(F.col("usable_count") < limits.min_samples, F.col("usable_count")).otherwise(F.col("used")).alias("used_count"), F.when(ok, F.col("coverage")).alias("coverage"), F.when(ok, F.col("mean_confidence")).alias("mean_confidence"),
    )


def row_speeds(rows: DataFrame, keys: list[str], max_kmh: float = 40.0) -> DataFrame:
    """Per row: speed from the last row with a position, and the distance so far over speeds in bounds."""
    w = Window.partitionBy(*keys).orderBy("timestamp_ms")
    at = F.when(F.col("x_field").isNotNull() & F.col("y_field").isNotNull(), F.struct("timestamp_ms", "x_field", "y_field"))
    prev = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = rows.withColumn("p", prev)
    step = distance(F.col("x_field"), F.col("y_field"), F.col("p.x_field"), F.col("p.y_field"))
    seconds = (F.col("timestamp_ms") - F.col("p.timestamp_ms")) / 1000.0
    d = d.withColumn("step_m", F.when(seconds > 0, step)).withColumn("speed_kmh", F.when(seconds > 0, step / seconds * 3.6))
    d = d.withColumn("speed_kmh", F.when(F.col("speed_kmh") <= max_kmh, F.col("speed_kmh")))
    total = F.sum(F.when(F.col("speed_kmh").isNotNull(), F.col("step_m")).otherwise(F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("cumulative_distance_m", total).drop("p", "step_m")


def speed_audit(series: DataFrame, keys: list[str], speed: str = "speed_kmh", spike_kmh: float = 30.0, jump_kmh: float = 8.0) -> DataFrame:
    """Per track: raw maximum, number of isolated spikes, 95th percentile, maximum of the rest."""
    w = Window.partitionBy(*keys).orderBy("timestamp_ms")
    v = F.col(speed)
    around = F.greatest(F.coalesce(F.lag(v).over(w), v), F.coalesce(F.lead(v).over(w), v))
    marked = series.where(v.isNotNull()).withColumn("spike", (v >= spike_kmh) & (v - around > jump_kmh))
    return marked.groupBy(*keys).agg(F.max(speed).alias("raw_max_kmh"), F.sum(F.col("spike").cast("int")).alias("spikes"), F.percentile(speed, 0.95).alias("p95_kmh"), F.max(F.when(~F.col("spike"), v)).alias("reported_max_kmh"))


def track_quality(tracks: DataFrame, keys: list[str], total_frames: int | None = None) -> DataFrame:
    """Distinct frames, span, breaks, coverage, continuity and the weighted geometric score."""
    w = Window.partitionBy(*keys).orderBy("frame_id")
    frames = tracks.groupBy(*keys, "frame_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(F.col("bbox_valid").cast("int")).alias("v"))
    frames = frames.withColumn("gap", F.col("frame_id") - F.lag("frame_id").over(w))
    a = frames.groupBy(*keys).agg(
        F.count("*").alias("observations"), (F.max("frame_id") - F.min("frame_id") + 1).alias("frame_span"), F.count(F.when(F.col("gap") > 1, 1)).alias("fragmentation_count"),
        (F.sum("c") / F.sum("n")).alias("mean_tracking_confidence"), (F.sum("v") / F.sum("n")).alias("valid_bbox_fraction"),
    )
    whole = F.col("frame_span") if total_frames is None else F.lit(total_frames)
    a = a.withColumn("coverage", F.col("observations") / whole).withColumn("continuity", F.col("observations") / F.col("frame_span"))
    score = F.pow("coverage", F.lit(0.20)) * F.pow("continuity", F.lit(0.25)) * F.pow("mean_tracking_confidence", F.lit(0.20)) * F.pow("valid_bbox_fraction", F.lit(0.10))
    return a.withColumn("quality_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def usable_tracks(quality: DataFrame, min_frames: int = 10, min_coverage: float = 0.5, min_score: float = 0.3) -> DataFrame:
    return quality.withColumn("usable_for_metrics", (F.col("observations") >= min_frames) & (F.col("coverage") >= min_coverage) & (F.col("quality_score") >= min_score))


def visibility(tracks: DataFrame, keys: list[str], total_frames: int) -> DataFrame:
    """Frames seen live, their share, first and last."""
    live = tracks.where("not replay").groupBy(*keys).agg(F.countDistinct("frame_id").alias("visible_frames"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))
    return live.withColumn("visible_fraction", F.col("visible_frames") / F.lit(total_frames))


def longest_run_seconds(frames: DataFrame, keys: list[str], flag: str, fps: float) -> DataFrame:
    """Seconds of the longest run of frames with (or, by negating the flag, without) something."""
    runs = runs_of(frames, keys, "frame_id", F.col(flag))
    return runs.groupBy(*keys).agg((F.max("rows") / F.lit(fps)).alias("seconds"))
