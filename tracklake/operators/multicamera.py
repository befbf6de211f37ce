"""Several cameras: coverage, fusion, duplicates, drift and offsets.

Observations: camera_id, local_track_id, global_id, t (seconds), x, y, team_id, team_confidence,
jersey_number, jersey_confidence, role, detection_confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import distance
from tracklake.operators.windows import first_by


def camera_coverage(observations: DataFrame, keys: list[str]) -> DataFrame:
    return observations.groupBy(*keys, "camera_id").agg(
        F.count("*").alias("observation_count"), F.countDistinct("local_track_id").alias("track_count"), F.min("t").alias("first_time_seconds"), F.max("t").alias("last_time_seconds"),
        F.avg(F.col("x").isNotNull().cast("double")).alias("pitch_localized_fraction"), F.avg("detection_confidence").alias("mean_detection_confidence"),
    )


def coverage_gaps(observations: DataFrame, matches: DataFrame, keys: list[str], bin_seconds: float = 10.0, min_active: int = 1) -> DataFrame:
    """Time bins of each match (keys, duration_seconds, expected) with too few cameras."""
    grid = matches.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("duration_seconds") / bin_seconds) - 1).cast("long"))))
    seen = observations.select(*keys, F.floor(F.col("t") / bin_seconds).alias("bin"), "camera_id").distinct().groupBy(*keys, "bin").agg(F.collect_list("camera_id").alias("seen"))
    g = grid.join(seen, [*keys, "bin"], "left").withColumn("active_cameras", F.array_sort(F.array_intersect("expected", F.coalesce("seen", F.array().cast("array<string>")))))
    g = g.where(F.size("active_cameras") < min_active)
    return g.select(*keys, (F.col("bin") * bin_seconds).alias("start_seconds"), F.least((F.col("bin") + 1) * bin_seconds, F.col("duration_seconds")).alias("end_seconds"), "active_cameras", F.array_sort(F.array_except("expected", "active_cameras")).alias("missing_cameras"))


def fuse(observations: DataFrame, keys: list[str], min_team: float = 0.5, min_jersey: float = 0.5) -> DataFrame:
    """One row per key: weighted time and place, surest team and jersey, and conflicts."""
    w = F.greatest(F.col("detection_confidence"), F.lit(1e-9))
    xy = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), w)
    team = F.when(F.col("team_id").isNotNull() & (F.col("team_confidence") >= min_team), F.struct(F.col("team_confidence").alias("c"), F.col("team_id").alias("v")))
    jersey = F.when(F.col("jersey_number").isNotNull() & (F.col("jersey_confidence") >= min_jersey), F.struct(F.col("jersey_confidence").alias("c"), F.col("jersey_number").alias("v")))
    role = F.when(F.col("role") != "unknown", F.col("role"))
    a = observations.groupBy(*keys).agg(
        (F.sum(w * F.col("t")) / F.sum(w)).alias("time_seconds"), (F.sum(xy * F.col("x")) / F.sum(xy)).alias("x"), (F.sum(xy * F.col("y")) / F.sum(xy)).alias("y"), F.max(team).alias("bt"), F.max(jersey).alias("bj"),
        F.countDistinct(team["v"]).alias("nt"), F.countDistinct(jersey["v"]).alias("nj"), F.countDistinct(role).alias("nr"), F.min(role).alias("r"),
        F.array_sort(F.collect_set("camera_id")).alias("source_cameras"), F.count("*").alias("observation_count"), F.avg("detection_confidence").alias("confidence"),
    )
    conflicts = F.filter(F.array(*[F.when(F.col(n) > 1, F.lit(name)) for n, name in (("nt", "team_conflict"), ("nj", "jersey_conflict"), ("nr", "role_conflict"))]), lambda c: c.isNotNull())
    return a.select(*keys, "time_seconds", "x", "y", F.col("bt.v").alias("team_id"), F.coalesce("bt.c", F.lit(0.0)).alias("team_confidence"), F.col("bj.v").alias("jersey_number"), F.coalesce("bj.c", F.lit(0.0)).alias("jersey_confidence"), F.coalesce("r", F.lit("unknown")).alias("role"), "source_cameras", "observation_count", "confidence", conflicts.alias("conflicts"))


def fuse_timeline(observations: DataFrame, keys: list[str], bin_seconds: float = 0.2) -> DataFrame:
    return fuse(observations.withColumn("time_bin", F.floor(F.col("t") / bin_seconds)), [*keys, "time_bin"])


def _simultaneous(observations: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Pairs of observations (l, r) of one key at most `tolerance` apart in time, by time buckets."""
    row = F.struct(*observations.columns)
    wide = max(tolerance, 1e-6)
    left = observations.select(*keys, row.alias("l"), F.explode(F.sequence(F.floor(F.col("t") / wide), F.floor(F.col("t") / wide) + 1)).alias("slot"), F.floor(F.col("t") / wide).alias("home"))
    right = observations.select(*keys, row.alias("r"), F.floor(F.col("t") / wide).alias("slot"))
    dt = F.col("r.t") - F.col("l.t")
    after = (dt > 0) | ((dt == 0) & (F.col("l.obs_id") < F.col("r.obs_id")))
    return left.join(right, [*keys, "slot"]).where(after & (dt <= tolerance)).drop("slot", "home")


def intra_camera_duplicates(observations: DataFrame, keys: list[str], tolerance: float = 0.08, spot_m: float = 1.0) -> DataFrame:
    """Two tracks of one camera in one place at one time: the less sure one is a duplicate. Needs obs_id."""
    p = _simultaneous(observations.where("x is not null and y is not null"), [*keys, "camera_id"], tolerance).where("l.local_track_id <> r.local_track_id")
    d = distance(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"))
    keep_left = F.col("l.detection_confidence") >= F.col("r.detection_confidence")
    return p.where(d <= spot_m).select(*keys, "camera_id", F.when(keep_left, F.col("l.obs_id")).otherwise(F.col("r.obs_id")).alias("kept_id"), F.when(keep_left, F.col("r.obs_id")).otherwise(F.col("l.obs_id")).alias("suppressed_id"), d.alias("distance_m"))


def suppress_duplicates(observations: DataFrame, keys: list[str]) -> DataFrame:
    gone = intra_camera_duplicates(observations, keys).select(*keys, F.col("suppressed_id").alias("obs_id")).distinct()
    return observations.join(gone, [*keys, "obs_id"], "left_anti")


def impossible_duplicates(observations: DataFrame, keys: list[str], tolerance: float = 0.08, far_m: float = 20.0, min_jersey: float = 0.5) -> DataFrame:
    """One jersey of one team in two far places at once."""
    known = observations.where((F.col("jersey_confidence") >= min_jersey) & F.col("jersey_number").isNotNull() & F.col("x").isNotNull())
    p = _simultaneous(known, [*keys, "jersey_number"], tolerance)
    other = (F.col("l.camera_id") != F.col("r.camera_id")) | (F.col("l.local_track_id") != F.col("r.local_track_id"))
    team = F.coalesce(F.col("l.team_id") == F.col("r.team_id"), F.lit(True))
    d = distance(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"))
    return p.where(other & team & (d >= far_m)).select(*keys, "jersey_number", F.col("l.obs_id").alias("left_id"), F.col("r.obs_id").alias("right_id"), d.alias("distance_m"), (F.col("r.t") - F.col("l.t")).alias("time_delta_seconds"))


def drift_fit(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted least squares of offset_seconds over measured_at_seconds: one aggregation for the weighted means, joined back,
    and one for sums about them, so that a camera's rows are never in one task."""
    m = measurements.where("measured_at_seconds is not null").withColumn("w", F.greatest("confidence", F.lit(1e-9)))
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    means = m.groupBy(*keys).agg(mean("measured_at_seconds").alias("anchor"), mean("offset_seconds").alias("base"))
    t, o = F.col("measured_at_seconds") - F.col("anchor"), F.col("offset_seconds") - F.col("base")
    s = m.join(means, keys).groupBy(*keys).agg(F.first("base").alias("base"), F.first("anchor").alias("anchor"), F.sum(F.col("w") * t * t).alias("tt"), F.sum(F.col("w") * t * o).alias("to"), F.sum(F.col("w") * o * o).alias("oo"), F.sum("w").alias("ww"), F.count("*").alias("sample_count"))
    rate = F.when(F.col("tt") > 1e-9, F.col("to") / F.col("tt")).otherwise(F.lit(0.0))
    rest = F.greatest(F.col("oo") - 2 * F.col("rate") * F.col("to") + F.col("rate") * F.col("rate") * F.col("tt"), F.lit(0.0))
    return s.withColumn("rate", rate).select(*keys, F.col("base").alias("base_offset_seconds"), F.col("rate").alias("drift_rate"), F.col("anchor").alias("anchor_seconds"), F.sqrt(rest / F.col("ww")).alias("residual_seconds"), "sample_count")


def best_offsets(estimates: DataFrame, reference: str, min_confidence: float = 0.6) -> DataFrame:
    """The surest offset of each camera other than the reference."""
    ok = estimates.where((F.col("camera_id") != reference) & (F.col("confidence") >= min_confidence))
    return ok.groupBy("camera_id").agg(F.max_by("offset_seconds", F.struct("confidence", "offset_seconds")).alias("offset_seconds"), F.max("confidence").alias("confidence"))


def to_local_time(t, offset, drift, anchor):
    """Reference seconds to a camera's seconds."""
    return t - (offset + drift * (t - anchor))


def cross_correlation(reference: DataFrame, target: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """(keys, lag, score): normalised correlation of two sampled signals (i, v) at each lag within the
    bound; each sample is sent to 2 * max_lag + 1 places, not to all."""
    norm = lambda d: d.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*keys))).withColumn("e", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*keys))))
    a = norm(reference).select(*keys, "i", F.col("v").alias("va"), F.col("e").alias("ea"))
    b = norm(target).select(*keys, F.col("v").alias("vb"), F.col("e").alias("eb"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("i", F.col("j") - F.col("lag"))
    j = a.join(b, [*keys, "i"])
    return j.groupBy(*keys, "lag").agg((F.sum(F.col("va") * F.col("vb")) / F.nullif(F.max("ea") * F.max("eb"), F.lit(0.0))).alias("score"))


def best_lag(correlation: DataFrame, keys: list[str], rate_hz: float) -> DataFrame:
    best = first_by(correlation.where("score is not null"), keys, F.desc("score"), F.abs("lag"), "lag")
    return best.select(*keys, (F.col("lag") / rate_hz).alias("offset_seconds"), F.greatest(F.col("score"), F.lit(0.0)).alias("confidence"))
