"""Role evidence, tracklet pairs and calibration gates as column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import vectors as V
from tracklake.functions.geometry import PITCH_LENGTH, PITCH_WIDTH, distance
from tracklake.functions.labels import hsv_close, role_family


def goalkeeper_score(kit_distinct: Column, penalty_share: Column, min_kit: float = 0.45, min_share: float = 0.35) -> Column:
    """0 unless the kit stands out and the player stays near a goal, else the mean of both."""
    return F.when((kit_distinct >= min_kit) & (penalty_share >= min_share), (kit_distinct + penalty_share) / 2).otherwise(F.lit(0.0))


def official_scores(kit: Column, team_kit: Column, on_pitch: Column, touchline: Column, min_kit: float = 0.35, penalty: float = 0.8) -> Column:
    """Struct referee, assistant: likeness to an official's kit less that to a team's, by place."""
    s = F.when(kit >= min_kit, F.greatest(F.lit(0.0), kit - penalty * F.greatest(team_kit - kit, F.lit(0.0)))).otherwise(F.lit(0.0))
    return F.struct(F.when(on_pitch, s).otherwise(F.lit(0.0)).alias("referee"), F.when(touchline, s).otherwise(F.lit(0.0)).alias("assistant"))


def role_evidence(kit_team: Column, goalkeeper: Column, officials: Column, zone: Column, replay: Column, min_score: float = 0.3) -> Column:
    """Map of role to score; nothing from a replay, nothing below the least score."""
    every = F.create_map(
        F.lit("player"), F.when(zone == "pitch", kit_team).otherwise(F.lit(0.0)), F.lit("goalkeeper"), goalkeeper, F.lit("referee"), officials["referee"], F.lit("assistant_referee"), officials["assistant"],
        F.lit("staff"), F.when(zone == "bench", F.lit(0.6)).otherwise(F.lit(0.0)), F.lit("spectator"), F.when(zone == "stands", F.lit(0.8)).otherwise(F.lit(0.0)),
    )
    return F.when(~replay, F.map_filter(every, lambda k, v: v >= min_score))


def person_zone(x: Column, y: Column, foot_y: Column, foot_x: Column, green: Column, height: Column, frame_width: float = 1920.0, frame_height: float = 1080.0, margin: float = 3.0) -> Column:
    """Zone of a person: by pitch position where known, else by place in the frame and grass at the feet."""
    known = x.isNotNull() & y.isNotNull()
    inside = x.between(-margin, PITCH_LENGTH + margin) & y.between(-margin, PITCH_WIDTH + margin)
    return (
        F.when(known & inside, "pitch").when(known, "outside").when((foot_y < 0.18 * frame_height) & (height < 28), "stands").when((foot_y > 0.78 * frame_height) & (green < 0.12), "bench")
        .when(((foot_x < 0.12 * frame_width) | (foot_x > 0.88 * frame_width)) & (green < 0.12), "bench").when(green >= 0.12, "pitch").otherwise("unknown")
    )


def kit_scores(fractions: Column) -> Column:
    """Struct white, dark, coloured from shares by colour family (a map)."""
    g = lambda k: F.coalesce(F.element_at(fractions, F.lit(k)), F.lit(0.0))
    white, dark = g("white") + 0.5 * g("grey"), g("black") + 0.5 * g("grey")
    return F.struct(white.alias("white"), dark.alias("dark"), F.greatest(F.lit(0.0), 1 - white - dark).alias("coloured"), (dark >= 0.5).alias("is_dark"))


def tracklet_pairs(tracklets: DataFrame, match: list[str], max_gap_ms: float = 18_000.0) -> DataFrame:
    """Pairs (a, b) where b starts within the gap after a ends, by time buckets of the gap."""
    row = F.struct(*tracklets.columns)
    k = lambda c: F.floor(F.col(c) / max_gap_ms)
    a = tracklets.select(*match, row.alias("a"), F.explode(F.array(k("end_ms"), k("end_ms") + 1)).alias("slot"))
    b = tracklets.select(*match, row.alias("b"), k("start_ms").alias("slot"))
    return a.join(b, [*match, "slot"]).where((F.col("b.start_ms") > F.col("a.end_ms")) & (F.col("b.start_ms") - F.col("a.end_ms") <= max_gap_ms)).drop("slot")


def pair_veto(max_gap_s: float = 8.0, max_speed: float = 11.0) -> Column:
    """Why a pair of tracklet_pairs can't be one player; NULL if it can."""
    a, b = F.col("a"), F.col("b")
    gap = (b["start_ms"] - a["end_ms"]) / 1000.0
    fa, fb = role_family(a["role"]), role_family(b["role"])
    far = distance(a["last_x"], a["last_y"], b["first_x"], b["first_y"])
    return (
        F.when((fa != fb) & ~fa.isin("unknown") & ~fb.isin("unknown"), "role").when(a["team_id"] != b["team_id"], "team").when(a["jersey"] != b["jersey"], "jersey")
        .when(gap > max_gap_s, "gap").when(far > 8.0 + max_speed * gap, "speed")
    )


def pair_score() -> Column:
    """Struct score, reasons of a pair: likeness, nearness, jersey and shoes."""
    a, b = F.col("a"), F.col("b")
    gap = (b["start_ms"] - a["end_ms"]) / 1000.0
    sim = V.cosine(a["embedding"], b["embedding"])
    near = F.greatest(F.lit(0.0), 1 - distance(a["last_x"], a["last_y"], b["first_x"], b["first_y"]) / (8.0 + 11.0 * gap))
    jersey = F.coalesce(a["jersey"] == b["jersey"], F.lit(False))
    shoes = F.coalesce(hsv_close(a["shoe"], b["shoe"]), F.lit(False))
    score = 0.7 * F.coalesce(sim, F.lit(0.0)) + 0.15 * F.coalesce(near, F.lit(0.0)) + 0.15 * jersey.cast("int") + 0.03 * shoes.cast("int")
    why = F.concat_ws(",", F.when(sim >= 0.62, "reid_strong").when(sim >= 0.52, "reid"), F.when(near >= 0.5, "near"), F.when(jersey, "jersey"), F.when(shoes, "shoes"))
    return F.struct(F.least(score, F.lit(1.0)).alias("score"), why.alias("reasons"))


def calibration_accepted(max_error: float = 8.0, min_points: int = 4, min_coverage: float = 0.15, min_confidence: float = 0.5) -> Column:
    """Reasons against a calibration row, joined; empty if it is accepted."""
    c = F.col
    checks = (
        (c("orientation").isNull(), "orientation_unknown"), (F.coalesce(c("points"), F.lit(0)) < min_points, "too_few_points"), (~F.coalesce(c("reprojection_error") <= max_error, F.lit(False)), "reprojection_error"),
        (~F.coalesce(c("coverage") >= min_coverage, F.lit(False)), "low_coverage"), (~F.coalesce(c("confidence") >= min_confidence, F.lit(False)), "low_confidence"),
    )
    return F.concat_ws("; ", *[F.when(bad, F.lit(why)) for bad, why in checks])


def first_valid_provider(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several providers' rows (priority, valid, reason) the first valid one; else all reasons."""
    return rows.groupBy(*keys).agg(F.min_by("provider", F.when(F.col("valid"), F.col("priority"))).alias("provider"), F.max("valid").alias("valid"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct("priority", "reason")))), lambda s: s["reason"]), "; ").alias("reasons")).withColumn("reasons", F.when(~F.col("valid"), F.col("reasons")))


def matched_offset(events: DataFrame, keys: list[str]) -> DataFrame:
    """Offset and drift of a camera by least squares over matched events (local_s, reference_s), with a confidence by what is left over."""
    a = events.groupBy(*keys).agg(F.count("*").alias("events"), F.regr_slope("reference_s", "local_s").alias("slope"), F.regr_intercept("reference_s", "local_s").alias("offset_seconds"), F.regr_sxx("reference_s", "local_s").alias("sxx"), F.regr_syy("reference_s", "local_s").alias("syy"), F.regr_sxy("reference_s", "local_s").alias("sxy"))
    rest = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.col("events"))
    return a.withColumn("residual_seconds", rest).withColumn("confidence", 1 / (1 + 10 * F.col("residual_seconds"))).drop("sxx", "syy", "sxy")


def quality_weighted_pool(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean of a column weighted by exp(score) * quality over rows that aren't masked."""
    w = F.when(~F.col("masked"), F.exp("score") * F.greatest(F.col("quality"), F.lit(1e-6)))
    return rows.groupBy(*keys).agg((F.sum(w * F.col(column)) / F.sum(w)).alias(column))
