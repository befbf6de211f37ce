"""Team shape, occupancy, dwell heatmaps, team locks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import PITCH_LENGTH, PITCH_WIDTH, distance, finite
from tracklake.functions.labels import bin_of
from tracklake.operators.windows import mode_by, ordered_sum


def shape_ready(min_confidence: float = 0.6) -> Column:
    return F.coalesce(finite(F.col("x_field"), F.col("y_field")) & F.col("calibration_valid") & (F.col("team_confidence") >= min_confidence), F.lit(False))


def team_shape(players: DataFrame, keys: list[str], min_players: int = 4, min_confidence: float = 0.6) -> DataFrame:
    """Centroid, width, depth, mean pair distance and compactness of each team of each frame; NULL with
    a reason under min_players. Pairs are taken inside the team's array, some eleven players, so no self-join."""
    ok = players.where(shape_ready(min_confidence)).groupBy(*keys).agg(
        F.avg("x_field").alias("cx"), F.avg("y_field").alias("cy"), (F.max("y_field") - F.min("y_field")).alias("w"), (F.max("x_field") - F.min("x_field")).alias("d"),
        F.max("x_field").alias("last_line_x"), F.count("*").alias("player_count"), F.array_sort(F.collect_list(F.struct("track_id", F.col("x_field").alias("x"), F.col("y_field").alias("y")))).alias("ps"),
    )
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b["track_id"] > a["track_id"]), lambda b: distance(a["x"], a["y"], b["x"], b["y"]))))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    centre = F.transform("ps", lambda p: distance(p["x"], p["y"], F.col("cx"), F.col("cy")))
    enough = F.col("player_count") >= min_players
    return ok.select(
        *keys, enough.alias("valid"), F.when(~enough, F.lit("insufficient_players")).alias("invalid_reason"), "player_count", F.least(F.col("player_count") / F.lit(float(min_players)), F.lit(1.0)).alias("player_coverage"),
        *[F.when(enough, c).alias(n) for n, c in (("centroid_x", F.col("cx")), ("centroid_y", F.col("cy")), ("width_m", F.col("w")), ("depth_m", F.col("d")), ("mean_pair_distance_m", mean(pairs)), ("compactness_m", mean(centre)), ("last_line_x", F.col("last_line_x")))],
    )


def dense_teams(shape: DataFrame, frames: DataFrame, frame_keys: list[str], team: str, teams: tuple[str, ...] = ("team_0", "team_1")) -> DataFrame:
    """A row for each frame and team, invalid where nothing is known."""
    grid = frames.select(*frame_keys).distinct().withColumn(team, F.explode(F.array(*[F.lit(t) for t in teams])))
    out = grid.join(shape, [*frame_keys, team], "left")
    return out.withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("player_count", F.coalesce("player_count", F.lit(0))).withColumn("invalid_reason", F.when(F.col("valid"), F.lit(None)).otherwise(F.coalesce("invalid_reason", F.lit("insufficient_players"))))


def occupancy(players: DataFrame, keys: list[str], bins_x: int = 6, bins_y: int = 4) -> DataFrame:
    """(keys, bin_x, bin_y, n) of players by cell, clamped to the pitch."""
    return players.where(shape_ready()).groupBy(*keys, bin_of(F.col("x_field"), PITCH_LENGTH, bins_x).alias("bin_x"), bin_of(F.col("y_field"), PITCH_WIDTH, bins_y).alias("bin_y")).agg(F.count("*").alias("n"))


def on_pitch() -> Column:
    ok = ~F.col("replay") & F.col("calibration_valid") & finite(F.col("x_field"), F.col("y_field"))
    return F.coalesce(ok & F.col("x_field").between(0, PITCH_LENGTH) & F.col("y_field").between(0, PITCH_WIDTH), F.lit(False))


def dwell_heatmap(samples: DataFrame, keys: list[str], bins_x: int = 21, bins_y: int = 14, max_gap_ms: float = 1500.0) -> DataFrame:
    """(keys, bin_x, bin_y, dwell_ms, share): each gap between neighbouring usable samples is
    halved between their cells; an unusable sample breaks the chain."""
    w = Window.partitionBy(*keys).orderBy("timestamp_ms")
    cell = F.struct(bin_of(F.col("x_field"), PITCH_LENGTH, bins_x).alias("bin_x"), bin_of(F.col("y_field"), PITCH_WIDTH, bins_y).alias("bin_y"))
    d = samples.withColumn("ok", on_pitch()).withColumn("cell", cell)
    d = d.withColumn("gap", F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)).withColumn("prev_ok", F.lag("ok").over(w)).withColumn("prev_cell", F.lag("cell").over(w))
    d = d.where(F.col("ok") & F.col("prev_ok") & (F.col("gap") > 0) & (F.col("gap") <= max_gap_ms))
    halves = d.select(*keys, (F.col("gap") / 2).alias("half"), F.explode(F.array("cell", "prev_cell")).alias("c"))
    out = halves.groupBy(*keys, "c.bin_x", "c.bin_y").agg(F.sum("half").alias("dwell_ms"))
    return out.withColumn("share", F.col("dwell_ms") / F.sum("dwell_ms").over(Window.partitionBy(*keys)))


def penalty_area_share(samples: DataFrame, keys: list[str], depth: float = 16.5) -> DataFrame:
    """Larger share of samples in either end band."""
    a = samples.where(on_pitch()).groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("x_field") <= depth, 1)).alias("l"), F.count(F.when(F.col("x_field") >= PITCH_LENGTH - depth, 1)).alias("r"))
    return a.select(*keys, (F.greatest("l", "r") / F.col("n")).alias("penalty_area_share"))


def team_lock(identities: DataFrame, keys: list[str], min_confidence: float = 0.35) -> DataFrame:
    """identities with locked_team: the team with the most confidence over the track's strong rows, or over all if none is strong."""
    d = identities.withColumn("strong", F.col("team_confidence") >= min_confidence)
    d = d.withColumn("any_strong", F.max(F.col("strong") & F.col("team_id").isNotNull()).over(Window.partitionBy(*keys)))
    best = mode_by(d.where(~F.coalesce("any_strong", F.lit(False)) | F.col("strong")), keys, "team_id", F.col("team_confidence"))
    return identities.join(best.select(*keys, F.col("team_id").alias("locked_team")), keys, "left")


def last_team(identities: DataFrame, keys: list[str]) -> DataFrame:
    return identities.where("team_id is not null").groupBy(*keys).agg(F.max_by("team_id", "frame_id").alias("team_id"))


def best_mean_team(identities: DataFrame, keys: list[str]) -> DataFrame:
    means = identities.where("team_id is not null").groupBy(*keys, "team_id").agg(F.avg("team_confidence").alias("m"))
    return means.groupBy(*keys).agg(F.max_by("team_id", F.struct("m", "team_id")).alias("team_id"))


def attack_direction(players: DataFrame, keys: list[str]) -> DataFrame:
    """+1 where team_0 stands further left on average, else -1; +1 where a side is unknown."""
    m = players.groupBy(*keys).agg(F.avg(F.when(F.col("team_id") == "team_0", F.col("x_field"))).alias("m0"), F.avg(F.when(F.col("team_id") == "team_1", F.col("x_field"))).alias("m1"))
    return m.select(*keys, F.when(F.col("m0") > F.col("m1"), F.lit(-1)).otherwise(F.lit(1)).alias("attack_sign"))


def team_rollup(players: DataFrame, team: str = "team_id", player: str = "track_id", sums: tuple[str, ...] = ("total_distance_m",)) -> DataFrame:
    """Sums by player, team and match in one pass; level 0 player, 1 team, 3 all."""
    return players.rollup(team, player).agg(F.grouping_id().alias("level"), F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in sums])


def nearest_team(queries: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """queries with the team whose centroid of the frame (summed by track) is nearer, the first by name where both are as
    near; NULL if no team is known."""
    mean = lambda c: ordered_sum(F.col(c), "track_id") / F.count(c)
    c = players.where("team_id is not null").groupBy(*keys, "team_id").agg(mean("x_field").alias("tx"), mean("y_field").alias("ty"))
    near = queries.join(c.withColumnRenamed("team_id", "near_team"), keys, "left")
    d = distance(F.col("x_field"), F.col("y_field"), F.col("tx"), F.col("ty"))
    return near.groupBy(*queries.columns).agg(F.min_by("near_team", F.struct(d, "near_team")).alias("resolved_team"))


def visible_seconds(tracks: DataFrame, keys: list[str], fps: float) -> DataFrame:
    return tracks.groupBy(*keys).agg((F.countDistinct("frame_id") / F.lit(fps)).alias("visible_seconds"))


def activity_index(visible: Column, metres: Column, touches: Column, passes: Column, duels: Column, defensive: Column, penalty: Column, min_seconds: float = 8.0) -> Column:
    """Six capped rates a minute, weighted to 100; NULL if seen too briefly."""
    minutes = F.greatest(visible / 60.0, F.lit(1e-6))
    part = lambda n, per: F.least(F.lit(1.0), F.coalesce(n, F.lit(0.0)) / minutes / F.lit(per))
    score = 0.20 * part(metres, 120.0) + 0.20 * part(touches, 8.0) + 0.20 * part(passes, 6.0) + 0.15 * part(duels, 3.0) + 0.15 * part(defensive, 2.0)
    score = score + 0.10 * F.least(F.lit(1.0), F.coalesce(penalty, F.lit(0.0)) / F.greatest(minutes, F.lit(1.0)))
    return F.when(visible >= min_seconds, F.round(100.0 * score, 1))
