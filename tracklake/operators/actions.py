"""Touches and what follows from them: sessions, chains, passes, duels, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import distance
from tracklake.functions.labels import action_status, attack_sign, in_opponent_penalty, known_team, percent, zone_third
from tracklake.operators.team import activity_index
from tracklake.operators.windows import band_join, first_by, gap_sessions, islands


def numbered(df: DataFrame, keys: list[str], prefix: str, *order: str, name: str) -> DataFrame:
    """Adds an id such as pass-00007, counted within the keys (a match) in an order without ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.format_string(f"{prefix}-%05d", F.row_number().over(w)))


def infer_touches(ball: DataFrame, tracks: DataFrame, keys: list[str], max_px: float = 55.0, max_m: float = 2.5, min_ball: float = 0.15, min_touch: float = 0.35) -> DataFrame:
    """Per frame with a visible ball the player most likely to touch it.

    ball: keys, frame_id, timestamp_ms, visible, ball_confidence, interpolated, ball_x_pixel, ball_y_pixel,
    pitch_x, pitch_y; tracks: keys, frame_id, track_id, team_id, foot_x_pixel, foot_y_pixel, x_field,
    y_field. Change of speed is taken within runs of visible frames.
    """
    b = islands(ball, keys, ["frame_id"], ~F.col("visible"), "run").where("visible")
    given = F.coalesce("ball_confidence", F.lit(0.0))
    conf = F.when(given > 0, given).when(F.col("interpolated"), F.lit(0.10)).otherwise(F.lit(0.15))
    b = b.where(F.col("ball_x_pixel").isNotNull() & F.col("ball_y_pixel").isNotNull() & ((given >= min_ball) | (given <= 0))).withColumn("bc", conf)
    r = Window.partitionBy(*keys, "run").orderBy("frame_id")
    b = b.withColumn("speed", distance(F.col("ball_x_pixel"), F.col("ball_y_pixel"), F.lag("ball_x_pixel").over(r), F.lag("ball_y_pixel").over(r)))
    b = b.withColumn("delta", F.coalesce(F.abs(F.col("speed") - F.lag("speed").over(r)), F.lit(0.0)))
    j = b.join(tracks.select(*keys, "frame_id", "track_id", "team_id", "foot_x_pixel", "foot_y_pixel", "x_field", "y_field"), [*keys, "frame_id"])
    px = distance(F.col("foot_x_pixel"), F.col("foot_y_pixel"), F.col("ball_x_pixel"), F.col("ball_y_pixel"))
    j = j.withColumn("distance_px", px).withColumn("distance_m", distance(F.col("x_field"), F.col("y_field"), F.col("pitch_x"), F.col("pitch_y")))
    j = j.where((F.col("distance_px") <= max_px) & F.coalesce(F.col("distance_m") <= max_m, F.lit(True)))
    score = 0.55 * F.greatest(F.lit(0.0), 1 - F.col("distance_px") / max_px) + 0.25 * F.col("bc") + F.when(F.col("delta") > 8.0, 0.15).otherwise(0.0)
    j = j.withColumn("confidence", F.least(score, F.lit(1.0)))
    best = first_by(j, [*keys, "frame_id"], F.desc("confidence"), "track_id").where(F.col("confidence") >= min_touch)
    c, d = F.col("confidence"), F.col("delta")
    out = best.select(*keys, "frame_id", "timestamp_ms", "track_id", "team_id", "confidence", ((c >= 0.55) & (d >= 5.0)).alias("controlled_touch"), ((c < 0.55) & (d >= 12.0)).alias("deflection"), (c < 0.65).alias("candidate_only"), "distance_px", "distance_m", "pitch_x", "pitch_y")
    return numbered(out, keys, "touch", "timestamp_ms", "track_id", name="touch_id")


def touch_sessions(touches: DataFrame, keys: list[str], gap_ms: float = 300.0) -> DataFrame:
    """One row for the contacts of a player that follow each other within the gap: the most
    confident one's values, and first, last and number of frames."""
    s = gap_sessions(touches, [*keys, "track_id"], "timestamp_ms", gap_ms, "frame_id")
    peak = F.max_by(F.struct("frame_id", "timestamp_ms"), F.struct("confidence", (-F.col("frame_id")).alias("f")))
    out = s.groupBy(*keys, "track_id", "session").agg(peak.alias("p"), F.max("confidence").alias("confidence"), F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count("*").alias("raw_touch_count"))
    return out.select(*keys, "track_id", F.col("p.frame_id").alias("frame_id"), F.col("p.timestamp_ms").alias("timestamp_ms"), "confidence", "start_frame", "end_frame", "raw_touch_count", (F.col("raw_touch_count") > 1).alias("deduplicated"))


def _pairs(touches: DataFrame, keys: list[str]) -> DataFrame:
    """Each touch with the one before (a.*, b.*)."""
    w = Window.partitionBy(*keys).orderBy("timestamp_ms", "track_id")
    row = F.struct(*[c for c in touches.columns if c not in keys])
    return touches.select(*keys, row.alias("b"), F.lag(row).over(w).alias("a"), F.row_number().over(w).alias("n"))


def possession_chain(touches: DataFrame, keys: list[str], max_gap_ms: float = 4000.0, min_confidence: float = 0.4) -> DataFrame:
    """Hand-overs within a team; a long gap or another team starts the next chain."""
    p = _pairs(touches, keys).where("a is not null")
    gap = F.col("b.timestamp_ms") - F.col("a.timestamp_ms")
    other = F.col("a.track_id") != F.col("b.track_id")
    same = F.coalesce(F.col("a.team_id") == F.col("b.team_id"), F.lit(False))
    stale = (gap <= 0) | (gap > max_gap_ms)
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("chain", F.sum((stale | (other & ~same)).cast("int")).over(w))
    conf = F.least("a.confidence", "b.confidence")
    p = p.where(~stale & other & same & (conf >= min_confidence)).withColumn("confidence", conf)
    seg = F.row_number().over(Window.partitionBy(*keys, "chain").orderBy("n"))
    return p.select(*keys, F.format_string("chain-%04d", "chain").alias("chain_id"), seg.alias("segment_index"), F.col("a.timestamp_ms").alias("start_ms"), F.col("b.timestamp_ms").alias("end_ms"), F.col("a.team_id").alias("team_id"), F.col("a.track_id").alias("from_track_id"), F.col("b.track_id").alias("to_track_id"), "confidence", F.col("a.controlled_touch").alias("pass_like"), (F.col("a.deflection") | F.col("b.deflection")).alias("deflection"))


def passes_from_chain(chain: DataFrame) -> DataFrame:
    return chain.where("pass_like").select(*[c for c in chain.columns if c not in ("pass_like", "segment_index")])


def infer_passes(touches: DataFrame, keys: list[str], max_gap_ms: float = 4000.0, min_confidence: float = 0.45, long_m: float = 25.0, progress_m: float = 10.0, sign: int = 1) -> DataFrame:
    """Consecutive touches of two players: a pass, successful within one team."""
    p = _pairs(touches, keys).where("a is not null")
    gap = F.col("b.timestamp_ms") - F.col("a.timestamp_ms")
    ta, tb = known_team(F.col("a.team_id")), known_team(F.col("b.team_id"))
    conf = F.least("a.confidence", "b.confidence")
    p = p.where((gap > 0) & (gap <= max_gap_ms) & (F.col("a.track_id") != F.col("b.track_id")) & ta.isNotNull() & tb.isNotNull() & F.col("a.controlled_touch") & (conf >= min_confidence))
    shown = F.when(F.col("a.deflection") | F.col("b.deflection"), F.least(conf, F.lit(0.5))).otherwise(conf)
    far = distance(F.col("b.pitch_x"), F.col("b.pitch_y"), F.col("a.pitch_x"), F.col("a.pitch_y"))
    forward = (F.col("b.pitch_x") - F.col("a.pitch_x")) * attack_sign(ta, sign)
    ok = ta == tb
    out = p.select(
        *keys, F.col("a.track_id").alias("passer_track_id"), F.col("b.track_id").alias("receiver_track_id"), ta.alias("team_id"), F.col("a.timestamp_ms").alias("start_time_ms"), F.col("b.timestamp_ms").alias("end_time_ms"),
        F.col("a.pitch_x").alias("start_x"), F.col("a.pitch_y").alias("start_y"), F.col("b.pitch_x").alias("end_x"), F.col("b.pitch_y").alias("end_y"), zone_third(F.col("a.pitch_x"), ta, sign).alias("start_zone"), zone_third(F.col("b.pitch_x"), ta, sign).alias("end_zone"),
        far.alias("distance_m"), forward.alias("forward_progress_m"), ok.alias("successful"), F.coalesce(far >= long_m, F.lit(False)).alias("long_pass"), F.coalesce((forward >= progress_m) & ok, F.lit(False)).alias("progressive_pass"), shown.alias("confidence"), action_status(shown).alias("status"),
    )
    return numbered(out, keys, "pass", "start_time_ms", "end_time_ms", "passer_track_id", name="pass_id")


def infer_clearances(touches: DataFrame, keys: list[str], min_m: float = 8.0, sign: int = 1) -> DataFrame:
    """A controlled touch in the own third after which the ball is next touched far away, not by a team mate."""
    p = _pairs(touches, keys).where("a is not null and a.controlled_touch")
    far = distance(F.col("b.pitch_x"), F.col("b.pitch_y"), F.col("a.pitch_x"), F.col("a.pitch_y"))
    team = known_team(F.col("a.team_id"))
    mate = (F.col("a.track_id") != F.col("b.track_id")) & known_team(F.col("b.team_id")).eqNullSafe(team)
    p = p.where((zone_third(F.col("a.pitch_x"), team, sign) == "zone_1") & (far >= min_m) & ~mate)
    out = p.select(*keys, F.lit("clearance").alias("action_type"), F.col("a.track_id").alias("track_id"), team.alias("team_id"), F.col("a.timestamp_ms").alias("timestamp_ms"), F.lit("zone_1").alias("start_zone"), zone_third(F.col("b.pitch_x"), team, sign).alias("end_zone"), far.alias("distance_m"), F.col("a.confidence").alias("confidence"), action_status(F.col("a.confidence")).alias("status"))
    return numbered(out, keys, "clr", "timestamp_ms", "track_id", name="action_id")


def turnovers(passes: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows for each failed pass: the interception, and the passer's loss of the ball."""
    lost = passes.where("not successful")
    hit = F.col("receiver_track_id").isNotNull()
    rows = F.array(
        F.struct(F.lit(1).alias("part"), F.when(hit, F.lit("interception")).otherwise(F.lit("turnover")).alias("action_type"), F.col("receiver_track_id").alias("track_id"), F.lit(None).cast("string").alias("team_id"), F.col("end_time_ms").alias("timestamp_ms")),
        F.struct(F.lit(2).alias("part"), F.when(hit, F.lit("dispossession")).otherwise(F.lit("turnover")).alias("action_type"), F.col("passer_track_id").alias("track_id"), F.col("team_id").alias("team_id"), F.col("start_time_ms").alias("timestamp_ms")),
    )
    out = lost.select(*keys, "pass_id", "start_zone", "end_zone", "distance_m", "confidence", F.explode(rows).alias("r"))
    out = out.select(*keys, "pass_id", "r.*", "start_zone", "end_zone", "distance_m", "confidence", action_status(F.col("confidence")).alias("status"))
    return numbered(out, keys, "def", "pass_id", "part", name="action_id").drop("part", "pass_id")


def infer_duels(touches: DataFrame, tracks: DataFrame, keys: list[str], band_ms: float = 400.0, near_m: float = 2.5) -> DataFrame:
    """The two samples nearest to a touch within the band, if of opposing teams."""
    t = touches.where("pitch_x is not null").select(*keys, "touch_id", F.col("timestamp_ms").alias("touch_ms"), F.col("track_id").alias("toucher"), "pitch_x", "pitch_y")
    s = tracks.where("x_field is not null").select(*keys, "timestamp_ms", "track_id", "team_id", "x_field", "y_field")
    j = band_join(t, s, keys, "touch_ms", "timestamp_ms", band_ms, band_ms)
    j = j.withColumn("d", distance(F.col("x_field"), F.col("y_field"), F.col("pitch_x"), F.col("pitch_y"))).where(F.col("d") <= near_m)
    two = first_by(j, [*keys, "touch_id"], "d", "timestamp_ms", "track_id", rows=2)
    pair = two.groupBy(*keys, "touch_id", "touch_ms", "toucher").agg(F.array_sort(F.collect_list(F.struct("d", "timestamp_ms", "track_id", "team_id"))).alias("p")).where("size(p) = 2")
    a, b = F.col("p")[0], F.col("p")[1]
    pair = pair.where(a["team_id"] != b["team_id"])
    own = (F.col("toucher") == a["track_id"]) | (F.col("toucher") == b["track_id"])
    out = pair.select(*keys, "touch_id", a["track_id"].alias("player_a"), b["track_id"].alias("player_b"), a["team_id"].alias("team_a"), b["team_id"].alias("team_b"), F.col("touch_ms").alias("timestamp_ms"), F.lit("ground_duel").alias("duel_type"), F.lit(0.45).alias("confidence"), F.when(own, F.lit("candidate")).otherwise(F.lit("unresolved")).alias("status"))
    return numbered(out, keys, "duel", "timestamp_ms", "touch_id", name="duel_id")


def infer_dribbles(touches: DataFrame, keys: list[str], min_m: float = 3.0) -> DataFrame:
    """From a player's first to last controlled touch, if far enough."""
    at = F.struct("timestamp_ms", "pitch_x", "pitch_y", "confidence")
    g = touches.where("controlled_touch").groupBy(*keys, "track_id").agg(F.min_by(at, "timestamp_ms").alias("a"), F.max_by(at, "timestamp_ms").alias("b"), F.count("*").alias("n")).where("n >= 2")
    far = distance(F.col("b.pitch_x"), F.col("b.pitch_y"), F.col("a.pitch_x"), F.col("a.pitch_y"))
    conf = F.least(F.col("a.confidence"), F.col("b.confidence"), F.lit(0.55))
    out = g.where(far >= min_m).select(*keys, F.col("track_id").alias("attacker_track_id"), F.col("a.timestamp_ms").alias("timestamp_ms"), F.col("a.pitch_x").alias("start_x"), F.col("a.pitch_y").alias("start_y"), F.col("b.pitch_x").alias("end_x"), F.col("b.pitch_y").alias("end_y"), far.alias("distance_m"), conf.alias("confidence"), action_status(conf).alias("status"))
    return numbered(out, keys, "drb", "attacker_track_id", name="dribble_id")


#: Counts that add up over a team's players, and shares of a first in a second that are taken anew.
SUMS = (
    "pass_attempts", "passes_completed", "long_pass_attempts", "long_passes_completed", "zone_1_to_2_passes", "zone_2_to_3_passes", "dribble_attempts", "dribbles_completed",
    "duels", "duels_won", "aerial_duels", "aerial_duels_won", "tackles_won", "interceptions", "clearances", "turnovers", "penalty_area_touches",
)
SHARES = (("passes_completed", "pass_attempts", "pass_completion_pct"), ("long_passes_completed", "long_pass_attempts", "long_pass_completion_pct"), ("dribbles_completed", "dribble_attempts", "dribble_success_pct"), ("duels_won", "duels", "duel_win_pct"))


def metric_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distance, top speed and sprint rows of each track from rows of cumulative distance, smoothed speed and sprint state; tracks without a valid row are left out."""
    ok = rows.where("valid")
    return ok.groupBy(*keys, "track_id").agg(F.max("cumulative_distance_m").alias("distance_m"), F.max("smoothed_speed_kmh").alias("max_speed_kmh"), F.count(F.when(F.col("sprint_state") == "sprint", 1)).alias("sprint_count"), F.avg(F.col("valid").cast("double")).alias("metric_quality"))


def player_summary(identities: DataFrame, touches: DataFrame, passes: DataFrame, dribbles: DataFrame, duels: DataFrame, defensive: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per identity (track_id, team_id, role, visible_seconds, identity_quality, unresolved): its confirmed
    passes, dribbles, duels and defensive actions, its touches, its metrics (see metric_totals) and activity."""
    me = [*keys, "track_id"]
    n = lambda cond: F.count(F.when(F.col(cond) if isinstance(cond, str) else cond, 1))
    done = F.col("successful")
    p = confirmed_only(passes).withColumnRenamed("passer_track_id", "track_id").groupBy(*me).agg(
        F.count("*").alias("pass_attempts"), n(done).alias("passes_completed"), n("long_pass").alias("long_pass_attempts"), n(F.col("long_pass") & done).alias("long_passes_completed"),
        n((F.col("start_zone") == "zone_1") & (F.col("end_zone") == "zone_2") & done).alias("zone_1_to_2_passes"), n((F.col("start_zone") == "zone_2") & (F.col("end_zone") == "zone_3") & done).alias("zone_2_to_3_passes"),
    )
    g = confirmed_only(dribbles).withColumnRenamed("attacker_track_id", "track_id").groupBy(*me).agg(F.count("*").alias("dribble_attempts"), n(done).alias("dribbles_completed"))
    won, aerial = F.coalesce(F.col("winner_track_id") == F.col("track_id"), F.lit(False)), F.col("duel_type") == "aerial_duel"
    d = confirmed_only(duels).select(*keys, "duel_type", "winner_track_id", F.explode(F.array("player_a", "player_b")).alias("track_id")).groupBy(*me).agg(
        F.count("*").alias("duels"), n(won).alias("duels_won"), n(aerial).alias("aerial_duels"), n(aerial & won).alias("aerial_duels_won"))
    kind = lambda k: n(F.col("action_type") == k)
    e = confirmed_only(defensive).where("track_id is not null").groupBy(*me).agg(kind("tackle_won").alias("tackles_won"), kind("interception").alias("interceptions"), kind("clearance").alias("clearances"), kind("turnover").alias("turnovers"), kind("dispossession").alias("dispossessions"))
    t = touches.join(identities.select(*me, F.col("team_id").alias("own_team")), me).groupBy(*me).agg(F.count("*").alias("touches"), n(F.col("controlled_touch") & in_opponent_penalty(F.col("pitch_x"), F.col("pitch_y"), F.col("own_team"))).alias("penalty_area_touches"))
    out = identities
    for part in (p, g, d, e, t, metrics.select(*me, "distance_m", "max_speed_kmh", "sprint_count", "metric_quality")):
        out = out.join(part, me, "left")
    counts = [c for part in (p, g, d, e, t) for c in part.columns if c not in me]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    num = lambda c: F.col(c).cast("double")
    active = activity_index(F.col("visible_seconds"), F.col("distance_m"), num("touches"), num("pass_attempts"), num("duels"), num("tackles_won") + num("interceptions") + num("clearances"), num("penalty_area_touches"))
    out = out.withColumn("activity_index", active).withColumns({name: percent(F.col(x), F.col(y)) for x, y, name in SHARES})
    flags = F.concat_ws(",", F.when(F.col("unresolved"), "unresolved_identity"), F.when(F.col("metric_quality") < 0.3, "low_metric_coverage"), F.when(F.col("activity_index").isNull(), "activity_insufficient_visibility"))
    return out.withColumns({"distance_m": F.round("distance_m", 1), "max_speed_kmh": F.round("max_speed_kmh", 1), "quality_flags": flags, "jersey_number": F.lit(None).cast("int")}).drop("unresolved", "touches")


def team_summary(players: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over a team's players (teams that are known), with percentages taken anew."""
    known = known_team(F.col("team_id"))
    out = players.where(known.isNotNull()).groupBy(*keys, "team_id").agg(
        F.count(F.when(F.col("identity_quality") != "low", 1)).alias("validated_player_count"), F.round(F.coalesce(F.avg("metric_quality"), F.lit(0.0)), 2).alias("metric_coverage"),
        F.round(F.coalesce(F.sum("distance_m"), F.lit(0.0)), 1).alias("total_distance_m"), F.coalesce(F.sum("sprint_count"), F.lit(0)).alias("sprint_count"), *[F.sum(c).alias(c) for c in SUMS],
    )
    return out.withColumns({name: percent(F.col(x), F.col(y)) for x, y, name in SHARES})


def confirmed_only(df: DataFrame, status: Column | None = None) -> DataFrame:
    """Rows of confirmed actions; all others may be shown but aren't counted."""
    return df.where((F.col("status") if status is None else status) == "confirmed")
