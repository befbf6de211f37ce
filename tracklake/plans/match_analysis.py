"""The whole analysis of recordings as one DAG of named DataFrames, and its publication gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators import actions, evaluation, events, physical, possession, team

Frames = dict[str, DataFrame]
MATCH, TRACK = ["match_id"], ["match_id", "track_id"]


def touches(t: Frames) -> DataFrame:
    seen = actions.infer_touches(t["ball"], t["tracks"], MATCH)
    short = actions.touch_sessions(seen, MATCH)
    return seen.join(short.select(*MATCH, "track_id", "frame_id", "raw_touch_count"), [*MATCH, "track_id", "frame_id"])


def timeline(t: Frames) -> DataFrame:
    frames = t["ball"].select(*MATCH, "frame_id", "timestamp_ms", F.col("pitch_x").alias("ball_x"), F.col("pitch_y").alias("ball_y"), "in_play")
    return possession.possession_timeline(possession.frame_candidates(frames, t["tracks"], MATCH), MATCH)


def defensive(t: Frames) -> DataFrame:
    return actions.turnovers(t["passes"], MATCH).unionByName(actions.infer_clearances(t["touches"], MATCH), allowMissingColumns=True)


def players(t: Frames) -> DataFrame:
    seen = t["tracks"].groupBy(*TRACK, "team_id").agg((F.countDistinct("frame_id") / F.lit(25.0)).alias("visible_seconds"))
    ids = seen.select("*", F.lit("player").alias("role"), F.lit("candidate").alias("identity_quality"), F.lit(True).alias("unresolved"))
    metrics = t["player_metrics"].where("valid").select(*TRACK, F.col("total_distance_m").alias("distance_m"), "max_speed_kmh", "sprint_count", F.lit(1.0).alias("metric_quality"))
    dribbles = t["dribbles"].withColumn("successful", F.lit(False))
    duels = t["duels"].withColumn("winner_track_id", F.lit(None).cast("long"))
    return actions.player_summary(ids, t["touches"], t["passes"], dribbles, duels, t["defensive"], metrics, MATCH)


#: name: function of the tables so far; each result is a table for those after it.
STAGES: dict[str, Callable[[Frames], DataFrame]] = {
    "player_metrics": lambda t: physical.player_metrics(t["tracks"], TRACK),
    "team_shape": lambda t: team.team_shape(t["tracks"], [*MATCH, "frame_id", "team_id"]),
    "heatmaps": lambda t: team.dwell_heatmap(t["tracks"], TRACK),
    "possession": timeline,
    "touches": touches,
    "chain": lambda t: actions.possession_chain(t["touches"], MATCH),
    "passes": lambda t: actions.infer_passes(t["touches"], MATCH),
    "dribbles": lambda t: actions.infer_dribbles(t["touches"], MATCH),
    "duels": lambda t: actions.infer_duels(t["touches"], t["tracks"], MATCH),
    "defensive": defensive,
    "goal_crossings": lambda t: events.goal_line_crossings(t["ball"], MATCH),
    "players": players,
    "teams": lambda t: actions.team_summary(t["players"], MATCH),
}


def analyse(tables: Frames, upto: str | None = None) -> Frames:
    """tables with the result of every stage, up to one of them. Needs tracks (foot and field
    positions) and ball. Nothing runs here: what isn't asked for isn't computed."""
    out = dict(tables)
    for name, stage in STAGES.items():
        out[name] = stage(out)
        if name == upto:
            break
    return out


def publish(tables: Frames, facts: DataFrame, needs: dict[str, str]) -> Frames:
    """The tables whose publication flag (needs: table to flag) holds, match by match."""
    flags = evaluation.publishability(facts)
    return {name: tables[name].join(flags.where(F.col(flag)).select("match_id"), "match_id", "left_semi") for name, flag in needs.items()}
