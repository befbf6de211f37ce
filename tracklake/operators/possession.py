"""Possession: a state machine over the frames of a match."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import distance
from tracklake.operators.folds import ordered_fold


@dataclass(frozen=True)
class PossessionRules:
    radius_m: float = 1.8
    contest_ratio: float = 1.35
    debounce_frames: int = 3
    unknown_timeout_ms: float = 2000.0
    pass_speed: float = 2.0


@dataclass
class PossessionMachine:
    """Who has the ball. Control by another player only passes on after some frames in a row; a
    contested, loose or out-of-play ball has no owner; a ball lost for short keeps its state."""

    rules: PossessionRules = field(default_factory=PossessionRules)
    owner: tuple[int, str] | None = None
    challenger: int | None = None
    streak: int = 0
    seen: float | None = None
    last: tuple[float, float, float] | None = None

    def _drop(self, state: str, reason: str) -> tuple:
        self.owner, self.challenger, self.streak = None, None, 0
        return state, reason, None, None

    def step(self, t: float, x: float | None, y: float | None, in_play: bool, near: list) -> tuple:
        """(state, reason, owner track, owner team); near: (distance, track, team), nearest first."""
        r = self.rules
        if x is None or y is None:
            if self.seen is None or t - self.seen > r.unknown_timeout_ms:
                return self._drop("unknown", "ball_lost_timeout")
            if self.owner:
                return f"controlled_{self.owner[1]}", "ball_briefly_missing", *self.owner
            return "loose_ball", "ball_briefly_missing", None, None
        self.seen, speed = t, None
        if self.last and (t - self.last[0]) / 1000.0 > 1e-3:
            speed = math.hypot(x - self.last[1], y - self.last[2]) / ((t - self.last[0]) / 1000.0)
        self.last = (t, x, y)
        if not in_play:
            return self._drop("out_of_play", "ball_out_of_play")
        if not near:
            return self._drop("pass_in_flight", "ball_moving_free") if speed is not None and speed >= r.pass_speed else self._drop("loose_ball", "no_player_in_range")
        d, track, team = near[0]
        if any(c[2] != team and c[0] <= d * r.contest_ratio for c in near[1:]):
            return self._drop("contested", "rival_within_contest_ratio")
        if team is None:
            return self._drop("unknown", "unassigned_team_identity")
        if self.owner is None or self.owner == (track, team):
            self.owner, self.challenger, self.streak = (track, team), None, 0
        else:
            self.streak = self.streak + 1 if track == self.challenger else 1
            self.challenger = track
            if self.streak >= r.debounce_frames:
                self.owner, self.challenger, self.streak = (track, team), None, 0
        return f"controlled_{self.owner[1]}", "closest_player_control", *self.owner


def frame_candidates(frames: DataFrame, players: DataFrame, keys: list[str], rules: PossessionRules = PossessionRules()) -> DataFrame:
    """frames (keys, frame_id, timestamp_ms, ball_x, ball_y, in_play) with `near`: the players in
    reach of the ball, nearest first."""
    j = frames.join(players.select(*keys, "frame_id", "track_id", "team_id", "x_field", "y_field"), [*keys, "frame_id"], "left")
    d = distance(F.col("x_field"), F.col("y_field"), F.col("ball_x"), F.col("ball_y"))
    near = F.when(d <= rules.radius_m, F.struct(d.alias("d"), F.col("track_id").alias("track_id"), F.col("team_id").alias("team_id")))
    return j.groupBy(*frames.columns).agg(F.array_sort(F.collect_list(near)).alias("near"))


SCHEMA = "frame_id long, timestamp_ms double, possession_state string, transition_reason string, owner_track_id long, owner_team_id string"


def possession_timeline(candidates: DataFrame, keys: list[str], rules: PossessionRules = PossessionRules()) -> DataFrame:
    """A row per frame: state, reason and owner."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        machine = PossessionMachine(rules)
        for r in rows:
            near = [(c["d"], c["track_id"], c["team_id"]) for c in r["near"]]
            yield r["frame_id"], r["timestamp_ms"], *machine.step(r["timestamp_ms"], r["ball_x"], r["ball_y"], r["in_play"], near)

    return ordered_fold(candidates, keys, ["frame_id"], fold, SCHEMA)


def possession_summary(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, possession_state, frames, percent, known): frames by state and their share."""
    n = timeline.groupBy(*keys, "possession_state").agg(F.count("*").alias("frames"))
    total = F.sum("frames").over(Window.partitionBy(*keys))
    return n.withColumn("percent", F.round(100.0 * F.col("frames") / total, 1)).withColumn("known", ~F.col("possession_state").isin("unknown", "loose_ball"))
