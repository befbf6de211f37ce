"""Structured Streaming forms: fused timeline, touch sessions, possession.

Time is event time. Rows later than the watermark are dropped, as results are never revised.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklake.operators.possession import PossessionMachine, PossessionRules

WATERMARK = "2 seconds"


def fused_timeline(observations: DataFrame, keys: list[str], bin_size: str = "200 milliseconds", watermark: str = WATERMARK) -> DataFrame:
    """Weighted place of each identity in tumbling windows of event_time."""
    w = F.greatest(F.col("detection_confidence"), F.lit(1e-9))
    out = observations.withWatermark("event_time", watermark).groupBy(F.window("event_time", bin_size), *keys).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"), F.count("*").alias("observation_count"), F.avg("detection_confidence").alias("confidence"))
    return out.select(F.col("window.start").alias("start"), *keys, "x", "y", "observation_count", "confidence")


def touch_sessions(touches: DataFrame, keys: list[str], gap: str = "300 milliseconds", watermark: str = WATERMARK) -> DataFrame:
    """Contacts of a player that follow each other within the gap."""
    out = touches.withWatermark("event_time", watermark).groupBy(F.session_window("event_time", gap), *keys).agg(F.max("confidence").alias("confidence"), F.count("*").alias("raw_touch_count"))
    return out.select(F.col("session_window.start").alias("start"), *keys, "confidence", "raw_touch_count")


STATE = "owner_track long, owner_team string, challenger long, streak int, seen double, last_t double, last_x double, last_y double"
OUT = "match_id long, frame_id long, timestamp_ms double, possession_state string, owner_track_id long, owner_team_id string"


def possession_stream(frames: DataFrame, rules: PossessionRules = PossessionRules()) -> DataFrame:
    """A row per frame as it comes; the machine's few values are the state of a match. Frames of a
    match have match_id, frame_id, timestamp_ms, ball_x, ball_y, in_play, near (d, track_id, team_id)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = PossessionMachine(rules)
        if state.exists:
            ot, team, ch, streak, seen, lt, lx, ly = state.get
            m.owner = (ot, team) if team is not None else None
            m.challenger, m.streak, m.seen = ch, streak, seen
            m.last = (lt, lx, ly) if lt is not None else None
        rows = pd.concat(list(batches)).sort_values("frame_id")
        out = []
        known = lambda v: None if v is None or pd.isna(v) else float(v)
        for r in rows.itertuples():
            near = [(c["d"], c["track_id"], c["team_id"]) for c in (r.near if r.near is not None else [])]
            s, _, track, team = m.step(r.timestamp_ms, known(r.ball_x), known(r.ball_y), bool(r.in_play), near)
            out.append((key[0], r.frame_id, r.timestamp_ms, s, track, team))
        owner, last = m.owner or (None, None), m.last or (None, None, None)
        state.update((owner[0], owner[1], m.challenger, m.streak, m.seen, *last))
        yield pd.DataFrame(out, columns=["match_id", "frame_id", "timestamp_ms", "possession_state", "owner_track_id", "owner_team_id"]).astype({"owner_track_id": "Int64"})

    return frames.groupBy("match_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
