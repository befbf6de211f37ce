"""Evidence, goals, attribution, substitutions, reviews and clips."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.labels import confirmed, evidence_status, team_index
from tracklake.operators.folds import ordered_fold
from tracklake.operators.windows import band_join, first_by


def evidence_scores(items: DataFrame, keys: list[str], first_cap: float = 0.5, next_cap: float = 0.3) -> DataFrame:
    """(keys, score, corroborated, status, sources): the best item of each source, capped, less the
    strongest contradiction. One source alone can't confirm. Replay items don't count."""
    live = items.where(~F.col("from_replay"))
    by = live.groupBy(*keys, "source").agg(F.max(F.when(F.col("score") >= 0, F.col("score"))).alias("best"), F.max(F.when(F.col("score") < 0, -F.col("score"))).alias("against"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("best").desc_nulls_last(), "source"))
    by = by.withColumn("part", F.when(F.col("best").isNotNull(), F.least(F.col("best"), F.when(rank == 1, F.lit(first_cap)).otherwise(F.lit(next_cap)))))
    agg = by.groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("s"), F.coalesce(F.max("against"), F.lit(0.0)).alias("a"), F.count(F.when(F.col("best") > 0, 1)).alias("supporting"), F.array_sort(F.collect_set("source")).alias("sources"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") - F.col("a")))
    out = agg.select(*keys, score.alias("score"), (F.col("supporting") >= 2).alias("corroborated"), "sources")
    return out.withColumn("status", evidence_status(F.col("score"), F.col("corroborated")))


def build_events(scored: DataFrame, event_type: str, keys: list[str]) -> DataFrame:
    """Events from scored signals; attribution of what isn't confirmed moves to suggested_ columns."""
    sure = F.col("status") == "auto_confirmed"
    out = scored.where("status is not null").withColumn("suggested_scorer_track_id", F.when(~sure, F.col("scorer_track_id"))).withColumn("scorer_track_id", F.when(sure, F.col("scorer_track_id")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp_ms", "signal_id"))
    return out.withColumn("event_type", F.lit(event_type)).withColumn("event_id", F.format_string(f"{event_type}-%04d", n))


def goal_line_crossings(ball: DataFrame, keys: list[str], length: float = 105.0, post_low: float = 30.34, post_high: float = 37.66) -> DataFrame:
    """Frames at which the ball passes a goal line between the posts, seen against the row before."""
    w = Window.partitionBy(*keys).orderBy("frame_id")
    b = ball.withColumn("px", F.lag("pitch_x").over(w))
    left = (F.col("px") > 0) & (F.col("pitch_x") <= 0)
    right = (F.col("px") < length) & (F.col("pitch_x") >= length)
    hit = b.where(F.col("visible") & (left | right) & F.col("pitch_y").between(post_low, post_high))
    return hit.select(*keys, "frame_id", "timestamp_ms", F.when(left, F.lit("left")).otherwise(F.lit("right")).alias("goal_side"), "pitch_y")


def scorers(goals: DataFrame, touches: DataFrame, keys: list[str], lookback_ms: float = 4000.0, min_confidence: float = 0.7) -> DataFrame:
    """goals with the last touch before each, a controlled one if there is any; resolved if sure enough."""
    g = goals.select(*keys, "goal_id", F.col("timestamp_ms").alias("goal_ms"))
    j = band_join(g, touches, keys, "goal_ms", "timestamp_ms", lookback_ms, 0.0)
    last = first_by(j, [*keys, "goal_id"], F.desc("controlled_touch"), F.desc("timestamp_ms"), F.desc("track_id"))
    sure = F.col("confidence") >= min_confidence
    s = last.select(*keys, "goal_id", F.when(sure, F.col("track_id")).alias("scorer_track_id"), F.col("team_id").alias("scorer_team_id"), F.col("confidence").alias("scorer_confidence"), F.when(sure, F.lit("resolved")).otherwise(F.lit("unresolved")).alias("scorer_status"))
    out = goals.join(s, [*keys, "goal_id"], "left")
    return out.withColumn("scorer_status", F.coalesce("scorer_status", F.lit("unresolved"))).withColumn("scorer_confidence", F.coalesce("scorer_confidence", F.lit(0.0)))


def assists(goals: DataFrame, passes: DataFrame, keys: list[str], window_ms: float = 15000.0, min_confidence: float = 0.5) -> DataFrame:
    """The latest pass to the scorer before each goal that has one and may have an assist, with its evidence score."""
    g = goals.where("scorer_track_id is not null and not own_goal and not penalty").select(*keys, "goal_id", F.col("timestamp_ms").alias("goal_ms"), "scorer_track_id")
    p = passes.where(F.col("confidence") >= min_confidence).select(*keys, F.col("end_time_ms").alias("pass_ms"), "passer_track_id", "receiver_track_id", "team_id", "confidence")
    j = band_join(g, p, keys, "goal_ms", "pass_ms", window_ms, 0.0).where((F.col("receiver_track_id") == F.col("scorer_track_id")) & (F.col("passer_track_id") != F.col("scorer_track_id")))
    last = first_by(j, [*keys, "goal_id"], F.desc("pass_ms"), "passer_track_id")
    recency = F.greatest(F.lit(0.0), 1 - (F.col("goal_ms") - F.col("pass_ms")) / window_ms)
    best, other = F.greatest(recency, F.col("confidence")), F.least(recency, F.col("confidence"))
    score = F.least(best, F.lit(0.5)) + F.least(other, F.lit(0.3))
    return last.select(*keys, "goal_id", F.col("pass_ms").alias("timestamp_ms"), F.col("passer_track_id").alias("assist_track_id"), "team_id", score.alias("score"), evidence_status(score, recency > 0).alias("status"))


def substitutions(observations: DataFrame, keys: list[str], max_gap_ms: float = 120000.0) -> DataFrame:
    """Exits paired with the nearest entry still free, in order of exits; observations: kind (exit,
    entry), timestamp_ms, track_id, team_id, confidence, came_from_bench, from_replay."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        rows = [r for r in rows if not r["from_replay"]]
        free = [r for r in rows if r["kind"] == "entry"]
        for x in (r for r in rows if r["kind"] == "exit"):
            fits = [e for e in free if (x["team_id"] is None or e["team_id"] is None or x["team_id"] == e["team_id"]) and abs(e["timestamp_ms"] - x["timestamp_ms"]) <= max_gap_ms]
            if fits:
                e = min(fits, key=lambda r: (abs(r["timestamp_ms"] - x["timestamp_ms"]), r["timestamp_ms"], r["track_id"]))
                free.remove(e)
                items = sorted([x["confidence"], e["confidence"], *([min(e["confidence"], 0.8)] if e["came_from_bench"] else [])], reverse=True)
                score = min(1.0, sum(min(s, 0.3 if k else 0.5) for k, s in enumerate(items)))
                yield (x["timestamp_ms"] + e["timestamp_ms"]) / 2, x["team_id"] or e["team_id"], x["track_id"], e["track_id"], score, len(items) > 1
            else:
                yield x["timestamp_ms"], x["team_id"], x["track_id"], None, min(x["confidence"], 0.4), False

    out = ordered_fold(observations, keys, ["timestamp_ms", "track_id"], fold, "timestamp_ms double, team_id string, player_off_track_id long, player_on_track_id long, score double, corroborated boolean")
    return out.withColumn("status", evidence_status(F.col("score"), F.col("corroborated"))).where("status is not null")


def suppress_replays(events: DataFrame, keys: list[str], window_ms: float = 12000.0, near_ms: float = 3000.0) -> DataFrame:
    """events with kept: a replayed event near a kept one of its type goes, as does one of the same team within near_ms."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        kept: list[dict] = []
        for r in rows:
            close = [k for k in kept if k["event_type"] == r["event_type"] and r["timestamp_ms"] - k["timestamp_ms"] <= window_ms]
            gone = any(r["in_replay"] or (k["team_id"] is not None and k["team_id"] == r["team_id"] and r["timestamp_ms"] - k["timestamp_ms"] < near_ms) for k in close)
            if not gone:
                kept = [*[k for k in kept if r["timestamp_ms"] - k["timestamp_ms"] <= window_ms], r]
            yield r["event_id"], r["event_type"], r["timestamp_ms"], r["team_id"], not gone

    return ordered_fold(events, keys, ["timestamp_ms", "event_id"], fold, "event_id string, event_type string, timestamp_ms double, team_id string, kept boolean")


def apply_reviews(events: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """events after their corrections in order of sequence: confirm, reject, set_scorer, set_team, set_type.
    Each kind's last one counts, and a rejection stands unless it is confirmed later."""
    last = corrections.groupBy(*keys, "event_id").agg(
        F.max_by("kind", F.when(F.col("kind").isin("confirm", "reject"), F.col("sequence"))).alias("verdict"), F.max_by("value", F.when(F.col("kind") == "set_scorer", F.col("sequence"))).alias("new_scorer"),
        F.max_by("value", F.when(F.col("kind") == "set_team", F.col("sequence"))).alias("new_team"), F.max_by("value", F.when(F.col("kind") == "set_type", F.col("sequence"))).alias("new_type"),
        F.max(F.col("kind").isin("confirm", "reject")).alias("judged"), F.max(F.col("kind") == "set_scorer").alias("has_scorer"), F.max(F.col("kind") == "set_team").alias("has_team"), F.max(F.col("kind") == "set_type").alias("has_type"),
    )
    j = events.join(last, [*keys, "event_id"], "left")
    status = F.when(F.col("judged") & (F.col("verdict") == "reject"), F.lit("rejected")).when(F.col("judged"), F.lit("manually_confirmed")).otherwise(F.col("status"))
    changed = j.withColumn("status", status).withColumn("scorer_track_id", F.when(F.col("has_scorer"), F.col("new_scorer").cast("long")).otherwise(F.col("scorer_track_id"))).withColumn("team_id", F.when(F.col("has_team"), F.col("new_team")).otherwise(F.col("team_id"))).withColumn("event_type", F.when(F.col("has_type"), F.col("new_type")).otherwise(F.col("event_type")))
    return changed.select(*events.columns)


def unmatched_reviews(events: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    return corrections.join(events.select(*keys, "event_id"), [*keys, "event_id"], "left_anti")


def credited_team() -> Column:
    """An own goal counts for the other of two teams."""
    other = F.when(team_index(F.col("team_id")) == 0, F.lit("team_1")).when(team_index(F.col("team_id")) == 1, F.lit("team_0"))
    return F.when(F.col("own_goal"), other).otherwise(F.col("team_id"))


def event_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed events by type and credited team, and how many wait for a review."""
    e = events.withColumn("credited_team", credited_team())
    waiting = F.col("status").isin("candidate_review_required", "unresolved")
    return e.groupBy(*keys, "event_type", "credited_team").agg(F.count(F.when(confirmed(F.col("status")), 1)).alias("confirmed"), F.count(F.when(waiting, 1)).alias("pending"), F.count(F.when(confirmed(F.col("status")) & F.col("scorer_track_id").isNull(), 1)).alias("unattributed"))


def clip_windows(events: DataFrame, pre_ms: float = 8000.0, post_ms: float = 5000.0) -> DataFrame:
    """events with start_ms and end_ms; a substitution's interval is used where known."""
    return events.withColumn("start_ms", F.greatest(F.lit(0.0), F.coalesce("interval_start_ms", "timestamp_ms") - pre_ms)).withColumn("end_ms", F.coalesce("interval_end_ms", "timestamp_ms") + post_ms)


def subtract_segments(start: Column, end: Column, segments: Column) -> Column:
    """Array of (start_ms, end_ms): an interval less an array of segments."""
    piece = lambda a, b: F.struct(a.alias("start_ms"), b.alias("end_ms"))

    def cut(pieces: Column, s: Column) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.when((s["end_ms"] <= p["start_ms"]) | (s["start_ms"] >= p["end_ms"]), F.array(p)).otherwise(F.array(piece(p["start_ms"], s["start_ms"]), piece(s["end_ms"], p["end_ms"])))))

    whole = F.array(piece(start, end))
    out = F.aggregate(F.coalesce(segments, F.array().cast("array<struct<start_ms:double,end_ms:double>>")), whole.cast("array<struct<start_ms:double,end_ms:double>>"), lambda acc, s: F.filter(cut(acc, s), lambda p: p["end_ms"] > p["start_ms"]))
    return out


def clips_less_replays(windows: DataFrame, replays: DataFrame, keys: list[str]) -> DataFrame:
    """windows cut by the replay segments of their match; what a replay covers whole is gone."""
    r = replays.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("segments"))
    j = windows.join(r, keys, "left")
    rest = [c for c in windows.columns if c not in ("start_ms", "end_ms")]
    return j.select(*rest, F.inline(subtract_segments(F.col("start_ms"), F.col("end_ms"), F.col("segments"))))


def merge_clips(windows: DataFrame, keys: list[str], gap_ms: float = 1000.0) -> DataFrame:
    """Windows of one type that touch or nearly touch become one, with their events' ids joined."""
    w = Window.partitionBy(*keys, "event_type").orderBy("start_ms", "event_id")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = windows.withColumn("new", F.coalesce(F.col("start_ms") - reach > gap_ms, F.lit(True)).cast("int")).withColumn("clip", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ids = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "event_id"))), lambda s: s["event_id"])), "+")
    return d.groupBy(*keys, "event_type", "clip").agg(ids.alias("event_ids"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("clip")
