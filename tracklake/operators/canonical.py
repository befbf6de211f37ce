"""Joins that build canonical tables from tracks, calibration, shots, identities and the ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import inverse, matrix, project, to_pitch
from tracklake.functions.labels import action_status, known_team
from tracklake.operators.windows import first_by, mode_by, ordered_sum


def people(rows: DataFrame) -> DataFrame:
    """Rows of people, where the table says what its objects are."""
    return rows.where("object_type = 'person'") if "object_type" in rows.columns else rows


def renamed(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns that there are, under their new names; others are dropped."""
    return rows.select(*[F.col(c).alias(n) for c, n in mapping.items() if c in rows.columns])


def with_quality(game_state: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """game_state with quality_ok, false for tracks that the quality table doesn't have."""
    return game_state.drop("quality_ok").join(quality.select(*keys, F.col("usable_for_metrics").alias("quality_ok")), keys, "left").withColumn("quality_ok", F.coalesce("quality_ok", F.lit(False)))


def team_samples(game_state: DataFrame, identities: DataFrame, frame_keys: list[str]) -> DataFrame:
    """game_state of players whose identity in the frame has one of the two teams, with that team and its confidence."""
    i = identities.where(F.col("team_id").isin("team_0", "team_1")).select(*frame_keys, "team_id", "team_confidence")
    return game_state.drop("team_id", "team_confidence").join(i, frame_keys)


def game_state(tracks: DataFrame, calibration: DataFrame, shots: DataFrame, identities: DataFrame, frame: list[str], spatial_shots: tuple[str, ...] = ("wide", "tactical")) -> DataFrame:
    """A row for each track's foot point with its place on the pitch, where the frame's calibration is valid, its shot shows
    the pitch and the place is on it, or the first reason why there is none."""
    c = calibration.select(*frame, "homography_json", F.col("valid").alias("calibrated"), F.col("confidence").alias("calibration_confidence"), F.col("reason").alias("calibration_reason"))
    d = tracks.join(c, frame, "left").join(shots.select(*frame, "shot_type"), frame, "left").join(identities.select(*frame, "track_id", "role", "team_id"), [*frame, "track_id"], "left")
    shot = F.coalesce("shot_type", F.lit("unknown"))
    at = to_pitch(matrix(F.col("homography_json")), F.col("foot_x_pixel"), F.col("foot_y_pixel"), F.coalesce("calibrated", F.lit(False)) & shot.isin(*spatial_shots))
    d = d.withColumn("at", at).withColumn("shot_type", shot)
    why = F.coalesce(F.when(~F.coalesce("calibrated", F.lit(False)), F.coalesce("calibration_reason", F.lit("calibration_missing"))), F.when(~F.col("shot_type").isin(*spatial_shots), F.concat(F.lit("shot_type_"), "shot_type", F.lit("_not_spatial"))), F.lit("foot_point_outside_pitch"))
    ok = F.col("at").isNotNull()
    return d.select(*frame, "timestamp_ms", "track_id", "role", "team_id", "foot_x_pixel", "foot_y_pixel", "at.x", "at.y", "shot_type", ok.alias("valid"), F.when(ok, F.col("calibration_confidence")).otherwise(0.0).alias("calibration_confidence"), F.when(~ok, why).alias("invalid_reason")).withColumnsRenamed({"x": "x_field", "y": "y_field"})


def touches_on_pitch(touches: DataFrame, ball: DataFrame, frame: list[str]) -> DataFrame:
    """touches with the ball's place on the pitch in their frame, unless they have places of their own."""
    if "pitch_x" in touches.columns:
        return touches
    return touches.join(ball.select(*frame, "pitch_x", "pitch_y"), frame, "left")


def touch_motion(touches: DataFrame, ball: DataFrame, match: list[str]) -> DataFrame:
    """touches with the change of the ball's speed and direction since the frame before, where both frames have them."""
    w = Window.partitionBy(*match).orderBy("frame_id")
    joined = F.lag("frame_id").over(w) == F.col("frame_id") - 1
    b = ball.select(*match, "frame_id", *[F.when(joined, F.abs(F.col(c) - F.lag(c).over(w))).alias(n) for c, n in (("velocity_mps", "ball_velocity_change"), ("direction", "ball_direction_change"))])
    return touches.join(b, [*match, "frame_id"], "left").withColumns({"pose_evidence": F.lit(False), "status": action_status(F.col("confidence")), "timestamp": F.col("timestamp_ms") / 1000.0})


def aerial_candidates(touches: DataFrame, ball: DataFrame, frame: list[str]) -> DataFrame:
    """A candidate aerial duel, of one known player, for each touch in a frame in which the ball is in the air."""
    air = ball.where("visibility_state = 'airborne'").select(*frame)
    return touches.join(air, frame, "left_semi").select(*[c for c in frame if c != "frame_id"], F.concat(F.lit("aerial-cand-"), "touch_id").alias("duel_id"), F.col("track_id").alias("player_a"), F.col("team_id").alias("team_a"), "timestamp_ms", F.lit("aerial_duel").alias("duel_type"), F.lit(0.42).alias("confidence"), F.lit("candidate").alias("status"))


def mapped(rows: DataFrame, ids: DataFrame, keys: list[str], local: str = "track_id", to: str = "global_id") -> DataFrame:
    """rows with the id that their local one stands for, or the local one itself where there is none."""
    m = ids.select(*keys, F.col(local), F.col(to))
    return rows.join(m, [*keys, local], "left").withColumn(to, F.coalesce(to, local))


def preferred(game: DataFrame, identities: DataFrame, tracks: DataFrame, frame_track: list[str]) -> DataFrame:
    """Role and team of each track's row: those of the game state where it has the row, else those of the identity."""
    g = game.select(*frame_track, F.struct("role", "team_id").alias("game"))
    i = identities.select(*frame_track, F.struct("role", "team_id").alias("identity"))
    d = tracks.join(g, frame_track, "left").join(i, frame_track, "left").withColumn("source", F.coalesce("game", "identity"))
    return d.select(*tracks.columns, F.col("source.role").alias("role"), known_team(F.col("source.team_id")).alias("team_id"))


def display_teams(identities: DataFrame, displays: DataFrame, match: list[str]) -> DataFrame:
    """identities with one team for all tracks of a display id, the one of most team confidence, summed by frame and
    track; tracks without a display id, and displays without any team, keep theirs."""
    member = identities.join(displays.select(*match, "track_id", "display_id"), [*match, "track_id"], "left")
    votes = member.where("display_id is not null and team_id is not null").groupBy(*match, "display_id", "team_id").agg(ordered_sum(F.col("team_confidence"), "frame_id", "track_id").alias("vote"))
    best = first_by(votes, [*match, "display_id"], F.desc("vote"), "team_id").select(*match, "display_id", F.col("team_id").alias("locked"))
    out = member.join(best, [*match, "display_id"], "left")
    return out.withColumns({"team_id": F.coalesce("locked", "team_id"), "valid": F.coalesce("valid", F.lit(False)) | F.col("locked").isNotNull()}).select(*identities.columns, "display_id")


def speed_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Of each track's valid rows: frames, seconds, distance, mean and top speed, sprint frames and coverage."""
    return metrics.where("valid").groupBy(*keys).agg(
        F.count("frame_id").alias("measurable_frames"), F.greatest((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0, F.lit(0.0)).alias("measurable_seconds"), F.max("cumulative_distance_m").alias("total_distance_m"),
        F.avg("smoothed_speed_kmh").alias("average_moving_speed_kmh"), F.max("smoothed_speed_kmh").alias("maximum_reliable_speed_kmh"), F.count(F.when(F.col("sprint_state") == "sprint", 1)).alias("sprint_frames"), F.max("coverage").alias("coverage"),
    )


def shape_stats(boxes: DataFrame, frame: list[str], frame_height: float) -> DataFrame:
    """Boxes in each frame, and the median and largest of their heights over the frame's."""
    h = F.greatest(F.col("bbox_y2") - F.col("bbox_y1"), F.lit(0.0)) / F.lit(float(frame_height))
    return boxes.groupBy(*frame).agg(F.count("*").alias("count"), F.median(h).alias("median_height"), F.max(h).alias("largest_height"))


def interpolation_runs(ball: DataFrame, match: list[str]) -> DataFrame:
    """ball with the number of each interpolated row in its run of interpolated rows, 0 for others."""
    w = Window.partitionBy(*match).orderBy("frame_id")
    d = ball.withColumn("run", F.sum(F.when(F.col("interpolated"), 0).otherwise(1)).over(w))
    n = F.sum(F.col("interpolated").cast("int")).over(Window.partitionBy(*match, "run").orderBy("frame_id"))
    return d.withColumn("interpolation_run", F.when(F.col("interpolated"), n).otherwise(F.lit(0)).cast("long")).drop("run")


def spotted_score(signals: DataFrame, spotted: DataFrame, match: list[str], window_ms: float = 2500.0) -> DataFrame:
    """signals (signal_id, timestamp_ms) with the highest confidence of a spotted goal (timestamp in seconds) within the
    window to either side; by time buckets as wide as the window."""
    g = spotted.where(F.lower("event_type") == "goal").select(*match, (F.col("timestamp") * 1000.0).alias("spotted_ms"), "confidence")
    slot = lambda c: F.floor(F.col(c) / window_ms)
    g = g.withColumn("slot", F.explode(F.array(slot("spotted_ms") - 1, slot("spotted_ms"), slot("spotted_ms") + 1)))
    hit = signals.withColumn("slot", slot("timestamp_ms")).join(g, [*match, "slot"]).where(F.abs(F.col("spotted_ms") - F.col("timestamp_ms")) <= window_ms)
    return signals.join(hit.groupBy(*match, "signal_id").agg(F.max("confidence").alias("spotting_score")), [*match, "signal_id"], "left")


#: Signals of a shot and the columns that have their scores.
SHOT_SOURCES = ("ball_toward_goal", "ball_speed_spike", "striking_pose", "goalkeeper_reaction")


def shot_evidence(signals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, score, from_replay): a row for each score that a signal of a possible shot has."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}_score").alias("score")) for s in SHOT_SOURCES]))
    return signals.select(*keys, "from_replay", each.alias("e")).select(*keys, "e.source", "e.score", "from_replay").where("score is not null")


def shooter(min_attribution: float = 0.7) -> Column:
    """The shooter, where attributed well enough and not from a replay."""
    return F.when((F.col("shooter_attribution_score") >= min_attribution) & ~F.col("from_replay"), F.col("shooter_track_id"))


def events_frame(events: DataFrame) -> DataFrame:
    """Events as flat rows with attributes and evidence as JSON, in order of time."""
    return events.select("match_id", "event_id", "event_type", "status", "timestamp_ms", (F.col("timestamp_ms") / 1000.0).alias("timestamp_seconds"), "team_id", "scorer_track_id", "confidence", F.to_json("attributes").alias("attributes_json"), F.col("attributes.in_replay").alias("in_replay"))


def pitch_box(tracks: DataFrame, box: tuple[Column, Column, Column, Column], homography: Column) -> DataFrame:
    """tracks with the lower corners and the middle of the lower edge of their boxes on the pitch."""
    m = matrix(homography)
    left, right = project(m, box[0], box[3]), project(m, box[2], box[3])
    middle = project(m, (box[0] + box[2]) / 2, box[3])
    return tracks.withColumns({"x_bottom_left": left[0], "y_bottom_left": left[1], "x_bottom_right": right[0], "y_bottom_right": right[1], "x_bottom_middle": middle[0], "y_bottom_middle": middle[1]})


def projected_corners(homography: Column, length: float = 105.0, width: float = 68.0) -> list[tuple[Column, Column]]:
    """Corners of the pitch in the picture, through the inverse of a homography."""
    m = inverse(matrix(homography))
    return [project(m, F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (length, 0.0), (length, width), (0.0, width))]


def mean_metric(rows: DataFrame, keys: list[str], column: str, default: float) -> DataFrame:
    """Mean of a metric between 0 and 1, the default where no row has it; a value out of range is an error."""
    v = F.when(F.col(column).isNull() | F.col(column).between(0.0, 1.0), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} out of range: "), F.col(column).cast("string"))).cast("double"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(v), F.lit(float(default))).alias(column))


def crop_votes(crops: DataFrame, keys: list[str], min_votes: int = 3, dark: float = 0.5) -> DataFrame:
    """Team of each track by the majority of its crops' labels, without dark kits; null under min_votes."""
    ok = crops.where(F.col("dark_share") < dark)
    n = ok.groupBy(*keys).agg(F.count("*").alias("votes"))
    top = mode_by(ok, keys, "label").select(*keys, "label")
    return crops.select(*keys).distinct().join(n, keys, "left").join(top, keys, "left").select(*keys, F.coalesce("votes", F.lit(0)).alias("votes"), F.when(F.col("votes") >= min_votes, F.col("label")).alias("team"))


def whiter_first(assigned: DataFrame, match: list[str]) -> DataFrame:
    """assigned (track_id, label 0 or 1, white) with labels flipped where label 1 has the whiter kits."""
    w = Window.partitionBy(*match)
    a, b = (F.avg(F.when(F.col("label") == k, F.col("white"))).over(w) for k in (0, 1))
    return assigned.withColumn("label", F.when(F.coalesce(b > a, F.lit(False)), 1 - F.col("label")).otherwise(F.col("label")))


def effective_offset(offsets: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """times (local_s) with their camera's offset at that time: the estimate, or else the manual one, and drift since it was measured."""
    at = F.coalesce("offset_seconds", "manual_offset_seconds") + F.coalesce("drift_rate", F.lit(0.0)) * (F.col("local_s") - F.coalesce("measured_at_seconds", F.lit(0.0)))
    return times.join(offsets, keys, "left").withColumn("effective_offset_seconds", at).select(*times.columns, "effective_offset_seconds")


def rebased_offsets(offsets: DataFrame, match: list[str], reference: str) -> DataFrame:
    """offsets less that of the reference camera of the match."""
    r = offsets.where(F.col("camera_id") == reference).select(*match, F.col("offset_seconds").alias("base"))
    return offsets.join(r, match, "left").withColumn("offset_seconds", F.col("offset_seconds") - F.col("base")).drop("base")


def coverage_report(coverage: DataFrame, gaps: DataFrame, match: list[str], expected: list[str]) -> DataFrame:
    """Of each match its cameras, those that are missing, and gaps with their seconds."""
    c = coverage.groupBy(*match).agg(F.array_sort(F.collect_set("camera_id")).alias("have"))
    g = gaps.groupBy(*match).agg(F.count("*").alias("gaps"), F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("gap_seconds"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in expected]), F.col("have")))
    return c.join(g, match, "left").select(*match, F.array_join("have", ",").alias("cameras"), F.array_join(missing, ",").alias("missing_cameras"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("gap_seconds", F.lit(0.0)).alias("gap_seconds"))


def local_tracks(observations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per camera and local track: observations, first and last time, mean place."""
    return observations.groupBy(*keys, "camera_id", "local_track_id").agg(F.count("*").alias("observations"), F.min("t").alias("first_s"), F.max("t").alias("last_s"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def tracklet_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tracklets with their frames in order."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set("frame_id")), lambda x: x.cast("string")), ",").alias("frames"), F.countDistinct("frame_id").alias("n_frames"))
