"""Registered queries over the bridged driver tables, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.functions import labels as L
from tracklake.functions import vectors as V
from tracklake.operators import actions, evaluation, events, folds, greedy, identity, multicamera, physical, possession, roles, summaries, team, windows
from tracklake.plans import match_analysis
from tracklake.plans.bridge import MATCH, SQL, TRACK, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "team_shape_by_frame"
FRAME = ["match_id", "frame_id"]


def query(sql: str | None = None, floats: str = "") -> Callable:
    """Registers f(tables); `floats` are rounded to 9 digits in both engines (and -0.0 is 0.0)."""
    names = floats.split()

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in names}) if names else out

        QUERIES[f.__name__] = run
        if sql:
            replace = " REPLACE (" + ", ".join(f"round(CAST({c} AS DOUBLE), 9) + 0.0 AS {c}" for c in names) + ")" if names else ""
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {SQL}, result AS ({sql}) SELECT *{replace} FROM result"
        return f

    return add


@query("""
SELECT match_id, frame_id, team_id, count(*) >= 4 AS valid, CASE WHEN count(*) < 4 THEN 'insufficient_players' END AS invalid_reason, count(*) AS player_count, least(count(*) / 4.0, 1.0) AS player_coverage,
  CASE WHEN count(*) >= 4 THEN avg(x_field) END AS centroid_x, CASE WHEN count(*) >= 4 THEN avg(y_field) END AS centroid_y, CASE WHEN count(*) >= 4 THEN max(y_field) - min(y_field) END AS width_m, CASE WHEN count(*) >= 4 THEN max(x_field) - min(x_field) END AS depth_m,
  CASE WHEN count(*) >= 4 THEN max(pd) END AS mean_pair_distance_m, CASE WHEN count(*) >= 4 THEN avg(sqrt((x_field - cx) * (x_field - cx) + (y_field - cy) * (y_field - cy))) END AS compactness_m, CASE WHEN count(*) >= 4 THEN max(x_field) END AS last_line_x
FROM (SELECT p.*, avg(p.x_field) OVER w AS cx, avg(p.y_field) OVER w AS cy, q.pd FROM tr p LEFT JOIN (
    SELECT a.frame_id AS f, a.team_id AS g, avg(sqrt((a.x_field - b.x_field) * (a.x_field - b.x_field) + (a.y_field - b.y_field) * (a.y_field - b.y_field))) AS pd FROM tr a JOIN tr b ON a.frame_id = b.frame_id AND a.team_id = b.team_id AND a.track_id < b.track_id
    WHERE a.calibration_valid AND b.calibration_valid AND a.team_confidence >= 0.6 AND b.team_confidence >= 0.6 GROUP BY ALL) q ON q.f = p.frame_id AND q.g = p.team_id
  WHERE calibration_valid AND team_confidence >= 0.6 WINDOW w AS (PARTITION BY frame_id, team_id)) GROUP BY match_id, frame_id, team_id
""", "player_coverage centroid_x centroid_y width_m depth_m mean_pair_distance_m compactness_m last_line_x")  # fmt: skip
def team_shape_by_frame(t: Tables) -> DataFrame:
    return team.team_shape(t.tracks, [*FRAME, "team_id"])


@query("""SELECT match_id, team_id, CAST(least(greatest(floor(x_field / 105.0 * 6), 0), 5) AS INTEGER) AS bin_x, CAST(least(greatest(floor(y_field / 68.0 * 4), 0), 3) AS INTEGER) AS bin_y, count(*) AS n FROM tr WHERE calibration_valid AND team_confidence >= 0.6 GROUP BY ALL""")
def team_occupancy_grid(t: Tables) -> DataFrame:
    return team.occupancy(t.tracks, ["match_id", "team_id"])


@query("""
SELECT *, dwell_ms / sum(dwell_ms) OVER (PARTITION BY match_id, track_id) AS share FROM (SELECT match_id, track_id, bin_x, bin_y, sum(half) AS dwell_ms FROM (
  SELECT match_id, track_id, gap / 2 AS half, unnest([bx, pbx]) AS bin_x, unnest([by_, pby]) AS bin_y FROM (
    SELECT *, timestamp_ms - lag(timestamp_ms) OVER w AS gap, lag(ok) OVER w AS pok, lag(bx) OVER w AS pbx, lag(by_) OVER w AS pby FROM (
      SELECT *, NOT replay AND calibration_valid AND x_field BETWEEN 0 AND 105 AND y_field BETWEEN 0 AND 68 AS ok, CAST(least(greatest(floor(x_field / 105.0 * 21), 0), 20) AS INTEGER) AS bx, CAST(least(greatest(floor(y_field / 68.0 * 14), 0), 13) AS INTEGER) AS by_ FROM tr)
    WINDOW w AS (PARTITION BY match_id, track_id ORDER BY timestamp_ms)) WHERE ok AND pok AND gap > 0 AND gap <= 1500) GROUP BY ALL)
""", "dwell_ms share")  # fmt: skip
def dwell_heatmap(t: Tables) -> DataFrame:
    return team.dwell_heatmap(t.tracks, TRACK)


@query("""SELECT match_id, track_id, greatest(count(*) FILTER (x_field <= 16.5), count(*) FILTER (x_field >= 88.5)) / count(*) AS penalty_area_share FROM tr WHERE NOT replay AND calibration_valid AND x_field BETWEEN 0 AND 105 AND y_field BETWEEN 0 AND 68 GROUP BY ALL""", "penalty_area_share")
def goalkeeper_dwell_share(t: Tables) -> DataFrame:
    return team.penalty_area_share(t.tracks, TRACK)


_SPEEDS = """
pv AS (SELECT *, lag(timestamp_ms) OVER w AS pt, lag(x_field) OVER w AS px, lag(y_field) OVER w AS py FROM tr WINDOW w AS (PARTITION BY match_id, track_id ORDER BY timestamp_ms)),
sp AS (SELECT *, CASE WHEN v <= 40 THEN v END AS speed_kmh, s AS step_m FROM (SELECT *, sqrt((x_field - px) * (x_field - px) + (y_field - py) * (y_field - py)) AS s, sqrt((x_field - px) * (x_field - px) + (y_field - py) * (y_field - py)) / ((timestamp_ms - pt) / 1000.0) * 3.6 AS v FROM pv))
"""


@query(f"""WITH {_SPEEDS} SELECT match_id, track_id, frame_id, speed_kmh, sum(CASE WHEN speed_kmh IS NOT NULL THEN step_m ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY timestamp_ms) AS cumulative_distance_m FROM sp""", "speed_kmh cumulative_distance_m")
def instantaneous_speed(t: Tables) -> DataFrame:
    return physical.row_speeds(t.tracks, TRACK).select(*TRACK, "frame_id", "speed_kmh", "cumulative_distance_m")


@query(f"""WITH {_SPEEDS} SELECT match_id, track_id, frame_id, avg(speed_kmh) OVER (PARTITION BY match_id, track_id ORDER BY timestamp_ms RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS smoothed_kmh FROM sp WHERE speed_kmh IS NOT NULL""", "smoothed_kmh")
def smoothed_speed(t: Tables) -> DataFrame:
    rows = physical.row_speeds(t.tracks, TRACK).where("speed_kmh is not null")
    return windows.centred_average(rows, TRACK, "timestamp_ms", "speed_kmh", 500.0, "smoothed_kmh").select(*TRACK, "frame_id", "smoothed_kmh")


@query(f"""
WITH {_SPEEDS}, a AS (SELECT match_id, track_id, speed_kmh AS v, greatest(coalesce(lag(speed_kmh) OVER w, speed_kmh), coalesce(lead(speed_kmh) OVER w, speed_kmh)) AS around FROM sp WHERE speed_kmh IS NOT NULL WINDOW w AS (PARTITION BY match_id, track_id ORDER BY timestamp_ms))
SELECT match_id, track_id, max(v) AS raw_max_kmh, CAST(sum(CASE WHEN v >= 30 AND v - around > 8 THEN 1 ELSE 0 END) AS BIGINT) AS spikes, quantile_cont(v, 0.95) AS p95_kmh, max(v) FILTER (NOT (v >= 30 AND v - around > 8)) AS reported_max_kmh FROM a GROUP BY ALL
""", "raw_max_kmh p95_kmh reported_max_kmh")  # fmt: skip
def speed_spike_audit(t: Tables) -> DataFrame:
    return physical.speed_audit(physical.row_speeds(t.tracks, TRACK), TRACK)


_FOLD = """
us AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY timestamp_ms) AS n FROM tr WHERE calibration_valid AND shot_type = 'wide' AND confidence >= 0.2),
walk AS (
  SELECT match_id, track_id, n, timestamp_ms AS t, x_field AS x, y_field AS y, CAST(NULL AS DOUBLE) AS v, CAST(1 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS dist, CAST(NULL AS DOUBLE) AS kmh, timestamp_ms AS moment FROM us WHERE n = 1
  UNION ALL
  SELECT match_id, track_id, n, CASE WHEN gap > 1500 OR ok THEN t2 ELSE t END, CASE WHEN gap > 1500 OR ok THEN x2 ELSE x END, CASE WHEN gap > 1500 OR ok THEN y2 ELSE y END, CASE WHEN gap > 1500 THEN NULL WHEN ok THEN nv ELSE v END, used + CASE WHEN gap > 1500 OR ok THEN 1 ELSE 0 END, dist + CASE WHEN gap <= 1500 AND ok THEN far ELSE 0 END, CASE WHEN gap <= 1500 AND ok THEN nv * 3.6 END, t2
  FROM (SELECT *, nv * 3.6 <= 40 AND (v IS NULL OR abs(nv - v) / sec <= 8) AS ok FROM (SELECT *, far / sec AS nv FROM (
    SELECT w.match_id, w.track_id, u.n, w.t, w.x, w.y, w.v, w.used, w.dist, u.timestamp_ms AS t2, u.x_field AS x2, u.y_field AS y2, u.timestamp_ms - w.t AS gap, greatest((u.timestamp_ms - w.t) / 1000.0, 0.001) AS sec,
      sqrt((u.x_field - w.x) * (u.x_field - w.x) + (u.y_field - w.y) * (u.y_field - w.y)) AS far FROM walk w JOIN us u ON u.match_id = w.match_id AND u.track_id = w.track_id AND u.n = w.n + 1))))
"""


@query(f"""
WITH RECURSIVE {_FOLD}, last AS (SELECT match_id, track_id, max(n) AS usable, max(used) AS used, max(dist) AS dist, count(kmh) AS moves FROM walk GROUP BY ALL)
SELECT a.match_id, a.track_id, coalesce(usable >= 3 AND moves > 0, false) AS valid, CASE WHEN coalesce(usable, 0) < 3 THEN 'insufficient_usable_samples' WHEN moves = 0 THEN 'no_valid_motion_segments' END AS invalid_reason, CASE WHEN usable >= 3 AND moves > 0 THEN dist END AS total_distance_m, a.samples AS sample_count
FROM (SELECT match_id, track_id, count(*) AS samples FROM tr GROUP BY ALL) a LEFT JOIN last USING (match_id, track_id)
""", "total_distance_m")  # fmt: skip
def player_distance_gated(t: Tables) -> DataFrame:
    m = physical.player_metrics(t.tracks, TRACK)
    return m.select(*TRACK, "valid", "invalid_reason", "total_distance_m", "sample_count")


@query()
def player_metrics(t: Tables) -> DataFrame:
    return physical.player_metrics(t.tracks, TRACK)


@query(f"""
WITH RECURSIVE {_FOLD}, s AS (SELECT match_id, track_id, moment, avg(kmh) OVER (PARTITION BY match_id, track_id ORDER BY moment RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS k FROM walk WHERE kmh IS NOT NULL),
b AS (SELECT *, k >= 5 AS fast, CASE WHEN (k >= 5) IS DISTINCT FROM lag(k >= 5) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY match_id, track_id ORDER BY moment)),
r AS (SELECT *, sum(new) OVER (PARTITION BY match_id, track_id ORDER BY moment) AS run FROM b)
SELECT match_id, track_id, min(moment) AS start_ms, max(moment) AS end_ms, max(k) AS peak_kmh FROM r WHERE fast GROUP BY match_id, track_id, run HAVING max(moment) - min(moment) >= 1000
""", "start_ms end_ms peak_kmh")  # fmt: skip
def sprint_episodes(t: Tables) -> DataFrame:
    slow = physical.MotionLimits(sprint_kmh=5.0, min_samples=1)  # bridged players are slow
    series = physical.speed_series(physical.accepted_motion(t.tracks, TRACK, slow), TRACK, slow)
    return physical.sprints(series, TRACK, slow)


@query("""
WITH f AS (SELECT match_id, track_id, frame_id, frame_id - lag(frame_id) OVER (PARTITION BY match_id, track_id ORDER BY frame_id) AS gap, confidence FROM tr),
a AS (SELECT match_id, track_id, count(*) AS observations, max(frame_id) - min(frame_id) + 1 AS frame_span, count(*) FILTER (gap > 1) AS fragmentation_count, avg(confidence) AS mean_tracking_confidence, CAST(1 AS DOUBLE) AS valid_bbox_fraction FROM f GROUP BY ALL)
SELECT *, observations / frame_span AS coverage, observations / frame_span AS continuity, least(greatest(pow(observations / frame_span, 0.2) * pow(observations / frame_span, 0.25) * pow(mean_tracking_confidence, 0.2) * pow(valid_bbox_fraction, 0.1), 0), 1) AS quality_score FROM a
""", "mean_tracking_confidence valid_bbox_fraction coverage continuity quality_score")  # fmt: skip
def track_quality(t: Tables) -> DataFrame:
    return physical.track_quality(t.tracks.withColumn("bbox_valid", F.lit(True)), TRACK)


@query("""SELECT match_id, track_id, count(DISTINCT frame_id) AS visible_frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(DISTINCT frame_id) / 250.0 AS visible_fraction FROM tr WHERE NOT replay GROUP BY ALL""", "visible_fraction")
def track_visibility(t: Tables) -> DataFrame:
    return physical.visibility(t.tracks, TRACK, 250)


@query("""SELECT match_id, frame_id, sum(CASE WHEN scene_cut THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_id) AS segment FROM tr WHERE track_id = 0""")
def scene_segments(t: Tables) -> DataFrame:
    return windows.islands(t.frames, MATCH, ["frame_id"], F.col("scene_cut"), "segment").select(*FRAME, "segment")


@query("""
WITH m AS (SELECT match_id, track_id, team_id, sum(confidence) AS total_distance_m FROM tr GROUP BY ALL)
SELECT team_id, track_id, CAST(grouping(team_id) * 2 + grouping(track_id) AS BIGINT) AS level, count(*) AS rows, sum(total_distance_m) AS total_distance_m FROM m GROUP BY ROLLUP (team_id, track_id)
""", "total_distance_m")  # fmt: skip
def player_team_rollup(t: Tables) -> DataFrame:
    m = t.tracks.groupBy("match_id", "track_id", "team_id").agg(F.sum("confidence").alias("total_distance_m"))
    return team.team_rollup(m)


@query("""
WITH b AS (SELECT *, lag(pitch_x) OVER w AS px, lag(pitch_y) OVER w AS py, lag(timestamp_ms) OVER w AS pt, lag(visible) OVER w AS pv FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame_id))
SELECT match_id, frame_id, CASE WHEN visible AND pv THEN sqrt((pitch_x - px) * (pitch_x - px) + (pitch_y - py) * (pitch_y - py)) / ((timestamp_ms - pt) / 1000.0) END AS speed_ms, CASE WHEN visible AND pv THEN atan2(pitch_y - py, pitch_x - px) END AS direction FROM b
""", "speed_ms direction")  # fmt: skip
def ball_velocity(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*MATCH).orderBy("frame_id")
    b = t.ball.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("pitch_x", "pitch_y", "timestamp_ms", "visible")})
    both = F.col("visible") & F.col("p_visible")
    far = G.distance(F.col("pitch_x"), F.col("pitch_y"), F.col("p_pitch_x"), F.col("p_pitch_y"))
    return b.select(*FRAME, F.when(both, far / ((F.col("timestamp_ms") - F.col("p_timestamp_ms")) / 1000.0)).alias("speed_ms"), F.when(both, F.atan2(F.col("pitch_y") - F.col("p_pitch_y"), F.col("pitch_x") - F.col("p_pitch_x"))).alias("direction"))


@query("""
WITH b AS (SELECT match_id, frame_id, visible, last_value(CASE WHEN visible THEN pitch_x END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN visible THEN frame_id END IGNORE NULLS) OVER w AS f FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING))
SELECT match_id, frame_id, CASE WHEN visible THEN 'detected' WHEN frame_id - f <= 5 THEN 'held' ELSE 'missing' END AS provenance, CASE WHEN visible OR frame_id - f <= 5 THEN x END AS held_x FROM b
""", "held_x")  # fmt: skip
def ball_hold_short_gap(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*MATCH).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = t.ball.withColumn("x", F.last(F.when(F.col("visible"), F.col("pitch_x")), True).over(w)).withColumn("f", F.last(F.when(F.col("visible"), F.col("frame_id")), True).over(w))
    near = F.col("frame_id") - F.col("f") <= 5
    return b.select(*FRAME, F.when(F.col("visible"), "detected").when(near, "held").otherwise("missing").alias("provenance"), F.when(F.col("visible") | near, F.col("x")).alias("held_x"))


@query("""
WITH b AS (SELECT match_id, frame_id, visible, CASE WHEN visible IS DISTINCT FROM lag(visible) OVER (PARTITION BY match_id ORDER BY frame_id) THEN 1 ELSE 0 END AS new FROM ball), r AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY frame_id) AS run FROM b),
n AS (SELECT match_id, run, count(*) AS c FROM r WHERE NOT visible GROUP BY ALL) SELECT match_id, max(c) / 25.0 AS seconds FROM n GROUP BY match_id
""", "seconds")  # fmt: skip
def longest_missing_interval(t: Tables) -> DataFrame:
    return physical.longest_run_seconds(t.ball.withColumn("missing", ~F.col("visible")), MATCH, "missing", 25.0)


def _timeline(t: Tables) -> DataFrame:
    frames = t.ball.select(*FRAME, "timestamp_ms", F.col("pitch_x").alias("ball_x"), F.col("pitch_y").alias("ball_y"), "in_play")
    return possession.possession_timeline(possession.frame_candidates(frames, t.tracks, MATCH), MATCH)


@query()
def possession_timeline(t: Tables) -> DataFrame:
    return _timeline(t)


@query()
def possession_summary(t: Tables) -> DataFrame:
    return possession.possession_summary(_timeline(t), MATCH)


@query()
def ball_kalman(t: Tables) -> DataFrame:
    c = F.when(F.col("visible"), F.array(F.struct(F.col("ball_x_pixel").alias("x"), F.col("ball_y_pixel").alias("y"), F.col("ball_confidence").alias("confidence"), F.lit(12.0).alias("size"))))
    frames = t.ball.join(t.frames.select(*FRAME, "scene_cut"), FRAME).select(*FRAME, "timestamp_ms", c.alias("candidates"), "scene_cut")
    return folds.ball_trajectory(frames, MATCH, folds.BallRules(kalman=True))


@query()
def wrong_object_filter(t: Tables) -> DataFrame:
    d = t.ball.where("visible").select(*FRAME, F.col("ball_x_pixel").alias("x"), F.col("ball_y_pixel").alias("y"), (F.lit(10.0) + F.col("frame_id") % 7).alias("size"), F.col("ball_confidence").alias("confidence"))
    return folds.wrong_object_filter(d, MATCH)


@query()
def smoothed_boxes(t: Tables) -> DataFrame:
    return folds.smoothed_boxes(t.boxes, TRACK)


@query()
def calibration_states(t: Tables) -> DataFrame:
    f = t.frames.select(*FRAME, "shot_type", "scene_cut", (F.col("event_type") != "error").alias("measured"), "confidence", (F.col("frame_id") % 50).cast("double").alias("corner_jump"))
    return folds.calibration_states(f, MATCH)


@query()
def calibration_propagation(t: Tables) -> DataFrame:
    f = t.frames.select(*FRAME, "scene_cut", (F.col("event_type") == "click").alias("valid"), (F.col("frame_id") % 60).cast("double").alias("px"), F.lit(0.0).alias("py"))
    return folds.propagate_calibration(f, MATCH)


_TOUCH = """
WITH s AS (SELECT * FROM (SELECT *, sum(CASE WHEN visible THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY frame_id) AS run FROM ball) WHERE visible AND (ball_confidence >= 0.15 OR ball_confidence <= 0)),
v AS (SELECT *, CASE WHEN ball_confidence > 0 THEN ball_confidence WHEN interpolated THEN 0.10 ELSE 0.15 END AS bc, sqrt((ball_x_pixel - lag(ball_x_pixel) OVER w) * (ball_x_pixel - lag(ball_x_pixel) OVER w) + (ball_y_pixel - lag(ball_y_pixel) OVER w) * (ball_y_pixel - lag(ball_y_pixel) OVER w)) AS speed FROM s WINDOW w AS (PARTITION BY match_id, run ORDER BY frame_id)),
d AS (SELECT *, coalesce(abs(speed - lag(speed) OVER (PARTITION BY match_id, run ORDER BY frame_id)), 0) AS delta FROM v),
j AS (SELECT d.*, t.track_id, t.team_id, sqrt((t.x_field * 10 - ball_x_pixel) * (t.x_field * 10 - ball_x_pixel) + (t.y_field * 10 - ball_y_pixel) * (t.y_field * 10 - ball_y_pixel)) AS distance_px, sqrt((t.x_field - pitch_x) * (t.x_field - pitch_x) + (t.y_field - pitch_y) * (t.y_field - pitch_y)) AS distance_m FROM d JOIN tr t ON t.frame_id = d.frame_id),
c AS (SELECT *, least(0.55 * greatest(0, 1 - distance_px / 55.0) + 0.25 * bc + CASE WHEN delta > 8 THEN 0.15 ELSE 0 END, 1.0) AS confidence FROM j WHERE distance_px <= 55 AND distance_m <= 2.5),
b AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY confidence DESC, track_id) AS rn FROM c)
SELECT match_id, frame_id, timestamp_ms, track_id, team_id, confidence, confidence >= 0.55 AND delta >= 5 AS controlled_touch, confidence < 0.55 AND delta >= 12 AS deflection, confidence < 0.65 AS candidate_only, distance_px, distance_m, printf('touch-%05d', row_number() OVER (PARTITION BY match_id ORDER BY timestamp_ms, track_id)) AS touch_id FROM b WHERE rn = 1 AND confidence >= 0.35
"""


@query(_TOUCH, "confidence distance_px distance_m")
def touch_inference(t: Tables) -> DataFrame:
    tracks = t.tracks.select(*FRAME, "track_id", "team_id", (F.col("x_field") * 10).alias("foot_x_pixel"), (F.col("y_field") * 10).alias("foot_y_pixel"), "x_field", "y_field")
    return actions.infer_touches(t.ball, tracks, MATCH).drop("pitch_x", "pitch_y")


@query("""
WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM s GROUP BY ALL
""")
def event_sessions(t: Tables) -> DataFrame:
    e = t.raw("events").select("user_id", "event_id", F.expr("unix_millis(cast(ts as timestamp))").alias("ms"))
    return windows.gap_sessions(e, ["user_id"], "ms", 3_600_000, "event_id").groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query("""
WITH g AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w <= 2000 THEN 0 ELSE 1 END AS new FROM touches WINDOW w AS (PARTITION BY match_id, track_id ORDER BY timestamp_ms, frame_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY match_id, track_id ORDER BY timestamp_ms, frame_id) AS session FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id, session ORDER BY confidence DESC, frame_id) AS rn FROM s)
SELECT match_id, track_id, max(frame_id) FILTER (rn = 1) AS frame_id, max(timestamp_ms) FILTER (rn = 1) AS timestamp_ms, max(confidence) AS confidence, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS raw_touch_count, count(*) > 1 AS deduplicated FROM r GROUP BY match_id, track_id, session
""", "confidence timestamp_ms")  # fmt: skip
def touch_sessions(t: Tables) -> DataFrame:
    return actions.touch_sessions(t.touches, MATCH, 2000.0)


_PAIRS = "pr AS (SELECT b.*, {lags}, row_number() OVER w AS n FROM touches b WINDOW w AS (PARTITION BY match_id ORDER BY timestamp_ms, track_id))".format(lags=", ".join(f"lag({c}) OVER w AS a_{c}" for c in ("timestamp_ms", "track_id", "team_id", "confidence", "controlled_touch", "deflection", "pitch_x", "pitch_y")))


@query(f"""
WITH {_PAIRS}, p AS (SELECT *, sum(CASE WHEN timestamp_ms - a_timestamp_ms <= 0 OR timestamp_ms - a_timestamp_ms > 4000 OR (track_id <> a_track_id AND team_id <> a_team_id) THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY n) AS chain FROM pr WHERE a_track_id IS NOT NULL)
SELECT match_id, printf('chain-%04d', chain) AS chain_id, CAST(row_number() OVER (PARTITION BY match_id, chain ORDER BY n) AS INTEGER) AS segment_index, a_timestamp_ms AS start_ms, timestamp_ms AS end_ms, a_team_id AS team_id, a_track_id AS from_track_id, track_id AS to_track_id, least(a_confidence, confidence) AS confidence, a_controlled_touch AS pass_like, a_deflection OR deflection AS deflection
FROM p WHERE timestamp_ms > a_timestamp_ms AND timestamp_ms - a_timestamp_ms <= 4000 AND track_id <> a_track_id AND team_id = a_team_id AND least(a_confidence, confidence) >= 0.4
""", "confidence")  # fmt: skip
def possession_chain(t: Tables) -> DataFrame:
    return actions.possession_chain(t.touches, MATCH)


_ZONE = "CASE WHEN (CASE WHEN a_team_id = 'team_1' THEN 105 - {x} ELSE {x} END) < 35 THEN 'zone_1' WHEN (CASE WHEN a_team_id = 'team_1' THEN 105 - {x} ELSE {x} END) < 70 THEN 'zone_2' ELSE 'zone_3' END"
_STATUS = "CASE WHEN {c} >= 0.65 THEN 'confirmed' WHEN {c} >= 0.4 THEN 'candidate' ELSE 'unresolved' END"
_PASSES = f"""
WITH {_PAIRS}, q AS (SELECT *, CASE WHEN a_deflection OR deflection THEN least(a_confidence, confidence, 0.5) ELSE least(a_confidence, confidence) END AS conf, sqrt((pitch_x - a_pitch_x) * (pitch_x - a_pitch_x) + (pitch_y - a_pitch_y) * (pitch_y - a_pitch_y)) AS far, (pitch_x - a_pitch_x) * CASE WHEN a_team_id = 'team_1' THEN -1 ELSE 1 END AS fwd
  FROM pr WHERE timestamp_ms > a_timestamp_ms AND timestamp_ms - a_timestamp_ms <= 4000 AND track_id <> a_track_id AND a_controlled_touch AND least(a_confidence, confidence) >= 0.45)
SELECT match_id, a_track_id AS passer_track_id, track_id AS receiver_track_id, a_team_id AS team_id, a_timestamp_ms AS start_time_ms, timestamp_ms AS end_time_ms, a_pitch_x AS start_x, a_pitch_y AS start_y, pitch_x AS end_x, pitch_y AS end_y, {_ZONE.format(x="a_pitch_x")} AS start_zone, {_ZONE.format(x="pitch_x")} AS end_zone,
  far AS distance_m, fwd AS forward_progress_m, team_id = a_team_id AS successful, far >= 25 AS long_pass, fwd >= 10 AND team_id = a_team_id AS progressive_pass, conf AS confidence, {_STATUS.format(c="conf")} AS status, printf('pass-%05d', row_number() OVER (PARTITION BY match_id ORDER BY a_timestamp_ms, timestamp_ms, a_track_id)) AS pass_id FROM q
"""


@query(_PASSES, "distance_m forward_progress_m confidence start_x start_y end_x end_y")
def passes(t: Tables) -> DataFrame:
    return actions.infer_passes(t.touches, MATCH)


ORACLE_CLEARANCES = f"""
WITH {_PAIRS} SELECT match_id, 'clearance' AS action_type, a_track_id AS track_id, a_team_id AS team_id, a_timestamp_ms AS timestamp_ms, 'zone_1' AS start_zone, {_ZONE.format(x="pitch_x")} AS end_zone, sqrt((pitch_x - a_pitch_x) * (pitch_x - a_pitch_x) + (pitch_y - a_pitch_y) * (pitch_y - a_pitch_y)) AS distance_m, a_confidence AS confidence, {_STATUS.format(c="a_confidence")} AS status,
  printf('clr-%05d', row_number() OVER (PARTITION BY match_id ORDER BY a_timestamp_ms, a_track_id)) AS action_id
FROM pr WHERE a_controlled_touch AND {_ZONE.format(x="a_pitch_x")} = 'zone_1' AND sqrt((pitch_x - a_pitch_x) * (pitch_x - a_pitch_x) + (pitch_y - a_pitch_y) * (pitch_y - a_pitch_y)) >= 8 AND NOT (track_id <> a_track_id AND team_id = a_team_id)
"""


@query(ORACLE_CLEARANCES, "distance_m confidence")
def clearances(t: Tables) -> DataFrame:
    return actions.infer_clearances(t.touches, MATCH)


ORACLE_TURNOVERS = f"""
WITH ps AS ({_PASSES}), r AS (SELECT match_id, pass_id, 1 AS part, 'interception' AS action_type, receiver_track_id AS track_id, CAST(NULL AS VARCHAR) AS team_id, end_time_ms AS timestamp_ms, start_zone, end_zone, distance_m, confidence FROM ps WHERE NOT successful
  UNION ALL SELECT match_id, pass_id, 2, 'dispossession', passer_track_id, team_id, start_time_ms, start_zone, end_zone, distance_m, confidence FROM ps WHERE NOT successful)
SELECT match_id, action_type, track_id, team_id, timestamp_ms, start_zone, end_zone, distance_m, confidence, {_STATUS.format(c="confidence")} AS status, printf('def-%05d', row_number() OVER (PARTITION BY match_id ORDER BY pass_id, part)) AS action_id FROM r
"""


@query(ORACLE_TURNOVERS, "distance_m confidence")
def turnovers_explode(t: Tables) -> DataFrame:
    return actions.turnovers(actions.infer_passes(t.touches, MATCH), MATCH)


ORACLE_DUELS = """
WITH j AS (SELECT c.match_id, c.touch_id, c.timestamp_ms AS touch_ms, c.track_id AS toucher, t.track_id, t.team_id, t.timestamp_ms, sqrt((t.x_field - c.pitch_x) * (t.x_field - c.pitch_x) + (t.y_field - c.pitch_y) * (t.y_field - c.pitch_y)) AS d FROM touches c JOIN tr t ON t.match_id = c.match_id AND t.timestamp_ms BETWEEN c.timestamp_ms - 400 AND c.timestamp_ms + 400),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, touch_id ORDER BY d, timestamp_ms, track_id) AS rn FROM j WHERE d <= 2.5),
p AS (SELECT a.match_id, a.touch_id, a.track_id AS player_a, b.track_id AS player_b, a.team_id AS team_a, b.team_id AS team_b, a.touch_ms AS timestamp_ms, a.toucher FROM r a JOIN r b USING (match_id, touch_id) WHERE a.rn = 1 AND b.rn = 2 AND a.team_id <> b.team_id)
SELECT match_id, touch_id, player_a, player_b, team_a, team_b, timestamp_ms, 'ground_duel' AS duel_type, 0.45 AS confidence, CASE WHEN toucher IN (player_a, player_b) THEN 'candidate' ELSE 'unresolved' END AS status, printf('duel-%05d', row_number() OVER (PARTITION BY match_id ORDER BY timestamp_ms, touch_id)) AS duel_id FROM p
"""


@query(ORACLE_DUELS, "confidence")
def duels_band_join(t: Tables) -> DataFrame:
    return actions.infer_duels(t.touches, t.tracks, MATCH)


ORACLE_DRIBBLES = f"""
WITH g AS (SELECT match_id, track_id, arg_min(pitch_x, timestamp_ms) AS ax, arg_min(pitch_y, timestamp_ms) AS ay, arg_max(pitch_x, timestamp_ms) AS bx, arg_max(pitch_y, timestamp_ms) AS by_, min(timestamp_ms) AS ts, least(arg_min(confidence, timestamp_ms), arg_max(confidence, timestamp_ms), 0.55) AS conf FROM touches WHERE controlled_touch GROUP BY ALL HAVING count(*) >= 2)
SELECT match_id, track_id AS attacker_track_id, ts AS timestamp_ms, ax AS start_x, ay AS start_y, bx AS end_x, by_ AS end_y, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS distance_m, conf AS confidence, {_STATUS.format(c="conf")} AS status, printf('drb-%05d', row_number() OVER (PARTITION BY match_id ORDER BY track_id)) AS dribble_id
FROM g WHERE sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) >= 3
"""


@query(ORACLE_DRIBBLES, "start_x start_y end_x end_y distance_m confidence")
def dribbles(t: Tables) -> DataFrame:
    return actions.infer_dribbles(t.touches, MATCH)


_CONFIRMED = f"""
ids AS (SELECT match_id, track_id, team_id, CASE WHEN track_id % 11 = 0 THEN 'goalkeeper' ELSE 'player' END AS role, count(DISTINCT frame_id) / 25.0 AS visible_seconds, CASE WHEN avg(team_confidence) >= 0.50031 THEN 'high' ELSE 'low' END AS identity_quality, avg(confidence) < 0.49031 AS unresolved FROM tr GROUP BY ALL),
{_SPEEDS.strip()},
sm AS (SELECT match_id, track_id, avg(speed_kmh) OVER (PARTITION BY match_id, track_id ORDER BY timestamp_ms RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS k, cum FROM (SELECT *, sum(CASE WHEN speed_kmh IS NOT NULL THEN step_m ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY timestamp_ms) AS cum FROM sp) WHERE speed_kmh IS NOT NULL),
me AS (SELECT match_id, track_id, max(cum) AS distance_m, max(k) AS max_speed_kmh, count(*) FILTER (k >= 5) AS sprint_count, 1.0 AS metric_quality FROM sm GROUP BY ALL),
ps AS ({_PASSES}), cl AS ({ORACLE_CLEARANCES}), tu AS ({ORACLE_TURNOVERS}), dr AS ({ORACLE_DRIBBLES}), du AS ({ORACLE_DUELS}),
pa AS (SELECT match_id, passer_track_id AS track_id, count(*) AS pass_attempts, count(*) FILTER (successful) AS passes_completed, count(*) FILTER (long_pass) AS long_pass_attempts, count(*) FILTER (long_pass AND successful) AS long_passes_completed,
  count(*) FILTER (start_zone = 'zone_1' AND end_zone = 'zone_2' AND successful) AS zone_1_to_2_passes, count(*) FILTER (start_zone = 'zone_2' AND end_zone = 'zone_3' AND successful) AS zone_2_to_3_passes FROM ps WHERE status = 'confirmed' GROUP BY ALL),
dg AS (SELECT match_id, attacker_track_id AS track_id, count(*) AS dribble_attempts, count(*) FILTER (distance_m >= 20) AS dribbles_completed FROM dr WHERE confidence >= 0.3 GROUP BY ALL),
dd AS (SELECT match_id, track_id, count(*) AS duels, count(*) FILTER (track_id = winner) AS duels_won, count(*) FILTER (air) AS aerial_duels, count(*) FILTER (air AND track_id = winner) AS aerial_duels_won FROM (
  SELECT match_id, unnest([player_a, player_b]) AS track_id, least(player_a, player_b) AS winner, (player_a + player_b) % 3 = 0 AS air FROM du WHERE status = 'candidate') GROUP BY ALL),
de AS (SELECT match_id, track_id, 0 AS tackles_won, count(*) FILTER (action_type = 'interception') AS interceptions, count(*) FILTER (action_type = 'clearance') AS clearances, 0 AS turnovers, count(*) FILTER (action_type = 'dispossession') AS dispossessions
  FROM (SELECT match_id, track_id, action_type FROM cl WHERE status = 'confirmed' UNION ALL SELECT match_id, track_id, action_type FROM tu WHERE status = 'confirmed') GROUP BY ALL),
tt AS (SELECT match_id, track_id, count(*) AS touches, count(*) FILTER (controlled_touch AND abs(pitch_y - 34) <= 20.16 AND (CASE WHEN team_id = 'team_0' THEN 105 - pitch_x ELSE pitch_x END) BETWEEN 0 AND 16.5) AS penalty_area_touches FROM touches GROUP BY ALL),
j AS (SELECT ids.*, distance_m, max_speed_kmh, sprint_count, metric_quality, {", ".join(f"coalesce({c}, 0) AS {c}" for c in (*actions.SUMS, "dispossessions", "touches"))}, greatest(visible_seconds / 60.0, 1e-6) AS mi
  FROM ids LEFT JOIN pa USING (match_id, track_id) LEFT JOIN dg USING (match_id, track_id) LEFT JOIN dd USING (match_id, track_id) LEFT JOIN de USING (match_id, track_id) LEFT JOIN tt USING (match_id, track_id) LEFT JOIN me USING (match_id, track_id)),
pl AS (SELECT match_id, track_id, team_id, role, visible_seconds, identity_quality, round(distance_m, 1) AS distance_m, round(max_speed_kmh, 1) AS max_speed_kmh, sprint_count, CAST(metric_quality AS DOUBLE) AS metric_quality, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in (*actions.SUMS, "dispossessions"))},
  {", ".join(f"CASE WHEN {y} > 0 THEN round(100.0 * {x} / {y}, 1) END AS {name}" for x, y, name in actions.SHARES)}, activity_index, CAST(NULL AS INTEGER) AS jersey_number,
  concat_ws(',', CASE WHEN unresolved THEN 'unresolved_identity' END, CASE WHEN metric_quality < 0.3 THEN 'low_metric_coverage' END, CASE WHEN activity_index IS NULL THEN 'activity_insufficient_visibility' END) AS quality_flags
  FROM (SELECT *, CASE WHEN visible_seconds >= 8 THEN round(100.0 * (0.20 * least(1, coalesce(distance_m, 0) / mi / 120.0) + 0.20 * least(1, touches / mi / 8.0) + 0.20 * least(1, pass_attempts / mi / 6.0) + 0.15 * least(1, duels / mi / 3.0)
    + 0.15 * least(1, (tackles_won + interceptions + clearances) / mi / 2.0) + 0.10 * least(1, penalty_area_touches / greatest(mi, 1))), 1) END AS activity_index FROM j))
"""


def _players(t: Tables) -> DataFrame:
    p = actions.infer_passes(t.touches, MATCH)
    e = actions.turnovers(p, MATCH).unionByName(actions.infer_clearances(t.touches, MATCH), allowMissingColumns=True)
    ids = t.tracks.groupBy(*TRACK, "team_id").agg(F.when(F.col("track_id") % 11 == 0, "goalkeeper").otherwise("player").alias("role"), (F.countDistinct("frame_id") / F.lit(25.0)).alias("visible_seconds"), F.when(F.avg("team_confidence") >= 0.50031, "high").otherwise("low").alias("identity_quality"), (F.avg("confidence") < 0.49031).alias("unresolved"))
    # bridged dribbles and duels are never confirmed, so some are taken as such, and bridged players are slow
    dr = actions.infer_dribbles(t.touches, MATCH).withColumns({"status": F.when(F.col("confidence") >= 0.3, "confirmed").otherwise("candidate"), "successful": F.col("distance_m") >= 20})
    du = actions.infer_duels(t.touches, t.tracks, MATCH).withColumns({"status": F.when(F.col("status") == "candidate", "confirmed").otherwise("unresolved"), "winner_track_id": F.least("player_a", "player_b"), "duel_type": F.when((F.col("player_a") + F.col("player_b")) % 3 == 0, "aerial_duel").otherwise("ground_duel")})
    rows = physical.row_speeds(t.tracks, TRACK).where("speed_kmh is not null")
    rows = windows.centred_average(rows, TRACK, "timestamp_ms", "speed_kmh", 500.0, "smoothed_speed_kmh").select(*TRACK, "cumulative_distance_m", "smoothed_speed_kmh", F.when(F.col("smoothed_speed_kmh") >= 5, "sprint").alias("sprint_state"), F.lit(True).alias("valid"))
    return actions.player_summary(ids, t.touches, p, dr, du, e, actions.metric_totals(rows, MATCH), MATCH)


@query(f"WITH {_CONFIRMED} SELECT * FROM pl", "visible_seconds")
def player_summary(t: Tables) -> DataFrame:
    return _players(t)


@query(f"""
WITH {_CONFIRMED} SELECT *, {", ".join(f"CASE WHEN {y} > 0 THEN round(100.0 * {x} / {y}, 1) END AS {name}" for x, y, name in actions.SHARES)} FROM (SELECT match_id, team_id, count(*) FILTER (identity_quality <> 'low') AS validated_player_count, round(coalesce(avg(metric_quality), 0), 2) AS metric_coverage, round(sum(distance_m), 1) AS total_distance_m,
  CAST(coalesce(sum(sprint_count), 0) AS BIGINT) AS sprint_count, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in actions.SUMS)} FROM pl GROUP BY ALL)
""")  # fmt: skip
def team_summary(t: Tables) -> DataFrame:
    return actions.team_summary(_players(t), MATCH)


@query("""
WITH i AS (SELECT match_id, frame_id AS signal_id, CASE track_id % 4 WHEN 0 THEN 'ball_crossed_line' WHEN 1 THEN 'scoreboard_change' WHEN 2 THEN 'kickoff_restart' ELSE 'celebration_break' END AS source, confidence * 2 - 0.8 AS score, replay AS from_replay FROM tr),
b AS (SELECT match_id, signal_id, source, max(score) FILTER (score >= 0) AS best, max(-score) FILTER (score < 0) AS against FROM i WHERE NOT from_replay GROUP BY ALL),
r AS (SELECT *, least(best, CASE WHEN row_number() OVER (PARTITION BY match_id, signal_id ORDER BY best DESC NULLS LAST, source) = 1 THEN 0.5 ELSE 0.3 END) AS part FROM b),
s AS (SELECT match_id, signal_id, greatest(0.0, least(1.0, coalesce(sum(part) FILTER (best IS NOT NULL), 0) - coalesce(max(against), 0))) AS score, count(*) FILTER (best > 0) >= 2 AS corroborated, array_to_string(list_sort(list(source)), ',') AS sources FROM r GROUP BY ALL)
SELECT *, CASE WHEN score >= 0.85 AND corroborated THEN 'auto_confirmed' WHEN score >= 0.45 THEN 'candidate_review_required' WHEN score >= 0.15 THEN 'unresolved' END AS status FROM s
""", "score")  # fmt: skip
def evidence_score(t: Tables) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(s) for s in ("ball_crossed_line", "scoreboard_change", "kickoff_restart", "celebration_break")]), (F.col("track_id") % 4 + 1).cast("int"))
    items = t.tracks.select("match_id", F.col("frame_id").alias("signal_id"), source.alias("source"), (F.col("confidence") * 2 - 0.8).alias("score"), F.col("replay").alias("from_replay"))
    return events.evidence_scores(items, ["match_id", "signal_id"]).withColumn("sources", F.array_join("sources", ","))


@query("""
WITH b AS (SELECT *, pitch_x - 50 AS gx, lag(pitch_x - 50) OVER (PARTITION BY match_id ORDER BY frame_id) AS px FROM ball)
SELECT match_id, frame_id, timestamp_ms, CASE WHEN px > 0 AND gx <= 0 THEN 'left' ELSE 'right' END AS goal_side, pitch_y FROM b WHERE visible AND ((px > 0 AND gx <= 0) OR (px < 10 AND gx >= 10)) AND pitch_y BETWEEN 0 AND 60
""", "pitch_y")  # fmt: skip
def goal_line_crossings(t: Tables) -> DataFrame:
    return events.goal_line_crossings(t.ball.withColumn("pitch_x", F.col("pitch_x") - 50), MATCH, 10.0, 0.0, 60.0)


_GOALS = "gl AS (SELECT match_id, frame_id AS goal_id, timestamp_ms + 20.0 AS timestamp_ms FROM tr WHERE track_id = 0 AND frame_id % 25 = 24)"
_SCORERS = f"""{_GOALS}, sj AS (SELECT g.match_id, g.goal_id, g.timestamp_ms AS goal_ms, c.track_id, c.team_id, c.confidence, row_number() OVER (PARTITION BY g.match_id, g.goal_id ORDER BY c.controlled_touch DESC, c.timestamp_ms DESC, c.track_id DESC) AS rn FROM gl g LEFT JOIN touches c ON c.match_id = g.match_id AND c.timestamp_ms BETWEEN g.timestamp_ms - 4000 AND g.timestamp_ms),
sc AS (SELECT match_id, goal_id, goal_ms AS timestamp_ms, CASE WHEN confidence >= 0.7 THEN track_id END AS scorer_track_id, team_id AS scorer_team_id, coalesce(confidence, 0) AS scorer_confidence, CASE WHEN confidence >= 0.7 THEN 'resolved' ELSE 'unresolved' END AS scorer_status FROM sj WHERE rn = 1)"""


def _goals(t: Tables) -> DataFrame:
    return t.frames.where("frame_id % 25 = 24").select("match_id", F.col("frame_id").alias("goal_id"), (F.col("timestamp_ms") + 20.0).alias("timestamp_ms"))


@query(f"WITH {_SCORERS} SELECT * FROM sc", "scorer_confidence")
def scorer_asof(t: Tables) -> DataFrame:
    return events.scorers(_goals(t), t.touches, MATCH)


@query(f"""
WITH {_SCORERS}, ps AS ({_PASSES}), aj AS (SELECT s.match_id, s.goal_id, s.timestamp_ms AS goal_ms, p.end_time_ms, p.passer_track_id, p.team_id, p.confidence, row_number() OVER (PARTITION BY s.match_id, s.goal_id ORDER BY p.end_time_ms DESC, p.passer_track_id) AS rn FROM sc s JOIN ps p ON p.match_id = s.match_id AND p.receiver_track_id = s.scorer_track_id AND p.passer_track_id <> s.scorer_track_id AND p.confidence >= 0.5 AND p.end_time_ms BETWEEN s.timestamp_ms - 15000 AND s.timestamp_ms),
z AS (SELECT *, greatest(0, 1 - (goal_ms - end_time_ms) / 15000) AS rec FROM aj WHERE rn = 1), y AS (SELECT *, least(greatest(rec, confidence), 0.5) + least(least(rec, confidence), 0.3) AS score FROM z)
SELECT match_id, goal_id, end_time_ms AS timestamp_ms, passer_track_id AS assist_track_id, team_id, score, CASE WHEN score >= 0.85 AND rec > 0 THEN 'auto_confirmed' WHEN score >= 0.45 THEN 'candidate_review_required' WHEN score >= 0.15 THEN 'unresolved' END AS status FROM y
""", "score")  # fmt: skip
def assist_asof(t: Tables) -> DataFrame:
    goals = events.scorers(_goals(t), t.touches, MATCH).withColumn("own_goal", F.lit(False)).withColumn("penalty", F.lit(False))
    return events.assists(goals, actions.infer_passes(t.touches, MATCH), MATCH)


@query()
def substitution_pairs(t: Tables) -> DataFrame:
    o = t.tracks.where("event_type in ('signup', 'purchase')").select("match_id", F.when(F.col("event_type") == "signup", "exit").otherwise("entry").alias("kind"), "timestamp_ms", "track_id", "team_id", "confidence", F.expr("event_id % 2 = 0").alias("came_from_bench"), F.col("replay").alias("from_replay"))
    return events.substitutions(o, MATCH)


_EVENTS = "ev AS (SELECT match_id, 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, CASE WHEN track_id % 2 = 0 THEN 'goal' ELSE 'shot' END AS event_type, timestamp_ms, team_id, replay AS in_replay, CASE WHEN confidence >= 0.7 THEN 'auto_confirmed' WHEN confidence >= 0.4 THEN 'candidate_review_required' ELSE 'unresolved' END AS status, CASE WHEN confidence >= 0.8 THEN track_id END AS scorer_track_id, track_id = 6 AS own_goal FROM tr)"


def _events(t: Tables) -> DataFrame:
    return _as_events(t.tracks)


def _as_events(e: DataFrame) -> DataFrame:
    status = F.when(F.col("confidence") >= 0.7, "auto_confirmed").when(F.col("confidence") >= 0.4, "candidate_review_required").otherwise("unresolved")
    return e.select("match_id", F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event_id"), F.when(F.col("track_id") % 2 == 0, "goal").otherwise("shot").alias("event_type"), "timestamp_ms", "team_id", F.col("replay").alias("in_replay"), status.alias("status"), F.when(F.col("confidence") >= 0.8, F.col("track_id")).alias("scorer_track_id"), (F.col("track_id") == 6).alias("own_goal"))


@query()
def replay_dup_suppression(t: Tables) -> DataFrame:
    return events.suppress_replays(_as_events(t.tracks), MATCH)


@query(f"""
WITH {_EVENTS} SELECT match_id, event_type, CASE WHEN own_goal THEN CASE team_id WHEN 'team_0' THEN 'team_1' ELSE 'team_0' END ELSE team_id END AS credited_team, count(*) FILTER (status = 'auto_confirmed') AS confirmed, count(*) FILTER (status <> 'auto_confirmed') AS pending, count(*) FILTER (status = 'auto_confirmed' AND scorer_track_id IS NULL) AS unattributed FROM ev GROUP BY ALL
""")
def event_summary(t: Tables) -> DataFrame:
    return events.event_summary(_events(t), MATCH)


@query(f"""
WITH {_EVENTS}, c AS (SELECT match_id, event_id, row_number() OVER (PARTITION BY match_id ORDER BY event_id) AS n FROM ev)
SELECT e.match_id, e.event_id, CASE WHEN n % 3 = 0 THEN 'rejected' WHEN n % 3 = 1 THEN 'manually_confirmed' ELSE status END AS status, CASE WHEN n % 3 = 2 THEN 7 ELSE scorer_track_id END AS scorer_track_id FROM ev e JOIN c USING (match_id, event_id)
""")
def review_replay(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    e = _events(t)
    n = F.row_number().over(Window.partitionBy(*MATCH).orderBy("event_id"))
    c = e.select("match_id", "event_id", n.alias("n")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    kind = F.when(F.col("k") == 0, "confirm").when(F.col("n") % 3 == 0, "reject").when(F.col("n") % 3 == 1, "confirm")
    c = c.withColumn("kind", F.when(F.col("n") % 3 == 2, F.when(F.col("k") == 0, "set_scorer")).otherwise(kind)).where("kind is not null")
    c = c.select("match_id", "event_id", "kind", F.when(F.col("kind") == "set_scorer", "7").alias("value"), (F.col("n") * 10 + F.col("k")).alias("sequence"))
    return events.apply_reviews(e, c, MATCH).select("match_id", "event_id", "status", "scorer_track_id")


@query(f"""
WITH {_EVENTS}, w AS (SELECT match_id, event_id, event_type, greatest(0, timestamp_ms - 100) AS start_ms, timestamp_ms + 300 AS end_ms FROM ev),
m AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY match_id, event_type ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 250 THEN 0 ELSE 1 END AS new FROM w), c AS (SELECT *, sum(new) OVER (PARTITION BY match_id, event_type ORDER BY start_ms, event_id) AS clip FROM m)
SELECT match_id, event_type, string_agg(event_id, '+' ORDER BY start_ms, event_id) AS event_ids, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM c GROUP BY match_id, event_type, clip
""", "start_ms end_ms")  # fmt: skip
def clip_windows_merge(t: Tables) -> DataFrame:
    e = _events(t).withColumn("interval_start_ms", F.lit(None).cast("double")).withColumn("interval_end_ms", F.lit(None).cast("double"))
    return events.merge_clips(events.clip_windows(e, 100.0, 300.0).select("match_id", "event_id", "event_type", "start_ms", "end_ms"), MATCH, 250.0)


@query()
def clip_minus_replay(t: Tables) -> DataFrame:
    e = _events(t).withColumn("interval_start_ms", F.lit(None).cast("double")).withColumn("interval_end_ms", F.lit(None).cast("double"))
    w = events.clip_windows(e, 800.0, 500.0).select("match_id", "event_id", "event_type", "start_ms", "end_ms")
    r = windows.runs_of(t.frames.withColumn("replay", F.col("shot_type") == "replay"), MATCH, "timestamp_ms", F.col("replay")).select("match_id", F.col("start").alias("start_ms"), (F.col("end") + 40.0).alias("end_ms"))
    return events.clips_less_replays(w, r, MATCH)


@query("""
WITH s AS (SELECT match_id, track_id, team, sum(team_confidence) AS w FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'team_1' ELSE 'team_0' END AS team FROM tr) WHERE team_confidence >= 0.35 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY w DESC, team) AS rn FROM s)
SELECT match_id, track_id, count(*) AS rows, any_value(b.team) AS locked_team FROM tr JOIN b USING (match_id, track_id) WHERE rn = 1 GROUP BY ALL
""")
def team_lock(t: Tables) -> DataFrame:
    i = t.tracks.withColumn("team_id", F.when(F.col("event_id") % 3 == 0, "team_1").otherwise("team_0"))
    return team.team_lock(i, TRACK).groupBy(*TRACK).agg(F.count("*").alias("rows"), F.first("locked_team").alias("locked_team"))


@query("""
WITH v AS (SELECT match_id, track_id, CASE WHEN event_id % 5 = 0 THEN 'referee' ELSE 'player' END AS role, pow(0.98, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_id DESC) - 1) * confidence AS vote FROM tr WHERE NOT replay), s AS (SELECT match_id, track_id, role, sum(vote) AS vote, count(*) AS n FROM v GROUP BY ALL),
a AS (SELECT match_id, track_id, arg_max(role, vote) AS best, max(vote) / sum(vote) AS share, CAST(sum(n) AS BIGINT) AS observations FROM s GROUP BY ALL)
SELECT match_id, track_id, CASE WHEN observations >= 5 AND share >= 0.55 THEN best ELSE 'unknown' END AS role, share, observations FROM a
""", "share")  # fmt: skip
def role_voting(t: Tables) -> DataFrame:
    o = t.tracks.withColumn("role", F.when(F.col("event_id") % 5 == 0, "referee").otherwise("player")).withColumn("score", F.col("confidence"))
    return identity.vote_roles(o, TRACK)


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id
""", "similarity")  # fmt: skip
def cosine_pairs(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    asked = e.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    pairs = asked.join(e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("eb")), "label")
    return pairs.where("b <> a").select("a", "b", V.cosine(F.col("ea"), F.col("eb")).alias("similarity"))


@query(floats="consistency")
def prototype_robust_mean(t: Tables) -> DataFrame:
    return identity.prototypes(t.raw("embeddings"), ["label"]).withColumn("dim", F.size("prototype")).drop("prototype")


def _reid_tracks(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(F.col("label").alias("team"), F.col("vec_id").alias("track_id"), (F.col("vec_id") % 97 * 1000.0).alias("start_ms"), (F.col("vec_id") % 97 * 1000.0 + 5000.0).alias("end_ms"), "embedding")


@query("""
WITH k AS (SELECT label AS team, vec_id, vec_id % 97 * 1000.0 AS s, vec_id % 97 * 1000.0 + 5000 AS e, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm FROM embeddings),
p AS (SELECT a.team, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (a.nrm * b.nrm) AS sim FROM k a JOIN k b ON a.team = b.team AND a.vec_id < b.vec_id AND a.s <= b.e + 40 AND b.s <= a.e + 40)
SELECT team, count(*) AS pairs, quantile_cont(sim, 0.5) AS p50, quantile_cont(sim, 0.75) AS p75, quantile_cont(sim, 0.9) AS p90 FROM p GROUP BY team
""", "p50 p75 p90")  # fmt: skip
def hard_negative_thresholds(t: Tables) -> DataFrame:
    return identity.hard_negative_thresholds(_reid_tracks(t), ["team"])


@query()
def identity_resolve(t: Tables) -> DataFrame:
    f = _reid_tracks(t).select("team", "track_id", ((F.col("track_id") % 40 + 12) / 25.0).alias("visible_seconds"), F.when(F.col("track_id") % 50 == 7, "goalkeeper").otherwise("outfield").alias("role"), "start_ms", "end_ms", F.struct((F.col("track_id") % 100).cast("double").alias("x_field"), F.lit(30.0).alias("y_field")).alias("first_xy"), F.struct((F.col("track_id") % 100 + 1).cast("double").alias("x_field"), F.lit(31.0).alias("y_field")).alias("last_xy"), F.lit("team_0").alias("team_id"), "embedding")
    return identity.resolve(f, ["team"])


@query()
def constrained_clusters(t: Tables) -> DataFrame:
    return identity.clusters_apart(_reid_tracks(t), ["team"], tolerance_ms=4000.0, min_score=0.1)


@query()
def global_registry(t: Tables) -> DataFrame:
    return identity.registry(t.observations, MATCH)


@query("""WITH e AS (SELECT match_id, t AS moment, 1 AS d FROM obs UNION ALL SELECT match_id, t + 2, -1 FROM obs), s AS (SELECT match_id, sum(d) OVER (PARTITION BY match_id ORDER BY moment, d DESC ROWS UNBOUNDED PRECEDING) AS n_open FROM e) SELECT match_id, CAST(max(n_open) AS BIGINT) AS peak FROM s GROUP BY match_id""")
def peak_simultaneous(t: Tables) -> DataFrame:
    return identity.peak_simultaneous(t.observations.select("match_id", F.col("t").alias("start_ms"), (F.col("t") + 2).alias("end_ms")), MATCH)


@query("""SELECT match_id, camera_id, count(*) AS observation_count, count(DISTINCT local_track_id) AS track_count, min(t) AS first_time_seconds, max(t) AS last_time_seconds, avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS pitch_localized_fraction, avg(detection_confidence) AS mean_detection_confidence FROM obs GROUP BY ALL""", "first_time_seconds last_time_seconds pitch_localized_fraction mean_detection_confidence")
def camera_coverage(t: Tables) -> DataFrame:
    return multicamera.camera_coverage(t.observations, MATCH)


@query("""
WITH o AS (SELECT match_id, floor((t - match_id * 10) / 0.5) AS bin, camera_id FROM obs WHERE detection_confidence > 0.6), g AS (SELECT DISTINCT match_id, unnest(range(0, 20)) AS bin FROM obs), c AS (SELECT DISTINCT * FROM o WHERE camera_id IN ('camera_0', 'camera_1')),
a AS (SELECT g.match_id, g.bin, coalesce(list_sort(list(camera_id) FILTER (camera_id IS NOT NULL)), []) AS act FROM g LEFT JOIN c ON c.match_id = g.match_id AND c.bin = g.bin GROUP BY ALL)
SELECT match_id, CAST(bin * 0.5 AS DOUBLE) AS start_seconds, CAST((bin + 1) * 0.5 AS DOUBLE) AS end_seconds, array_to_string(act, ',') AS active_cameras, array_to_string(list_filter(['camera_0', 'camera_1'], lambda x: NOT list_contains(act, x)), ',') AS missing_cameras FROM a WHERE len(act) < 2
""", "start_seconds end_seconds")  # fmt: skip
def coverage_gaps(t: Tables) -> DataFrame:
    o = t.observations.where("detection_confidence > 0.6").withColumn("t", F.col("t") - F.col("match_id") * 10)
    m = t.observations.select("match_id").distinct().withColumn("duration_seconds", F.lit(10.0)).withColumn("expected", F.array(F.lit("camera_0"), F.lit("camera_1")))
    return multicamera.coverage_gaps(o, m, MATCH, 0.5, 2).withColumn("active_cameras", F.array_join("active_cameras", ",")).withColumn("missing_cameras", F.array_join("missing_cameras", ","))


@query("""
WITH o AS (SELECT *, floor(t / 0.2) AS tb, greatest(detection_confidence, 1e-9) AS w FROM obs)
SELECT match_id, global_id, CAST(tb AS BIGINT) AS time_bin, sum(w * t) / sum(w) AS time_seconds, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, max(team_id) FILTER (team_confidence >= 0.5) AS team_id, coalesce(max(team_confidence) FILTER (team_confidence >= 0.5), 0) AS team_confidence, max(jersey_number) FILTER (jersey_confidence >= 0.5) AS jersey_number, coalesce(max(jersey_confidence) FILTER (jersey_confidence >= 0.5 AND jersey_number IS NOT NULL), 0) AS jersey_confidence,
  coalesce(min(role) FILTER (role <> 'unknown'), 'unknown') AS role, array_to_string(list_sort(list(DISTINCT camera_id)), ',') AS source_cameras, count(*) AS observation_count, avg(detection_confidence) AS confidence FROM o GROUP BY ALL
""", "time_seconds x y team_confidence jersey_confidence confidence")  # fmt: skip
def fuse_timeline(t: Tables) -> DataFrame:
    f = multicamera.fuse_timeline(t.observations, ["match_id", "global_id"])
    return f.drop("conflicts").withColumn("source_cameras", F.array_join("source_cameras", ","))


@query("""
SELECT l.match_id, l.camera_id, CASE WHEN l.detection_confidence >= r.detection_confidence THEN l.obs_id ELSE r.obs_id END AS kept_id, CASE WHEN l.detection_confidence >= r.detection_confidence THEN r.obs_id ELSE l.obs_id END AS suppressed_id, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS distance_m
FROM obs l JOIN obs r ON l.match_id = r.match_id AND l.camera_id = r.camera_id AND l.local_track_id <> r.local_track_id AND (r.t > l.t OR (r.t = l.t AND r.obs_id > l.obs_id)) AND r.t - l.t <= 0.08 WHERE sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) <= 1
""", "distance_m")  # fmt: skip
def intra_camera_duplicates(t: Tables) -> DataFrame:
    return multicamera.intra_camera_duplicates(t.observations, MATCH)


@query("""
WITH k AS (SELECT * FROM obs WHERE jersey_confidence >= 0.5 AND jersey_number IS NOT NULL)
SELECT l.match_id, l.jersey_number, l.obs_id AS left_id, r.obs_id AS right_id, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS distance_m, r.t - l.t AS time_delta_seconds
FROM k l JOIN k r ON l.match_id = r.match_id AND l.jersey_number = r.jersey_number AND l.team_id = r.team_id AND (l.camera_id <> r.camera_id OR l.local_track_id <> r.local_track_id) AND (r.t > l.t OR (r.t = l.t AND r.obs_id > l.obs_id)) AND r.t - l.t <= 0.08 WHERE sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) >= 20
""", "distance_m time_delta_seconds")  # fmt: skip
def impossible_duplicates(t: Tables) -> DataFrame:
    return multicamera.impossible_duplicates(t.observations, MATCH)


@query("""
WITH m AS (SELECT 'camera_' || CAST(event_id % 3 AS VARCHAR) AS camera_id, CAST(event_id AS DOUBLE) AS s, value / 1000.0 + event_id * 0.0001 AS o, greatest(((event_id * 31) % 100) / 100.0, 1e-9) AS w FROM events), a AS (SELECT camera_id, sum(w * s) / sum(w) AS anchor, sum(w * o) / sum(w) AS base, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT camera_id, anchor, base, n, sum(w * (s - anchor) * (o - base)) / sum(w * (s - anchor) * (s - anchor)) AS rate FROM m JOIN a USING (camera_id) GROUP BY ALL)
SELECT camera_id, base AS base_offset_seconds, rate AS drift_rate, anchor AS anchor_seconds, sqrt(sum(w * pow(o - base - rate * (s - anchor), 2)) / sum(w)) AS residual_seconds, n AS sample_count FROM m JOIN r USING (camera_id) GROUP BY camera_id, base, rate, anchor, n
""", "base_offset_seconds drift_rate anchor_seconds residual_seconds")  # fmt: skip
def drift_fit(t: Tables) -> DataFrame:
    m = t.tracks.select(F.concat(F.lit("camera_"), (F.col("event_id") % 3).cast("string")).alias("camera_id"), F.col("event_id").cast("double").alias("measured_at_seconds"), (F.col("value") / 1000.0 + F.col("event_id") * 0.0001).alias("offset_seconds"), "confidence")
    return multicamera.drift_fit(m, ["camera_id"])


@query("""
WITH a AS (SELECT match_id, frame_id AS i, sum(value) AS v FROM tr GROUP BY ALL), b AS (SELECT match_id, frame_id + 7 AS i, sum(value) AS v FROM tr GROUP BY ALL), na AS (SELECT match_id, i, v - avg(v) OVER (PARTITION BY match_id) AS v FROM a), nb AS (SELECT match_id, i, v - avg(v) OVER (PARTITION BY match_id) AS v FROM b),
ea AS (SELECT match_id, sqrt(sum(v * v)) AS e FROM na GROUP BY ALL), eb AS (SELECT match_id, sqrt(sum(v * v)) AS e FROM nb GROUP BY ALL), l AS (SELECT unnest(range(-12, 13)) AS lag)
SELECT na.match_id, CAST(lag AS INTEGER) AS lag, sum(na.v * nb.v) / nullif(max(ea.e) * max(eb.e), 0) AS score FROM na, l, nb, ea, eb WHERE nb.match_id = na.match_id AND nb.i - lag = na.i AND ea.match_id = na.match_id AND eb.match_id = na.match_id GROUP BY na.match_id, lag
""", "score")  # fmt: skip
def xcorr_offset(t: Tables) -> DataFrame:
    s = t.tracks.groupBy("match_id", F.col("frame_id").alias("i")).agg(F.sum("value").alias("v"))
    return multicamera.cross_correlation(s, s.withColumn("i", F.col("i") + 7), MATCH, 12)


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluation.confusion(t.raw("labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")), "truth", "predicted")


@query("""
WITH m AS (SELECT quality AS tr_, toxic AS pr_, count(*) AS n FROM labels GROUP BY ALL), c AS (SELECT tr_ AS c, sum(n) AS t, coalesce(sum(n) FILTER (tr_ = pr_), 0) AS tp FROM m GROUP BY ALL), p AS (SELECT pr_ AS c, sum(n) AS p FROM m GROUP BY ALL)
SELECT (SELECT sum(n) FILTER (tr_ = pr_) FROM m) / (SELECT sum(n) FROM m) AS accuracy, (SELECT sum(n) FILTER (tr_ = pr_ AND tr_ <> 0) FROM m) / (SELECT sum(n) FILTER (tr_ <> 0) FROM m) AS known_accuracy, (SELECT sum(n) FILTER (tr_ = 0 AND pr_ = 0) FROM m) / (SELECT sum(n) FILTER (pr_ = 0) FROM m) AS unknown_precision, (SELECT sum(n) FILTER (tr_ = 0 AND pr_ = 0) FROM m) / (SELECT sum(n) FILTER (tr_ = 0) FROM m) AS unknown_recall, (SELECT avg(2.0 * tp / (t + coalesce(p, 0))) FROM c LEFT JOIN p USING (c)) AS macro_f1
""", "accuracy known_accuracy unknown_precision unknown_recall macro_f1")  # fmt: skip
def classification_metrics(t: Tables) -> DataFrame:
    m = evaluation.confusion(t.raw("labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")), "truth", "predicted")
    return evaluation.class_metrics(m, "truth", "predicted", 0)


_BOXES = """tb AS (SELECT match_id, frame_id, track_id AS gt_id, x_field * 10 AS x1, y_field * 10 AS y1, x_field * 10 + 60 AS x2, y_field * 10 + 60 AS y2 FROM tr), fb AS (SELECT match_id, frame_id, track_id AS id, x_field * 10 + event_id % 40 AS x1, y_field * 10 + event_id % 30 AS y1, x_field * 10 + 60 + event_id % 40 AS x2, y_field * 10 + 60 + event_id % 30 AS y2 FROM tr),
bj AS (SELECT t.match_id, t.frame_id, gt_id, id, ow * oh / (7200.0 - ow * oh) AS iou, sqrt(((t_x1 - f_x1)) * ((t_x1 - f_x1)) + ((t_y1 - f_y1)) * ((t_y1 - f_y1))) AS centre_error FROM (SELECT t.match_id, t.frame_id, gt_id, id, t.x1 AS t_x1, f.x1 AS f_x1, t.y1 AS t_y1, f.y1 AS f_y1, greatest(least(t.x2, f.x2) - greatest(t.x1, f.x1), 0) AS ow, greatest(least(t.y2, f.y2) - greatest(t.y1, f.y1), 0) AS oh FROM tb t JOIN fb f ON t.frame_id = f.frame_id) t),
bm AS (SELECT match_id, frame_id, gt_id, id, iou, centre_error FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, gt_id ORDER BY round(iou, 9) DESC, centre_error, id) AS rn FROM bj WHERE iou >= 0.3) WHERE rn = 1)"""


def _boxes(t: Tables) -> tuple[DataFrame, DataFrame]:
    x, y = F.col("x_field") * 10, F.col("y_field") * 10
    truth = t.tracks.select(*FRAME, F.col("track_id").alias("gt_id"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 60).alias("y2"))
    dx, dy = F.col("event_id") % 40, F.col("event_id") % 30
    found = t.tracks.select(*FRAME, F.col("track_id").alias("id"), (x + dx).alias("x1"), (y + dy).alias("y1"), (x + 60 + dx).alias("x2"), (y + 60 + dy).alias("y2"))
    return truth, found


@query(f"WITH {_BOXES} SELECT * FROM bm", "iou centre_error")
def iou_matching(t: Tables) -> DataFrame:
    truth, found = _boxes(t)
    return evaluation.match_boxes(truth, found, FRAME, "gt_id", "id")


@query(f"WITH {_BOXES}, l AS (SELECT *, lag(id) OVER (PARTITION BY match_id, gt_id ORDER BY frame_id) AS before FROM bm) SELECT match_id, gt_id, count(*) FILTER (before <> id) AS switches, count(DISTINCT id) AS ids FROM l GROUP BY ALL")
def id_switches(t: Tables) -> DataFrame:
    truth, found = _boxes(t)
    return evaluation.id_switches(evaluation.match_boxes(truth, found, FRAME, "gt_id", "id"), MATCH, "gt_id", "id")


@query(f"""
WITH {_BOXES}, c AS (SELECT match_id, gt_id, id, count(*) AS n, min(frame_id) AS since FROM bm GROUP BY ALL), a AS (SELECT match_id, gt_id, id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, gt_id ORDER BY n DESC, since, id) AS rn FROM c) WHERE rn = 1), b AS (SELECT match_id, gt_id, id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, id ORDER BY n DESC, since, gt_id) AS rn FROM c) WHERE rn = 1),
g AS (SELECT match_id, sum(n) AS idtp FROM c JOIN a USING (match_id, gt_id, id) JOIN b USING (match_id, gt_id, id) GROUP BY ALL), t AS (SELECT match_id, count(*) AS truth FROM tb GROUP BY ALL), f AS (SELECT match_id, count(*) AS found FROM fb GROUP BY ALL)
SELECT match_id, truth, found, CAST(coalesce(idtp, 0) AS BIGINT) AS idtp, 2.0 * coalesce(idtp, 0) / (truth + found) AS idf1 FROM t JOIN f USING (match_id) LEFT JOIN g USING (match_id)
""", "idf1")  # fmt: skip
def idf1(t: Tables) -> DataFrame:
    truth, found = _boxes(t)
    return evaluation.idf1(evaluation.match_boxes(truth, found, FRAME, "gt_id", "id"), truth, found, MATCH, "gt_id", "id")


@query("""
WITH a AS (SELECT match_id, touch_id AS tid, timestamp_ms AS ms FROM touches), b AS (SELECT match_id, touch_id AS fid, timestamp_ms + 90 AS ms FROM touches), n AS (SELECT a.match_id, count(DISTINCT tid) AS truth_hit, count(DISTINCT fid) AS found_hit FROM a JOIN b ON a.match_id = b.match_id AND b.ms BETWEEN a.ms - 200 AND a.ms + 200 GROUP BY ALL),
t AS (SELECT match_id, count(*) AS truth FROM a GROUP BY ALL), f AS (SELECT match_id, count(*) AS found FROM b GROUP BY ALL)
SELECT match_id, coalesce(truth, 0) AS truth, coalesce(found, 0) AS found, coalesce(truth_hit, 0) AS truth_hit, coalesce(found_hit, 0) AS found_hit, CASE WHEN found > 0 THEN coalesce(found_hit, 0) / found END AS precision, CASE WHEN truth > 0 THEN coalesce(truth_hit, 0) / truth END AS recall FROM t FULL JOIN f USING (match_id) LEFT JOIN n USING (match_id)
""", "precision recall")  # fmt: skip
def gt_tolerance_pr(t: Tables) -> DataFrame:
    a = t.touches.select("match_id", F.col("touch_id").alias("event_id"), F.col("timestamp_ms").alias("at_ms"))
    b = t.touches.select("match_id", F.col("touch_id").alias("event_id"), (F.col("timestamp_ms") + 90).alias("at_ms"))
    return evaluation.tolerance_scores(a, b, MATCH, 200.0)


_T = evaluation.THRESHOLDS


@query(f"""
WITH f AS (SELECT match_id, avg(confidence) > 0.3 AS ball_gt_complete, CASE WHEN match_id % 4 <> 3 THEN true END AS identity_gt_complete, count(*) FILTER (replay) > 0 AS touch_review_complete, 0.69 + (match_id % 5) / 100.0 AS ball_precision, avg(confidence) + 0.2 AS ball_recall, avg(team_confidence) AS trajectory_coverage,
  CASE WHEN match_id % 6 <> 5 THEN 0.48 + (match_id % 6) / 100.0 END AS idf1, CAST(11 + match_id % 2 AS BIGINT) AS max_validated, 0.6 + (match_id % 3) / 10.0 AS touch_precision, avg(CAST(calibration_valid AS INTEGER)) AS calibration_coverage, 0.2 + (match_id % 7) / 40.0 AS measured_coverage,
  CASE WHEN match_id % 5 <> 4 THEN avg(confidence) - 0.1 + (match_id % 3) / 40.0 END AS position_coverage, 1.5 + (match_id % 9) AS continuous_seconds, 7.0 + (match_id % 11) / 8.0 AS reprojection_error, CAST(match_id % 2 AS BIGINT) AS spike_candidates FROM tr GROUP BY match_id),
r AS (SELECT *, CASE WHEN coalesce(ball_precision >= {_T["min_precision"]} AND ball_recall >= {_T["min_recall"]}, false) THEN 'ok' ELSE 'below_threshold' END AS det,
  CASE WHEN calibration_coverage IS NULL OR calibration_coverage < {_T["min_frame_coverage"]} THEN 'low_frame_coverage' WHEN measured_coverage < {_T["min_measured_coverage"]} THEN 'low_measured_coverage' WHEN continuous_seconds < {_T["min_continuous_calibrated_seconds"]} THEN 'short_continuous_calibration'
    WHEN reprojection_error > {_T["max_reprojection_error"]} THEN 'high_reprojection_error' WHEN position_coverage < {_T["min_player_position_coverage"]} THEN 'low_player_position_coverage' ELSE 'ok' END AS calibration_reason FROM f),
q AS (SELECT *, CASE WHEN NOT coalesce(ball_gt_complete, false) THEN 'GT_INCOMPLETE' ELSE det END AS ball_detection_reason, CASE WHEN NOT coalesce(ball_gt_complete, false) THEN 'GT_INCOMPLETE' WHEN det = 'ok' AND coalesce(trajectory_coverage >= {_T["min_trajectory_coverage"]}, false) THEN 'ok' ELSE 'below_threshold' END AS ball_tracking_reason,
  CASE WHEN NOT coalesce(identity_gt_complete, false) THEN 'GT_INCOMPLETE' WHEN max_validated > {_T["max_validated_per_team"]} THEN 'over_11' WHEN coalesce(idf1 >= {_T["min_idf1"]}, false) THEN 'ok' ELSE 'below_idf1' END AS identity_reason,
  CASE WHEN NOT coalesce(touch_review_complete, false) THEN 'REVIEW_INCOMPLETE' WHEN coalesce(touch_precision >= {_T["min_touch_precision"]}, false) THEN 'ok' ELSE 'below_threshold' END AS touch_reason FROM r),
z AS (SELECT * EXCLUDE (det), ball_detection_reason = 'ok' AS ball_detection_publishable, ball_tracking_reason = 'ok' AS ball_tracking_publishable, identity_reason = 'ok' AS identity_publishable, touch_reason = 'ok' AS touch_publishable, calibration_reason = 'ok' AS calibration_publishable,
  CASE WHEN calibration_reason <> 'ok' THEN 'calibration_not_publishable' WHEN spike_candidates > {_T["max_speed_spike_candidates"]} THEN 'speed_spike_audit_failed' WHEN position_coverage < {_T["min_player_position_coverage"]} THEN 'low_player_position_coverage' ELSE 'ok' END AS physical_metrics_reason FROM q)
SELECT *, physical_metrics_reason = 'ok' AS physical_metrics_publishable, calibration_publishable AS tactical_metrics_publishable, CASE WHEN calibration_publishable THEN 'ok' ELSE 'gated' END AS tactical_metrics_reason, identity_publishable AS action_stats_publishable, CASE WHEN identity_publishable THEN 'ok' ELSE 'gated' END AS action_stats_reason,
  CASE WHEN 'GT_INCOMPLETE' IN (ball_detection_reason, identity_reason) THEN 'GT_INCOMPLETE' WHEN ball_detection_publishable AND identity_publishable AND calibration_publishable THEN 'ok' ELSE 'gates_failed' END AS overall_reason,
  'GT_INCOMPLETE' NOT IN (ball_detection_reason, identity_reason) AND ball_detection_publishable AND identity_publishable AND calibration_publishable AS overall_publishable FROM z
""", "ball_precision ball_recall trajectory_coverage idf1 touch_precision calibration_coverage measured_coverage position_coverage continuous_seconds reprojection_error")  # fmt: skip
def publishability_flags(t: Tables) -> DataFrame:
    m = F.col("match_id")
    facts = t.tracks.groupBy("match_id").agg(
        (F.avg("confidence") > 0.3).alias("ball_gt_complete"), F.when(m % 4 != 3, F.lit(True)).alias("identity_gt_complete"), (F.count(F.when(F.col("replay"), 1)) > 0).alias("touch_review_complete"), (0.69 + (m % 5) / 100.0).alias("ball_precision"), (F.avg("confidence") + 0.2).alias("ball_recall"), F.avg("team_confidence").alias("trajectory_coverage"),
        F.when(m % 6 != 5, 0.48 + (m % 6) / 100.0).alias("idf1"), (11 + m % 2).alias("max_validated"), (0.6 + (m % 3) / 10.0).alias("touch_precision"), F.avg(F.col("calibration_valid").cast("int")).alias("calibration_coverage"), (0.2 + (m % 7) / 40.0).alias("measured_coverage"),
        F.when(m % 5 != 4, F.avg("confidence") - 0.1 + (m % 3) / 40.0).alias("position_coverage"), (1.5 + m % 9).alias("continuous_seconds"), (7.0 + (m % 11) / 8.0).alias("reprojection_error"), (m % 2).alias("spike_candidates"),
    )
    return evaluation.publishability(facts)


@query("""
WITH v AS (SELECT match_id, frame_id, timestamp_ms, event_type = 'click' AS ok FROM tr WHERE track_id = 0), n AS (SELECT match_id, frame_id, last_value(CASE WHEN ok THEN frame_id END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS b, first_value(CASE WHEN ok THEN frame_id END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM v),
p AS (SELECT match_id, frame_id, CASE WHEN b IS NOT NULL AND (a IS NULL OR frame_id - b <= a - frame_id) THEN b ELSE a END AS src FROM n) SELECT match_id, frame_id, CASE WHEN abs(frame_id - src) <= 2 THEN src END AS source_frame_asof, CASE WHEN abs(frame_id - src) <= 2 THEN abs(frame_id - src) END AS asof_distance FROM p
""")
def calibration_asof_hold(t: Tables) -> DataFrame:
    f = t.frames
    valid = f.where("event_type = 'click'").select(*FRAME, F.col("frame_id").alias("source_frame"))
    return windows.asof_nearest(f.select(*FRAME), valid, MATCH, "frame_id", ["source_frame"], 2)


@query("""
WITH p AS (SELECT event_id, x_field * 10 AS u, y_field * 10 AS v FROM tr), w AS (SELECT event_id, (0.1 * u + 0.01 * v + 1) / (0.0001 * u + 0.0002 * v + 1) AS x, (0.02 * u + 0.09 * v + 2) / (0.0001 * u + 0.0002 * v + 1) AS y FROM p)
SELECT event_id, CASE WHEN x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68 THEN x END AS x, CASE WHEN x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68 THEN y END AS y FROM w
""", "x y")  # fmt: skip
def homography_apply(t: Tables) -> DataFrame:
    m = G.matrix(F.lit("[[0.2,0.02,2.0],[0.04,0.18,4.0],[0.0002,0.0004,2.0]]"))
    at = G.to_pitch(m, F.col("x_field") * 10, F.col("y_field") * 10, F.lit(True))
    return t.tracks.select("event_id", at.alias("p")).select("event_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("""SELECT match_id, frame_id + 1 AS frame, track_id AS id, x_field * 10 AS x, y_field * 10 AS y, CAST(20 + track_id AS DOUBLE) AS w, CAST(50 AS DOUBLE) AS h, confidence AS conf FROM tr""", "x y w h conf")
def mot_export(t: Tables) -> DataFrame:
    from tracklake.sources.exports import mot_rows

    return mot_rows(t.boxes, MATCH)


@query(r"""
WITH s AS (SELECT conv_id, turn, turn * 3.0 AS a, turn * 3.0 + 2.5 AS b, text FROM conversations WHERE text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY a, turn) AS k FROM s)
SELECT conv_id, CAST(k AS INTEGER) AS number, printf('%02d:%02d:%02d,%03d', CAST(floor(a / 3600) AS INTEGER), CAST(floor(a / 60) AS INTEGER) % 60, CAST(floor(a) AS INTEGER) % 60, CAST(round((a - floor(a)) * 1000) AS INTEGER)) || ' --> ' || printf('%02d:%02d:%02d,%03d', CAST(floor(b / 3600) AS INTEGER), CAST(floor(b / 60) AS INTEGER) % 60, CAST(floor(b) AS INTEGER) % 60, CAST(round((b - floor(b)) * 1000) AS INTEGER)) AS times, text FROM n
""")
def srt_segments(t: Tables) -> DataFrame:
    from tracklake.sources.segments import srt_blocks

    s = t.raw("conversations").where("text is not null").select("conv_id", "turn", (F.col("turn") * 3.0).alias("start_s"), (F.col("turn") * 3.0 + 2.5).alias("end_s"), "text")
    return srt_blocks(s, ["conv_id"], "turn")


@query("""
WITH c AS (SELECT user_id AS camera_id, count(*) AS frames FROM events GROUP BY ALL), k AS (SELECT camera_id, frames, unnest(range(0, CAST(ceil(frames / 30.0) AS BIGINT))) AS chunk_index FROM c)
SELECT camera_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_index * 30 AS frame_start, least((chunk_index + 1) * 30, frames) AS frame_end, chunk_index * 30 / 1.0 AS start_seconds, least((chunk_index + 1) * 30, frames) / 1.0 AS end_seconds FROM k
""", "start_seconds end_seconds")  # fmt: skip
def chunk_plan(t: Tables) -> DataFrame:
    from tracklake.plans.chunks import plan_chunks

    cameras = t.raw("events").groupBy(F.col("user_id").alias("camera_id")).agg(F.count("*").alias("frames"))
    return plan_chunks(cameras, 1.0, 30.0)


@query("""
WITH r AS (SELECT user_id % 10 AS camera_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PENDING' ELSE 'PASSED' END AS status, CASE WHEN event_type NOT IN ('error', 'click') THEN value END AS wall_seconds FROM events)
SELECT camera_id, count(*) AS chunks, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status NOT IN ('PASSED', 'FAILED')) AS remaining, count(*) FILTER (status = 'PASSED') / count(*) AS fraction, avg(wall_seconds) * count(*) FILTER (status NOT IN ('PASSED', 'FAILED')) AS eta_seconds FROM r GROUP BY ALL
""", "fraction eta_seconds")  # fmt: skip
def chunk_progress(t: Tables) -> DataFrame:
    from tracklake.plans.chunks import progress

    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "PENDING").otherwise("PASSED")
    r = t.raw("events").select((F.col("user_id") % 10).alias("camera_id"), status.alias("status"), F.when(status == "PASSED", F.col("value")).alias("wall_seconds"))
    return progress(r, ["camera_id"])


@query("""SELECT event_id, CASE WHEN value < 100 THEN 'green' END AS g, CASE WHEN x_field IS NULL THEN NULL WHEN (CASE WHEN team_id = 'team_1' THEN 105 - x_field ELSE x_field END) < 35 THEN 'zone_1' WHEN (CASE WHEN team_id = 'team_1' THEN 105 - x_field ELSE x_field END) < 70 THEN 'zone_2' ELSE 'zone_3' END AS zone, CASE WHEN y_field < 68 / 3.0 THEN 'right_channel' WHEN y_field < 136 / 3.0 THEN 'central_channel' ELSE 'left_channel' END AS channel, abs(y_field - 34) <= 20.16 AND CASE WHEN team_id = 'team_0' THEN x_field BETWEEN 0 AND 16.5 ELSE x_field BETWEEN 88.5 AND 105 END AS own_penalty_area FROM tr""")
def pitch_zones(t: Tables) -> DataFrame:
    z = L.zone_labels(F.col("x_field"), F.col("y_field"), F.col("team_id"))
    return t.tracks.select("event_id", F.when(F.col("value") < 100, "green").alias("g"), z["zone"].alias("zone"), z["channel"].alias("channel"), z["own_penalty_area"].alias("own_penalty_area"))


@query("""SELECT match_id, count(*) AS frames, avg(CASE WHEN calibration_valid THEN 1.0 ELSE 0.0 END) AS calibrated_fraction, avg(CASE WHEN replay THEN 1.0 ELSE 0.0 END) AS replay_fraction, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS ball_visible_fraction FROM tr WHERE track_id = 0 GROUP BY ALL""", "calibrated_fraction replay_fraction ball_visible_fraction")
def match_quality_report(t: Tables) -> DataFrame:
    f = t.tracks.where("track_id = 0").select("match_id", F.col("calibration_valid").alias("calibrated"), "replay", (F.col("event_type") != "error").alias("ball_visible"))
    return summaries.match_quality_report(f, physical.track_quality(t.tracks.withColumn("bbox_valid", F.lit(True)), TRACK), MATCH).drop("mean_track_quality", "low_quality_tracks")


@query("""
WITH b AS (SELECT match_id, track_id, frame_id, (x_field * 10 + x_field * 10 + 20 + track_id) / 2 AS cx, y_field * 10 + 25 AS cy FROM tr), m AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER w = 1 THEN sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) / 50 END AS move FROM b WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_id))
SELECT match_id, track_id, quantile_cont(move, 0.5) AS median_jitter FROM m GROUP BY ALL
""", "median_jitter")  # fmt: skip
def box_jitter(t: Tables) -> DataFrame:
    return summaries.box_jitter(t.boxes, TRACK)


@query("""
WITH q AS (SELECT match_id, track_id, frame_id, floor(timestamp_ms / 1000) AS second, row_number() OVER (PARTITION BY match_id, track_id, floor(timestamp_ms / 1000) ORDER BY timestamp_ms) AS rn FROM tr) SELECT match_id, track_id, CAST(second AS BIGINT) AS second, frame_id FROM q WHERE rn = 1
""")
def first_each_second(t: Tables) -> DataFrame:
    return summaries.first_each_second(t.tracks, TRACK).select(*TRACK, "second", "frame_id")


@query("""
WITH r AS (SELECT match_id, frame_id, event_type AS digest FROM tr WHERE track_id = 1), w AS (SELECT *, count(digest) OVER w AS n, min(digest) OVER w AS a, max(digest) OVER w AS b FROM r WINDOW w AS (PARTITION BY match_id ORDER BY frame_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT match_id, frame_id, digest, n = 3 AND a = b AS stable FROM w
""")
def scoreboard_stable_reads(t: Tables) -> DataFrame:
    return summaries.stable_reads(t.tracks.where("track_id = 1").select(*FRAME, F.col("event_type").alias("digest")), MATCH)


@query("""
WITH m AS (SELECT label AS k, median(CAST(embedding[1] AS DOUBLE)) AS ma, median(CAST(embedding[2] AS DOUBLE)) AS mb FROM embeddings GROUP BY ALL), d AS (SELECT label AS k, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, ma, mb FROM embeddings JOIN m ON k = label), v AS (SELECT k, median(abs(a - ma)) AS da, median(abs(b - mb)) AS db FROM d GROUP BY ALL),
i AS (SELECT d.k, a, b, (da <= 1e-12 OR 0.6745 * abs(a - ma) / da <= 3.5) AND (db <= 1e-12 OR 0.6745 * abs(b - mb) / db <= 3.5) AS ok FROM d JOIN v ON v.k = d.k), e AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY k) >= 3 AS enough FROM i)
SELECT k AS label, count(*) AS rows, median(a) AS a, median(b) AS b FROM e WHERE ok OR NOT enough GROUP BY k
""", "a b")  # fmt: skip
def mad_pooling(t: Tables) -> DataFrame:
    e = t.raw("embeddings").select("label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return summaries.mad_pool(e, ["label"], ["a", "b"])


@query("""
WITH n AS (SELECT match_id, frame_id, count(*) OVER (PARTITION BY match_id) AS n, row_number() OVER (PARTITION BY match_id ORDER BY frame_id) - 1 AS i FROM tr WHERE track_id = 0), w AS (SELECT unnest(range(0, 7)) AS k) SELECT DISTINCT match_id, frame_id FROM n, w WHERE n <= 7 OR i = round_even(k * (n - 1) / 6.0, 0)
""")
def even_sample(t: Tables) -> DataFrame:
    return summaries.even_sample(t.frames.select(*FRAME), MATCH, "frame_id", 7)


@query("""
WITH k AS (SELECT match_id, event_type, event_id, row_number() OVER (PARTITION BY match_id, event_type ORDER BY sha256('7:' || CAST(event_id AS VARCHAR)), event_id) AS rn FROM tr) SELECT match_id, event_type, event_id FROM k WHERE rn <= 5
""")
def stratified_sample(t: Tables) -> DataFrame:
    return summaries.stratified_sample(t.tracks.select("match_id", "event_type", "event_id"), MATCH, "event_type", "event_id", 5, 7)


@query("""
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n FROM labels) SELECT doc_id, rn <= round_even(n * 0.2, 0) AS validation FROM n
""")
def hash_split(t: Tables) -> DataFrame:
    return evaluation.hash_split(t.raw("labels").select("doc_id"), "doc_id", 0.2, 3)


@query("""
WITH b AS (SELECT match_id, frame_id, track_id AS box_id, CASE WHEN track_id % 5 = 0 THEN 'referee' ELSE 'player' END AS class_name, x_field * 10 AS x1, y_field * 10 AS y1 FROM tr),
j AS (SELECT a.match_id, a.frame_id, a.box_id AS a_box_id, b.box_id AS b_box_id, greatest(least(a.x1, b.x1) + 80 - greatest(a.x1, b.x1), 0) * greatest(least(a.y1, b.y1) + 80 - greatest(a.y1, b.y1), 0) AS i FROM b a JOIN b b ON a.frame_id = b.frame_id AND a.box_id < b.box_id AND a.class_name <> b.class_name)
SELECT match_id, frame_id, a_box_id, b_box_id, i / (12800.0 - i) AS iou FROM j WHERE i / (12800.0 - i) >= 0.3
""", "iou")  # fmt: skip
def player_referee_conflicts(t: Tables) -> DataFrame:
    x, y = F.col("x_field") * 10, F.col("y_field") * 10
    b = t.tracks.select(*FRAME, F.col("track_id").alias("box_id"), F.when(F.col("track_id") % 5 == 0, "referee").otherwise("player").alias("class_name"), x.alias("x1"), y.alias("y1"), (x + 80).alias("x2"), (y + 80).alias("y2"))
    return evaluation.box_conflicts(b, FRAME, 0.3, False)


@query()
def suppressed_boxes(t: Tables) -> DataFrame:
    x, y = F.col("x_field") * 10, F.col("y_field") * 10
    b = t.tracks.select(*FRAME, F.col("track_id").alias("box_id"), F.when(F.col("track_id") % 5 == 0, "referee").otherwise("player").alias("class_name"), "confidence", x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 60).alias("y2"))
    return greedy.suppress_boxes(b, FRAME)


@query()
def pitch_filter(t: Tables) -> DataFrame:
    return greedy.pitch_filter(t.tracks.select(*TRACK, "frame_id", F.when(F.col("calibration_valid"), F.col("x_field")).alias("x"), F.when(F.col("calibration_valid"), F.col("y_field")).alias("y")), TRACK)


@query()
def team_assignment(t: Tables) -> DataFrame:
    return greedy.assign_teams(t.tracks.select(*TRACK, "frame_id", F.when(F.col("event_id") % 3 > 0, F.col("team_id")).alias("label")), TRACK)


@query()
def stable_display_ids(t: Tables) -> DataFrame:
    pieces = windows.islands(t.tracks, TRACK, ["frame_id"], F.col("frame_id") % 60 == 0, "piece")
    at = F.struct("x_field", "y_field")
    p = pieces.groupBy(*TRACK, "team_id", "piece").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.min_by(at, "timestamp_ms").alias("a"), F.max_by(at, "timestamp_ms").alias("b"))
    p = p.select("match_id", (F.col("track_id") * 1000 + F.col("piece")).alias("track_id"), "team_id", "start_ms", "end_ms", F.col("a.x_field").alias("first_x"), F.col("a.y_field").alias("first_y"), F.col("b.x_field").alias("last_x"), F.col("b.y_field").alias("last_y"))
    return greedy.display_ids(p, MATCH)


@query("""SELECT match_id, avg(x_field) FILTER (team_id = 'team_0') > avg(x_field) FILTER (team_id = 'team_1') AS flipped, CASE WHEN avg(x_field) FILTER (team_id = 'team_0') > avg(x_field) FILTER (team_id = 'team_1') THEN -1 ELSE 1 END AS attack_sign FROM tr GROUP BY ALL""")
def attack_direction(t: Tables) -> DataFrame:
    return team.attack_direction(t.tracks, MATCH).withColumn("flipped", F.col("attack_sign") == -1)


@query("""
WITH g AS (SELECT match_id, frame_id, team_id, avg(x_field) AS tx, avg(y_field) AS ty FROM tr WHERE track_id % 11 <> 0 GROUP BY ALL), q AS (SELECT t.match_id, t.frame_id, t.track_id, g.team_id, sqrt((t.x_field - tx) * (t.x_field - tx) + (t.y_field - ty) * (t.y_field - ty)) AS d FROM tr t JOIN g USING (match_id, frame_id) WHERE t.track_id % 11 = 0)
SELECT match_id, frame_id, track_id, arg_min(team_id, d) AS resolved_team FROM q GROUP BY ALL
""")
def nearest_team_centroid(t: Tables) -> DataFrame:
    q = t.tracks.where("track_id % 11 = 0").select(*FRAME, "track_id", "x_field", "y_field")
    return team.nearest_team(q, t.tracks.where("track_id % 11 <> 0"), FRAME).select(*FRAME, "track_id", "resolved_team")


def _canonical(t: Tables) -> dict[str, DataFrame]:
    tracks = t.tracks.withColumn("foot_x_pixel", F.col("x_field") * 10).withColumn("foot_y_pixel", F.col("y_field") * 10)
    return {"tracks": tracks, "ball": t.ball}


@query()
def match_teams(t: Tables) -> DataFrame:
    return match_analysis.analyse(_canonical(t))["teams"]


@query("""
WITH p AS (SELECT match_id, track_id, team_id, frame_id // 50 AS piece, min(timestamp_ms) AS s, max(timestamp_ms) AS e, arg_min(x_field, timestamp_ms) AS fx, arg_min(y_field, timestamp_ms) AS fy, arg_max(x_field, timestamp_ms) AS lx, arg_max(y_field, timestamp_ms) AS ly FROM tr GROUP BY ALL)
SELECT a.match_id, a.track_id * 100 + a.piece AS a, b.track_id * 100 + b.piece AS b, CASE WHEN a.team_id <> b.team_id THEN 'team' WHEN a.track_id % 7 <> b.track_id % 7 THEN 'jersey' WHEN (b.s - a.e) / 1000 > 3 THEN 'gap' WHEN sqrt((a.lx - b.fx) * (a.lx - b.fx) + (a.ly - b.fy) * (a.ly - b.fy)) > 8 + 11 * (b.s - a.e) / 1000 THEN 'speed' END AS veto
FROM p a JOIN p b ON a.match_id = b.match_id AND b.s > a.e AND b.s - a.e <= 5000
""")
def tracklet_vetoes(t: Tables) -> DataFrame:
    at = F.struct("x_field", "y_field")
    p = t.tracks.withColumn("piece", F.expr("frame_id div 50")).groupBy(*TRACK, "team_id", "piece").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.min_by(at, "timestamp_ms").alias("p"), F.max_by(at, "timestamp_ms").alias("q"))
    p = p.select("match_id", (F.col("track_id") * 100 + F.col("piece")).alias("id"), "team_id", "start_ms", "end_ms", F.col("p.x_field").alias("first_x"), F.col("p.y_field").alias("first_y"), F.col("q.x_field").alias("last_x"), F.col("q.y_field").alias("last_y"), F.lit("player").alias("role"), (F.col("track_id") % 7).alias("jersey"))
    return roles.tracklet_pairs(p, MATCH, 5000.0).select("match_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), roles.pair_veto(3.0).alias("veto"))


@query("""
WITH e AS (SELECT user_id % 5 AS camera_id, value AS l, value * 1.01 + 2 + (event_id % 3) * 0.1 AS r FROM events)
SELECT camera_id, count(*) AS events, regr_slope(r, l) AS slope, regr_intercept(r, l) AS offset_seconds, sqrt(greatest(regr_syy(r, l) - regr_slope(r, l) * regr_sxy(r, l), 0) / count(*)) AS residual_seconds, 1 / (1 + 10 * sqrt(greatest(regr_syy(r, l) - regr_slope(r, l) * regr_sxy(r, l), 0) / count(*))) AS confidence FROM e GROUP BY camera_id
""", "slope offset_seconds residual_seconds confidence")  # fmt: skip
def matched_event_offset(t: Tables) -> DataFrame:
    e = t.raw("events").select((F.col("user_id") % 5).alias("camera_id"), F.col("value").alias("local_s"), (F.col("value") * 1.01 + 2 + (F.col("event_id") % 3) * 0.1).alias("reference_s"))
    return roles.matched_offset(e, ["camera_id"])
