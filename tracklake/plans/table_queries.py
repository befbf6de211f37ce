"""Queries for canonical joins, review tables and the column functions, over the bridged tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.functions import labels as L
from tracklake.operators import canonical, evaluation, events, folds, greedy, identity, interchange, mot, multicamera, physical, reviews, roles, summaries
from tracklake.plans import chunks
from tracklake.plans.bridge import MATCH, TRACK, Tables
from tracklake.plans.queries import FRAME, _SPEEDS, query

_E = lambda k: F.expr(f"event_id % {k}")


def _pick(values: list[str | None], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _sql_pick(values: list[str | None], index: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{index} + 1]"


# boxes -------------------------------------------------------------------------------------------------------------

_BOX = "bx AS (SELECT match_id, frame_id, track_id, event_id, confidence, x_field * 10 - 20 AS x1, y_field * 10 - 30 AS y1, x_field * 10 + 5 + track_id AS x2, y_field * 10 + 40 AS y2 FROM tr)"


def _boxes(t: Tables) -> DataFrame:
    x, y = F.col("x_field") * 10, F.col("y_field") * 10
    return t.tracks.select(*FRAME, "track_id", "event_id", "confidence", (x - 20).alias("x1"), (y - 30).alias("y1"), (x + 5 + F.col("track_id")).alias("x2"), (y + 40).alias("y2"))


@query(f"""
WITH {_BOX}, c AS (SELECT *, least(greatest(x1, 0.0), 640.0) AS cx1, least(greatest(y1, 0.0), 480.0) AS cy1, least(greatest(x2, 0.0), 640.0) AS cx2, least(greatest(y2, 0.0), 480.0) AS cy2, x2 - x1 AS w, y2 - y1 AS h FROM bx),
d AS (SELECT *, CASE WHEN greatest(w, 0) * greatest(h, 0) > 0 THEN greatest(cx2 - cx1, 0) * greatest(cy2 - cy1, 0) / (w * h) ELSE 0.0 END AS vis, CASE WHEN y2 < 0 OR y2 > 480 OR w <= 0 THEN 0.0 ELSE greatest(least(x2, 640) - greatest(x1, 0), 0) / w END AS foot_conf FROM c)
SELECT match_id, frame_id, track_id, w AS width, h AS height, greatest(w, 0) * greatest(h, 0) AS area, w > 0 AND h > 0 AS valid, cx1, cy1, cx2, cy2, vis AS visible, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, foot_conf, CASE WHEN w > 0 AND h > 0 THEN least(vis, foot_conf) ELSE 0.0 END AS crop_quality,
  y1 + h * 0.92 AS ankle_y, (x1 + x2) / 2 - w * 0.15 AS ankle_left,
  CASE WHEN least(ceil(x2 - w * 0.2), 640) - greatest(floor(x1 + w * 0.2), 0) >= 2 AND least(ceil(y1 + h * 0.55), 480) - greatest(floor(y1 + h * 0.15), 0) >= 2 THEN CAST(greatest(floor(x1 + w * 0.2), 0) AS BIGINT) END AS torso_x1,
  0.45 * least(greatest(w, 0) * greatest(h, 0) / 20000.0, 1.0) + 0.25 * greatest(0.0, 1 - sqrt(((x1 + x2) / 2 - 320) * ((x1 + x2) / 2 - 320) + ((y1 + y2) / 2 - 240) * ((y1 + y2) / 2 - 240)) / 400.0) + 0.2 * confidence + 0.1 * CASE WHEN x1 <= 2 OR y1 <= 2 OR x2 >= 638 OR y2 >= 478 THEN 0.0 ELSE 1.0 END AS crop_score FROM d
""", "width height area cx1 cy1 cx2 cy2 visible foot_x foot_y foot_conf crop_quality ankle_y ankle_left crop_score")  # fmt: skip
def box_features(t: Tables) -> DataFrame:
    b = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    c = G.clip(b, 640, 480)
    foot, ankle = G.foot_point(b), G.ankle_point(b)
    return _boxes(t).select(
        *FRAME, "track_id", G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"), G.valid(b).alias("valid"), *[x.alias(n) for x, n in zip(c, ("cx1", "cy1", "cx2", "cy2"), strict=True)], G.visible_fraction(b, 640, 480).alias("visible"),
        foot[0].alias("foot_x"), foot[1].alias("foot_y"), G.foot_confidence(b, 640, 480).alias("foot_conf"), G.crop_quality(b, 640, 480).alias("crop_quality"), ankle["y"].alias("ankle_y"), ankle["left_x"].alias("ankle_left"), G.torso_crop(b, 640, 480)["x1"].alias("torso_x1"), G.crop_score(b, F.col("confidence"), 640, 480).alias("crop_score"),
    )


@query("""
WITH m AS (SELECT *, (2 + event_id % 3) / 2.0 AS a, 0.25 AS b, (event_id % 7) / 2.0 AS c, 0.125 AS d, (1 + event_id % 2) / 2.0 AS e, 1.5 AS f, x_field * 10 AS px, y_field * 10 AS py FROM tr),
p AS (SELECT *, a * px + b * py + c AS qx, d * px + e * py + f AS qy, a * e - b * d AS det FROM m)
SELECT match_id, frame_id, track_id, qx AS projected_x, qy AS projected_y, CASE WHEN calibration_valid AND qx BETWEEN 0 AND 105 AND qy BETWEEN 0 AND 68 THEN qx END AS pitch_x, (e * 52.0 - b * 34.0 + b * f - c * e) / det AS inverse_x, (a * 34.0 - d * 52.0 + d * c - a * f) / det AS inverse_y,
  0.0 AS round_trip, (sqrt(c * c + f * f) + sqrt((a * 100 + c - 100) * (a * 100 + c - 100) + (d * 100 + f) * (d * 100 + f)) + sqrt((a * 100 + b * 50 + c - 100) * (a * 100 + b * 50 + c - 100) + (d * 100 + e * 50 + f - 50) * (d * 100 + e * 50 + f - 50)) + sqrt((b * 50 + c) * (b * 50 + c) + (e * 50 + f - 50) * (e * 50 + f - 50))) / 4 AS corner_jump FROM p
""", "projected_x projected_y pitch_x inverse_x inverse_y round_trip corner_jump")  # fmt: skip
def homography_checks(t: Tables) -> DataFrame:
    h = F.concat(F.lit("[["), (2 + _E(3)).cast("string"), F.lit(",0.5,"), _E(7).cast("string"), F.lit("],[0.25,"), (1 + _E(2)).cast("string"), F.lit(",3],[0.0,0.0,2.0]]"))
    rows = t.tracks.withColumn("m", G.cells(G.matrix(h))).withColumn("back", G.cells(G.inverse(G.from_cells(F.col("m")))))
    m, inverse = G.from_cells(F.col("m")), G.from_cells(F.col("back"))
    one = [[F.lit(float(r == c)) for c in range(3)] for r in range(3)]
    x, y = F.col("x_field") * 10, F.col("y_field") * 10
    p, at = G.project(m, x, y), G.project(inverse, F.lit(52.0), F.lit(34.0))
    return rows.select(*FRAME, "track_id", p[0].alias("projected_x"), p[1].alias("projected_y"), G.to_pitch(m, x, y, F.col("calibration_valid"))["x"].alias("pitch_x"), at[0].alias("inverse_x"), at[1].alias("inverse_y"), G.round_trip_error(m, inverse, x, y).alias("round_trip"), G.corner_jump(m, one, 100.0, 50.0).alias("corner_jump"))


@query("""
SELECT match_id, frame_id, track_id, (2 * (x_field * 10) + 0.5 * (y_field * 10 + 50) + 5) / 2 AS x_bottom_left, ((y_field * 10 + 50) + 3) / 2 AS y_bottom_left, (2 * (x_field * 10 + 20 + track_id) + 0.5 * (y_field * 10 + 50) + 5) / 2 AS x_bottom_right, (2 * (x_field * 10 + (20 + track_id) / 2.0) + 0.5 * (y_field * 10 + 50) + 5) / 2 AS x_bottom_middle,
  (0.0 - 0.25 * (68 * 2 - 3.0) * 2 - 5.0) / 2 + 0.0 AS corner_x FROM tr
""", "x_bottom_left y_bottom_left x_bottom_right x_bottom_middle corner_x")  # fmt: skip
def pitch_boxes(t: Tables) -> DataFrame:
    h = F.lit("[[2,0.5,5],[0,1,3],[0,0,2]]")
    box = tuple(F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2"))
    corner = canonical.projected_corners(h)[3]
    return canonical.pitch_box(t.boxes, box, h).select(*FRAME, "track_id", "x_bottom_left", "y_bottom_left", "x_bottom_right", "x_bottom_middle", corner[0].alias("corner_x"))


# labels ------------------------------------------------------------------------------------------------------------

_WORDS = ["true", "No", "", "perhaps", " y ", "0", None]
_TEAMS = ["team_0", "team_1", "unknown", "", None]
_ROLES = ["player", "Goalkeeper", "assistant_referee", "team staff", "main Official", "fan", None]
_SHOTS = ["wide", "Replay wide", "close_up", "graphic", "tactical"]
_REASONS = ["Scene cut", "replay shown", "reproj too high", "coverage", "few points", "singular matrix", "odd", None]
_JERSEYS = ["7", " 10.0", "100", "x", "0", None]


@query(f"""
WITH s AS (SELECT *, {_sql_pick(_WORDS, "event_id % 7")} AS word, {_sql_pick(_TEAMS, "event_id % 5")} AS team, {_sql_pick(_ROLES, "event_id % 7")} AS ro, {_sql_pick(_ROLES, "event_id // 7 % 7")} AS ro2, {_sql_pick(_SHOTS, "event_id % 5")} AS shot, {_sql_pick(_REASONS, "event_id % 8")} AS why, {_sql_pick(_JERSEYS, "event_id % 6")} AS jersey FROM tr),
f AS (SELECT *, lower(trim(word)) AS lw, CASE WHEN lower(ro) LIKE '%goalkeeper%' THEN 'goalkeeper' WHEN regexp_matches(lower(ro), 'referee|official|assistant') THEN 'official' WHEN lower(ro) LIKE '%staff%' THEN 'staff' WHEN lower(ro) LIKE '%player%' THEN 'player' ELSE 'unknown' END AS fam,
  CASE WHEN lower(ro2) LIKE '%goalkeeper%' THEN 'goalkeeper' WHEN regexp_matches(lower(ro2), 'referee|official|assistant') THEN 'official' WHEN lower(ro2) LIKE '%staff%' THEN 'staff' WHEN lower(ro2) LIKE '%player%' THEN 'player' ELSE 'unknown' END AS fam2 FROM s)
SELECT event_id, CASE WHEN lw IN ('true', '1', 'yes', 'y', 't', '1.0') THEN true WHEN lw IN ('false', '0', 'no', 'n', 'f', '0.0', '') THEN false END AS flag, CASE WHEN trim(team) NOT IN ('', 'unknown', 'None') THEN team END AS known, CASE team WHEN 'team_0' THEN 0 WHEN 'team_1' THEN 1 END AS team_index, CASE team WHEN 'team_0' THEN 'left' WHEN 'team_1' THEN 'right' END AS side,
  fam AS role_family, coalesce(regexp_matches(lower(ro), 'referee|official|staff|assistant'), false) AS excluded, (fam = 'goalkeeper' AND fam2 = 'player') OR (fam = 'player' AND fam2 = 'goalkeeper') AS mismatch, regexp_matches(shot, '(?i)replay|close|graphic') AS replay_shot,
  CASE WHEN why IS NULL THEN NULL ELSE ['scene_cut', 'non_live_shot', 'reprojection_error', 'low_coverage', 'insufficient_points', 'invalid_homography', 'other'][event_id % 8 + 1] END AS category, CASE jersey WHEN '7' THEN '7' WHEN ' 10.0' THEN '10' WHEN '0' THEN '0' END AS jersey,
  CASE WHEN confidence >= 0.65 THEN 'confirmed' WHEN confidence >= 0.4 THEN 'candidate' ELSE 'unresolved' END AS tier, CASE WHEN confidence >= 0.65 THEN 'auto_confirmed' ELSE 'unresolved' END IN ('auto_confirmed', 'manually_confirmed') AS confirmed, CASE WHEN confidence >= 0.75 THEN 'green' WHEN confidence >= 0.5 THEN 'amber' ELSE 'red' END AS light,
  CASE WHEN event_id % 9 = 0 THEN 100 ELSE CAST(event_id % 100 AS INTEGER) END AS class, printf('%02d:%02d', CAST(floor(timestamp_ms / 60000) AS BIGINT), CAST(floor(timestamp_ms / 1000) AS BIGINT) % 60) AS clock, CAST(least(greatest(floor(timestamp_ms / 1000.0 * 25 + 0.5), 0), 299) AS BIGINT) AS frame_at, frame_id / 25.0 AS time_at,
  CASE WHEN event_id % 4 = 0 THEN 'validated' ELSE CASE WHEN event_id % 4 = 3 THEN 'a, low' ELSE 'low' END END AS quality, 'sha' AS fingerprint
FROM f
""", "time_at")  # fmt: skip
def label_functions(t: Tables) -> DataFrame:
    word, team, role, role2 = _pick(_WORDS, _E(7)), _pick(_TEAMS, _E(5)), _pick(_ROLES, _E(7)), _pick(_ROLES, F.expr("event_id div 7 % 7"))
    flags = F.when(_E(4) == 0, F.array().cast("array<string>")).when(_E(4) == 3, F.array(F.lit("low"), F.lit("a"))).otherwise(F.array(F.lit("low")))
    c = F.col("confidence")
    same = L.fingerprint(F.lit(1), team) == L.fingerprint(F.lit(1), team)
    return t.tracks.select(
        "event_id", L.tri_state(word).alias("flag"), L.known_team(team).alias("known"), L.team_index(team).alias("team_index"), L.side(team).alias("side"), L.role_family(role).alias("role_family"), L.excluded_role(role).alias("excluded"), L.role_mismatch(role, role2).alias("mismatch"),
        L.replay_shot(_pick(_SHOTS, _E(5))).alias("replay_shot"), L.rejection_category(_pick(_REASONS, _E(8))).alias("category"), L.jersey_text(_pick(_JERSEYS, _E(6))).alias("jersey"), L.action_status(c).alias("tier"), L.confirmed(F.when(c >= 0.65, "auto_confirmed").otherwise("unresolved")).alias("confirmed"), L.traffic_light(c).alias("light"),
        L.jersey_class(F.when(_E(9) == 0, F.lit(-1)).otherwise(_E(100)).cast("int")).alias("class"), L.clock(F.col("timestamp_ms")).alias("clock"), L.frame_of(F.col("timestamp_ms") / 1000.0, 25.0, 300).alias("frame_at"), L.time_of(F.col("frame_id"), 25.0).alias("time_at"), L.quality_words(flags).alias("quality"), F.when(same, "sha").alias("fingerprint"),
    )


@query("""
SELECT event_id, least(abs(event_id % 180 - event_id * 7 % 180), 180 - abs(event_id % 180 - event_id * 7 % 180)) <= 12 AND abs(event_id % 90 - event_id * 3 % 90) <= 50 AND abs(event_id % 50 - event_id * 11 % 120) <= 50 AS kit_close,
  confidence >= 0.4 AND (confidence >= 0.8 OR confidence - coalesce(CASE WHEN event_id % 3 > 0 THEN team_confidence END, -1.0) >= 0.1) AS accepted, CASE WHEN confidence < 0.4 THEN 'below_floor' WHEN confidence >= 0.8 THEN 'strong' WHEN confidence - coalesce(CASE WHEN event_id % 3 > 0 THEN team_confidence END, -1.0) >= 0.1 THEN 'relative_margin' ELSE 'ambiguous' END AS accept_reason,
  CASE WHEN team_confidence >= 0.22 AND confidence < 0.18 THEN 'graphic' WHEN event_id % 13 / 20.0 >= 0.35 THEN 'close_up' WHEN confidence >= 0.32 THEN CASE WHEN event_id % 5 / 100.0 > 0.025 THEN 'tactical' ELSE 'wide' END WHEN confidence >= 0.18 THEN 'medium' WHEN event_id % 4 / 20.0 >= 0.12 THEN 'crowd' WHEN event_id % 3 >= 2 THEN 'bench' ELSE 'unknown' END AS shot
FROM tr
""")  # fmt: skip
def decision_lists(t: Tables) -> DataFrame:
    hsv = lambda a, b, c: F.struct(a.alias("h"), b.alias("s"), c.alias("v"))
    close = L.hsv_close(hsv(_E(180), _E(90), _E(50)), hsv(F.expr("event_id * 7 % 180"), F.expr("event_id * 3 % 90"), F.expr("event_id * 11 % 120")))
    match = L.accept_match(F.col("confidence"), F.when(_E(3) > 0, F.col("team_confidence")), 0.4, 0.8, 0.1)
    shot = L.shot_label(F.col("confidence"), _E(5) / 100.0, F.col("team_confidence"), _E(4) / 20.0, _E(3), _E(13) / 20.0)
    return t.tracks.select("event_id", close.alias("kit_close"), match["accepted"].alias("accepted"), match["reason"].alias("accept_reason"), shot.alias("shot"))


@query("""
WITH s AS (SELECT *, event_id % 11 / 10.0 AS kit, event_id % 7 / 6.0 AS share, event_id % 5 / 4.0 AS white, event_id % 3 / 8.0 AS grey, event_id % 4 / 12.0 AS black, event_id % 13 / 20.0 AS green, event_id % 60 AS h FROM tr),
o AS (SELECT *, CASE WHEN kit >= 0.45 AND share >= 0.35 THEN (kit + share) / 2 ELSE 0.0 END AS gk, CASE WHEN kit >= 0.35 THEN greatest(0.0, kit - 0.8 * greatest(share - kit, 0.0)) ELSE 0.0 END AS off, white + 0.5 * grey AS w, black + 0.5 * grey AS d,
  CASE WHEN event_id % 2 = 0 AND x_field BETWEEN -3 AND 45 AND y_field BETWEEN -3 AND 71 THEN 'pitch' WHEN event_id % 2 = 0 AND x_field IS NOT NULL AND y_field BETWEEN -3 AND 71 THEN 'pitch' WHEN event_id % 2 = 0 THEN 'outside' WHEN y_field * 16 < 194.4 AND h < 28 THEN 'stands' WHEN y_field * 16 > 842.4 AND green < 0.12 THEN 'bench' WHEN (x_field * 20 < 230.4 OR x_field * 20 > 1689.6) AND green < 0.12 THEN 'bench' WHEN green >= 0.12 THEN 'pitch' ELSE 'unknown' END AS zone FROM s)
SELECT event_id, gk AS goalkeeper, CASE WHEN event_id % 3 = 0 THEN off ELSE 0.0 END AS referee, CASE WHEN event_id % 3 = 1 THEN off ELSE 0.0 END AS assistant, zone, w AS white_score, d AS dark_score, greatest(0.0, 1 - w - d) AS coloured_score, d >= 0.5 AS is_dark,
  CASE WHEN NOT replay THEN array_to_string(list_filter([CASE WHEN CASE WHEN event_id % 3 = 1 THEN off ELSE 0.0 END >= 0.3 THEN 'assistant_referee' END, CASE WHEN gk >= 0.3 THEN 'goalkeeper' END, CASE WHEN zone = 'pitch' AND share >= 0.3 THEN 'player' END, CASE WHEN CASE WHEN event_id % 3 = 0 THEN off ELSE 0.0 END >= 0.3 THEN 'referee' END, CASE WHEN zone = 'stands' THEN 'spectator' END, CASE WHEN zone = 'bench' THEN 'staff' END], lambda x: x IS NOT NULL), ',') END AS roles
FROM o
""", "goalkeeper referee assistant white_score dark_score coloured_score")  # fmt: skip
def role_scores(t: Tables) -> DataFrame:
    kit, share = _E(11) / 10.0, _E(7) / 6.0
    keeper, officials = roles.goalkeeper_score(kit, share), roles.official_scores(kit, share, _E(3) == 0, _E(3) == 1)
    known = _E(2) == 0
    zone = roles.person_zone(F.when(known, F.col("x_field")), F.when(known, F.col("y_field")), F.col("y_field") * 16, F.col("x_field") * 20, _E(13) / 20.0, _E(60))
    kits = roles.kit_scores(F.create_map(F.lit("white"), _E(5) / 4.0, F.lit("grey"), _E(3) / 8.0, F.lit("black"), _E(4) / 12.0))
    found = roles.role_evidence(share, keeper, officials, zone, F.col("replay"))
    return t.tracks.select("event_id", keeper.alias("goalkeeper"), officials["referee"].alias("referee"), officials["assistant"].alias("assistant"), zone.alias("zone"), kits["white"].alias("white_score"), kits["dark"].alias("dark_score"), kits["coloured"].alias("coloured_score"), kits["is_dark"].alias("is_dark"), F.array_join(F.array_sort(F.map_keys(found)), ",").alias("roles"))


@query("""
WITH c AS (SELECT *, CASE WHEN event_id % 9 > 0 THEN 'left' END AS orientation, event_id % 8 AS points, CASE WHEN event_id % 6 > 0 THEN event_id % 12 * 1.0 END AS err, event_id % 5 / 10.0 AS cov FROM tr)
SELECT event_id, concat_ws('; ', CASE WHEN orientation IS NULL THEN 'orientation_unknown' END, CASE WHEN points < 4 THEN 'too_few_points' END, CASE WHEN NOT coalesce(err <= 8, false) THEN 'reprojection_error' END, CASE WHEN NOT coalesce(cov >= 0.15, false) THEN 'low_coverage' END, CASE WHEN NOT coalesce(confidence >= 0.5, false) THEN 'low_confidence' END) AS reasons FROM c
""")  # fmt: skip
def calibration_gate_reasons(t: Tables) -> DataFrame:
    c = t.tracks.withColumns({"orientation": F.when(_E(9) > 0, "left"), "points": _E(8), "reprojection_error": F.when(_E(6) > 0, _E(12) * 1.0), "coverage": _E(5) / 10.0})
    return c.select("event_id", roles.calibration_accepted().alias("reasons"))


@query("""
WITH p AS (SELECT match_id, frame_id, track_id AS priority, 'p' || track_id AS provider, event_id % 5 = 0 AS valid, 'r' || (event_id % 3) AS reason FROM tr)
SELECT match_id, frame_id, arg_min(provider, priority) FILTER (valid) AS provider, bool_or(valid) AS valid, CASE WHEN NOT bool_or(valid) THEN string_agg(reason, '; ' ORDER BY priority) END AS reasons FROM p GROUP BY ALL
""")  # fmt: skip
def provider_chain(t: Tables) -> DataFrame:
    rows = t.tracks.select(*FRAME, F.col("track_id").alias("priority"), F.concat(F.lit("p"), "track_id").alias("provider"), (_E(5) == 0).alias("valid"), F.concat(F.lit("r"), _E(3)).alias("reason"))
    return roles.first_valid_provider(rows, FRAME)


@query("""SELECT match_id, track_id, sum(exp(confidence) * greatest(team_confidence, 1e-6) * x_field) FILTER (event_id % 4 <> 0) / sum(exp(confidence) * greatest(team_confidence, 1e-6)) FILTER (event_id % 4 <> 0) AS x_field FROM tr GROUP BY ALL""", "x_field")
def weighted_pool(t: Tables) -> DataFrame:
    return roles.quality_weighted_pool(t.tracks.withColumns({"score": F.col("confidence"), "quality": F.col("team_confidence"), "masked": _E(4) == 0}), TRACK, "x_field")


# canonical joins ---------------------------------------------------------------------------------------------------

_IDS = "ids AS (SELECT match_id, frame_id, track_id, CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 9 = 1 THEN 'unknown' ELSE team_id END END AS team_id, team_confidence, CASE WHEN track_id % 11 = 0 THEN 'goalkeeper' ELSE 'player' END AS role FROM tr WHERE event_type <> 'purchase')"


def _ids(t: Tables) -> DataFrame:
    team = F.when(_E(4) > 0, F.when(_E(9) == 1, "unknown").otherwise(F.col("team_id")))
    return t.tracks.where("event_type <> 'purchase'").select(*FRAME, "track_id", team.alias("team_id"), "team_confidence", F.when(F.col("track_id") % 11 == 0, "goalkeeper").otherwise("player").alias("role"))


@query("""SELECT match_id, frame_id, track_id, CASE WHEN track_id % 5 = 4 THEN false ELSE track_id % 3 > 0 END AS quality_ok FROM tr WHERE event_type <> 'error'""")
def samples_with_quality(t: Tables) -> DataFrame:
    quality = t.tracks.select(*TRACK).distinct().where("track_id % 5 <> 4").withColumn("usable_for_metrics", F.col("track_id") % 3 > 0)
    rows = canonical.people(t.tracks.withColumn("object_type", F.when(F.col("event_type") != "error", "person").otherwise("ball")))
    return canonical.with_quality(rows, quality, TRACK).select(*FRAME, "track_id", "quality_ok")


@query(f"""WITH {_IDS} SELECT t.match_id, t.frame_id, t.track_id, t.x_field, ids.team_id, ids.team_confidence FROM tr t JOIN ids USING (match_id, frame_id, track_id) WHERE ids.team_id IN ('team_0', 'team_1')""", "x_field team_confidence")
def team_samples(t: Tables) -> DataFrame:
    return canonical.team_samples(t.tracks, _ids(t), [*FRAME, "track_id"]).select(*FRAME, "track_id", "x_field", "team_id", "team_confidence")


@query(f"""
WITH {_IDS}, c AS (SELECT match_id, frame_id, event_type <> 'error' AS ok, confidence AS conf, CASE WHEN event_type = 'error' AND frame_id % 2 = 0 THEN 'no lines' END AS why FROM tr WHERE track_id = 0 AND event_type <> 'purchase'),
s AS (SELECT match_id, frame_id, CASE WHEN frame_id % 3 = 2 THEN 'close_up' ELSE 'wide' END AS shot FROM tr WHERE track_id = 0 AND confidence < 0.95),
j AS (SELECT t.match_id, t.frame_id, t.timestamp_ms, t.track_id, ids.role, ids.team_id, t.x_field * 10 AS fx, t.y_field * 10 AS fy, coalesce(c.ok, false) AS ok, c.conf, c.why, coalesce(s.shot, 'unknown') AS shot FROM tr t LEFT JOIN c USING (match_id, frame_id) LEFT JOIN s USING (match_id, frame_id) LEFT JOIN ids USING (match_id, frame_id, track_id)),
v AS (SELECT *, ok AND shot = 'wide' AND fx / 5 + 1 BETWEEN 0 AND 105 AND fy / 9 BETWEEN 0 AND 68 AS valid FROM j)
SELECT match_id, frame_id, timestamp_ms, track_id, role, team_id, fx AS foot_x_pixel, fy AS foot_y_pixel, CASE WHEN valid THEN fx / 5 + 1 END AS x_field, CASE WHEN valid THEN fy / 9 END AS y_field, shot AS shot_type, valid, CASE WHEN valid THEN conf ELSE 0.0 END AS calibration_confidence,
  CASE WHEN NOT valid THEN CASE WHEN NOT ok THEN coalesce(why, 'calibration_missing') WHEN shot <> 'wide' THEN 'shot_type_' || shot || '_not_spatial' ELSE 'foot_point_outside_pitch' END END AS invalid_reason FROM v
""", "timestamp_ms foot_x_pixel foot_y_pixel x_field y_field calibration_confidence")  # fmt: skip
def game_state(t: Tables) -> DataFrame:
    tracks = t.tracks.select(*FRAME, "timestamp_ms", "track_id", (F.col("x_field") * 10).alias("foot_x_pixel"), (F.col("y_field") * 10).alias("foot_y_pixel"))
    bad = F.col("event_type") == "error"
    c = t.frames.where("event_type <> 'purchase'").select(*FRAME, (~bad).alias("valid"), "confidence", F.when(bad & (F.col("frame_id") % 2 == 0), "no lines").alias("reason"), F.lit(f"[[0.2,0,1],[0,{1 / 9!r},0],[0,0,1]]").alias("homography_json"))
    shots = t.frames.where("confidence < 0.95").select(*FRAME, F.when(F.col("frame_id") % 3 == 2, "close_up").otherwise("wide").alias("shot_type"))
    return canonical.game_state(tracks, c, shots, _ids(t), FRAME)


@query("""SELECT c.touch_id, c.match_id, b.pitch_x, b.pitch_y FROM touches c LEFT JOIN ball b USING (match_id, frame_id)""", "pitch_x pitch_y")
def touches_on_pitch(t: Tables) -> DataFrame:
    return canonical.touches_on_pitch(t.touches.drop("pitch_x", "pitch_y"), t.ball, FRAME).select("touch_id", "match_id", "pitch_x", "pitch_y")


@query("""
WITH b AS (SELECT match_id, frame_id, abs(v - lag(v) OVER w) AS dv, abs(d - lag(d) OVER w) AS dd FROM (SELECT match_id, frame_id, CASE WHEN visible THEN pitch_x / 3 END AS v, CASE WHEN visible THEN pitch_y * 2 END AS d FROM ball) WINDOW w AS (PARTITION BY match_id ORDER BY frame_id))
SELECT touch_id, c.match_id, dv AS ball_velocity_change, dd AS ball_direction_change, false AS pose_evidence, CASE WHEN confidence >= 0.65 THEN 'confirmed' WHEN confidence >= 0.4 THEN 'candidate' ELSE 'unresolved' END AS status, timestamp_ms / 1000.0 AS timestamp FROM touches c LEFT JOIN b USING (match_id, frame_id)
""", "ball_velocity_change ball_direction_change timestamp")  # fmt: skip
def touch_motion(t: Tables) -> DataFrame:
    ball = t.ball.select(*FRAME, (F.col("pitch_x") / 3).alias("velocity_mps"), (F.col("pitch_y") * 2).alias("direction"))
    return canonical.touch_motion(t.touches, ball, MATCH).select("touch_id", "match_id", "ball_velocity_change", "ball_direction_change", "pose_evidence", "status", "timestamp")


@query("""SELECT c.match_id, 'aerial-cand-' || touch_id AS duel_id, track_id AS player_a, team_id AS team_a, timestamp_ms, 'aerial_duel' AS duel_type, 0.42 AS confidence, 'candidate' AS status FROM touches c WHERE EXISTS (SELECT 1 FROM ball b WHERE b.match_id = c.match_id AND b.frame_id = c.frame_id AND b.interpolated)""", "confidence")
def aerial_candidates(t: Tables) -> DataFrame:
    return canonical.aerial_candidates(t.touches, t.ball.withColumn("visibility_state", F.when(F.col("interpolated"), "airborne").otherwise("visible")), FRAME)


@query("""SELECT match_id, frame_id, track_id, CASE WHEN track_id % 3 > 0 THEN track_id % 4 + 100 ELSE track_id END AS global_id FROM tr""")
def mapped_ids(t: Tables) -> DataFrame:
    ids = t.tracks.select(*TRACK).distinct().where("track_id % 3 > 0").withColumn("global_id", F.col("track_id") % 4 + 100)
    return canonical.mapped(t.tracks.select(*FRAME, "track_id"), ids, MATCH)


@query(f"""WITH {_IDS} SELECT t.match_id, t.frame_id, t.track_id, CASE WHEN t.event_type = 'click' THEN 'player' ELSE ids.role END AS role, CASE WHEN t.event_type = 'click' THEN t.team_id WHEN ids.team_id <> 'unknown' THEN ids.team_id END AS team_id FROM tr t LEFT JOIN ids USING (match_id, frame_id, track_id)""")
def preferred_rows(t: Tables) -> DataFrame:
    game = t.tracks.where("event_type = 'click'").select(*FRAME, "track_id", F.lit("player").alias("role"), "team_id")
    return canonical.preferred(game, _ids(t), t.tracks.select(*FRAME, "track_id"), [*FRAME, "track_id"])


@query(f"""
WITH {_IDS}, v AS (SELECT match_id, track_id % 6 AS display_id, team_id, sum(team_confidence) AS vote FROM ids WHERE track_id <> 21 AND team_id IS NOT NULL GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY match_id, display_id ORDER BY vote DESC, team_id) AS rn FROM v)
SELECT i.match_id, i.frame_id, i.track_id, coalesce(b.team_id, i.team_id) AS team_id, i.track_id % 2 = 0 OR b.team_id IS NOT NULL AS valid, CASE WHEN i.track_id <> 21 THEN i.track_id % 6 END AS display_id FROM ids i LEFT JOIN b ON b.match_id = i.match_id AND b.display_id = i.track_id % 6 AND i.track_id <> 21 AND rn = 1
""")  # fmt: skip
def display_team_lock(t: Tables) -> DataFrame:
    ids = _ids(t).withColumn("valid", F.col("track_id") % 2 == 0)
    displays = t.tracks.select(*TRACK).distinct().where("track_id <> 21").withColumn("display_id", F.col("track_id") % 6)
    return canonical.display_teams(ids, displays, MATCH).select(*FRAME, "track_id", "team_id", "valid", "display_id")


@query(f"""
WITH {_SPEEDS}, s AS (SELECT *, sum(CASE WHEN speed_kmh IS NOT NULL THEN step_m ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY timestamp_ms) AS cum FROM sp)
SELECT match_id, track_id, count(*) AS measurable_frames, (max(timestamp_ms) - min(timestamp_ms)) / 1000.0 AS measurable_seconds, max(cum) AS total_distance_m, avg(speed_kmh) AS average_moving_speed_kmh, max(speed_kmh) AS maximum_reliable_speed_kmh, count(*) FILTER (speed_kmh >= 6) AS sprint_frames, max(confidence) AS coverage FROM s WHERE speed_kmh IS NOT NULL GROUP BY ALL
""", "measurable_seconds total_distance_m average_moving_speed_kmh maximum_reliable_speed_kmh coverage")  # fmt: skip
def speed_summary(t: Tables) -> DataFrame:
    rows = physical.row_speeds(t.tracks, TRACK).withColumns({"valid": F.col("speed_kmh").isNotNull(), "smoothed_speed_kmh": F.col("speed_kmh"), "sprint_state": F.when(F.col("speed_kmh") >= 6, "sprint"), "coverage": F.col("confidence")})
    return canonical.speed_summary(rows, TRACK)


@query(f"""WITH {_BOX} SELECT match_id, frame_id, count(*) AS count, quantile_cont(greatest(y2 - y1 + track_id, 0) / 1080.0, 0.5) AS median_height, max(greatest(y2 - y1 + track_id, 0) / 1080.0) AS largest_height FROM bx GROUP BY ALL""", "median_height largest_height")
def shape_stats(t: Tables) -> DataFrame:
    b = _boxes(t).select(*FRAME, F.col("y1").alias("bbox_y1"), (F.col("y2") + F.col("track_id")).alias("bbox_y2"))
    return canonical.shape_stats(b, FRAME, 1080.0)


@query("""
WITH r AS (SELECT *, sum(CASE WHEN interpolated THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY frame_id) AS run FROM ball)
SELECT match_id, frame_id, CASE WHEN interpolated THEN CAST(sum(CASE WHEN interpolated THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, run ORDER BY frame_id) AS BIGINT) ELSE 0 END AS interpolation_run FROM r
""")  # fmt: skip
def interpolation_runs(t: Tables) -> DataFrame:
    return canonical.interpolation_runs(t.ball, MATCH).select(*FRAME, "interpolation_run")


@query("""
WITH g AS (SELECT match_id, frame_id, timestamp_ms + 333 AS ms, confidence FROM tr WHERE event_type IN ('click', 'error'))
SELECT f.match_id, f.frame_id AS signal_id, f.timestamp_ms, max(g.confidence) AS spotting_score FROM (SELECT * FROM tr WHERE track_id = 0) f LEFT JOIN g ON g.match_id = f.match_id AND abs(g.ms - f.timestamp_ms) <= 400 GROUP BY ALL
""", "spotting_score timestamp_ms")  # fmt: skip
def spotting_scores(t: Tables) -> DataFrame:
    spotted = t.tracks.select("match_id", F.when(F.col("event_type").isin("click", "error"), "Goal").otherwise("card").alias("event_type"), ((F.col("timestamp_ms") + 333) / 1000.0).alias("timestamp"), "confidence")
    return canonical.spotted_score(t.frames.select("match_id", F.col("frame_id").alias("signal_id"), "timestamp_ms"), spotted, MATCH, 400.0)


@query("""
WITH s AS (SELECT match_id, event_id, replay, track_id, confidence, team_confidence, [CASE WHEN event_id % 3 > 0 THEN confidence END, CASE WHEN event_id % 5 > 0 THEN team_confidence - 0.3 END, CASE WHEN event_id % 7 > 0 THEN 0.25 END, CASE WHEN event_id % 2 > 0 THEN confidence / 2 END] AS sc FROM tr),
e AS (SELECT match_id, event_id, unnest(['ball_toward_goal', 'ball_speed_spike', 'striking_pose', 'goalkeeper_reaction']) AS source, unnest(sc) AS score, replay FROM s),
b AS (SELECT match_id, event_id, source, max(score) FILTER (score >= 0) AS best, max(-score) FILTER (score < 0) AS against FROM e WHERE score IS NOT NULL AND NOT replay GROUP BY ALL),
r AS (SELECT *, least(best, CASE WHEN row_number() OVER (PARTITION BY match_id, event_id ORDER BY best DESC NULLS LAST, source) = 1 THEN 0.5 ELSE 0.3 END) AS part FROM b),
z AS (SELECT match_id, event_id, greatest(0.0, least(1.0, coalesce(sum(part) FILTER (best IS NOT NULL), 0) - coalesce(max(against), 0))) AS score, count(*) FILTER (best > 0) >= 2 AS corroborated FROM r GROUP BY ALL)
SELECT z.match_id, z.event_id, score, corroborated, CASE WHEN score >= 0.85 AND corroborated THEN 'auto_confirmed' WHEN score >= 0.45 THEN 'candidate_review_required' WHEN score >= 0.15 THEN 'unresolved' END AS status, CASE WHEN s.confidence >= 0.7 AND NOT s.replay THEN s.track_id END AS shooter FROM z JOIN s USING (match_id, event_id)
""", "score")  # fmt: skip
def shots(t: Tables) -> DataFrame:
    c, k = F.col("confidence"), F.col("team_confidence")
    s = t.tracks.select("match_id", "event_id", F.col("replay").alias("from_replay"), F.when(_E(3) > 0, c).alias("ball_toward_goal_score"), F.when(_E(5) > 0, k - 0.3).alias("ball_speed_spike_score"), F.when(_E(7) > 0, 0.25).alias("striking_pose_score"), F.when(_E(2) > 0, c / 2).alias("goalkeeper_reaction_score"), F.col("track_id").alias("shooter_track_id"), c.alias("shooter_attribution_score"))
    keys = ["match_id", "event_id"]
    found = events.evidence_scores(canonical.shot_evidence(s, keys), keys).select(*keys, "score", "corroborated", "status")
    return found.join(s.select(*keys, canonical.shooter().alias("shooter")), keys)


@query("""
SELECT match_id, 'e' || event_id AS event_id, CASE WHEN track_id % 2 = 0 THEN 'goal' ELSE 'shot' END AS event_type, 'unresolved' AS status, timestamp_ms, timestamp_ms / 1000.0 AS timestamp_seconds, team_id, CASE WHEN confidence >= 0.8 THEN track_id END AS scorer_track_id, confidence, '{"in_replay":' || CASE WHEN replay THEN 'true' ELSE 'false' END || ',"zone":' || (track_id % 3) || '}' AS attributes_json, replay AS in_replay FROM tr
""", "timestamp_ms timestamp_seconds confidence")  # fmt: skip
def events_frame(t: Tables) -> DataFrame:
    e = t.tracks.select("match_id", F.concat(F.lit("e"), "event_id").alias("event_id"), F.when(F.col("track_id") % 2 == 0, "goal").otherwise("shot").alias("event_type"), F.lit("unresolved").alias("status"), "timestamp_ms", "team_id", F.when(F.col("confidence") >= 0.8, F.col("track_id")).alias("scorer_track_id"), "confidence", F.struct(F.col("replay").alias("in_replay"), (F.col("track_id") % 3).alias("zone")).alias("attributes"))
    return canonical.events_frame(e)


@query("""SELECT match_id, track_id, coalesce(avg(CASE WHEN event_id % 3 > 0 AND track_id <> 7 THEN confidence END), 0.5) AS confidence FROM tr GROUP BY ALL""", "confidence")
def mean_metrics(t: Tables) -> DataFrame:
    return canonical.mean_metric(t.tracks.withColumn("confidence", F.when((_E(3) > 0) & (F.col("track_id") != 7), F.col("confidence"))), TRACK, "confidence", 0.5)


@query("""
WITH c AS (SELECT match_id, track_id, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS label FROM tr WHERE team_confidence < 0.5 AND track_id <> 4), n AS (SELECT match_id, track_id, label, count(*) AS k FROM c GROUP BY match_id, track_id, label),
b AS (SELECT *, sum(k) OVER (PARTITION BY match_id, track_id) AS votes, row_number() OVER (PARTITION BY match_id, track_id ORDER BY k DESC, label) AS rn FROM n)
SELECT t.match_id, t.track_id, CAST(coalesce(votes, 0) AS BIGINT) AS votes, CASE WHEN votes >= 3 THEN label END AS team FROM (SELECT DISTINCT match_id, track_id FROM tr) t LEFT JOIN b ON b.match_id = t.match_id AND b.track_id = t.track_id AND rn = 1
""")  # fmt: skip
def crop_votes(t: Tables) -> DataFrame:
    dark = F.when(F.col("track_id") == 4, 1.0).otherwise(F.col("team_confidence"))
    return canonical.crop_votes(t.tracks.select(*TRACK, F.when(_E(3) == 0, "b").otherwise("a").alias("label"), dark.alias("dark_share")), TRACK)


@query("""
WITH a AS (SELECT match_id, track_id, CAST(track_id % 2 AS INTEGER) AS label, avg(CASE WHEN match_id % 2 = 0 THEN x_field ELSE 100 - x_field END) + 40 * (track_id % 2) * (CASE WHEN match_id % 2 = 0 THEN 1 ELSE -1 END) AS white FROM tr GROUP BY match_id, track_id)
SELECT match_id, track_id, CASE WHEN avg(white) FILTER (label = 1) OVER (PARTITION BY match_id) > avg(white) FILTER (label = 0) OVER (PARTITION BY match_id) THEN 1 - label ELSE label END AS label FROM a
""")  # fmt: skip
def whiter_first(t: Tables) -> DataFrame:
    even = F.col("match_id") % 2 == 0
    a = t.tracks.groupBy(*TRACK).agg(F.avg(F.when(even, F.col("x_field")).otherwise(100 - F.col("x_field"))).alias("w"))
    a = a.select(*TRACK, (F.col("track_id") % 2).cast("int").alias("label"), (F.col("w") + 40 * (F.col("track_id") % 2) * F.when(even, 1).otherwise(-1)).alias("white"))
    return canonical.whiter_first(a, MATCH).select(*TRACK, "label")


@query("""
WITH o AS (SELECT * FROM (VALUES ('camera_0', 0.5, 9.0, 0.001, 2.0), ('camera_1', NULL, -0.25, NULL, NULL)) v(camera_id, est, man, rate, anchor))
SELECT obs_id, coalesce(est, man) + coalesce(rate, 0) * (t - coalesce(anchor, 0)) AS effective_offset_seconds FROM obs LEFT JOIN o USING (camera_id)
""", "effective_offset_seconds")  # fmt: skip
def effective_offsets(t: Tables) -> DataFrame:
    o = t.spark.createDataFrame([("camera_0", 0.5, 9.0, 0.001, 2.0), ("camera_1", None, -0.25, None, None)], "camera_id string, offset_seconds double, manual_offset_seconds double, drift_rate double, measured_at_seconds double")
    return canonical.effective_offset(o, t.observations.select("obs_id", "camera_id", F.col("t").alias("local_s")), ["camera_id"]).select("obs_id", "effective_offset_seconds")


@query("""WITH o AS (SELECT match_id, camera_id, avg(confidence) AS off FROM (SELECT match_id, camera_id, detection_confidence AS confidence FROM obs) GROUP BY ALL) SELECT o.match_id, o.camera_id, o.off - r.off AS offset_seconds FROM o LEFT JOIN o r ON r.match_id = o.match_id AND r.camera_id = 'camera_1'""", "offset_seconds")
def rebased_offsets(t: Tables) -> DataFrame:
    o = t.observations.groupBy(*MATCH, "camera_id").agg(F.avg("detection_confidence").alias("offset_seconds"))
    return canonical.rebased_offsets(o, MATCH, "camera_1")


@query("""
WITH o AS (SELECT DISTINCT match_id, floor((t - match_id * 10) / 0.5) AS bin, camera_id FROM obs WHERE detection_confidence > 0.9 AND camera_id <> 'camera_2'), g AS (SELECT DISTINCT match_id, unnest(range(0, 20)) AS bin FROM obs),
a AS (SELECT g.match_id, g.bin, count(camera_id) AS n FROM g LEFT JOIN o ON o.match_id = g.match_id AND o.bin = g.bin GROUP BY ALL)
SELECT match_id, 'camera_0,camera_1' AS cameras, 'camera_2' AS missing_cameras, count(*) FILTER (n < 2) AS gaps, 0.5 * count(*) FILTER (n < 2) AS gap_seconds FROM a GROUP BY ALL
""", "gap_seconds")  # fmt: skip
def camera_coverage_report(t: Tables) -> DataFrame:
    o = t.observations.where("detection_confidence > 0.9 and camera_id <> 'camera_2'").withColumn("t", F.col("t") - F.col("match_id") * 10)
    cameras = [f"camera_{k}" for k in range(3)]
    m = t.observations.select("match_id").distinct().withColumn("duration_seconds", F.lit(10.0)).withColumn("expected", F.array(*[F.lit(c) for c in cameras[:2]]))
    return canonical.coverage_report(multicamera.camera_coverage(o, MATCH), multicamera.coverage_gaps(o, m, MATCH, 0.5, 2), MATCH, cameras)


@query("""SELECT match_id, camera_id, local_track_id, count(*) AS observations, min(t) AS first_s, max(t) AS last_s, avg(x) AS mean_x, avg(y) AS mean_y FROM obs GROUP BY ALL""", "first_s last_s mean_x mean_y")
def local_tracks(t: Tables) -> DataFrame:
    return canonical.local_tracks(t.observations, MATCH)


@query("""SELECT match_id, track_id, event_type, array_to_string(list_sort(list(DISTINCT frame_id)), ',') AS frames, count(DISTINCT frame_id) AS n_frames FROM tr GROUP BY ALL""")
def tracklet_records(t: Tables) -> DataFrame:
    return canonical.tracklet_records(t.tracks, [*TRACK, "event_type"])


# reviews -----------------------------------------------------------------------------------------------------------

_SAMPLE = "sa AS (SELECT match_id, frame_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_id * 7 % 50, frame_id) AS sample_order, frame_id % 3 > 0 AS reviewed FROM tr WHERE track_id = 0 AND frame_id % 5 = 0), gt AS (SELECT match_id, frame_id, track_id, event_type <> 'error' AS reviewed, CASE WHEN value < 80 THEN x_field END AS x1, CASE WHEN event_type <> 'view' OR match_id % 2 = 0 THEN 'yes' ELSE 'perhaps' END AS ball_visible FROM tr WHERE value < 120)"


def _sample(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*MATCH).orderBy(F.expr("frame_id * 7 % 50"), "frame_id"))
    return t.frames.where("frame_id % 5 = 0").select(*FRAME, n.alias("sample_order"), F.when(F.col("frame_id") % 3 > 0, "true").otherwise("false").alias("reviewed"))


def _truth(t: Tables) -> DataFrame:
    return t.tracks.where("value < 120").select(*FRAME, "track_id", F.when(F.col("event_type") != "error", "1").otherwise("0").alias("reviewed"), F.when(F.col("value") < 80, F.col("x_field")).alias("x1"), F.when((F.col("event_type") != "view") | (F.col("match_id") % 2 == 0), "yes").otherwise("perhaps").alias("ball_visible"))


@query(f"""WITH {_SAMPLE} SELECT match_id, frame_id, track_id FROM gt WHERE reviewed AND x1 IS NOT NULL AND EXISTS (SELECT 1 FROM sa WHERE sa.match_id = gt.match_id AND sa.frame_id = gt.frame_id AND sa.reviewed)""")
def eligible_truth(t: Tables) -> DataFrame:
    return reviews.eligible_truth(_truth(t), _sample(t), FRAME).select(*FRAME, "track_id")


@query(f"""WITH {_SAMPLE} SELECT DISTINCT match_id, frame_id FROM gt WHERE NOT EXISTS (SELECT 1 FROM sa WHERE sa.match_id = gt.match_id AND sa.frame_id = gt.frame_id)""")
def truth_outside_sample(t: Tables) -> DataFrame:
    return reviews.outside_sample(_truth(t), _sample(t), FRAME)


@query(f"""
WITH {_SAMPLE}, a AS (SELECT match_id, count(*) AS n, count(*) FILTER (reviewed) AS r, count(*) FILTER (reviewed AND ball_visible = 'perhaps') AS u FROM gt GROUP BY ALL)
SELECT match_id, n AS rows, r AS reviewed_rows, r / n AS completion_rate, CASE WHEN n < 4000 THEN 'too_few_frames:' || n || '<4000' WHEN r < n THEN 'unreviewed:' || (n - r) WHEN u > 0 THEN 'ball_visible_incomplete' ELSE 'complete' END AS reason FROM a
""", "completion_rate")  # fmt: skip
def truth_completion(t: Tables) -> DataFrame:
    g = _truth(t)
    return reviews.completion(g, MATCH).join(reviews.ball_truth_complete(g, MATCH, 4000).select(*MATCH, "reason"), MATCH)


@query(f"""
WITH {_SAMPLE}, f AS (SELECT match_id, frame_id, bool_or(reviewed) AS r, bool_or(reviewed AND ball_visible = 'perhaps') AS u FROM gt GROUP BY ALL),
a AS (SELECT sa.match_id, count(*) AS n, count(DISTINCT frame_id) AS d, count(*) FILTER (r) AS r, count(*) FILTER (u) AS u, coalesce(min(sample_order - 1) FILTER (NOT coalesce(r, false)), 0) AS first_unreviewed FROM sa LEFT JOIN f USING (match_id, frame_id) GROUP BY ALL)
SELECT match_id, r AS sample_reviewed, n = 50 AND d = 50 AND r >= 50 AND u = 0 AS complete, CASE WHEN n <> 50 THEN 'sample_size_mismatch:' || n || '!=50' WHEN d <> 50 THEN 'duplicate_frames' WHEN r < 50 THEN 'unreviewed:' || (50 - r) WHEN u > 0 THEN 'ball_visible_incomplete' ELSE 'complete' END AS reason, CAST(first_unreviewed AS BIGINT) AS first_unreviewed FROM a
""")  # fmt: skip
def sample_completion(t: Tables) -> DataFrame:
    s, g = _sample(t), _truth(t)
    return reviews.sample_complete(s, g, MATCH).join(reviews.first_unreviewed(s, g, MATCH), MATCH)


@query("""SELECT match_id, team_id, count(*) FILTER (NOT controlled_touch) = 0 AS complete, CASE WHEN count(*) FILTER (NOT controlled_touch) > 0 THEN 'unreviewed:' || count(*) FILTER (NOT controlled_touch) ELSE 'complete' END AS reason FROM touches GROUP BY ALL""")
def touch_review(t: Tables) -> DataFrame:
    return reviews.touch_review_complete(t.touches.withColumn("reviewed", F.col("controlled_touch")), [*MATCH, "team_id"])


@query(f"""WITH {_SAMPLE} SELECT f.match_id, f.frame_id, max(sa.frame_id) FILTER (sa.frame_id < f.frame_id) AS previous_frame, min(sa.frame_id) FILTER (sa.frame_id > f.frame_id) AS next_frame FROM (SELECT * FROM tr WHERE track_id = 0) f LEFT JOIN sa ON sa.match_id = f.match_id GROUP BY ALL""")
def sample_neighbours(t: Tables) -> DataFrame:
    return reviews.neighbours(t.frames.select(*FRAME), _sample(t), MATCH)


@query("""
WITH r AS (SELECT match_id, frame_id, CASE WHEN event_type = 'error' THEN 'jump' WHEN event_type = 'signup' THEN 'low' WHEN event_type = 'purchase' THEN 'other' END AS reason FROM tr WHERE event_type IN ('error', 'signup', 'purchase')),
o AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY CASE reason WHEN 'jump' THEN 0 WHEN 'low' THEN 1 ELSE 2 END, reason) AS rn FROM r), h AS (SELECT *, sha256('5:' || frame_id) AS hk FROM o WHERE rn = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY match_id, reason ORDER BY hk, frame_id) AS k FROM h), l AS (SELECT *, CASE WHEN k > CASE reason WHEN 'jump' THEN 12 WHEN 'low' THEN 20 ELSE 0 END THEN 1 ELSE 0 END AS later FROM n), c AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY later, hk, frame_id) AS pos FROM l)
SELECT match_id, frame_id, reason, row_number() OVER (PARTITION BY match_id ORDER BY frame_id) AS sample_order FROM c WHERE pos <= 50
""")  # fmt: skip
def balanced_review_sample(t: Tables) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "jump").when(F.col("event_type") == "signup", "low").when(F.col("event_type") == "purchase", "other")
    return reviews.balanced_sample(t.tracks.select(*FRAME, reason.alias("reason")).where("reason is not null"), MATCH, {"jump": 12, "low": 20}, 50, 5)


_PROPOSALS = "pr AS (SELECT match_id, frame_id, event_id AS proposal_id, event_id % 3 = 0 AS accepted, event_id % 11 = 5 AS manual, event_id % 4 = 1 AS rejected, CASE WHEN track_id % 5 = 0 THEN 'referee' ELSE 'player' END AS class_name, round(x_field) AS x1, round(y_field / 20) AS y1, round(x_field) + 5 AS x2, round(y_field / 20) + 9 AS y2 FROM tr)"


def _proposals(t: Tables) -> DataFrame:
    x, y = F.round("x_field"), F.round(F.col("y_field") / 20)
    return t.tracks.select(*FRAME, F.col("event_id").alias("proposal_id"), (_E(3) == 0).alias("accepted"), (_E(11) == 5).alias("manual"), (_E(4) == 1).alias("rejected"), F.when(F.col("track_id") % 5 == 0, "referee").otherwise("player").alias("class_name"), x.alias("x1"), y.alias("y1"), (x + 5).alias("x2"), (y + 9).alias("y2"))


@query(f"""
WITH {_PROPOSALS}, d AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id, class_name, x1, y1, x2, y2 ORDER BY proposal_id) AS rn FROM pr WHERE NOT rejected AND (accepted OR manual))
SELECT match_id, frame_id, CASE WHEN manual THEN 'manual_' || proposal_id ELSE CAST(proposal_id AS VARCHAR) END AS gt_id, class_name, x1, y1, x2, y2, true AS reviewed, CASE WHEN manual THEN 'manual' ELSE 'from_proposal' END AS notes FROM d WHERE rn = 1
""", "x1 y1 x2 y2")  # fmt: skip
def truth_from_proposals(t: Tables) -> DataFrame:
    return reviews.truth_rows(_proposals(t), FRAME)


@query(f"""WITH {_PROPOSALS} SELECT match_id, frame_id, proposal_id, CASE WHEN bool_or((accepted AND NOT rejected) OR manual) THEN 'ok' WHEN bool_or(NOT manual) THEN 'need_accept' ELSE 'need_empty_confirm' END AS guard FROM pr GROUP BY ALL""")
def save_guards(t: Tables) -> DataFrame:
    return reviews.save_guard(_proposals(t), [*FRAME, "proposal_id"])


@query("""
SELECT match_id, frame_id, CASE WHEN frame_id % 5 = 0 THEN 1.0 WHEN visible THEN ball_x_pixel - CASE WHEN frame_id % 3 = 0 THEN 24.0 ELSE frame_id % 7 + 3.0 END / 2 END AS x1, CASE WHEN frame_id % 5 = 0 THEN 9.0 WHEN visible THEN ball_y_pixel + 24.0 / 2 END AS y2 FROM ball
""", "x1 y2")  # fmt: skip
def prediction_boxes(t: Tables) -> DataFrame:
    own = F.col("frame_id") % 5 == 0
    b = t.ball.withColumns({"ball_x1": F.when(own, 1.0), "ball_y1": F.when(own, 2.0), "ball_x2": F.when(own, 8.0), "ball_y2": F.when(own, 9.0), "bbox_w": F.when(F.col("frame_id") % 3 == 0, 0.0).otherwise(F.col("frame_id") % 7 + 3.0), "bbox_h": F.lit(None).cast("double")})
    p = reviews.prediction_box()
    return b.select(*FRAME, p["x1"].alias("x1"), p["y2"].alias("y2"))


@query("""SELECT match_id, global_id, count(*) AS events, max(event_id) AS last_sequence FROM (SELECT match_id, event_id, unnest(CASE WHEN track_id = frame_id % 22 THEN [track_id] ELSE [track_id, frame_id % 22] END) AS global_id FROM tr) GROUP BY ALL""")
def identity_history(t: Tables) -> DataFrame:
    return reviews.history(t.tracks.select("match_id", F.col("event_id").alias("sequence"), F.col("track_id").alias("source_id"), F.expr("frame_id % 22").alias("target_id")), MATCH)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN timestamp_ms END AS start_ms, CASE WHEN event_id % 3 = 0 THEN timestamp_ms + 500 END AS end_ms FROM tr""", "start_ms end_ms")
def event_intervals(t: Tables) -> DataFrame:
    a = F.create_map(F.lit("interval_start_ms"), F.col("timestamp_ms").cast("string"), F.lit("interval_end_ms"), F.when(_E(3) == 0, (F.col("timestamp_ms") + 500).cast("string")).when(_E(3) == 1, "soon"))
    i = reviews.interval_from(a)
    return t.tracks.select("event_id", i["start_ms"].alias("start_ms"), i["end_ms"].alias("end_ms"))


@query("""SELECT match_id, camera_id, calibration_source, calibration_source <> 'missing' AS calibrated, estimated_bytes FROM (SELECT match_id, camera_id, CASE WHEN bool_or(jersey_number = 99) THEN 'manual' WHEN camera_id = 'camera_1' THEN 'prepared' WHEN camera_id = 'camera_0' AND match_id % 2 = 0 THEN 'provider' ELSE 'missing' END AS calibration_source, greatest(67108864, CAST(floor(sum(obs_id * 1000) * 0.1) AS BIGINT)) AS estimated_bytes FROM obs GROUP BY match_id, camera_id)""")
def camera_status(t: Tables) -> DataFrame:
    o = t.observations
    c = o.select(*MATCH, "camera_id").distinct().withColumns({"manual": F.lit(False), "prepared": F.col("camera_id") == "camera_1", "provider_valid": (F.col("camera_id") == "camera_0") & (F.col("match_id") % 2 == 0)})
    size = reviews.run_bytes(o.withColumn("size_bytes", F.col("obs_id") * 1000), [*MATCH, "camera_id"])
    return reviews.camera_status(c).drop("manual", "prepared", "provider_valid").join(size, [*MATCH, "camera_id"])


# summaries and audits ----------------------------------------------------------------------------------------------


def _quality(t: Tables) -> DataFrame:
    return physical.track_quality(t.tracks.withColumn("bbox_valid", F.lit(True)), TRACK)


@query("""
WITH b AS (SELECT match_id, track_id, frame_id, (2 * x_field * 10 + 20 + track_id) / 2 AS cx, y_field * 10 + 25 AS cy, x_field * 10 <= 0 OR y_field * 10 <= 0 OR x_field * 10 + 20 + track_id >= 600 OR y_field * 10 + 50 >= 500 AS edge FROM tr),
m AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER w = 1 THEN sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) / 50.0 END AS mv FROM b WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_id)),
s AS (SELECT match_id, track_id, quantile_cont(mv, 0.5) AS median_jitter, avg(CASE WHEN edge THEN 1.0 ELSE 0.0 END) AS truncation, min(frame_id) AS f, max(frame_id) AS l, count(*) AS n FROM m GROUP BY ALL),
c AS (SELECT s.match_id, s.track_id, count(*) AS cuts FROM s JOIN tr t ON t.match_id = s.match_id AND t.track_id = 0 AND t.scene_cut AND t.frame_id > f AND t.frame_id <= l GROUP BY ALL)
SELECT match_id, track_id, median_jitter, truncation, coalesce(cuts, 0) AS scene_cut_count, n >= 10 AND truncation <= 0.4 AS usable FROM s LEFT JOIN c USING (match_id, track_id)
""", "median_jitter truncation")  # fmt: skip
def track_quality_table(t: Tables) -> DataFrame:
    q = _quality(t).withColumn("quality_score", F.lit(1.0))
    d = summaries.track_quality_table(q, t.boxes, t.frames, MATCH, 600.0, 500.0, max_truncation=0.4)
    return d.select(*TRACK, "median_jitter", "truncation", "scene_cut_count", F.col("usable_for_metrics").alias("usable"))


@query("""
WITH f AS (SELECT match_id, frame_id, event_type <> 'error' AS valid, x_field AS px, y_field AS py, ['Scene cut', 'reproj', NULL][frame_id % 3 + 1] AS reason FROM tr WHERE track_id = 0),
l AS (SELECT *, last_value(CASE WHEN valid THEN px END IGNORE NULLS) OVER w AS lx, last_value(CASE WHEN valid THEN py END IGNORE NULLS) OVER w AS ly FROM f WINDOW w AS (PARTITION BY match_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, frame_id, CASE WHEN valid THEN sqrt((px - lx) * (px - lx) + (py - ly) * (py - ly)) END AS jump, coalesce(CASE WHEN valid THEN sqrt((px - lx) * (px - lx) + (py - ly) * (py - ly)) END > 5, false) AS jumped, ['scene_cut', 'reprojection_error', NULL][frame_id % 3 + 1] AS category FROM l
""", "jump")  # fmt: skip
def calibration_audit(t: Tables) -> DataFrame:
    f = t.tracks.where("track_id = 0").select(*FRAME, (F.col("event_type") != "error").alias("valid"), F.col("x_field").alias("px"), F.col("y_field").alias("py"), _pick(["Scene cut", "reproj", None], F.col("frame_id") % 3).alias("reason"))
    return summaries.calibration_audit(f, MATCH, 5.0).select(*FRAME, "jump", "jumped", "category")


@query("""
WITH f AS (SELECT match_id, frame_id, timestamp_ms, scene_cut, count(*) FILTER (calibration_valid AND team_confidence > 0.4) AS players FROM tr GROUP BY match_id, frame_id, timestamp_ms, scene_cut),
s AS (SELECT *, unnest(range(CAST(greatest(floor(timestamp_ms / 500) - 3, 0) AS BIGINT), CAST(floor(timestamp_ms / 500) AS BIGINT) + 1)) AS slot FROM f), a AS (SELECT match_id, slot, avg(players) - 5 * sum(CASE WHEN scene_cut THEN 1 ELSE 0 END) + 5 AS score, count(*) AS frames FROM s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, slot) AS rn FROM a) SELECT match_id, slot * 500.0 AS start_ms, slot * 500.0 + 2000.0 AS end_ms, score, frames FROM b WHERE rn = 1
""", "score start_ms end_ms")  # fmt: skip
def best_window(t: Tables) -> DataFrame:
    f = t.tracks.groupBy(*FRAME, "timestamp_ms", "scene_cut").agg(F.count(F.when(F.col("calibration_valid") & (F.col("team_confidence") > 0.4), 1)).alias("players"))
    return summaries.best_window(f, MATCH, 2.0)


@query("""
WITH e AS (SELECT match_id, timestamp_ms, 0 AS new, NULL AS score FROM tr WHERE event_type = 'purchase' AND confidence > 0.9 UNION ALL SELECT match_id, timestamp_ms + 7, 1, confidence FROM tr WHERE event_type = 'signup' AND confidence > 0.9),
g AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w >= 60 OR lag(timestamp_ms) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM e WINDOW w AS (PARTITION BY match_id ORDER BY timestamp_ms, new)), i AS (SELECT *, sum(st) OVER (PARTITION BY match_id ORDER BY timestamp_ms, new) AS grp FROM g)
SELECT match_id, min(timestamp_ms) AS timestamp_ms, max(score) AS score FROM i GROUP BY match_id, grp HAVING min(new) = 1
""", "score timestamp_ms")  # fmt: skip
def spotted_goals(t: Tables) -> DataFrame:
    new = t.tracks.where("event_type = 'signup' and confidence > 0.9").select("match_id", (F.col("timestamp_ms") + 7).alias("timestamp_ms"), F.col("confidence").alias("score"))
    return summaries.spotted_goals(new, t.tracks.where("event_type = 'purchase' and confidence > 0.9"), MATCH, 60.0)


@query("""
WITH v AS (SELECT match_id, track_id, CASE WHEN event_id % 5 < 3 AND track_id % 3 = 0 THEN 'referee' WHEN track_id % 11 = 0 THEN 'goalkeeper' ELSE 'player' END AS label, CASE WHEN track_id % 7 = 5 AND event_id % 4 > 0 THEN 'stands' WHEN track_id % 7 = 2 AND event_id % 3 > 0 THEN 'bench' ELSE 'pitch' END AS zone, CASE WHEN track_id < 9 THEN 3.0 ELSE 20.0 END AS motion FROM tr),
a AS (SELECT match_id, track_id, count(*) AS n, avg(CAST(label = 'referee' AS INTEGER)) AS referee, avg(CAST(label = 'goalkeeper' AS INTEGER)) AS goalkeeper, avg(CAST(zone = 'pitch' AS INTEGER)) AS pitch, avg(CAST(zone = 'bench' AS INTEGER)) AS bench, avg(CAST(zone = 'stands' AS INTEGER)) AS stands, avg(motion) AS motion FROM v GROUP BY ALL)
SELECT match_id, track_id, CASE WHEN n < 8 THEN 'unknown' WHEN stands >= 0.6 AND motion <= 8 THEN 'spectator' WHEN referee >= 0.55 AND pitch >= 0.25 AND bench < 0.55 THEN 'referee' WHEN bench >= 0.5 THEN 'staff' WHEN goalkeeper >= 0.5 THEN 'goalkeeper' WHEN pitch > 0 THEN 'player' ELSE 'unknown' END AS role, n, referee, pitch, bench, stands FROM a
""", "referee pitch bench stands")  # fmt: skip
def final_roles(t: Tables) -> DataFrame:
    k = F.col("track_id")
    label = F.when((_E(5) < 3) & (k % 3 == 0), "referee").when(k % 11 == 0, "goalkeeper").otherwise("player")
    zone = F.when((k % 7 == 5) & (_E(4) > 0), "stands").when((k % 7 == 2) & (_E(3) > 0), "bench").otherwise("pitch")
    return summaries.final_roles(t.tracks.select(*TRACK, label.alias("label"), zone.alias("zone"), F.when(k < 9, 3.0).otherwise(20.0).alias("motion")), TRACK)


_GLOBAL = "gl AS (SELECT match_id, track_id % 8 AS global_id, arg_min(team_id, track_id) AS team_id, sum(vs) AS visible_seconds, min(f) AS first_frame, max(l) AS last_frame, count(*) AS fragments FROM (SELECT match_id, track_id, team_id, count(DISTINCT frame_id) / 25.0 AS vs, min(frame_id) AS f, max(frame_id) AS l FROM tr GROUP BY ALL) GROUP BY match_id, track_id % 8)"


def _global(t: Tables) -> DataFrame:
    mapping = t.tracks.select(*TRACK).distinct().withColumn("global_id", F.col("track_id") % 8)
    return summaries.identity_table(t.tracks, mapping, MATCH, 25.0, 7)


@query(f"""WITH {_GLOBAL} SELECT *, count(*) OVER (PARTITION BY match_id, team_id) AS team_size, count(*) OVER (PARTITION BY match_id, team_id) <= 7 AS validated FROM gl""", "visible_seconds")
def identity_table(t: Tables) -> DataFrame:
    return _global(t)


@query(f"""
WITH {_GLOBAL}, c AS (SELECT *, CASE WHEN visible_seconds < 28 THEN 'short' WHEN global_id % 3 = 0 THEN 'unsure_team' WHEN fragments > 2 THEN 'merged' ELSE 'single' END AS class FROM gl) SELECT match_id, class, count(*) AS n, sum(visible_seconds) AS visible_seconds FROM c GROUP BY ALL
""", "visible_seconds")  # fmt: skip
def fragment_classes(t: Tables) -> DataFrame:
    g = _global(t).select(*MATCH, F.lit(50).alias("frames"), (F.col("visible_seconds") - 27.2).alias("visible_seconds"), F.when(F.col("global_id") % 3 == 0, 0.1).otherwise(0.9).alias("team_confidence"), (F.col("fragments") - 1).alias("fragments"))
    return summaries.fragment_classes(g, MATCH).withColumn("visible_seconds", F.col("visible_seconds") + 27.2 * F.col("n"))


@query("""
SELECT match_id, track_id, count(*) AS rows, bool_and(new_x) AS replaced FROM (SELECT match_id, frame_id, track_id, false AS new_x FROM tr WHERE frame_id % 6 <> 1 UNION ALL SELECT match_id, frame_id, track_id, true FROM tr WHERE frame_id % 6 = 1 AND event_id % 4 > 0
  UNION ALL SELECT t.match_id, t.frame_id, t.track_id, false FROM tr t WHERE frame_id % 6 = 1 AND NOT EXISTS (SELECT 1 FROM tr u WHERE u.match_id = t.match_id AND u.frame_id = t.frame_id AND u.event_id % 4 > 0)) GROUP BY ALL
""")  # fmt: skip
def upserted_frames(t: Tables) -> DataFrame:
    old = t.tracks.select(*FRAME, "track_id", F.lit(False).alias("new_x"))
    new = t.tracks.where("frame_id % 6 = 1 and event_id % 4 > 0").select(*FRAME, "track_id", F.lit(True).alias("new_x"))
    return summaries.upsert_frame(old, new, FRAME).groupBy(*TRACK).agg(F.count("*").alias("rows"), F.min("new_x").alias("replaced"))


@query("""
WITH l AS (SELECT match_id, track_id, event_type, event_id AS revision FROM tr), n AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY revision DESC) AS rn, count(*) OVER (PARTITION BY match_id, track_id) AS revisions FROM l) SELECT match_id, track_id, event_type, revision, revisions FROM n WHERE rn = 1
""")  # fmt: skip
def latest_decisions(t: Tables) -> DataFrame:
    return summaries.latest_decisions(t.tracks.select(*TRACK, "event_type", F.col("event_id").alias("revision")), TRACK)


@query("""
SELECT g.match_id, g.status, count(t.event_id) AS n FROM (SELECT DISTINCT match_id, unnest(['click', 'view', 'refund']) AS status FROM tr) g LEFT JOIN tr t ON t.match_id = g.match_id AND t.event_type = g.status GROUP BY ALL
""")  # fmt: skip
def status_counts(t: Tables) -> DataFrame:
    return summaries.status_counts(t.tracks.withColumnRenamed("event_type", "status").where("status in ('click', 'view')"), MATCH, "status", ["click", "view", "refund"])


@query("""
WITH c AS (SELECT 'camera_' || (track_id % 4) AS camera_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' ELSE 'PASSED' END AS status FROM tr)
SELECT camera_id, count(*) FILTER (status = 'PASSED') AS "PASSED", count(*) FILTER (status = 'FAILED') AS "FAILED", count(*) FILTER (status = 'PENDING') AS "PENDING", count(*) FILTER (status = 'RETRY') AS "RETRY", count(*) AS chunks, 30.0 * count(*) FILTER (status = 'PASSED') AS seconds_done, round(100.0 * count(*) FILTER (status = 'PASSED') / count(*), 1) AS done_pct FROM c GROUP BY ALL
""", "seconds_done")  # fmt: skip
def chunk_consolidation(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "PENDING").otherwise("PASSED")
    c = t.tracks.select(F.concat(F.lit("camera_"), F.col("track_id") % 4).alias("camera_id"), status.alias("status"), F.lit(0.0).alias("start_seconds"), F.lit(30.0).alias("end_seconds"))
    return summaries.consolidate(c, ["PASSED", "FAILED", "PENDING", "RETRY"])


@query("""
WITH c AS (SELECT camera_id, obs_id AS chunk_index, CASE WHEN obs_id % 5 = 0 THEN 'PASSED' WHEN obs_id % 5 = 1 THEN 'FAILED' ELSE 'PENDING' END AS status, obs_id % 4 AS attempts, CASE WHEN obs_id % 3 = 0 THEN 'old' WHEN obs_id % 3 = 1 THEN 'new' END AS fp FROM obs),
i AS (SELECT camera_id, chunk_index, CASE WHEN fp = 'old' THEN 'PENDING' ELSE status END AS status, CASE WHEN fp = 'old' THEN 0 ELSE attempts END AS attempts, CASE WHEN fp = 'old' THEN NULL ELSE fp END AS fp FROM c), m AS (SELECT *, chunk_index % 7 < 2 AS tried, chunk_index % 7 = 0 AS ok FROM i)
SELECT camera_id, chunk_index, CASE WHEN tried AND ok THEN 'PASSED' WHEN tried AND attempts + 1 >= 3 THEN 'FAILED' WHEN tried THEN 'RETRY' ELSE status END AS status, attempts + CASE WHEN tried THEN 1 ELSE 0 END AS attempts, CASE WHEN tried THEN 'new' ELSE fp END AS fingerprint, NOT (status = 'PASSED' AND coalesce(fp = 'new', false)) AND NOT (status = 'FAILED' AND coalesce(fp = 'new', false) AND attempts >= 3) AS due FROM m
""")  # fmt: skip
def chunk_states(t: Tables) -> DataFrame:
    o = F.col("obs_id")
    c = t.observations.select("camera_id", o.alias("chunk_index"), F.when(o % 5 == 0, "PASSED").when(o % 5 == 1, "FAILED").otherwise("PENDING").alias("status"), (o % 4).alias("attempts"), F.when(o % 3 == 0, "old").when(o % 3 == 1, "new").alias("fingerprint"))
    fresh = chunks.invalidate(c, "new")
    results = c.where("chunk_index % 7 < 2").select("camera_id", "chunk_index", (F.col("chunk_index") % 7 == 0).alias("ok"))
    due = fresh.select("camera_id", "chunk_index", chunks.should_run(F.lit("new")).alias("due"))
    return chunks.mark(fresh, results, "new").join(due, ["camera_id", "chunk_index"])


@query("""
WITH p AS (SELECT match_id, track_id, team_id, CASE WHEN track_id = 5 THEN 'assistant_referee' WHEN track_id % 11 = 0 THEN 'goalkeeper' ELSE 'player' END AS role FROM (SELECT DISTINCT match_id, track_id, team_id FROM tr)), q AS (SELECT p.*, track_id % 4 > 0 AS valid, CASE WHEN track_id % 4 > 0 THEN track_id * 10.0 END AS d FROM p WHERE track_id <> 5)
SELECT match_id, team_id, count(*) AS players, count(*) FILTER (valid) AS measured, sum(d) AS total_distance_m, max(CASE WHEN valid THEN 20.0 + track_id END) AS max_speed_kmh, array_to_string(list_sort(list(track_id) FILTER (role = 'goalkeeper')), ',') AS goalkeepers, count(*) FILTER (NOT valid) AS excluded, 1 AS officials, 21 AS all_players FROM q GROUP BY ALL
""", "total_distance_m max_speed_kmh")  # fmt: skip
def match_tables(t: Tables) -> DataFrame:
    k = F.col("track_id")
    people = t.tracks.select(*TRACK, "team_id").distinct().withColumn("role", F.when(k == 5, "assistant_referee").when(k % 11 == 0, "goalkeeper").otherwise("player"))
    metrics = people.where("track_id % 4 > 0 and track_id % 7 <> 3 or track_id % 4 > 0").select(*TRACK, F.lit(True).alias("valid"), (k * 10.0).alias("total_distance_m"), (20.0 + k).alias("max_speed_kmh"), F.lit(None).cast("string").alias("invalid_reason"))
    players = summaries.player_table(people, metrics, TRACK)
    officials = summaries.officials_table(people, metrics.drop("team_id"), TRACK)
    m = summaries.match_summary(players, officials, MATCH).select(*MATCH, "officials", F.col("players").alias("all_players"))
    return summaries.team_table(players, MATCH).withColumn("goalkeepers", F.array_join("goalkeepers", ",")).join(m, MATCH)


@query("""
WITH s AS (SELECT match_id, track_id, coalesce(avg(CASE WHEN x_field >= 50 THEN 1.0 ELSE 0.0 END), 0) AS share FROM tr GROUP BY ALL) SELECT match_id, track_id, 'goalkeeper' AS role, share FROM s WHERE track_id % 11 = 0
""", "share")  # fmt: skip
def goalkeeper_table(t: Tables) -> DataFrame:
    players = t.tracks.select(*TRACK).distinct().withColumn("role", F.when(F.col("track_id") % 11 == 0, "goalkeeper").otherwise("player"))
    shares = t.tracks.groupBy(*TRACK).agg(F.avg((F.col("x_field") >= 50).cast("double")).alias("share"))
    return summaries.goalkeeper_table(players, shares, TRACK)


@query("""
WITH c AS (SELECT match_id, track_id, frame_id, confidence AS quality, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_id) - 1 AS n FROM tr WHERE y_field * 20 >= 400), b AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY quality DESC, frame_id) AS p FROM c WHERE n % 3 = 0)
SELECT match_id, track_id, frame_id, quality FROM b WHERE p <= 24
""", "quality")  # fmt: skip
def reid_sample_selection(t: Tables) -> DataFrame:
    crops = t.tracks.select(*TRACK, "frame_id", (F.col("y_field") * 20).alias("area"), F.col("confidence").alias("quality"))
    return identity.best_samples(crops, TRACK).select(*TRACK, "frame_id", "quality")


@query("""
SELECT count(DISTINCT frame_id) >= 50 AND count(DISTINCT track_id) >= 8 AND bool_and(confidence >= 0) AS complete, CASE WHEN count(DISTINCT frame_id) < 50 THEN 'too_few_frames' WHEN count(DISTINCT track_id) < 8 THEN 'too_few_players' WHEN NOT bool_and(confidence >= 0) THEN 'not_reviewed' END AS reason FROM tr
""")  # fmt: skip
def identity_truth_complete(t: Tables) -> DataFrame:
    return evaluation.identity_gt_complete(t.tracks.select("frame_id", F.col("track_id").alias("gt_player_id"), (F.col("confidence") >= 0).alias("reviewed")))


@query("""
WITH RECURSIVE r AS (SELECT match_id, track_id, frame_id, confidence / 1.7 AS ref, CASE WHEN track_id = 3 THEN 0.9 ELSE team_confidence / 1.3 END AS gk, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_id) AS n FROM tr),
f AS (SELECT match_id, track_id, frame_id, n, 0.25 * ref AS ref, 0.25 * gk AS gk, CASE WHEN 0.25 * gk >= 0.6 AND gk >= ref THEN 'goalkeeper' WHEN 0.25 * ref >= 0.6 THEN 'referee' ELSE 'player' END AS role FROM r WHERE n = 1
  UNION ALL SELECT match_id, track_id, frame_id, n, ref, gk, CASE WHEN was = 'goalkeeper' THEN was WHEN gk >= 0.6 AND gk >= ref THEN 'goalkeeper' WHEN ref >= 0.6 THEN 'referee' ELSE 'player' END FROM (SELECT r.match_id, r.track_id, r.frame_id, r.n, 0.75 * f.ref + 0.25 * r.ref AS ref, 0.75 * f.gk + 0.25 * r.gk AS gk, f.role AS was FROM f JOIN r ON r.match_id = f.match_id AND r.track_id = f.track_id AND r.n = f.n + 1))
SELECT match_id, track_id, frame_id, role, ref AS referee_score, gk AS goalkeeper_score FROM f
""", "referee_score goalkeeper_score")  # fmt: skip
def sticky_roles(t: Tables) -> DataFrame:
    rows = t.tracks.select(*TRACK, "frame_id", (F.col("confidence") / 1.7).alias("referee_score"), F.when(F.col("track_id") == 3, 0.9).otherwise(F.col("team_confidence") / 1.3).alias("goalkeeper_score"))
    return folds.sticky_roles(rows, TRACK)


@query("""
WITH RECURSIVE r AS (SELECT match_id, track_id, frame_id, CASE WHEN event_id % 3 > 0 THEN x_field + 1 ELSE x_field END AS x, y_field AS y, event_id % 3 > 0 AS ank, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_id) AS n FROM tr),
f AS (SELECT match_id, track_id, frame_id, n, x, y, ank FROM r WHERE n = 1 UNION ALL SELECT r.match_id, r.track_id, r.frame_id, r.n, 0.22 * r.x + 0.78 * f.x, 0.22 * r.y + 0.78 * f.y, r.ank FROM f JOIN r ON r.match_id = f.match_id AND r.track_id = f.track_id AND r.n = f.n + 1)
SELECT match_id, track_id, frame_id, x, y, CASE WHEN ank THEN 'ankle' ELSE 'bbox' END AS source FROM f
""", "x y")  # fmt: skip
def foot_points(t: Tables) -> DataFrame:
    ankle = _E(3) > 0
    rows = t.tracks.select(*TRACK, "frame_id", F.when(ankle, F.col("x_field") + 1).alias("ankle_x"), F.when(ankle, F.col("y_field")).alias("ankle_y"), F.col("x_field").alias("foot_x"), F.col("y_field").alias("foot_y"))
    return greedy.foot_points(rows, TRACK)


@query()
def participation(t: Tables) -> DataFrame:
    role = F.when(F.col("event_type") == "error", "referee").when((F.col("track_id") % 11 == 0) & (_E(4) > 0), "goalkeeper").otherwise("player")
    return folds.participation(t.tracks.select(*TRACK, "frame_id", role.alias("role"), F.col("confidence").alias("share"), F.col("calibration_valid").alias("on_pitch"), F.expr("frame_id % 200 = 199 and track_id % 5 = 1").alias("substituted")), TRACK)


@query()
def surplus_demotion(t: Tables) -> DataFrame:
    p = t.observations.select(*MATCH, "team_id", F.expr("global_id + 100 * (obs_id div 2200)").alias("global_id"), F.col("t").alias("t"))
    p = p.groupBy(*MATCH, "team_id", "global_id").agg((F.min("t") * 1000).alias("start_ms"), (F.max("t") * 1000).alias("end_ms"), (F.count("*") / 25.0).alias("visible_seconds"))
    return greedy.demote_surplus(p, [*MATCH, "team_id"], 9)


@query("""
WITH p AS (SELECT a.match_id, CASE WHEN a.detection_confidence >= b.detection_confidence THEN b.obs_id ELSE a.obs_id END AS gone FROM obs a JOIN obs b ON a.match_id = b.match_id AND a.camera_id = b.camera_id AND a.obs_id <> b.obs_id AND (a.t < b.t OR (a.t = b.t AND a.obs_id < b.obs_id)) AND b.t - a.t <= 0.08 AND a.local_track_id <> b.local_track_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.0)
SELECT match_id, camera_id, count(*) AS n FROM obs WHERE obs_id NOT IN (SELECT gone FROM p) GROUP BY ALL
""")  # fmt: skip
def suppressed_duplicates(t: Tables) -> DataFrame:
    return multicamera.suppress_duplicates(t.observations, MATCH).groupBy(*MATCH, "camera_id").agg(F.count("*").alias("n"))


@query("""
SELECT camera_id, arg_max(t, detection_confidence * 1000000 + t) AS offset_seconds, max(detection_confidence) AS confidence FROM obs WHERE camera_id <> 'camera_0' AND detection_confidence >= 0.6 GROUP BY ALL
""", "offset_seconds confidence")  # fmt: skip
def best_offsets(t: Tables) -> DataFrame:
    return multicamera.best_offsets(t.observations.select("camera_id", F.col("detection_confidence").alias("confidence"), F.col("t").alias("offset_seconds")), "camera_0")


@query("""SELECT match_id, display_id, bin_x, bin_y, dwell_ms, CASE WHEN display_id % 2 = 0 THEN 'team_0' ELSE 'team_1' END AS team_id FROM (SELECT match_id, track_id % 4 AS display_id, CAST(floor(x_field / 30) AS INTEGER) AS bin_x, CAST(floor(y_field / 30) AS INTEGER) AS bin_y, 1.0 * sum(CASE WHEN event_id % 5 > 0 THEN 40 ELSE 0 END) AS dwell_ms FROM tr GROUP BY match_id, track_id % 4, floor(x_field / 30), floor(y_field / 30)) WHERE dwell_ms > 0""", "dwell_ms")
def heatmap_export(t: Tables) -> DataFrame:
    cells = t.tracks.groupBy(*TRACK, F.floor(F.col("x_field") / 30).cast("int").alias("bin_x"), F.floor(F.col("y_field") / 30).cast("int").alias("bin_y")).agg((F.sum(F.when(_E(5) > 0, 40).otherwise(0)) * 1.0).alias("dwell_ms"))
    members = t.tracks.select(*TRACK).distinct().select(*TRACK, (F.col("track_id") % 4).alias("display_id")).withColumn("team_id", F.when(F.col("display_id") % 2 == 0, "team_0").otherwise("team_1"))
    return summaries.heatmap_export(cells, members, MATCH)


@query("""SELECT match_id, track_id FROM (SELECT match_id, track_id, count(*) AS n, avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END) AS tr_ FROM tr GROUP BY ALL) WHERE n >= 12 AND tr_ <= 0.505 AND track_id % 3 > 0""")
def reid_coverage(t: Tables) -> DataFrame:
    q = t.tracks.groupBy(*TRACK).agg(F.count("*").alias("observations"), F.avg((F.col("confidence") < 0.5).cast("double")).alias("truncation")).withColumn("usable_for_metrics", F.col("track_id") % 3 > 0)
    return summaries.reid_tracks(q, True, 12, 0.505).select(*TRACK)


def _tracked(t: Tables) -> tuple[DataFrame, DataFrame]:
    x, y = F.col("x_field") * 10, F.col("y_field") * 10
    truth = t.tracks.select(*FRAME, F.col("track_id").alias("truth_id"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 60).alias("y2"))
    dx, dy = _E(40), _E(30)
    name = F.when(F.expr("frame_id % 90 > 60"), F.expr("(track_id + 1) % 22")).otherwise(F.col("track_id"))
    found = t.tracks.where("event_type <> 'error'").select(*FRAME, name.alias("found_id"), (x + dx).alias("x1"), (y + dy).alias("y1"), (x + 60 + dx).alias("x2"), (y + 60 + dy).alias("y2"))
    return truth, found


@query(floats="hota det_a ass_a loc_a")
def hota(t: Tables) -> DataFrame:
    return mot.hota(*_tracked(t), MATCH)


@query(floats="mota motp")
def clear_mot(t: Tables) -> DataFrame:
    return mot.clear(*_tracked(t), MATCH)


@query(floats="idf1 idp idr")
def identity_scores(t: Tables) -> DataFrame:
    return mot.identity_scores(*_tracked(t), MATCH)


# other tools' formats ----------------------------------------------------------------------------------------------


def _gs_rows(t: Tables) -> DataFrame:
    return t.tracks.select(*FRAME, F.col("frame_id").cast("string").alias("image_id"), "track_id", F.lit(1.0).alias("category_id"), F.lit("object").alias("supercategory"), "confidence", F.col("x_field").alias("bbox_x"), F.when(_E(5) > 0, F.col("y_field")).otherwise(F.lit(float("nan"))).alias("bbox_y"), F.when(_E(3) > 0, F.lit("player")).alias("role"), F.col("team_id").alias("team"))


@query("""SELECT match_id, frame_id, CAST(frame_id AS VARCHAR) AS image_id, track_id, 1.0 AS category_id, confidence, x_field AS bbox_x, CASE WHEN event_id % 5 > 0 THEN y_field END AS bbox_y, CASE WHEN event_id % 3 > 0 THEN 'player' END AS role, team_id AS team FROM tr""", "category_id confidence bbox_x bbox_y")
def gs_round_trip(t: Tables) -> DataFrame:
    documents = interchange.gs_json(_gs_rows(t), FRAME, ["track_id"])
    return interchange.gs_predictions(documents, "document", FRAME).select(*FRAME, "image_id", "track_id", "category_id", "confidence", "bbox_x", "bbox_y", "role", "team")


@query("""SELECT conv_id, turn, 1 + conv_id % 2 AS half, 'commentary' AS event_type, CAST(round(turn * 1.5 * 1000) AS BIGINT) AS timestamp_ms, CAST(round((turn * 1.5 + conv_id % 3 - 0.5) * 1000) AS BIGINT) AS end_timestamp_ms, CAST(round((turn * 1.5 + conv_id % 3 - 0.5) * 1000) AS BIGINT) - CAST(round(turn * 1.5 * 1000) AS BIGINT) AS duration_ms, length(trim(text, ' ')) AS n, 'sn_echoes/' || role AS source_method, conv_id % 3 >= 1 AS valid FROM conversations""")
def commentary_events(t: Tables) -> DataFrame:
    s = t.raw("conversations").select("conv_id", "turn", (1 + F.col("conv_id") % 2).alias("half"), (F.col("turn") * 1.5).alias("start_s"), (F.col("turn") * 1.5 + F.col("conv_id") % 3 - 0.5).alias("end_s"), "text", "role")
    return interchange.commentary_events(s.select("conv_id", "turn", "half", "start_s", "end_s", "text", "role"), ["conv_id", "turn"], F.col("role")).withColumn("n", F.length("text").cast("long")).drop("text")


@query("""SELECT event_id, 'goal' AS event_type, timestamp_ms / 1000 AS timestamp, confidence, CASE WHEN event_id % 2 = 0 THEN 'm' ELSE 'unnamed' END AS source_model, CASE WHEN event_id % 3 = 0 THEN 4 ELSE frame_id END AS window_start, CASE WHEN event_id % 3 = 0 THEN 9 ELSE frame_id END AS window_end, frame_id FROM tr""", "timestamp confidence")
def spotting_decode(t: Tables) -> DataFrame:
    c = F.struct(F.lit("goal").alias("event_type"), (F.col("timestamp_ms") / 1000).alias("timestamp"), "confidence", F.when(_E(2) == 0, "m").alias("source_model"), F.when(_E(3) == 0, F.array(F.lit(4), F.lit(9))).alias("temporal_window"), "frame_id")
    return interchange.spotting_candidates(t.tracks.select("event_id", F.to_json(F.struct(F.array(c).alias("candidates"))).alias("j")), "j", ["event_id"])


@query("""
SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id % 4 * 10.0 WHEN event_id % 3 > 0 THEN event_id % 3 * 8.0 ELSE 25.0 END AS fps, CASE WHEN event_id % 5 > 0 THEN event_id % 5 WHEN event_id % 2 = 0 THEN 7 ELSE 0 END AS frame_count, CASE event_id % 3 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 0.0 ELSE 25.0 END AS rate,
  CASE event_id % 4 WHEN 0 THEN 'percent' WHEN 1 THEN 'decimal' WHEN 2 THEN 'whole' ELSE 'text' END AS format FROM tr
""", "fps rate")  # fmt: skip
def video_facts(t: Tables) -> DataFrame:
    m = t.tracks.select("event_id", (_E(4) * 10.0).alias("working_fps"), (_E(3) * 8.0).alias("reported_fps"), _E(5).alias("working_frames"), F.when(_E(2) == 0, F.lit(7)).alias("reported_frames"))
    return m.select("event_id", *interchange.video_facts(), interchange.frame_rate(_pick(["30000/1001", "0/0", "25/1"], _E(3))).alias("rate"), interchange.column_format(_pick(["pass_pct", "distance_m", "track_id", "role_name"], _E(4))).alias("format"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'tactical' WHEN 'view' THEN 'replay' ELSE 'wide' END AS shot_type, CASE WHEN event_id % 7 > 0 THEN x_field END AS x_field, CASE WHEN event_id % 5 > 0 THEN confidence ELSE 0.0 END AS confidence FROM tr""", "x_field confidence")
def player_samples(t: Tables) -> DataFrame:
    shot = F.when(F.col("event_type") == "click", "Tactical_wide").when(F.col("event_type") == "view", "replay").when(F.col("event_type") == "error", "main")
    m = t.tracks.select("event_id", shot.alias("shot_type"), F.when(_E(7) > 0, F.col("x_field")).otherwise(F.lit(float("nan"))).alias("x_field"), "y_field", F.when(_E(5) > 0, F.col("confidence")).alias("confidence"))
    return interchange.player_samples(m).select("event_id", "shot_type", "x_field", "confidence")


@query("""
WITH c AS (SELECT DISTINCT match_id, frame_id, 1 + frame_id % 3 AS k FROM tr), p AS (SELECT match_id, frame_id, track_id, x_field * 10 AS px, y_field * 10 AS py, x_field + CASE WHEN frame_id % 4 = 0 THEN 3.0 ELSE 0.5 END AS x, y_field AS y FROM tr WHERE value < 60),
e AS (SELECT p.match_id, p.frame_id, count(*) AS n, bool_or(NOT (x BETWEEN -5 AND 110 AND y BETWEEN -5 AND 73)) AS off, avg(sqrt((px * k / 10 - x) * (px * k / 10 - x) + (py / 10 - y) * (py / 10 - y))) AS err FROM p JOIN c USING (match_id, frame_id) GROUP BY ALL),
w AS (SELECT c.match_id, c.frame_id, err, CASE WHEN frame_id % 11 = 10 THEN 'not_invertible' WHEN n < 4 THEN 'too_few_control_points' WHEN off THEN 'control_points_outside_pitch' WHEN err > 2 THEN 'reprojection_error' END AS why FROM c LEFT JOIN e USING (match_id, frame_id))
SELECT match_id, frame_id, why IS NULL AS valid, CASE WHEN why IS NULL THEN err END AS reprojection_error_m, why AS invalid_reason FROM w
""", "reprojection_error_m")  # fmt: skip
def camera_gates(t: Tables) -> DataFrame:
    k = 1 + F.col("frame_id") % 3
    singular = F.col("frame_id") % 11 == 10
    cells = F.array(*[F.when(singular, F.lit(0.0)).otherwise(c) for c in (k * 0.1, *[F.lit(v) for v in (0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0)])], F.lit(1.0))
    points = t.tracks.where("value < 60").select(*FRAME, (F.col("x_field") * 10).alias("px"), (F.col("y_field") * 10).alias("py"), (F.col("x_field") + F.when(F.col("frame_id") % 4 == 0, 3.0).otherwise(0.5)).alias("x"), F.col("y_field").alias("y"))
    return interchange.camera_gates(t.frames.select(*FRAME, cells.alias("cells")), points, FRAME)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no_width' WHEN 1 THEN 'no_width;no_height' ELSE 'not_finite' END AS violations FROM tr WHERE event_id % 4 < 3""")
def box_violations(t: Tables) -> DataFrame:
    k = _E(4)
    b = t.tracks.select("event_id", F.lit(5.0).alias("bbox_x1"), F.lit(5.0).alias("bbox_y1"), F.when(k == 2, F.lit(None).cast("double")).when(k < 2, 5.0).otherwise(9.0).alias("bbox_x2"), F.when(k == 1, 4.0).otherwise(9.0).alias("bbox_y2"))
    return interchange.box_violations(b, ["event_id"])


@query("""SELECT unnest([5, 3, 9]) AS event_id, unnest([0, 1, 2]) AS place""")
def selected_rows(t: Tables) -> DataFrame:
    return interchange.selected_rows(t.tracks.select("event_id"), [5, 3, 9], "event_id").select(F.col("event_id").cast("int").alias("event_id"), "place")


@query("""SELECT t.event_id, count(*) AS zones FROM tr t JOIN (VALUES (0, 35, 0, 68), (35, 70, 0, 68), (70, 105, 0, 68), (0, 16.5, 13.84, 54.16), (88.5, 105, 13.84, 54.16), (0, 105, 0, 68 / 3.0), (0, 105, 68 / 3.0, 136 / 3.0), (0, 105, 136 / 3.0, 68)) z(x1, x2, y1, y2) ON t.x_field > z.x1 AND t.x_field <= z.x2 AND t.y_field > z.y1 AND t.y_field <= z.y2 GROUP BY ALL""")
def zone_membership(t: Tables) -> DataFrame:
    z = interchange.zone_geometry(t.spark)  # eight rows
    return t.tracks.join(F.broadcast(z), (F.col("x_field") > F.col("x1")) & (F.col("x_field") <= F.col("x2")) & (F.col("y_field") > F.col("y1")) & (F.col("y_field") <= F.col("y2"))).groupBy("event_id").agg(F.count("*").alias("zones"))


@query("""SELECT match_id, frame_id, track_id, (2 * x_field * 10 + 20 + track_id) / 2 AS foot_x_pixel, y_field * 10 + 46 AS foot_y_pixel, x_field * 10 AS bbox_x1 FROM tr""", "foot_x_pixel foot_y_pixel bbox_x1")
def ankle_foot_points(t: Tables) -> DataFrame:
    rows = interchange.with_ankles(t.boxes.withColumns({"foot_x_pixel": F.lit(0.0), "foot_y_pixel": F.lit(0.0)}))
    names = rows.select("match_id", F.col("frame_id").alias("frame_idx"), F.col("track_id").alias("id"), "foot_x_pixel", "foot_y_pixel", F.col("bbox_x1").alias("left"))
    o = interchange.overlay_table(names.drop("match_id", "foot_x_pixel", "foot_y_pixel"))
    return o.join(rows.select(*FRAME, "track_id", "foot_x_pixel", "foot_y_pixel"), ["frame_id", "track_id"]).select(*FRAME, "track_id", "foot_x_pixel", "foot_y_pixel", "bbox_x1")


@query("""SELECT match_id, track_id, track_id % 3 = 0 AS same FROM (SELECT DISTINCT match_id, track_id FROM tr)""")
def proposals_are_truth(t: Tables) -> DataFrame:
    boxes = lambda d: t.tracks.select(*TRACK, "frame_id", (F.col("x_field") + d).alias("x1"), F.col("y_field").alias("y1"), (F.col("x_field") + 4).alias("x2"), (F.col("y_field") + 9).alias("y2"))
    return interchange.same_boxes(boxes(F.when(F.col("track_id") % 3 == 0, 0.0).otherwise(1.0)), boxes(F.lit(0.0)), TRACK)


@query("""
WITH f AS (SELECT match_id, frame_id, x_field AS x, y_field AS y, confidence FROM tr WHERE event_type = 'error'), g AS (SELECT match_id, frame_id, x_field AS x, y_field AS y, confidence FROM tr WHERE event_type = 'signup' AND track_id < 9),
a AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY confidence DESC, x DESC, y DESC) AS rn FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY confidence DESC, x DESC, y DESC) AS rn FROM g)
SELECT t.match_id, t.frame_id, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.confidence, b.confidence, 0) AS confidence, CASE WHEN a.x IS NOT NULL THEN 'detected' WHEN b.x IS NOT NULL THEN 'tracked' ELSE 'missing' END AS provenance
FROM (SELECT * FROM tr WHERE track_id = 0) t LEFT JOIN a ON a.match_id = t.match_id AND a.frame_id = t.frame_id AND a.rn = 1 LEFT JOIN b ON b.match_id = t.match_id AND b.frame_id = t.frame_id AND b.rn = 1
""", "x y confidence")  # fmt: skip
def ball_provenance(t: Tables) -> DataFrame:
    at = lambda where: t.tracks.where(where).select(*FRAME, F.col("x_field").alias("x"), F.col("y_field").alias("y"), "confidence")
    return interchange.ball_provenance(at("event_type = 'error'"), at("event_type = 'signup' and track_id < 9"), t.frames, FRAME)


def _recovered(t: Tables) -> DataFrame:
    state = F.when(~F.col("visible"), "unknown").when(F.col("interpolated"), "airborne").otherwise("detected")
    return interchange.recover_ball(t.ball.select(*FRAME, "timestamp_ms", F.col("ball_x_pixel").alias("x"), F.col("ball_y_pixel").alias("y"), state.alias("state"), F.col("ball_confidence").alias("confidence")), MATCH)


@query(floats="x y confidence")
def ball_recovery(t: Tables) -> DataFrame:
    return _recovered(t)


@query(floats="raw_detection_coverage tracked_coverage interpolated_coverage longest_missing_interval_ms")
def ball_coverage(t: Tables) -> DataFrame:
    return interchange.ball_coverage(_recovered(t), MATCH)


@query()
def team_centres(t: Tables) -> DataFrame:
    d = t.tracks.groupBy(*TRACK).agg((F.avg("confidence") + F.when(F.col("track_id") < 11, 0.4).otherwise(0.0)).alias("white"), F.avg("team_confidence").alias("colour"), F.lit(0.1).alias("dark_share"))
    return interchange.two_centres(d, MATCH, ["white", "colour"])


@query("""
WITH p AS (SELECT match_id, track_id, event_id % 180 AS h, event_id * 7 % 256 AS s, event_id * 11 % 256 AS v FROM tr), f AS (SELECT *, CASE WHEN v < 60 THEN 'black' WHEN s < 45 AND v >= 170 THEN 'white' WHEN s < 45 THEN 'grey' WHEN h < 8 OR h >= 170 THEN 'red' WHEN h < 22 THEN 'orange' WHEN h < 35 THEN 'yellow' WHEN h < 80 THEN 'green' WHEN h < 100 THEN 'cyan' WHEN h < 130 THEN 'blue' WHEN h < 150 THEN 'purple' ELSE 'pink' END AS family FROM p)
SELECT *, n / sum(n) OVER (PARTITION BY match_id, track_id) AS share FROM (SELECT match_id, track_id, family, count(*) AS n FROM f GROUP BY ALL)
""", "share")  # fmt: skip
def kit_fractions(t: Tables) -> DataFrame:
    return interchange.kit_fractions(t.tracks.select(*TRACK, _E(180).alias("h"), F.expr("event_id * 7 % 256").alias("s"), F.expr("event_id * 11 % 256").alias("v")), TRACK)


@query("""
SELECT f.match_id, f.frame_id, count(t.track_id) AS n, coalesce(string_agg(CAST(t.track_id AS VARCHAR), ',' ORDER BY t.track_id), '') AS players, any_value(b.pitch_x) AS pitch_x, coalesce(any_value(b.visible), false) AS visible FROM (SELECT * FROM tr WHERE track_id = 0) f LEFT JOIN tr t ON t.match_id = f.match_id AND t.frame_id = f.frame_id AND t.event_type = 'error' LEFT JOIN ball b ON b.match_id = f.match_id AND b.frame_id = f.frame_id AND b.visible GROUP BY f.match_id, f.frame_id
""", "pitch_x")  # fmt: skip
def frame_grid(t: Tables) -> DataFrame:
    g = interchange.frame_grid(t.frames, t.tracks.where("event_type = 'error'"), t.ball.where("visible"), FRAME)
    return g.select(*FRAME, F.size("players").cast("long").alias("n"), F.array_join(F.transform("players", lambda p: p["track_id"].cast("string")), ",").alias("players"), "pitch_x", "visible")
