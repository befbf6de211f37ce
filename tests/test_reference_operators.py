"""Operators against small hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.functions import labels as L
from tracklake.functions import vectors as V
from tracklake.operators import actions, evaluation, events, folds, identity, multicamera, physical, possession, team, windows

SAMPLE = "track_id long, timestamp_ms double, x_field double, y_field double, confidence double, calibration_valid boolean, shot_type string, quality_ok boolean"


def runner(fps, speed, seconds=6.0, track=1):
    return [(track, k * 1000.0 / fps, speed * k / fps, 30.0, 0.9, True, "wide", True) for k in range(int(fps * seconds) + 1)]


@pytest.mark.parametrize("fps", [24, 25, 30])
def test_distance_and_speed_do_not_depend_on_fps(spark, fps):
    r = physical.player_metrics(spark.createDataFrame(runner(fps, 5.0), SAMPLE), ["track_id"]).first()
    assert r.valid and math.isclose(r.total_distance_m, 30.0, abs_tol=1e-6) and math.isclose(r.max_speed_kmh, 18.0, abs_tol=1e-6) and r.sprint_count == 0


def test_teleport_is_dropped_and_gap_reanchors(spark):
    rows = runner(25, 5.0)
    rows[40] = (*rows[40][:2], 90.0, *rows[40][3:])
    r = physical.player_metrics(spark.createDataFrame(rows, SAMPLE), ["track_id"]).first()
    assert math.isclose(r.total_distance_m, 30.0, abs_tol=1e-6) and r.used_count == len(rows) - 1
    late = [(1, t + 5000.0, x + 50, *rest) for _, t, x, *rest in runner(25, 5.0, 2.0)]
    r = physical.player_metrics(spark.createDataFrame(runner(25, 5.0, 2.0) + late, SAMPLE), ["track_id"]).first()
    assert math.isclose(r.total_distance_m, 20.0, abs_tol=1e-6)


def test_sprint_and_invalid_tracks(spark):
    rows = runner(25, 26 / 3.6, 4.0) + [(2, 0.0, 1.0, 1.0, 0.9, True, "wide", True)] + [(3, k * 40.0, None, 1.0, 0.9, True, "wide", True) for k in range(9)]
    out = {r.track_id: r for r in physical.player_metrics(spark.createDataFrame(rows, SAMPLE), ["track_id"]).collect()}
    assert out[1].sprint_count == 1 and out[2].invalid_reason == "insufficient_usable_samples"
    assert out[2].total_distance_m is None and out[3].total_distance_m is None and not out[3].valid


def machine_states(frames):
    m = possession.PossessionMachine()
    return [m.step(*f)[0] for f in frames]


def test_possession_machine():
    near = [(0.5, 7, "team_0")]
    held = [(k * 100.0, 1.0, 1.0, True, near) for k in range(2)]
    gone = [(100.0 + k * 100.0, None, None, True, []) for k in range(1, 25)]
    states = machine_states(held + gone)
    assert states[:2] == ["controlled_team_0"] * 2 and states[5] == "controlled_team_0" and states[-1] == "unknown"
    rival = [(0.5, 7, "team_0"), (0.6, 9, "team_1")]
    assert machine_states([(0.0, 1.0, 1.0, True, rival)]) == ["contested"]
    other = [(0.3, 9, "team_1")]
    seq = [(0.0, 1.0, 1.0, True, near)] + [(40.0 * k, 1.0, 1.0, True, other) for k in range(1, 4)]
    assert machine_states(seq) == ["controlled_team_0", "controlled_team_0", "controlled_team_0", "controlled_team_1"]
    assert machine_states([(0.0, 1.0, 1.0, False, near)]) == ["out_of_play"]
    assert machine_states([(0.0, 1.0, 1.0, True, []), (100.0, 2.0, 1.0, True, [])]) == ["loose_ball", "pass_in_flight"]


def test_possession_timeline(spark):
    frames = spark.createDataFrame([(1, k, k * 40.0, 10.0 if k < 5 else None, 10.0 if k < 5 else None, True) for k in range(8)], "match_id long, frame_id long, timestamp_ms double, ball_x double, ball_y double, in_play boolean")
    players = spark.createDataFrame([(1, k, 3, "team_0", 10.5, 10.0) for k in range(8)], "match_id long, frame_id long, track_id long, team_id string, x_field double, y_field double")
    out = possession.possession_timeline(possession.frame_candidates(frames, players, ["match_id"]), ["match_id"]).orderBy("frame_id").collect()
    assert [r.possession_state for r in out] == ["controlled_team_0"] * 8 and out[7].transition_reason == "ball_briefly_missing"


TOUCH = "match_id long, touch_id string, frame_id long, timestamp_ms double, track_id long, team_id string, confidence double, controlled_touch boolean, deflection boolean, pitch_x double, pitch_y double"


def test_passes(spark):
    rows = [(1, "a", 0, 0.0, 1, "team_0", 0.9, True, False, 20.0, 30.0), (1, "b", 25, 1000.0, 2, "team_0", 0.8, True, False, 50.0, 30.0), (1, "c", 50, 2000.0, 12, "team_1", 0.7, True, True, 55.0, 30.0), (1, "d", 300, 12000.0, 13, "team_1", 0.9, True, False, 60.0, 30.0), (1, "e", 310, 12400.0, 14, "unknown", 0.9, True, False, 60.0, 30.0)]
    out = actions.infer_passes(spark.createDataFrame(rows, TOUCH), ["match_id"]).orderBy("pass_id").collect()
    assert [(r.pass_id, r.successful, r.long_pass, r.progressive_pass) for r in out] == [("pass-00001", True, True, True), ("pass-00002", False, False, False)]
    assert (out[0].start_zone, out[0].end_zone, out[0].status) == ("zone_1", "zone_2", "confirmed") and out[1].confidence == 0.5
    lost = actions.turnovers(actions.infer_passes(spark.createDataFrame(rows, TOUCH), ["match_id"]), ["match_id"]).orderBy("action_id").collect()
    assert [(r.action_type, r.track_id) for r in lost] == [("interception", 12), ("dispossession", 2)]


def test_touch_sessions(spark):
    rows = [(1, 5, f, f * 100.0, c) for f, c in ((0, 0.5), (2, 0.9), (5, 0.6), (9, 0.7))]
    out = actions.touch_sessions(spark.createDataFrame(rows, "match_id long, track_id long, frame_id long, timestamp_ms double, confidence double"), ["match_id"]).orderBy("start_frame").collect()
    assert [(r.frame_id, r.start_frame, r.end_frame, r.raw_touch_count) for r in out] == [(2, 0, 5, 3), (9, 9, 9, 1)]


def test_evidence(spark):
    rows = [(1, "a", 0.9, False), (1, "a", 0.8, False), (2, "a", 0.9, False), (2, "b", 0.9, False), (2, "c", 0.9, False), (3, "a", 0.9, False), (3, "b", -0.3, False), (4, "a", 0.9, True)]
    out = {r.signal_id: r for r in events.evidence_scores(spark.createDataFrame(rows, "signal_id long, source string, score double, from_replay boolean"), ["signal_id"]).collect()}
    assert out[1].score == 0.5 and out[1].status == "candidate_review_required" and not out[1].corroborated
    assert out[2].score == 1.0 and out[2].status == "auto_confirmed"
    assert math.isclose(out[3].score, 0.2) and out[3].status == "unresolved" and 4 not in out


def test_clips(spark):
    e = spark.createDataFrame([("a", "goal", 10000.0, None, None), ("b", "goal", 12000.0, None, None), ("c", "substitution", 50000.0, 40000.0, 60000.0)], "event_id string, event_type string, timestamp_ms double, interval_start_ms double, interval_end_ms double").withColumn("match_id", F.lit(1))
    w = events.clip_windows(e)
    merged = {r.event_ids: (r.start_ms, r.end_ms) for r in events.merge_clips(w, ["match_id"]).collect()}
    assert merged == {"a+b": (2000.0, 17000.0), "c": (32000.0, 65000.0)}
    replays = spark.createDataFrame([(1, 5000.0, 6000.0), (1, 14000.0, 99000.0)], "match_id int, start_ms double, end_ms double")
    cut = events.clips_less_replays(w.select("match_id", "event_id", "start_ms", "end_ms"), replays, ["match_id"]).orderBy("event_id", "start_ms").collect()
    assert [(r.event_id, r.start_ms, r.end_ms) for r in cut] == [("a", 2000.0, 5000.0), ("a", 6000.0, 14000.0), ("b", 4000.0, 5000.0), ("b", 6000.0, 14000.0)]


def test_substitutions(spark):
    rows = [(1, "exit", 1000.0, 3, "team_0", 0.9, False, False), (1, "entry", 5000.0, 30, "team_0", 0.9, True, False), (1, "entry", 2000.0, 31, "team_1", 0.9, True, False), (1, "exit", 4000.0, 4, "team_0", 0.9, False, False)]
    out = events.substitutions(spark.createDataFrame(rows, "match_id long, kind string, timestamp_ms double, track_id long, team_id string, confidence double, came_from_bench boolean, from_replay boolean"), ["match_id"]).orderBy("player_off_track_id").collect()
    assert (out[0].player_on_track_id, out[0].status) == (30, "auto_confirmed") and (out[1].player_on_track_id, out[1].status, out[1].score) == (None, "unresolved", 0.4)


def test_replay_suppression(spark):
    rows = [("a", "goal", 0.0, "team_0", False), ("b", "goal", 2000.0, "team_0", False), ("c", "goal", 9000.0, "team_1", True), ("d", "goal", 40000.0, "team_1", True), ("e", "shot", 1000.0, "team_0", False)]
    out = events.suppress_replays(spark.createDataFrame([(1, *r) for r in rows], "match_id long, event_id string, event_type string, timestamp_ms double, team_id string, in_replay boolean"), ["match_id"])
    assert {r.event_id for r in out.where("kept").collect()} == {"a", "d", "e"}


def test_asof_and_band(spark):
    left = spark.createDataFrame([(1, f) for f in range(10)], "k long, f long")
    right = spark.createDataFrame([(1, 2, "x"), (1, 6, "y")], "k long, f long, v string")
    out = [r.v_asof for r in windows.asof_nearest(left, right, ["k"], "f", ["v"], 2).orderBy("f").collect()]
    assert out == ["x", "x", "x", "x", "x", "y", "y", "y", "y", None]
    a = spark.createDataFrame([(1, k * 0.37) for k in range(60)], "k long, t double")
    b = spark.createDataFrame([(1, k * 0.53) for k in range(60)], "k long, u double")
    got = {(r.t, r.u) for r in windows.band_join(a, b, ["k"], "t", "u", 0.5, 0.25).collect()}
    assert got == {(x * 0.37, y * 0.53) for x in range(60) for y in range(60) if x * 0.37 - 0.5 <= y * 0.53 <= x * 0.37 + 0.25}


def test_geometry(spark):
    one = spark.range(1)
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    m = G.matrix(F.lit("[[2,0,1],[0,3,2],[0,0.01,1]]"))
    x, y = G.project(m, F.lit(10.0), F.lit(10.0))
    r = one.select(G.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("iou"), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("none"), G.visible_fraction(box(-5, 0, 5, 10), 100, 100).alias("seen"), x.alias("x"), y.alias("y"), G.round_trip_error(m, G.inverse(m), F.lit(7.0), F.lit(3.0)).alias("e"), G.to_pitch(m, F.lit(90.0), F.lit(1.0), F.lit(True)).alias("out"), G.corner_jump(m, m).alias("jump"), G.foot_confidence(box(-5, 0, 5, 200), 100, 100).alias("foot")).first()
    assert math.isclose(r.iou, 1 / 3) and r.none == 0 and r.seen == 0.5 and math.isclose(r.x, 21 / 1.1) and math.isclose(r.y, 32 / 1.1) and r.e < 1e-6 and r.out is None and r.jump == 0 and r.foot == 0


def test_labels(spark):
    rows = [("true", True), ("0", False), ("", False), ("maybe", None), (None, None), ("YES", True)]
    assert [r.b for r in spark.createDataFrame(rows, "v string, w boolean").select(L.tri_state(F.col("v")).alias("b")).collect()] == [w for _, w in rows]
    r = spark.range(1).select(L.srt_timestamp(F.lit(3661.5)).alias("s"), L.zone_third(F.lit(90.0), F.lit("team_1")).alias("z"), L.in_own_penalty(F.lit(100.0), F.lit(34.0), F.lit("team_1")).alias("p"), L.jersey_text(F.lit(" 7.0")).alias("j"), L.jersey_text(F.lit("x7")).alias("n"), L.percent(F.lit(1), F.lit(3)).alias("q"), L.percent(F.lit(1), F.lit(0)).alias("q0"), L.hue_distance(F.lit(175), F.lit(5)).alias("h")).first()
    assert (r.s, r.z, r.p, r.j, r.n, r.q, r.q0, r.h) == ("01:01:01,500", "zone_1", True, "7", None, 33.3, None, 10)


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    out = [r[0] for r in d.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(out[0], math.sqrt(0.5)) and out[1:] == [None, None]


def _resolved(spark, rows):
    """rows: track_id, seconds, start, end, x, team, role, embedding."""
    at = lambda x: None if x is None else {"x_field": x, "y_field": 10.0}
    data = [(1, k, s, a, b, at(x), at(x), team, role, e) for k, s, a, b, x, team, role, e in rows]
    d = spark.createDataFrame(data, "match_id long, track_id long, visible_seconds double, start_ms double, end_ms double, first_xy struct<x_field:double,y_field:double>, last_xy struct<x_field:double,y_field:double>, team_id string, role string, embedding array<double>")
    return {r.track_id: r for r in identity.resolve(d, ["match_id"]).collect()}


def test_identity_resolution(spark):
    e, o = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    out = _resolved(spark, [(1, 4.0, 0.0, 4000.0, 10.0, "team_0", "outfield", e), (2, 2.4, 1000.0, 3000.0, 10.0, "team_0", "outfield", o), (3, 2.0, 4300.0, 6000.0, 10.0, "team_0", "outfield", e), (4, 1.6, 7000.0, 8000.0, 10.0, "team_1", "outfield", e)])
    assert out[1].global_id != out[2].global_id and out[3].global_id == out[1].global_id and out[3].reason == "strong" and out[4].global_id not in {out[1].global_id, out[2].global_id}
    # two seen at once with equal embeddings stay apart; a goalkeeper joins no outfield player
    out = _resolved(spark, [(1, 4.0, 0.0, 4000.0, 10.0, "team_0", "outfield", e), (2, 3.0, 0.0, 4000.0, 60.0, "team_0", "outfield", e), (3, 2.0, 4300.0, 6000.0, 10.0, "team_0", "goalkeeper", e)])
    assert len({r.global_id for r in out.values()}) == 3 and out[3].rejected == 2
    # without an embedding, or without a team, by place
    out = _resolved(spark, [(1, 4.0, 0.0, 4000.0, 10.0, "team_0", "outfield", e), (2, 2.0, 4300.0, 6000.0, 12.0, "team_0", "outfield", None), (3, 1.0, 6200.0, 7000.0, 90.0, "team_0", "outfield", None), (4, 0.9, 8000.0, 9000.0, 12.0, None, "outfield", e)])
    assert out[2].reason == "short_gap_continuity" and out[3].decision == "new" and out[4].reason == "team_unknown"


def test_hard_negatives_raise_thresholds():
    rows = [{"unit": identity._unit([1.0, 0.1 * k]), "team_id": "a", "start_ms": 0.0, "end_ms": 1.0} for k in range(5)]
    merge, strong = identity.thresholds(rows, identity.ResolveRules())
    assert merge == 0.90 and strong > merge
    assert identity.thresholds(rows[:1], identity.ResolveRules()) == (0.42, 0.55)


def test_constrained_clusters(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.8), (1, 4, 5, 0.9)], "m long, a long, b long, score double")
    never = spark.createDataFrame([(1, 1, 3)], "m long, a long, b long")
    out = {r.node: r.cluster for r in identity.constrained_clusters(edges, ["m"], never).collect()}
    assert out[1] == out[2] != out[3] and out[4] == out[5]


def test_audit_replay(spark):
    rows = [(1, 1, "merge", 2, 1, None), (1, 2, "merge", 3, 1, None), (1, 3, "undo", None, None, 1)]
    out = {r.source_id: r.global_id for r in identity.replay_audit(spark.createDataFrame(rows, "m long, sequence long, kind string, source_id long, target_id long, undo_of long"), ["m"]).collect()}
    assert out == {1: 1, 2: 2, 3: 1}


def test_ball_machine():
    m = folds.BallMachine()
    see = lambda k, x, c=0.9: m.step(k, k * 40.0, [{"x": x, "y": 0.0, "confidence": c, "size": 10.0}], False)
    assert [see(k, k * 4.0)[2] for k in range(5)] == ["detected"] * 5
    p = [m.step(k, k * 40.0, [], False) for k in range(5, 30)]
    assert p[0][2] == "occluded_short" and math.isclose(p[0][0], 20.0) and p[5][2] == "predicted" and p[-1][2] == "unknown" and p[-1][0] is None
    assert see(40, 500.0)[2] == "detected"
    assert m.step(41, 41 * 40.0, [{"x": 5000.0, "y": 0.0, "confidence": 0.9, "size": 10.0}], False)[2] == "occluded_short"


def test_team_lock_and_shape(spark):
    rows = [(1, f, "team_0" if f < 3 else "team_1", 0.9 if f < 3 else 0.2) for f in range(10)]
    out = team.team_lock(spark.createDataFrame(rows, "track_id long, frame_id long, team_id string, team_confidence double"), ["track_id"]).select("locked_team").distinct().collect()
    assert [r[0] for r in out] == ["team_0"]
    ps = [(0, k, "team_0", float(k), 0.0, 0.9, True) for k in range(4)] + [(1, k, "team_0", float(k), 0.0, 0.9, True) for k in range(3)]
    s = {r.frame_id: r for r in team.team_shape(spark.createDataFrame(ps, "frame_id long, track_id long, team_id string, x_field double, y_field double, team_confidence double, calibration_valid boolean"), ["frame_id", "team_id"]).collect()}
    assert s[0].depth_m == 3.0 and math.isclose(s[0].mean_pair_distance_m, 10 / 6) and not s[1].valid and s[1].depth_m is None


def test_mot_scenarios(spark):
    """Two players over ten frames: perfect, identities swapped half-way, a false positive, a miss."""
    truth = [(1, f, p, 10.0 + 50 * p, 0.0, 20.0 + 50 * p, 20.0) for f in range(10) for p in (1, 2)]
    cols = "match_id long, frame_id long, {} long, x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame(truth, cols.format("gt_id"))

    def scores(found):
        f = spark.createDataFrame(found, cols.format("id"))
        m = evaluation.match_boxes(t, f, ["match_id", "frame_id"], "gt_id", "id")
        return evaluation.idf1(m, t, f, ["match_id"], "gt_id", "id").first().idf1, evaluation.detection_scores(t, f, m, ["match_id"]).first()

    assert scores(truth)[0] == 1.0
    swapped = [(m, f, (3 - p) if f >= 5 else p, *b) for m, f, p, *b in truth]
    assert scores(swapped)[0] == 0.5
    extra = truth + [(1, f, 9, 500.0, 0.0, 510.0, 20.0) for f in range(10)]
    assert math.isclose(scores(extra)[0], 0.8)
    missed = [r for r in truth if not (r[2] == 2 and r[1] % 2)]
    i, d = scores(missed)
    assert math.isclose(i, 30 / 35) and d.precision == 1.0 and d.recall == 0.75


def test_multicamera(spark):
    cols = "m long, obs_id long, camera_id string, local_track_id long, t double, x double, y double, team_id string, team_confidence double, jersey_number int, jersey_confidence double, role string, detection_confidence double"
    rows = [(1, 1, "a", 1, 0.0, 10.0, 10.0, "team_0", 0.9, 7, 0.9, "player", 0.8), (1, 2, "a", 2, 0.05, 10.5, 10.0, "team_0", 0.9, 7, 0.9, "unknown", 0.4), (1, 3, "b", 1, 0.02, 60.0, 10.0, "team_1", 0.6, 7, 0.9, "goalkeeper", 0.4)]
    o = spark.createDataFrame(rows, cols)
    assert [(r.kept_id, r.suppressed_id) for r in multicamera.intra_camera_duplicates(o, ["m"]).collect()] == [(1, 2)]
    assert multicamera.suppress_duplicates(o, ["m"]).count() == 2 and multicamera.impossible_duplicates(o, ["m"]).count() == 0
    f = multicamera.fuse(o, ["m"]).first()
    assert f.team_id == "team_0" and f.conflicts == ["team_conflict", "role_conflict"] and math.isclose(f.x, (8 + 4.2 + 24) / 1.6) and f.source_cameras == ["a", "b"]
    d = multicamera.drift_fit(spark.createDataFrame([("a", float(k), 1.0 + 0.01 * k, 0.9) for k in range(5)], "camera_id string, measured_at_seconds double, offset_seconds double, confidence double"), ["camera_id"]).first()
    assert math.isclose(d.drift_rate, 0.01) and math.isclose(d.base_offset_seconds, 1.02) and d.residual_seconds < 1e-9


def test_calibration_folds(spark):
    rows = [(1, k, "wide", False, k in (0, 1), 0.9, 0.0) for k in range(60)]
    out = [r.state for r in folds.calibration_states(spark.createDataFrame(rows, "m long, frame_id long, shot_type string, scene_cut boolean, measured boolean, confidence double, corner_jump double"), ["m"]).orderBy("frame_id").collect()]
    assert out[:3] == ["MEASURED", "MEASURED", "PROPAGATED"] and out[20] == "FROZEN" and out[-1] == "INVALID"
    rows = [(1, k, k == 6, k in (2, 9), float(k), 0.0) for k in range(12)]
    out = [r.source for r in folds.propagate_calibration(spark.createDataFrame(rows, "m long, frame_id long, scene_cut boolean, valid boolean, px double, py double"), ["m"]).orderBy("frame_id").collect()]
    assert out[0] == "propagated" and out[2] == "measured" and out[5] == "propagated" and out[6] == "propagated"


def _naive(values):
    total = 0.0
    for v in values:  # sum() makes up for lost digits
        total += v
    return total


def test_votes_do_not_depend_on_where_rows_lie(spark):
    """Sums that are equal but for their last digits decide by the order of frames and tracks, not of partitions."""
    from tracklake.operators import canonical

    weights = [0.1, 0.2, 0.3, 0.7, 0.9, 0.11, 0.17, 0.23] * 8
    assert _naive(weights) != _naive(weights[::-1])
    rows = [(1, f, 0, "team_1", w, True) for f, w in enumerate(weights)] + [(1, f, 1, "team_0", w, True) for f, w in enumerate(weights[::-1])]
    want = "team_1" if _naive(weights) > _naive(weights[::-1]) else "team_0"
    cols = "match_id long, frame_id long, track_id long, team_id string, team_confidence double, valid boolean"
    displays = spark.createDataFrame([(1, 0, 5), (1, 1, 5)], "match_id long, track_id long, display_id long")
    got = []
    for step in (1, 3, 7, 11):
        order = sorted(range(len(rows)), key=lambda k: (k * step) % 127)
        ids = spark.createDataFrame([rows[k] for k in order], cols).coalesce(1)
        got += [r.team_id for r in canonical.display_teams(ids, displays, ["match_id"]).select("team_id").distinct().collect()]
    assert got == [want] * 4


def test_nearest_team_does_not_depend_on_where_rows_lie(spark):
    """Two teams of the same places, of which one is nearer by the last digit of its mean; equal means give the first team."""
    places = [0.1, 0.2, 0.3, 0.7, 0.9, 0.11, 0.17, 0.23] * 8
    far = {"team_0": _naive(places) / 64, "team_1": _naive(places[::-1]) / 64}
    assert far["team_0"] != far["team_1"]
    cols = "frame_id long, track_id long, team_id string, x_field double, y_field double"
    asked = spark.createDataFrame([(0, 99, 0.0, 0.0), (1, 99, 0.0, 0.0)], "frame_id long, track_id long, x_field double, y_field double")
    rows = [(0, t, s, x, 0.0) for s, xs in (("team_0", places), ("team_1", places[::-1])) for t, x in enumerate(xs)] + [(1, t, s, x, 0.0) for s in ("team_0", "team_1") for t, x in enumerate(places)]
    for step in (1, 3, 5, 11):
        players = spark.createDataFrame(sorted(rows, key=lambda r: (r[1] * step) % 67), cols).coalesce(1)
        got = {r.frame_id: r.resolved_team for r in team.nearest_team(asked, players, ["frame_id"]).collect()}
        assert got == {0: min(far, key=far.get), 1: "team_0"}, step


def _met_tracks(spark):
    """Two teams with copies, vectors that are NULL, zero, short or hold a NULL, and a track that meets none."""
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in np.round(rng.normal(size=6), 2)] for _ in range(30)]
    rows = [(k % 2, k, float(s := int(rng.integers(0, 60)) * 1000), s + float(rng.integers(500, 25000)), vectors[int(rng.integers(0, 30))]) for k in range(160)]
    rows += [(0, 900, 0.0, 50000.0, None), (0, 901, 0.0, 50000.0, [0.0] * 6), (0, 902, 0.0, 50000.0, [1.0, 2.0]), (0, 903, 0.0, 50000.0, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1, 904, 1e7, 1e7 + 1, vectors[0])]
    return spark.createDataFrame(rows, "team int, track_id long, start_ms double, end_ms double, embedding array<double>")


def test_hard_negatives_by_blocks(spark, monkeypatch):
    tracks = _met_tracks(spark)
    sims = identity.overlapping_pairs(tracks, ["team"]).select("team", V.cosine(F.col("l.embedding"), F.col("r.embedding")).alias("sim")).collect()
    for block in (4096, 7):
        monkeypatch.setattr(identity, "BLOCK", block)
        got = {r.team: r for r in identity.hard_negative_thresholds(tracks, ["team"]).collect()}
        assert set(got) == {0, 1}
        for side, r in got.items():
            x = [s.sim for s in sims if s.team == side and s.sim is not None]
            assert r.pairs == len(x) and np.allclose([r.p50, r.p75, r.p90], np.percentile(x, [50, 75, 90]), atol=1e-12, rtol=0)
    blank = tracks.where("track_id in (900, 901)")
    assert [tuple(r) for r in identity.hard_negative_thresholds(blank, ["team"]).collect()] == [(0, 0, None, None, None)]


def test_clusters_by_blocks(spark, monkeypatch):
    """As by rows of all pairs, whatever the blocks."""
    tracks = _met_tracks(spark)
    ids = lambda d: d.select("team", F.col("l.track_id").alias("a"), F.col("r.track_id").alias("b"), V.cosine_or_zero(F.col("l.embedding"), F.col("r.embedding")).alias("score"))
    near, never = (ids(identity.overlapping_pairs(tracks, ["team"], tolerance_ms=x)) for x in (4000.0, 0.0))
    want = sorted(map(tuple, identity.constrained_clusters(near, ["team"], never, min_score=0.1).collect()))
    assert len({(t, c) for t, _, c in want}) < len(want)
    for block in (4096, 7):
        monkeypatch.setattr(identity, "BLOCK", block)
        assert sorted(map(tuple, identity.clusters_apart(tracks, ["team"], 4000.0, min_score=0.1).collect())) == want
