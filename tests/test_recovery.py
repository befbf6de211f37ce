"""Ball recovery, team centres, on-field surplus, participation and formats on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tracklake.operators import canonical, folds, greedy, interchange, reviews

BALL = "match_id long, frame_id long, timestamp_ms double, x double, y double, state string, confidence double"


def test_ball_is_filled_for_five_frames_and_wild_detections_go(spark):
    rows = []
    for f in range(40):
        gone = f in (10, 11, 12) or 20 <= f < 30
        wild = f == 35
        rows.append((1, f, f * 40.0, None if gone else 5000.0 if wild else 100.0 + 4 * f, None if gone else 50.0, "unknown" if gone else "detected", 0.0 if gone else 0.9))
    out = {r.frame_id: r for r in interchange.recover_ball(spark.createDataFrame(rows, BALL), ["match_id"]).collect()}
    assert [out[f].source for f in (10, 11, 12)] == ["kalman_predict"] * 3 and out[11].x == pytest.approx(144.0, abs=3.0)
    assert [out[f].source for f in range(20, 30)] == ["kalman_predict"] * 5 + ["missing"] * 5
    assert out[35].false_positive and out[35].x == pytest.approx(240.0, abs=6.0) and not any(out[f].false_positive for f in out if f != 35)
    c = interchange.ball_coverage(spark.createDataFrame(list(out.values())), ["match_id"]).first()
    assert (c.frames, c.false_positive_candidates, c.longest_missing_interval_ms) == (40, 1, 200.0) and c.interpolated_coverage == pytest.approx(9 / 40) and c.raw_detection_coverage == pytest.approx(26 / 40)


def test_two_centres_without_dark_kits(spark):
    rows = [(1, k, 0.9 if k < 5 else 0.2, 0.5 + 0.01 * k, 0.0) for k in range(10)] + [(1, 10, 0.0, 9.0, 0.9)]
    d = spark.createDataFrame(rows, "match_id long, track_id long, white double, colour double, dark_share double")
    out = {r.track_id: r.label for r in interchange.two_centres(d, ["match_id"], ["white", "colour"]).collect()}
    assert [out[k] for k in range(10)] == [0] * 5 + [1] * 5 and len(out) == 11


def test_surplus_and_participation(spark):
    rows = [(1, "a", k, 0.0, 1000.0, 30.0 - k) for k in range(13)] + [(1, "a", 20, 1500.0, 2000.0, 0.5)]
    out = {r.global_id: r.validated for r in greedy.demote_surplus(spark.createDataFrame(rows, "m long, team_id string, global_id long, start_ms double, end_ms double, visible_seconds double"), ["m", "team_id"]).collect()}
    assert [k for k, v in out.items() if not v] == [11, 12] and out[20]
    rows = [(1, f, "goalkeeper" if f == 0 else "player", 0.9, f < 50, f == 60) for f in range(62)]
    out = {r.frame_id: r.state for r in folds.participation(spark.createDataFrame(rows, "m long, frame_id long, role string, share double, on_pitch boolean, substituted boolean"), ["m"]).collect()}
    assert out[0] == out[29] == "active_goalkeeper" and out[40] == "active_player" and out[55] == "bench" and out[61] == "substituted_off"


def test_formats(spark):
    bad = spark.createDataFrame([(1, '{"predictions": [{"image_id": "1", "track_id": 2}]}')], "k long, j string")
    with pytest.raises(Exception, match="no confidence"):
        interchange.gs_predictions(bad, "j", ["k"]).collect()
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError, match="unknown"):
        interchange.selected_rows(rows, [2, 7], "id")
    with pytest.raises(ValueError, match="repeated"):
        interchange.selected_rows(rows, [2, 2], "id")
    assert interchange.load(spark, [{"a": 1}]).count() == 1 and interchange.load(spark, rows) is rows
    assert canonical.renamed(rows, {"id": "track_id", "gone": "x"}).columns == ["track_id"]


def test_sample_size_and_guards(spark):
    s = spark.createDataFrame([(1, 3, 1, "true"), (1, 3, 2, "true")], "m long, frame_id long, sample_order long, reviewed string")
    g = spark.createDataFrame([(1, 3, "true", "yes")], "m long, frame_id long, reviewed string, ball_visible string")
    assert reviews.sample_complete(s, g, ["m"], 2).first().reason == "duplicate_frames" and reviews.sample_complete(s, g, ["m"], 3).first().reason == "sample_size_mismatch:2!=3"
    assert reviews.first_unreviewed(s, g.where("frame_id > 9"), ["m"]).first().first_unreviewed == 0
    b = spark.createDataFrame([(1, False, False, True)], "frame_id long, accepted boolean, manual boolean, rejected boolean")
    assert reviews.save_guard(b, ["frame_id"]).first().guard == "need_accept" and reviews.save_guard(b.withColumn("manual", F.lit(True)), ["frame_id"]).first().guard == "ok"


def test_metric_out_of_range(spark):
    d = spark.createDataFrame([(1, 1.5)], "m long, q double")
    with pytest.raises(Exception, match="out of range"):
        canonical.mean_metric(d, ["m"], "q", 0.5).collect()
