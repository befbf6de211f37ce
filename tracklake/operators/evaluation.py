"""Against ground truth: boxes, identities, classes, tolerances, completeness and publishability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import box, distance, iou
from tracklake.operators.windows import band_join, first_by


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def match_boxes(truth: DataFrame, found: DataFrame, keys: list[str], truth_id: str, found_id: str, min_iou: float = 0.3) -> DataFrame:
    """Each true box with the found one of its frame that overlaps it most. Boxes: x1, y1, x2, y2."""
    t = truth.select(*keys, truth_id, *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    f = found.select(*keys, found_id, *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = t.join(f, keys).withColumn("iou", iou(box("t_"), box("f_"))).where(F.col("iou") >= min_iou)
    j = j.withColumn("centre_error", distance((F.col("t_x1") + F.col("t_x2")) / 2, (F.col("t_y1") + F.col("t_y2")) / 2, (F.col("f_x1") + F.col("f_x2")) / 2, (F.col("f_y1") + F.col("f_y2")) / 2))
    return first_by(j, [*keys, truth_id], F.desc("iou"), "centre_error", found_id).select(*keys, truth_id, found_id, "iou", "centre_error")


def detection_scores(truth: DataFrame, found: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1, mean overlap and median centre error."""
    t = truth.groupBy(*keys).agg(F.count("*").alias("truth"))
    f = found.groupBy(*keys).agg(F.count("*").alias("found"))
    m = matches.groupBy(*keys).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"), F.median("centre_error").alias("median_centre_error"))
    j = t.join(f, keys, "full").join(m, keys, "left").na.fill(0, ["truth", "found", "matched"])
    p, r = ratio(F.col("matched"), F.col("found")), ratio(F.col("matched"), F.col("truth"))
    return j.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)))


def id_switches(matches: DataFrame, keys: list[str], truth_id: str, found_id: str) -> DataFrame:
    """How often a player's found id changes, over the frames in which it has one."""
    w = Window.partitionBy(*keys, truth_id).orderBy("frame_id")
    d = matches.where(F.col(found_id).isNotNull()).withColumn("before", F.lag(found_id).over(w))
    return d.groupBy(*keys, truth_id).agg(F.count(F.when(F.col("before") != F.col(found_id), 1)).alias("switches"), F.countDistinct(found_id).alias("ids"))


def idf1(matches: DataFrame, truth_rows: DataFrame, found_rows: DataFrame, keys: list[str], truth_id: str, found_id: str) -> DataFrame:
    """Identity F1 over pairs of ids that are each other's most frequent match, the earlier one on a tie."""
    n = matches.groupBy(*keys, truth_id, found_id).agg(F.count("*").alias("n"), F.min("frame_id").alias("since"))
    a = first_by(n, [*keys, truth_id], F.desc("n"), "since", found_id).select(*keys, truth_id, found_id)
    b = first_by(n, [*keys, found_id], F.desc("n"), "since", truth_id).select(*keys, truth_id, found_id)
    good = matches.join(a.join(b, [*keys, truth_id, found_id]), [*keys, truth_id, found_id], "left_semi").groupBy(*keys).agg(F.count("*").alias("idtp"))
    t, f = truth_rows.groupBy(*keys).agg(F.count("*").alias("truth")), found_rows.groupBy(*keys).agg(F.count("*").alias("found"))
    j = t.join(f, keys).join(good, keys, "left").na.fill(0, ["idtp"])
    return j.withColumn("idf1", ratio(2.0 * F.col("idtp"), F.col("truth") + F.col("found")))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame, truth: str, predicted: str, unknown: int = 100) -> DataFrame:
    """One row: accuracy, accuracy over known ones, precision and recall of unknown, macro F1 over classes present."""
    n = F.col("n")
    one = matrix.agg(
        F.sum(n).alias("total"), F.sum(F.when(F.col(truth) == F.col(predicted), n)).alias("right"), F.sum(F.when(F.col(truth) != unknown, n)).alias("known"), F.sum(F.when((F.col(truth) == F.col(predicted)) & (F.col(truth) != unknown), n)).alias("known_right"),
        F.sum(F.when((F.col(truth) == unknown) & (F.col(predicted) == unknown), n)).alias("u_right"), F.sum(F.when(F.col(truth) == unknown, n)).alias("u_true"), F.sum(F.when(F.col(predicted) == unknown, n)).alias("u_pred"),
    )
    by_true = matrix.groupBy(F.col(truth).alias("c")).agg(F.sum(n).alias("t"), F.coalesce(F.sum(F.when(F.col(truth) == F.col(predicted), n)), F.lit(0)).alias("tp"))
    by_pred = matrix.groupBy(F.col(predicted).alias("c")).agg(F.sum(n).alias("p"))
    f1 = by_true.join(by_pred, "c", "left").agg(F.avg(2.0 * F.col("tp") / (F.col("t") + F.coalesce("p", F.lit(0)))).alias("macro_f1"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return one.crossJoin(f1).select(ratio(z("right"), z("total")).alias("accuracy"), ratio(z("known_right"), z("known")).alias("known_accuracy"), ratio(z("u_right"), z("u_pred")).alias("unknown_precision"), ratio(z("u_right"), z("u_true")).alias("unknown_recall"), "macro_f1")


def tolerance_scores(truth: DataFrame, found: DataFrame, keys: list[str], tolerance_ms: float) -> DataFrame:
    """Precision and recall of events (event_id, at_ms) that have a counterpart within the tolerance."""
    t, f = truth.select(*keys, F.col("event_id").alias("tid"), F.col("at_ms").alias("t_ms")), found.select(*keys, F.col("event_id").alias("fid"), F.col("at_ms").alias("f_ms"))
    near = band_join(t, f, keys, "t_ms", "f_ms", tolerance_ms, tolerance_ms)
    hit = near.groupBy(*keys).agg(F.countDistinct("tid").alias("truth_hit"), F.countDistinct("fid").alias("found_hit"))
    n = t.groupBy(*keys).agg(F.count("*").alias("truth")).join(f.groupBy(*keys).agg(F.count("*").alias("found")), keys, "full").join(hit, keys, "left").na.fill(0)
    return n.withColumn("precision", ratio(F.col("found_hit"), F.col("found"))).withColumn("recall", ratio(F.col("truth_hit"), F.col("truth")))


def identity_gt_complete(truth: DataFrame, min_frames: int = 50, min_players: int = 8) -> DataFrame:
    """One row: complete, reason."""
    a = truth.agg(F.countDistinct("frame_id").alias("frames"), F.countDistinct("gt_player_id").alias("players"), F.min(F.coalesce(F.col("reviewed"), F.lit(False))).alias("all_reviewed"))
    reason = F.when(F.col("frames") < min_frames, F.lit("too_few_frames")).when(F.col("players") < min_players, F.lit("too_few_players")).when(~F.coalesce("all_reviewed", F.lit(False)), F.lit("not_reviewed"))
    return a.select(reason.isNull().alias("complete"), reason.alias("reason"))


#: Least (or, where named so, greatest) values from which figures may be published.
THRESHOLDS = {
    "min_precision": 0.7, "min_recall": 0.6, "min_trajectory_coverage": 0.5, "min_idf1": 0.5, "max_validated_per_team": 11, "min_touch_precision": 0.7, "min_frame_coverage": 0.5, "min_measured_coverage": 0.25,
    "min_continuous_calibrated_seconds": 2.0, "max_reprojection_error": 8.0, "min_player_position_coverage": 0.4, "max_speed_spike_candidates": 0,
}


def _first(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that holds, or ok."""
    out = F.when(checks[0][0], checks[0][1])
    for bad, why in checks[1:]:
        out = out.when(bad, why)
    return out.otherwise("ok")


def publishability(facts: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """facts, one row per match, with nine flags and a reason for each area. What isn't known isn't published,
    but for measured coverage, continuity, reprojection error, position coverage and spikes, which only count if known.

    facts: ball_gt_complete, identity_gt_complete, touch_review_complete (booleans, null is false), ball_precision,
    ball_recall, trajectory_coverage, idf1, max_validated, touch_precision, calibration_coverage, measured_coverage,
    position_coverage, continuous_seconds, reprojection_error, spike_candidates.
    """
    t, c = THRESHOLDS | (thresholds or {}), F.col
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    under = lambda name, key: F.coalesce(c(name) < t[key], F.lit(True))
    below = lambda name, key: F.coalesce(c(name) < t[key], F.lit(False))
    above = lambda name, key: F.coalesce(c(name) > t[key], F.lit(False))
    no_ball, no_identity = (~yes("ball_gt_complete"), "GT_INCOMPLETE"), (~yes("identity_gt_complete"), "GT_INCOMPLETE")
    detected = under("ball_precision", "min_precision") | under("ball_recall", "min_recall")
    reasons = {
        "ball_detection": _first([no_ball, (detected, "below_threshold")]),
        "ball_tracking": _first([no_ball, (detected | under("trajectory_coverage", "min_trajectory_coverage"), "below_threshold")]),
        "identity": _first([no_identity, (above("max_validated", "max_validated_per_team"), "over_11"), (under("idf1", "min_idf1"), "below_idf1")]),
        "touch": _first([(~yes("touch_review_complete"), "REVIEW_INCOMPLETE"), (under("touch_precision", "min_touch_precision"), "below_threshold")]),
        "calibration": _first([
            (under("calibration_coverage", "min_frame_coverage"), "low_frame_coverage"), (below("measured_coverage", "min_measured_coverage"), "low_measured_coverage"),
            (below("continuous_seconds", "min_continuous_calibrated_seconds"), "short_continuous_calibration"), (above("reprojection_error", "max_reprojection_error"), "high_reprojection_error"),
            (below("position_coverage", "min_player_position_coverage"), "low_player_position_coverage"),
        ]),
    }
    out = facts.withColumns({f"{k}_reason": v for k, v in reasons.items()}).withColumns({f"{k}_publishable": c(f"{k}_reason") == "ok" for k in reasons})
    physical = _first([(~c("calibration_publishable"), "calibration_not_publishable"), (above("spike_candidates", "max_speed_spike_candidates"), "speed_spike_audit_failed"), (below("position_coverage", "min_player_position_coverage"), "low_player_position_coverage")])
    every = c("ball_detection_publishable") & c("identity_publishable") & c("calibration_publishable")
    out = out.withColumns({"physical_metrics_reason": physical, "tactical_metrics_publishable": c("calibration_publishable"), "action_stats_publishable": c("identity_publishable"), "overall_reason": _first([no_ball, no_identity, (~every, "gates_failed")])})
    out = out.withColumns({"physical_metrics_publishable": c("physical_metrics_reason") == "ok", "overall_publishable": c("overall_reason") == "ok"})
    return out.withColumns({f"{k}_reason": _first([(~c(f"{k}_publishable"), "gated")]) for k in ("tactical_metrics", "action_stats")})


def box_conflicts(boxes: DataFrame, keys: list[str], min_iou: float, same_class: bool) -> DataFrame:
    """Pairs of boxes of a frame that overlap too much, within or across classes."""
    cols = ["box_id", "class_name", "x1", "y1", "x2", "y2"]
    a = boxes.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = boxes.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    same = F.col("a_class_name") == F.col("b_class_name")
    j = a.join(b, keys).where((F.col("a_box_id") < F.col("b_box_id")) & (same if same_class else ~same)).withColumn("iou", iou(box("a_"), box("b_")))
    return j.where(F.col("iou") >= min_iou).select(*keys, "a_box_id", "b_box_id", "iou")


def hash_split(ids: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """ids with `validation`: exactly the given share, by order of a seeded hash. Ids are counted by the first 16 bits of
    the hash; bins below the one in which the share ends are taken whole, and only that bin is sorted."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    d = ids.withColumn("hash_key", key).withColumn("bin", F.substring("hash_key", 1, 4))
    bins = sorted((r["bin"], r["count"]) for r in d.groupBy("bin").count().collect())  # 65536 rows at most
    wanted = round(sum(n for _, n in bins) * share)
    last, before = "", 0
    for name, n in bins:
        if before + n > wanted:
            last = name
            break
        before += n
    else:
        last = "g"  # after all bins
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("hash_key", id_col))
    edge = d.where(F.col("bin") == last).withColumn("validation", rank <= wanted - before)
    rest = d.where(F.col("bin") != last).withColumn("validation", F.col("bin") < last)
    return rest.unionByName(edge).drop("hash_key", "bin")


