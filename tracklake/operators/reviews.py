"""Review samples, ground-truth rows and what is complete: small tables next to large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.labels import tri_state
from tracklake.operators.windows import first_by


def reviewed(column: str = "reviewed") -> Column:
    return F.coalesce(tri_state(F.col(column)), F.lit(False))


def eligible_truth(truth: DataFrame, sample: DataFrame, frame: list[str]) -> DataFrame:
    """Boxes on frames of the sample that are reviewed on both sides, without empty placeholders."""
    return truth.where(reviewed() & F.col("x1").isNotNull()).join(sample.where(reviewed()).select(*frame), frame, "left_semi")


def outside_sample(truth: DataFrame, sample: DataFrame, frame: list[str]) -> DataFrame:
    """Frames with ground truth that the sample doesn't have: none, if it only contains sample frames."""
    return truth.select(*frame).distinct().join(sample.select(*frame), frame, "left_anti")


def completion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, reviewed rows and their share."""
    a = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(F.when(reviewed(), 1)).alias("reviewed_rows"))
    return a.withColumn("completion_rate", F.col("reviewed_rows") / F.col("rows"))


def ball_truth_complete(truth: DataFrame, keys: list[str], min_frames: int = 150) -> DataFrame:
    """Whether there are enough rows, all reviewed and with visibility known; else the first reason."""
    a = truth.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(reviewed(), 1)).alias("r"), F.count(F.when(reviewed() & tri_state(F.col("ball_visible")).isNull(), 1)).alias("u"))
    why = F.when(F.col("n") < min_frames, F.concat(F.lit("too_few_frames:"), F.col("n"), F.lit(f"<{min_frames}"))).when(F.col("r") < F.col("n"), F.concat(F.lit("unreviewed:"), F.col("n") - F.col("r"))).when(F.col("u") > 0, "ball_visible_incomplete").otherwise("complete")
    return a.select(*keys, (why == "complete").alias("complete"), why.alias("reason"))


def sample_complete(sample: DataFrame, truth: DataFrame, keys: list[str], size: int = 50) -> DataFrame:
    """Whether a sample has its size, no frame twice, and all of its frames reviewed with visibility known."""
    t = truth.groupBy(*keys, "frame_id").agg(F.max(reviewed()).alias("r"), F.max(reviewed() & tri_state(F.col("ball_visible")).isNull()).alias("u"))
    j = sample.select(*keys, "frame_id").join(t, [*keys, "frame_id"], "left")
    a = j.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("frame_id").alias("d"), F.count(F.when(F.col("r"), 1)).alias("r"), F.count(F.when(F.col("u"), 1)).alias("u"))
    why = (
        F.when(F.col("n") != size, F.concat(F.lit("sample_size_mismatch:"), F.col("n"), F.lit(f"!={size}"))).when(F.col("d") != size, "duplicate_frames")
        .when(F.col("r") < size, F.concat(F.lit("unreviewed:"), F.lit(size) - F.col("r"))).when(F.col("u") > 0, "ball_visible_incomplete").otherwise("complete")
    )
    return a.select(*keys, F.col("r").alias("sample_reviewed"), (why == "complete").alias("complete"), why.alias("reason"))


def touch_review_complete(reviews: DataFrame, keys: list[str]) -> DataFrame:
    a = reviews.groupBy(*keys).agg(F.count(F.when(~reviewed(), 1)).alias("open"))
    why = F.when(F.col("open") > 0, F.concat(F.lit("unreviewed:"), F.col("open"))).otherwise("complete")
    return a.select(*keys, (F.col("open") == 0).alias("complete"), why.alias("reason"))


def first_unreviewed(sample: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Place, from 0 in the sample's order, of its first frame that isn't reviewed; 0 if all are."""
    d = sample.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("sample_order")) - 1)
    t = truth.groupBy(*keys, "frame_id").agg(F.max(reviewed()).alias("done"))
    return d.join(t, [*keys, "frame_id"], "left").groupBy(*keys).agg(F.coalesce(F.min(F.when(~F.coalesce("done", F.lit(False)), F.col("place"))), F.lit(0)).cast("long").alias("first_unreviewed"))


def neighbours(frames: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """frames with the next sample frame in either direction."""
    every = frames.select(*keys, "frame_id", F.lit(False).alias("in_sample")).unionByName(sample.select(*keys, "frame_id", F.lit(True).alias("in_sample")))
    w = Window.partitionBy(*keys).orderBy("frame_id")
    own = F.when(F.col("in_sample"), F.col("frame_id"))
    before = F.max(own).over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.min(own).over(w.rangeBetween(1, Window.unboundedFollowing))
    return every.withColumns({"previous_frame": before, "next_frame": after}).where(~F.col("in_sample")).drop("in_sample")


def balanced_sample(frames: DataFrame, match: list[str], quotas: dict[str, int], size: int, seed: int) -> DataFrame:
    """Up to `size` frames: first each reason's quota, then the rest of all, by a seeded hash; a frame that several
    reasons have counts for the first of them in order of quotas. Numbered in order of frames."""
    rank = F.create_map(*[x for k, r in enumerate(quotas) for x in (F.lit(r), F.lit(k))])[F.col("reason")]
    one = first_by(frames.withColumn("reason_rank", rank), [*match, "frame_id"], F.asc_nulls_last("reason_rank"), "reason")
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("frame_id").cast("string")), 256)
    quota = F.coalesce(F.create_map(*[x for r, q in quotas.items() for x in (F.lit(r), F.lit(q))])[F.col("reason")], F.lit(0))
    d = one.withColumn("hash_key", key).withColumn("n", F.row_number().over(Window.partitionBy(*match, "reason").orderBy("hash_key", "frame_id")))
    d = d.withColumn("later", (F.col("n") > quota).cast("int"))
    d = first_by(d, match, "later", "hash_key", "frame_id", rows=size)
    return d.select(*match, "frame_id", "reason", F.row_number().over(Window.partitionBy(*match).orderBy("frame_id")).cast("long").alias("sample_order"))


def truth_rows(boxes: DataFrame, frame: list[str]) -> DataFrame:
    """Ground-truth rows of a frame's accepted and manual boxes that aren't rejected, once for each class and place to a
    tenth of a pixel."""
    ok = boxes.where(~F.col("rejected") & (F.col("accepted") | F.col("manual")))
    near = [F.round(c, 1) for c in ("x1", "y1", "x2", "y2")]
    d = ok.withColumns({f"k{k}": c for k, c in enumerate(near)})
    d = first_by(d, [*frame, "class_name", "k0", "k1", "k2", "k3"], "proposal_id")
    name = F.when(F.col("manual"), F.concat(F.lit("manual_"), "proposal_id")).otherwise(F.col("proposal_id").cast("string"))
    return d.select(*frame, name.alias("gt_id"), "class_name", "x1", "y1", "x2", "y2", F.lit(True).alias("reviewed"), F.when(F.col("manual"), "manual").otherwise("from_proposal").alias("notes"))


def save_guard(boxes: DataFrame, frame: list[str]) -> DataFrame:
    """Whether a frame may be saved: boxes were accepted or drawn; proposals wait; or it is empty."""
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    a = boxes.groupBy(*frame).agg(some((F.col("accepted") & ~F.col("rejected")) | F.col("manual")).alias("kept"), some(~F.col("manual")).alias("proposed"))
    return a.select(*frame, F.when(F.col("kept"), "ok").when(F.col("proposed"), "need_accept").otherwise("need_empty_confirm").alias("guard"))


def prediction_box(default_size: float = 24.0) -> Column:
    """Struct of corners: those of the row, or a box of the row's or the default size around its centre; NULL without either."""
    side = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(default_size))
    cx, cy, w, h = F.col("ball_x_pixel"), F.col("ball_y_pixel"), side("bbox_w"), side("bbox_h")
    own = F.struct(F.col("ball_x1").alias("x1"), F.col("ball_y1").alias("y1"), F.col("ball_x2").alias("x2"), F.col("ball_y2").alias("y2"))
    made = F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))
    return F.when(F.col("ball_x1").isNotNull(), own).when(cx.isNotNull() & cy.isNotNull(), made)


def history(audit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, global_id, events, last_sequence): how many audit events an id takes part in, in any role."""
    each = audit.select(*keys, "sequence", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("global_id")).where("global_id is not null")
    return each.groupBy(*keys, "global_id").agg(F.count("*").alias("events"), F.max("sequence").alias("last_sequence"))


def interval_from(attributes: Column) -> Column:
    """Struct start_ms, end_ms of an event, from its attributes; NULL unless both are numbers."""
    a, b = (attributes[k].try_cast("double") for k in ("interval_start_ms", "interval_end_ms"))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start_ms"), b.alias("end_ms")))


def camera_status(cameras: DataFrame) -> DataFrame:
    """Calibration status of each camera: manual over prepared over provider, else missing."""
    by = F.when(F.col("manual"), "manual").when(F.col("prepared"), "prepared").when(F.col("provider_valid"), "provider").otherwise("missing")
    return cameras.withColumn("calibration_source", by).withColumn("calibrated", by != "missing")


def run_bytes(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Disk that a run may need: a tenth of its inputs, 64 MiB at least."""
    return inputs.groupBy(*keys).agg(F.greatest(F.lit(64 << 20).cast("long"), F.floor(F.sum("size_bytes") * 0.1).cast("long")).alias("estimated_bytes"))
