"""Match, team, role and quality summaries; audits and review samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import distance
from tracklake.functions.labels import excluded_role, percent, rejection_category, role_family
from tracklake.operators.windows import first_by, islands, mode_by


def box_jitter(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Median move of a box between neighbouring frames over its height."""
    w = Window.partitionBy(*keys).orderBy("frame_id")
    cx, cy, h = (F.col("bbox_x1") + F.col("bbox_x2")) / 2, (F.col("bbox_y1") + F.col("bbox_y2")) / 2, F.col("bbox_y2") - F.col("bbox_y1")
    d = boxes.withColumn("move", F.when(F.col("frame_id") - F.lag("frame_id").over(w) == 1, distance(cx, cy, F.lag(cx).over(w), F.lag(cy).over(w)) / F.nullif(h, F.lit(0.0))))
    return d.groupBy(*keys).agg(F.median("move").alias("median_jitter"))


def track_quality_table(quality: DataFrame, boxes: DataFrame, cuts: DataFrame, match: list[str], width: float = 1920.0, height: float = 1080.0, min_frames: int = 10, min_score: float = 0.3, max_truncation: float = 0.85) -> DataFrame:
    """quality with jitter, share of truncated boxes, scene cuts within the track and whether it may be measured."""
    keys = [*match, "track_id"]
    edge = (F.col("bbox_x1") <= 0) | (F.col("bbox_y1") <= 0) | (F.col("bbox_x2") >= width) | (F.col("bbox_y2") >= height)
    span = boxes.groupBy(*keys).agg(F.avg(edge.cast("double")).alias("truncation"), F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))
    n = span.join(cuts.where("scene_cut").select(*match, F.col("frame_id").alias("cut")), match, "left").where("cut is null or (cut > first and cut <= last)").groupBy(*keys).agg(F.count("cut").alias("scene_cut_count"))
    out = quality.join(box_jitter(boxes, keys), keys, "left").join(span.select(*keys, "truncation"), keys, "left").join(n, keys, "left").na.fill(0, ["scene_cut_count"])
    return out.withColumn("usable_for_metrics", (F.col("observations") >= min_frames) & (F.col("quality_score") >= min_score) & (F.col("truncation") <= max_truncation))


def match_quality_report(frames: DataFrame, quality: DataFrame, match: list[str], low: float = 0.3) -> DataFrame:
    """Shares of frames by kind, mean quality of tracks, and the ids of poor ones."""
    part = lambda c: F.avg(c.cast("double"))
    f = frames.groupBy(*match).agg(F.count("*").alias("frames"), part(F.col("calibrated")).alias("calibrated_fraction"), part(F.col("replay")).alias("replay_fraction"), part(F.col("ball_visible")).alias("ball_visible_fraction"))
    q = quality.groupBy(*match).agg(F.avg("quality_score").alias("mean_track_quality"), F.array_sort(F.collect_list(F.when(F.col("quality_score") < low, F.col("track_id")))).alias("low_quality_tracks"))
    return f.join(q, match, "left")


def player_table(players: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Players (not officials) with their metrics and the first reason why there are none."""
    p = players.where(~excluded_role(F.col("role"))).join(metrics, keys, "left")
    return p.withColumn("reason", F.when(F.coalesce("valid", F.lit(False)), F.lit(None)).otherwise(F.coalesce("invalid_reason", F.lit("no_metrics")))).withColumn("valid", F.coalesce("valid", F.lit(False)))


def team_table(players: DataFrame, match: list[str]) -> DataFrame:
    """Totals over players with valid metrics; goalkeepers by id; how many are left out."""
    keeper = role_family(F.col("role")) == "goalkeeper"
    t = players.where("team_id is not null").groupBy(*match, "team_id").agg(
        F.count("*").alias("players"), F.count(F.when(F.col("valid"), 1)).alias("measured"), F.sum(F.when(F.col("valid"), F.col("total_distance_m"))).alias("total_distance_m"), F.max(F.when(F.col("valid"), F.col("max_speed_kmh"))).alias("max_speed_kmh"),
        F.array_sort(F.collect_list(F.when(keeper, F.col("track_id")))).alias("goalkeepers"),
    )
    return t.withColumn("excluded", F.col("players") - F.col("measured"))


def officials_table(people: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    return people.where(role_family(F.col("role")) == "official").join(metrics, keys, "left")


def goalkeeper_table(players: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    return players.where(role_family(F.col("role")) == "goalkeeper").join(shares, keys, "left")


def match_summary(players: DataFrame, officials: DataFrame, match: list[str]) -> DataFrame:
    """Counts; an error if someone is a player and an official."""
    both = players.select(*match, "track_id").intersect(officials.select(*match, "track_id")).limit(3).collect()
    if both:
        raise ValueError(f"players and officials at once: {both}")
    a = players.groupBy(*match).agg(F.count("*").alias("players"), F.countDistinct("team_id").alias("teams"), F.sum("total_distance_m").alias("total_distance_m"))
    return a.join(officials.groupBy(*match).agg(F.count("*").alias("officials")), match, "left").na.fill(0, ["officials"])


def identity_table(tracks: DataFrame, mapping: DataFrame, match: list[str], fps: float, max_per_team: int = 11) -> DataFrame:
    """One row per global id: its tracks' visible seconds, first and last frame, and whether its team has no more than it may."""
    t = tracks.groupBy(*match, "track_id", "team_id").agg((F.countDistinct("frame_id") / F.lit(fps)).alias("visible_seconds"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))
    g = t.join(mapping, [*match, "track_id"]).groupBy(*match, "global_id").agg(F.min_by("team_id", "track_id").alias("team_id"), F.sum("visible_seconds").alias("visible_seconds"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.count("*").alias("fragments"))
    n = F.count("*").over(Window.partitionBy(*match, "team_id"))
    return g.withColumn("team_size", n).withColumn("validated", F.col("team_size") <= max_per_team)


def reid_tracks(quality: DataFrame, strict: bool, min_frames: int = 12, max_truncation: float = 0.85) -> DataFrame:
    """Tracks worth an embedding: long and little truncated; strictly, also usable."""
    d = quality.where((F.col("observations") >= min_frames) & (F.col("truncation") <= max_truncation))
    return d.where("usable_for_metrics") if strict else d


def mad_pool(features: DataFrame, keys: list[str], columns: list[str], z: float = 3.5, min_rows: int = 3) -> DataFrame:
    """Medians of features without rows that lie far out, by median absolute deviation; of all rows if too few are left."""
    mids = features.groupBy(*keys).agg(*[F.median(c).alias(f"m_{c}") for c in columns])
    d = features.join(mids, keys)
    devs = d.groupBy(*keys).agg(*[F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"d_{c}") for c in columns])
    d = d.join(devs, keys)
    inside = F.lit(True)
    for c in columns:
        inside = inside & ((F.col(f"d_{c}") <= 1e-12) | (0.6745 * F.abs(F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}") <= z))
    d = d.withColumn("inside", inside)
    d = d.withColumn("enough", F.sum(F.col("inside").cast("int")).over(Window.partitionBy(*keys)) >= min_rows)
    return d.where(F.col("inside") | ~F.col("enough")).groupBy(*keys).agg(F.count("*").alias("rows"), *[F.median(c).alias(c) for c in columns])


def final_roles(votes: DataFrame, keys: list[str], min_frames: int = 8) -> DataFrame:
    """Role of a track by shares of its frames' labels and zones, first rule that holds: votes have label, zone, motion."""
    share = lambda c: F.avg(c.cast("double"))
    a = votes.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("label") == "referee").alias("referee"), share(F.col("label") == "goalkeeper").alias("goalkeeper"), share(F.col("zone") == "pitch").alias("pitch"), share(F.col("zone") == "bench").alias("bench"), share(F.col("zone") == "stands").alias("stands"), F.avg("motion").alias("motion"))
    role = (
        F.when(F.col("n") < min_frames, "unknown").when((F.col("stands") >= 0.6) & (F.col("motion") <= 8.0), "spectator").when((F.col("referee") >= 0.55) & (F.col("pitch") >= 0.25) & (F.col("bench") < 0.55), "referee")
        .when(F.col("bench") >= 0.5, "staff").when(F.col("goalkeeper") >= 0.5, "goalkeeper").when(F.col("pitch") > 0, "player").otherwise("unknown")
    )
    return a.select(*keys, role.alias("role"), "n", "referee", "pitch", "bench", "stands")


def calibration_audit(frames: DataFrame, match: list[str], max_jump: float = 35.0) -> DataFrame:
    """frames (valid, px, py, reason) with the jump from the last valid one, whether it is too large, and the reason's category."""
    w = Window.partitionBy(*match).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("valid"), F.struct("px", "py")), True).over(w)
    d = frames.withColumn("last", last).withColumn("jump", F.when(F.col("valid"), distance(F.col("px"), F.col("py"), F.col("last.px"), F.col("last.py"))))
    return d.withColumn("jumped", F.coalesce(F.col("jump") > max_jump, F.lit(False))).withColumn("category", rejection_category(F.col("reason"))).drop("last")


def stable_reads(reads: DataFrame, match: list[str], count: int = 3) -> DataFrame:
    """reads (frame_id, digest) with stable: the last `count` digests are one and the same."""
    w = Window.partitionBy(*match).orderBy("frame_id").rowsBetween(1 - count, 0)
    return reads.withColumn("stable", F.coalesce((F.count("digest").over(w) == count) & (F.min("digest").over(w) == F.max("digest").over(w)), F.lit(False)))


def first_each_second(tracks: DataFrame, keys: list[str]) -> DataFrame:
    return first_by(tracks.withColumn("second", F.floor(F.col("timestamp_ms") / 1000)), [*keys, "second"], "timestamp_ms", "frame_id")


def best_window(frames: DataFrame, match: list[str], seconds: float = 20.0, cut_cost: float = 5.0) -> DataFrame:
    """The window, of those that start every quarter of its length, with most players and fewest cuts;
    frames: timestamp_ms, players, scene_cut."""
    step, size = seconds * 250.0, seconds * 1000.0
    k = F.floor(F.col("timestamp_ms") / step)
    d = frames.withColumn("slot", F.explode(F.sequence(F.greatest(k - 3, F.lit(0)), k)))
    a = d.groupBy(*match, "slot").agg((F.avg("players") - cut_cost * F.sum(F.col("scene_cut").cast("int")) + 5).alias("score"), F.count("*").alias("frames"))
    return first_by(a, match, F.desc("score"), "slot").select(*match, (F.col("slot") * step).alias("start_ms"), (F.col("slot") * step + size).alias("end_ms"), "score", "frames")


def even_sample(rows: DataFrame, match: list[str], order: str, count: int) -> DataFrame:
    """`count` rows at even distances from the first to the last."""
    w = Window.partitionBy(*match)
    d = rows.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(order)) - 1)
    want = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (F.col("n") - 1) / F.lit(float(max(count - 1, 1)))).cast("long"))
    return d.where((F.col("n") <= count) | F.array_contains(want, F.col("i").cast("long"))).drop("n", "i")


def stratified_sample(rows: DataFrame, match: list[str], stratum: str, id_col: str, quota: int, seed: int) -> DataFrame:
    """Up to `quota` rows of each stratum, by a seeded hash (not by the order of a generator)."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)
    return first_by(rows.withColumn("sample_key", key), [*match, stratum], "sample_key", id_col, rows=quota).drop("sample_key")


def upsert_frame(truth: DataFrame, new_rows: DataFrame, frame_keys: list[str]) -> DataFrame:
    """truth with the frames that new_rows have replaced by these, others as they were."""
    return truth.join(new_rows.select(*frame_keys).distinct(), frame_keys, "left_anti").unionByName(new_rows, allowMissingColumns=True)


def latest_decisions(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last revision of each decision of an append-only log, and how many there were."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return first_by(log.withColumn("revisions", n), keys, F.desc("revision"))


def status_counts(rows: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """A row for each status that there may be, also where none is."""
    grid = rows.select(*keys).distinct().withColumn(status, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(rows.groupBy(*keys, status).agg(F.count("*").alias("n")), [*keys, status], "left").na.fill(0, ["n"])


def spotted_goals(candidates: DataFrame, existing: DataFrame, match: list[str], apart_ms: float = 2000.0) -> DataFrame:
    """Candidates at least `apart_ms` after any goal kept before, existing ones first: islands of close
    ones give their first."""
    every = existing.select(*match, "timestamp_ms", F.lit(0).alias("new"), F.lit(None).cast("double").alias("score")).unionByName(candidates.select(*match, "timestamp_ms", F.lit(1).alias("new"), "score"))
    w = Window.partitionBy(*match).orderBy("timestamp_ms", "new")
    d = islands(every.withColumn("since", F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)), match, ["timestamp_ms", "new"], F.col("since").isNull() | (F.col("since") >= apart_ms), "group")
    first = d.groupBy(*match, "group").agg(F.min("new").alias("all_new"), F.min("timestamp_ms").alias("timestamp_ms"), F.max("score").alias("score"))
    return first.where("all_new = 1").select(*match, "timestamp_ms", "score")


def fragment_classes(fragments: DataFrame, match: list[str], fps: float = 25.0) -> DataFrame:
    """Class of each identity fragment, by the first rule that holds."""
    c = F.when(F.col("frames") < 12, "noise").when(F.col("visible_seconds") < 0.8, "short").when(F.col("team_confidence") < 0.4, "unsure_team").when(F.col("fragments") > 1, "merged").otherwise("single")
    return fragments.withColumn("class", c).groupBy(*match, "class").agg(F.count("*").alias("n"), F.sum("visible_seconds").alias("visible_seconds"))


def consolidate(chunks: DataFrame, values: list[str]) -> DataFrame:
    """Per camera: chunks by status (all of them), share done and the seconds covered."""
    n = status_counts(chunks, ["camera_id"], "status", values).groupBy("camera_id").pivot("status", values).agg(F.first("n"))
    s = chunks.groupBy("camera_id").agg(F.count("*").alias("chunks"), F.sum(F.when(F.col("status") == "PASSED", F.col("end_seconds") - F.col("start_seconds"))).alias("seconds_done"))
    out = n.join(s, "camera_id")
    return out.withColumn("done_pct", percent(F.col("PASSED"), F.col("chunks")))


def heatmap_export(cells: DataFrame, members: DataFrame, match: list[str]) -> DataFrame:
    """Cells above 0 of each display id, with the most frequent team of its tracks."""
    t = mode_by(members, [*match, "display_id"], "team_id").select(*match, "display_id", "team_id")
    d = cells.join(members.select(*match, "track_id", "display_id"), [*match, "track_id"]).groupBy(*match, "display_id", "bin_x", "bin_y").agg(F.sum("dwell_ms").alias("dwell_ms")).where("dwell_ms > 0")
    return d.join(t, [*match, "display_id"], "left")
