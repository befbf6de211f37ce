"""Other tools' formats and contracts as tables: predictions, commentary, spotting, manifests, calibration records; and
small adapters between canonical tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import geometry as G
from tracklake.operators.folds import ordered_fold
from tracklake.operators.windows import runs_of

GS = "predictions array<struct<image_id:string,track_id:long,category_id:double,supercategory:string,confidence:double,bbox_image:struct<x:double,y:double,w:double,h:double>,bbox_pitch:struct<x_bottom_left:double,y_bottom_left:double,x_bottom_middle:double,y_bottom_middle:double,x_bottom_right:double,y_bottom_right:double>,attributes:struct<role:string,team:string,jersey:string>>>"
_PITCH = ("x_bottom_left", "y_bottom_left", "x_bottom_middle", "y_bottom_middle", "x_bottom_right", "y_bottom_right")


def load(spark: SparkSession, source: str | list[dict] | DataFrame) -> DataFrame:
    """A table from parquet, csv or json files, rows, or as it is."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame(source)
    kind = source.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(source)
    return spark.read.json(source) if kind in ("json", "jsonl") else spark.read.parquet(source)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a JSON manifest, in the fields that the schema names."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.*")


def gs_predictions(documents: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Flat rows of documents of game-state predictions; a prediction without a confidence is an error."""
    p = documents.select(*keys, F.explode(F.from_json(column, GS)["predictions"]).alias("p"))
    sure = F.coalesce(F.col("p.confidence"), F.raise_error(F.lit("a prediction has no confidence")).cast("double"))
    return p.select(
        *keys, "p.image_id", "p.track_id", "p.category_id", "p.supercategory", sure.alias("confidence"), *[F.col(f"p.bbox_image.{c}").alias(f"bbox_{c}") for c in "xywh"], *[F.col(f"p.bbox_pitch.{c}").alias(f"pitch_{c}") for c in _PITCH],
        *[F.col(f"p.attributes.{c}").alias(c) for c in ("role", "team", "jersey")],
    )


def gs_json(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One JSON document of game-state predictions for each key; non-finite numbers are left out."""
    have = set(rows.columns)
    num = lambda c: F.when(G.finite(F.col(c).cast("double")), F.col(c).cast("double")) if c in have else F.lit(None).cast("double")
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    p = F.struct(
        F.col("image_id").cast("string").alias("image_id"), F.col("track_id").cast("long").alias("track_id"), F.col("category_id").cast("double").alias("category_id"), "supercategory", num("confidence").alias("confidence"),
        F.struct(*[num(f"bbox_{c}").alias(c) for c in "xywh"]).alias("bbox_image"), F.struct(*[num(f"pitch_{c}").alias(c) for c in _PITCH]).alias("bbox_pitch"), F.struct(*[text(c).alias(c) for c in ("role", "team", "jersey")]).alias("attributes"),
    )
    each = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, p.alias("p")))).alias("rows"))
    return each.select(*keys, F.to_json(F.struct(F.transform("rows", lambda r: r["p"]).alias("predictions"))).alias("document"))


def commentary_events(segments: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Timed text as events in milliseconds, valid where it doesn't end before it starts."""
    a, b = (F.round(F.col(c) * 1000).cast("long") for c in ("start_s", "end_s"))
    return segments.select(*keys, "half", F.lit("commentary").alias("event_type"), a.alias("timestamp_ms"), b.alias("end_timestamp_ms"), (b - a).alias("duration_ms"), F.trim("text").alias("text"), F.concat(F.lit("sn_echoes/"), version).alias("source_method"), F.coalesce(F.col("end_s") >= F.col("start_s"), F.lit(False)).alias("valid"))


SPOTTED = "candidates array<struct<event_type:string,timestamp:double,confidence:double,source_model:string,temporal_window:array<long>,frame_id:long>>"


def spotting_candidates(documents: DataFrame, column: str, keys: list[str], model: str = "unnamed") -> DataFrame:
    """Rows of documents of spotted events; a candidate without a window has that of its frame."""
    c = documents.select(*keys, F.explode(F.from_json(column, SPOTTED)["candidates"]).alias("c"))
    at = lambda k: F.coalesce(F.get("c.temporal_window", F.lit(k)), F.col("c.frame_id"), F.lit(0).cast("long"))
    return c.select(*keys, "c.event_type", "c.timestamp", "c.confidence", F.coalesce("c.source_model", F.lit(model)).alias("source_model"), at(0).alias("window_start"), at(1).alias("window_end"), "c.frame_id")


def video_facts() -> list[Column]:
    """fps and frame_count of a manifest: of the working copy, else as reported, else 25 and 0."""
    fps = F.when(F.col("working_fps") > 0, F.col("working_fps")).otherwise(F.coalesce(F.nullif("reported_fps", F.lit(0.0)), F.lit(25.0)))
    frames = F.coalesce(F.nullif("working_frames", F.lit(0)), "reported_frames", F.lit(0)).cast("long")
    return [fps.alias("fps"), frames.alias("frame_count")]


def frame_rate(text: Column) -> Column:
    """Frames a second of a text such as 30000/1001; 0 where it has none."""
    a, b = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.coalesce(F.when(b != 0, a / F.when(b != 0, b)), F.lit(0.0))


def column_format(name: Column) -> Column:
    """Kind of number by the last part of a column's name."""
    last = F.regexp_extract(name, r"([a-z0-9]+)$", 1)
    return F.when(last.isin("pct", "percent"), "percent").when(last.isin("m", "kmh", "seconds", "confidence", "quality", "coverage"), "decimal").when(last.isin("id", "count", "frame", "frames", "ms", "number"), "whole").otherwise("text")


def player_samples(metrics: DataFrame) -> DataFrame:
    """Samples from rows of metrics: other names of the wide shot, unknown confidence as 0, NaN as unknown."""
    shot = F.lower(F.coalesce("shot_type", F.lit("wide")))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return metrics.withColumns({"shot_type": F.when(shot.isin("tactical", "tactical_wide"), "tactical").when(shot.isin("replay", "close_up", "graphic"), shot).otherwise("wide"), "x_field": known("x_field"), "y_field": known("y_field"), "confidence": F.coalesce("confidence", F.lit(0.0)), "quality_ok": F.lit(True)})


def camera_gates(cameras: DataFrame, points: DataFrame, keys: list[str], max_error_m: float = 2.0, margin_m: float = 5.0, min_points: int = 4) -> DataFrame:
    """Whether each camera's matrix (column cells, row by row) is usable with its control points (px, py, x, y), the first
    reason why not, and the mean error in metres; without points the error stays unknown."""
    m = G.from_cells(F.col("cells"))
    row = points.join(cameras.select(*keys, "cells"), keys)
    u, v = G.project(m, F.col("px"), F.col("py"))
    off = ~(F.col("x").between(-margin_m, G.PITCH_LENGTH + margin_m) & F.col("y").between(-margin_m, G.PITCH_WIDTH + margin_m))
    p = row.groupBy(*keys).agg(F.count("*").alias("n"), F.max(off).alias("off"), F.max(u.isNull()).alias("far"), F.avg(G.distance(u, v, F.col("x"), F.col("y"))).alias("error_m"))
    j = cameras.join(p, keys, "left")
    finite = F.aggregate("cells", F.lit(True), lambda a, c: a & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    why = (
        F.when(F.size("cells") != 9, "not_3x3").when(~finite, "not_finite").when(F.abs(G.determinant(m)) < 1e-12, "not_invertible").when(F.abs(m[2][2]) < 1e-12, "not_normalizable").when(F.col("n") < min_points, "too_few_control_points")
        .when(F.col("off"), "control_points_outside_pitch").when(F.col("far"), "control_points_at_infinity").when(F.col("error_m") > max_error_m, "reprojection_error")
    )
    return j.select(*keys, why.isNull().alias("valid"), F.when(why.isNull(), F.col("error_m")).alias("reprojection_error_m"), why.alias("invalid_reason"))


def box_violations(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose box isn't finite or has no extent, with the reasons."""
    b = tuple(F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2"))
    why = F.concat_ws(";", F.when(~G.finite(*b), "not_finite"), F.when(G.width(b) <= 0, "no_width"), F.when(G.height(b) <= 0, "no_height"))
    return boxes.select(*keys, why.alias("violations")).where("violations <> ''")


def selected_rows(rows: DataFrame, wanted: list[int], id_col: str) -> DataFrame:
    """Rows of the wanted ids with their place in the list; unknown or repeated ids are an error."""
    if len(set(wanted)) != len(wanted):
        raise ValueError("repeated ids")
    order = rows.sparkSession.createDataFrame([(i, k) for k, i in enumerate(wanted)], f"{id_col} long, place int")  # the caller's list
    out = F.broadcast(order).join(rows, id_col, "left").withColumn("found", F.max(F.lit(True)).over(Window.partitionBy(id_col)))
    missing = order.join(rows.select(id_col), id_col, "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"unknown ids: {[r[id_col] for r in missing]}")
    return out.drop("found")


def zone_geometry(spark: SparkSession) -> DataFrame:
    """The pitch's zones as rectangles in metres, for team 0's direction."""
    length, width = G.PITCH_LENGTH, G.PITCH_WIDTH
    low, high = (width - 40.32) / 2, (width + 40.32) / 2
    zones = [(f"zone_{k + 1}", k * length / 3, (k + 1) * length / 3, 0.0, width) for k in range(3)]
    zones += [("own_penalty_area", 0.0, 16.5, low, high), ("opponent_penalty_area", length - 16.5, length, low, high)]
    zones += [(n, 0.0, length, k * width / 3, (k + 1) * width / 3) for k, n in enumerate(("right_channel", "central_channel", "left_channel"))]
    return spark.createDataFrame(zones, "zone string, x1 double, x2 double, y1 double, y2 double")


def with_ankles(tracks: DataFrame) -> DataFrame:
    """tracks with the foot point moved to the ankles' middle, where the box is valid."""
    b = tuple(F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2"))
    a = G.ankle_point(b)
    return tracks.withColumns({"foot_x_pixel": F.when(G.valid(b), a["x"]).otherwise(F.col("foot_x_pixel")), "foot_y_pixel": F.when(G.valid(b), a["y"]).otherwise(F.col("foot_y_pixel"))})


#: Canonical names of overlay columns and what else they are called.
ALIASES = {"frame_id": ("frame_idx", "frame", "frame_index"), "track_id": ("id", "player_id", "gt_id"), "bbox_x1": ("x1", "left"), "bbox_y1": ("y1", "top"), "bbox_x2": ("x2", "right"), "bbox_y2": ("y2", "bottom"), "class_name": ("label", "cls")}


def overlay_table(rows: DataFrame) -> DataFrame:
    """rows under the canonical names, the canonical column first where a row has it."""
    out = {}
    for name, others in ALIASES.items():
        have = [c for c in (name, *others) if c in rows.columns]
        if have:
            out[name] = F.coalesce(*have)
    return rows.select(*[c.alias(n) for n, c in out.items()])


def same_boxes(proposals: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, whether the proposals are the truth itself: as many boxes, all at the same places."""
    cols = ["x1", "y1", "x2", "y2"]
    digest = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(f"{n}_n"), F.bit_xor(F.xxhash64("frame_id", *[F.round(c, 1) for c in cols])).alias(f"{n}_h"), F.sum(F.xxhash64("frame_id", *[F.round(c, 1) for c in cols]).cast("decimal(38,0)")).alias(f"{n}_s"))
    j = digest(proposals, "p").join(digest(truth, "t"), keys)
    return j.select(*keys, ((F.col("p_n") == F.col("t_n")) & (F.col("p_h") == F.col("t_h")) & (F.col("p_s") == F.col("t_s"))).alias("same"))


def ball_provenance(football: DataFrame, general: DataFrame, frames: DataFrame, frame: list[str]) -> DataFrame:
    """One ball for each frame: the football detector's, or else the general one's, and where it is from."""
    best = lambda d, n: d.groupBy(*frame).agg(F.max_by(F.struct("x", "y", "confidence"), F.struct("confidence", "x", "y")).alias(n))
    j = frames.select(*frame).join(best(football, "own"), frame, "left").join(best(general, "other"), frame, "left").withColumn("b", F.coalesce("own", "other"))
    return j.select(*frame, "b.x", "b.y", F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("own").isNotNull(), "detected").when(F.col("other").isNotNull(), "tracked").otherwise("missing").alias("provenance"))


@dataclass(frozen=True)
class RecoveryRules:
    max_fill: int = 5
    max_speed: float = 2800.0
    process: float = 400.0
    measurement: float = 4.0
    fill_confidence: float = 0.15


RECOVERED = "frame_id long, timestamp_ms double, x double, y double, state string, source string, confidence double, false_positive boolean"


def recover_ball(ball: DataFrame, match: list[str], rules: RecoveryRules = RecoveryRules()) -> DataFrame:
    """ball (frame_id, timestamp_ms, x, y, state, confidence) with gaps of up to max_fill frames after a detection filled by
    a constant-velocity Kalman filter; a detection that is too far from what is predicted is taken out."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        s = None  # x, y, vx, vy and the variances of place, of both, of velocity (alike for both axes)
        before, since = None, None
        for r in rows:
            dt = 0.04 if before is None else max(1e-3, (r["timestamp_ms"] - before) / 1000.0)
            before = r["timestamp_ms"]
            since = None if since is None else since + 1
            if s:
                x, y, vx, vy, p, c, q = s
                s = [x + vx * dt, y + vy * dt, vx, vy, p + 2 * dt * c + dt * dt * q + rules.process * dt**3 / 3, c + dt * q + rules.process * dt * dt / 2, q + rules.process * dt]
            here = r["x"] is not None and r["y"] is not None and r["state"] in ("detected", "predicted", "occluded_short", "airborne")
            wild = bool(here and s and r["state"] == "detected" and math.hypot(r["x"] - s[0], r["y"] - s[1]) / dt > 1.5 * rules.max_speed)
            if here and not wild:
                if s is None:
                    s = [r["x"], r["y"], 0.0, 0.0, rules.measurement, 0.0, 1e6]
                else:
                    x, y, vx, vy, p, c, q = s
                    k, g = p / (p + rules.measurement), c / (p + rules.measurement)
                    dx, dy = r["x"] - x, r["y"] - y
                    s = [x + k * dx, y + k * dy, vx + g * dx, vy + g * dy, (1 - k) * p, (1 - k) * c, q - g * c]
                if r["state"] in ("detected", "airborne"):
                    since = 0
                elif since is None or since > rules.max_fill:
                    since = rules.max_fill
                yield r["frame_id"], r["timestamp_ms"], r["x"], r["y"], r["state"], "raw_detection" if r["state"] == "detected" else f"ball_state_{r['state']}", r["confidence"], False
            elif s and since is not None and 0 < since <= rules.max_fill:
                yield r["frame_id"], r["timestamp_ms"], s[0], s[1], "predicted", "kalman_predict", max(r["confidence"] or 0.0, rules.fill_confidence), wild
            else:
                if since is not None and since > rules.max_fill:
                    s = None  # too old to predict from
                yield r["frame_id"], r["timestamp_ms"], None, None, "unknown", "missing", r["confidence"], wild

    return ordered_fold(ball, match, ["frame_id"], fold, RECOVERED)


def ball_coverage(recovered: DataFrame, match: list[str]) -> DataFrame:
    """Shares of frames with a detection, with a place and filled, false positives, and the longest time without a place."""
    a = recovered.groupBy(*match).agg(
        F.avg((F.col("source") == "raw_detection").cast("double")).alias("raw_detection_coverage"), F.avg(F.col("x").isNotNull().cast("double")).alias("tracked_coverage"), F.avg((F.col("source") == "kalman_predict").cast("double")).alias("interpolated_coverage"),
        F.count(F.when(F.col("false_positive"), 1)).alias("false_positive_candidates"), F.count("*").alias("frames"), F.max("timestamp_ms").alias("last"),
    )
    nxt = F.lead("timestamp_ms").over(Window.partitionBy(*match).orderBy("timestamp_ms"))
    d = recovered.withColumn("until", F.coalesce(nxt, F.col("timestamp_ms")))
    w = Window.partitionBy(*match).orderBy("timestamp_ms")
    d = d.withColumn("run", F.sum(F.col("x").isNotNull().cast("int")).over(w)).where("x is null").groupBy(*match, "run").agg((F.max("until") - F.min("timestamp_ms")).alias("gap"))
    return a.join(d.groupBy(*match).agg(F.max("gap").alias("longest_missing_interval_ms")), match, "left").na.fill(0.0, ["longest_missing_interval_ms"]).drop("last")


def two_centres(tracks: DataFrame, match: list[str], columns: list[str], rounds: int = 12) -> DataFrame:
    """Label 0 or 1 of each track by two centres of its descriptors, 0 the whiter (higher first column): from the tracks of
    least and greatest first column on, each round takes the mean of the nearest tracks, without dark kits if others
    do; dark ones are labelled, too. A fixed number of aggregations, whatever the rows."""
    ok = F.col("dark_share") < 0.5
    pool = tracks.withColumn("light", F.sum(ok.cast("int")).over(Window.partitionBy(*match))).withColumn("fits", ok | (F.col("light") < 2))
    key = F.struct(F.col(columns[0]), F.col("track_id"))
    mid = F.struct(*columns)
    c = pool.where("fits").groupBy(*match).agg(F.max_by(mid, key).alias("c0"), F.min_by(mid, key).alias("c1"))
    far = lambda name: sum(((F.col(x) - F.col(f"{name}.{x}")) * (F.col(x) - F.col(f"{name}.{x}")) for x in columns), F.lit(0.0))
    for _ in range(rounds):
        d = pool.where("fits").join(c, match).withColumn("label", (far("c1") < far("c0")).cast("int"))
        mean = lambda k: F.struct(*[F.coalesce(F.avg(F.when(F.col("label") == k, F.col(x))), F.first(F.col(f"c{k}.{x}"))).alias(x) for x in columns])
        c = d.groupBy(*match).agg(mean(0).alias("c0"), mean(1).alias("c1"))
    return tracks.join(c, match).select(*match, "track_id", (far("c1") < far("c0")).cast("int").alias("label"))


def kit_family(h: Column, s: Column, v: Column, grey: float = 45, black: float = 60, white: float = 170) -> Column:
    """Colour family of a pixel by hue (of 180), saturation and value (of 255)."""
    return (
        F.when(v < black, "black").when((s < grey) & (v >= white), "white").when(s < grey, "grey").when((h < 8) | (h >= 170), "red").when(h < 22, "orange").when(h < 35, "yellow")
        .when(h < 80, "green").when(h < 100, "cyan").when(h < 130, "blue").when(h < 150, "purple").otherwise("pink")
    )


def kit_fractions(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each colour family among a torso's pixels."""
    n = pixels.groupBy(*keys, kit_family(F.col("h"), F.col("s"), F.col("v")).alias("family")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def frame_grid(frames: DataFrame, tracks: DataFrame, ball: DataFrame, frame: list[str]) -> DataFrame:
    """A row for every frame, with its players in order of id and its ball, also where there are none."""
    p = tracks.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("track_id", "team_id", "x_field", "y_field"))).alias("players"))
    b = ball.select(*frame, "pitch_x", "pitch_y", "visible")
    none = F.array().cast("array<struct<track_id:bigint,team_id:string,x_field:double,y_field:double>>")
    return frames.select(*frame).join(p, frame, "left").join(b, frame, "left").withColumns({"players": F.coalesce("players", none), "visible": F.coalesce("visible", F.lit(False))})


def longest_hidden(frames: DataFrame, match: list[str], flag: str) -> DataFrame:
    """Longest run of frames without the flag."""
    r = runs_of(frames, match, "frame_id", ~F.col(flag))
    return r.groupBy(*match).agg(F.max(F.col("end") - F.col("start") + 1).alias("frames"))
