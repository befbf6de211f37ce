"""Canonical tracking tables derived from the driver's tables, the same way in Spark and in SQL.

22 consecutive events are a frame, the remainder is the track; 250 frames are a match. Positions
go back and forth along the pitch, and some jump, so that rejection has something to do.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH = ["match_id"]
TRACK = ["match_id", "track_id"]

SQL = """
tr AS (
  SELECT event_id, event_id // 22 AS frame_id, event_id % 22 AS track_id, event_id // 5500 AS match_id, CAST(event_id // 22 AS DOUBLE) * 40.0 AS timestamp_ms,
    CASE WHEN event_id % 22 < 11 THEN 'team_0' ELSE 'team_1' END AS team_id, event_type, value,
    (CASE WHEN ph < 1000 THEN ph ELSE 2000 - ph END) / 20.0 + (CASE WHEN value > 300 THEN 20.0 ELSE 0.0 END) AS x_field,
    (((event_id % 22) * 13 + event_id // 22) % 680) / 10.0 AS y_field,
    ((event_id * 31) % 100) / 100.0 AS confidence, ((event_id * 17) % 100) / 100.0 AS team_confidence,
    CASE WHEN (event_id // 22) % 40 >= 36 THEN 'replay' ELSE 'wide' END AS shot_type, (event_id // 22) % 40 >= 36 AS replay, event_id % 17 <> 0 AS calibration_valid, true AS quality_ok,
    (event_id // 22) % 100 = 99 AS scene_cut
  FROM (SELECT *, ((event_id // 22) * (1 + (event_id % 22) % 4) + (event_id % 22) * 90) % 2000 AS ph FROM events)),
ball AS (
  SELECT f.match_id, f.frame_id, f.timestamp_ms, f.event_type <> 'error' AS visible, f.confidence AS ball_confidence, f.event_type = 'view' AS interpolated, f.event_type <> 'signup' AS in_play,
    CASE WHEN f.event_type <> 'error' THEN t.x_field END AS pitch_x, CASE WHEN f.event_type <> 'error' THEN t.y_field END AS pitch_y,
    CASE WHEN f.event_type <> 'error' THEN t.x_field * 10 + 3 END AS ball_x_pixel, CASE WHEN f.event_type <> 'error' THEN t.y_field * 10 + 4 END AS ball_y_pixel
  FROM tr f JOIN tr t ON t.frame_id = f.frame_id AND t.track_id = (f.frame_id // 12) % 22 WHERE f.track_id = 0),
touches AS (
  SELECT match_id, 'touch-' || lpad(CAST(frame_id AS VARCHAR), 9, '0') AS touch_id, frame_id, timestamp_ms, track_id, team_id, ((event_id * 37) % 100) / 100.0 AS confidence, event_type <> 'error' AS controlled_touch,
    event_type = 'signup' AS deflection, x_field AS pitch_x, y_field AS pitch_y
  FROM tr WHERE track_id = (frame_id * 7 + frame_id // 5) % 22 AND event_type <> 'view'),
obs AS (
  SELECT match_id, event_id AS obs_id, 'camera_' || CAST(event_id % 3 AS VARCHAR) AS camera_id, track_id AS local_track_id, track_id AS global_id, timestamp_ms / 1000.0 AS t, x_field AS x, y_field AS y, team_id, team_confidence,
    CASE WHEN event_id % 5 <> 0 THEN track_id % 11 + 1 END AS jersey_number, confidence AS jersey_confidence, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'player' END AS role, confidence AS detection_confidence
  FROM tr)
"""


class Tables:
    """The bridged tables of one directory; nothing runs until a query does."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tracks(self) -> DataFrame:
        e = self.raw("events").select("event_id", "event_type", "value")
        e = e.withColumns({"frame_id": F.expr("event_id div 22"), "track_id": F.expr("event_id % 22"), "match_id": F.expr("event_id div 5500")})
        e = e.withColumn("ph", F.expr("(frame_id * (1 + track_id % 4) + track_id * 90) % 2000"))
        x = F.when(F.col("ph") < 1000, F.col("ph")).otherwise(2000 - F.col("ph")) / 20.0 + F.when(F.col("value") > 300, 20.0).otherwise(0.0)
        return e.select(
            "match_id", "frame_id", "track_id", "event_id", "event_type", "value", (F.col("frame_id").cast("double") * 40.0).alias("timestamp_ms"), F.when(F.col("track_id") < 11, "team_0").otherwise("team_1").alias("team_id"),
            x.alias("x_field"), (F.expr("(track_id * 13 + frame_id) % 680") / 10.0).alias("y_field"), (F.expr("event_id * 31 % 100") / 100.0).alias("confidence"), (F.expr("event_id * 17 % 100") / 100.0).alias("team_confidence"),
            F.when(F.expr("frame_id % 40 >= 36"), "replay").otherwise("wide").alias("shot_type"), F.expr("frame_id % 40 >= 36").alias("replay"), F.expr("event_id % 17 <> 0").alias("calibration_valid"), F.lit(True).alias("quality_ok"), F.expr("frame_id % 100 = 99").alias("scene_cut"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        return self.tracks.where("track_id = 0").select("match_id", "frame_id", "timestamp_ms", "shot_type", "scene_cut", "event_type", "confidence")

    @cached_property
    def ball(self) -> DataFrame:
        at = self.tracks.where("track_id = (frame_id div 12) % 22").select("match_id", "frame_id", "x_field", "y_field")
        b = self.frames.join(at, ["match_id", "frame_id"])
        seen = F.col("event_type") != "error"
        return b.select(
            "match_id", "frame_id", "timestamp_ms", seen.alias("visible"), F.col("confidence").alias("ball_confidence"), (F.col("event_type") == "view").alias("interpolated"), (F.col("event_type") != "signup").alias("in_play"),
            F.when(seen, F.col("x_field")).alias("pitch_x"), F.when(seen, F.col("y_field")).alias("pitch_y"), F.when(seen, F.col("x_field") * 10 + 3).alias("ball_x_pixel"), F.when(seen, F.col("y_field") * 10 + 4).alias("ball_y_pixel"),
        )

    @cached_property
    def touches(self) -> DataFrame:
        t = self.tracks.where("track_id = (frame_id * 7 + frame_id div 5) % 22 and event_type <> 'view'")
        return t.select(
            "match_id", F.concat(F.lit("touch-"), F.lpad(F.col("frame_id").cast("string"), 9, "0")).alias("touch_id"), "frame_id", "timestamp_ms", "track_id", "team_id", (F.expr("event_id * 37 % 100") / 100.0).alias("confidence"),
            (F.col("event_type") != "error").alias("controlled_touch"), (F.col("event_type") == "signup").alias("deflection"), F.col("x_field").alias("pitch_x"), F.col("y_field").alias("pitch_y"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        t = self.tracks
        return t.select(
            "match_id", F.col("event_id").alias("obs_id"), F.concat(F.lit("camera_"), F.expr("event_id % 3").cast("string")).alias("camera_id"), F.col("track_id").alias("local_track_id"), F.col("track_id").alias("global_id"), (F.col("timestamp_ms") / 1000.0).alias("t"),
            F.col("x_field").alias("x"), F.col("y_field").alias("y"), "team_id", "team_confidence", F.when(F.expr("event_id % 5 <> 0"), F.expr("track_id % 11 + 1")).alias("jersey_number"), F.col("confidence").alias("jersey_confidence"),
            F.when(F.expr("event_id % 7 = 0"), "unknown").otherwise("player").alias("role"), F.col("confidence").alias("detection_confidence"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        """One box per track and frame, in pixels."""
        return self.tracks.select("match_id", "frame_id", "timestamp_ms", "track_id", "scene_cut", "confidence", (F.col("x_field") * 10).alias("bbox_x1"), (F.col("y_field") * 10).alias("bbox_y1"), (F.col("x_field") * 10 + 20 + F.col("track_id")).alias("bbox_x2"), (F.col("y_field") * 10 + 50).alias("bbox_y2"))
