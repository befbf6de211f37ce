"""Timed text: segments of speech from JSON, time ranges, subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions.labels import srt_timestamp


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, segment_id, start_s, end_s, text) from files {"segments": {id: [start, end, text]}};
    rows of another shape have valid = false."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    s = raw.select("path", F.explode(F.from_json("value", "segments map<string,array<string>>")["segments"]).alias("segment_id", "parts"))
    p = lambda k: F.get("parts", F.lit(k))
    start, end = p(0).try_cast("double"), p(1).try_cast("double")
    ok = (F.size("parts") == 3) & start.isNotNull() & end.isNotNull() & p(2).isNotNull()
    return s.select("path", "segment_id", start.alias("start_s"), end.alias("end_s"), p(2).alias("text"), F.coalesce(ok & (end >= start), F.lit(False)).alias("valid"))


def match_of(path) -> list:
    """Columns league, season, game, half from .../<league>/<season>/<game>/<half>... paths."""
    part = lambda k: F.element_at(F.split(path, "/"), -k)
    return [part(4).alias("league"), part(3).alias("season"), part(2).alias("game"), F.regexp_extract(part(1), r"^(\d+)", 1).try_cast("int").alias("half")]


def in_range(segments: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Segments that overlap [start_s, end_s)."""
    return segments.where((F.col("start_s") < end_s) & (F.col("end_s") > start_s))


def srt_blocks(segments: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Number, times and text of each subtitle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", tie))
    return segments.select(*keys, n.alias("number"), F.concat(srt_timestamp(F.col("start_s")), F.lit(" --> "), srt_timestamp(F.col("end_s"))).alias("times"), "text")


def srt_text(segments: DataFrame, keys: list[str], tie: str) -> DataFrame:
    b = srt_blocks(segments, keys, tie).withColumn("block", F.concat_ws("\n", F.col("number").cast("string"), "times", "text"))
    return b.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda s: s["block"]), "\n\n").alias("srt"))
