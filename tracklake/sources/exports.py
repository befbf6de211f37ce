"""Sinks and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json")


def mot_rows(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the MOT challenge: frames from 1, corner and size; boxes without area are left out."""
    b = boxes.where((F.col("bbox_x2") > F.col("bbox_x1")) & (F.col("bbox_y2") > F.col("bbox_y1")))
    return b.select(*keys, (F.col("frame_id") + 1).alias("frame"), F.col("track_id").alias("id"), F.col("bbox_x1").alias("x"), F.col("bbox_y1").alias("y"), (F.col("bbox_x2") - F.col("bbox_x1")).alias("w"), (F.col("bbox_y2") - F.col("bbox_y1")).alias("h"), F.col("confidence").alias("conf"))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no key occurs twice; a ValueError with some of them otherwise."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"keys that occur more than once: {twice}")
    return df


def finite_json(df: DataFrame) -> DataFrame:
    """Floating columns with NULL for NaN and infinities, which JSON doesn't have."""
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)) for c in floats})


def export(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Writes df and returns what is read back, after checking rows and columns. Spark's commit
    protocol makes files appear whole or not at all."""
    if kind not in FORMATS:
        raise ValueError(f"one of {FORMATS}, not {kind}")
    df = finite_json(df) if kind == "json" else df
    w, r = df.write.mode("overwrite"), df.sparkSession.read.schema(df.schema)
    {"parquet": w.parquet, "json": lambda p: w.option("ignoreNullFields", "false").json(p), "csv": lambda p: w.option("header", True).option("escape", '"').csv(p)}[kind](path)
    back = {"parquet": r.parquet, "json": r.json, "csv": lambda p: r.option("header", True).option("escape", '"').option("multiLine", True).csv(p)}[kind](path)
    if back.columns != df.columns or back.count() != df.count():
        raise ValueError(f"{path} isn't what was written")
    return back


def predictions_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per key: predictions in order of frame and track."""
    item = F.struct("frame_id", "track_id", *[c for c in rows.columns if c not in (*keys, "frame_id", "track_id")])
    return finite_json(rows).groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("predictions"))).alias("json"))
