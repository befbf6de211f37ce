"""Scans with contracts: required, optional, ordered, tri-state CSV, jersey predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tracklake.functions.labels import jersey_text, tri_state

HEADER = T.StructType(
    [T.StructField(n, t) for n, t in (("schema_version", T.StringType()), ("run_id", T.StringType()), ("match_id", T.StringType()), ("frame_id", T.LongType()), ("timestamp_ms", T.DoubleType()), ("source_method", T.StringType()), ("confidence", T.DoubleType()), ("valid", T.BooleanType()))]
)


def read_required(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Parquet table that must have these columns; NaN is read as NULL."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in floats})


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one with this schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def order_violations(df: DataFrame, keys: list[str], order: str, row: str) -> DataFrame:
    """Rows whose `order` is NULL or falls behind the row before."""
    w = Window.partitionBy(*keys).orderBy(row)
    return df.withColumn("before", F.lag(order).over(w)).where(F.col(order).isNull() | (F.col("before") > F.col(order))).drop("before")


def read_truth_csv(spark: SparkSession, path: str, booleans: list[str], numbers: list[str]) -> DataFrame:
    """Ground truth from CSV: flags as true, false or NULL, numbers or NULL."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({**{c: tri_state(F.col(c)) for c in booleans}, **{c: F.col(c).try_cast("double") for c in numbers}})


def jersey_predictions(rows: DataFrame) -> DataFrame:
    """(track_id, jersey_number) from any number of predictions; two numbers for a track are an error."""
    j = rows.select("track_id", jersey_text(F.col("jersey_number")).alias("jersey_number")).where("jersey_number is not null").distinct()
    bad = j.groupBy("track_id").count().where("count > 1").limit(3).collect()
    if bad:
        raise ValueError(f"more than one jersey number for tracks {[r.track_id for r in bad]}")
    return j


def with_header(df: DataFrame, run_id: str, method: str, version: str = "2.0.0") -> DataFrame:
    """The common columns in front; confidence within 0 and 1, and 0 where not valid."""
    valid = F.coalesce("valid", F.lit(False)) if "valid" in df.columns else F.lit(True)
    conf = F.when(valid, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))).otherwise(F.lit(0.0))
    out = df.withColumns({"schema_version": F.lit(version), "run_id": F.lit(run_id), "source_method": F.lit(method), "confidence": conf, "valid": valid})
    return out.select(*[F.col(f.name).cast(f.dataType) for f in HEADER if f.name in out.columns], *[c for c in df.columns if c not in HEADER.names])
