"""Chunks of long recordings: plan, resume, invalidate, progress; all on a status table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_chunks(cameras: DataFrame, fps: float, chunk_seconds: float) -> DataFrame:
    """Contiguous frame ranges of each camera (camera_id, frames); chunks of 30 to 300 seconds."""
    if not 30 <= chunk_seconds <= 300:
        raise ValueError("a chunk has 30 to 300 seconds")
    step = round(fps * chunk_seconds)
    k = cameras.where("frames > 0").withColumn("chunk_index", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("frames") / step) - 1).cast("int"))))
    start, end = F.col("chunk_index").cast("long") * step, F.least((F.col("chunk_index").cast("long") + 1) * step, F.col("frames"))
    return k.select("camera_id", "chunk_index", start.alias("frame_start"), end.alias("frame_end"), (start / fps).alias("start_seconds"), (end / fps).alias("end_seconds"))


def should_run(fingerprint: Column, retry_limit: int = 3) -> Column:
    """Anything not passed under this fingerprint that may still be tried."""
    fresh = F.coalesce(F.col("fingerprint") == fingerprint, F.lit(False))
    return ~((F.col("status") == "PASSED") & fresh) & ~((F.col("status") == "FAILED") & fresh & (F.col("attempts") >= retry_limit))


def invalidate(chunks: DataFrame, fingerprint: str) -> DataFrame:
    """Chunks of another fingerprint are pending again."""
    stale = F.col("fingerprint").isNotNull() & (F.col("fingerprint") != fingerprint)
    return chunks.withColumn("status", F.when(stale, "PENDING").otherwise(F.col("status"))).withColumn("attempts", F.when(stale, 0).otherwise(F.col("attempts"))).withColumn("fingerprint", F.when(~stale, F.col("fingerprint")))


def mark(chunks: DataFrame, results: DataFrame, fingerprint: str, retry_limit: int = 3) -> DataFrame:
    """chunks after results (camera_id, chunk_index, ok): passed, to retry, or failed for good."""
    j = chunks.join(results, ["camera_id", "chunk_index"], "left")
    tried = F.col("ok").isNotNull()
    attempts = F.col("attempts") + tried.cast("int")
    status = F.when(F.col("ok"), "PASSED").when(tried & (attempts >= retry_limit), "FAILED").when(tried, "RETRY").otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("attempts", attempts).withColumn("fingerprint", F.when(tried, fingerprint).otherwise(F.col("fingerprint"))).select(*chunks.columns)


def progress(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, and seconds left at the mean pace of those that passed."""
    n = lambda c: F.count(F.when(c, 1))
    ok, bad = F.col("status") == "PASSED", F.col("status") == "FAILED"
    a = chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), n(ok).alias("passed"), n(bad).alias("failed"), n(~ok & ~bad).alias("remaining"), F.avg(F.when(ok, F.col("wall_seconds"))).alias("pace"))
    return a.select(*keys, "chunks", "passed", "failed", "remaining", (F.col("passed") / F.col("chunks")).alias("fraction"), (F.col("pace") * F.col("remaining")).alias("eta_seconds"))
