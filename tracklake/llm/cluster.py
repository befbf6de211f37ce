"""What the operators need to know of the session: shared storage and partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; sets a folder of its own only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tracklake-checkpoint-"))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with its lineage cut. Shuffles that only df needed are
    let go at once: Spark deletes their files when the driver collects garbage, which may be long after."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of results of materialise() from which df is read, once nothing reads them any more."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        if leaves.apply(k).getClass().getSimpleName() == "LogicalRDD":
            kept = leaves.apply(k).rdd().getCheckpointFile()
            if kept.isDefined():
                _delete(df.sparkSession, kept.get())


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """df as a table in the shared checkpoint folder, bucketed by key, so that joins on key don't shuffle it; it is
    dropped at the end."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"tracklake_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FAN = 128


def tree_sum(parts: DataFrame, size: int) -> DataFrame:
    """(piece, counts) summed over all tasks: counts are packed arrays of `size` numbers of 1, 4 or 8 bytes,
    and of 8 in the result. Arrays of FAN neighbouring tasks are added first, then FAN of these, then
    the rest, so that no task gets more than FAN arrays of a piece from up to FAN**3 tasks."""
    kind = dict(parts.dtypes)["piece"]
    arrow = pa.string() if kind == "string" else pa.int32()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype=np.int64)
        for x in t["counts"]:
            raw = x.as_py()
            total += np.frombuffer(raw, {1: np.uint8, 4: np.int32, 8: np.int64}[len(raw) // size])
        return pa.table({"piece": pa.array([t["piece"][0].as_py()], arrow), "slot": pa.array([t["slot"][0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = parts.withColumn("slot", F.spark_partition_id().cast("long"))
    for _ in range(2):
        rows = rows.withColumn("slot", F.floor(F.col("slot") / FAN)).groupBy("piece", "slot").applyInArrow(add, f"piece {kind}, slot long, counts binary")
    return rows.groupBy("piece").applyInArrow(add, f"piece {kind}, slot long, counts binary").select("piece", "counts")
