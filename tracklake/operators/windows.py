"""Sequence helpers: islands, sessions, as-of joins, band joins; all partitioned by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Adds the running number of rows at which an island starts."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))


def gap_sessions(df: DataFrame, keys: list[str], time: str, gap: float, tie: str, name: str = "session") -> DataFrame:
    """Sessions of rows no more than `gap` after the one before."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    marked = df.withColumn("since", F.col(time) - F.lag(time).over(w))
    return islands(marked, keys, [time, tie], F.col("since").isNull() | (F.col("since") > gap), name).drop("since")


def runs_of(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """(keys, run, start, end, rows) of the maximal runs of rows with the flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("run_flag", F.coalesce(flag, F.lit(False)))
    marked = islands(marked, keys, [order], F.col("run_flag") != F.lag("run_flag").over(w), "run")
    return marked.where("run_flag").groupBy(*keys, "run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("rows"))


def centred_average(df: DataFrame, keys: list[str], time: str, value: str, half: float, name: str) -> DataFrame:
    """Mean over the rows within `half` to either side in time."""
    by = ", ".join(f"`{k}`" for k in keys)
    return df.withColumn(name, F.expr(f"avg(`{value}`) over (partition by {by} order by `{time}` range between {half}D preceding and {half}D following)"))


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: list[str], tolerance: float) -> DataFrame:
    """The right row nearest in `order`, at most `tolerance` away, the earlier one on a tie.

    Both sides go through one window by key instead of a theta join; adds `<column>_asof` and
    asof_distance.
    """
    item = F.struct(F.col(order).alias("at"), *columns)
    both = left.withColumn("asof_item", F.lit(None).cast(right.select(item.alias("x")).schema["x"].dataType)).withColumn("asof_left", F.lit(True))
    from_right = right.select(*keys, order, item.alias("asof_item"), F.lit(False).alias("asof_left"))
    every = both.unionByName(from_right, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy(F.col(order), F.col("asof_left").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("asof_left").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("before", F.last("asof_item", True).over(back)).withColumn("after", F.last("asof_item", True).over(ahead)).where("asof_left")
    db, da = F.col(order) - F.col("before.at"), F.col("after.at") - F.col(order)
    pick = F.when(db.isNotNull() & (da.isNull() | (db <= da)), F.col("before")).otherwise(F.col("after"))
    every = every.withColumn("pick", pick).withColumn("asof_distance", F.abs(F.col(order) - F.col("pick.at")))
    near = F.col("asof_distance") <= tolerance
    return every.select(*left.columns, *[F.when(near, F.col(f"pick.{c}")).alias(f"{c}_asof") for c in columns], F.when(near, F.col("asof_distance")).alias("asof_distance"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, below: float, above: float) -> DataFrame:
    """Inner join on keys and right_time in [left_time - below, left_time + above], by buckets as
    wide as the band, so that each left row meets two or three buckets and never a whole key."""
    wide = max(below + above, 1e-9)
    slots = F.sequence(F.floor((F.col(left_time) - below) / wide), F.floor((F.col(left_time) + above) / wide))
    a = left.withColumn("band_slot", F.explode(slots))
    b = right.withColumn("band_slot", F.floor(F.col(right_time) / wide))
    return a.join(b, [*keys, "band_slot"]).where((F.col(right_time) >= F.col(left_time) - below) & (F.col(right_time) <= F.col(left_time) + above)).drop("band_slot")


def first_by(df: DataFrame, keys: list[str], *order: Column | str, rows: int = 1) -> DataFrame:
    """The first `rows` rows of each key in an order that has no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("first_by", F.row_number().over(w)).where(F.col("first_by") <= rows).drop("first_by")


def ordered_sum(value: Column, *order: str) -> Column:
    """Sum over a bounded group in an order that has no ties, so that its last digits, and what they decide, don't
    depend on where rows lie; NULL without a value."""
    items = F.array_sort(F.collect_list(F.struct(*order, value.cast("double").alias("ordered_value"))))
    return F.when(F.count(value) > 0, F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(x["ordered_value"], F.lit(0.0))))


def mode_by(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, value, weight): the value with the largest summed weight, the smallest one on a tie."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("weight"))
    return first_by(sums, keys, F.desc("weight"), F.col(value))
