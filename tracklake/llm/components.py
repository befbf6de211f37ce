"""Connected components of a table of links, by distributed min-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.cluster import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b); the component is its smallest node.

    Alternates two star steps (each node hands its larger, then its smaller neighbours to the
    smallest one it knows) until every edge points straight at its component; stars, which
    is what pivots give, are done after one turn. Only counts come to the driver.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: all larger neighbours of a node point at the smallest of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point at the smallest of them
        down = materialise(large)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        new = materialise(down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(down)
        # done once each node points at one only, and none that is pointed at points on
        onward = new.select(F.col("v").alias("u")).distinct().join(new.select("u").distinct(), "u", "left_semi").limit(1).count()
        if not onward and not new.groupBy("u").count().where("count > 1").limit(1).count():
            break
        discard(edges)
        edges = new
    discard(edges)
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
