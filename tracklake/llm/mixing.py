"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Among all document rates between 0 and `cap`, the ones
nearest to 1 in (bounded) relative entropy that meet the targets have the form
rate = cap / (1 + (cap - 1) * exp(-l * x)), x being the document's size over the mean size
of its source: the odds rate / (cap - rate) are tilted exponentially by the multiplier l
of the source. The multipliers solve the convex dual; each Newton step is one distributed
aggregation over counts of equal sizes, for all sources at once, kept inside a bracket so
that it can't diverge. Rates are then rounded to whole copies: within blocks of a source,
from the longest document down, each takes the number of copies next to its rate that
brings the running total nearest to what the rates ask for.

Edge cases: null and empty texts have size 0, take no copies and don't count; a null source
is a source of its own, last in order; an empty table gives an empty result; repeated rows
take copies each on its own, those of one id and size in any order, as they are alike; all other columns are kept, but
columns with the names of the operator's own (OUTPUTS, and `copy` in `repeat`) give way to these. Texts are
counted whole. Multipliers are rounded to 6 digits once they have converged, so that the order of
summation doesn't show in reruns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.cluster import discard, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
MAX_STEPS = 60
TOLERANCE = 1e-9
OUTPUTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
BLOCK_ROWS = 2048
BLOCK_WORDS = 1_000_000
#: Up to so many sources (a row of some 100 bytes each) are broadcast; more are joined by key.
BROADCAST_SOURCES = 20_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, col: str) -> DataFrame:
    """Adds `rank`, from 0, by code point, null last; sorted in ranges, not in one task."""
    ordered = materialise(sources.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    before = parts.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col(col).asc_nulls_last())) - 1
    return ordered.withColumn("w", within).join(before, "part").withColumn("rank", F.col("w") + F.col("before")).drop("part", "w", "before")


def source_targets(histogram: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, docs, target) from (source, size, n).

    Targets share `share` times all sizes by weight; one that is over `cap` times its
    source's size stops there and the rest is shared anew, until none is above. The level
    (words for each unit of weight) only rises, so a few passes over the sources do.
    """
    sums = histogram.groupBy(source).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialise(ranked(sums, source).withColumn("weight", weight).drop("rank"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit, level, capped = F.col("source_size") * F.lit(float(cap)), 0.0, -1
    while True:
        under = limit >= F.col("weight") * F.lit(level)
        r = sources.agg(F.sum(F.when(under, F.col("weight"))), F.sum(F.when(~under, limit)), F.count(F.when(~under, 1))).first()
        if r[2] == capped or not r[0]:
            break
        capped, level = r[2], (share * total - (r[1] or 0.0)) / r[0]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit)).drop("weight")


def _join(rows: DataFrame, sources: DataFrame, source: str, n_sources: int) -> DataFrame:
    right = sources.withColumnRenamed(source, "mix_source")
    on = F.col(source).eqNullSafe(F.col("mix_source"))
    return rows.join(F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right, on).drop("mix_source")


def rate(cap: float, multiplier: Column, x: Column) -> Column:
    return F.lit(float(cap)) / (1 + F.lit(float(cap - 1)) * F.exp(-multiplier * x))


def solve(histogram: DataFrame, targets: DataFrame, source: str = "source", cap: float = CAP) -> DataFrame:
    """Adds `multiplier` to targets: infinite where a source takes all it can, null where it
    has no words; Newton's steps on the dual, one aggregation each."""
    size, full = F.col("source_size"), F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = targets.select(source, "source_size", "docs", "target", F.lit(0.0).alias("l"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (full | (size == 0)).alias("done"))
    state = materialise(state)
    n_sources = state.count()
    for _ in range(MAX_STEPS):
        if not state.where(~F.col("done")).limit(1).count():
            break
        x = F.col("size") * F.col("docs") / F.col("source_size")
        r = rate(cap, F.col("l"), x)
        words = F.col("size") * F.col("n")
        # a source's steps stop once it is done; others go on
        sums = _join(histogram.where("size > 0"), state.where(~F.col("done")), source, n_sources).groupBy(source).agg(F.sum(words * r).alias("taken"), F.sum(words * x * r * (cap - r) / cap).alias("slope"))
        s = state.join(sums.withColumnRenamed(source, "sum_source"), F.col(source).eqNullSafe(F.col("sum_source")), "left")
        off = F.col("taken") - F.col("target")
        low = F.when(off < 0, F.col("l")).otherwise(F.col("low"))
        high = F.when(off >= 0, F.col("l")).otherwise(F.col("high"))
        most = F.abs("l") + 2
        step = F.greatest(-most, F.least(most, F.coalesce(F.when(F.col("slope") > 0, -off / F.col("slope")), F.signum(-off) * most)))
        new = F.col("l") + step
        new = F.when((low.isNotNull() & (new <= low)) | (high.isNotNull() & (new >= high)), F.coalesce((low + high) / 2, F.col("l") + F.signum(-off) * most)).otherwise(new)
        near = F.abs(off) <= TOLERANCE * F.col("target")
        old, state = state, materialise(s.select(source, "source_size", "docs", "target", F.when(F.col("done") | near, F.col("l")).otherwise(new).alias("l"), low.alias("low"), high.alias("high"), (F.col("done") | near).alias("done")))
        discard(old)
    found = F.when(size == 0, F.lit(None)).when(full, F.lit(float("inf"))).otherwise(F.round("l", 6))
    return state.select(source, "source_size", "docs", "target", found.alias("multiplier"))


def copies_of(size: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies of the documents of one block, in the order given (longest first)."""
    out = np.zeros(len(size), dtype=np.int64)
    owed = 0.0
    for k, (n, r) in enumerate(zip(size.tolist(), rates.tolist(), strict=True)):
        if n == 0:
            continue
        owed += r * n
        low = int(r)
        c = low + 1 if r > low and abs(owed - (low + 1) * n) < abs(owed - low * n) else low
        out[k] = c
        owed -= c * n
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Columns `keep` (all by default) of each document, with mix_size, mix_source_size,
    mix_target and mix_copies."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUTS]
    sized = docs.select(F.col(id_col).alias("mix_id"), F.col(source).alias("mix_src"), word_count(text).alias("size"), F.struct(*keep).alias("mix_row"))
    histogram = materialise(sized.groupBy("mix_src", "size").agg(F.count("*").alias("n")))
    solved = materialise(solve(histogram, source_targets(histogram, "mix_src", weights, share, cap), "mix_src", cap))
    rows = _join(sized, solved, "mix_src", solved.count())
    x = F.col("size") * F.col("docs") / F.col("source_size")
    r = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("multiplier") == F.lit(float("inf")), F.lit(float(cap))).otherwise(F.round(rate(cap, F.col("multiplier"), x), 9))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_ROWS), F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1))
    rows = rows.select("mix_id", "mix_src", "mix_row", "size", "source_size", "target", r.alias("rate"), F.pmod(F.xxhash64("mix_id", "size"), blocks).alias("block"))

    def rounded(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("mix_id", "ascending")])
        return t.append_column("copies", pa.array(copies_of(t["size"].to_numpy(), t["rate"].to_numpy())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.groupBy("mix_src", "block").applyInArrow(rounded, fields + ", copies long")
    return out.select(*[F.col("mix_row")[c].alias(c) for c in keep], F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"))


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy taken: columns and `copy`, from 1."""
    return mixed.where("mix_copies > 0").select(*[c for c in columns if c != "copy"], F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy"))
