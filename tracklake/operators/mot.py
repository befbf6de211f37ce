"""Multi-object tracking scores: HOTA, CLEAR and identity scores, by their published definitions.

Boxes of a frame are paired by an equi-join; sums over frames are aggregations. Python only runs for
assignments (of one frame's boxes, or of one match's ids) and for CLEAR, whose matches depend on the frame before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geometry import box, iou
from tracklake.operators.folds import ordered_fold

ALPHAS = [round(0.05 * k, 2) for k in range(1, 20)]
_EPS = 1e-9


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment with the greatest sum of non-negative scores; pairs of
    score 0 are left out. Shortest augmenting paths with potentials."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score).astype(np.float64)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            row = owner[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            j = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[j]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            if not owner[j]:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    found = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) if flip else (r, c) for r, c in found if -cost[r, c] > 0)


def pairs(truth: DataFrame, found: DataFrame, match: list[str]) -> DataFrame:
    """(match, frame_id, truth_id, found_id, iou) of boxes (x1, y1, x2, y2) of a frame that overlap."""
    t = truth.select(*match, "frame_id", "truth_id", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    f = found.select(*match, "frame_id", "found_id", *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")])
    return t.join(f, [*match, "frame_id"]).select(*match, "frame_id", "truth_id", "found_id", iou(box("t_"), box("f_")).alias("iou")).where("iou > 0")


def _totals(truth: DataFrame, found: DataFrame, match: list[str]) -> DataFrame:
    t, f = truth.groupBy(*match).agg(F.count("*").alias("n_truth")), found.groupBy(*match).agg(F.count("*").alias("n_found"))
    return t.join(f, match, "full").na.fill(0, ["n_truth", "n_found"])


def _assigned(scored: DataFrame, match: list[str], frames: int = 512) -> DataFrame:
    """The pairs that each frame's assignment by `score` takes; a task has some frames of a match."""
    kinds = dict(scored.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame_id")
        frame, score = t["frame_id"].to_numpy(), t["score"].to_numpy()
        rows, cols = (t[c].to_numpy(zero_copy_only=False) for c in ("truth_id", "found_id"))
        keep = []
        for part in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(frame)) + 1):
            r, ri = np.unique(rows[part], return_inverse=True)
            c, ci = np.unique(cols[part], return_inverse=True)
            matrix, at = np.zeros((len(r), len(c))), np.zeros((len(r), len(c)), dtype=np.int64)
            matrix[ri, ci], at[ri, ci] = score[part], part
            keep += [int(at[x]) for x in assignment(matrix)]
        return t.take(pa.array(keep, pa.int64())).select([*match, "frame_id", "truth_id", "found_id", "iou"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*match, "frame_id", "truth_id", "found_id", "iou"))
    return scored.groupBy(*match, F.expr(f"frame_id div {frames}")).applyInArrow(run, schema)


def hota(truth: DataFrame, found: DataFrame, match: list[str]) -> DataFrame:
    """hota, det_a, ass_a and loc_a of each match, means over the thresholds ALPHAS."""
    p = pairs(truth, found, match)
    by_t, by_f = (F.sum("iou").over(Window.partitionBy(*match, "frame_id", c)) for c in ("truth_id", "found_id"))
    ids = [*match, "truth_id", "found_id"]
    likely = p.withColumn("part", F.col("iou") / (by_t + by_f - F.col("iou"))).groupBy(*ids).agg(F.sum("part").alias("likely"))
    nt = truth.groupBy(*match, "truth_id").agg(F.count("*").alias("nt"))
    nf = found.groupBy(*match, "found_id").agg(F.count("*").alias("nf"))
    align = likely.join(nt, [*match, "truth_id"]).join(nf, [*match, "found_id"])
    scored = p.join(align.select(*ids, "nt", "nf", (F.col("likely") / (F.col("nt") + F.col("nf") - F.col("likely"))).alias("align")), ids)
    taken = _assigned(scored.withColumn("score", F.col("align") * F.col("iou")), match)
    grid = F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha")
    hit = taken.select("*", grid).where(F.col("iou") >= F.col("alpha") - _EPS)
    c = hit.groupBy(*ids, "alpha").agg(F.count("*").alias("c"), F.sum("iou").alias("overlap")).join(nt, [*match, "truth_id"]).join(nf, [*match, "found_id"])
    s = c.groupBy(*match, "alpha").agg(F.sum("c").alias("tp"), F.sum("overlap").alias("overlap"), F.sum(F.col("c") * F.col("c") / (F.col("nt") + F.col("nf") - F.col("c"))).alias("ass"))
    every = _totals(truth, found, match).select("*", grid).join(s, [*match, "alpha"], "left").na.fill(0, ["tp"])
    det = F.col("tp") / F.greatest(F.col("n_truth") + F.col("n_found") - F.col("tp"), F.lit(1))
    ass = F.when(F.col("tp") > 0, F.col("ass") / F.col("tp")).otherwise(F.lit(0.0))
    loc = F.when(F.col("tp") > 0, F.col("overlap") / F.col("tp")).otherwise(F.lit(1.0))
    return every.groupBy(*match).agg(F.avg(F.sqrt(det * ass)).alias("hota"), F.avg(det).alias("det_a"), F.avg(ass).alias("ass_a"), F.avg(loc).alias("loc_a"))


def clear(truth: DataFrame, found: DataFrame, match: list[str], threshold: float = 0.5) -> DataFrame:
    """mota, motp, id switches, false positives and misses of each match; a match of the frame before is preferred."""
    both = truth.select(*match, "frame_id").distinct().join(found.select(*match, "frame_id"), [*match, "frame_id"], "left_semi")
    rows = pairs(truth, found, match).where(F.col("iou") >= threshold - _EPS)
    rows = both.join(rows, [*match, "frame_id"], "left")

    def fold(items: Iterator[dict]) -> Iterator[tuple]:
        last: dict = {}
        before: dict = {}
        frame: list[dict] = []
        tp, switches, overlap = 0, 0, 0.0

        def close() -> None:
            nonlocal before, tp, switches, overlap
            t, f = sorted({r["truth_id"] for r in frame}), sorted({r["found_id"] for r in frame})
            score = np.zeros((len(t), len(f)))
            for r in frame:
                score[t.index(r["truth_id"]), f.index(r["found_id"])] = r["iou"] + 1000.0 * (before.get(r["truth_id"]) == r["found_id"])
            now = {t[i]: f[j] for i, j in assignment(score)} if frame else {}
            tp += len(now)
            overlap += sum(r["iou"] for r in frame if now.get(r["truth_id"]) == r["found_id"])
            switches += sum(k in last and last[k] != x for k, x in now.items())
            last.update(now)
            before = now

        at = None
        for r in items:
            if at is not None and r["frame_id"] != at:
                close()
                frame.clear()
            at = r["frame_id"]
            if r["truth_id"] is not None:
                frame.append(r)
        if at is not None:
            close()
        yield tp, switches, overlap

    s = ordered_fold(rows, match, ["frame_id", "truth_id", "found_id"], fold, "tp long, id_switches long, overlap double")
    every = _totals(truth, found, match).join(s, match, "left").na.fill(0, ["tp", "id_switches", "overlap"])
    return every.select(*match, F.when(F.col("n_truth") > 0, (2 * F.col("tp") - F.col("n_found") - F.col("id_switches")) / F.col("n_truth")).alias("mota"), F.when(F.col("tp") > 0, F.col("overlap") / F.col("tp")).alias("motp"), "id_switches", (F.col("n_found") - F.col("tp")).alias("false_positives"), (F.col("n_truth") - F.col("tp")).alias("misses"))


def identity_scores(truth: DataFrame, found: DataFrame, match: list[str], threshold: float = 0.5) -> DataFrame:
    """idf1, id precision and id recall of each match, by the one-to-one assignment of ids that shares most boxes."""
    n = pairs(truth, found, match).where(F.col("iou") >= threshold - _EPS).groupBy(*match, "truth_id", "found_id").agg(F.count("*").cast("double").alias("score"))
    n = n.withColumns({"frame_id": F.lit(0).cast("long"), "iou": F.col("score")})
    s = _assigned(n, match).groupBy(*match).agg(F.sum("iou").alias("idtp"))
    every = _totals(truth, found, match).join(s, match, "left").na.fill(0, ["idtp"])
    part = lambda den: F.when(den > 0, F.col("idtp") / den)
    return every.select(*match, part((F.col("n_truth") + F.col("n_found")) / 2).alias("idf1"), part(F.col("n_found")).alias("idp"), part(F.col("n_truth")).alias("idr"))
