"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search.

All functions take a sequence of non-negative integer codes (bytes, word numbers). They
hold one shard in memory; callers size shards, so memory doesn't follow the corpus.
"""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray, depth: int, positions: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of `codes` in lexicographic order of their first `depth` codes.

    Larsson-Sadakane: suffixes are put in order by one code, then groups that still tie
    are refined by the group number of the suffix h further on, h = 1, 2, 4, ...; groups
    of one are done and never touched again. A suffix that ends is smaller than any that
    goes on. Refinement stops once h reaches `depth`, so ties of that length may remain,
    in order of position. With `positions`, only these suffixes are returned (group
    numbers are kept for all, as refinement needs them).
    """
    n = len(codes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    first = codes[order]
    start = np.concatenate([[True], first[1:] != first[:-1]])
    slot = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    group = np.empty(n + 1, dtype=np.int64)  # group[n]: past the end
    group[order] = slot
    group[n] = -1
    tied = _tied(start)
    h = 1
    while h < depth and len(tied):
        at = order[tied]
        key = group[at] * np.int64(n + 1) + group[np.minimum(at + h, n)] + 1
        new = np.argsort(key, kind="stable")
        at, key = at[new], key[new]
        order[tied] = at
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        group[at] = tied[np.maximum.accumulate(np.where(begins, np.arange(len(tied)), 0))]
        single = begins & np.concatenate([begins[1:], [True]])
        tied = tied[~single]
        h *= 2
    if positions is not None:
        wanted = np.zeros(n, dtype=bool)
        wanted[positions] = True
        order = order[wanted[order]]
    return order


def _tied(start: np.ndarray) -> np.ndarray:
    """Slots of groups of two or more, given where groups start."""
    single = start & np.concatenate([start[1:], [True]])
    return np.flatnonzero(~single)


def kasai(codes: np.ndarray, order: np.ndarray, limit: int, stripes: int = 2048) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in `order`, at most `limit`.

    Kasai's scan in text order: the length for position i + 1 is that for i less one, or
    more. The text is cut in stripes that run in lockstep, so that each step is one numpy
    operation over all stripes; a stripe starts from length 0.
    """
    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    text = np.concatenate([codes.astype(np.int64), [-1]])
    stripes = max(1, min(stripes, n // 64 or 1))
    bounds = np.linspace(0, n, stripes + 1).astype(np.int64)
    i, end = bounds[:-1].copy(), bounds[1:]
    h = np.zeros(stripes, dtype=np.int64)
    plcp = np.zeros(n, dtype=np.int64)
    live = i < end
    i, end, h = i[live], end[live], h[live]
    while len(i):
        j = before[i]
        ok = (j >= 0) & (h < limit)
        ri, rj = i + h, j + h
        ok &= (ri < n) & (rj < n)
        ok &= text[np.minimum(ri, n)] == text[np.clip(rj, 0, n)]
        done = ~ok
        plcp[i[done]] = np.where(j[done] >= 0, h[done], 0)
        # past `limit` the order is one of positions, so the length carries over only along one pair
        carry = (j >= 0) & ((h < limit) | (before[np.minimum(i + 1, n - 1)] == j + 1))
        h = np.where(ok, h + 1, np.where(carry, np.maximum(h - 1, 0), 0))
        i = i + done
        live = i < end
        if not live.all():
            i, end, h = i[live], end[live], h[live]
    out[:] = plcp[order]
    return out


def search(codes: np.ndarray, order: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (a row, `lengths` codes of it count), the range [low, high) of
    `order` whose suffixes begin with it. One binary search for all queries at once."""
    n, width = len(order), queries.shape[1]
    padded = np.concatenate([codes.astype(np.int64), np.full(width, -1, dtype=np.int64)])
    steps = np.arange(width)
    counts = steps[None, :] < lengths[:, None]

    def bound(upper: bool) -> np.ndarray:
        low = np.zeros(len(queries), dtype=np.int64)
        high = np.full(len(queries), n, dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            diff = padded[order[mid][:, None] + steps] - queries[open_]
            diff = np.where(counts[open_], diff, 0)
            differs = diff != 0
            at = differs.argmax(axis=1)
            sign = np.sign(diff[np.arange(len(open_)), at])  # 0: the suffix begins with the query
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]

    return bound(False), bound(True)
