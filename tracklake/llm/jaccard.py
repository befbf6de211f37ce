"""Exact n-gram Jaccard self-join: rare-first prefix filtering, filters, one check per pair.

A document is the set of its distinct word n-grams (64-bit hashes of lower-cased words).

1. Documents with the same set are one node from the start (its key is a hash of the set). Each
   set has a parity signature of a quarter byte an n-gram; the n-grams in which two sets
   differ are at least as many as the places in which their signatures do.
2. Sketches of fixed size count n-grams and words. N-grams are ordered by how far the count of their place
   is above the usual one (which only frequent n-grams raise) and by the product of the frequencies of
   their words, so rare ones come first. Any order is right, as long as all tasks use the same;
   the counts only make it a good one.
3. Of each set the first n - ceil(t * n) + 1 n-grams in that order are its prefix. Two sets
   that link share a prefix n-gram. Prefix entries are packed into buckets by n-gram; equal
   sets of one task are sent once. An n-gram that is very frequent is dealt
   over several buckets.
4. In a bucket, pairs that share an n-gram must pass the length filter and the positional
   filter. Groups of two give a pair. In larger groups each member is paired with a pivot, the
   smallest key of its range of keys, and these with the pivots of wider ranges, so that no
   pivot has many partners; the members are also kept for step 6. Pairs are made distinct.
5. Pairs pass the suffix filter (by their signatures), are joined with their texts and are
   checked exactly, once each. Texts lie in a table bucketed by key, so that only pairs are
   shuffled to them.
6. Components of the links: a group whose members all are in one component needs no more
   pairs, as further links couldn't change anything; of groups of the same members one is
   enough. In groups that are still split, small ones give all their pairs across components. In
   large ones each member is paired with the sets of other components whose signatures are
   nearest, and a group that has no more is done: 4, then 64, 1024, ... in each round, until none
   is left unchecked. So no link between components is lost, and large groups of near copies
   are never expanded into all pairs.

Edge cases: null and empty texts, and those without words, have size 0 and link with nothing;
texts of fewer words than n are one n-gram; repeated rows share a node; rows that share an
id but not a text keep a component each; a null id never names a component unless all ids of
it are null; an empty table gives an empty result. Texts are read whole, a long one as a slice of
its own. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import textops as X
from tracklake.llm.cluster import bucketed, discard, materialise, shuffle_partitions, tree_sum
from tracklake.llm.components import components

WIDTH = 4
PERCENT = 85
SKETCH_BITS, WORD_BITS = 17, 18
#: Bits of an n-gram's hash in a prefix entry: equal ones only make candidates.
GRAM_BITS = 48
#: Entries of one n-gram that one bucket may get before they are dealt over several, and entries of a bucket.
HOT, BUCKET = 20_000, 2_000_000
FLUSH = 200_000
#: Partners of a pivot.
FAN_BITS = 6
#: Members of a split group that one task compares with as many others.
BLOCK = 4000
#: Groups of up to so many members give all their pairs; tasks of these groups have so many members.
SMALL, SMALL_TASK = 64, 100_000
#: Bytes to which signatures are folded in large groups.
BRIEF = 512
_ENTRY = np.dtype([("gram", "<i8"), ("key", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a slice, and the first word of each document."""
    buf = X.lower_ascii(buf)
    start, end, firsts = X.word_spans(buf, offsets)
    return X.span_hash(X.prefix_hash(buf), start, end), firsts


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct n-grams of each document of a slice."""
    word, firsts = words(buf, offsets)
    grams = X.combine(word, width)
    for k in range(len(offsets) - 1):
        a, b = int(firsts[k]), int(firsts[k + 1])
        if b - a >= width:
            g = np.sort(grams[a : b - width + 1])
            yield g[np.concatenate([[True], g[1:] != g[:-1]])]
        elif b > a:
            yield X.combine(word[a:b], b - a)
        else:
            yield grams[:0]


def ranked_sets(buf: np.ndarray, offsets: np.ndarray, width: int, cost: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of a slice, and of each n-gram its rank: the summed costs of its words and its own, by their places, then its hash."""
    word, firsts = words(buf, offsets)
    grams = X.combine(word, width)
    each = cost[(word >> np.uint64(64 - (int(cost.size).bit_length() - 1))).astype(np.int64)].astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    for k in range(len(offsets) - 1):
        a, b = int(firsts[k]), int(firsts[k + 1])
        if b - a >= width:
            g = grams[a : b - width + 1]
            order = np.argsort(g)
            order = order[np.concatenate([[True], np.diff(g[order]) != 0])]
            at = a + order
            extra = own[(g[order] >> np.uint64(64 - (int(own.size).bit_length() - 1))).astype(np.int64)].astype(np.uint64)
            yield g[order], (np.minimum(total[at + width] - total[at] + extra, np.uint64(0xFFFF)) << np.uint64(48)) | (g[order] & np.uint64((1 << 48) - 1))
        elif b > a:
            g = X.combine(word[a:b], b - a)
            yield g, g & np.uint64((1 << 48) - 1)
        else:
            yield grams[:0], grams[:0]


def set_key(grams: np.ndarray) -> int:
    if not len(grams):
        return 0
    total = X.mix(grams + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(X.mix(np.array([total + np.uint64(len(grams))], dtype=np.uint64))[0].astype(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


class Seen:
    """Whether a task has given a key before; forgets all now and then, as a key given twice does no harm."""

    def __init__(self, most: int = 200_000):
        self._keys: set[int] = set()
        self._most = most

    def new(self, key: int) -> bool:
        if key in self._keys:
            return False
        if len(self._keys) >= self._most:
            self._keys.clear()
        self._keys.add(key)
        return True


def signature(grams: np.ndarray) -> bytes:
    """Parity of the number of n-grams at each of 2**k places, at least two for each n-gram. Two
    signatures differ in no more places than the sets in n-grams; the longer one folds."""
    bits = 64
    while bits < 2 * len(grams):
        bits *= 2
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sign: bytes, most: int) -> bytes:
    """The signature over at most `most` bytes."""
    x = np.frombuffer(sign, np.uint64)
    while x.nbytes > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def signatures_allow(a: bytes, na: int, b: bytes, nb: int, percent: int) -> bool:
    """Whether the length filter and the signatures allow a link.

    |A ^ B| = n - 2o and (100 + t) o >= t n, so (100 + t) |A ^ B| <= (100 - t) n.
    """
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    size = min(len(a), len(b))
    x, y = np.frombuffer(folded(a, size), np.uint64), np.frombuffer(folded(b, size), np.uint64)
    return (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * (na + nb)


def sets(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """id, n, key of each document; sign, where a task gives the key first, and brief, sign in at most
    BRIEF bytes where it is longer."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            n, key, sign = [], [], []
            for s in X.slices(b.column(1)):
                for g in shingle_sets(s.buf, s.offsets, width):
                    n.append(len(g))
                    key.append(set_key(g))
                    sign.append(signature(g) if len(g) and seen.new(key[-1]) else None)
            brief = [folded(x, BRIEF) if x and len(x) > BRIEF else None for x in sign]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sign, pa.binary()), pa.array(brief, pa.binary())], names=["id", "n", "key", "sign", "brief"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n long, key long, sign binary, brief binary")


def sketch(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by place of their hash (2**SKETCH_BITS) and words by place of theirs (2**WORD_BITS),
    summed over all tasks in pieces."""
    size, both = 8192, (1 << SKETCH_BITS) + (1 << WORD_BITS)
    pieces = both // size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(both, dtype=np.int64)
        grams, single = total[: 1 << SKETCH_BITS], total[1 << SKETCH_BITS :]
        for b in batches:
            for s in X.slices(b.column(0)):
                word, firsts = words(s.buf, s.offsets)
                each = X.combine(word, width)[X.windows(firsts, width)[: max(0, len(word) - width + 1)]]
                grams += np.bincount((each >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                single += np.bincount((word >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in np.split(total, pieces)], pa.binary())], names=["piece", "counts"])

    rows = tree_sum(docs.select(text).mapInArrow(run, "piece int, counts binary"), size).collect()
    total = np.zeros((pieces, size), dtype=np.int64)
    for r in rows:
        total[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    total = total.reshape(-1)
    return total[: 1 << SKETCH_BITS], total[1 << SKETCH_BITS :]


def shares(counts: np.ndarray) -> np.ndarray:
    """Buckets over which the n-grams of each place are dealt."""
    usual = max(1, int(np.median(counts)))
    return (1 + np.maximum(counts - 2 * usual, 0) // HOT).astype(np.int64)


def pack(e: np.ndarray) -> bytes:
    """Entries, sorted by n-gram, as byte planes."""
    e = e[np.argsort(e["gram"], kind="stable")]
    planes = [np.diff(e["gram"], prepend=np.int64(0)), e["key"], e["n"], e["pos"]]
    return pa.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(p).view(np.uint8).reshape(len(e), -1).T).tobytes() for p in planes), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=_ENTRY.itemsize * n, codec="zstd", asbytes=True), np.uint8)
    e, at = np.empty(n, _ENTRY), 0
    for name in _ENTRY.names:
        size = _ENTRY[name].itemsize
        e[name] = np.ascontiguousarray(flat[at * n : (at + size) * n].reshape(size, n).T).view(_ENTRY[name]).reshape(n)
        at += size
    e["gram"] = np.cumsum(e["gram"])
    return e


def entries(docs: DataFrame, text: str, width: int, percent: int, counts: np.ndarray, single: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, size, payload): packed prefix entries of all documents; equal sets of a task once."""
    bits = int(counts.size).bit_length() - 1
    cost = np.minimum(np.log2(1 + single) * 64, 4095).astype(np.uint16)
    spread = shares(counts)
    own = (np.log2(1 + np.maximum(counts - 2 * max(1, int(np.median(counts))), 0)) * 256).astype(np.uint16)
    sent = docs.sparkSession.sparkContext.broadcast((cost, own, spread))  # 2**WORD_BITS * 2 and 2**SKETCH_BITS * 10 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, own, spread = sent.value
        seen = Seen()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            e = np.concatenate(held)
            g = e["gram"].view(np.uint64)
            deal = spread[(g >> np.uint64(GRAM_BITS - bits)).astype(np.int64)]
            sub = np.mod(e["key"], deal).astype(np.uint64)
            bucket = (X.mix(g + sub * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            parts = np.split(e, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([len(x) for x in parts], pa.int32()), pa.array([pack(x) for x in parts], pa.binary())], names=["bucket", "size", "payload"])

        for b in batches:
            for s in X.slices(b.column(0)):
                for g, rank in ranked_sets(s.buf, s.offsets, width, cost, own):
                    n = len(g)
                    key = set_key(g)
                    if not n or not seen.new(key):
                        continue
                    p = prefix_length(n, percent)
                    at = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
                    at = at[np.argsort(rank[at])]
                    e = np.empty(p, dtype=_ENTRY)
                    e["gram"], e["key"], e["n"], e["pos"] = (g[at] >> np.uint64(64 - GRAM_BITS)).view(np.int64), key, n, np.arange(p)
                    held.append(e)
                    size += p
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return docs.select(text).mapInArrow(run, "bucket int, size int, payload binary")


def may_link(n1, p1, n2, p2, percent: int):
    """Length and positional filter for two sets that share an n-gram at places p1 and p2.

    Linked sets share o n-grams with (100 + percent) * o >= percent * (n1 + n2); at most
    min(p1, p2) of them come before this one and min(n - p - 1) after.
    """
    length = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return length & ((100 + percent) * most >= percent * (n1 + n2))


def pivot_pairs(e: np.ndarray, group: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of keys: each entry with the smallest key of its range of keys in its group, and these with
    those of ranges 2**FAN_BITS as wide, up to the whole group. Entries are sorted by group and key."""
    n, key = e["n"].astype(np.int64), e["key"].view(np.uint64)
    bits = np.ceil(np.log2(np.maximum(count, 1) / (1 << FAN_BITS))).astype(np.int64).clip(0)[group]
    at, out = np.arange(len(e)), [np.empty((0, 2), np.int64)]
    while len(at):
        span = np.where(bits[at] > 0, key[at] >> (64 - np.maximum(bits[at], 1)).astype(np.uint64), 0)
        order = np.lexsort((key[at], span, group[at]))
        at, span = at[order], span[order]
        head = np.concatenate([[True], (group[at][1:] != group[at][:-1]) | (span[1:] != span[:-1])])
        pivot = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        a, b = pivot[~head], at[~head]
        ok = may_link(n[a], e["pos"][a], n[b], e["pos"][b], percent)
        out.append(np.stack([e["key"][a[ok]], e["key"][b[ok]]], axis=1))
        at = at[head]
        at = at[bits[at] > 0]
        bits = (bits - FAN_BITS).clip(0)
    pairs = np.sort(np.concatenate(out), axis=1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def candidates(packed: DataFrame, percent: int, hot: np.ndarray, bits: int) -> DataFrame:
    """Rows of two kinds: pairs to check (a, b), and members (gram, a, n, pos) of groups of three
    or more, or of n-grams whose places are in `hot`, as other buckets have the rest of these."""

    def run(t: pa.Table) -> pa.Table:
        e = np.concatenate([unpack(x.as_py(), n.as_py()) for x, n in zip(t["payload"], t["size"], strict=True)])
        e = e[np.lexsort((e["key"], e["gram"]))]
        keep = np.ones(len(e), dtype=bool)
        keep[1:] = (e["gram"][1:] != e["gram"][:-1]) | (e["key"][1:] != e["key"][:-1])
        e = e[keep]
        first = np.flatnonzero(np.concatenate([[True], e["gram"][1:] != e["gram"][:-1]]))
        count = np.diff(np.concatenate([first, [len(e)]]))
        # most n-grams are in one set only
        shared = np.repeat((count > 1) | np.isin(e["gram"][first] >> (GRAM_BITS - bits), hot), count)
        e = e[shared]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(e)), bool), e["gram"][1:] != e["gram"][:-1]]))
        count = np.diff(np.concatenate([first, [len(e)]]))
        group = np.repeat(np.arange(len(first)), count)
        pairs = pivot_pairs(e, group, count, percent)
        big = e[(count > 2)[group] | np.isin(e["gram"] >> (GRAM_BITS - bits), hot)]
        z = len(pairs)
        none = lambda k: pa.nulls(k, pa.int64())
        join = lambda *x: pa.chunked_array([y if isinstance(y, pa.Array) else pa.array(y) for y in x], pa.int64())
        return pa.table({
            "a": join(pairs[:, 0], big["key"]), "b": join(pairs[:, 1], none(len(big))), "gram": join(none(z), big["gram"]),
            "n": join(none(z), big["n"].astype(np.int64)), "pos": join(none(z), big["pos"].astype(np.int64)),
        })

    return packed.groupBy("bucket").applyInArrow(run, "a long, b long, gram long, n long, pos long")


def _fold(m: np.ndarray) -> np.ndarray:
    half = m.shape[1] // 2
    return m[:, :half] ^ m[:, half:]


def best_pairs(keys: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, signs: list[bytes], percent: int, each: int, left: np.ndarray, right: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Pairs, and whether some are left for later. For each set, its `each` most similar ones, by signature,
    among sets of other components that may link; pairs of a `left` with a `right` only. Sets of the
    largest component are only ever partners, as each pair across components has another side."""
    words = np.array([len(x) // 8 for x in signs])
    classes = {w: np.flatnonzero(words == w) for w in np.unique(words)}
    rows = {w: np.stack([np.frombuffer(signs[k], np.uint64) for k in at]) for w, at in classes.items()}
    values, counts = np.unique(comp, return_counts=True)
    out, more = [], False
    for i in np.flatnonzero(comp != values[counts.argmax()]):
        mine = rows[words[i]][np.searchsorted(classes[words[i]], i)][None, :]
        near, apart = [], []
        for w, at in classes.items():
            ok = (comp[at] != comp[i]) & may_link(n[i], pos[i], n[at], pos[at], percent)
            ok &= (left[i] & right[at]) | (right[i] & left[at])
            if not ok.any():
                continue
            own, other = mine, rows[w][ok]
            while other.shape[1] > own.shape[1]:
                other = _fold(other)
            while own.shape[1] > other.shape[1]:
                own = _fold(own)
            d = np.bitwise_count(own ^ other).sum(axis=1).astype(np.int64)
            fits = (100 + percent) * d <= (100 - percent) * (n[i] + n[at[ok]])
            near.append(at[ok][fits])
            apart.append(d[fits])
        if not near:
            continue
        near, apart = np.concatenate(near), np.concatenate(apart)
        more |= len(near) > each
        best = near[np.lexsort((keys[near], apart))][:each]
        out += [(int(min(keys[i], keys[j])), int(max(keys[i], keys[j]))) for j in best]
    return out, more


def nearest(members: DataFrame, percent: int, each: int) -> DataFrame:
    """Pairs (a, b) to check next among members (gram, key, n, pos, c, brief) of large groups, and (gram) of
    groups that have more for later rounds. A group of very many members is cut into blocks, and its
    pairs of blocks are tasks of their own, so that memory stays bounded."""
    m = members.withColumn("blocks", 1 + F.floor(F.col("m") / BLOCK)).withColumn("own", F.pmod("key", "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    m = m.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        col = {c: t[c].to_numpy() for c in ("key", "n", "pos", "c", "own")}
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        pairs, more = best_pairs(col["key"], col["n"], col["pos"], col["c"], t["brief"].to_pylist(), percent, each, col["own"] == low, col["own"] == high)
        found = np.unique(np.array(pairs, dtype=np.int64).reshape(-1, 2), axis=0)
        rest = [t["gram"][0].as_py()] if more else []
        none = pa.nulls(len(rest), pa.int64())
        return pa.table({"a": pa.chunked_array([pa.array(found[:, 0]), none]), "b": pa.chunked_array([pa.array(found[:, 1]), none]), "gram": pa.array([None] * len(found) + rest, pa.int64())})

    return m.select("gram", "low", "high", "own", "key", "n", "pos", "c", "brief").groupBy("gram", "low", "high").applyInArrow(run, "a long, b long, gram long")


def all_pairs(members: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(a, b, gram): all pairs across components that may link in groups of up to SMALL members, many groups a task."""

    def run(t: pa.Table) -> pa.Table:
        gram, keys, n, pos, comp = (t[c].to_numpy() for c in ("gram", "key", "n", "pos", "c"))
        order = np.lexsort((keys, gram))
        gram, keys, n, pos, comp = gram[order], keys[order], n[order], pos[order], comp[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        last = np.repeat(np.concatenate([first[1:], [len(gram)]]), np.diff(np.concatenate([first, [len(gram)]])))
        found = [np.empty((0, 2), np.int64)]
        for step in range(1, SMALL):  # each member with the one `step` places on
            i = np.flatnonzero(np.arange(len(gram)) + step < last)
            if not len(i):
                break
            j = i + step
            ok = (comp[i] != comp[j]) & may_link(n[i], pos[i], n[j], pos[j], percent)
            found.append(np.unique(np.stack([keys[i[ok]], keys[j[ok]]], axis=1), axis=0))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": out[:, 0], "b": out[:, 1], "gram": pa.nulls(len(out), pa.int64())})

    task = F.pmod(F.xxhash64("gram"), F.lit(tasks))
    return members.select(task.alias("task"), "gram", "key", "n", "pos", "c").groupBy("task").applyInArrow(run, "a long, b long, gram long")


def texts(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(key, body): compressed text of each node; equal sets of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6, write_checksum=False)
        seen = Seen()
        for b in batches:
            for s in X.slices(b.column(0)):
                keys, bodies = [], []
                for k, g in enumerate(shingle_sets(s.buf, s.offsets, width)):
                    key = set_key(g)
                    if len(g) and seen.new(key):
                        keys.append(key)
                        bodies.append(press.compress(s.buf[s.offsets[k] : s.offsets[k + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], names=["key", "body"])

    return docs.select(text).mapInArrow(run, "key long, body binary")


def both_sides(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Two neighbouring rows for each pair (a, b), with the columns of `of` for a, then for b. Only the first of
    the two shuffles has hot keys, and these rows are small; Spark may split them."""
    ask = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("key"), F.lit(0).alias("side")), F.struct(F.col("b").alias("key"), F.lit(1).alias("side")))).alias("x"))
    rows = ask.select("a", "b", "x.key", "x.side").join(of, "key").drop("key")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "side")


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """Neighbouring rows of one pair; a pair may lie across two batches."""
    before = None
    for t in batches:
        for row in t.to_pylist():
            if before is not None and (before["a"], before["b"]) == (row["a"], row["b"]):
                yield before, row
                before = None
            else:
                before = row


def likely(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the length filter and the whole signatures allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(x["a"], x["b"]) for x, y in paired(batches) if signatures_allow(x["sign"], x["n"], y["sign"], y["n"], percent)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], names=["a", "b"])

    return both_sides(pairs, signs).mapInArrow(run, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    o = int((both[1:] == both[:-1]).sum())
    return 100 * o >= percent * (len(a) + len(b) - o)


def verify(pairs: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()

        def get(body: bytes) -> np.ndarray:
            buf = np.frombuffer(open_.decompress(body), np.uint8)
            return next(shingle_sets(buf, np.array([0, len(buf)]), width))

        key, grams = None, None  # pairs of one a follow each other
        for x, y in paired(batches):
            if key != x["a"]:
                key, grams = x["a"], get(x["body"])
            if linked(grams, get(y["body"]), percent):
                yield pa.RecordBatch.from_arrays([pa.array([x["a"]], pa.int64()), pa.array([x["b"]], pa.int64())], names=["a", "b"])

    return both_sides(pairs, bodies).mapInArrow(run, "a long, b long")


def links_of(docs: DataFrame, measured: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(node, component) of all sets that link with another, from measured sets."""
    spark = docs.sparkSession
    usual = shuffle_partitions(spark)
    size = measured.agg(F.sum("n")).first()[0] or 0
    buckets = max(usual, size * (100 - percent) // 100 // BUCKET)
    counts, single = sketch(docs, text, width)
    bits = int(counts.size).bit_length() - 1
    spread = shares(counts)
    hot = np.flatnonzero(spread > 1)
    found = materialise(candidates(entries(docs, text, width, percent, counts, single, buckets), percent, hot, bits))
    pairs = found.where("b is not null").select("a", "b")
    members = found.where("b is null").select("gram", F.col("a").alias("key"), "n", "pos")
    # an n-gram dealt over several buckets has several pivots, which are paired with the smallest
    if len(hot):
        # at most 2**SKETCH_BITS rows of two numbers
        deal = F.broadcast(spark.createDataFrame([(int(h), int(spread[h])) for h in hot], "place long, deal long"))
        dealt = members.withColumn("place", F.shiftrightunsigned("gram", GRAM_BITS - bits)).join(deal, "place")
        # within each of its shares, the smallest key; then all of these against the smallest of all
        pivots = dealt.groupBy("gram", F.pmod("key", "deal").alias("share")).agg(F.min("key").alias("key"))
        top = pivots.groupBy("gram").agg(F.min("key").alias("a"))
        pairs = pairs.union(pivots.join(top, "gram").where("a < key").select("a", F.col("key").alias("b")))
    tested = materialise(pairs.distinct())
    signs = materialise(measured.where("sign is not null").select("key", "n", "sign", F.coalesce("brief", "sign").alias("brief")).dropDuplicates(["key"]))
    hopeful = materialise(likely(tested, signs.select("key", "n", "sign"), percent))
    ends = hopeful.select(F.explode(F.array("a", "b")).alias("key"))
    involved = ends.union(members.select("key")).distinct()
    with bucketed(texts(docs, text, width).join(involved, "key", "left_semi").dropDuplicates(["key"]), "key", usual) as bodies:
        links = materialise(verify(hopeful, bodies, width, percent))
        each, of, first = 4, None, True
        while True:
            old, of = of, components(links if of is None else links.union(of.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            placed = members.join(of.withColumnRenamed("node", "key"), "key", "left").select("gram", "key", "n", "pos", F.coalesce("component", "key").alias("c"))
            split = placed.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("same")).where("low <> high")
            # groups of the same members have the same links
            split = split.groupBy("same", "m").agg(F.min("gram").alias("gram")).select("gram", "m")
            open_ = materialise(placed.join(split, "gram"))
            if old is not None:
                discard(old)
            more = nearest(open_.where(F.col("m") > SMALL).join(signs.select("key", "brief"), "key"), percent, each)
            if first:
                few = open_.where(F.col("m") <= SMALL)
                more = more.union(all_pairs(few, percent, max(usual, few.count() // SMALL_TASK)))
            more, first = materialise(more), False
            pairs = materialise(more.where("gram is null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
            rest = more.where("gram is not null").select("gram").distinct()
            some = pairs.limit(1).count()
            if not some and not rest.limit(1).count():
                break
            members = materialise(open_.join(rest, "gram", "left_semi").select("gram", "key", "n", "pos"))
            each *= 16
            discard(open_)
            discard(more)
            links = materialise(verify(likely(pairs, signs.select("key", "n", "sign"), percent), bodies, width, percent))
            tested = tested.union(pairs)
    return of


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    measured = materialise(sets(docs, id_col, text, width))
    of = links_of(docs, measured, text, width, percent)
    nodes = measured.where("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    named = nodes.join(of.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = named.select("key", "component").join(least, "component").select("key", "component_id")
    out = measured.drop("sign", "brief").join(by_key.withColumnRenamed("key", "node_key"), (F.col("key") == F.col("node_key")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
