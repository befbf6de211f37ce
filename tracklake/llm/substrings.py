"""Exact substring dedup by suffix arrays over content-defined shards.

A byte goes if it is in some 100-byte string that also starts earlier: in a document with a
smaller id, or earlier in the same one. Strings are judged on the input.

Suffixes can't be compared across a corpus all with all, so shards are made such that equal
strings always meet: every 100-byte string has one anchor, its leftmost smallest hash of 24
bytes, and equal strings have equal anchors at equal places.

1. Scan: the anchors of each document, each with the range of strings it stands for (its
   context, some 135 bytes) as a hash. Contexts are packed into shards by anchor. Equal
   contexts of one task are sent once: all but the earliest are covered whole. A sketch of
   fixed size tells very frequent anchors, which are dealt over several shards.
2. Shard: equal contexts are covered but for the earliest. Anchors left with one context need
   no more; those with several differ somewhere, and their contexts are fetched.
3. Suffix arrays: each shard puts its contexts into one (Larsson-Sadakane, then Kasai's common
   prefixes); runs with common prefixes of 100 bytes are equal strings, and all but the
   earliest are covered.
4. Shards of one dealt anchor are merged: their distinct strings, in order, are binary-searched
   in the union of all, and those that start earlier elsewhere are covered.
5. Covered ranges meet their documents and are cut out.

No string is dropped or sampled, and none is compared by hash alone where contexts differ;
equal contexts have equal 128 bits, and so have strings of dealt anchors in step 4 (two hashes of the whole string, read
from either end).

Edge cases: null texts are empty; texts under 100 bytes keep everything; a null id takes no
part (nothing is removed from it or because of it); rows that repeat an id and its text are one
document; where ids aren't integers, or rows share an id but not a text, rows are numbered by id and a hash of the
text first, and judged in that order, each by its own text. Long texts come in chunks of CHUNK strings. Other columns
aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm import textops as X
from tracklake.llm.cluster import materialise, shuffle_partitions, tree_sum
from tracklake.llm.decontaminate import merge
from tracklake.llm.suffix import kasai, suffix_array

LENGTH = 100
GRAM = 24
CHUNK = 1 << 20
SKETCH_BITS = 17
#: Bytes of text for which there is a shard.
SHARD_BYTES = 16 << 20
#: Contexts of one anchor that one shard may get before they are dealt over several.
HOT = 20_000
FLUSH = 400_000
_POS_BITS = np.uint64(21)
_ENTRY = np.dtype([("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("at", "<i2"), ("size", "<i2")])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first byte of the context, its size, place of the anchor in it, hash of the anchor, hash of
    the context) of each anchor of a slice; a long document comes in chunks of strings."""
    for d0, d1 in _chunks(offsets):
        if d1 - d0 == 1:  # perhaps longer than a chunk: by ranges of starts
            low, high = int(offsets[d0]), int(offsets[d1])
            for x in range(low, max(low + 1, high - length + 1), CHUNK):
                end = min(high, x + CHUNK + length - 1)
                yield _anchors(buf[x:end], np.array([0, end - x]), length, d0, x - low)
        else:
            low = int(offsets[d0])
            yield _anchors(buf[low : offsets[d1]], offsets[d0 : d1 + 1] - low, length, d0, 0)


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, min(n, int(np.searchsorted(offsets, offsets[d] + CHUNK, side="right")) - 1))
        yield d, e
        d = e


def _anchors(buf: np.ndarray, offsets: np.ndarray, length: int, doc0: int, shift: int) -> tuple[np.ndarray, ...]:
    n, width = len(buf), length - GRAM + 1
    if n < length:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    prefix = X.prefix_hash(buf)
    at = np.arange(n - GRAM + 1)
    key = (X.span_hash(prefix, at, at + GRAM) >> _POS_BITS << _POS_BITS) | at.astype(np.uint64)
    low, span = key, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - length + 1], low[width - span : width - span + n - length + 1])
    spot = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    last = np.repeat(offsets[1:] - length, sizes)[: len(spot)]
    inside = np.arange(len(spot)) <= last
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(spot)]
    new = np.ones(len(spot), dtype=bool)
    new[1:] = (spot[1:] != spot[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    end = np.concatenate([first[1:], [len(spot)]])
    ok = inside[first]
    first, end = first[ok], end[ok]
    p = spot[first]
    gram = X.span_hash(prefix, p, p + GRAM)
    context = X.span_hash(prefix, first, end - 1 + length, seed=1)
    context = X.mix(context + (p - first).astype(np.uint64))
    return doc[first] + doc0, first - offsets[doc[first]] + shift, end - 1 + length - first, p - first, gram, context


def place_of(gram: np.ndarray, bits: int) -> np.ndarray:
    """An anchor's place among 2**bits. An anchor is the smallest hash of its window, so its hash is hashed again to
    spread over all places."""
    return (X.mix(gram) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, text: str, bits: int = SKETCH_BITS) -> np.ndarray:
    """Anchors by place of a hash: 2**bits counts, summed over all tasks in pieces. Equal contexts
    of one slice count once, as they are sent once."""
    pieces = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for s in X.slices(b.column(0)):
                for *_, gram, context in anchors(s.buf, s.offsets):
                    _, once = np.unique(context, return_index=True)
                    total += np.bincount(place_of(gram[once], bits), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in np.split(total, pieces)], pa.binary())], names=["piece", "counts"])

    rows = tree_sum(docs.select(text).mapInArrow(run, "piece int, counts binary"), (1 << bits) // pieces).collect()
    out = np.zeros((pieces, (1 << bits) // pieces), dtype=np.int64)
    for r in rows:
        out[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def shares(counts: np.ndarray) -> np.ndarray:
    """Shards over which the anchors of each place are dealt."""
    usual = max(1, int(np.median(counts)))
    return (1 + np.maximum(counts - 2 * usual, 0) // HOT).astype(np.int64)


def _earliest(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by anchor, context, document and start, and which of them equal an earlier one."""
    e = e[np.lexsort((e["start"], e["doc"], e["context"], e["gram"]))]
    same = np.zeros(len(e), dtype=bool)
    same[1:] = (e["gram"][1:] == e["gram"][:-1]) & (e["context"][1:] == e["context"][:-1])
    again = same.copy()
    again[1:] &= (e["doc"][1:] == e["doc"][:-1]) & (e["start"][1:] == e["start"][:-1])
    return e[~again], same[~again]


def _ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of covered ranges for each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    d, s, e = doc[order], start[order], end[order]
    base = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1])]))
    top = int(e.max()) + 2
    s2, e2 = merge(s + base * top, e + base * top)
    which = s2 // top
    names = d[np.concatenate([[True], d[1:] != d[:-1]])]
    return names[which], s2 - which * top, e2 - which * top


_ROWS = "kind int, shard int, doc long, payload binary"
_NAMES = ["kind", "shard", "doc", "payload"]


def _rows(kind: int, shard, doc, payload: list[bytes]) -> pa.RecordBatch:
    n = len(payload)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(shard if shard is not None else [None] * n, pa.int32()), pa.array(doc if doc is not None else [None] * n, pa.int64()), pa.array(payload, pa.binary())], names=_NAMES)


def _covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray, shards: int = 1) -> pa.RecordBatch:
    """Rows of kind 1: covered ranges of a document, packed; a shard only carries them on."""
    d, s, e = _ranges(doc, start, end)
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.empty(0, np.int64)
    both = np.stack([s, e], axis=1).astype(np.int64)
    return _rows(1, (X.mix(d[first].view(np.uint64)) % np.uint64(shards)).astype(np.int32), d[first], [x.tobytes() for x in np.split(both, first[1:])] if len(first) else [])


def _planes(e: np.ndarray) -> bytes:
    """Entries byte by byte, all first bytes before all second ones, so that a shuffle compresses their zeros."""
    return e.view(np.uint8).reshape(len(e), _ENTRY.itemsize).T.tobytes()


def _entries(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(_ENTRY.itemsize, -1).T).view(_ENTRY).reshape(-1)


def scan(docs: DataFrame, id_col: str, text: str, counts: np.ndarray, shards: int) -> DataFrame:
    """Rows of kind 0, packed contexts of a shard, and of kind 1."""
    bits = int(counts.size).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(shares(counts))  # 2**SKETCH_BITS * 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal_of, held, size = sent.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            e, same = _earliest(np.concatenate(held))
            dup = e[same]
            yield _covered(dup["doc"], dup["start"], dup["start"] + dup["size"], shards)
            e = e[~same]
            deal = deal_of[place_of(e["gram"], bits)].astype(np.uint64)
            shard = (X.mix(e["gram"] + e["context"] % deal * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            e, shard = e[order], shard[order]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            yield _rows(0, shard[first], None, [_planes(x) for x in np.split(e, first[1:])])

        for b in batches:
            b = b.filter(b.column(0).is_valid())
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s in X.slices(b.column(1)):
                for doc, start, n, at, gram, context in anchors(s.buf, s.offsets):
                    if not len(doc):
                        continue
                    e = np.empty(len(doc), dtype=_ENTRY)
                    e["gram"], e["context"], e["doc"], e["start"], e["at"], e["size"] = gram, context, ids[s.row + doc], start, at, n
                    held.append(e)
                    size += len(e)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select(id_col, text).mapInArrow(run, _ROWS)


def settle(packed: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows of kind 1 (those of the scan too), and of kind 2: contexts to fetch, packed by document, with their shard."""
    bits = int(counts.size).bit_length() - 1
    dealt = np.flatnonzero(shares(counts) > 1)

    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        ready = pc.equal(t["kind"], 1)
        carried, t = t.filter(ready).to_batches(), t.filter(pc.invert(ready))
        e, same = _earliest(np.concatenate([np.empty(0, _ENTRY), *[_entries(x.as_py()) for x in t["payload"]]]))
        dup = e[same]
        out = [*carried, _covered(dup["doc"], dup["start"], dup["start"] + dup["size"])]
        e = e[~same]
        first = np.flatnonzero(np.concatenate([[True], e["gram"][1:] != e["gram"][:-1]])[: len(e)])
        many = np.repeat(np.diff(np.concatenate([first, [len(e)]])) > 1, np.diff(np.concatenate([first, [len(e)]])))
        e = e[many | np.isin(place_of(e["gram"], bits), dealt)]
        if len(e):
            e = e[np.argsort(e["doc"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], e["doc"][1:] != e["doc"][:-1]]))
            out.append(_rows(2, [shard] * len(first), e["doc"][first], [x.tobytes() for x in np.split(e, first[1:])]))
        return pa.Table.from_batches(out)

    return packed.groupBy("shard").applyInArrow(run, _ROWS)


def pressed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, n_bytes, whole_sha256 and the compressed text, as it is to be shuffled."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            buf, at = X.text_buffers(b.column(1))
            parts = [buf[at[k] : at[k + 1]] for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at) if b.num_rows else [], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()), pa.array([press.compress(x.tobytes()) for x in parts], pa.binary())], names=["id", "n_bytes", "whole_sha256", "body"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n_bytes long, whole_sha256 string, body binary")


def fetch(wanted: DataFrame, bodies: DataFrame) -> DataFrame:
    """(shard, payload, body) with the bytes of the contexts, one row per shard and document."""
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("shard", "payload")).alias("asked"))
    both = bodies.select("id", "body").join(asked, F.col("id") == F.col("doc")).select("asked", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            shard, payload, found = [], [], []
            for k in range(b.num_rows):
                body = open_.decompress(b.column(1)[k].as_py())
                for x in b.column(0)[k].as_py():
                    e = np.frombuffer(x["payload"], _ENTRY)
                    shard.append(x["shard"])
                    payload.append(x["payload"])
                    found.append(b"".join(body[s : s + n] for s, n in zip(e["start"].tolist(), e["size"].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(payload, pa.binary()), pa.array(found, pa.binary())], names=["shard", "payload", "body"])

    return both.mapInArrow(run, "shard int, payload binary, body binary")


#: Bytes of contexts that one suffix array takes; a shard with more goes anchor by anchor.
ARRAY_BYTES = 4_000_000


def arrays(contexts: DataFrame, counts: np.ndarray, shards: int, length: int = LENGTH) -> DataFrame:
    """Rows of kind 1 from equal strings within a shard, and of kind 3: distinct strings of dealt
    anchors, as (hash, hash, document, start) in order, by the shard where they are to be merged."""
    bits = int(counts.size).bit_length() - 1
    dealt = np.flatnonzero(shares(counts) > 1)
    string = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("start", "<i8")])

    def run(t: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x.as_py(), _ENTRY) for x in t["payload"]])
        text = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["body"]])
        size = e["size"].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(e["gram"], kind="stable")
        bound = np.concatenate([[0], np.flatnonzero(np.diff(e["gram"][order]) != 0) + 1, [len(e)]])
        total = np.concatenate([[0], np.cumsum(size[order])])[bound]
        out, g = [], 0
        while g < len(bound) - 1:  # whole groups of an anchor, as many as fit
            h = max(g + 1, int(np.searchsorted(total, total[g] + ARRAY_BYTES, side="right")) - 1)
            pick = order[bound[g] : bound[h]]
            out += one(e[pick], begin[pick], size[pick], text)
            g = h
        return pa.Table.from_batches(out)

    def one(e: np.ndarray, begin: np.ndarray, size: np.ndarray, text: np.ndarray) -> list[pa.RecordBatch]:
        # contexts one after the other, each ended by 0; other codes are bytes + 1
        room = size + 1
        base = np.concatenate([[0], np.cumsum(room)])
        owner = np.repeat(np.arange(len(e)), room)
        inner = np.arange(base[-1]) - base[:-1][owner]
        codes = np.where(inner < size[owner], text[np.minimum(begin[owner] + inner, len(text) - 1)].astype(np.int64) + 1, 0)
        sa = suffix_array(codes, length)
        common = kasai(codes, sa, length)
        string_at = inner[sa] + length <= size[owner[sa]]  # suffixes that are whole strings
        run_id = np.cumsum(common < length)
        sa, run_id = sa[string_at], run_id[string_at]
        who = owner[sa]
        doc, start = e["doc"][who], e["start"][who] + inner[sa]
        order = np.lexsort((start, doc, run_id))
        run_id, doc, start, sa, who = run_id[order], doc[order], start[order], sa[order], who[order]
        later = np.zeros(len(sa), dtype=bool)
        later[1:] = run_id[1:] == run_id[:-1]
        twin = np.zeros(len(sa), dtype=bool)  # the same place by another anchor's context: can't be, but for repeated rows
        twin[1:] = later[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
        cover = later & ~twin
        head = np.maximum.accumulate(np.where(~later, np.arange(len(sa)), 0)) if len(sa) else np.empty(0, np.int64)
        cover &= (doc != doc[head]) | (start != start[head])
        out = [_covered(doc[cover], start[cover], start[cover] + length)]
        hot = ~later & np.isin(place_of(e["gram"], bits)[who], dealt)
        if hot.any():
            spot = sa[hot]
            raw = (codes & 255).astype(np.uint8)
            prefix, other = X.prefix_hash(raw), X.prefix_hash(raw[::-1])
            s = np.empty(len(spot), dtype=string)
            s["a"], s["b"] = X.span_hash(prefix, spot, spot + length, seed=3), X.span_hash(other, len(raw) - spot - length, len(raw) - spot, seed=4)
            s["doc"], s["start"] = doc[hot], start[hot]
            shard = (s["a"] % np.uint64(shards)).astype(np.int32)
            by = np.argsort(shard, kind="stable")
            s, shard = s[by], shard[by]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            out.append(_rows(3, shard[first], None, [np.sort(x, order=["a", "b"]).tobytes() for x in np.split(s, first[1:])]))
        return out

    return contexts.groupBy("shard").applyInArrow(run, _ROWS)


def merge_shards(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of kind 1 from equal strings of different shards: each shard's strings are binary-searched
    in the sorted union, whose entries know the earliest start."""
    string = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("start", "<i8")])

    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), string) for x in t["payload"]]
        every = np.concatenate(parts)
        every = every[np.lexsort((every["start"], every["doc"], every["b"], every["a"]))]
        new = np.concatenate([[True], (every["a"][1:] != every["a"][:-1]) | (every["b"][1:] != every["b"][:-1])])
        union = every[new]
        out = []
        for p in parts:
            at = np.searchsorted(union["a"], p["a"])
            while True:  # equal first hashes
                step = union["b"][np.minimum(at, len(union) - 1)] != p["b"]
                if not step.any():
                    break
                at = at + step
            q = union[at]
            cover = (q["doc"] != p["doc"]) | (q["start"] != p["start"])
            out.append(_covered(p["doc"][cover], p["start"][cover], p["start"][cover] + length))
        return pa.Table.from_batches(out)

    return rows.groupBy("shard").applyInArrow(run, _ROWS)


def cut(bodies: DataFrame, covered: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text)."""
    ranges = covered.where("kind = 1").groupBy("doc").agg(F.collect_list("payload").alias("ranges"))
    both = bodies.join(ranges, F.col("id") == F.col("doc"), "left").select("id", "n_bytes", "whole_sha256", "body", "ranges")
    kind = dict(bodies.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            removed, spans, sha, kept = [], [], [], []
            for k in range(b.num_rows):
                got = b.column(4)[k].as_py()
                if not got:
                    removed.append(0)
                    spans.append(0)
                    sha.append(b.column(2)[k].as_py())
                    if with_text:
                        kept.append(open_.decompress(b.column(3)[k].as_py()))
                    continue
                r = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in got])
                s, e = merge(r[:, 0], r[:, 1])
                body = open_.decompress(b.column(3)[k].as_py())
                keep = b"".join(body[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(body)], strict=True))
                removed.append(int((e - s).sum()))
                spans.append(len(s))
                sha.append(hashlib.sha256(keep).hexdigest())
                if with_text:
                    kept.append(keep)
            cols = [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if with_text else []), names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text)

    return both.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text)


def keyed(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame] | None:
    """(key, text), and key by (id, text's hash), where ids aren't long integers or rows share an id but not a text: keys
    count up by id, then hash, so that an earlier id stays earlier. None where ids are good as keys."""
    plain = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    each = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("sha"))
    short = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    if plain and not short.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").limit(1).count():
        return None
    ordered = materialise(each.distinct().repartitionByRange("id", "sha").withColumn("part", F.spark_partition_id()))
    before = ordered.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("id", "sha"))
    keys = materialise(ordered.withColumn("w", within).join(before, "part").select("id", "sha", (F.col("w") + F.col("before")).cast("long").alias("key")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("sha"))
    return rows.join(keys, ["id", "sha"], "left").select("key", "text"), keys


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; with_text also gives the
    bytes that remain."""
    other = keyed(docs, id_col, text)
    if other is not None:
        rows, keys = other
        kind = docs.schema[id_col].dataType.simpleString()
        out = dedup_keyed(materialise(rows), "key", "text", with_text)
        return out.join(keys, "key", "left").select(F.col("id").cast(kind).alias(id_col), *[c for c in out.columns if c != "key"])
    return dedup_keyed(docs, id_col, text, with_text)


def dedup_keyed(docs: DataFrame, id_col: str, text: str, with_text: bool = False) -> DataFrame:
    """`dedup` where rows of one id have one text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(4 * shuffle_partitions(docs.sparkSession), size // SHARD_BYTES)
    counts = sketch(docs, text)
    scanned = scan(docs, id_col, text, counts, shards)
    first = materialise(settle(scanned, counts))
    bodies = pressed(docs, id_col, text)
    second = materialise(arrays(fetch(first.where("kind = 2"), bodies), counts, shards))
    covered = first.where("kind = 1").unionByName(second.where("kind = 1"))
    if (shares(counts) > 1).any():
        covered = covered.unionByName(merge_shards(second.where("kind = 3")))
    return cut(bodies, covered, with_text).withColumnRenamed("id", id_col)
