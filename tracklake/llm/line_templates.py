"""Line dedup by a log-template tree.

A line is masked (a token with a digit becomes <*>) and parsed down a tree of fixed depth: number of
tokens, then the first three masked tokens. At a leaf, variable
fields are generalised: a token stays where at least a quarter of the leaf's lines have it
at that place, and becomes <*> elsewhere. Lines of one leaf with the same result have one
template, which counts if at least 60% of its tokens are constant. Lines for which the whole leaf
gives no template are generalised again in groups: for each token that TEMPLATE_DOCS of these
lines have at a place, the lines that have it there. A word of its own at some place is enough to find
a template, whatever its share of the leaf; of several templates a line takes the one of the most
documents. A masked line is also a template of its own, so that exact repeats are found in leaves of
any mix; where under 60% of a line's tokens are constant, as in rows of numbers, only lines with the same
tokens are equal.

A masked line of MIN_TOKENS tokens or more that recurs in MIN_DOCS documents or more, a shorter one or a generalised
template that recurs in TEMPLATE_DOCS or more, is dropped from all documents but the one with the
smallest id, where it stays, so that no content is lost altogether.

Each distinct line of a task is sent once, compressed with others, to the bucket of its leaf, with its number of
documents and their smallest id; a bucket has whole leaves and settles them. Leaves that a sketch of fixed size says are
very frequent are dealt over several buckets by line; these only sum up lines, and the
leaf is settled by joins on its places and tokens, with the same result.

Edge cases: null and empty texts have one empty line and lose nothing; lines without tokens stay; a
document whose lines all go keeps its row with an empty text; a row with a null id loses
nothing and keeps nothing from others; repeated rows count as one document each, and both
keep their lines if theirs is the smallest id; other columns are kept, but columns named line_count and line_dropped
give way to the operator's own in `dedup` (`strip` keeps them). Texts are read whole, a long one as a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import textops as X
from tracklake.llm.cluster import materialise, shuffle_partitions, tree_sum

#: Documents from which a masked line recurs, and a short line or a template with other variable fields than digits.
MIN_DOCS, TEMPLATE_DOCS = 2, 10
MIN_TOKENS = 3
DEPTH = 3
#: A token is constant at a place that 1 / SHARE of its leaf's lines have it at.
SHARE = 4
#: Constant tokens of a template, in tenths.
CONSTANT = 6
SKETCH_BITS = 17
#: Lines of a leaf, in all documents, that one bucket may get before they are dealt over several; lines of a bucket.
HOT, BUCKET = 50_000, 500_000
#: Bytes of lines a task holds before it gives them out.
HELD = 32 << 20
#: Bytes of texts that are parsed together where lines are cut.
TOGETHER = 1 << 20
#: Tokens of a leaf that are counted together.
CELLS = 1 << 17
_MASK = np.uint64(1)


def parse(buf: np.ndarray, offsets: np.ndarray, whole: bool = True) -> dict[str, np.ndarray]:
    """The lines of a slice that have tokens: document, number of the line in it (from 0), leaf, first token and
    number of tokens, first byte and end; if whole, also the line and the hashes of all masked tokens."""
    start, end, firsts = X.spans((buf - np.uint8(9) > 4) & (buf != 32), offsets)
    breaks = np.flatnonzero(buf == 10)
    new = np.zeros(len(start) + 1, dtype=bool)
    new[np.searchsorted(start, breaks)] = True
    new[firsts] = True
    first = np.flatnonzero(new[:-1])
    size = np.diff(np.concatenate([first, [len(start)]]))
    d = np.searchsorted(firsts, first, side="right") - 1
    number = np.searchsorted(breaks, start[first]) - np.searchsorted(breaks, offsets[:-1])[d]
    masked = np.zeros(len(start), dtype=bool)
    masked[np.searchsorted(start, np.flatnonzero((buf >= 48) & (buf <= 57)), side="right") - 1] = True
    if whole:
        plain = X.word_hash(buf, start, end)
        token = np.where(masked, _MASK, plain)
    leaf = size.astype(np.uint64)
    for k in range(DEPTH):
        at = np.minimum(first + k, len(start) - 1)
        kth = token[at] if whole else np.where(masked[at], _MASK, X.word_hash(buf, start[at], end[at]))
        leaf = np.where(size > k, X.mix(leaf * np.uint64(0x9E3779B97F4A7C15) + kth), leaf)
    out = {"doc": d, "number": number, "leaf": leaf, "first": first, "size": size, "from": start[first], "to": end[first + size - 1]}
    if whole:
        sums = lambda x, of: np.add.reduceat(x, first, dtype=of) if len(first) else np.zeros(0, dtype=of)
        told = 10 * (size - sums(masked, np.int64)) >= CONSTANT * size
        total = sums(np.where(np.repeat(told, size), token, plain) * X._power("mul", len(token)), np.uint64)
        out["line"] = X.mix(total * X._power("inv", len(token) + 1)[first] + (size * 2 + ~told).astype(np.uint64))
        out["token"] = token
    return out


def _once(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first of each (document, value)."""
    _, at = np.unique(X.mix(value ^ X.mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.sort(at)


def sketch(docs: DataFrame, text: str, bits: int | None = None) -> np.ndarray:
    """Lines of documents by place of a hash of their leaf: 2**bits counts."""
    bits = bits or SKETCH_BITS
    pieces = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for s in X.slices(b.column(0)):
                p = parse(s.buf, s.offsets, whole=False)
                total += np.bincount((p["leaf"] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in np.split(total, pieces)], pa.binary())], names=["piece", "counts"])

    rows = tree_sum(docs.select(text).mapInArrow(run, "piece int, counts binary"), (1 << bits) // pieces).collect()
    out = np.zeros((pieces, (1 << bits) // pieces), dtype=np.int64)
    for r in rows:
        out[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def shares(counts: np.ndarray) -> np.ndarray:
    """Buckets over which the leaves of each place are dealt."""
    usual = max(1, int(np.median(counts)))
    return (1 + np.maximum(counts - 2 * usual, 0) // HOT).astype(np.int64)


def least_of(group: np.ndarray, ids: pa.Array, groups: int) -> pa.Array:
    """The smallest id of each group, null if all are."""
    t = pa.table({"group": group, "id": ids}).group_by("group").aggregate([("id", "min")]).sort_by("group")
    out = t["id_min"]
    return (out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out) if groups else ids.slice(0, 0)


def lines(docs: DataFrame, id_col: str, text: str, spread: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, texts, n, least): distinct lines of a task, with their number of documents and smallest id, packed."""
    bits = int(spread.size).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(spread)  # 2**SKETCH_BITS * 8 bytes
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
        size = 0

        def give() -> pa.RecordBatch:
            leaf, line = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            words, ids = (pa.concat_arrays([x[k] for x in held]) for k in (2, 3))
            _, at, group = np.unique(line, return_index=True, return_inverse=True)
            n, least = np.bincount(group), least_of(group, ids, len(at))
            leaf, line = leaf[at], line[at]
            deal = sent.value[(leaf >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
            bucket = (X.mix(leaf + (line % deal) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            words, least, n, bucket = words.take(pa.array(at[order])), least.take(pa.array(order)), n[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = [*first[1:], len(order)]
            raw = [press.compress(b"\n".join(words.slice(f, e - f).to_pylist())) for f, e in zip(first, ends, strict=True)]
            offsets = pa.array([*first, len(order)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())), pa.ListArray.from_arrays(offsets, least)], names=["bucket", "texts", "n", "least"])

        for b in batches:
            for s in X.slices(b.column(1)):
                p = parse(s.buf, s.offsets)
                at = _once(p["doc"], p["line"])
                if not len(at):
                    continue
                spans = np.stack([p["from"][at], p["to"][at]], axis=1).reshape(-1)
                every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(spans) - 1, [None, pa.py_buffer(spans.astype(np.int64)), pa.py_buffer(s.buf)])
                held.append((p["leaf"][at], p["line"][at], every.take(pa.array(np.arange(0, len(spans), 2))), b.column(0).take(pa.array(s.row + p["doc"][at]))))
                size += int((p["to"][at] - p["from"][at]).sum()) + 48 * len(at)
                if size >= HELD:
                    yield give()
                    held.clear()
                    size = 0
        if held:
            yield give()

    return docs.select(id_col, text).mapInArrow(run, f"bucket int, texts binary, n array<long>, least array<{kind}>")


def _have(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Documents whose line has the same token at the place, for each line and place."""
    out = np.empty(token.shape, dtype=np.int64)
    step = max(1, CELLS // max(1, len(n)))
    for k in range(0, token.shape[1], step):
        t = np.ascontiguousarray(token[:, k : k + step].T)
        order = np.argsort(t, axis=1)
        new = np.ones(t.shape, dtype=bool)
        each = np.take_along_axis(t, order, axis=1)
        new[:, 1:] = each[:, 1:] != each[:, :-1]
        at = np.cumsum(new.reshape(-1)) - 1
        have = np.empty(t.shape, dtype=np.int64)
        np.put_along_axis(have, order, np.bincount(at, weights=n[order].reshape(-1)).astype(np.int64)[at].reshape(t.shape), axis=1)
        out[:, k : k + step] = have.T
    return out


def _forms(token: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Hashes of the constant tokens with their places; 0 where too few are constant."""
    place = X.mix(np.arange(1, token.shape[1] + 1).astype(np.uint64))
    each = X.mix((token * np.uint64(0x9E3779B97F4A7C15)) ^ place[None, :])
    form = np.where(constant, each, np.uint64(0)).sum(axis=1, dtype=np.uint64) | np.uint64(1)
    return np.where(10 * constant.sum(axis=1) >= CONSTANT * token.shape[1], form, np.uint64(0))


def leaf_templates(token: np.ndarray, n: np.ndarray, template_docs: int) -> np.ndarray:
    """For each line of a leaf a number of its template, or 0."""
    out = np.zeros(len(n), dtype=np.uint64)
    form = _forms(token, (token != _MASK) & (SHARE * _have(token, n) >= n.sum()))
    _, at = np.unique(form, return_inverse=True)
    ok = (form > 0) & (np.bincount(at, weights=n)[at] >= template_docs)
    out[ok] = form[ok]
    rest = np.flatnonzero(~ok)
    if not len(rest):
        return out
    # a constant token is in 1 / SHARE of a group of template_docs at least: lines with too few such tokens have no template
    often = (token[rest] != _MASK) & (SHARE * _have(token[rest], n[rest]) >= template_docs)
    rest = rest[10 * often.sum(axis=1) >= CONSTANT * token.shape[1]]
    if not len(rest):
        return out
    t, m = token[rest], n[rest]
    common = (t != _MASK) & (_have(t, m) >= template_docs)
    seen: set[bytes] = set()
    found: dict[tuple[int, int], int] = {}  # (line, form): constant tokens
    for k in range(t.shape[1]):
        at = np.flatnonzero(common[:, k])
        at = at[np.argsort(t[at, k], kind="stable")]
        for group in np.split(at, np.flatnonzero(np.diff(t[at, k])) + 1) if len(at) else ():
            key = hashlib.blake2b(np.sort(group).tobytes(), digest_size=16).digest()
            if key in seen:  # groups of the same lines count once
                continue
            seen.add(key)
            constant = (t[group] != _MASK) & (SHARE * _have(t[group], m[group]) >= m[group].sum())
            for i, f, c in zip(group.tolist(), _forms(t[group], constant).tolist(), constant.sum(axis=1).tolist(), strict=True):
                if f:
                    found[i, f] = c
    docs: dict[int, int] = {}
    for i, f in found:
        docs[f] = docs.get(f, 0) + int(m[i])
    best: dict[int, tuple[int, int, int]] = {}
    for (i, f), c in found.items():
        if docs[f] >= template_docs:
            best[i] = max(best.get(i, (0, 0, 0)), (docs[f], c, f))
    for i, (_, _, f) in best.items():
        out[rest[i]] = np.uint64(f) ^ np.uint64(1 << 63)
    return out


def settled(packed: DataFrame, kind: str, spread: np.ndarray, min_docs: int, template_docs: int) -> DataFrame:
    """(line, keeper) of lines that recur; for leaves that are dealt over several buckets also each of their lines, as
    (leaf, line, n, least, tokens) with keeper null."""
    bits = int(spread.size).bit_length() - 1
    sent = packed.sparkSession.sparkContext.broadcast(spread)  # 2**SKETCH_BITS * 8 bytes

    def run(t: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        leaf, line, size, flat = [], [], [], []
        for x in t["texts"]:
            raw = np.frombuffer(open_.decompress(x.as_py()), np.uint8)
            p = parse(raw, np.array([0, len(raw)]))
            leaf.append(p["leaf"])
            line.append(p["line"])
            size.append(p["size"])
            flat.append(p["token"])
        leaf, line, size, flat = (np.concatenate(x) for x in (leaf, line, size, flat))
        begin = np.concatenate([[0], np.cumsum(size)])
        every = pc.list_flatten(t["n"].combine_chunks()).to_numpy()
        ids = pc.list_flatten(t["least"].combine_chunks())
        line, at, group = np.unique(line, return_index=True, return_inverse=True)
        n = np.bincount(group, weights=every).astype(np.int64)
        least = least_of(group, ids, len(at))
        leaf, size, begin = leaf[at], size[at], begin[at]
        dealt = sent.value[(leaf >> np.uint64(64 - bits)).astype(np.int64)] > 1
        template = np.zeros(len(line), dtype=np.uint64)
        order = np.lexsort((line, leaf))
        first = np.flatnonzero(np.concatenate([[True], np.diff(leaf[order]) > 0]))
        end, one = np.append(first[1:], len(order)), order[first]
        able = (end - first > 1) & (size[one] >= MIN_TOKENS) & ~dealt[one] & (np.add.reduceat(n[order], first) >= template_docs)
        for f, e in zip(first[able].tolist(), end[able].tolist(), strict=True):
            rows = order[f:e]
            token = flat[begin[rows][:, None] + np.arange(size[rows[0]])[None, :]]
            made = leaf_templates(token, n[rows], template_docs)
            template[rows] = np.where(made > 0, X.mix(made ^ leaf[rows[0]]) | np.uint64(1), np.uint64(0))
        # lines of one template share its smallest id, the others keep their own
        _, group = np.unique(np.where(template > 0, template, line), return_inverse=True)
        shared = least_of(group, least, group.max() + 1).take(pa.array(group))
        keeper = pc.if_else(pa.array(template > 0), shared, least)
        alone = n >= np.where(size >= MIN_TOKENS, min_docs, template_docs)
        out = np.flatnonzero((template > 0) | alone)
        more = np.flatnonzero(dealt & (size >= MIN_TOKENS))
        none = lambda k, of: pa.nulls(k, of)
        a, b = pa.array(out), pa.array(more)
        tokens = pa.array([flat[begin[k] : begin[k] + size[k]].view(np.int64) for k in more], pa.list_(pa.int64()))
        long = pa.int64()
        return pa.table({
            "line": pa.array(np.concatenate([line[out], line[more]]).view(np.int64)),
            "keeper": pa.concat_arrays([keeper.take(a), none(len(more), least.type)]),
            "leaf": pa.concat_arrays([none(len(out), long), pa.array(leaf[more].view(np.int64))]),
            "n": pa.concat_arrays([none(len(out), long), pa.array(n[more])]),
            "least": pa.concat_arrays([none(len(out), least.type), least.take(b)]),
            "tokens": pa.concat_arrays([none(len(out), tokens.type), tokens]),
        })

    return packed.groupBy("bucket").applyInArrow(run, f"line long, keeper {kind}, leaf long, n long, least {kind}, tokens array<long>")


def templates(by_line: DataFrame, template_docs: int) -> DataFrame:
    """(line, template_keeper) of the lines (leaf, line, n, least, tokens) of leaves of any size that have a template."""
    by_line = materialise(by_line)
    leaves = by_line.groupBy("leaf").agg(F.sum("n").alias("total")).where(F.col("total") >= template_docs)
    mixed = by_line.join(leaves, "leaf")
    each = mixed.select("leaf", "line", "n", "least", "total", F.posexplode("tokens").alias("pos", "token"))
    constant = each.where(F.col("token") != 1).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("have"), F.max("total").alias("total")).where(SHARE * F.col("have") >= F.col("total")).select("leaf", "pos", "token")
    kept = each.join(constant, ["leaf", "pos", "token"]).groupBy("leaf", "line").agg(F.count("*").alias("n_constant"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("form"))
    general = by_line.join(kept, ["leaf", "line"]).where(10 * F.col("n_constant") >= CONSTANT * F.size("tokens")).select("leaf", "line", "n", "least", "form")
    forms = general.groupBy("leaf", "form").agg(F.sum("n").alias("docs"), F.min("least").alias("keeper")).where(F.col("docs") >= template_docs)
    first = materialise(general.join(forms, ["leaf", "form"]).select("leaf", "line", F.col("keeper").alias("template_keeper")))
    rest = materialise(mixed.join(first, ["leaf", "line"], "left_anti").select("leaf", "line", "n", "least", "tokens"))
    return first.select("line", "template_keeper").union(grouped(rest, template_docs))


def grouped(rest: DataFrame, template_docs: int) -> DataFrame:
    """(line, template_keeper): lines of rest with a template of a group of their leaf's lines in rest, and the smallest
    id of the lines that take the template. Groups of the same lines count once."""

    def words(lines: DataFrame) -> DataFrame:
        return lines.select("leaf", "line", "n", F.posexplode("tokens").alias("pos", "token")).where(F.col("token") != 1)

    # a constant token is in 1 / SHARE of a group of template_docs at least: lines with too few such tokens have no template
    often = words(rest).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("have")).where(SHARE * F.col("have") >= template_docs)
    fit = words(rest).join(often.select("leaf", "pos", "token"), ["leaf", "pos", "token"]).groupBy("leaf", "line").agg(F.count("*").alias("n_often"))
    able = materialise(rest.join(fit, ["leaf", "line"]).where(10 * F.col("n_often") >= CONSTANT * F.size("tokens")).drop("n_often"))
    common = words(able).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("have"), F.bit_xor(F.xxhash64("line")).alias("same"))
    common = common.where(F.col("have") >= template_docs).select("leaf", "pos", "token", "have", F.xxhash64("same", "have").alias("group"))
    member = words(able).join(common, ["leaf", "pos", "token"]).select("leaf", "group", "line", "have").distinct()
    inside = materialise(member.join(able.select("leaf", "line", "n", "tokens"), ["leaf", "line"]))
    each = inside.select("leaf", "group", "line", "have", "n", F.posexplode("tokens").alias("pos", "token")).where(F.col("token") != 1)
    constant = each.groupBy("leaf", "group", "pos", "token").agg(F.sum("n").alias("n_have"), F.max("have").alias("have")).where(SHARE * F.col("n_have") >= F.col("have")).select("leaf", "group", "pos", "token")
    kept = each.select("leaf", "group", "line", "pos", "token").join(constant, ["leaf", "group", "pos", "token"]).groupBy("leaf", "group", "line").agg(F.count("*").alias("n_constant"), F.bit_xor(F.xxhash64("pos", "token")).alias("form"))
    # the same form of two groups is one template
    general = kept.join(able.select("leaf", "line", "n", "least", F.size("tokens").alias("size")), ["leaf", "line"]).where(10 * F.col("n_constant") >= CONSTANT * F.col("size"))
    general = materialise(general.select("leaf", "line", "n", "least", "n_constant", "form").distinct())
    templates = general.groupBy("leaf", "form").agg(F.sum("n").alias("docs")).where(F.col("docs") >= template_docs)
    best = general.join(templates, ["leaf", "form"]).groupBy("leaf", "line", "least").agg(F.max(F.struct("docs", "n_constant", "form")).alias("best"))
    best = best.select("leaf", "line", "least", F.col("best.form").alias("form"))
    keepers = best.groupBy("leaf", "form").agg(F.min("least").alias("template_keeper"))
    return best.join(keepers, ["leaf", "form"]).select("line", "template_keeper")


def recurring(docs: DataFrame, id_col: str, text: str, min_docs: int, template_docs: int) -> DataFrame:
    """(line, keeper): lines that recur, or whose template does, and the smallest id that has it."""
    kind = dict(docs.dtypes)[id_col]
    counts = sketch(docs, text)
    spread = shares(counts)
    buckets = max(shuffle_partitions(docs.sparkSession), int(counts.sum()) // BUCKET)
    found = materialise(settled(lines(docs, id_col, text, spread, buckets), kind, spread, min_docs, template_docs))
    exact = found.where("leaf is null").select("line", "keeper")
    if not (spread > 1).any():
        return exact
    more = templates(found.where("leaf is not null").select("leaf", "line", "n", "least", "tokens"), template_docs)
    return materialise(exact.join(more, "line", "full").select("line", F.coalesce("template_keeper", "keeper").alias("keeper")))


def _pressed(docs: DataFrame, at: int) -> DataFrame:
    """docs with the text, column `at`, compressed, and columns named by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for b in batches:
            raw = [press.compress(x.as_buffer()) if x.is_valid else None for x in b.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()) if k == at else c for k, c in enumerate(b.columns)], names=[f"in_{k}" for k in range(b.num_columns)])

    return docs.mapInArrow(run, ", ".join(f"in_{k} {'binary' if k == at else f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)))


def _gone(texts: list[bytes], lost: list[np.ndarray]) -> list[set[int]]:
    """Numbers of the lines of each text that are among its lost ones; the texts are parsed as one slice."""
    p = parse(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    bound = np.searchsorted(p["doc"], np.arange(len(texts) + 1))
    line = p["line"].view(np.int64)
    return [set(p["number"][a:b][np.isin(line[a:b], x)].tolist()) for a, b, x in zip(bound, bound[1:], lost, strict=False)]


def _stripped(docs: DataFrame, id_col: str, text: str, min_docs: int | None) -> DataFrame:
    """The columns of docs as in_0, in_1, ..., text being what remains, and line_count and line_dropped."""
    template_docs = min_docs or TEMPLATE_DOCS
    min_docs = min_docs or MIN_DOCS
    names = docs.columns
    i_id, at = names.index(id_col), names.index(text)
    kind = docs.schema[id_col].dataType.simpleString()
    again = recurring(docs, id_col, text, min_docs, template_docs)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                p = parse(s.buf, s.offsets)
                k = _once(p["doc"], p["line"])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s.row + p["doc"][k])), pa.array(p["line"][k].view(np.int64))], names=["id", "line"])

    have = docs.where(F.col(id_col).isNotNull()).select(id_col, text).mapInArrow(tell, f"id {kind}, line long")
    lost = have.join(again, "line").where(F.col("id") != F.col("keeper")).groupBy("id").agg(F.collect_set("line").alias("lost_lines")).withColumnRenamed("id", "lost_id")
    cols = [f"in_{k}" for k in range(len(names))]
    rows = _pressed(docs, at).join(lost, F.col(f"in_{i_id}") == F.col("lost_id"), "left").select("lost_lines", *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            column, lost = b.column(at + 1), b.column(0)
            out: list[bytes | None] = [None] * b.num_rows
            n_lines, n_lost = [1] * b.num_rows, [0] * b.num_rows
            held, size = [], 0
            for k in range(b.num_rows):
                raw = open_.decompress(column[k].as_py()) if column[k].is_valid else None
                out[k], n_lines[k] = raw, 1 + (raw or b"").count(b"\n")
                if raw and lost[k].is_valid:
                    held.append(k)
                    size += len(raw)
                if held and (size >= TOGETHER or k == b.num_rows - 1):
                    for j, gone in zip(held, _gone([out[j] for j in held], [lost[j].values.to_numpy() for j in held]), strict=True):
                        parts = out[j].split(b"\n")
                        out[j], n_lost[j] = b"\n".join(x for i, x in enumerate(parts) if i not in gone), len(gone)
                    held, size = [], 0
            arrays = [pa.array(out, pa.binary()).cast(pa.string()) if i == at + 1 else b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_lost, pa.int64())], names=[*cols, "line_count", "line_dropped"])

    schema = ", ".join([f"in_{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)] + ["line_count long", "line_dropped long"])
    return rows.mapInArrow(run, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int | None = None) -> DataFrame:
    """All columns of docs, text being what remains, with line_count and line_dropped. min_docs, if given,
    holds for masked lines and templates alike."""
    own = ("line_count", "line_dropped")
    return _stripped(docs, id_col, text, min_docs).select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns) if c not in own], *own)


def strip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int | None = None) -> DataFrame:
    """The columns of docs, text being what remains."""
    return _stripped(docs, id_col, text, min_docs).select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)])


def sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
