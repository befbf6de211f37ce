"""Benchmark decontamination by suffix arrays over training text.

Training documents are cut into shards of about SHARD bytes (a longer one is a shard of its own). In each, the runs of words
that all occur in the benchmark are put into a suffix array of word numbers (other words
can't be part of a match and end a run). Every benchmark suffix whose
words all occur in the shard is then binary-searched there (any other can't be found; they are taken by
their rarest word, so that the work follows the shard, not the benchmark); the ranges it gets are the places where the next `width` words of the item
(or the whole item, if shorter) stand verbatim. Neighbouring hits on one diagonal are
merged into the longest verbatim matches. Affected documents can be removed whole.

Words: ASCII letters lower-cased, runs of anything but ASCII non-alphanumerics.

Edge cases: null and empty texts have no words and never match; items without words are
ignored; an item id on several rows counts once; an empty benchmark finds nothing; rows
are judged each on its own, repeated and null ids included. Other columns aren't read by `find_matches`, whatever their
names, and all kept by `remove_contaminated`.

The benchmark is read in blocks of at most BLOCK_CHARS characters, each of which is sent to
the executors and searched over all documents; documents are shuffled in neither case. With
more than one block, rows are numbered and written once, and partial results meet by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import textops as X
from tracklake.llm.cluster import materialise
from tracklake.llm.suffix import search, suffix_array

WIDTH = 10
BLOCK_CHARS = 16_000_000
SHARD = 3 << 20


class Block:
    """Benchmark items as word numbers, and their suffixes as queries."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        texts = pa.array([t for _, t in items], type=pa.large_string())
        hashes, firsts, base = [], [], 0
        for s in X.slices(texts):
            buf = X.lower_ascii(s.buf)
            start, end, first = X.word_spans(buf, s.offsets, X.NOT_ALNUM)
            hashes.append(X.span_hash(X.prefix_hash(buf), start, end))
            firsts.append(first[:-1] + base)
            base += len(start)
        words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        first = np.concatenate([*firsts, [base]]).astype(np.int64)
        self.names = [n for n, _ in items]
        self.vocab = np.unique(words)
        codes = np.searchsorted(self.vocab, words) + 1
        n = np.diff(first)
        length = np.minimum(n, width)
        item = np.repeat(np.arange(len(n)), np.maximum(n - length + 1, 0) * (n > 0))
        offset = np.arange(len(item)) - np.concatenate([[0], np.cumsum(np.maximum(n - length + 1, 0) * (n > 0))])[item] if len(item) else np.empty(0, np.int64)
        padded = np.concatenate([codes, np.zeros(width, dtype=np.int64)])
        self.item, self.offset, self.length = item, offset, length[item]
        self.queries = (padded[(first[item] + offset)[:, None] + np.arange(width)] if len(item) else np.empty((0, width), np.int64)).astype(np.int32)
        # queries by the word of theirs that the benchmark has least often
        often = np.bincount(codes, minlength=len(self.vocab) + 1)
        inside = np.arange(width)[None, :] < self.length[:, None]
        rare = self.queries[np.arange(len(item)), np.where(inside, often[self.queries], len(codes) + 1).argmin(axis=1)] if len(item) else np.empty(0, np.int32)
        self.by_rare = np.argsort(rare, kind="stable")
        self.rare_first = np.searchsorted(rare[self.by_rare], np.arange(len(self.vocab) + 2))
        self.shortest = int(self.length.min()) if len(item) else 0


def possible(block: Block, code: np.ndarray) -> np.ndarray:
    """Queries whose words are all among the codes: only those whose rarest word is are looked at."""
    present = np.zeros(len(block.vocab) + 1, dtype=bool)
    present[code] = True
    has = np.flatnonzero(present[1:]) + 1
    first, n = block.rare_first[has], block.rare_first[has + 1] - block.rare_first[has]
    query = block.by_rare[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(has) else block.by_rare[:0]
    inside = np.arange(block.queries.shape[1])[None, :] < block.length[query][:, None]
    return np.sort(query[(present[block.queries[query]] | ~inside).all(axis=1)])


def find_in_slice(buf: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """First word of each document, hits (doc, word position in the slice, query), word spans."""
    buf = X.lower_ascii(buf)
    start, end, firsts = X.word_spans(buf, offsets, X.NOT_ALNUM)
    none = {k: np.empty(0, np.int64) for k in ("doc", "at", "query")}
    if not len(block.item) or not len(start):
        return firsts, none, (start, end)
    h = X.span_hash(X.prefix_hash(buf), start, end)
    spot = np.minimum(np.searchsorted(block.vocab, h), len(block.vocab) - 1)
    code = np.where(block.vocab[spot] == h, spot + 1, 0)
    # runs of benchmark words that stay in a document and are long enough for the shortest query
    known = code > 0
    breaks = np.zeros(len(code) + 1, dtype=bool)
    breaks[0] = breaks[-1] = True
    breaks[1:-1] = known[1:] != known[:-1]
    breaks[firsts] = True
    edges = np.flatnonzero(breaks)
    run, run_end = edges[:-1], edges[1:]
    good = known[run] & (run_end - run >= block.shortest)
    run, size = run[good], (run_end - run)[good]
    if not len(run):
        return firsts, none, (start, end)
    # each run, then a 0 that ends it
    total = size + 1
    base = np.concatenate([[0], np.cumsum(total)])
    source = np.arange(base[-1]) - np.repeat(base[:-1], total) + np.repeat(run, total)
    text = np.where(np.arange(base[-1]) - np.repeat(base[:-1], total) < np.repeat(size, total), code[np.minimum(source, len(code) - 1)], 0)
    asked = possible(block, text[text > 0])
    if not len(asked):
        return firsts, none, (start, end)
    order = suffix_array(text, int(block.length[asked].max()), np.flatnonzero(text))
    low, high = search(text, order, block.queries[asked].astype(np.int64), block.length[asked])
    n = high - low
    query = np.repeat(asked, n)
    slot = np.arange(len(query)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.repeat(low, n)
    at = source[order[slot]] if len(slot) else np.empty(0, np.int64)
    return firsts, {"doc": np.searchsorted(firsts, at, side="right") - 1, "at": at, "query": query}, (start, end)


def _summaries(column: pa.Array, block: Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str], list[tuple[str, int, int, int]]]]:
    """(row, words, starts and ends of hit words' runs, item ids, longest matches) of each document."""
    for s in X.slices(column, SHARD):
        firsts, hits, _ = find_in_slice(s.buf, s.offsets, block)
        order = np.argsort(hits["doc"], kind="stable")
        doc = hits["doc"][order]
        cut = np.searchsorted(doc, np.arange(s.n_docs + 1))
        for k in range(s.n_docs):
            n_words = int(firsts[k + 1] - firsts[k])
            if cut[k] == cut[k + 1]:
                yield s.row + k, n_words, np.empty(0, np.int64), np.empty(0, np.int64), [], []
                continue
            mine = order[cut[k] : cut[k + 1]]
            at, query = hits["at"][mine] - firsts[k], hits["query"][mine]
            starts, ends = merge(at, at + block.length[query])
            item = block.item[query]
            yield s.row + k, n_words, starts, ends, sorted({block.names[i] for i in np.unique(item)}), longest(at, block.offset[query], item, block.length[query], block.names)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; those that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


def longest(at: np.ndarray, offset: np.ndarray, item: np.ndarray, length: np.ndarray, names: list[str]) -> list[tuple[str, int, int, int]]:
    """(item, first word in the document, first word in the item, words): hits that follow
    each other on one diagonal are one match."""
    order = np.lexsort((at, at - offset, item))
    a, o, i, n = at[order], offset[order], item[order], length[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (a[1:] - o[1:] != a[:-1] - o[:-1]) | (a[1:] != a[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(a) - 1]])
    return [(names[i[f]], int(a[f]), int(o[f]), int(a[t] - a[f] + n[t])) for f, t in zip(first, last, strict=True)]


def blocks(bench: DataFrame, id_col: str, text_col: str, width: int, max_chars: int) -> Iterator[Block]:
    """The benchmark, at most max_chars characters (or one item) at a time."""
    part: list[tuple[str, str]] = []
    size = 0
    rows = bench.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        if part and size + len(r["t"]) > max_chars:
            yield Block(part, width)
            part, size = [], 0
        part.append((r["i"], r["t"]))
        size += len(r["t"])
    if part:
        yield Block(part, width)


SCHEMA = "id {kind}, n_words long, starts array<long>, ends array<long>, items array<string>, matches array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"


def find_matches(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: id, n_words, starts and ends of the runs of hit words, items, and
    matches, the longest verbatim matches with their places."""
    kind = dict(docs.dtypes)[doc_id]
    schema = "row long, " + SCHEMA.format(kind=kind)
    spark = docs.sparkSession
    found = []
    size = bench.agg(F.sum(F.length(item_text))).first()[0] or 0
    several = size > block_chars
    rows = docs.select((F.monotonically_increasing_id() if several else F.lit(0).cast("long")).alias("row"), doc_id, doc_text)
    if several:
        rows = materialise(rows)  # so that a row has one number in all blocks
    every = blocks(bench, item_id, item_text, width, block_chars)
    # one block at a time is in the driver's memory, and later only on disk, as a broadcast
    for block in chain([next(every, None) or Block([], width)], every):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            types = pa.schema([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])))])
            keys = ("item_id", "doc_word", "item_word", "n_words")
            for b in batches:
                rows = list(_summaries(b.column(2), sent.value))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tolist() for r in rows], types[0].type), pa.array([r[3].tolist() for r in rows], types[1].type), pa.array([r[4] for r in rows], types[2].type), pa.array([[dict(zip(keys, m, strict=True)) for m in r[5]] for r in rows], types[3].type)],
                    names=["row", "id", "n_words", "starts", "ends", "items", "matches"],
                )

        found.append(rows.mapInArrow(run, schema))
    if len(found) == 1:
        return found[0].drop("row")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    union = F.udf(_union, "struct<starts:array<long>,ends:array<long>>")
    met = every.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("s"), F.flatten(F.collect_list("ends")).alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"))
    return met.withColumn("u", union("s", "e")).select("id", "n_words", "u.starts", "u.ends", "items", "matches")


def _union(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    s, e = merge(np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64))
    return s.tolist(), e.tolist()


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the rows of find_matches."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns; no shuffle."""
    at, spark = docs.columns.index(doc_text), docs.sparkSession
    for block in blocks(bench, item_id, item_text, width, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, dtype=bool)
                for s in X.slices(b.column(at), SHARD):
                    _, hits, _ = find_in_slice(s.buf, s.offsets, sent.value)
                    clean[s.row + hits["doc"]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def items_sha256(items: list[str]) -> str:
    """The digest of a list of item ids, as in `digest`."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
