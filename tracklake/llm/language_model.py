"""LM scoring by cross-entropy difference.

Two n-gram models, of the target documents and of the whole corpus, share one vocabulary of
hashed words and one of hashed word pairs. Both are interpolated bigram models with the same
smoothing: p(w | c) = (n(c, w) + M * p(w)) / (n(c) + M), p(w) = (n(w) + 1/2) / (N + V / 2). The models are matched in
size: the background's counts, of all documents, are scaled to the target's number of words, so that the
smoothing weighs alike in both.
A document's score is the mean over its words of the target's loss less the background's:
below 0 where the target model expects the text better.

Counts are exact: words, contexts and pairs are kept apart by 64-bit hashes, in keyed tables that grow
with the distinct n-grams of the input. Documents are dealt to chunks of about CHUNK bytes by their id,
as compressed blocks; a chunk sends each of its distinct keys once, with its counts, to the piece of the key's range; a piece
sums them and sends the totals back to the chunks that asked, in the order of their sorted keys, so that
no key goes back. The numbers of chunks and pieces grow with the input; nothing is broadcast but
the number of words.

Edge cases: null and empty texts have no words and score null; without any target document
the target model is uniform and the background isn't scaled; a label on several rows counts once; repeated rows count and are
scored each on its own. Texts are read whole, a long one as a slice of its own; other columns aren't read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import textops as X
from tracklake.llm.cluster import materialise

#: Bits of a hash that keep n-grams apart.
BITS = 64
MASS = 8.0
#: Bytes of text of a chunk of documents, and bytes for which a kind of n-gram gets a piece.
CHUNK, PIECE = 16 << 20, 16 << 20
#: Bytes a task holds before it gives out its blocks.
HELD = 32 << 20
#: Columns of counts of words (as words and as contexts, in the target and in all documents) and of pairs.
COUNTS = (4, 2)
_START = np.uint64(0x51ED270B35CB1A6D)


def places(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each document, and keys of each word, of the word before, and of the two."""
    low = X.lower_ascii(buf)
    start, end, firsts = X.word_spans(low, offsets)
    word = X.span_hash(X.prefix_hash(low), start, end)
    before = np.concatenate([[_START], word[:-1]]) if len(word) else word
    before[firsts[:-1][firsts[:-1] < len(word)]] = _START
    pair = X.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)
    low_bits = np.uint64(64 - bits)
    return firsts, *((x >> low_bits) << low_bits for x in (word, before, pair))


def blocks(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, size, block): rows of id, text and chunk as compressed Arrow streams of a chunk each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def give() -> pa.RecordBatch:
            rows = []
            for chunk, parts in held.items():
                sink = pa.BufferOutputStream()
                whole = pa.Table.from_batches(parts).combine_chunks()
                with pa.ipc.new_stream(sink, whole.schema) as to:
                    to.write_table(whole)
                raw = sink.getvalue()
                rows.append({"chunk": chunk, "size": raw.size, "block": pa.compress(raw, codec="zstd", asbytes=True)})
            held.clear()
            return pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int32()), ("size", pa.int64()), ("block", pa.binary())]))

        size = 0
        for b in batches:
            chunk = b.column(2).to_numpy()
            order = np.argsort(chunk, kind="stable")
            sorted_rows = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order)), b.column(1).take(pa.array(order))], names=["id", "text"])
            first = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            for at, end in zip(first, [*first[1:], len(order)], strict=True):
                held.setdefault(int(chunk[order[at]]), []).append(sorted_rows.slice(at, end - at))
            size += b.nbytes
            if size >= HELD:
                yield give()
                size = 0
        if held:
            yield give()

    return docs.mapInArrow(run, "chunk int, size long, block binary")


def rows_of(t: pa.Table) -> pa.Table:
    """The id and text of a chunk's blocks."""
    return pa.concat_tables([pa.ipc.open_stream(pa.decompress(x.as_py(), decompressed_size=n.as_py(), codec="zstd")).read_all() for x, n in zip(t["block"], t["size"], strict=True)]) if len(t) else pa.table({"id": pa.array([], pa.null()), "text": pa.array([], pa.string())})


def keys_of(column: pa.ChunkedArray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each document; the distinct keys of words and contexts, sorted, and each word's and
    each context's place among them; the distinct keys of pairs and each pair's place."""
    sizes, found = [np.empty(0, np.int64)], [[np.empty(0, np.uint64)] for _ in range(3)]
    for s in X.slices(column.combine_chunks()):
        firsts, *keys = places(s.buf, s.offsets, bits)
        sizes.append(np.diff(firsts))
        for have, k in zip(found, keys, strict=True):
            have.append(k)
    word, before, pair = (np.concatenate(x) for x in found)
    words = np.unique(np.append(word, _START >> np.uint64(64 - bits) << np.uint64(64 - bits)))
    return np.concatenate(sizes), words, np.searchsorted(words, word), np.searchsorted(words, before), *np.unique(pair, return_inverse=True)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers of one length, byte planes apart, so that small numbers take little."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n)


_SENT = pa.schema([("piece", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("packed", pa.binary())])
_TOTALS = "piece int, chunk int, n long, packed binary, n_keys long, n_all long, n_target long"


def asked(parts: DataFrame, targets: DataFrame, pieces: int, bits: int) -> DataFrame:
    """(piece, chunk, n, packed): a chunk's distinct keys of a piece, as differences, and their counts. Pieces are
    ranges of keys, those of pairs after those of words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = rows_of(left)
        sizes, words, word, before, pairs, pair = keys_of(docs["text"], bits)
        # targets without a document here, or the other way round
        flag = pc.is_in(docs["id"], value_set=right["id"].combine_chunks(), skip_nulls=True).to_numpy() if len(docs) and len(right) else np.zeros(len(docs), bool)
        mine = np.repeat(flag.astype(bool), sizes)
        rows = []
        for kind, (keys, at_each) in enumerate(((words, (word, before)), (pairs, (pair,)))):
            counts = [np.bincount(at[m], minlength=len(keys)) for at in at_each for m in (mine, slice(None))]
            edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32), np.arange(pieces + 1))
            for k in np.flatnonzero(np.diff(edges)) if len(docs) else ():
                part = slice(edges[k], edges[k + 1])
                packed = pack(np.diff(keys[part], prepend=np.uint64(0)), *(x[part] for x in counts))
                rows.append({"piece": kind * pieces + int(k), "chunk": left["chunk"][0].as_py(), "n": int(edges[k + 1] - edges[k]), "packed": packed})
        return pa.Table.from_pylist(rows, _SENT)

    return parts.groupBy("chunk").cogroup(targets.groupBy("chunk")).applyInArrow(run, "piece int, chunk int, n long, packed binary")


def answered(sent: DataFrame, pieces: int) -> DataFrame:
    """The same rows with counts over all chunks and without keys; the first row of a piece of words has its
    number of distinct words and how many words there are in all and in the target documents."""

    def run(t: pa.Table) -> pa.Table:
        kind = t["piece"][0].as_py() // pieces
        sizes = t["n"].to_numpy()
        keys, *counts = np.concatenate([unpack(x.as_py(), n, 1 + COUNTS[kind]) for x, n in zip(t["packed"], sizes, strict=True)], axis=1)
        ends = np.cumsum(sizes)
        keys = np.concatenate([np.cumsum(x.view(np.uint64), dtype=np.uint64) for x in np.split(keys, ends[:-1])])
        distinct, at = np.unique(keys, return_inverse=True)
        totals = [np.bincount(at, weights=x, minlength=len(distinct)).astype(np.int64) for x in counts]
        packed = [pack(*(x[part] for x in totals)) for part in np.split(at, ends[:-1])]
        sums = (np.count_nonzero(totals[1]), totals[1].sum(), totals[0].sum()) if kind == 0 else (0, 0, 0)
        once = [pa.array([int(x)] + [0] * (len(sizes) - 1), pa.int64()) for x in sums]
        return pa.Table.from_arrays([t["piece"], t["chunk"], t["n"], pa.array(packed, pa.binary()), *once], names=[x.split(" ")[0] for x in _TOTALS.split(", ")])

    return sent.groupBy("piece").applyInArrow(run, _TOTALS)


def losses(parts: DataFrame, totals: DataFrame, sums: tuple[int, int, int], kind: str, pieces: int, bits: int) -> DataFrame:
    vocabulary, n_all, n_target = max(1, sums[0]), sums[1], sums[2]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = rows_of(left)
        sizes, words, word, before, pairs, pair = keys_of(docs["text"], bits)
        order = np.argsort(right["piece"].to_numpy())
        rows = [right.slice(k, 1).to_pylist()[0] for k in order]
        counts = [np.concatenate([np.empty((n, 0), np.int64), *(unpack(r["packed"], r["n"], n) for r in rows if r["piece"] // pieces == k)], axis=1) for k, n in enumerate(COUNTS)]
        if (len(words), len(pairs)) != (counts[0].shape[1], counts[1].shape[1]):
            raise RuntimeError(f"chunk has {len(words)} words and {len(pairs)} pairs, counts of {counts[0].shape[1]} and {counts[1].shape[1]}: the documents changed between reads")
        edges = np.concatenate([[0], np.cumsum(sizes)])
        none, each, cols = sizes == 0, np.maximum(sizes, 1), []
        for m, (n, scale) in enumerate(((n_target, 1.0), (n_all, n_target / n_all if n_target else 1.0))):
            p = (scale * counts[0][m][word] + 0.5) / (scale * n + vocabulary / 2)
            total = np.concatenate([[0.0], np.cumsum(-np.log((scale * counts[1][m][pair] + MASS * p) / (scale * counts[0][2 + m][before] + MASS)))])
            cols.append((total[edges[1:]] - total[edges[:-1]]) / each)
        cols.append(cols[0] - cols[1])
        return pa.Table.from_arrays([docs["id"].combine_chunks(), pa.array(sizes.astype(np.int64)), *(pa.array(x, mask=none) for x in cols)], names=["id", "n_words", "target_loss", "background_loss", "score"])

    return parts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, f"id {kind}, n_words long, target_loss double, background_loss double, score double")


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """id, n_words, target_loss, background_loss, score (their difference), per word."""
    kind = dict(docs.dtypes)[id_col]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, pieces = -(-size // CHUNK) or 1, -(-size // PIECE) or 1
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")
    # rows without an id aren't targets, so they may go anywhere
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = rows.select("id", "text", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("int")).otherwise(chunk).alias("chunk"))
    good = targets.select(F.col(id_col).cast(kind).alias("id")).where("id is not null").distinct().select("id", chunk)
    parts = blocks(rows, chunks)
    totals = materialise(answered(asked(parts, good, pieces, bits), pieces))
    sums = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_keys", "n_all", "n_target"))).first()
    return losses(parts, totals.select("piece", "chunk", "n", "packed"), tuple(sums), kind, pieces, bits).withColumnRenamed("id", id_col)
