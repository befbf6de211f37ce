"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Features of a document: words, pairs of words, shapes of words (runs of upper-case,
lower-case, digit and other characters, each run once) in runs of one to three, and
whether a word repeats the one before; all hashed into 2**BITS places. A feature's value is
1 + log(count), scaled to unit length over the document. Follow-the-regularised-leader
(proximal, with L1 and L2) runs over a bounded sample of the labelled rows (TRAIN_ROWS and TRAIN_BYTES) in one task; the
weights, of fixed size, are sent to all tasks, and a score is a sparse dot product.

Edge cases: null and empty texts have no features and score by the bias alone; several labels
of one document count as their mean; without any label, every score is 0.5; repeated rows
are scored each on its own; of labels of equal hash the smaller id comes first. Texts are read whole, a long one as a slice of
its own; other columns aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm import textops as X

BITS = 18
#: Bound of the training sample: the labelled rows with the smallest hashes of their ids.
TRAIN_ROWS = 8000
#: Bound of their texts' bytes, in the same order: a row that would exceed it is left out, and so are those after it.
TRAIN_BYTES = 96 << 20
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.02

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a slice in order of document: first entry of each, places, values."""
    n_docs = len(offsets) - 1
    start, end, firsts = X.word_spans(buf, offsets)
    shift = np.uint64(64 - bits)
    if not len(start):
        return np.zeros(n_docs + 1, dtype=np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    doc = X.doc_of(firsts, n_docs)
    word = X.span_hash(X.prefix_hash(buf), start, end)
    kind = _CLASS[buf]
    fresh = np.ones(len(buf), dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[start] = True
    spot = np.concatenate([[0], np.cumsum(fresh, dtype=np.int64)])
    shape = X.span_hash(X.prefix_hash(kind[fresh]), spot[start], spot[end], seed=7)
    keys, owners = [], []
    for n, (values, width) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        at = np.flatnonzero(X.windows(firsts, width))
        keys.append(X.mix(X.combine(values, width)[at] + np.uint64(n)) >> shift)
        owners.append(doc[at])
    at = np.flatnonzero(X.windows(firsts, 2))
    again = at[word[at] == word[at + 1]]
    keys.append(np.full(len(again), 12345 & ((1 << bits) - 1), dtype=np.uint64))
    owners.append(doc[again])
    both = (np.concatenate(owners).astype(np.int64) << bits) | np.concatenate(keys).astype(np.int64)
    both.sort()
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.concatenate([new, [len(both)]]))
    both = both[new]
    owner = both >> bits
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=n_docs))
    value = (value / norm[owner]).astype(np.float32)
    return np.searchsorted(owner, np.arange(n_docs + 1)), both & ((1 << bits) - 1), value


def ftrl(rows: Iterator[tuple[float, np.ndarray, np.ndarray]], epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights after `epochs` passes over (label, places, values); the last is the bias."""
    rows = list(rows)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for y, at, value in rows:
            at = np.append(at, 1 << bits)
            value = np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    return weight(np.arange((1 << bits) + 1)).astype(np.float32)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, mod folds, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text", max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from a sample of at most max_rows labelled rows that aren't held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(label).alias("label_mean"))
    known = known.where(~held_out(id_col)).withColumn("order", F.xxhash64(id_col)).orderBy("order", id_col).limit(max_rows)
    # at most max_rows rows of three numbers: broadcast
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text).alias("row_text"))
    chosen = rows.join(F.broadcast(known.withColumnRenamed(id_col, "label_id")), F.col("row_id") == F.col("label_id")).select("order", "label_mean", "row_text")
    # one number for each of at most max_rows labels
    sizes = sorted(tuple(r) for r in chosen.groupBy("order").agg(F.sum(F.coalesce(F.octet_length("row_text"), F.lit(0)))).collect())
    total = 0
    for order, size in sizes:
        total += size
        if total > TRAIN_BYTES:
            chosen = chosen.where(F.col("order") < order)
            break

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, values = [], []
            for s in X.slices(b.column(2)):
                first, at, value = features(s.buf, s.offsets)
                for k in range(s.n_docs):
                    places.append(at[first[k] : first[k + 1]].astype(np.uint32).tobytes())
                    values.append(value[first[k] : first[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["order", "label", "places", "values"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["order"], r["label"], r["places"]))
        w = ftrl((r["label"], np.frombuffer(r["places"], np.uint32).astype(np.int64), np.frombuffer(r["values"], np.float32)) for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    rows = chosen.mapInArrow(extract, "`order` long, label double, places binary, values binary")
    got = rows.repartition(1).mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score (0 to 1) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # (2**BITS + 1) * 4 bytes
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            parts = []
            for s in X.slices(b.column(1)):
                first, at, value = features(s.buf, s.offsets)
                total = np.concatenate([[0.0], np.cumsum(w[at].astype(np.float64) * value)])
                parts.append(1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["id", "score"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
