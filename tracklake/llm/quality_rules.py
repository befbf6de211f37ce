"""Quality rules with thresholds that follow the corpus.

Each document gets counts of its whole text. Six rates made of them are put into
fixed-bin quantile sketches, one for each language and source: a sketch is the number of
documents in each bin, so two sketches merge by adding bins, in any order and with the
same result. A sketch's quartiles say which bins may be its own documents' (Tukey's outer fences, with a least
spread where half of them have the same rate); of these bins it takes the median and the quantiles at TAIL, and
its fences lie half as far again from the median as these. Fences are averaged with those of the language,
and these with those of all (sketches are sums of the same bins), by numbers of documents against
SHRINK, so that few documents decide little and no size changes the rule. Documents are then joined
with the fences of their group.

Edge cases: a null or empty text has no words and fails the base rule. Null languages
and sources are groups of their own. Repeated rows are judged each on its own. An empty
table gives an empty result. Other columns of the input are ignored by `measure` and
kept by `filter_documents`; columns with the names of counts don't clash, as counts are
kept in one struct of a reserved name there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm import textops as X
from tracklake.llm.cluster import materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutter")
WINDOW = 8
BINS = 1000
#: Bins beyond the quartiles by REACH * max(interquartile range, least spread of that rate) aren't looked at.
REACH = 3
#: Quantile, in thousandths, of the other bins from which a fence is taken, and its distance from the median in halves.
TAIL, HALVES = 995, 3
#: Documents that the language's fences weigh as many as, against a group's own; so do those of all against a language's.
SHRINK = 200
#: rate: (numerator, denominator, scale, least spread, lower fence too)
RATES = {
    "symbols": ("n_symbols", "word_chars", 1000, 15, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 160, False),
    "stutter": ("n_stutter", "n_words", 1000, 40, False),
    "upper": ("n_upper", "word_chars", 1000, 40, False),
    "length": ("word_chars", "n_words", 10, 10, True),
}
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def count_slice(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The counts of each document of a slice, one row each in the order of COUNTS."""
    starts, ends, firsts = X.word_spans(buf, offsets)
    n_docs = len(offsets) - 1
    inside = ~X.SPACE[buf]
    lead = (buf & 0xC0) != 0x80
    chars = X.per_doc(inside & lead, offsets)
    symbols = X.per_doc(_SYMBOL[buf], offsets)
    upper = X.per_doc((buf >= 65) & (buf <= 90), offsets)
    prefix = X.prefix_hash(buf)

    newline = np.zeros(256, dtype=bool)
    newline[10] = True
    l_start, l_end, l_first = X.word_spans(buf, offsets, newline)
    solid = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    has_word = solid[l_end] > solid[l_start]
    l_doc = X.doc_of(l_first, n_docs)[has_word]
    l_hash = X.mix(X.span_hash(prefix, l_start[has_word], l_end[has_word]) ^ X.mix(l_doc.astype(np.uint64) + np.uint64(1)))
    lines = np.bincount(l_doc, minlength=n_docs)
    distinct = np.zeros(n_docs, dtype=np.int64)
    if len(l_hash):
        _, keep = np.unique(l_hash, return_index=True)
        distinct = np.bincount(l_doc[keep], minlength=n_docs)

    words = np.diff(firsts)
    hashes = X.span_hash(prefix, starts, ends)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[firsts[:-1][firsts[:-1] < len(starts)]] = False
    stutter = X.per_doc(same, firsts)
    repeat = np.zeros(n_docs, dtype=np.int64)
    ok = X.windows(firsts, WINDOW)
    at = np.flatnonzero(ok)
    if len(at):
        doc = X.doc_of(firsts, n_docs)
        key = X.mix(X.combine(hashes, WINDOW)[at] ^ X.mix(doc[at].astype(np.uint64) + np.uint64(1)))
        sorted_ = np.sort(key)
        twice = np.unique(sorted_[1:][sorted_[1:] == sorted_[:-1]])
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            found = at[twice[spot] == key]
            edge = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(edge, found, 1)
            np.add.at(edge, found + WINDOW, -1)
            repeat = X.per_doc(np.cumsum(edge[:-1]) > 0, firsts)
    return np.stack([words, chars, symbols, lines - distinct, repeat, lines, upper, stutter], axis=1)


def counts_of(column: pa.Array) -> np.ndarray:
    parts = [count_slice(s.buf, s.offsets) for s in X.slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), dtype=np.int64)


def measure(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and the counts of each document; reads no other column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = counts_of(b.column(len(keys)))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keys))] + [pa.array(c[:, k]) for k in range(len(COUNTS))], names=[*keys, *COUNTS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{c} long" for c in COUNTS])
    return docs.select(*keys, text_col).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rate(name: str) -> Column:
    """A rate as the number of its bin, 0 to BINS."""
    top, bottom, scale, _, _ = RATES[name]
    return F.least(F.lit(BINS).cast("long"), F.expr(f"({scale} * {top}) div greatest({bottom}, 1)"))


def sketches(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rate, bin, n): documents that pass the base rule, by bin.

    Summed in each task before the shuffle, so a hot source sends a few hundred rows a task.
    """
    ok = counts.where(~base_failed())
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), rate(k).alias("bin")) for k in RATES])
    return ok.select(lang, source, F.explode(rates).alias("r")).groupBy(lang, source, "r.rate", "r.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, lang: str = "lang", source: str = "source", shrink: int = SHRINK) -> DataFrame:
    """(lang, source, and low_/high_ of each rate, in half bins), from the sketches of the group, its language and all."""
    from pyspark.sql import Window

    none = F.lit(None).cast("string")
    every = sketch.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.lit(1).alias("level"), "rate", "bin", "n")
    every = every.unionByName(sketch.groupBy(lang, "rate", "bin").agg(F.sum("n").alias("n")).select(F.col(lang).alias("g_lang"), none.alias("g_source"), F.lit(2).alias("level"), "rate", "bin", "n"))
    every = every.unionByName(sketch.groupBy("rate", "bin").agg(F.sum("n").alias("n")).select(none.alias("g_lang"), none.alias("g_source"), F.lit(3).alias("level"), "rate", "bin", "n"))
    group = ["level", "g_lang", "g_source"]
    w = Window.partitionBy(*group, "rate")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def at(thousandths: int) -> Column:
        return F.min(F.when(1000 * F.col("upto") >= thousandths * F.col("total"), F.col("bin")))

    cum = every.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(w))
    spread = F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v[3]))])[F.col("rate")]
    quart = cum.withColumn("q1", at(250).over(w)).withColumn("q3", at(750).over(w)).withColumn("docs", F.col("total")).withColumn("spread", spread)
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.col("spread"))
    inner = quart.withColumn("least", F.col("q1") - reach).withColumn("most", F.col("q3") + reach).where(F.col("bin").between(F.col("least"), F.col("most")))
    inner = inner.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(w))
    tails = inner.groupBy(*group, "rate").agg(at(500).alias("mid"), at(TAIL).alias("top"), at(1000 - TAIL).alias("bottom"), F.max("docs").alias("docs"), F.max("least").alias("least"), F.max("most").alias("most"), F.max("spread").alias("spread"))
    high = F.least(2 * F.col("most"), 2 * F.col("mid") + HALVES * (F.col("top") - F.col("mid")) + F.col("spread"))
    low = F.greatest(F.lit(0), 2 * F.col("least"), 2 * F.col("mid") - HALVES * (F.col("mid") - F.col("bottom")) - F.col("spread"))
    tails = tails.select(*group, "rate", "docs", low.cast("long").alias("low"), high.cast("long").alias("high"))
    cols = [f"{c}_{k}" for k in RATES for c in ("low", "high")]
    wide = tails.groupBy(*group).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{c}_{k}") for k in RATES for c in ("low", "high")])
    own = wide.where("level = 1").select(F.col("g_lang").alias(lang), F.col("g_source").alias(source), F.col("docs").alias("n1"), F.struct(*cols).alias("f1"))
    by_lang = wide.where("level = 2").select(F.col("g_lang").alias("l2"), F.col("docs").alias("n2"), F.struct(*cols).alias("f2"))
    of_all = wide.where("level = 3").select(F.struct(*cols).alias("f3"))  # one row
    out = own.join(by_lang, F.col(lang).eqNullSafe(F.col("l2"))).join(F.broadcast(of_all), F.lit(True))
    return out.select(lang, source, *[F.expr(f"(n1 * f1.{c} + {shrink} * ((n2 * f2.{c} + {shrink} * f3.{c}) div (n2 + {shrink}))) div (n1 + {shrink})").alias(c) for c in cols])


def inside() -> Column:
    """Whether every rate is within the fences on the row; true where the group has none."""
    out = F.lit(True)
    for k, v in RATES.items():
        ok = 2 * rate(k) <= F.col(f"high_{k}")
        if v[4]:
            ok = ok & (2 * rate(k) >= F.col(f"low_{k}"))
        out = out & F.coalesce(ok, F.lit(True))
    return out


#: Up to so many groups (a row of some 150 bytes each) are broadcast; more are joined by salted keys.
BROADCAST_GROUPS = 20_000
SALTS = 32


def join_fences(counted: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    fence = materialise(fence.withColumnsRenamed({lang: "f_lang", source: "f_source"}))
    on = F.col(lang).eqNullSafe(F.col("f_lang")) & F.col(source).eqNullSafe(F.col("f_source"))
    if fence.count() <= BROADCAST_GROUPS:
        return counted.join(F.broadcast(fence), on, "left")
    salted = fence.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = counted.withColumn("r_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_upper"), F.lit(SALTS)))
    return rows.join(salted, on & (F.col("r_salt") == F.col("f_salt")), "left")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source", shrink: int = SHRINK) -> DataFrame:
    """One row per document: id, counts, base_failed, kept."""
    counted = measure(docs, [id_col, lang, source], text_col)
    fence = fences(sketches(counted, lang, source), lang, source, shrink)
    joined = join_fences(counted, fence, lang, source)
    return joined.select(id_col, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside()).alias("kept"))


def filter_documents(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source", shrink: int = SHRINK) -> DataFrame:
    """The documents that are kept, with all their columns. Texts aren't shuffled: the
    second pass counts again and meets the fences in place."""
    fence = fences(sketches(measure(docs, [lang, source], text_col), lang, source), lang, source, shrink)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = counts_of(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c[:, k]) for k in range(len(COUNTS))]], names=[f"in_{k}" for k in range(len(names))] + list(COUNTS))

    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    schema = ", ".join([f"in_{k} {t}" for k, t in enumerate(kinds)] + [f"{c} long" for c in COUNTS])
    i_lang, i_source = (f"in_{names.index(c)}" for c in (lang, source))
    joined = join_fences(docs.mapInArrow(run, schema), fence.withColumnsRenamed({lang: i_lang, source: i_source}), i_lang, i_source)
    return joined.where(~base_failed() & inside()).select(*[F.col(f"in_{k}").alias(n) for k, n in enumerate(names)])
