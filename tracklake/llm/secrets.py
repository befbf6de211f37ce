"""Secret scans: fixed patterns, and zstandard novelty, which names strings by what they cost to compress.

A candidate is a string of 16 or more characters of a code alphabet, with letters and
digits, shortly after a sensitive word. Its novelty is the marginal cost of compression: the
zstandard size of the surrounding code with it, less that without it, both primed with a
dictionary of identifiers: a fixed list, and the DICTIONARY_WORDS parts of identifiers and words that
most documents of the corpus have (counted over all of them; PART_DOCS at least, so that no key primes itself). Candidates and surroundings are
split at case changes, digits and punctuation first, so that the words of a name are found whatever
joins them, and other copies of the candidate are taken out of its surroundings. The cost is compared with
that of random strings of the same alphabet and length, split alike, in the same place: a
candidate that costs nearly as much is reported as `novel`; names, paths and words that the
surroundings or the dictionary have already cost less. A value that a fixed pattern has too gets a span of
each kind.

Edge cases: null and empty texts have no spans; repeated rows are scanned each on its own;
texts are scanned whole, and a long candidate is measured whole, in pieces of PIECE characters. Spans are
in code points, end exclusive. Other columns aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import textops as X
from tracklake.llm.cluster import materialise

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|cred|private|bearer|sign|access|session|login", re.I | re.A)
#: Code points before a candidate in which a sensitive word must stand, and around it that prime its measure.
REACH, AROUND = 48, 256
#: Marginal bytes over those of random strings of the candidate's alphabet, and how many of these are tried.
NOVELTY, CONTROLS = 0.82, 4
#: Characters of a candidate that are measured at a time.
PIECE = 256
#: Parts of identifiers and words from the corpus in the dictionary, documents that must have one, and its letters.
DICTIONARY_WORDS, PART_DOCS, LETTERS = 8000, 5, (3, 24)
#: Distinct parts a task holds before it gives them out.
HELD_PARTS = 40_000
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HINTS = (b"key", b"secret", b"token", b"passw", b"pwd", b"auth", b"cred", b"private", b"bearer", b"sign", b"access", b"session", b"login")
#: Identifiers that are common in code.
IDENTIFIERS = """
access_token api_key apikey auth_token authorization bearer client_id client_secret config
connection_string const credentials database_url default description encryption environment
export false function getenv header headers host http https import include localhost login
module null object option options os.environ parameter password path port private_key
process.env production public_key refresh_token request response return secret_key self
session_id session_token setting settings sha256 signature signing_key staging static string
timeout token true undefined url user user_id username utf-8 value variable version
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx example
placeholder changeme your_api_key_here your-secret-key-here insert_token_here
"""


PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9\s]")
#: Alphabets of keys, the smallest first.
ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.digits + string.ascii_letters)


def split(text: str) -> str:
    """The parts of identifiers and words in lower case, with a space around each letter or digit run."""
    return " ".join(x for x in PARTS.findall(text) if x[0].isalnum()).lower()


def control(word: str, seed: int) -> str:
    """A random string over the smallest alphabet that holds the word's letters and digits; others stay."""
    rng = random.Random(f"{seed}:{word}")
    used = {c for c in word if c.isalnum()}
    alphabet = next(a for a in ALPHABETS if used <= set(a))
    return "".join(rng.choice(alphabet) if c.isalnum() else c for c in word)


class Novelty:
    """Marginal compressed bytes of strings in their surroundings, primed with identifiers, the most common last."""

    def __init__(self, identifiers: str):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=19)
        self._size = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)

    def bytes(self, around: str, text: str) -> int:
        return len(self._size.compress(f"{around} {text} ".encode())) - len(self._size.compress(f"{around} ".encode()))

    def share(self, before: str, word: str, after: str) -> float:
        """The word's marginal bytes over those of random strings like it."""
        around = split(before.replace(word, " ") + " " + after.replace(word, " "))
        pieces = [word[k : k + PIECE] for k in range(0, len(word), PIECE)]
        cost = sum(self.bytes(around, split(x)) for x in pieces)
        usual = sum(self.bytes(around, split(control(x, k))) for x in pieces for k in range(CONTROLS)) / CONTROLS
        return cost / max(usual, 1)


def part_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, n): in how many documents each run of letters without a change of case stands, lower-cased; summed in each
    task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in total.values()], pa.string()), pa.array([x[1] for x in total.values()], pa.int64())], names=["part", "n"])
            total.clear()
            return out

        for b in batches:
            for s in X.slices(b.column(0)):
                low = X.lower_ascii(s.buf)
                letter = (low >= 97) & (low <= 122)
                upper = letter & (low != s.buf)
                doc = np.repeat(np.arange(s.n_docs, dtype=np.int32), np.diff(s.offsets))
                joined = letter[1:] & letter[:-1] & ~(upper[1:] & ~upper[:-1]) & (doc[1:] == doc[:-1])
                begin = np.flatnonzero(letter & ~np.concatenate([[False], joined]))
                end = np.flatnonzero(letter & ~np.concatenate([joined, [False]])) + 1
                ok = (end - begin >= LETTERS[0]) & (end - begin <= LETTERS[1])
                begin, end = begin[ok], end[ok]
                key = X.span_hash(X.prefix_hash(low), begin, end)
                once = np.unique(X.mix(key ^ X.mix(doc[begin].astype(np.uint64))), return_index=True)[1]
                key, at, n = np.unique(key[once], return_index=True, return_counts=True)
                for k, i, c in zip(key.tolist(), once[at].tolist(), n.tolist(), strict=True):
                    if k in total:
                        total[k][1] += c
                    else:
                        total[k] = [low[begin[i] : end[i]].tobytes().decode(), c]
                if len(total) > HELD_PARTS:
                    yield give()
        yield give()

    return docs.select(text).mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, text: str = "text", words: int | None = None) -> str:
    """The fixed identifiers and the corpus's most common parts, the most common last.

    Counts are binned by their first five bits (under 1100 bins); of the bins from the top, as many as have `words`
    parts at most come to the driver.
    """
    most = words or DICTIONARY_WORDS
    low = F.greatest(F.length(F.bin("n")) - 5, F.lit(0))
    parts = materialise(part_counts(docs, text).where(F.col("n") >= PART_DOCS).withColumn("low", low).withColumn("bin", F.expr("shiftleft(shiftright(n, low), low)")).drop("low"))
    least, total = None, 0
    for r in sorted(parts.groupBy("bin").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["bin"]
    rows = parts.where(F.col("bin") >= least).collect() if least is not None else []
    return " ".join([split(IDENTIFIERS), *(r["part"] for r in sorted(rows, key=lambda r: (r["n"], r["part"])))]) + " "


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, low: bytes, novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, 3, end) of strings that are incompressible in a sensitive context, whether a fixed pattern has them or not."""
    if not any(h in low for h in _HINTS):
        return []
    out = []
    near = [m.end() for m in SENSITIVE.finditer(text)]
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        k = bisect_right(near, s)
        if not k or near[k - 1] < s - REACH:
            continue
        if not (re.search(r"[0-9]", m.group()) and re.search(r"[A-Za-z]", m.group())):
            continue
        if novelty.share(*surroundings(text, s, e)) >= NOVELTY:
            out.append((s, 3, e))
    return out


def surroundings(text: str, start: int, end: int) -> tuple[str, str, str]:
    """AROUND characters before a candidate, it and as many after it, without strings that the edges cut."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    if start > AROUND:
        before = re.sub(r"^[A-Za-z0-9+/_=-]+", "", before)
    if end + AROUND < len(text):
        after = re.sub(r"[A-Za-z0-9+/_=-]+$", "", after)
    return before, text[start:end], after


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", identifiers: str | None = None) -> DataFrame:
    """One row per document: id, the number of spans of each base kind, base_sha256 and spans. identifiers, if
    given, stand for the dictionary of the corpus."""
    kind = dict(docs.dtypes)[id_col]
    primed = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text) if identifiers is None else identifiers)  # DICTIONARY_WORDS * 25 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed.value)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                t = value.as_py() or ""
                low = t.encode("utf-8", "replace").lower()
                base = base_spans(t, low)
                counts = [sum(1 for x in base if x[1] == k) for k in range(3)]
                rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + novel_spans(t, low, novelty)))))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(5)]], names=["id", *names])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
