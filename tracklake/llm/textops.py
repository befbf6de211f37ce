"""Vectorised text kernels shared by the operators.

Arrow string columns are looked at as UTF-8 bytes. Documents are cut into slices of
about a megabyte (a longer document is a slice of its own), and each kernel works on
the bytes of one slice with numpy, so that memory follows the slice, not the input.

Hashes are 64-bit: a polynomial in a fixed odd multiplier over a table of random byte
values, then mixed with the length. They depend on nothing but the bytes, so reruns on
other executors give the same values.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.RandomState(20240611)
_BYTE = (_rng.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, 256, dtype=np.uint64)
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
#: The lowest 0 to 8 bytes of a value, and bytes from which a word is hashed by itself.
_LOW, LONG_WORD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64), 64
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, SLICE_BYTES + 4096), _MUL if kind == "mul" else _INV, dtype=np.uint64)
        base[0] = 1
        have = np.cumprod(base)
        if n <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span of buf."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * _power("mul", len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends)."""
    raw = (prefix[ends] - prefix[starts]) * _power("inv", len(prefix))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends), made eight bytes at a time: for spans that are short and many."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place
    size = ends - starts
    out = mix((eight[starts] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    more = np.flatnonzero(size > 8)
    for k in range(8, LONG_WORD, 8):
        if not len(more):
            return out
        out[more] = mix((out[more] ^ (eight[starts[more] + k] & _LOW[np.minimum(size[more] - k, 8)])) * np.uint64(_MUL) + np.uint64(k))
        more = more[size[more] > k + 8]
    raw = memoryview(padded)
    out[more] = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[more].tolist(), ends[more].tolist(), strict=True)), "<u8")
    return out


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive values (length len(words) - width + 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(_MUL)
        out += words[k : k + n]
    return mix(out + np.uint64(width))


class Slice:
    """Consecutive documents of one Arrow batch: bytes and the offsets of each document."""

    __slots__ = ("row", "buf", "offsets")

    def __init__(self, row: int, buf: np.ndarray, offsets: np.ndarray):
        self.row, self.buf, self.offsets = row, buf, offsets

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if column.null_count:
        null = ~column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(at)[null] > 0).any():  # bytes under nulls are allowed, but not usual
            return text_buffers(column.fill_null(""))
    return buf, at


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of at most max_bytes, whole documents each."""
    if not len(column):
        return
    buf, at = text_buffers(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + max_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield Slice(row, buf[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end
    if at[-1] - at[0] > 4 * SLICE_BYTES:
        release()


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that aren't part of a word of letters and digits: ASCII other than 0-9, a-z (text is lower-cased first).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    upper = (buf >= 65) & (buf <= 90)
    return buf + (upper.view(np.uint8) << np.uint8(5))


def word_spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the first word of each document
    (n_docs + 1 values). Words end at gap bytes and at document ends."""
    return spans(~gap[buf], offsets)


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, of bytes of which word says whether they are part of one."""
    edge = np.zeros(len(word) + 1, dtype=bool)
    if len(word):
        edge[0] = word[0]
        edge[-1] = word[-1]
        edge[1:-1] = word[1:] != word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(word))]
    split = np.unique(inner[word[inner - 1] & word[inner]]) if len(inner) else inner
    flips = np.flatnonzero(edge)
    if len(split):
        flips = np.sort(np.concatenate([flips, split, split]))
    starts, ends = flips[0::2], flips[1::2]
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def doc_of(firsts: np.ndarray, n: int) -> np.ndarray:
    """Document index of each of n items, given the first item of each document."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def windows(firsts: np.ndarray, width: int) -> np.ndarray:
    """Mask over item positions: a run of `width` items from there stays in its document."""
    n = int(firsts[-1])
    ok = np.zeros(n, dtype=bool)
    if n:
        last = np.repeat(firsts[1:], np.diff(firsts))
        ok = np.arange(n) + width <= last
    return ok


def per_doc(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of values (one for each item) over each document."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[firsts[1:]] - total[firsts[:-1]]
