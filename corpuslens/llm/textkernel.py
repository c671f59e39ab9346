"""Vectorised text kernels over Arrow string buffers.

Every function works on the UTF-8 bytes of a whole batch of texts at once, so that word splitting, hashing and
counting cost a few numpy passes instead of a Python step for each word.  Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Separators of the quality contract: space and U+0009 to U+000D.
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of lower-cased alphanumeric words: every ASCII character but digits and letters.
ALNUM_SEP = np.ones(256, bool)
ALNUM_SEP[128:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    ALNUM_SEP[_a:_b] = False
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def tidy(run):
    """Make a batch iterator give freed memory back to the system when its task ends.

    Python workers live on through many tasks and stages, and the allocator would keep what the largest one took.
    """

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


@dataclass
class Slice:
    """Rows ``row0`` to ``row0 + rows`` of a batch: their bytes and the offsets of each text in them."""

    row0: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.off) - 1


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield Slice(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 2 * SLICE_BYTES:
            _powers[name] = have
    return have


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    n = len(buf)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("p", _P, n)[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power("i", _PINV, len(prefix))[start])


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``span_hash`` of spans that rise and don't overlap; a long text is worked on in stretches."""
    if len(buf) <= 2 * SLICE_BYTES:
        return span_hash(prefix_hash(buf), start, end)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a <= SLICE_BYTES:
            out[i:j] = span_hash(prefix_hash(buf[a:b]), start[i:j] - a, end[i:j] - a)
        else:  # one long span
            parts = [int(prefix_hash(buf[c : min(c + SLICE_BYTES, b)])[-1]) * pow(int(_P), c - a, 1 << 64) for c in range(a, b, SLICE_BYTES)]
            out[i] = mix(np.array([sum(parts) % (1 << 64)], np.uint64))[0]
        i = j
    return out


def find_words(s: Slice, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that aren't separators, in text order."""
    n = len(s.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~sep[s.buf]
    first = np.zeros(n + 1, bool)
    first[s.off[:-1]] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = np.zeros(n + 1, bool)
    end[1:n] = word[:-1] & (~word[1:] | first[1:n])
    end[n] = word[n - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end), np.searchsorted(s.off, starts, "right") - 1


def count_in_rows(s: Slice, flags: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes each row has."""
    if s.rows == 1:
        return np.array([np.count_nonzero(flags)])
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[s.off[1:]] - total[s.off[:-1]]


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def word_grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``k`` words within a row, and the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = (acc + hashes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        acc ^= acc >> np.uint64(32)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(acc[at]), at


def chars(s: Slice, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One value for each character (its UTF-8 bytes, the first one lowest), and where each row's begin."""
    if not len(buf) or buf.max() < 0x80:
        return buf.astype(np.uint32), s.off
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    value = buf[at].astype(np.uint32)
    wide = np.flatnonzero(value >= 0xC0)
    padded = np.concatenate([buf, np.zeros(3, np.uint8)])
    inside = np.ones(len(wide), bool)
    for j in (1, 2, 3):
        b = padded[at[wide] + j]
        inside &= (b & 0xC0) == 0x80
        value[wide] |= np.where(inside, b, 0).astype(np.uint32) << np.uint32(8 * j)
    return value, np.searchsorted(at, s.off)


def stretches(value: np.ndarray, off: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Characters and row offsets as they are, or a long text in parts that hold each window of ``k`` once."""
    if len(value) <= 2 * SLICE_BYTES or len(off) > 2:
        yield value, off
        return
    for i in range(0, len(value) - k + 1, SLICE_BYTES):
        part = value[i : i + SLICE_BYTES + k - 1]
        yield part, np.array([0, len(part)])


def char_grams(value: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of each window of ``k`` characters within a row, and the place of its first one."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint32)
    for i in range(k):
        acc = (acc + value[i : i + n]) * np.uint32(0x9E3779B1)
        acc ^= acc >> np.uint32(15)
    ok = np.ones(n, bool)
    cut = (off[1:-1, None] - np.arange(1, k)).ravel()
    ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    return acc[at] * np.uint32(0x85EBCA6B), at


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters and the two-byte letters U+00C0 to U+00DE."""
    out = LOWER[buf]
    if len(out) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def hash_text(word: str) -> int:
    """The hash that ``span_hash`` gives this word wherever it stands."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])
