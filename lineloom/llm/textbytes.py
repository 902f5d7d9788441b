"""Vectorised text primitives over Arrow string buffers.

A slice is a run of documents of one record batch, small enough that the temporary arrays stay within
some tens of MB (a single longer document makes a slice of its own). Its bytes are one uint8 array;
words, k-grams and hashes are computed for all its documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i mod 2^64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def table(*spans: tuple[int, int]) -> np.ndarray:
    """A 256-entry class table, true on the given inclusive byte ranges."""
    t = np.zeros(256, bool)
    for a, b in spans:
        t[a : b + 1] = True
    return t


#: Words [^\x20\x09-\x0D]+
NONSPACE = ~table((0x20, 0x20), (0x09, 0x0D))
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
LETTERS = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Slice:
    """Documents lo..hi of a batch. edges: byte offsets of each document in data, and the end."""

    lo: int
    hi: int
    data: np.ndarray
    edges: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole documents of at most `most` bytes, or one longer document."""
    data, o = _buffers(column)
    n, lo = len(o) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + most, "right")) - 1)
        yield Slice(lo, hi, data[o[lo] : o[hi]], o[lo : hi + 1] - o[lo])
        lo = hi


@dataclass
class Words:
    """Word spans of a slice in order; of[i] is the first word of document i, of[-1] the count."""

    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.counts)


def words(s: Slice, data: np.ndarray, wordlike: np.ndarray) -> Words:
    """Maximal runs of bytes of a class, cut at document edges."""
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(s.n + 1, np.int64))
    w = wordlike[data]
    first = np.empty(len(w), bool)
    first[0] = True
    np.logical_not(w[:-1], out=first[1:])
    inner = s.edges[:-1]
    first[inner[inner < len(w)]] = True
    first &= w
    last = np.empty(len(w), bool)
    last[-1] = True
    np.logical_not(w[1:], out=last[:-1])
    ends = s.edges[1:]
    last[ends[ends > 0] - 1] = True
    last &= w
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, s.edges))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = sum of (data[k]+1) * B^k for i <= k < j, mod 2^64."""
    p, _ = powers(len(data))
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, equal for equal bytes wherever they stand."""
    _, inv = powers(len(h))
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


_GRAM = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingles(s: Slice, w: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, and the index of each one's first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        g += hashes[i : n - k + 1 + i] * _GRAM[i]
    d = w.docs
    at = np.flatnonzero(d[: n - k + 1] == d[k - 1 :])
    return mix(g[at]), at


def whole_hash(hashes: np.ndarray, lo: int, hi: int) -> np.uint64:
    """Hash of the word sequence lo..hi as one shingle, apart from those of any k-gram."""
    g = np.uint64(hi - lo)
    for i in range(lo, hi):
        g = mix(np.array([g ^ hashes[i]], np.uint64))[0]
    return g
