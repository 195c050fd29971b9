"""Words of whole texts as numpy arrays, read straight from Arrow string buffers.

A word is a maximal run of bytes for which a 256-entry mask is true; every separator used here is
ASCII, so byte runs and code-point runs are the same. Each word gets a 64-bit polynomial hash
of randomised byte values, and windows of words a 64-bit hash of their words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 2**64)
_WBASE = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(9, 14)]] = True
#: words `[^\x20\x09-\x0D]+`
NOT_SPACE = ~SPACES
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z, everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets) of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if len(off) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``max_bytes`` of text (one longer text goes alone)."""
    if not batch.num_rows:
        return
    sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch of texts: ``start``/``end`` (byte positions), ``doc`` (row), ``hash``,
    ``first`` (index of each row's first word, with one entry more than rows)."""

    def __init__(self, col: pa.Array, mask: np.ndarray = NOT_SPACE, lower: bool = False, hashes: bool = True):
        data, off = string_bytes(col)
        if lower:
            data = _LOWER[data]
        self.data, self.off = data, off
        n = len(data)
        inside = mask[data]
        begins = np.empty(n + 1, dtype=bool)  # a word begins here
        begins[:n] = inside
        begins[1:n] &= ~inside[:-1]
        ends = np.empty(n + 1, dtype=bool)  # a word has ended before this byte
        ends[0] = False
        ends[1:] = inside
        ends[1:n] &= ~inside[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut]
        ends[cut] = inside[cut - 1]
        self.start = np.flatnonzero(begins[:n])
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        if hashes:
            p, q = powers(_BASE, n + 1), powers(_INV, n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * p[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * q[self.start])
        else:
            self.hash = None

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        w = powers(_WBASE, k)
        total = self.hash[:n - k + 1] * w[0]
        for i in range(1, k):
            total = total + self.hash[i:n - k + 1 + i] * w[i]
        ok = np.flatnonzero(self.doc[:n - k + 1] == self.doc[k - 1:])
        return ok, mix(total[ok])


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash that ``Words.windows(len(hashes))`` gives this run of words."""
    return mix((hashes * powers(_WBASE, len(hashes))).sum(dtype=np.uint64).reshape(1))[0]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the n positions that lie in a window [s, s + k) of one of the starts."""
    delta = np.zeros(n + 1, dtype=np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + k, n), -1)
    return np.cumsum(delta[:n]) > 0
