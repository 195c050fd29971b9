"""Worker-side tokenizers that encode each distinct unit of a slice of texts once.

A unit is the white space before a word and the word; a single comma or full stop after an ASCII
letter is a unit of its own. Both vocabularies split text at all those places before any merge, so
the encodings of the units, one after another, are the encoding of the text. Texts with a special
token's string or with white space beyond ASCII go to the library as a whole. Units are told apart
by 64-bit hashes; a bounded cache, begun anew when full, keeps the encodings of earlier slices and
changes speed only.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from strata.llm.words import _BASE, _BYTE, _INV, _LOWER, SPACES, Words, mix, powers

CACHE = 300_000  # units: about 80 MB of a worker, which keeps it for all its tasks
SLICE = 2 << 20
_WIDE_SPACES = "\x85\xa0                　"
_COMMA_STOP = np.zeros(256, dtype=bool)
_COMMA_STOP[[44, 46]] = True
_LEADING = np.zeros(256, dtype=bool)
_LEADING[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


def whole_rows(col: pa.Array, path: str) -> np.ndarray:
    """Rows that must be encoded as a whole."""
    texts = None
    bad = np.zeros(len(col), dtype=bool)
    data = col.cast(pa.large_string()).fill_null("")
    joined = "\n".join(data.to_pylist())
    for s in (*specials(path), *_WIDE_SPACES):
        if s in joined:
            texts = texts or data.to_pylist()
            bad |= np.fromiter((s in t for t in texts), dtype=bool, count=len(col))
    return bad


class Units:
    """Byte ranges ``start``/``end`` of the units of a column's texts, their row and their hash.

    ``spaces``: units hold the white space before them; else white space belongs to no unit.
    ``lower``: hashes ignore the case of A-Z."""

    def __init__(self, col: pa.Array, spaces: bool, lower: bool = False):
        w = Words(col, hashes=False)
        data, off = w.data, w.off
        last = w.end - 1
        tail = last[(w.end - w.start > 1) & _COMMA_STOP[data[last]] & _LETTER[data[last - 1]]]
        if spaces:
            cut = np.zeros(len(data) + 1, dtype=bool)
            cut[w.end] = cut[tail] = cut[off[1:]] = True
            cut[0] = False
            self.end = np.flatnonzero(cut)
            self.start = np.concatenate([np.zeros(min(1, len(self.end)), np.int64), self.end[:-1]])
        else:
            self.start = np.sort(np.concatenate([w.start, tail]))
            self.end = np.sort(np.concatenate([w.end, tail]))
        self.row = np.searchsorted(off, self.start, side="right") - 1
        n = len(data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * powers(_BASE, n + 1)[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * powers(_INV, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))
        self.data = data

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8")


class Cache:
    """Distinct units -> place in a table that the subclass fills for new units."""

    def __init__(self, path: str, limit: int = CACHE):
        self.path, self.lib, self.limit = path, load(path), limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}

    def add(self, u: Units, new: np.ndarray) -> None:
        """Appends the encodings of the units ``new`` of ``u`` to the table."""
        raise NotImplementedError

    def places(self, u: Units) -> np.ndarray:
        """The place of each unit."""
        if len(self.place) > self.limit:
            self.clear()
        known, at, back = np.unique(u.hash, return_index=True, return_inverse=True)
        keys = known.tolist()
        got = np.fromiter(map(self.place.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(got < 0)
        if len(new):
            have = len(self.place)
            self.add(u, at[new])
            got[new] = np.arange(have, have + len(new))
            self.place.update(zip(known[new].tolist(), range(have, have + len(new)), strict=True))
        return got[back]


class Ids(Cache):
    """Token ids of whole texts by a byte-level vocabulary."""

    def __init__(self, path: str, limit: int = CACHE):
        super().__init__(path, limit)
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():  # each character of a byte-level token stands for one byte
            self.n_bytes[i] = len(token)

    def clear(self) -> None:
        super().clear()
        self.ids, self.first, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def add(self, u: Units, new: np.ndarray) -> None:
        first, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        start, size = u.start[new], u.end[new] - u.start[new]
        chained = np.flatnonzero(_LEADING[u.data[start]] & ~SPACES[u.data[u.end[new] - 1]])
        have, parts = len(self.ids), [self.ids]
        for a in range(0, len(chained), 4000):  # a chain of units is encoded at once and cut by bytes
            some = chained[a:a + 4000]
            ends = np.cumsum(size[some])
            at = np.repeat(start[some] - ends + size[some], size[some]) + np.arange(ends[-1])
            ids = self.encode(u.data[at].tobytes().decode("utf-8"))
            cut = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="left") + 1
            n[some] = np.diff(cut, prepend=0)
            first[some] = have + cut - n[some]
            parts.append(ids)
            have += len(ids)
        for i in np.setdiff1d(np.arange(len(new)), chained).tolist():
            ids = self.encode(u.text(new[i]))
            first[i], n[i] = have, len(ids)
            parts.append(ids)
            have += len(ids)
        self.ids = np.concatenate(parts)
        self.first, self.n = np.concatenate([self.first, first]), np.concatenate([self.n, n])

    def __call__(self, col: pa.Array) -> list[np.ndarray]:
        """Each row's ids (null or empty: none)."""
        u = Units(col, spaces=True)
        whole = whole_rows(col, self.path)
        if whole.any():
            keep = ~whole[u.row]
            u.start, u.end, u.row, u.hash = u.start[keep], u.end[keep], u.row[keep], u.hash[keep]
        place = self.places(u)
        n = self.n[place]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(self.first[place] - total[:-1], n) + np.arange(total[-1])]
        rows = np.searchsorted(u.row, np.arange(len(col) + 1))
        out = [flat[total[a]:total[b]] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.encode(col[i].as_py())
        return out


@lru_cache(maxsize=2)
def worker_ids(path: str, limit: int = CACHE) -> Ids:
    """The worker's own tokenizer: its cache serves all tasks that the worker runs."""
    return Ids(path, limit)


class Counts(Cache):
    """Numbers of tokens of whole texts by a vocabulary that drops white space and case.

    ``table``: sorted hashes and lengths of frequent units, looked up before the cache."""

    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray] | None = None, limit: int = CACHE):
        super().__init__(path, limit)
        self.hashes, self.lengths = table if table is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.misses = 0

    def clear(self) -> None:
        super().clear()
        self.n = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)], dtype=np.int64)

    def add(self, u: Units, new: np.ndarray) -> None:
        self.misses += len(new)
        self.n = np.concatenate([self.n, self.encode([u.text(i) for i in new.tolist()])])

    def __call__(self, col: pa.Array) -> np.ndarray:
        u = Units(col, spaces=False, lower=True)
        whole = whole_rows(col, self.path)
        if whole.any():
            keep = ~whole[u.row]
            u.start, u.end, u.row, u.hash = u.start[keep], u.end[keep], u.row[keep], u.hash[keep]
        n = np.zeros(len(u.hash), dtype=np.int64)
        miss = np.ones(len(u.hash), dtype=bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, u.hash), len(self.hashes) - 1)
            miss = self.hashes[at] != u.hash
            n[~miss] = self.lengths[at[~miss]]
        if miss.any():
            rest = object.__new__(Units)
            rest.data, rest.start, rest.end, rest.hash = u.data, u.start[miss], u.end[miss], u.hash[miss]
            place = self.places(rest)
            n[miss] = self.n[place]
        out = np.bincount(u.row, weights=n, minlength=len(col)).astype(np.int64) if len(u.row) else np.zeros(len(col), np.int64)
        if whole.any():
            out[whole] = self.encode([col[i].as_py() for i in np.flatnonzero(whole).tolist()])
        return out
