"""Substring dedup by De Bruijn compaction over words.

A window of ``k`` words is an edge between its first and its last k - 1 words. Three exchanges:

1. edges that occur in two documents stay (a 32-bit key in each bucket: extra edges do no harm);
2. an edge whose every occurrence has the same predecessor and successor does not branch. Joined
   back to the documents, adjacent edges that do not branch compact into one path; every
   occurrence of a path holds the whole path, and a branching edge is a path of its own;
3. paths meet by a 64-bit hash of their words, are verified by a second one and their length, and
   give the smallest source document; occurrences in later documents are removed.

Results depend on hashes only through 128 bits per path and 64 bits per edge.

Defined cases: null, empty and white-space texts have no words; texts shorter than ``k`` words lose
nothing; documents with equal ids are one document and never remove from each other; null ids
come after all others; extra columns are ignored; rows stay one to one.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import exchange as X
from strata.llm.words import Words, covered, mix, powers

_A, _B = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


class _Edges:
    """A chunk's words and windows; ``known``: the distinct edges, ``back``: each window's place there."""

    def __init__(self, table: pa.Table, k: int):
        self.words = Words(table["text"], hashes=True)
        ids = X.documents(table["id"])
        self.at, self.hash = self.words.windows(k)
        self.row = self.words.doc[self.at]
        self.doc = ids[self.row]
        self.known, _, _, self.back, self.two = X.first_of(self.hash, self.doc)

    def repeated(self, answer, buckets: int) -> np.ndarray:
        return (X.bits_of(self.known, answer, buckets) | self.two)[self.back]

    def contexts(self) -> np.ndarray:
        """A hash of the edges before and after each window in its document."""
        joined = self.row[1:] == self.row[:-1]
        before, after = np.zeros(len(self.hash), np.uint64), np.zeros(len(self.hash), np.uint64)
        before[1:][joined] = self.hash[:-1][joined]
        after[:-1][joined] = self.hash[1:][joined]
        return mix(before * np.uint64(_A) + mix(after + np.uint64(_B))) | np.uint64(1)


class _Repeated:
    """The repeated windows only, with the answers of the first round."""

    def __init__(self, table: pa.Table, k: int, answers: list, buckets: int):
        self.edges = e = _Edges(table, k)
        self.of = np.flatnonzero(e.repeated(answers[0], buckets))
        self.hash, self.doc, self.row, self.at = e.hash[self.of], e.doc[self.of], e.row[self.of], e.at[self.of]
        self.known, _, _, self.back, _ = X.first_of(self.hash, self.doc)
        self.context = X.one_value(self.back, len(self.known), e.contexts()[self.of])

    def paths(self, answer, buckets: int):
        """(first window, windows, key, check) of each compacted path, in text order."""
        plain = X.bits_of(self.known, answer, buckets)[self.back]
        n = len(self.of)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = ~((self.row[1:] == self.row[:-1]) & (self.at[1:] == self.at[:-1] + 1) & plain[1:] & plain[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, n))
        keys = []
        for base in (_A, _B):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(self.hash + np.uint64(base)) * powers(base | 1, n + 1)[:n], out=total[1:])
            inverse = powers(pow(base | 1, -1, 2**64), n + 1)
            keys.append(mix((total[first + size] - total[first]) * inverse[first] + size.astype(np.uint64)))
        return first, size, keys[0], keys[1]


_PAIR = np.dtype([("check", "<u8"), ("doc", "<i8")])


def remove_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
                   chunk_bytes: int = X.CHUNK, bucket_bytes: int = X.BUCKET) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and
    with ``keep_text`` the kept words (null texts stay null). A word goes if a window over it also
    starts in a document with a smaller id."""
    chunks = X.Chunks(docs, id_col, text_col, chunk_bytes, bucket_bytes)
    buckets = chunks.buckets

    def edges(table, _):
        return _Edges(table, k).known, None

    def contexts(table, answers):
        r = _Repeated(table, k, answers, buckets)
        return r.known, r.context

    def no_branch(keys, values):
        return np.split(X.uniform(np.concatenate(keys), np.concatenate(values)), np.cumsum([len(x) for x in keys])[:-1])

    def paths(table, answers):
        r = _Repeated(table, k, answers, buckets)
        first, _, key, check = r.paths(answers[1], buckets)
        known, at, low, _, _ = X.first_of(key, r.doc[first])
        values = np.empty(len(known), _PAIR)
        values["check"], values["doc"] = check[at], low
        return known, values

    def earlier(keys, values):
        v = np.concatenate(values)
        return np.split(X.smaller(np.concatenate(keys), v["check"], v["doc"]), np.cumsum([len(x) for x in keys])[:-1])

    def make(table, answers):
        r = _Repeated(table, k, answers, buckets)
        first, size, key, _ = r.paths(answers[1], buckets)
        known, _, low, back, _ = X.first_of(key, r.doc[first])
        gone = X.bits_of(known, answers[2], buckets)[back] | (r.doc[first] > low[back])
        w = r.edges.words
        windows = np.repeat(gone, size)
        removed = covered(r.at[windows], k, len(w.hash))
        counts = np.add.reduceat(np.append(removed, False).astype(np.int64), w.first[:-1]) * (w.count > 0) if len(w.count) else np.zeros(0, np.int64)
        sha, kept_text = [], []
        for text, a, b in zip(table["text"].to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            kept = b" ".join(compress((text or "").encode().split(), (~removed[a:b]).tolist()))
            sha.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                kept_text.append(None if text is None else kept.decode())
        cols = [pa.array(w.count.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(sha, pa.string())]
        names = ["n_words", "n_removed", "kept_sha256"]
        if keep_text:
            cols, names = [*cols, pa.array(kept_text, pa.string())], [*names, "kept_text"]
        yield table, names, cols

    chunks.exchange(edges, X.in_two, "u1", key_bytes=4)
    chunks.exchange(contexts, no_branch, "<u8")
    chunks.exchange(paths, earlier, _PAIR)
    return chunks.finish(make, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text, id_col)
