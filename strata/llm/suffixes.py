"""Substring dedup over bytes by prefix-free parsing.

A position is a trigger when the rolling hash of its 20 bytes is the smallest of the 50-byte window
around it; so, other than with a fixed modulus, every 50-byte string holds a trigger, and equal
strings hold equal ones. Triggers cut a text into phrases: the runs of windows that share a
trigger. A phrase overlaps the next one by 49 bytes (the prefix-free overlap, widened from the
trigger's bytes to the length of interest), so the first 50 bytes of every suffix of the corpus lie
in one phrase.

1. Parse: triggers that occur in two documents stay; the rest of the corpus needs no order.
2. Dictionary: distinct phrases with their first document. A phrase that an earlier document holds
   goes as a whole. Where all phrases of a trigger are equal, all their suffixes are ordered by the
   phrase alone, and nothing more is to be done.
3. Other triggers have several phrases (edges of repeated passages): the suffixes of those
   dictionary phrases, each from its first document only, are sorted to a depth of 50 bytes and
   each class of equal prefixes takes its first document. A round of 32-bit keys first leaves out
   suffixes whose first bytes occur in one document only.

Combining 2 and 3 along each document's parse marks every position whose 50 bytes start in an
earlier document. Only classes of equal 50-byte prefixes matter here, so suffixes are sorted by
fingerprint (64 bits and, as a check, the trigger's 64 bits) and not by letters.

Defined cases: null and empty texts have no bytes; texts under 50 bytes lose nothing; documents
with equal ids are one document and never remove from each other; null ids come after all others;
extra columns are ignored; rows stay one to one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import exchange as X
from strata.llm.words import _BASE, _BYTE, _INV, covered, distinct, mix, powers, slices, string_bytes

TRIGGER = 20
MOST_PHRASES = 16
_ENTRY = np.dtype([("check", "<u8"), ("doc", "<i8")])


class _Text:
    """Bytes of a run of rows with prefix hashes."""

    def __init__(self, col: pa.Array):
        self.data, self.off = string_bytes(col)
        n = len(self.data)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * powers(_BASE, n + 1)[:n], out=self.total[1:])
        self.inverse = powers(_INV, n + 1)

    def hash(self, start, end):
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class _Parse:
    """Phrases of a chunk: trigger, document, row, first window (byte in its slice), number of windows."""

    def __init__(self, table: pa.Table, length: int):
        ids = X.documents(table["id"])
        self.texts: list[_Text] = []
        parts, row0 = [], 0
        batch = pa.RecordBatch.from_arrays([table["text"].combine_chunks()], names=["text"])
        for part in slices(batch, "text"):
            t = _Text(part.column(0))
            parts.append((*self._phrases(t, length), row0))
            self.texts.append(t)
            row0 += part.num_rows
        cat = lambda i, kind: np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]).astype(kind)
        self.trigger, self.start, self.size = cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64)
        self.slice = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        self.row = cat(3, np.int64) + np.repeat([p[4] for p in parts] or [0], [len(p[0]) for p in parts] or [0])
        self.doc = ids[self.row] if len(ids) else np.zeros(0, np.int64)

    @staticmethod
    def _phrases(t: _Text, length: int):
        n = len(t.data)
        none = np.zeros(0, np.int64)
        if n < length:
            return np.zeros(0, np.uint64), none, none, none
        low = mix((t.total[TRIGGER:] - t.total[:-TRIGGER]) * t.inverse[:n + 1 - TRIGGER])
        wide, have = length - TRIGGER + 1, 1
        while 2 * have <= wide:  # smallest of a sliding window by doubling
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < wide:
            low = np.minimum(low[:have - wide], low[wide - have:])
        ends = t.off[1:]
        fits = np.ones(n - length + 1, dtype=bool)  # the window ends in its own row
        for e in ends[:-1].tolist():
            fits[max(0, e - length + 1):e] = False
        begins = fits.copy()
        begins[1:] &= (low[1:] != low[:-1]) | ~fits[:-1]
        start = np.flatnonzero(begins)
        stops = np.flatnonzero(fits & np.append((low[1:] != low[:-1]) | ~fits[1:], True)) + 1
        return low[start], start, stops - start, np.searchsorted(t.off, start, side="right") - 1

    def phrase_hash(self, which: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for i, t in enumerate(self.texts):
            mine = np.flatnonzero(self.slice[which] == i)
            p = which[mine]
            out[mine] = t.hash(self.start[p], self.start[p] + self.size[p] + length - 1)
        return out | np.uint64(1)

    def suffixes(self, which: np.ndarray, length: int):
        """(index into which, window start, hash) of every window of these phrases."""
        n = self.size[which]
        of = np.repeat(np.arange(len(which)), n)
        start = np.repeat(self.start[which], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(len(of), np.uint64)
        part = self.slice[which][of]
        for i, t in enumerate(self.texts):
            mine = np.flatnonzero(part == i)
            out[mine] = t.hash(start[mine], start[mine] + length)
        return of, start, out


class _Shared:
    """Phrases whose trigger occurs in two documents, as distinct (trigger, phrase) pairs with their first
    document in the chunk. A trigger with more than ``MOST_PHRASES`` phrases in the chunk is one pair
    with phrase 0: it surely has several phrases, and no task has to gather them all."""

    def __init__(self, table, length, answers, buckets):
        self.parse = p = _Parse(table, length)
        known, _, _, back, two = X.first_of(p.trigger, p.doc)
        self.which = which = np.flatnonzero((X.bits_of(known, answers[0], buckets) | two)[back])
        self.doc = p.doc[which]
        trigger, phrase = p.trigger[which], p.phrase_hash(which, length)
        order = np.lexsort((phrase, trigger))
        t, h = trigger[order], phrase[order]
        fresh = np.ones(len(t), dtype=bool)
        fresh[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        group = np.ones(len(t), dtype=bool)
        group[1:] = t[1:] != t[:-1]
        of_group = np.cumsum(group) - 1
        crowded = (np.bincount(of_group, weights=fresh) > MOST_PHRASES)[of_group] if len(t) else group
        fresh &= ~crowded | group
        self.pair = np.empty(len(t), dtype=np.int64)
        self.pair[order] = np.cumsum(fresh) - 1
        self.trigger, self.phrase = t[fresh], np.where(crowded, np.uint64(0), h)[fresh]
        self.low = np.full(len(self.trigger), X.LAST)
        np.minimum.at(self.low, self.pair, self.doc)

    def split(self, answer, buckets):
        """(phrases that also are in an earlier document, phrases whose suffixes must be sorted)."""
        alone, earlier = X.bits_of(self.trigger, answer, buckets, width=2)
        single = self.phrase != 0
        # a trigger with several phrases in this chunk alone isn't alone
        alone &= single
        gone = (single[self.pair] & (earlier[self.pair] | (self.doc > self.low[self.pair])))
        return self.which[gone], self.which[~gone & ~alone[self.pair]]


class _Suffixes:
    """The suffixes of a chunk that must be sorted; with the third round's answers only those whose first
    bytes occur in two documents."""

    def __init__(self, shared: _Shared, length: int, answers, buckets):
        self.gone, which = shared.split(answers[1], buckets)
        p = shared.parse
        of, self.start, self.key = p.suffixes(which, length)
        self.slice, self.doc, self.trigger = p.slice[which][of], p.doc[which][of], p.trigger[which][of]
        self.known, self.at, self.low, self.back, two = X.first_of(self.key, self.doc)
        if len(answers) > 2:
            keep = (X.bits_of(self.known, answers[2], buckets) | two)[self.back]
            self.start, self.key, self.slice, self.doc, self.trigger = (x[keep] for x in (self.start, self.key, self.slice, self.doc, self.trigger))
            self.known, self.at, self.low, self.back, _ = X.first_of(self.key, self.doc)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
                   chunk_bytes: int = X.CHUNK, bucket_bytes: int = X.BUCKET) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``keep_text``, the kept bytes. A byte goes if a ``length``-byte string over it also starts in a
    document with a smaller id."""
    chunks = X.Chunks(docs, id_col, text_col, chunk_bytes, bucket_bytes)
    buckets = chunks.buckets

    def triggers(table, _):
        p = _Parse(table, length)
        return distinct(p.trigger), None

    def phrases(table, answers):
        s = _Shared(table, length, answers, buckets)
        values = np.empty(len(s.trigger), _ENTRY)
        values["check"], values["doc"] = s.phrase, s.low
        return s.trigger, values

    def dictionary(keys, values):
        k, v = np.concatenate(keys), np.concatenate(values)
        alone = X.uniform(k, v["check"])
        earlier = X.smaller(k, v["check"], v["doc"])
        cut = np.cumsum([len(x) for x in keys])[:-1]
        return [np.concatenate(x) for x in zip(np.split(alone, cut), np.split(earlier, cut), strict=True)]

    def candidates(table, answers):
        return _Suffixes(_Shared(table, length, answers, buckets), length, answers, buckets).known, None

    def suffixes(table, answers):
        x = _Suffixes(_Shared(table, length, answers, buckets), length, answers, buckets)
        values = np.empty(len(x.known), _ENTRY)
        values["check"], values["doc"] = x.trigger[x.at], x.low
        return x.known, values

    def order(keys, values):
        v = np.concatenate(values)
        return np.split(X.smaller(np.concatenate(keys), v["check"], v["doc"]), np.cumsum([len(x) for x in keys])[:-1])

    def make(table, answers):
        s = _Shared(table, length, answers, buckets)
        p = s.parse
        x = _Suffixes(s, length, answers, buckets)
        gone = x.gone
        late = X.bits_of(x.known, answers[3], buckets)[x.back] | (x.doc > x.low[x.back])
        single, at_single = x.slice[late], x.start[late]
        n = p.size[gone]
        at_phrase = np.repeat(p.start[gone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        in_phrase = np.repeat(p.slice[gone], n)
        sizes, removed, spans, sha, text = [], [], [], [], []
        for i, t in enumerate(p.texts):
            cut = covered(np.concatenate([at_single[single == i], at_phrase[in_phrase == i]]), length, len(t.data))
            keep = ~cut
            run = cut.copy()
            run[1:] &= ~cut[:-1]
            first = t.off[:-1]
            first = first[first < len(cut)]
            run[first] = cut[first]
            for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist(), strict=True):
                kept = t.data[a:b][keep[a:b]].tobytes()
                sizes.append(b - a), removed.append(b - a - len(kept)), spans.append(int(run[a:b].sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    text.append(kept)
        cols = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)] + [pa.array(sha, pa.string())]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            cols, names = [*cols, pa.array(text, pa.binary())], [*names, "kept_bytes"]
        yield table, names, cols

    chunks.exchange(triggers, X.in_two, "u1", key_bytes=4)
    chunks.exchange(phrases, dictionary, _ENTRY)
    chunks.exchange(candidates, X.in_two, "u1", key_bytes=4)
    chunks.exchange(suffixes, order, _ENTRY)
    return chunks.finish(make, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_text, id_col)
