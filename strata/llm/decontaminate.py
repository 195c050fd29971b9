"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items become windows of ``size`` consecutive words (a shorter item is one window). Words
are ordered by rarity, that is by how often they occur in all documents; exact containment needs
every word of a window, so the necessary prefix is its rarest word. Documents and windows are
joined on that word. A candidate is kept if the window, laid so that the words meet, lies inside
the document (positional and length bounds), and is then verified word by word.

The window index is broadcast in blocks of at most ``block_windows`` windows, dealt by hash, so a
larger benchmark means more passes over the documents and not a larger broadcast.

Defined cases: null or empty texts and texts without words are never hit; items without words
have no window; repeated windows and items count once per item id; a null item id counts as
the empty string; documents with equal or null ids stay rows of their own; an empty benchmark
hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.words import ALNUM, Words, slices


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, words array<long>): distinct windows of each item, words as 64-bit hashes."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), ALNUM, lower=True)
                hashes = w.hash.view(np.int64)
                names = part.column(0).to_pylist()
                item, words = [], []
                for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    for s in range(a, max(b - size, a) + 1) if b > a else ():
                        item.append(names[r])
                        words.append(hashes[s:min(s + size, b)])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])

    return (items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
            .mapInArrow(cut, "item string, words array<long>").distinct())


class Index:
    """Windows of one block, grouped by their rarest word."""

    def __init__(self, rows: list, counts: dict[int, int]):
        self.items = sorted({i for r in rows for i in r["items"]})
        number = {x: i for i, x in enumerate(self.items)}
        rarest = []
        for r in rows:
            at = min(range(len(r["words"])), key=lambda i: (counts.get(r["words"][i], 0), r["words"][i], i))
            rarest.append((r["words"][at], at))
        order = sorted(range(len(rows)), key=lambda i: rarest[i])
        rows, rarest = [rows[i] for i in order], [rarest[i] for i in order]
        self.length = np.array([len(r["words"]) for r in rows], dtype=np.int64)
        self.at = np.array([a for _, a in rarest], dtype=np.int64)
        self.words = np.array([w for r in rows for w in r["words"]], dtype=np.int64).view(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        keys = np.array([k for k, _ in rarest], dtype=np.int64).view(np.uint64)
        self.key, begin = np.unique(keys, return_index=True)  # a new order: of unsigned values
        self.begin, self.n = begin, np.array([np.count_nonzero(keys == k) for k in self.key], dtype=np.int64)
        self.window_items = [[number[i] for i in r["items"]] for r in rows]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.key) or not len(w.hash):
            return none, none
        at = np.minimum(np.searchsorted(self.key, w.hash), len(self.key) - 1)
        pos = np.flatnonzero(self.key[at] == w.hash)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(pos), 50_000):  # candidates of so many words at a time
            p = pos[a:a + 50_000]
            n = self.n[at[p]]
            window = np.repeat(self.begin[at[p]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(p, n) - self.at[window]
            row = np.repeat(w.doc[p], n)
            ok = (start >= w.first[row]) & (start + self.length[window] <= w.first[row + 1])
            start, window = start[ok], window[ok]
            for i in range(int(self.length.max(initial=0))):
                inside = self.length[window] > i
                same = np.ones(len(start), dtype=bool)
                same[inside] = w.hash[start[inside] + i] == self.words[self.first[window[inside]] + i]
                start, window = start[same], window[same]
            out.append((start, window))
        return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(x for _, x in out)])


def word_counts(docs: DataFrame, words: np.ndarray) -> dict[int, int]:
    """Occurrences in all documents of the given (sorted, unsigned) word hashes."""
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(words)

    def count(batches):
        keys = wanted.value
        total = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), ALNUM, lower=True)
                if len(w.hash) and len(keys):
                    at = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
                    total += np.bincount(at[keys[at] == w.hash], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    rows = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    wanted.unpersist()
    return {r["word"]: r["n"] for r in rows}


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", block_windows: int = 100_000) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    id_type = docs.schema["id"].dataType.simpleString()
    table = windows(items, size, item_col).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    blocks = max(1, -(-table.count() // block_windows))
    passes = []
    for block in range(blocks):
        rows = (table if blocks == 1 else table.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)).collect()
        words = np.unique(np.array([w for r in rows for w in r["words"]], dtype=np.int64).view(np.uint64))
        index = spark.sparkContext.broadcast(Index(rows, word_counts(docs, words)))
        passes.append(_hits(docs, id_col, id_type, index, blocks > 1))
    if blocks == 1:
        return passes[0]
    return _merged(passes, id_col, id_type)


def _hits(docs: DataFrame, id_col: str, id_type: str, index, partial: bool) -> DataFrame:
    """A row per document; ``partial``: with hit positions and items for _merged."""

    def find(batches):
        idx = index.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), ALNUM, lower=True)
                start, window = idx.hits(w)
                delta = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(delta, start, 1)
                np.add.at(delta, start + idx.length[window], -1)
                hit = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
                n_hit = np.bincount(w.doc[hit], minlength=part.num_rows)
                found: list[set[str]] = [set() for _ in range(part.num_rows)]
                for r, k in zip(w.doc[start].tolist(), window.tolist(), strict=True):
                    found[r].update(idx.items[i] for i in idx.window_items[k])
                cols = [part.column(0), pa.array(w.count.astype(np.int64))]
                if partial:
                    places = [(hit[a:b] - f).tolist() for a, b, f in zip(np.searchsorted(hit, w.first[:-1]), np.searchsorted(hit, w.first[1:]), w.first[:-1], strict=True)]
                    cols += [pa.array(places, pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                    names = [id_col, "n_words", "places", "items"]
                else:
                    cols += [pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found], pa.int64()),
                             pa.array([_items_hash(x) for x in found], pa.string()), pa.array(n_hit > 0)]
                    names = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                yield pa.RecordBatch.from_arrays([*cols, part.column(2)], names=[*names, "text_hash"])

    rest = "places array<long>, items array<string>" if partial else "n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return docs.mapInArrow(find, f"`{id_col}` {id_type}, n_words long, {rest}, text_hash long")


def _items_hash(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _merged(passes: list[DataFrame], id_col: str, id_type: str) -> DataFrame:
    """The passes over one document as one row; equal documents give equal rows, each its own."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    one = every.groupBy(id_col, "n_words", "text_hash").agg(
        F.count("*").alias("__n"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"))
    copies = F.sequence(F.lit(1).cast("long"), (F.col("__n") / len(passes)).cast("long"))
    return (one.withColumn("__copy", F.explode(copies))
            .select(F.col(id_col).cast(id_type), "n_words", "n_hit", F.size("__items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_hash"))
