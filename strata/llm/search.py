"""Ranked lexical search of every item over all documents, scoring each bag of words once.

Documents are restricted to the items' vocabulary: what is left of a text is its terms' frequencies and ``m``,
which stands for its length. Documents that agree in both have equal scores for every item, so they
form a class. Classes are dealt by a hash and told apart by the whole vector, which is part of
the grouping key; copies meet in each task before anything is shuffled. Each class is scored
once, and every task passes on only its ``k`` best classes per item, ties by the smallest id.
The ``k`` best documents of an item lie in its ``k`` best classes, so only those are expanded,
each into its ``k`` smallest ids, before the last ranking.

Items are dealt into blocks of about ``block_postings`` (item, term) pairs; a block's vocabulary and
postings are broadcast, and a larger benchmark means more passes and not a larger broadcast.
Terms are known by 64-bit hash and byte length.

Defined cases: null and empty texts have no terms and are neither counted in N nor returned; equal
texts are documents of their own, and so are rows with equal ids; null ids come first; rows of items
with one id (null too) are one item with all their terms; an item without terms, or whose terms are in no
document, has no rows; without documents or items there are no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.words import ALNUM, Words, slices
from strata.session import checkpoint_dir

BLOCK_POSTINGS = 1_000_000
CELLS = 1_000_000  # of a slice's (class, item) scores and of its term-item pairs
SALTS = 16


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term hash, size): distinct terms of each item."""
    kind = dict(items.dtypes)[id_col]

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), ALNUM, lower=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(w.doc)), pa.array(w.hash.view(np.int64)), pa.array((w.end - w.start).astype(np.int64))],
                                                 names=["item", "term", "size"])

    return (items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(cut, f"item {kind}, term long, size long").distinct())


class Index:
    """A block of items: sorted terms, and for each the items (by number) that hold it."""

    def __init__(self, rows: list):
        items = list(dict.fromkeys(r["item"] for r in rows))
        number = {x: i for i, x in enumerate(items)}
        self.items = items
        term = np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64)
        size = np.array([r["size"] for r in rows], dtype=np.int64)
        order = np.lexsort((size, term))
        self.of = np.array([number[r["item"]] for r in rows], dtype=np.int64)[order]
        term, size = term[order], size[order]
        self.term, self.begin = np.unique(term, return_index=True)
        self.size = size[self.begin]
        self.n = np.diff(np.append(self.begin, len(term)))


def vectors(docs: DataFrame, index) -> DataFrame:
    """(id, n, vec): all terms with repeats, and the block's terms as little-endian pairs of 32-bit
    (number in the vocabulary, frequency)."""

    def restrict(batches):
        keys, sizes = index.value.term, index.value.size
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), ALNUM, lower=True)
                at = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == w.hash) & (sizes[at] == w.end - w.start))
                cell, tf = np.unique(w.doc[hit] * len(keys) + at[hit], return_counts=True)
                pairs = np.stack([cell % len(keys), tf], axis=1).astype("<u4").tobytes()
                off = np.searchsorted(cell, np.arange(part.num_rows + 1) * len(keys)) * 8
                vec = [pairs[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.count.astype(np.int64)), pa.array(vec, pa.binary())], names=["id", "n", "vec"])

    return docs.mapInArrow(restrict, f"id {docs.schema['id'].dataType.simpleString()}, n long, vec binary")


def _pairs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of all rows, pairs of each row)."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0]:off[-1]] if len(col) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data).view("<u4").reshape(-1, 2).astype(np.int64), np.diff(off) // 8


def _statistics(rows: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and documents holding each term of the block."""

    def count(batches):
        df = np.zeros(terms + 2, dtype=np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            df[terms] += np.count_nonzero(n)
            df[terms + 1] += n.sum()
            df[:terms] += np.bincount(_pairs(batch.column(1))[0][:, 0], minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["i", "n"])

    df = np.zeros(terms + 2, dtype=np.int64)
    for r in rows.select("n", "vec").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row per term of the block
        df[r["i"]] = r["n"]
    return int(df[terms]), int(df[terms + 1]), df[:terms]


class Best:
    """The k best classes of each item so far; of equal scores those that came first."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, None
        self.floor = np.zeros(items, dtype=np.int64)

    def add(self, scores: np.ndarray, batch: pa.RecordBatch) -> None:
        """``scores``: classes of the batch x items."""
        row, item = np.nonzero(scores > self.floor)
        if not len(row):
            return
        new = pa.Table.from_batches([batch]).take(pa.array(row)).append_column("item", pa.array(item)).append_column("score", pa.array(scores[row, item]))
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        item, score = rows["item"].to_numpy(), rows["score"].to_numpy()
        order = np.lexsort((np.arange(len(item)), -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.floor)))
        rank = np.arange(len(order)) - first[item[order]]
        self.rows = rows.take(pa.array(order[rank < self.k])).combine_chunks()
        last = order[rank == self.k - 1]
        self.floor[item[last]] = score[last]


def _scored(classes: DataFrame, index, weights: np.ndarray, k: int) -> DataFrame:
    """(cid, no_id, first, item, score): each task's k best classes of every item."""
    kind = dict(classes.dtypes)["first"]

    def score(batches):
        idx = index.value
        best = Best(len(idx.items), k)
        for batch in batches:
            m = batch.column(0).to_numpy()
            pairs, sizes = _pairs(batch.column(1))
            row = np.repeat(np.arange(len(m)), sizes)
            term, tf = pairs[:, 0], pairs[:, 1]
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            ends = np.cumsum(sizes)
            work = np.concatenate([[0], np.cumsum(idx.n[term])])[np.concatenate([[0], ends])]
            names = pa.RecordBatch.from_arrays([batch.column(i) for i in (2, 3, 4)], names=["cid", "no_id", "first"])
            a = 0
            while a < len(m):
                b = max(a + 1, min(int(np.searchsorted(work, work[a] + CELLS, side="right")) - 1, a + max(1, CELLS // len(idx.items))))
                e, f = (ends[a] - sizes[a]), ends[b - 1]
                n = idx.n[term[e:f]]
                post = np.repeat(idx.begin[term[e:f]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                scores = np.zeros((b - a) * len(idx.items), dtype=np.int64)
                np.add.at(scores, np.repeat((row[e:f] - a) * len(idx.items), n) + idx.of[post], np.repeat(part[e:f], n))
                best.add(scores.reshape(b - a, -1), names.slice(a, b - a))
                a = b
        if best.rows is not None:
            yield from best.rows.to_batches()

    return classes.select("m", "vec", "cid", "no_id", "first").mapInArrow(score, f"cid long, no_id boolean, first {kind}, item long, score long")


def _first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def _search_block(docs: DataFrame, rows: list, k: int, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(Index(rows))
    items, terms = index.value.items, len(index.value.term)
    bags = vectors(docs, index).checkpoint()
    n_docs, length, df = _statistics(bags, terms)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(length, 1)}L")
    key = ["h", "m", "vec"]
    bags = bags.where(F.octet_length("vec") > 0).select("id", m.alias("m"), "vec").withColumn("h", F.xxhash64("m", "vec"))
    classes = (bags.groupBy(*key).agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("no_id"))
               .sortWithinPartitions(F.desc("no_id"), "first").withColumn("cid", F.monotonically_increasing_id()).checkpoint())
    order = [F.desc("score"), F.desc("no_id"), "first", "cid"]
    best = _first(_scored(classes, index, weights, k), ["item"], order, k).select("item", "cid", "score").checkpoint()
    # at most k classes for each item of the block: ids and hashes of bounded number
    chosen = classes.join(F.broadcast(best.select("cid").distinct()), "cid").select("cid", *key).checkpoint()
    some = bags.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi").withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    members = _first(_first(some, [*key, "__salt"], [F.asc_nulls_first("id")], k), key, [F.asc_nulls_first("id")], k)
    found = best.join(members.join(chosen, key).select("cid", "id"), "cid")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    names = spark.createDataFrame(list(enumerate(items)), f"item long, item_id {item_type}")  # the block's items
    out = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "id", "score").checkpoint()
    index.unpersist()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Each item's k best documents: item_id, rank, id, score."""
    checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    item_type = dict(items.dtypes)[item_col]
    terms = item_terms(items, item_col).checkpoint()
    blocks = -(-terms.count() // block_postings)
    parts = []
    for i in range(blocks):
        rows = (terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)).collect()
        if rows:
            parts.append(_search_block(docs, rows, k, item_type))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` {docs.schema['id'].dataType.simpleString()}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnsRenamed({"item_id": item_col, "id": id_col})


SEARCH_SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
tf AS (SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY doc_id, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
score AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM item JOIN weight USING (t) JOIN tf USING (t) JOIN size USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""
