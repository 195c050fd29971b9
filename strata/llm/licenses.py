"""License scan by diagonal voting.

Every template (a licence text or notice, or a short phrase) is cut into rolling grams of
``GRAM`` words, a shorter one is a single gram. The rolling grams of all documents are joined with
them by Spark on hash and words. A match of document word p and template word q votes for the diagonal
p - q; votes are aggregated by diagonal as the set of template places. Diagonals of one template that
lie at most a twentieth of its length apart are merged, as words put in or left out shift what
follows. A merged span is verified: the template words that its grams cover must be at
least nine tenths of a template shorter than ``LONG`` words, six tenths of others, hold the template's key phrase
whole, and stand in at most twice the template's length.

Before the join, documents drop grams whose bit is not set in a bitmap of the templates' hashes
(2**20 bits, whatever the number of templates); the join decides. The templates' grams are broadcast
up to ``MOST_BROADCAST`` bytes and shuffled beyond.

Defined cases: null and empty texts have no words, no labels and score 0; rows with equal ids and texts
have equal rows each; null ids are allowed; empty templates match nothing; without templates nothing
is found; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.license_texts import PHRASES, TEMPLATES
from strata.llm.words import ALNUM, Words, slices
from strata.session import checkpoint_dir

GRAM = 4
LONG = 20
BITS = 20
MOST_BROADCAST = 8 << 20


def templates(spark: SparkSession, phrases: list[tuple[str, str]] | None = None, texts: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(t, label, base, key, text) of the given phrases and texts, by default the public ones."""
    phrases = PHRASES if phrases is None else phrases
    texts = TEMPLATES if texts is None else texts
    rows = [(x, True, p, p) for x, p in phrases] + [(x, False, k, t) for x, k, t in texts]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "t int, label string, base boolean, key string, text string")


def _text(w: Words, a: int, b: int) -> str:
    return " ".join(w.data[w.start[i]:w.end[i]].tobytes().decode() for i in range(a, b))


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates as (t, label, base, n, k, slack, least, key places) and their grams (t, q, k, h, gram)."""

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            body, keys = Words(batch.column(4), ALNUM, lower=True), Words(batch.column(3), ALNUM, lower=True)
            for r in range(batch.num_rows):
                (a, b), (c, d) = body.first[r:r + 2].tolist(), keys.first[r:r + 2].tolist()
                k = min(GRAM, b - a)
                if not k:
                    continue
                one = Words(batch.column(4).slice(r, 1), ALNUM, lower=True)
                at, h = one.windows(k)
                grams = [(int(q), int(x), _text(one, q, q + k)) for q, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
                key = keys.hash[c:d].tolist()
                place = next((i for i in range(b - a - (d - c) + 1) if body.hash[a + i:a + i + d - c].tolist() == key), None)
                if place is None:
                    raise ValueError(f"the key of template {batch.column(0)[r]} is not in its text")
                out.append((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].as_py(), b - a, k, [*range(place, place + d - c)],
                            [{"q": q, "h": x, "gram": g} for q, x, g in grams]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], x) for i, x in enumerate(kinds)], names=["t", "label", "base", "n", "k", "keys", "grams"])

    kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()),
             pa.list_(pa.struct([("q", pa.int32()), ("h", pa.int64()), ("gram", pa.string())]))]
    done = rows.mapInArrow(cut, "t int, label string, base boolean, n int, k int, keys array<int>, grams array<struct<q:int,h:long,gram:string>>").checkpoint()
    return done.drop("grams"), done.select("t", "k", F.explode("grams").alias("g")).select("t", "k", "g.q", "g.h", "g.gram")


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _rolled(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(id, th, n_words, grams): a document's rolling grams that may be a template's."""
    field = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    kind = docs.schema["id"].dataType.simpleString()
    gram = pa.list_(pa.struct([("p", pa.int32()), ("k", pa.int32()), ("h", pa.int64()), ("gram", pa.string())]))

    def roll(batches):
        has = np.unpackbits(field.value).astype(bool)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), ALNUM, lower=True)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in sizes:
                    at, h = w.windows(k)
                    some = has[_bit(h)]
                    for p, x, r in zip(at[some].tolist(), h[some].view(np.int64).tolist(), w.doc[at[some]].tolist(), strict=True):
                        found[r].append({"p": p - int(w.first[r]), "k": k, "h": x, "gram": _text(w, p, p + k)})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(w.count.astype(np.int64)), pa.array(found, gram)], names=["id", "th", "n_words", "grams"])

    return docs.mapInArrow(roll, f"id {kind}, th long, n_words long, grams array<struct<p:int,k:int,h:long,gram:string>>")


def spans(rolled: DataFrame, table: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified spans: id, th, t, label, base, start, end (words), covered, n."""
    size = grams.agg(F.coalesce(F.sum(F.octet_length("gram") + 32), F.lit(0))).first()[0]
    side = F.broadcast(grams) if size <= MOST_BROADCAST else grams
    votes = (rolled.select("id", "th", F.explode("grams").alias("g")).select("id", "th", "g.*").join(side, ["h", "k", "gram"])
             .groupBy("id", "th", "t", (F.col("p") - F.col("q")).alias("d")).agg(F.collect_set("q").alias("qs"))
             .join(F.broadcast(table) if size <= MOST_BROADCAST else table, "t"))
    w = Window.partitionBy("id", "th", "t").orderBy("d")
    far = F.col("d") - F.lag("d").over(w) > F.expr("n div 20")
    merged = (votes.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("s", F.sum("far").over(w))
              .groupBy("id", "th", "t", "s", "label", "base", "n", "k", "keys")
              .agg(F.flatten(F.collect_list("qs")).alias("qs"), F.min(F.col("d") + F.array_min("qs")).alias("start"), F.max(F.col("d") + F.array_max("qs") + F.col("k")).alias("end")))
    covered = F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + F.col("k") - 1))))
    merged = merged.withColumn("places", covered).withColumn("covered", F.size("places"))
    least = F.when(F.col("n") < LONG, 9).otherwise(6)
    good = (10 * F.col("covered") >= least * F.col("n")) & (F.size(F.array_except("keys", "places")) == 0) & (F.col("end") - F.col("start") <= 2 * F.col("n"))
    return merged.where(good).select("id", "th", "t", "label", "base", "start", "end", "covered", "n")


class Scan:
    """Documents' rolling grams and the verified spans of the templates in them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None):
        checkpoint_dir(docs.sparkSession)
        self.id_col = id_col
        docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
        table, grams = _cut(known if known is not None else templates(docs.sparkSession))
        bits = np.zeros(1 << BITS, dtype=bool)
        bit = F.shiftrightunsigned("h", 64 - BITS)
        for r in grams.select(bit.cast("int").alias("bit")).distinct().collect():  # at most 2**BITS small numbers
            bits[r["bit"]] = True
        sizes = sorted(r["k"] for r in table.select("k").distinct().collect())  # at most GRAM
        self.rolled = _rolled(docs, sizes, bits).checkpoint()
        self.spans = spans(self.rolled, table, grams)

    def documents(self) -> DataFrame:
        """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
        base = F.col("base")
        per = self.spans.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(
            F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max(F.col("covered") / F.col("n")).alias("score"))
        same = F.col("id").eqNullSafe(F.col("__id")) & F.col("th").eqNullSafe(F.col("__th"))
        return self.rolled.drop("grams").join(per, same, "left").select(
            F.col("id").alias(self.id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    return Scan(docs, id_col, text_col, known).documents()


def _values() -> str:
    rows = [(x, True, p, p) for x, p in PHRASES] + [(x, False, k, t) for x, k, t in TEMPLATES]
    quoted = ("'" + str(x).replace("'", "''") + "'" for r in rows for x in r)
    return ", ".join(f"({i}, {next(quoted)}, {next(quoted)} = 'True', {next(quoted)}, {next(quoted)})" for i in range(len(rows)))


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LICENSE_SQL = f"""
WITH given(t, label, base, key, txt) AS (VALUES {_values()}),
cut AS (SELECT t, label, base, {_WORDS.format('txt')} AS ws, {_WORDS.format('key')} AS kw FROM given),
tpl AS (SELECT *, len(ws) AS n, least({GRAM}, len(ws)) AS k, list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(kw)] = kw)[1] AS spot FROM cut),
tg AS (SELECT t, k, q, array_to_string(ws[q + 1:q + k], ' ') AS gram FROM (SELECT *, unnest(range(n - k + 1)) AS q FROM tpl)),
d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
dg AS (SELECT doc_id, k, p, array_to_string(ws[p + 1:p + k], ' ') AS gram FROM (
  SELECT doc_id, ws, k, unnest(range(greatest(len(ws) - k + 1, 0))) AS p FROM d, (SELECT DISTINCT k FROM tpl))),
votes AS (SELECT DISTINCT doc_id, t, k, p - q AS d, q FROM dg JOIN tg USING (k, gram)),
lines AS (SELECT doc_id, t, d, sum(far) OVER (PARTITION BY doc_id, t ORDER BY d) AS s FROM (
  SELECT doc_id, t, d, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, t ORDER BY d) > n // 20 THEN 1 ELSE 0 END AS far
  FROM (SELECT DISTINCT doc_id, t, d FROM votes) JOIN tpl USING (t))),
places AS (SELECT doc_id, t, s, min(d + q) AS start, max(d + q + k) AS stop, list_distinct(flatten(list(range(q, q + k)))) AS places
  FROM votes JOIN lines USING (doc_id, t, d) GROUP BY doc_id, t, s),
spans AS (SELECT doc_id, label, base, start, len(places) / n AS share FROM places JOIN tpl USING (t)
  WHERE 10 * len(places) >= CASE WHEN n < {LONG} THEN 9 ELSE 6 END * n AND list_has_all(places, range(spot, spot + len(kw))) AND stop - start <= 2 * n),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, CAST(min(start) FILTER (base) AS BIGINT) AS first_word, CAST(max(start) FILTER (base) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
  max(share) AS score FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN per USING (doc_id)"""
