"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import debruijn, decontaminate, langid, licenses, merkle, near_dup, packing, quality, search, secrets, shards, suffixes, token_counts, tokens
from strata.llm.manifest_sql import MANIFEST_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_array_dedup")
def op1(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(lower_az, '[ \t\n\x0B\f\r]+') AS raw FROM (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
w AS (SELECT doc_id, list_filter(raw, lambda x: x <> '') AS ws FROM d),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM hits JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.sh) + len(q.sh) - n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM s UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM s JOIN reach ON reach.v = s.doc_id GROUP BY s.doc_id, sh"""


@query("op2_minhash_near_dedup", NEAR_SQL)
def op2(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_benchmark_decontamination")
def op3(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op4_language_id")
def op4(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"), tokens.default_path("piece_bpe_32k.model"))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"))


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"))


@query("op8_secret_scans")
def op8(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents")).drop("n_novel")


def _divergence(name: str, bins: str) -> str:
    """CTEs of the Jensen-Shannon distance of ``bins`` (doc_id, lang, i, c) to their language's sums."""
    return f"""{name}_ref AS (SELECT lang, i, sum(c) AS c FROM {bins} GROUP BY ALL),
{name}_pq AS (SELECT b.doc_id, b.c / greatest(sum(b.c) OVER (PARTITION BY b.doc_id), 1) AS p, r.c / greatest(sum(r.c) OVER (PARTITION BY b.doc_id), 1) AS q
  FROM {bins} b JOIN {name}_ref r USING (lang, i)),
{name}_js AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js FROM {name}_pq GROUP BY doc_id)"""


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
f AS (SELECT doc_id, lang, len(ws) AS n_words, length(t) AS n_chars, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS capitals,
  length(t) - length(regexp_replace(t, '\p{Nd}', '', 'g')) AS digits FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
words AS (SELECT doc_id, lang, unnest(ws) AS x FROM w),
sym AS (SELECT doc_id, count(*) AS c FROM words WHERE NOT regexp_matches(x, '[\p{L}\p{N}]') GROUP BY doc_id),
top AS (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) AS i FROM words WHERE regexp_matches(x, '[\p{L}\p{N}]')
  GROUP BY lang, x QUALIFY i <= 16),
classes AS (SELECT doc_id, lang, unnest(range(6)) AS i, unnest([letters - capitals, capitals, digits, n_chars - word_chars, n_symbols,
  word_chars - letters - digits - n_symbols]) AS c FROM f),
seen AS (SELECT doc_id, i, count(*) AS c FROM words JOIN top USING (lang, x) GROUP BY ALL),
common AS (SELECT f.doc_id, lang, top.i, coalesce(seen.c, 0) AS c FROM f JOIN top USING (lang) LEFT JOIN seen ON seen.doc_id = f.doc_id AND seen.i = top.i
  UNION ALL SELECT f.doc_id, lang, -1, coalesce(sym.c, 0) FROM f LEFT JOIN sym USING (doc_id)
  UNION ALL SELECT f.doc_id, lang, 0, n_words - coalesce(s.c, 0) - coalesce(sym.c, 0) FROM f
    LEFT JOIN (SELECT doc_id, sum(c) AS c FROM seen GROUP BY doc_id) s USING (doc_id) LEFT JOIN sym USING (doc_id)),
""" + _divergence("class", "classes") + ",\n" + _divergence("word", "common") + f""",
bare AS (SELECT lang, i, c, CAST(i = 0 AS DOUBLE) AS p, c / greatest(sum(c) OVER (PARTITION BY lang), 1) AS q FROM word_ref),
lim AS (SELECT lang, coalesce(sum(c) FILTER (i > 0), 0) / greatest(sum(c), 1) AS share, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS bare FROM bare GROUP BY lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words OR (n_chars >= {quality.LEAST_CHARS} AND class_js.js > {quality.MOST_CHAR_DISTANCE})
    OR (n_words >= {quality.LEAST_WORDS} AND word_js.js > CASE WHEN n_words * share >= {quality.LEAST_COMMON}
      THEN least({quality.MOST_WORD_DISTANCE}, {quality.MOST_BARE} * bare) ELSE {quality.MOST_WORD_DISTANCE} END)) AS kept
FROM f JOIN lim USING (lang) JOIN class_js USING (doc_id) JOIN word_js USING (doc_id) LEFT JOIN rep USING (doc_id)"""


@query("op10_token_shards")
def op10(spark, sf_dir):
    return shards.write_shards(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_js", "word_js", "text_hash")


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11(spark, sf_dir):
    return merkle.proofs(table(spark, sf_dir, "documents"))


@query("op12_lexical_search", search.SEARCH_SQL)
def op12(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_license_scans", licenses.LICENSE_SQL)
def op13(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))
