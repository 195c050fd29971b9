"""Registered balancing queries (B1-B9) on labels joined to documents (label = toxic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import balance as B
from strata.functions.stats import seeded_hash_sql
from strata.plans.registry import register
from strata.sources import tables as T

FEATS = ["n_chars", "n_words"]


def _bs(spark, sf):
    return T.balance_set(spark, sf)


def _h(x: str, salt: int, seed: int = 42) -> str:
    return seeded_hash_sql([x], seed, salt)


CNT = "cnt AS (SELECT label, COUNT(*) AS n FROM balance_set GROUP BY 1)"
MIN_CLS = "(SELECT label FROM cnt ORDER BY n, label LIMIT 1)"
MAJ_CLS = "(SELECT label FROM cnt ORDER BY n DESC, label LIMIT 1)"


@register("balance_random_over", f"""WITH {T.SQL_BALANCE_SET}, {CNT},
mino AS (SELECT *, row_number() OVER (ORDER BY {_h('doc_id', 0)}, doc_id) - 1 AS rk FROM balance_set WHERE label = {MIN_CLS}),
need AS (SELECT (SELECT MAX(n) FROM cnt) - (SELECT MIN(n) FROM cnt) AS need, (SELECT MIN(n) FROM cnt) AS nmin),
draws AS (SELECT r.range AS j, {_h('r.range', 1)} % need.nmin AS rk FROM need, range(0, need.need) r)
SELECT doc_id, n_chars, n_words, label, false AS synthetic FROM balance_set
UNION ALL SELECT m.doc_id, m.n_chars, m.n_words, m.label, true FROM draws d JOIN mino m USING (rk)""")
def q_balance_random_over(spark, sf):
    return B.balance_random_over(_bs(spark, sf), "label", "doc_id")


@register("balance_random_under", f"""WITH {T.SQL_BALANCE_SET}, {CNT},
maj AS (SELECT *, row_number() OVER (ORDER BY {_h('doc_id', 0)}, doc_id) - 1 AS rk FROM balance_set WHERE label = {MAJ_CLS})
SELECT doc_id, n_chars, n_words, label FROM balance_set WHERE label <> {MAJ_CLS}
UNION ALL SELECT doc_id, n_chars, n_words, label FROM maj WHERE rk < (SELECT MIN(n) FROM cnt)""")
def q_balance_random_under(spark, sf):
    return B.balance_random_under(_bs(spark, sf), "label", "doc_id")


@register("balance_smote")
def q_balance_smote(spark, sf):
    return B.balance_smote(_bs(spark, sf), "label", "doc_id", FEATS)


@register("balance_adasyn")
def q_balance_adasyn(spark, sf):
    return B.balance_adasyn(_bs(spark, sf), "label", "doc_id", FEATS)


@register("balance_borderline_smote")
def q_balance_borderline_smote(spark, sf):
    return B.balance_borderline_smote(_bs(spark, sf), "label", "doc_id", FEATS)


@register("balance_smote_enn")
def q_balance_smote_enn(spark, sf):
    return B.balance_smote_enn(_bs(spark, sf), "label", "doc_id", FEATS)


@register("balance_smote_tomek")
def q_balance_smote_tomek(spark, sf):
    return B.balance_smote_tomek(_bs(spark, sf), "label", "doc_id", FEATS)


@register("balance_auto_choice", f"""WITH {T.SQL_BALANCE_SET}, {CNT}
SELECT round(MAX(n) / MIN(n), 6) AS imbalance_ratio,
  CASE WHEN MAX(n) / MIN(n) > 10 THEN 'smote' WHEN MAX(n) / MIN(n) > 5 THEN 'borderline_smote'
       WHEN MAX(n) / MIN(n) > 3 THEN 'ros' ELSE 'none' END AS method FROM cnt""")
def q_balance_auto_choice(spark, sf):
    c = B.class_counts(_bs(spark, sf), "label")
    ratio = max(n for _, n in c) / min(n for _, n in c)
    return spark.createDataFrame([(round(ratio, 6), B.choose_balancing(ratio))], "imbalance_ratio double, method string")


@register("balance_report", f"""WITH {T.SQL_BALANCE_SET}, {CNT},
maj AS (SELECT *, row_number() OVER (ORDER BY {_h('doc_id', 0)}, doc_id) - 1 AS rk FROM balance_set WHERE label = {MAJ_CLS}),
aft AS (SELECT label FROM balance_set WHERE label <> {MAJ_CLS} UNION ALL SELECT label FROM maj WHERE rk < (SELECT MIN(n) FROM cnt)),
j AS (SELECT b.label, b.n AS n_before, a.n AS n_after FROM cnt b FULL JOIN (SELECT label, COUNT(*) AS n FROM aft GROUP BY 1) a USING (label)),
t AS (SELECT SUM(n_before) AS rb, SUM(n_after) AS ra, MAX(n_before) / MIN(n_before) AS r0, MAX(n_after) / MIN(n_after) AS r1 FROM j)
SELECT CAST(label AS VARCHAR) AS class, n_before, n_after, round(r0, 6) AS ratio_before, round(r1, 6) AS ratio_after,
  round(r0 - r1, 6) AS improvement, ra - rb AS samples_change,
  CASE WHEN r1 > 5 THEN ['severe_imbalance', 'ensemble_methods', 'cost_sensitive']
       WHEN r1 > 3 THEN ['moderate_imbalance', 'threshold_tuning'] ELSE ['slight_imbalance'] END AS advice FROM j, t""")
def q_balance_report(spark, sf):
    bs = _bs(spark, sf)
    r = B.balance_report(bs, B.balance_random_under(bs, "label", "doc_id"), "label")
    return r.select("class", "n_before", "n_after", *[F.round(c, 6).alias(c) for c in
                                                      ("ratio_before", "ratio_after", "improvement")],
                    "samples_change", "advice")


@register("oversample_union", f"""WITH {T.SQL_BALANCE_SET}, {CNT}
SELECT label, false AS synthetic, COUNT(*) AS rows FROM balance_set GROUP BY 1
UNION ALL SELECT {MIN_CLS}, true, (SELECT MAX(n) FROM cnt) - (SELECT MIN(n) FROM cnt)""")
def q_oversample_union(spark, sf):
    u = B.balance_random_over(_bs(spark, sf), "label", "doc_id")
    return u.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("rows"))
