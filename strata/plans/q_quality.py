"""Registered data-quality gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import quality as Q
from strata.plans.registry import register
from strata.sources import tables as T


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@register("gate_upload", """
SELECT * FROM (VALUES (0, 'data_not_empty'), (1, 'minimum_rows'), (2, 'minimum_columns')) v(seq, "check"),
LATERAL (SELECT CASE WHEN v.seq = 0 AND n = 0 THEN 'error' WHEN v.seq = 1 AND n < 10 THEN 'error' ELSE 'pass' END AS status,
  CASE WHEN v.seq = 0 AND n = 0 THEN 'Dataset is empty or not loaded'
       WHEN v.seq = 1 AND n < 10 THEN 'Dataset has insufficient rows (minimum 10 required)' ELSE '' END AS message
  FROM (SELECT COUNT(*) AS n FROM orders))""")
def q_gate_upload(spark, sf):
    return Q.gate_upload(T.table(spark, sf, "orders"))


NUMS = ["l_quantity", "l_tax", "l_extendedprice", "l_missing"]
CATS = ["l_returnflag", "l_quantity"]
LN_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
MISS = " + ".join(f"(COUNT(*) - COUNT({c}))" for c in LN_COLS)


@register("gate_preprocessing", _with(T.SQL_LINEITEM_NULLS) + f""",
st AS (SELECT COUNT(*) AS n, ({MISS}) AS miss, (COUNT(*) - COUNT(l_tax)) / COUNT(*) AS tnull FROM lineitem_nulls),
dup AS (SELECT COALESCE(SUM(c - 1), 0) AS d FROM (SELECT COUNT(*) AS c FROM lineitem_nulls GROUP BY {", ".join(LN_COLS)}))
SELECT 0 AS seq, 'column_consistency' AS "check", 'error' AS status, 'Numerical columns not found in data: [''l_missing'']' AS message
UNION ALL SELECT 1, 'column_consistency', 'warning', 'Columns appear in both numerical and categorical lists: [''l_quantity'']'
UNION ALL SELECT 2, 'target_validity', CASE WHEN tnull > 0.5 THEN 'error' ELSE 'pass' END,
  CASE WHEN tnull > 0.5 THEN printf('Target column has too many missing values (%.1f%%)', tnull * 100) ELSE '' END FROM st
UNION ALL SELECT 3, 'data_quality', 'pass', '' FROM st, dup WHERE miss / (n * {len(LN_COLS)}) <= 0.3 AND d / n <= 0.1""")
def q_gate_preprocessing(spark, sf):
    return Q.gate_preprocessing(T.lineitem_nulls(spark, sf), NUMS, CATS, "l_tax")


def _split(spark, sf):
    bs = T.balance_set(spark, sf)
    test = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    return bs.where(~test), bs.where(test)


@register("gate_training", """
SELECT * FROM (VALUES (0, 'train_test_split', 'pass', ''), (1, 'feature_consistency', 'pass', ''),
                      (2, 'problem_type', 'pass', '')) v(seq, "check", status, message)
WHERE (SELECT COUNT(DISTINCT toxic) FROM labels) >= 2""")
def q_gate_training(spark, sf):
    tr, te = _split(spark, sf)
    feats = ["n_chars", "n_words"]
    return Q.gate_training(tr.select(*feats), te.select(*feats), tr.select("label"), te.select("label"),
                           "label", "Classification")


@register("check_problem_type", """
SELECT 'Classification' AS problem_type, CASE WHEN u < 2 THEN 'error' ELSE 'pass' END AS status FROM (SELECT COUNT(DISTINCT toxic) AS u FROM labels)
UNION ALL SELECT 'Regression', CASE WHEN u < 10 THEN 'error' ELSE 'pass' END FROM (SELECT COUNT(DISTINCT toxic) AS u FROM labels)""")
def q_check_problem_type(spark, sf):
    lab = T.table(spark, sf, "labels")
    rows = [(pt, Q.problem_type_check(lab, "toxic", pt)[1]) for pt in ("Classification", "Regression")]
    return spark.createDataFrame(rows, "problem_type string, status string")


@register("gate_transition", """
SELECT 0 AS seq, 'data_not_empty' AS "check", 'pass' AS status, '' AS message FROM (SELECT COUNT(*) AS n FROM customer) WHERE n > 0
UNION ALL SELECT 1, 'minimum_rows', 'pass', '' FROM (SELECT COUNT(*) AS n FROM customer) WHERE n >= 10
UNION ALL SELECT 2, 'minimum_columns', 'pass', ''
UNION ALL SELECT 0, 'transition', 'error', 'Unknown workflow transition: upload_to_training'""")
def q_gate_transition(spark, sf):
    a = Q.gate_transition("upload", "eda", T.table(spark, sf, "customer"))
    b = Q.gate_transition("upload", "training", T.table(spark, sf, "customer"))
    return a.unionByName(b)


READY_SQL = _with(T.SQL_LINEITEM_NULLS) + f""",
st AS (SELECT COUNT(*) AS n, ({MISS}) / (COUNT(*) * {len(LN_COLS)}) AS mp FROM lineitem_nulls),
rd AS (
  SELECT 0 AS seq, 'rows' AS "check",
    CASE WHEN n >= 100 THEN 'success' WHEN n >= 20 THEN 'warning' ELSE 'error' END AS status,
    CASE WHEN n >= 100 THEN 'Dataset has sufficient rows (' || n || ') for training.'
         WHEN n >= 20 THEN 'Dataset is relatively small (' || n || ' rows). Consider cross-validation.'
         ELSE 'Dataset is very small (' || n || ' rows). Machine learning might not be effective.' END AS message FROM st
  UNION ALL SELECT 1, 'columns', 'success', 'Dataset has {len(LN_COLS)} columns, sufficient for feature engineering.'
  UNION ALL SELECT 2, 'missing',
    CASE WHEN mp = 0 THEN 'success' WHEN mp < 0.1 THEN 'success' WHEN mp < 0.3 THEN 'warning' ELSE 'error' END,
    CASE WHEN mp = 0 THEN 'No missing values detected in the dataset.'
         WHEN mp < 0.1 THEN printf('Low percentage of missing values (%.1f%%). Easy to handle.', mp * 100)
         WHEN mp < 0.3 THEN printf('Moderate percentage of missing values (%.1f%%). Imputation recommended.', mp * 100)
         ELSE printf('High percentage of missing values (%.1f%%). Data cleaning is critical.', mp * 100) END FROM st
  UNION ALL SELECT 3, 'numeric_target', 'success', 'Numeric columns detected, suitable for regression or time series.'
  UNION ALL SELECT 4, 'categorical_target', 'success', 'Categorical columns detected, suitable for classification.')
"""


def _readiness(spark, sf):
    return Q.data_readiness(T.lineitem_nulls(spark, sf), ["l_quantity", "l_tax"], ["l_returnflag"])


@register("data_readiness", READY_SQL + "SELECT * FROM rd")
def q_data_readiness(spark, sf):
    return _readiness(spark, sf)


@register("ml_readiness", READY_SQL + """,
c AS (SELECT COUNT(*) FILTER (WHERE status = 'error') AS e, COUNT(*) FILTER (WHERE status = 'warning') AS w FROM rd),
r AS (SELECT flatten(list(list_filter([
        CASE WHEN contains(lower(message), 'imputation') OR contains(lower(message), 'missing') THEN 'Apply missing value imputation in Preprocessing tab.' END,
        CASE WHEN contains(lower(message), 'small') THEN 'Use robust models like Random Forest or Cross-Validation.' END,
        CASE WHEN contains(lower(message), 'cleaning') THEN 'Review data quality in EDA tab.' END], lambda x: x IS NOT NULL)
        ORDER BY CASE WHEN status = 'error' THEN 0 ELSE 1 END, seq)) AS recs
      FROM rd WHERE status IN ('error', 'warning'))
SELECT e = 0 AS ready,
  CASE WHEN e = 0 AND w = 0 THEN 'Dataset is highly optimal for machine learning.'
       WHEN e = 0 THEN 'Dataset is ready for machine learning with some considerations.'
       ELSE 'Dataset requires significant cleaning before machine learning.' END AS message,
  CASE WHEN e = 0 THEN ['Exploratory Data Analysis', 'Preprocessing', 'Model Training', 'Model Interpretation']
       ELSE ['Exploratory Data Analysis'] END AS available_workflows,
  COALESCE(recs, []) AS recommendations FROM c, r""")
def q_ml_readiness(spark, sf):
    return Q.ml_readiness(_readiness(spark, sf))


EDA_SQL = _with(T.SQL_LINEITEM_NULLS) + f""",
st AS (SELECT ({MISS}) AS m FROM lineitem_nulls),
ed AS (
  SELECT 0 AS seq, 'missing' AS "check", CASE WHEN m = 0 THEN 'success' ELSE 'warning' END AS status,
    CASE WHEN m = 0 THEN 'Dataset is clean (no missing values).'
         ELSE 'Dataset has ' || m || ' missing values. Preprocessing recommended.' END AS message FROM st
  UNION ALL SELECT 1, 'correlation', 'success', 'Correlation analysis possible for 2 numerical features.'
  UNION ALL SELECT 2, 'distribution', 'success', 'Distribution analysis available for numerical features.'
  UNION ALL SELECT 3, 'outliers', 'info', 'Consider checking for outliers in numerical features before training.')
"""


def _eda(spark, sf):
    return Q.eda_completeness(T.lineitem_nulls(spark, sf), ["l_quantity", "l_tax"], ["l_returnflag"])


@register("eda_completeness", EDA_SQL + "SELECT * FROM ed")
def q_eda_completeness(spark, sf):
    return _eda(spark, sf)


@register("eda_readiness", EDA_SQL + """
SELECT true AS ready, 'Exploratory Data Analysis is sufficient for basic ML transition.' AS message,
  ['Preprocessing', 'Feature Engineering'] AS available_transitions,
  COALESCE((SELECT flatten(list(list_filter([
     CASE WHEN contains(lower(message), 'missing') THEN 'Handle missing values in the Preprocessing tab.' END,
     CASE WHEN contains(lower(message), 'correlation') THEN 'Add more numerical features if possible for better insight.' END],
     lambda x: x IS NOT NULL) ORDER BY seq)) FROM ed WHERE status = 'warning'), []) AS recommendations""")
def q_eda_readiness(spark, sf):
    return Q.eda_readiness(_eda(spark, sf))


@register("training_readiness", _with(T.SQL_BALANCE_SET) + """
SELECT 0 AS seq, 'rows' AS "check", CASE WHEN n < 10 THEN 'error' WHEN n < 50 THEN 'warning' ELSE 'success' END AS status,
  CASE WHEN n < 10 THEN 'Insufficient data for training (' || n || ' samples).'
       WHEN n < 50 THEN 'Small dataset (' || n || ' samples). Results might be unstable.'
       ELSE 'Training data has ' || n || ' samples.' END AS message FROM (SELECT COUNT(*) AS n FROM balance_set)
UNION ALL SELECT 1, 'classes', CASE WHEN u < 2 THEN 'error' ELSE 'success' END,
  CASE WHEN u < 2 THEN 'Classification requires at least 2 unique target classes.' ELSE 'Found ' || u || ' classes for classification.' END
  FROM (SELECT COUNT(DISTINCT label) AS u FROM balance_set)
UNION ALL SELECT 2, 'scaling', 'info', 'Logistic Regression assumes feature scaling. Check if scaling was applied.'""")
def q_training_readiness(spark, sf):
    bs = T.balance_set(spark, sf)
    return Q.training_readiness(bs.select("n_chars", "n_words"), bs.select("label"), "label", "Classification",
                                "Logistic Regression")
