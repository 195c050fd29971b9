"""Registered explanation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strata.operators import explain as X
from strata.operators import learn as L
from strata.plans.q_windows import rnd
from strata.plans.registry import register
from strata.sources import tables as T

ID_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _li(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
                     F.col("l_quantity").cast("double").alias("l_quantity"), "l_discount", "l_tax", "l_extendedprice",
                     "l_returnflag")


def _linear_attr(spark, sf):
    li = _li(spark, sf)
    m = L.fit_linear_regression(li, ["l_quantity"], "l_extendedprice").stages[-1]
    return X.shap_linear({"l_quantity": float(m.coefficients[0])}, li, li, "id")


LIN_SQL = f"""WITH a AS (SELECT {ID_SQL} AS id, 'l_quantity' AS feature, CAST(l_quantity AS DOUBLE) AS value,
  regr_slope(l_extendedprice, l_quantity) OVER () * (l_quantity - AVG(l_quantity) OVER ()) AS attribution FROM lineitem)
"""


@register("shap_linear", LIN_SQL + "SELECT id, feature, value, round(attribution, 4) AS attribution FROM a")
def q_shap_linear(spark, sf):
    return rnd(_linear_attr(spark, sf), 4)


@register("mean_abs_importance", LIN_SQL + "SELECT feature, round(AVG(abs(attribution)), 4) AS importance FROM a GROUP BY 1")
def q_mean_abs_importance(spark, sf):
    return rnd(X.mean_abs_importance(_linear_attr(spark, sf)), 4)


@register("histogram", LIN_SQL + """,
r AS (SELECT MIN(attribution) AS lo, MAX(attribution) AS hi FROM a)
SELECT CAST(least(floor((attribution - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, COUNT(*) AS count FROM a, r GROUP BY 1""")
def q_histogram(spark, sf):
    return X.attribution_histogram(_linear_attr(spark, sf), 30).select("bin", "count")


@register("attribution_scatter_data", LIN_SQL + "SELECT feature, value AS feature_value, round(attribution, 4) AS attribution FROM a")
def q_attribution_scatter_data(spark, sf):
    return rnd(X.attribution_scatter_data(_linear_attr(spark, sf)), 4)


def _clf(spark, sf):
    s = L.train_test_split(T.balance_set(spark, sf), "doc_id", "label")
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    model = L.fit_random_forest_classifier(train, ["n_chars", "n_words"], "label")
    return model, train, test


@register("shap_kernel")
def q_shap_kernel(spark, sf):
    model, train, test = _clf(spark, sf)
    return rnd(X.shap_values(model, test, train, "doc_id", ["n_chars", "n_words"]), 6)


@register("shap_tree")
def q_shap_tree(spark, sf):
    li = _li(spark, sf)
    model = L.fit_random_forest_regressor(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rnd(X.shap_tree(model, li, "id", ["l_quantity", "l_discount", "l_tax"]), 4)


@register("shap_tree_multiclass")
def q_shap_tree_multiclass(spark, sf):
    model, _, test = _clf(spark, sf)
    return rnd(X.shap_tree(model, test, "doc_id", ["n_chars", "n_words"]), 6)


@register("lime_tabular")
def q_lime_tabular(spark, sf):
    s = L.train_test_split(T.balance_set(spark, sf), "doc_id", "label")
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    model = L.fit_logistic_regression(train, ["n_chars", "n_words"], "label")
    return rnd(X.lime_tabular(model, test, train, "doc_id", ["n_chars", "n_words"]), 6)


#: fixed coefficients (class x feature) of a linear model, so that the attributions have an SQL twin
def _coefficient(k: int, i: int) -> float:
    return ((k * 7 + i * 3) % 11 - 5) / 10


N_CLASSES, N_DIMS = 10, 64


def _multiclass_attr(spark, sf):
    e = T.table(spark, sf, "embeddings")
    coefs = np.array([[_coefficient(k, i) for i in range(N_DIMS)] for k in range(N_CLASSES)])
    return X.shap_linear_classes(coefs, e, [F.col("embedding")[i].cast("double") for i in range(N_DIMS)], "vec_id")


MULTI_SQL = f"""WITH x AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range({N_DIMS}) r(i)),
m AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
a AS (SELECT vec_id, k AS class, 'f' || i AS feature, (((k * 7 + i * 3) % 11) - 5) / 10.0 * (v - m) AS attribution
  FROM x JOIN m USING (i), range({N_CLASSES}) c(k)),
best AS (SELECT class FROM a GROUP BY class ORDER BY sum(abs(attribution)) DESC, class LIMIT 1)
"""


@register("combine_multiclass", MULTI_SQL + """SELECT vec_id, feature, round(avg(abs(attribution)), 6) AS attribution FROM a GROUP BY ALL""")
def q_combine_multiclass(spark, sf):
    return rnd(X.combine_multiclass(_multiclass_attr(spark, sf), "vec_id", "mean_abs"), 6)


@register("importance_table", MULTI_SQL + """SELECT feature, round(avg(abs(attribution)), 6) AS importance, 'max_importance' AS class_name
FROM a JOIN best USING (class) GROUP BY feature ORDER BY avg(abs(attribution)) DESC, feature LIMIT 10""")
def q_importance_table(spark, sf):
    comb = X.combine_multiclass(_multiclass_attr(spark, sf), "vec_id", "max_importance")
    return rnd(X.importance_table(comb, 10, "max_importance"), 6)


@register("batch_explain", LIN_SQL.replace(" FROM lineitem", ", CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS b, l_returnflag FROM lineitem") + """
SELECT id, feature, value, round(attribution, 4) AS attribution, CAST(b AS INTEGER) AS batch_id FROM a WHERE l_returnflag IN ('A', 'N', 'R')""")
def q_batch_explain(spark, sf):
    attr, _ = _batches(spark, sf)
    return rnd(attr, 4)


def _batches(spark, sf):
    li = _li(spark, sf)
    m = L.fit_linear_regression(li, ["l_quantity"], "l_extendedprice").stages[-1]
    coefs = {"l_quantity": float(m.coefficients[0])}
    return X.batch_explain(lambda b: X.shap_linear(coefs, b, li, "id"), [li.where(F.col("l_returnflag") == v) for v in ("A", "N", "R")])


@register("batch_explain_status", """
SELECT CAST(b.i AS INTEGER) AS batch_id, 'success' AS status, COUNT(l.l_returnflag) AS rows, CAST(NULL AS VARCHAR) AS error
FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R')) b(i, f) LEFT JOIN lineitem l ON l.l_returnflag = b.f GROUP BY b.i""")
def q_batch_explain_status(spark, sf):
    return _batches(spark, sf)[1]


@register("explanation_report", MULTI_SQL + """, imp AS (SELECT feature, avg(abs(attribution)) AS v FROM a JOIN best USING (class) GROUP BY feature),
r AS (SELECT list(feature ORDER BY v DESC, feature) AS fs FROM imp)
SELECT 'success' AS status, 'shap' AS method, array_to_string(fs[1:5], ',') AS top_5, array_to_string(fs[1:10], ',') AS top_10,
  (SELECT count(DISTINCT vec_id) FROM a) AS explained_ok, CAST(0 AS INTEGER) AS explained_failed,
  'focus_on_feature:' || fs[1] || ',consider_tree_explainer_for_tree_models,validate_with_domain_knowledge' AS advice FROM r""")
def q_explanation_report(spark, sf):
    comb = X.combine_multiclass(_multiclass_attr(spark, sf), "vec_id", "max_importance")
    report = X.explanation_report(comb, "shap")
    return report.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in report.dtypes])


def _split_sql():
    from strata.plans.q_learn import _h
    return ("WITH " + T.SQL_BALANCE_SET + ", sp AS (SELECT doc_id, label, CASE WHEN row_number() OVER "
            "(PARTITION BY label ORDER BY " + _h("doc_id", 0) + ", doc_id) - 1 < floor(COUNT(*) OVER "
            "(PARTITION BY label) * 0.8) THEN 'train' ELSE 'test' END AS split FROM balance_set)\n")


@register("cross_background", _split_sql() + """, train AS (SELECT b.n_chars, b.n_words FROM sp JOIN balance_set b USING (doc_id) WHERE split = 'train'),
per AS (SELECT 0 AS mask, COUNT(*) AS n, COUNT(DISTINCT (n_chars, n_words)) AS p FROM train UNION ALL SELECT 1, COUNT(*), COUNT(DISTINCT n_words) FROM train
  UNION ALL SELECT 2, COUNT(*), COUNT(DISTINCT n_chars) FROM train UNION ALL SELECT 3, COUNT(*), least(1, COUNT(*)) FROM train)
SELECT doc_id, CAST(SUM(n) AS BIGINT) AS expanded_rows, COUNT(*) AS coalitions, MAX(n) AS background_rows, CAST(SUM(p) AS BIGINT) AS patterns
FROM sp, per WHERE split = 'test' GROUP BY doc_id""")
def q_cross_background(spark, sf):
    s = L.train_test_split(T.balance_set(spark, sf), "doc_id", "label")
    e = X.coalition_counts(s.where("split = 'test'"), s.where("split = 'train'"), "doc_id", ["n_chars", "n_words"])
    return e.groupBy("doc_id").agg(F.sum("background_rows").alias("expanded_rows"), F.count(F.lit(1)).alias("coalitions"),
                                   F.max("background_rows").alias("background_rows"), F.sum("patterns").alias("patterns"))
