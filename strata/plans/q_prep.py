"""Registered preparation queries: imputation, scaling, encoding, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import prep as PR
from strata.plans.q_windows import rnd
from strata.plans.registry import register
from strata.sources import tables as T


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


IMP_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag"]


def _imp_input(spark, sf):
    return T.lineitem_nulls(spark, sf).select(*IMP_COLS)


@register("impute_simple", _with(T.SQL_LINEITEM_NULLS) + """,
s AS (SELECT skewness(l_quantity) AS sq, AVG(l_quantity) AS mq, quantile_cont(l_quantity, 0.5) AS dq,
             skewness(l_tax) AS st, AVG(l_tax) AS mt, quantile_cont(l_tax, 0.5) AS dt,
             (SELECT l_returnflag FROM lineitem_nulls WHERE l_returnflag IS NOT NULL GROUP BY 1
              ORDER BY COUNT(*) DESC, l_returnflag LIMIT 1) AS mf FROM lineitem_nulls)
SELECT l_orderkey, l_linenumber,
  round(COALESCE(l_quantity, CASE WHEN abs(sq) > 1 THEN dq ELSE mq END), 6) AS l_quantity,
  round(COALESCE(l_tax, CASE WHEN abs(st) > 1 THEN dt ELSE mt END), 6) AS l_tax,
  COALESCE(l_returnflag, COALESCE(mf, 'Unknown')) AS l_returnflag
FROM lineitem_nulls, s""")
def q_impute_simple(spark, sf):
    d = _imp_input(spark, sf)
    return rnd(PR.impute_simple(d, num=["l_quantity", "l_tax"], cat=["l_returnflag"]), 6)


def _auto_sql(cols):
    miss = " + ".join(f"(COUNT(*) - COUNT({c}))" for c in cols)
    return _with(T.SQL_LINEITEM_NULLS) + f"""
SELECT round(p, 6) AS total_missing_pct,
  CASE WHEN p < 5 THEN 'simple' WHEN p < 20 THEN 'knn' WHEN p < 40 THEN 'iterative' ELSE 'model' END AS strategy
FROM (SELECT ({miss}) * 100.0 / (COUNT(*) * {len(cols)}) AS p FROM lineitem_nulls)"""


LN_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _auto_choice(spark, df):
    p = PR.total_missing_pct(df)
    return spark.createDataFrame([(round(p, 6), PR.choose_imputation_strategy(p))],
                                 "total_missing_pct double, strategy string")


@register("impute_auto_choice", _auto_sql(LN_ALL))
def q_impute_auto_choice(spark, sf):
    return _auto_choice(spark, T.lineitem_nulls(spark, sf))


@register("impute_auto_choice_subset", _auto_sql(["l_quantity", "l_tax", "l_returnflag"]))
def q_impute_auto_choice_subset(spark, sf):
    return _auto_choice(spark, T.lineitem_nulls(spark, sf).select("l_quantity", "l_tax", "l_returnflag"))


@register("impute_iterative")
def q_impute_iterative(spark, sf):
    d = T.lineitem_nulls(spark, sf).select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return PR.impute_iterative(d, cols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("impute_iterative_two_columns", "WITH RECURSIVE " + T.SQL_LINEITEM_NULLS + """,
s AS (SELECT COUNT(l_quantity) AS n, avg(l_quantity) AS my, avg(l_extendedprice) FILTER (l_quantity IS NOT NULL) AS mx,
  regr_sxx(l_quantity, l_extendedprice) AS xx, regr_sxy(l_quantity, l_extendedprice) AS xy, regr_syy(l_quantity, l_extendedprice) AS yy FROM lineitem_nulls),
it AS (SELECT 0 AS i, 1.0 / (yy / n + 2.220446049250313e-16) AS noise, CAST(1.0 AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS w, false AS done FROM s
  UNION ALL SELECT i + 1, (n - used + 2e-6) / (greatest(yy - 2 * c * xy + c * c * xx, 0) + 2e-6), (used + 2e-6) / (c * c + 2e-6), c, coalesce(abs(c - w) < 1e-3, false)
  FROM (SELECT i, w, xy / (xx + weight / noise) AS c, noise * xx / (weight + noise * xx) AS used FROM it, s WHERE NOT done AND i < 300), s),
fit AS (SELECT xy / (xx + weight / noise) AS c FROM it, s ORDER BY i DESC LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, my + c * (l_extendedprice - mx)), 6) AS l_quantity, l_extendedprice FROM lineitem_nulls, s, fit""")
def q_impute_iterative_two_columns(spark, sf):
    d = T.lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rnd(PR.impute_iterative(d, cols=["l_quantity", "l_extendedprice"]), 6)


@register("missing_indicator", _with(T.SQL_LINEITEM_NULLS) + """
SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag,
  CAST(l_quantity IS NULL AS INTEGER) AS l_quantity_missing, CAST(l_tax IS NULL AS INTEGER) AS l_tax_missing
FROM lineitem_nulls""")
def q_missing_indicator(spark, sf):
    return PR.missing_indicator(_imp_input(spark, sf), ["l_quantity", "l_tax"])


@register("clean_for_ml", _with(T.SQL_LINEITEM_NULLS) + """
SELECT l_orderkey, l_linenumber,
  COALESCE(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_nulls)) AS l_quantity,
  COALESCE(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM lineitem_nulls)) AS l_tax,
  l_extendedprice FROM lineitem_nulls""")
def q_clean_for_ml(spark, sf):
    d = T.lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    out, _ = PR.clean_for_ml(d, target="l_extendedprice", features=["l_quantity", "l_tax"])
    return out


@register("prep_for_attribution", _with(T.SQL_LINEITEM_NULLS) + """
SELECT l_orderkey, round(COALESCE(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_nulls)), 6) AS l_quantity,
  round(COALESCE(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM lineitem_nulls)), 6) AS l_discount,
  CAST(COALESCE(l_returnflag = 'A', false) AS INTEGER) AS l_returnflag_A,
  CAST(COALESCE(l_returnflag = 'N', false) AS INTEGER) AS l_returnflag_N,
  CAST(COALESCE(l_returnflag = 'R', false) AS INTEGER) AS l_returnflag_R,
  CAST(COALESCE(l_linestatus = 'F', false) AS INTEGER) AS l_linestatus_F,
  CAST(COALESCE(l_linestatus = 'O', false) AS INTEGER) AS l_linestatus_O
FROM lineitem_nulls""")
def q_prep_for_attribution(spark, sf):
    d = T.lineitem_nulls(spark, sf).select("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return rnd(PR.prep_for_attribution(d, "shap"), 6)


SC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("scale_standard", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - AVG({c}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({c}) OVER (), 0), 1), 6) AS {c}" for c in SC_COLS)
    + " FROM lineitem")
def q_scale_standard(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SC_COLS)
    return rnd(PR.scale_standard(li, SC_COLS), 6)


@register("scale_minmax", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - MIN({c}) OVER ()) / COALESCE(NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 1), 6) AS {c}"
    for c in SC_COLS) + " FROM lineitem")
def q_scale_minmax(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SC_COLS)
    return rnd(PR.scale_minmax(li, SC_COLS), 6)


@register("scale_robust", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - quantile_cont({c}, 0.5) OVER ()) / COALESCE(NULLIF(quantile_cont({c}, 0.75) OVER () - "
    f"quantile_cont({c}, 0.25) OVER (), 0), 1), 6) AS {c}" for c in SC_COLS) + " FROM lineitem")
def q_scale_robust(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SC_COLS)
    return rnd(PR.scale_robust(li, SC_COLS), 6)


def _poly(terms: list[float], x: str) -> str:
    out = repr(terms[0])
    for t in terms[1:]:
        out = f"({out} * {x} + {t!r})"
    return out


def _normal_sql(u: str) -> str:
    """The rational inverse of the normal distribution that the operator uses."""
    a, b, c, d = PR.PPF
    tail = lambda q: f"{_poly(c, q)} / {_poly([*d, 1.0], q)}"
    low, high = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))"
    mid = f"(({u} - 0.5) * ({u} - 0.5))"
    return f"""CASE WHEN {u} < 0.02425 THEN {tail(low)} WHEN {u} > 1 - 0.02425 THEN -({tail(high)})
  ELSE {_poly(a, mid)} * ({u} - 0.5) / {_poly([*b, 1.0], mid)} END"""


def _quantile_normal_sql(cols: list[str], nq: int = 1000) -> str:
    """For tables of at least ``nq`` rows."""
    probs = [i / (nq - 1) for i in range(nq)]
    parts = []
    for c in cols:
        parts.append(f"""{c}_knots AS (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS next_v, lead(lo) OVER (ORDER BY v) AS next_lo FROM (
  SELECT v, min(i) / {nq - 1}.0 AS lo, max(i) / {nq - 1}.0 AS hi FROM (SELECT unnest(q) AS v, unnest(range({nq})) AS i FROM (SELECT quantile_cont({c}, {probs}) AS q FROM lineitem)) GROUP BY v)),
{c}_scores AS (SELECT x, {_normal_sql("u")} AS score FROM (SELECT x, least(greatest(CASE WHEN x = v THEN (lo + hi) / 2 ELSE hi + (x - v) / (next_v - v) * (next_lo - hi) END, 1e-7), 1 - 1e-7) AS u
  FROM (SELECT DISTINCT {c} AS x FROM lineitem) ASOF JOIN {c}_knots ON x >= v))""")
    return ("WITH " + ",\n".join(parts) + "\nSELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}_scores.score, 6) AS {c}" for c in cols)
            + " FROM lineitem l " + " ".join(f"JOIN {c}_scores ON {c}_scores.x = l.{c}" for c in cols))


@register("scale_quantile_normal", _quantile_normal_sql(SC_COLS))
def q_scale_quantile_normal(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SC_COLS)
    return rnd(PR.scale_quantile_normal(li, SC_COLS), 6)


@register("scale_power")
def q_scale_power(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return PR.scale_power(li, ["l_extendedprice", "l_discount"])[1]


@register("scale_boxcox")
def q_scale_boxcox(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return PR.scale_boxcox(li, ["l_extendedprice", "l_quantity"])[1]


def _iqr_sql(c):
    return (f"COUNT(*) FILTER (WHERE {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))")


@register("scale_auto_choice", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in SC_COLS) + """ FROM lineitem),
s AS (SELECT COUNT(*) AS n, """ + " + ".join(_iqr_sql(c) for c in SC_COLS) + """ AS outliers,
  (""" + " + ".join(f"abs(skewness({c}))" for c in SC_COLS) + f""") / {len(SC_COLS)} AS sk,
  (""" + " + ".join(f"abs(kurtosis({c}))" for c in SC_COLS) + f""") / {len(SC_COLS)} AS ku FROM lineitem, q)
SELECT outliers, round(sk, 6) AS mean_abs_skew, round(ku, 6) AS mean_abs_kurtosis,
  CASE WHEN outliers > 0.05 * n THEN 'robust' WHEN sk > 1 THEN 'power' WHEN sk > 0.5 THEN 'quantile' ELSE 'standard' END AS method
FROM s""")
def q_scale_auto_choice(spark, sf):
    li = T.table(spark, sf, "lineitem").select(*SC_COLS)
    st = PR.scaling_stats(li, SC_COLS)
    return spark.createDataFrame([(st["outliers"], round(st["mean_abs_skew"], 6), round(st["mean_abs_kurtosis"], 6),
                                   PR.choose_scaling(st))],
                                 "outliers long, mean_abs_skew double, mean_abs_kurtosis double, method string")


@register("log_transform", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(ln({c} + 1), 6) AS {c}" for c in SC_COLS) + " FROM lineitem")
def q_log_transform(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SC_COLS)
    return rnd(PR.log_transform(li, SC_COLS), 6)


@register("mean_std_scaled_before_after", "SELECT " + ", ".join([
    "round((" + " + ".join(f"abs(skewness({c}))" for c in SC_COLS) + f") / {len(SC_COLS)}, 6) AS skew_before",
    "round((" + " + ".join(f"abs(kurtosis({c}))" for c in SC_COLS) + f") / {len(SC_COLS)}, 6) AS kurt_before",
    "round((" + " + ".join(f"abs(skewness({c}))" for c in SC_COLS) + f") / {len(SC_COLS)}, 6) AS skew_after",
    "round((" + " + ".join(f"abs(kurtosis({c}))" for c in SC_COLS) + f") / {len(SC_COLS)}, 6) AS kurt_after",
    "0.0 AS skew_reduction", "0.0 AS kurt_reduction"]) + " FROM lineitem")
def q_mean_std_scaled_before_after(spark, sf):
    li = T.table(spark, sf, "lineitem").select(*SC_COLS)
    r = PR.skew_kurt_before_after(li, PR.scale_robust(li, SC_COLS), SC_COLS)
    return rnd(r, 6).select(*[F.abs(F.col(c)).alias(c) if c.endswith("reduction") else F.col(c) for c in r.columns])


@register("onehot_drop_first", """
SELECT o_orderkey, o_orderstatus, o_orderpriority,
  CAST(o_orderstatus = 'O' AS DOUBLE) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS DOUBLE) AS o_orderstatus_P,
  CAST(o_orderpriority = '2-HIGH' AS DOUBLE) AS "o_orderpriority_2-HIGH",
  CAST(o_orderpriority = '3-MEDIUM' AS DOUBLE) AS "o_orderpriority_3-MEDIUM",
  CAST(o_orderpriority = '4-NOT SPECIFIED' AS DOUBLE) AS "o_orderpriority_4-NOT SPECIFIED",
  CAST(o_orderpriority = '5-LOW' AS DOUBLE) AS "o_orderpriority_5-LOW" FROM orders""")
def q_onehot_drop_first(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return PR.onehot_drop_first(o, ["o_orderstatus", "o_orderpriority"])


@register("onehot_all", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F,
  CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P
FROM orders""")
def q_onehot_all(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return PR.onehot_all(o, ["o_orderstatus"])


@register("factorize", """
WITH f AS (SELECT o_orderpriority, MIN(o_orderkey) AS fk FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY fk, o_orderpriority) - 1 AS code FROM f)
SELECT o.o_orderpriority, o.o_orderkey, COALESCE(c.code, -1) AS o_orderpriority_code
FROM orders o LEFT JOIN c USING (o_orderpriority)""")
def q_factorize(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return PR.factorize(o, "o_orderpriority", "o_orderkey").select("o_orderpriority", "o_orderkey",
                                                                    F.col("o_orderpriority_code").cast("int"))


@register("bin_equal_frequency", "WITH e AS (SELECT " + ", ".join(
    f"quantile_cont(l_extendedprice, {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(""" + " + ".join(
    f"CASE WHEN l_extendedprice >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + """ AS DOUBLE) AS l_extendedprice_binned
FROM lineitem, e""")
def q_bin_equal_frequency(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return PR.bin_equal_frequency(li, "l_extendedprice")[1]


@register("polynomial_features", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
  round(l_quantity * l_quantity, 6) AS "poly_l_quantity^2", round(l_quantity * l_discount, 6) AS "poly_l_quantity l_discount",
  round(l_quantity * l_tax, 6) AS "poly_l_quantity l_tax", round(l_discount * l_discount, 6) AS "poly_l_discount^2",
  round(l_discount * l_tax, 6) AS "poly_l_discount l_tax", round(l_tax * l_tax, 6) AS "poly_l_tax^2" FROM lineitem""")
def q_polynomial_features(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rnd(PR.polynomial_features(li, ["l_quantity", "l_discount", "l_tax"], "all"), 6)


@register("interaction_features", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount,
  concat_ws('|', l_returnflag, l_linestatus) AS l_returnflag_x_l_linestatus,
  round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount FROM lineitem""")
def q_interaction_features(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                              "l_quantity", "l_discount")
    return rnd(PR.interaction_features(li, [("l_returnflag", "l_linestatus")], [("l_quantity", "l_discount")]), 6)


@register("transform_auto", """
SELECT * FROM (SELECT 'o_totalprice' AS feature, CASE WHEN COUNT(DISTINCT o_totalprice) > 20 AND abs(skewness(o_totalprice)) > 1 THEN 'binning'
  WHEN abs(skewness(o_totalprice)) > 0.5 THEN 'polynomial' END AS method FROM orders
UNION ALL SELECT 'o_orderpriority', CASE WHEN COUNT(DISTINCT o_orderpriority) <= 10 THEN 'onehot_encoding' ELSE 'frequency_encoding' END FROM orders
UNION ALL SELECT 'o_custkey', CASE WHEN COUNT(DISTINCT o_custkey) <= 10 THEN 'onehot_encoding' ELSE 'frequency_encoding' END FROM orders) WHERE method IS NOT NULL""")
def q_transform_auto(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                           F.col("o_custkey").cast("string").alias("o_custkey"))
    out, info = PR.transform_auto(o, categorical=["o_orderpriority", "o_custkey"], numerical=["o_totalprice"])
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(info, "feature string, method string")
