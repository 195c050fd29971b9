"""Registered profiling queries (A1-A15, A24) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import profile as P
from strata.plans.registry import register
from strata.sources import tables as T

ORDERS_COLS = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"),
               ("o_totalprice", "num"), ("o_orderdate", "ts"), ("o_orderpriority", "str")]


def _sql_profile(table: str, cols) -> str:
    parts = []
    for c, kind in cols:
        order = c if kind != "str" else c
        top = (f"(SELECT CAST({c} AS VARCHAR) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
               f"ORDER BY COUNT(*) DESC, {order} LIMIT 1)")
        topn = (f"(SELECT COUNT(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY COUNT(*) DESC LIMIT 1)")
        if kind == "str":
            text = (f"round(AVG(length({c})), 6) AS avg_length, bool_or(regexp_matches({c}, '\\d')) AS has_numbers, "
                    f"bool_or(regexp_matches({c}, '[^\\w\\s]')) AS has_special_chars")
        else:
            text = "CAST(NULL AS DOUBLE) AS avg_length, CAST(NULL AS BOOLEAN) AS has_numbers, CAST(NULL AS BOOLEAN) AS has_special_chars"
        parts.append(
            f"SELECT '{c}' AS \"column\", COUNT(*) AS total, COUNT(*) - COUNT({c}) AS null_count, "
            f"round((COUNT(*) - COUNT({c})) / COUNT(*), 6) AS null_percentage, "
            f"COUNT(DISTINCT {c}) AS unique_count, round(COUNT(DISTINCT {c}) / COUNT(*), 6) AS unique_ratio, "
            f"{top} AS most_frequent, round({topn} / COUNT(*), 6) AS frequency_ratio, {text} FROM {table}")
    return "\nUNION ALL\n".join(parts)


@register("column_profile", _sql_profile("orders", ORDERS_COLS))
def q_column_profile(spark, sf):
    return P.column_profile(T.table(spark, sf, "orders"))


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_moments(table, cols):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", round(MIN({c}), 6) AS min, round(MAX({c}), 6) AS max, "
        f"round(AVG({c}), 5) AS mean, round(STDDEV_SAMP({c}), 6) AS std, round(skewness({c}), 6) AS skewness, "
        f"round(kurtosis({c}), 6) AS kurtosis, "
        f"(COUNT(DISTINCT {c}) <= 20 AND COUNT(DISTINCT {c}) / COUNT(*) < 0.1) AS potential_categorical FROM {table}"
        for c in cols)


@register("numeric_moments", _sql_moments("lineitem", LI_NUM))
def q_numeric_moments(spark, sf):
    return P.numeric_moments(T.table(spark, sf, "lineitem"), LI_NUM)


NULL_COLS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate"]


def _nulls_sql_counts():
    sel = ", ".join(f"COUNT(*) - COUNT({c}) AS m_{c}" for c in NULL_COLS)
    un = "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", m_{c} AS missing_count, n AS rows FROM w"
                              for c in NULL_COLS)
    return (f"WITH {T.SQL_LINEITEM_NULLS},\nw AS (SELECT COUNT(*) AS n, {sel} FROM lineitem_nulls),\n"
            f"nc AS ({un})\n")


def _li_nulls(spark, sf):
    return T.lineitem_nulls(spark, sf).select(*NULL_COLS)


@register("missing_summary", _nulls_sql_counts() + f"""
SELECT "column", missing_count, round(missing_count * 100.0 / rows, 6) AS missing_percentage,
       SUM(missing_count) OVER () AS total_missing,
       COUNT(*) FILTER (WHERE missing_count > 0) OVER () AS columns_with_missing,
       round(SUM(missing_count) OVER () * 100.0 / (rows * {len(NULL_COLS)}), 6) AS total_percentage
FROM nc QUALIFY missing_count > 0""")
def q_missing_summary(spark, sf):
    return P.missing_summary(_li_nulls(spark, sf))


_LEVEL_SQL = """CASE WHEN p < 5 THEN 'low' WHEN p < 20 THEN 'moderate' WHEN p < 40 THEN 'high' ELSE 'very_high' END"""


@register("missing_levels", _nulls_sql_counts() + f"""
SELECT "column", round(p, 6) AS missing_percentage, {_LEVEL_SQL} AS level
FROM (SELECT "column", missing_count * 100.0 / rows AS p FROM nc WHERE missing_count > 0)""")
def q_missing_levels(spark, sf):
    return P.missing_levels(_li_nulls(spark, sf))


@register("missing_recommendations", _nulls_sql_counts() + f"""
SELECT "column", round(p, 6) AS missing_percentage, {_LEVEL_SQL} AS level,
  CASE WHEN p < 5 THEN CASE WHEN "column" = 'l_tax' THEN ['simple_imputation']
                            ELSE ['simple_imputation', 'missing_indicator'] END
       WHEN p < 20 THEN ['advanced_imputation', 'missing_indicator']
       WHEN p < 40 THEN ['model_based', 'advanced_imputation']
       ELSE ['delete_columns', 'model_based'] END AS strategies
FROM (SELECT "column", missing_count * 100.0 / rows AS p FROM nc WHERE missing_count > 0)""")
def q_missing_recommendations(spark, sf):
    return P.missing_recommendations(_li_nulls(spark, sf), target_column="l_tax")


def _pairs_sql():
    ind = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS i_{c}" for c in NULL_COLS)
    pairs = []
    for i, a in enumerate(NULL_COLS):
        for b in NULL_COLS[i + 1:]:
            pairs.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
                         f"CASE WHEN isnan(corr(i_{a}, i_{b})) THEN NULL ELSE corr(i_{a}, i_{b}) END AS r, "
                         f"COUNT(*) AS rows FROM ind")
    return (f"WITH {T.SQL_LINEITEM_NULLS},\nind AS (SELECT {ind} FROM lineitem_nulls),\n"
            f"pr AS ({' UNION ALL '.join(pairs)})\n")


@register("missing_correlation", _pairs_sql() + """
SELECT column_a, column_b, round(r, 6) AS correlation FROM pr WHERE rows > 10 AND abs(r) > 0.5""")
def q_missing_correlation(spark, sf):
    return P.missing_correlation(_li_nulls(spark, sf))


@register("missing_pattern", _pairs_sql() + """
SELECT CASE WHEN MAX(rows) <= 10 THEN NULL
            WHEN COUNT(*) FILTER (WHERE abs(r) > 0.5) = 0 THEN 'MCAR'
            WHEN COUNT(*) FILTER (WHERE abs(r) > 0.7) > 0 THEN 'MNAR' ELSE 'MAR' END AS pattern,
       COUNT(*) FILTER (WHERE abs(r) > 0.5) AS high_corr_pairs FROM pr""")
def q_missing_pattern(spark, sf):
    return P.missing_pattern(_li_nulls(spark, sf))


@register("value_counts", """
SELECT o_orderpriority AS value, COUNT(*) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf):
    return P.value_counts(T.table(spark, sf, "orders"), "o_orderpriority")


@register("class_imbalance", """
WITH vc AS (SELECT toxic AS cls, COUNT(*) AS cnt FROM labels GROUP BY 1),
a AS (SELECT SUM(cnt) AS n, COUNT(*) AS k, MAX(cnt) AS mx, MIN(cnt) AS mn,
             arg_min(cls, (cnt, cls)) AS mi, arg_min(cls, (-cnt, cls)) AS ma,
             SUM(cnt * cnt) AS ss, list(cnt) AS counts FROM vc)
SELECT round(mx / mn, 6) AS imbalance_ratio, CAST(mi AS VARCHAR) AS minority_class,
       CAST(ma AS VARCHAR) AS majority_class, round(1 - ss / (n * n), 6) AS gini,
       CASE WHEN mx / mn > 10 THEN 'severe' WHEN mx / mn > 3 THEN 'moderate' ELSE 'slight' END AS imbalance_level,
       len(list_filter(counts, lambda x: x < n / k)) AS minority_classes,
       len(list_filter(counts, lambda x: x >= n / k)) AS majority_classes,
       CASE WHEN mx / mn > 3 THEN ['ensemble_methods', 'threshold_tuning'] ELSE [] END
       || CASE WHEN k > 2 THEN ['multiclass_strategies'] ELSE [] END AS recommendations
FROM a""")
def q_class_imbalance(spark, sf):
    return P.class_imbalance(T.table(spark, sf, "labels"), "toxic")


DC_COLS = ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate", "l_quantity"]


@register("distinct_count", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS unique_count FROM lineitem" for c in DC_COLS))
def q_distinct_count(spark, sf):
    return P.distinct_count(T.table(spark, sf, "lineitem"), DC_COLS)


@register("quantiles", "\nUNION ALL\n".join(
    f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS l_extendedprice, "
    f"round(quantile_cont(l_quantity, {p}), 6) AS l_quantity FROM lineitem"
    for p in (0.1, 0.25, 0.5, 0.75, 0.9)))
def q_quantiles(spark, sf):
    from strata.functions.stats import exact_quantiles
    li = T.table(spark, sf, "lineitem")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    return quantile_table(li, ["l_extendedprice", "l_quantity"], probs)


def quantile_table(df, cols, probs):
    """A11 as a DataFrame: one row per probability, one column per input column."""
    from strata.functions.stats import exact_quantiles
    q = exact_quantiles(df, cols, probs)
    rows = [(float(p), *[q[(c, p)] for c in cols]) for p in probs]
    schema = "p double, " + ", ".join(f"{c} double" for c in cols)
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.select("p", *[F.round(c, 6).alias(c) for c in cols])


@register("mode_value", T.SQL_LINEITEM_NULLS.join(["WITH ", "\n"]) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COALESCE((SELECT CAST({c} AS VARCHAR) FROM lineitem_nulls WHERE {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1), 'Unknown') AS mode"
    for c in ["l_returnflag", "l_linestatus", "l_quantity"]))
def q_mode_value(spark, sf):
    return P.mode_value(T.lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus", "l_quantity"])


@register("count_by_action", f"""WITH {T.SQL_ACTIVITY_LOG}
SELECT action, COUNT(*) AS total FROM activity_log GROUP BY action""")
def q_count_by_action(spark, sf):
    return P.count_by(T.activity_log(spark, sf), "action")


@register("usage_by_feature", f"""WITH {T.SQL_ACTIVITY_LOG},
fu AS (SELECT action AS feature_name, username, COUNT(*) AS use_count, MAX(created_at) AS last_used
       FROM activity_log GROUP BY 1, 2)
SELECT feature_name, SUM(use_count) AS total_uses, MAX(last_used) AS last_used FROM fu GROUP BY 1""")
def q_usage_by_feature(spark, sf):
    from strata.sources.activity import feature_usage_from_log
    fu = feature_usage_from_log(T.activity_log(spark, sf))
    return P.usage_by_feature(fu, "feature_name", "use_count", "last_used")


@register("having_duplicates", f"""WITH {T.SQL_DUP_EMAILS}
SELECT email, COUNT(*) AS count FROM dup_emails GROUP BY email HAVING COUNT(*) > 1""")
def q_having_duplicates(spark, sf):
    return P.having_duplicates(T.dup_emails(spark, sf), "email")


@register("duplicate_ratio", """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity, COUNT(*) AS c FROM lineitem GROUP BY ALL)
SELECT SUM(c) AS rows, SUM(c - 1) AS duplicates, round(SUM(c - 1) / SUM(c), 6) AS duplicate_ratio,
       SUM(c - 1) / SUM(c) > 0.1 AS warn FROM g""")
def q_duplicate_ratio(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return P.duplicate_ratio(li)
