"""Registered queries: type detection, scalar functions, projections, joins, sets, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import scalar as S
from strata.functions import types as TY
from strata.operators import profile as P
from strata.operators import relational as RL
from strata.plans.flagship import SQL_FLAGSHIP, flagship
from strata.functions.stats import seeded_hash_sql
from strata.plans.registry import register
from strata.plans.q_windows import rnd
from strata.sources import tables as T


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ type detection

def sql_prof(table: str, cols) -> str:
    """DuckDB per-column profile: one row per column with the detector's inputs."""
    parts = []
    for c, kind in cols:
        topn = f"(SELECT COUNT(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC LIMIT 1)"
        num = kind == "num"
        st = kind == "str"
        dtype = {"num": "numeric", "str": "object", "ts": "datetime"}[kind]
        parts.append(
            f"SELECT '{c}' AS col, '{dtype}' AS detected_type, COUNT(*) AS n, COUNT(DISTINCT {c}) AS uc, "
            f"COUNT(DISTINCT {c}) / COUNT(*) AS ur, {topn} / COUNT(*) AS fr, (COUNT(*) - COUNT({c})) / COUNT(*) AS np, "
            + (f"STDDEV_SAMP({c}) AS sd, skewness({c}) AS sk, MIN({c})::DOUBLE AS mn, MAX({c})::DOUBLE AS mx, "
               if num else "NULL::DOUBLE AS sd, NULL::DOUBLE AS sk, NULL::DOUBLE AS mn, NULL::DOUBLE AS mx, ")
            + (f"bool_or(regexp_matches({c}, '\\d')) AS hn, bool_or(regexp_matches({c}, '[^\\w\\s]')) AS hs, "
               f"AVG(length({c})) AS al, COALESCE(bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL), false) AS dt0 "
               if st else f"NULL::BOOLEAN AS hn, NULL::BOOLEAN AS hs, NULL::DOUBLE AS al, {'true' if kind == 'ts' else 'false'} AS dt0 ")
            + f"FROM {table}")
    return "prof0 AS (" + "\nUNION ALL\n".join(parts) + """),
prof AS (SELECT *, (dt0 AND uc > 0) AS is_dt,
           (detected_type = 'numeric' AND uc <= 20 AND ur < 0.1) AS pc FROM prof0),
conf AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN is_dt THEN 0.7 + 0.4 + CASE WHEN ur > 0.9 THEN 0.2 ELSE 0 END
  ELSE 0.7::DOUBLE
   + CASE WHEN detected_type = 'numeric' AND ur > 0.9 THEN 0.2 WHEN ur > 0.9 THEN -0.2 ELSE 0 END
   + CASE WHEN ur < 0.1 AND uc <= 20 THEN 0.2 ELSE 0 END
   + CASE WHEN COALESCE(fr, 0) > 0.5 THEN 0.1 ELSE 0 END
   + CASE WHEN detected_type = 'object' AND COALESCE(hn, false) THEN -0.1 ELSE 0 END
   + CASE WHEN detected_type = 'numeric' THEN 0.2 ELSE 0 END
   + CASE WHEN detected_type = 'numeric' AND uc > 0 AND COALESCE(sd, 0) > 0 THEN 0.1 ELSE 0 END
   + CASE WHEN detected_type = 'numeric' AND (uc = 0 OR sk < 10) THEN 0.1 ELSE 0 END
   + CASE WHEN detected_type = 'numeric' AND (uc = 0 OR mn <> mx) THEN 0.1 ELSE 0 END
   + CASE WHEN detected_type = 'numeric' AND np < 0.1 THEN 0.1 ELSE 0 END
   + CASE WHEN detected_type = 'object' AND uc <= 20 AND ur < 0.5 THEN 0.2 ELSE 0 END END)) AS confidence
  FROM prof)
"""


ORDERS_KINDS = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"),
                ("o_totalprice", "num"), ("o_orderdate", "ts"), ("o_orderpriority", "str")]


@register("detect_column_types", _with(sql_prof("orders", ORDERS_KINDS)) + """
SELECT col AS "column", detected_type, round(confidence, 6) AS confidence, is_dt AS is_datetime,
  pc AS potential_categorical,
  list_filter([CASE WHEN np > 0.5 THEN 'drop_high_missing' END, CASE WHEN pc THEN 'treat_as_categorical' END,
               CASE WHEN ur > 0.9 THEN 'id_column' END, CASE WHEN uc <= 2 AND COALESCE(fr, 0) > 0.9 THEN 'binary' END,
               CASE WHEN detected_type = 'object' THEN CASE WHEN is_dt THEN 'convert_datetime'
                    WHEN NOT COALESCE(hs, false) AND COALESCE(al, 0) < 20 THEN 'categorical_encoding' END END],
              lambda x: x IS NOT NULL) AS recommendations
FROM conf""")
def q_detect_column_types(spark, sf):
    return TY.detect_column_types(T.table(spark, sf, "orders"))


@register("classify_columns", _with(sql_prof("orders", ORDERS_KINDS)) + """
SELECT col AS "column", cls AS classification FROM (
  SELECT col, confidence, CASE WHEN detected_type = 'numeric' AND NOT pc THEN 'numerical'
    WHEN detected_type = 'datetime' OR is_dt THEN 'datetime'
    WHEN detected_type IN ('object', 'categorical') OR pc THEN 'categorical' END AS cls FROM conf)
WHERE confidence >= 0.8 AND cls IS NOT NULL""")
def q_classify_columns(spark, sf):
    return TY.classify_columns(T.table(spark, sf, "orders"), 0.8)


@register("detect_timeseries_columns", _with(sql_prof("orders", ORDERS_KINDS)) + """
SELECT col AS "column", regexp_matches(col, '(?i)(date|time|year|month|day|tanggal|waktu|tahun|bulan|hari)') AS name_match,
       is_dt AS parses_as_datetime
FROM prof WHERE regexp_matches(col, '(?i)(date|time|year|month|day|tanggal|waktu|tahun|bulan|hari)') OR is_dt
   OR detected_type = 'numeric'""")
def q_detect_timeseries_columns(spark, sf):
    return TY.detect_timeseries_columns(T.table(spark, sf, "orders"))


# ------------------------------------------------------------------ scalar functions

@register("date_features", """
SELECT o_orderkey, o_orderdate, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day,
  isodow(o_orderdate) - 1 AS dayofweek, quarter(o_orderdate) AS quarter,
  CAST(day(o_orderdate) = 1 AS INTEGER) AS is_month_start,
  CAST(CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS INTEGER) AS is_month_end
FROM orders""")
def q_date_features(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return S.date_features(o, "o_orderdate")


@register("future_dates", _with(T.SQL_DAILY_EVENTS) + """
SELECT event_type, CAST(last + INTERVAL (i) DAY AS DATE) AS ds
FROM (SELECT event_type, MAX(ds) AS last FROM daily_events GROUP BY 1), range(1, 11) t(i)""")
def q_future_dates(spark, sf):
    return S.future_dates(T.daily_events(spark, sf), "ds", periods=10, freq="D", partition_cols=("event_type",))


@register("json_metadata", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_metadata(spark, sf):
    ev = T.table(spark, sf, "events")
    return ev.select("event_id", S.json_field("props", "k").alias("k"))


def _error_sql(text: str) -> str:
    parts = []
    for cls, words in S.ERROR_KEYWORDS:
        cond = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{cls}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown_error' END"


@register("classify_error_text", f"SELECT doc_id, {_error_sql('text')} AS error_type FROM documents")
def q_classify_error_text(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", S.classify_error_text("text").alias("error_type"))


def _log_lines(spark, sf):
    ev = T.table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = S.format_log_line(F.col("ts"), F.concat(F.lit("strata."), F.col("event_type")), level,
                             F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" value "),
                                      F.col("value").cast("string")))
    return ev.select("event_id", line.alias("value"))


@register("scan_error_log", """
SELECT event_id, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, 'strata.' || event_type AS logger,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'user ' || CAST(user_id AS VARCHAR) || ' value ' || CAST(value AS VARCHAR) AS message FROM events""")
def q_scan_error_log(spark, sf):
    lines = _log_lines(spark, sf)
    parsed = S.parse_log_lines(lines, "value", keep=("event_id",))
    return parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("param_range_check", """
SELECT event_id, valid, value, error FROM (
  SELECT event_id, v AS value, e IS NULL AS valid, e AS error FROM (
    SELECT event_id, v, CASE WHEN v IS NULL THEN 'Parameter ''k'' must be of type int'
                             WHEN v < 10 THEN 'Parameter ''k'' must be >= 10'
                             WHEN v > 90 THEN 'Parameter ''k'' must be <= 90' END AS e
    FROM (SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN event_type
                                         ELSE json_extract_string(props, '$.k') END AS INTEGER) AS v FROM events)))""")
def q_param_range_check(spark, sf):
    ev = T.table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    chk = S.param_range_check(raw, "k", "int", 10, 90)
    return ev.select("event_id", chk.alias("r")).select("event_id", "r.valid", "r.value", "r.error")


# ------------------------------------------------------------------ projections / filters

LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SEEDED_SAMPLE_SQL = (f"SELECT * FROM lineitem ORDER BY {seeded_hash_sql(LI_KEYS)}, "
                     "l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000")


@register("select_by_type", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
          "l_discount, l_tax FROM lineitem")
def q_select_by_type(spark, sf):
    return RL.select_by_type(T.table(spark, sf, "lineitem"), "numeric")


@register("drop_high_null_columns", _with(T.SQL_LINEITEM_NULLS) +
          "SELECT * EXCLUDE (l_quantity) FROM lineitem_nulls")
def q_drop_high_null_columns(spark, sf):
    return RL.drop_high_null_columns(T.lineitem_nulls(spark, sf), max_missing_ratio=0.1)


@register("drop_null_rows", _with(T.SQL_LINEITEM_NULLS) +
          "SELECT * FROM lineitem_nulls WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL")
def q_drop_null_rows(spark, sf):
    return RL.drop_null_rows(T.lineitem_nulls(spark, sf), ["l_quantity", "l_tax"])


@register("filter_by_mask", f"SELECT * FROM ({SQL_FLAGSHIP}) WHERE is_anomaly")
def q_filter_by_mask(spark, sf):
    return RL.filter_by_mask(flagship(spark, sf), "is_anomaly")


@register("lookup_by_key", "SELECT * FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def q_lookup_by_key(spark, sf):
    keys = T.table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return RL.lookup_by_key(T.table(spark, sf, "customer"), keys, "c_custkey")


@register("keys_available", """
SELECT DISTINCT c_custkey FROM (SELECT c_custkey FROM customer UNION ALL SELECT user_id + 1000 FROM events)
WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def q_keys_available(spark, sf):
    cust = T.table(spark, sf, "customer").select("c_custkey")
    ev = T.table(spark, sf, "events")
    req = cust.unionByName(ev.select((F.col("user_id") + 1000).alias("c_custkey"))).distinct()
    return RL.keys_available(req, ev.select(F.col("user_id").alias("c_custkey")), "c_custkey")


@register("filter_unexpired", _with(T.SQL_ACTIVITY_LOG) + """
SELECT * FROM activity_log WHERE created_at + INTERVAL 24 HOUR > TIMESTAMP '2024-01-15 00:00:00'""")
def q_filter_unexpired(spark, sf):
    return RL.filter_unexpired(T.activity_log(spark, sf), "created_at", "2024-01-15 00:00:00")


@register("seeded_sample", SEEDED_SAMPLE_SQL)
def q_seeded_sample(spark, sf):
    return RL.seeded_sample(T.table(spark, sf, "lineitem"), 1000,
                            ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], seed=42)


def _inf_input(spark, sf):
    li = T.table(spark, sf, "lineitem")
    r = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") * F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", r.alias("ratio"))


@register("inf_to_median", """
WITH r AS (SELECT l_orderkey, l_linenumber,
             CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice * l_tax END AS ratio FROM lineitem)
SELECT l_orderkey, l_linenumber, round(COALESCE(ratio, (SELECT quantile_cont(ratio, 0.5) FROM r)), 4) AS ratio FROM r""")
def q_inf_to_median(spark, sf):
    return rnd(RL.inf_to_median(_inf_input(spark, sf), ["ratio"]))


@register("project_prediction_inputs", _with(T.SQL_DAILY_EVENTS) + """
SELECT event_type, ds, value FROM (
  SELECT event_type, ds, value, row_number() OVER (PARTITION BY event_type ORDER BY ds) AS rn,
         COUNT(*) OVER (PARTITION BY event_type) AS n FROM daily_events) WHERE rn = least(1000, n - 1) + 1""")
def q_project_prediction_inputs(spark, sf):
    return RL.project_prediction_inputs(T.daily_events(spark, sf), ["value"], "ds", 1000,
                                        partition_cols=("event_type",))


# ------------------------------------------------------------------ joins

@register("join_value_counts", """
SELECT l_orderkey, l_linenumber, l_suppkey, COUNT(*) OVER (PARTITION BY l_suppkey) AS l_suppkey_freq FROM lineitem""")
def q_join_value_counts(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return RL.join_value_counts(li, "l_suppkey")


@register("join_on_index", _with(T.SQL_DAILY_SALES) + """
SELECT d.ds, d.sales, o.n_orders FROM daily_sales d
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS ds, COUNT(*) AS n_orders FROM orders GROUP BY 1) o USING (ds)""")
def q_join_on_index(spark, sf):
    o = (T.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ds"))
         .agg(F.count(F.lit(1)).alias("n_orders")))
    return RL.join_on_index(T.daily_sales(spark, sf), o, "ds")


@register("semi_join_missing", _with(T.SQL_LINEITEM_NULLS) +
          "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem_nulls WHERE l_quantity IS NULL")
def q_semi_join_missing(spark, sf):
    miss, _ = RL.split_missing(T.lineitem_nulls(spark, sf), "l_quantity")
    return miss.select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("foreign_key_check", """
SELECT 'orders.o_custkey' AS relation, COUNT(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL
SELECT 'lineitem.l_orderkey', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL
SELECT 'lineitem.l_partkey', COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def q_foreign_key_check(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    parts = [("orders.o_custkey", RL.foreign_key_orphans(t("orders"), t("customer"), "o_custkey", "c_custkey")),
             ("lineitem.l_orderkey", RL.foreign_key_orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey")),
             ("lineitem.l_partkey", RL.foreign_key_orphans(t("lineitem"), t("part"), "l_partkey", "p_partkey"))]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ set operations

@register("union_long", """
SELECT l_orderkey, l_linenumber, feature, value FROM lineitem
UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount))""")
def q_union_long(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return RL.union_long(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"])


_NULL_COLS_SQL = _with(T.SQL_LINEITEM_NULLS) + """,
nulls AS (SELECT "column" FROM (
  SELECT 'l_quantity' AS "column", COUNT(*) - COUNT(l_quantity) AS m FROM lineitem_nulls UNION ALL
  SELECT 'l_tax', COUNT(*) - COUNT(l_tax) FROM lineitem_nulls UNION ALL
  SELECT 'l_returnflag', COUNT(*) - COUNT(l_returnflag) FROM lineitem_nulls UNION ALL
  SELECT 'l_extendedprice', COUNT(*) - COUNT(l_extendedprice) FROM lineitem_nulls) WHERE m > 0),
numeric AS (SELECT * FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t("column"))
"""


def _null_and_numeric(spark, sf):
    ln = T.lineitem_nulls(spark, sf).select("l_quantity", "l_tax", "l_returnflag", "l_extendedprice")
    nulls = P.missing_summary(ln).select("column")
    num_cols = RL.select_by_type(T.table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"), "numeric").columns
    return nulls, RL.columns_frame(spark, num_cols)


@register("intersect_columns", _NULL_COLS_SQL + 'SELECT "column" FROM numeric INTERSECT SELECT "column" FROM nulls')
def q_intersect_columns(spark, sf):
    nulls, num = _null_and_numeric(spark, sf)
    return RL.intersect_columns(num, nulls)


@register("except_columns", _NULL_COLS_SQL + 'SELECT "column" FROM numeric EXCEPT ALL SELECT "column" FROM nulls')
def q_except_columns(spark, sf):
    nulls, num = _null_and_numeric(spark, sf)
    return RL.except_columns(num, nulls)


@register("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def q_distinct_rows(spark, sf):
    return RL.distinct_rows(T.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


# ------------------------------------------------------------------ sorts

@register("sort_by_time", "SELECT o_orderkey, o_orderdate FROM orders")
def q_sort_by_time(spark, sf):
    return RL.sort_by_time(T.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@register("top_features", """
SELECT l_partkey, round(SUM(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1
ORDER BY revenue DESC, l_partkey LIMIT 10""")
def q_top_features(spark, sf):
    rev = (T.table(spark, sf, "lineitem").groupBy("l_partkey")
           .agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")))
    return RL.top_k(rev, "revenue", 10, "l_partkey")


@register("sort_by_abs", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice - (SELECT AVG(l_extendedprice) FROM lineitem), 4) AS contribution
FROM lineitem""")
def q_sort_by_abs(spark, sf):
    li = T.table(spark, sf, "lineitem")
    mu = li.agg(F.avg("l_extendedprice")).first()[0]
    c = li.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - F.lit(mu), 4).alias("contribution"))
    return RL.sort_by_abs(c, "contribution", "l_orderkey")


@register("head_non_null", _with(T.SQL_LINEITEM_NULLS) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem_nulls WHERE l_quantity IS NOT NULL
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""")
def q_head_non_null(spark, sf):
    return RL.head_non_null(T.lineitem_nulls(spark, sf), "l_quantity",
                            ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 10)


@register("top_one_class", """
SELECT l_returnflag, round(total, 2) AS total FROM (
  SELECT l_returnflag, SUM(abs(l_extendedprice)) AS total FROM lineitem GROUP BY 1) ORDER BY total DESC, l_returnflag LIMIT 1""")
def q_top_one_class(spark, sf):
    r = RL.top_one_class(T.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return r.select("l_returnflag", F.round("total", 2).alias("total"))


@register("type_recommendations", _with(sql_prof("orders", ORDERS_KINDS)) + """
SELECT col AS "column",
  list_filter([CASE WHEN np > 0.5 THEN 'drop_high_missing' END, CASE WHEN pc THEN 'treat_as_categorical' END,
               CASE WHEN ur > 0.9 THEN 'id_column' END, CASE WHEN uc <= 2 AND COALESCE(fr, 0) > 0.9 THEN 'binary' END,
               CASE WHEN detected_type = 'object' THEN CASE WHEN is_dt THEN 'convert_datetime'
                    WHEN NOT COALESCE(hs, false) AND COALESCE(al, 0) < 20 THEN 'categorical_encoding' END END],
              lambda x: x IS NOT NULL) AS recommendations FROM conf""")
def q_type_recommendations(spark, sf):
    return TY.detect_column_types(T.table(spark, sf, "orders")).select("column", "recommendations")


@register("is_datetime_column", _with(sql_prof("orders", ORDERS_KINDS)) + """
SELECT col AS "column", is_dt AS is_datetime FROM prof""")
def q_is_datetime_column(spark, sf):
    return TY.detect_column_types(T.table(spark, sf, "orders")).select("column", "is_datetime")
