"""Registered window queries (W1-W16, T9) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import windows as W
from strata.plans.flagship import SQL_FLAGSHIP, flagship
from strata.plans.registry import register
from strata.sources import tables as T

R4 = 4


def rnd(df: DataFrame, digits: int = R4) -> DataFrame:
    """Round every double column (both engines sum in different orders)."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


register("flagship_anomaly_features", SQL_FLAGSHIP)(flagship)

LAGS = (1, 2, 3, 7, 14)


@register("lag_features", _with(T.SQL_DAILY_EVENTS) + """,
lg AS (SELECT ds, event_type, value, """ + ", ".join(
    f"lag(value, {k}) OVER (PARTITION BY event_type ORDER BY ds) AS l{k}" for k in LAGS) + """ FROM daily_events)
SELECT ds, event_type, value, """ + ", ".join(
    f"round(last_value(l{k} IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING "
    f"AND CURRENT ROW), 4) AS value_lag_{k}" for k in LAGS) + " FROM lg")
def q_lag_features(spark, sf):
    de = T.daily_events(spark, sf)
    return rnd(W.lag_features(de, "value", "ds", lags=LAGS, fill_method="ffill", partition_cols=("event_type",)))


@register("lag_features_mean_fill", _with(T.SQL_DAILY_EVENTS) + """,
lg AS (SELECT ds, event_type, value, """ + ", ".join(
    f"lag(value, {k}) OVER (PARTITION BY event_type ORDER BY ds) AS l{k}" for k in (1, 7)) + """ FROM daily_events)
SELECT ds, event_type, value, """ + ", ".join(
    f"round(COALESCE(l{k}, AVG(l{k}) OVER (PARTITION BY event_type)), 4) AS value_lag_{k}" for k in (1, 7)) + " FROM lg")
def q_lag_features_mean(spark, sf):
    de = T.daily_events(spark, sf)
    return rnd(W.lag_features(de, "value", "ds", lags=(1, 7), fill_method="mean", partition_cols=("event_type",)))


ROLL = (7, 14, 30)


def _roll_sql():
    sel = []
    for w in ROLL:
        fr = f"(ORDER BY ds ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for stat, fn in (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX")):
            sel.append(f"CASE WHEN COUNT(cents) OVER {fr} >= 1 THEN {fn}(cents) OVER {fr} END AS r_{stat}_{w}")
    inner = ("SELECT ds, cents, " + ", ".join(sel) +
             " FROM (SELECT ds, CAST(round(sales * 100) AS BIGINT) AS cents FROM daily_sales)")
    outer = ", ".join(
        (f"round(last_value(r_{stat}_{w} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND "
         f"CURRENT ROW), 4)" if stat == "std" else
         f"last_value(r_{stat}_{w} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        + f" AS cents_rolling_{stat}_{w}" for w in ROLL for stat in ("mean", "std", "min", "max"))
    return _with(T.SQL_DAILY_SALES) + f"SELECT ds, cents, {outer} FROM ({inner})"


@register("rolling_features", _roll_sql())
def q_rolling_features(spark, sf):
    # integer cents: means of exact integer sums are one correctly rounded division, so they
    # are bit-identical in any engine and need no rounding; only the deviations are rounded
    ds = T.daily_sales(spark, sf).select("ds", F.round(F.col("sales") * 100).cast("bigint").alias("cents"))
    out = W.rolling_features(ds, "cents", "ds", windows=ROLL)
    return out.select(*[F.round(c, R4).alias(c) if "_std_" in c else F.col(c) for c in out.columns])


@register("rolling_mean_std_diff", _with(T.SQL_DAILY_EVENTS) + """
SELECT ds, event_type, value,
  round(CASE WHEN COUNT(value) OVER f >= 5 THEN AVG(value) OVER f END, 4) AS rolling_mean,
  round(CASE WHEN COUNT(value) OVER f >= 5 THEN STDDEV_SAMP(value) OVER f END, 4) AS rolling_std,
  round(value - lag(value) OVER w, 4) AS diff
FROM daily_events
WINDOW w AS (PARTITION BY event_type ORDER BY ds), f AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean_std_diff(spark, sf):
    return rnd(W.rolling_mean_std_diff(T.daily_events(spark, sf), "value", "ds", 5, partition_cols=("event_type",)))


GAPS = _with(T.SQL_DAILY_SALES_GAPS)
A_ = "(ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
B_ = "(ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("forward_fill", GAPS + f"SELECT ds, round(last_value(sales IGNORE NULLS) OVER {A_}, 4) AS sales FROM daily_sales_gaps")
def q_forward_fill(spark, sf):
    g = T.daily_sales_gaps(spark, sf)
    return rnd(W.fill_series(g, "sales", "ds", "ffill"))


@register("backward_fill", GAPS + f"SELECT ds, round(first_value(sales IGNORE NULLS) OVER {B_}, 4) AS sales FROM daily_sales_gaps")
def q_backward_fill(spark, sf):
    g = T.daily_sales_gaps(spark, sf)
    return rnd(W.fill_series(g, "sales", "ds", "bfill"))


def _interp_sql(x: str, then_fill: bool) -> str:
    body = f"""
k AS (SELECT ds, sales, {x} AS x,
        last_value(CASE WHEN sales IS NOT NULL THEN {x} END IGNORE NULLS) OVER {A_} AS px,
        last_value(sales IGNORE NULLS) OVER {A_} AS py,
        first_value(CASE WHEN sales IS NOT NULL THEN {x} END IGNORE NULLS) OVER {B_} AS nx,
        first_value(sales IGNORE NULLS) OVER {B_} AS ny
      FROM (SELECT *, row_number() OVER (ORDER BY ds) AS pos FROM daily_sales_gaps)),
i AS (SELECT ds, CASE WHEN sales IS NOT NULL THEN sales
                      WHEN py IS NOT NULL AND ny IS NOT NULL THEN
                        CASE WHEN nx = px THEN py ELSE py + (ny - py) * ((x - px) / (nx - px)) END
                      WHEN py IS NOT NULL THEN py END AS v FROM k)
"""
    if then_fill:
        sel = f"SELECT ds, round(COALESCE(last_value(v IGNORE NULLS) OVER {A_}, first_value(v IGNORE NULLS) OVER {B_}), 4) AS sales FROM i"
    else:
        sel = "SELECT ds, round(v, 4) AS sales FROM i"
    return GAPS.rstrip("\n") + "," + body + sel


@register("interpolate_linear", _interp_sql("CAST(pos AS DOUBLE)", False))
def q_interpolate_linear(spark, sf):
    return rnd(W.interpolate_linear(T.daily_sales_gaps(spark, sf), "sales", "ds"))


@register("interpolate_time", _interp_sql("CAST(epoch_us(CAST(ds AS TIMESTAMP)) AS DOUBLE)", True))
def q_interpolate_time(spark, sf):
    return rnd(W.interpolate_time(T.daily_sales_gaps(spark, sf), "sales", "ds"))


@register("fill_series_median", GAPS + "SELECT ds, round(COALESCE(sales, quantile_cont(sales, 0.5) OVER ()), 4) AS sales FROM daily_sales_gaps")
def q_fill_series_median(spark, sf):
    return rnd(W.fill_series(T.daily_sales_gaps(spark, sf), "sales", "ds", "median"))


@register("fill_series_drop", GAPS + "SELECT ds, sales FROM daily_sales_gaps WHERE sales IS NOT NULL")
def q_fill_series_drop(spark, sf):
    return W.fill_series(T.daily_sales_gaps(spark, sf), "sales", "ds", "drop")


@register("pct_change_yoy", _with(T.SQL_DAILY_SALES) + """
SELECT ds, sales, round(yoy, 4) AS yoy_pct FROM (
  SELECT ds, sales, CASE WHEN COUNT(*) OVER () >= 365 THEN (sales / lag(sales, 365) OVER (ORDER BY ds) - 1) * 100 END AS yoy
  FROM daily_sales) WHERE yoy IS NOT NULL""")
def q_pct_change_yoy(spark, sf):
    return rnd(W.pct_change_yoy(T.daily_sales(spark, sf), "sales", "ds"))


@register("moving_averages", _with(T.SQL_DAILY_EVENTS) + """
SELECT ds, event_type, value,
  round(CASE WHEN ws >= 2 AND rn >= ws THEN s7 END, 4) AS ma_short,
  round(CASE WHEN ws >= 2 AND wl > ws AND rn >= wl THEN s15 END, 4) AS ma_long,
  CAST(ws AS INTEGER) AS short_window, CAST(wl AS INTEGER) AS long_window
FROM (SELECT *, least(7, n // 4) AS ws, least(30, n // 2) AS wl,
        AVG(value) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s7,
        AVG(value) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS s15
      FROM (SELECT *, COUNT(*) OVER (PARTITION BY event_type) AS n,
                   row_number() OVER (PARTITION BY event_type ORDER BY ds) AS rn FROM daily_events))""")
def q_moving_averages(spark, sf):
    return rnd(W.moving_averages(T.daily_events(spark, sf), "value", "ds", partition_cols=("event_type",)))


@register("rolling_zscore", _with(T.SQL_SPIKED_SERIES) + f""",
m AS (SELECT ds, sales,
        CASE WHEN COUNT(sales) OVER f >= 11 THEN AVG(sales) OVER f END AS m,
        CASE WHEN COUNT(sales) OVER f >= 11 THEN STDDEV_SAMP(sales) OVER f END AS s
      FROM spiked_series WINDOW f AS (ORDER BY ds ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
z AS (SELECT ds, sales,
        COALESCE(last_value(m IGNORE NULLS) OVER {A_}, first_value(m IGNORE NULLS) OVER {B_}) AS rolling_mean,
        COALESCE(last_value(s IGNORE NULLS) OVER {A_}, first_value(s IGNORE NULLS) OVER {B_}) AS rolling_std FROM m)
SELECT ds, round(sales, 4) AS sales, round(rolling_mean, 4) AS rolling_mean, round(rolling_std, 4) AS rolling_std,
  round(zz, 4) AS z_score, zz > 3 AS is_anomaly
FROM (SELECT *, COALESCE(CASE WHEN rolling_std <> 0 THEN abs(sales - rolling_mean) / rolling_std END, 0.0) AS zz FROM z)""")
def q_rolling_zscore(spark, sf):
    return rnd(W.rolling_zscore(T.spiked_series(spark, sf), "sales", "ds", window_size=11, threshold=3.0))


@register("lookback_sequences", _with(T.SQL_DAILY_EVENTS) + """
SELECT ds, event_type, value, seq AS sequence,
  CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ds) <= floor(COUNT(*) OVER (PARTITION BY event_type) * 0.8)
       THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, list(value) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS seq
      FROM daily_events) WHERE len(seq) = 7""")
def q_lookback_sequences(spark, sf):
    return W.lookback_sequences(T.daily_events(spark, sf), "value", "ds", look_back=7, partition_cols=("event_type",))


@register("sliding_windows", _with(T.SQL_DAILY_EVENTS) + """
SELECT ds, event_type, value, w AS "window" FROM (
  SELECT *, list(value) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS w
  FROM daily_events) WHERE len(w) = 10""")
def q_sliding_windows(spark, sf):
    return W.sliding_windows(T.daily_events(spark, sf), "value", "ds", 10, partition_cols=("event_type",))


@register("keep_first_per_key", _with(T.SQL_DUP_EMAILS) + """
SELECT id, username, CASE WHEN row_number() OVER (PARTITION BY email ORDER BY id) = 1 THEN email END AS email
FROM dup_emails""")
def q_keep_first_per_key(spark, sf):
    return W.keep_first_per_key_agg(T.dup_emails(spark, sf), "email", "id")


@register("latest_per_key", _with(T.SQL_ACTIVITY_LOG) + """
SELECT username, id, action, metadata, created_at FROM activity_log
QUALIFY row_number() OVER (PARTITION BY username ORDER BY created_at DESC, id DESC) = 1""")
def q_latest_per_key(spark, sf):
    return W.latest_per_key(T.activity_log(spark, sf), "username", "created_at", tiebreak="id")


@register("chronological_split", _with(T.SQL_DAILY_SALES) + """
SELECT ds, sales, CASE WHEN row_number() OVER (ORDER BY ds) <= floor(COUNT(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
FROM daily_sales""")
def q_chronological_split(spark, sf):
    return W.chronological_split(T.daily_sales(spark, sf), "ds")


@register("centered_moving_average", _with(T.SQL_DAILY_SALES) + """
SELECT ds, cents, round(CASE WHEN COUNT(cents) OVER f = 13
   THEN (SUM(cents) OVER f - (lag(cents, 6) OVER w + lead(cents, 6) OVER w) / 2) / 12 END, 4) AS trend
FROM (SELECT ds, CAST(round(sales * 100) AS BIGINT) AS cents FROM daily_sales)
WINDOW w AS (ORDER BY ds), f AS (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)""")
def q_centered_moving_average(spark, sf):
    # integer cents keep the frame sums exact in any summation order
    ds = T.daily_sales(spark, sf).select("ds", F.round(F.col("sales") * 100).cast("bigint").alias("cents"))
    return rnd(W.centered_moving_average(ds, "cents", "ds", 12))


register("fill_series", _interp_sql("CAST(epoch_us(CAST(ds AS TIMESTAMP)) AS DOUBLE)", True))(
    lambda spark, sf: rnd(W.fill_series(T.daily_sales_gaps(spark, sf), "sales", "ds", "auto")))


@register("rolling_features_long_series", """
SELECT event_id, ts, value, """ + ", ".join(
    f"round({fn}(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS value_rolling_{st}_5"
    for st, fn in (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"))) + """ FROM events""")
def q_rolling_features_long_series(spark, sf):
    """W2 on the raw event stream as one long series (no resampling, no partition key):
    range partitions + halo rows, never a one-task window."""
    ev = T.table(spark, sf, "events").select("event_id", "ts", "value")
    out = W.rolling_features(ev, "value", ["ts", "event_id"], windows=(5,), fill_method="none", distributed=True)
    return rnd(out, 4)


@register("lag_features_long_series", """
SELECT event_id, ts, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 10) OVER w AS value_lag_10
FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def q_lag_features_long_series(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "ts", "value")
    return W.lag_features(ev, "value", ["ts", "event_id"], lags=(1, 10), fill_method="none", distributed=True)


@register("chronological_split_long_series", """
SELECT event_id, ts, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(COUNT(*) OVER () * 0.8)
  THEN 'train' ELSE 'test' END AS split FROM events""")
def q_chronological_split_long_series(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "ts")
    return W.chronological_split(ev, ["ts", "event_id"], 0.8, distributed=True)


def _events_gaps(spark, sf):
    """events with deterministic value gaps (value null when event_id % 13 = 0)."""
    ev = T.table(spark, sf, "events").select("event_id", "ts", "value")
    return ev.withColumn("value", F.when(F.col("event_id") % 13 == 0, None).otherwise(F.col("value")))


LS_A = "(ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LS_B = "(ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("interpolate_time_long_series", f"""
WITH g AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events),
k AS (SELECT event_id, ts, value, CAST(epoch_us(ts) AS DOUBLE) AS x,
        last_value(CASE WHEN value IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END IGNORE NULLS) OVER {LS_A} AS px,
        last_value(value IGNORE NULLS) OVER {LS_A} AS py,
        first_value(CASE WHEN value IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END IGNORE NULLS) OVER {LS_B} AS nx,
        first_value(value IGNORE NULLS) OVER {LS_B} AS ny FROM g)
SELECT event_id, ts, round(CASE WHEN value IS NOT NULL THEN value
  WHEN py IS NOT NULL AND ny IS NOT NULL THEN CASE WHEN nx = px THEN py ELSE py + (ny - py) * ((x - px) / (nx - px)) END
  WHEN py IS NOT NULL THEN py ELSE ny END, 4) AS value FROM k""")
def q_interpolate_time_long_series(spark, sf):
    """W6 on the raw event stream as one long series: range partitions with carries."""
    out = W.interpolate_time(_events_gaps(spark, sf), "value", ["ts", "event_id"], distributed=True, time_col="ts")
    return rnd(out, 4)
