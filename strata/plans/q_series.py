"""Registered time-series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators import series as SE
from strata.operators import windows as W
from strata.plans.q_windows import rnd
from strata.plans.registry import register
from strata.sources import tables as T


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@register("resample_mean_weekly", """
WITH e AS (SELECT event_type, ts, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events),
b AS (SELECT event_type, CAST(ts AS DATE) + CAST(7 - isodow(ts) AS INTEGER) AS bucket, AVG(value_cents) AS value_cents
      FROM e GROUP BY 1, 2),
cal AS (SELECT event_type, CAST(UNNEST(generate_series(MIN(bucket)::TIMESTAMP, MAX(bucket)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS bucket
        FROM b GROUP BY 1)
SELECT cal.event_type, cal.bucket, b.value_cents FROM cal LEFT JOIN b USING (event_type, bucket)""")
def q_resample_mean_weekly(spark, sf):
    # integer cents make each weekly mean one exact division (bit-identical across engines)
    ev = T.table(spark, sf, "events").select("event_type", "ts",
                                             F.round(F.col("value") * 100).cast("bigint").alias("value_cents"))
    return SE.resample_mean(ev, "ts", "value_cents", "W", ("event_type",))


@register("resample_mean_monthly", """
WITH b AS (SELECT last_day(l_shipdate) AS bucket, AVG(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price_cents
           FROM lineitem GROUP BY 1),
cal AS (SELECT last_day(CAST(UNNEST(generate_series(date_trunc('month', MIN(bucket))::TIMESTAMP,
                                                    date_trunc('month', MAX(bucket))::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE)) AS bucket FROM b)
SELECT cal.bucket, b.price_cents FROM cal LEFT JOIN b USING (bucket)""")
def q_resample_mean_monthly(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"))
    return SE.resample_mean(li, "l_shipdate", "price_cents", "M")


@register("prepare_series", """
WITH b AS (SELECT CAST(o_orderdate AS DATE) AS o_orderdate, AVG(o_totalprice) AS v FROM orders GROUP BY 1),
cal AS (SELECT CAST(UNNEST(generate_series(MIN(o_orderdate)::TIMESTAMP, MAX(o_orderdate)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS o_orderdate FROM b)
SELECT cal.o_orderdate, round(b.v, 6) AS o_totalprice FROM cal LEFT JOIN b USING (o_orderdate)""")
def q_prepare_series(spark, sf):
    o = T.table(spark, sf, "orders")
    return rnd(SE.prepare_series(o, "o_orderdate", "o_totalprice", freq="D"), 6)


DECOMP_SQL = _with(T.SQL_DAILY_SALES) + """,
s AS (SELECT ds, CAST(round(sales * 100) AS BIGINT) AS sales, row_number() OVER (ORDER BY ds) - 1 AS pos
      FROM daily_sales WHERE sales IS NOT NULL),
t AS (SELECT *, CASE WHEN COUNT(sales) OVER f = 13
        THEN (SUM(sales) OVER f - (lag(sales, 6) OVER w + lead(sales, 6) OVER w) / 2) / 12 END AS trend,
        pos % 12 AS phase
      FROM s WINDOW w AS (ORDER BY ds), f AS (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
ph AS (SELECT phase, AVG(sales - trend) AS pm FROM t GROUP BY 1),
ph2 AS (SELECT phase, pm - AVG(pm) OVER () AS seasonal FROM ph),
d AS (SELECT t.ds, t.pos, t.sales, 12 AS period, t.trend, ph2.seasonal, t.sales - t.trend - ph2.seasonal AS resid
      FROM t JOIN ph2 USING (phase))
"""


@register("decompose_additive", DECOMP_SQL + """
SELECT ds, pos, sales, period, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(resid, 4) AS resid FROM d""")
def q_decompose_additive(spark, sf):
    d = SE.decompose_additive(_cents(spark, sf), "ds", "sales")
    return rnd(d.withColumn("period", F.col("period").cast("int")), 4)


def _cents(spark, sf):
    """daily_sales in integer cents: frame sums are exact in any order."""
    return T.daily_sales(spark, sf).select("ds", F.round(F.col("sales") * 100).cast("bigint").alias("sales"))


@register("trend_seasonality_strength", DECOMP_SQL + """
SELECT COUNT(*) AS n, round(var_pop(trend) / var_pop(sales), 6) AS trend_strength,
  round(var_pop(seasonal) / var_pop(sales), 6) AS seasonality_strength,
  round(var_pop(resid) / var_pop(sales), 6) AS residual_strength,
  round(regr_slope(sales, pos), 6) AS slope,
  abs(regr_slope(sales, pos)) > 0.01 * stddev_pop(sales) AS trend_detected,
  var_pop(seasonal) / var_pop(sales) > 0.1 AS seasonality_detected FROM d""")
def q_trend_seasonality_strength(spark, sf):
    return rnd(SE.trend_seasonality_strength(_cents(spark, sf), "ds", "sales"), 6)


@register("trend_line", _with(T.SQL_DAILY_EVENTS) + """
SELECT event_type, ds, pos, value, round(regr_slope(value, pos) OVER p, 6) AS slope,
  round(regr_intercept(value, pos) OVER p, 6) AS intercept,
  round(regr_intercept(value, pos) OVER p + regr_slope(value, pos) OVER p * pos, 6) AS fitted
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ds) - 1 AS pos FROM daily_events)
WINDOW p AS (PARTITION BY event_type)""")
def q_trend_line(spark, sf):
    return rnd(SE.trend_line(T.daily_events(spark, sf), "ds", "value", ("event_type",)), 6)


ACF_CTES = """,
d AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ds) AS rn,
             value - AVG(value) OVER (PARTITION BY event_type) AS d,
             COUNT(*) OVER (PARTITION BY event_type) AS n FROM daily_events),
k AS (SELECT UNNEST(range(0, 41)) AS lag),
c AS (SELECT d.event_type, k.lag, SUM(d.d * l.d) AS ck FROM d
      JOIN (SELECT event_type, rn, d FROM d) l ON l.event_type = d.event_type
      JOIN k ON l.rn = d.rn - k.lag GROUP BY 1, 2),
acf AS (SELECT c.event_type, CAST(c.lag AS INTEGER) AS lag, c.ck / c0.ck AS acf
FROM c JOIN c AS c0 ON c0.event_type = c.event_type AND c0.lag = 0
JOIN (SELECT DISTINCT event_type, n FROM d) nn ON nn.event_type = c.event_type
WHERE c.lag <= least(floor(10 * log10(nn.n)), nn.n - 1))
"""


@register("acf", _with(T.SQL_DAILY_EVENTS) + ACF_CTES + "SELECT event_type, lag, round(acf, 6) AS acf FROM acf")
def q_acf(spark, sf):
    a = SE.acf(T.daily_events(spark, sf), "ds", "value", partition_cols=("event_type",))
    return rnd(a, 6)


@register("pacf", _with(T.SQL_DAILY_EVENTS).replace("WITH", "WITH RECURSIVE", 1) + ACF_CTES + """,
r AS (SELECT event_type, list(acf ORDER BY lag) AS r FROM acf GROUP BY event_type),
dl AS (
  SELECT event_type, r, 1 AS k, [r[2]] AS phi, 1 - r[2] * r[2] AS v, r[2] AS pk FROM r
  UNION ALL
  SELECT event_type, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - np * phi[k + 1 - j]), [np]), v * (1 - np * np), np
  FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j]))) / v AS np FROM dl) WHERE k + 2 <= len(r))
SELECT event_type, CAST(0 AS INTEGER) AS lag, 1.0 AS pacf FROM r
UNION ALL SELECT event_type, CAST(k AS INTEGER), round(pk, 6) FROM dl""")
def q_pacf(spark, sf):
    return rnd(SE.pacf(T.daily_events(spark, sf), "ds", "value", partition_cols=("event_type",)), 6)


@register("dominant_cycle", _with(T.SQL_DAILY_EVENTS) + """,
s AS (SELECT event_type, value - AVG(value) OVER (PARTITION BY event_type) AS d,
             row_number() OVER (PARTITION BY event_type ORDER BY ds) - 1 AS t,
             COUNT(*) OVER (PARTITION BY event_type) AS n FROM daily_events),
f AS (SELECT s.event_type, s.n, k, SUM(s.d * cos(2 * pi() * k * s.t / s.n)) AS re, SUM(s.d * sin(2 * pi() * k * s.t / s.n)) AS im
      FROM s, range(0, 1000) r(k) WHERE k <= s.n // 2 GROUP BY 1, 2, 3),
p AS (SELECT event_type, n, k, (re * re + im * im) / n * CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END AS pw FROM f),
best AS (SELECT event_type, n, k, pw FROM p WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY pw DESC, k) = 1),
mp AS (SELECT event_type, AVG(CASE WHEN k = 0 THEN 0 ELSE pw END) AS mean_power FROM p GROUP BY 1)
SELECT best.event_type, best.n, CAST(greatest(2, least(12, best.n // 4)) AS INTEGER) AS period,
  round(best.n / best.k, 6) AS dominant_period, round(best.pw, 4) AS dominant_power, round(mp.mean_power, 4) AS mean_power,
  best.n / best.k > greatest(2, least(12, best.n // 4)) AND best.pw > 3 * mp.mean_power AS cycle_detected
FROM best JOIN mp USING (event_type)""")
def q_dominant_cycle(spark, sf):
    d = SE.dominant_cycle(T.daily_events(spark, sf), "ds", "value", partition_cols=("event_type",))
    return d.select("event_type", "n", "period", F.round("dominant_period", 6).alias("dominant_period"),
                    F.round("dominant_power", 4).alias("dominant_power"), F.round("mean_power", 4).alias("mean_power"),
                    "cycle_detected")


@register("adf_fixed_lag", _with(T.SQL_DAILY_EVENTS) + """,
s AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ds) AS l FROM daily_events WHERE value IS NOT NULL),
f AS (SELECT event_type, COUNT(*) AS n, regr_slope(value - l, l) AS b, regr_sxx(value - l, l) AS sxx, regr_syy(value - l, l) AS syy, regr_sxy(value - l, l) AS sxy
  FROM s WHERE l IS NOT NULL GROUP BY event_type)
SELECT event_type, n + 1 AS n, CAST(0 AS INTEGER) AS used_lag, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS adf_stat FROM f""")
def q_adf_fixed_lag(spark, sf):
    a = SE.adf_stationarity(T.daily_events(spark, sf), "ds", "value", partition_cols=("event_type",), maxlag=0)
    return a.select("event_type", "n", "used_lag", F.round("adf_stat", 6).alias("adf_stat"))


@register("adf_stationarity")
def q_adf_stationarity(spark, sf):
    return SE.adf_stationarity(T.daily_events(spark, sf), "ds", "value", partition_cols=("event_type",))


@register("monthly_profile", _with(T.SQL_DAILY_SALES) + """,
c AS (SELECT ds, CAST(round(sales * 100) AS BIGINT) AS cents FROM daily_sales),
m AS (SELECT month(ds) AS month, AVG(cents) AS mean, STDDEV_SAMP(cents) AS std FROM c WHERE cents IS NOT NULL GROUP BY 1)
SELECT CAST(r.month AS INTEGER) AS month, COALESCE(m.mean, 0) AS mean, round(COALESCE(m.std, 0), 4) AS std
FROM range(1, 13) r(month) LEFT JOIN m ON m.month = r.month""")
def q_monthly_profile(spark, sf):
    c = T.daily_sales(spark, sf).select("ds", F.round(F.col("sales") * 100).cast("bigint").alias("cents"))
    m = SE.monthly_profile(c, "ds", "cents")
    return m.select("month", "mean", F.round("std", 4).alias("std"))


@register("seasonal_subseries", _with(T.SQL_DAILY_SALES) + """
SELECT phase, COUNT(sales) AS count, round(MIN(sales), 2) AS min, round(quantile_cont(sales, 0.25), 2) AS q1,
  round(quantile_cont(sales, 0.5), 2) AS median, round(quantile_cont(sales, 0.75), 2) AS q3, round(MAX(sales), 2) AS max
FROM (SELECT sales, (row_number() OVER (ORDER BY ds) - 1) % 7 AS phase FROM daily_sales WHERE sales IS NOT NULL) GROUP BY 1""")
def q_seasonal_subseries(spark, sf):
    return rnd(SE.seasonal_subseries(T.daily_sales(spark, sf), "ds", "sales", 7), 2)


def _naive(spark, sf):
    ds = T.daily_sales(spark, sf)
    return ds.withColumn("predicted", F.lag("sales", 7).over(Window.orderBy("ds")))


NAIVE_SQL = _with(T.SQL_DAILY_SALES) + """,
nv AS (SELECT ds, sales, lag(sales, 7) OVER (ORDER BY ds) AS predicted FROM daily_sales),
c AS (SELECT * FROM nv WHERE sales IS NOT NULL AND predicted IS NOT NULL)
"""


@register("forecast_metrics", NAIVE_SQL + """
SELECT COUNT(*) AS n_samples, round(AVG(abs(predicted - sales)), 4) AS MAE, round(AVG((predicted - sales) ^ 2), 2) AS MSE,
  round(sqrt(AVG((predicted - sales) ^ 2)), 4) AS RMSE,
  round(AVG(CASE WHEN sales <> 0 THEN abs((predicted - sales) / sales) END) * 100, 6) AS MAPE,
  round(1 - SUM((predicted - sales) ^ 2) / (var_pop(sales) * COUNT(sales)), 6) AS R2 FROM c""")
def q_forecast_metrics(spark, sf):
    m = SE.forecast_metrics(_naive(spark, sf), "sales", "predicted")
    return m.select("n_samples", F.round("MAE", 4).alias("MAE"), F.round("MSE", 2).alias("MSE"),
                    F.round("RMSE", 4).alias("RMSE"), F.round("MAPE", 6).alias("MAPE"), F.round("R2", 6).alias("R2"))


@register("forecast_metrics_smape", NAIVE_SQL + """
SELECT COUNT(*) AS n_samples, round(AVG(abs(predicted - sales)), 4) AS MAE,
  round(AVG(2 * abs(predicted - sales) / (abs(sales) + abs(predicted))) * 100, 6) AS SMAPE FROM c""")
def q_forecast_metrics_smape(spark, sf):
    m = SE.forecast_metrics(_naive(spark, sf), "sales", "predicted", smape=True)
    return m.select("n_samples", F.round("MAE", 4).alias("MAE"), F.round("SMAPE", 6).alias("SMAPE"))


@register("anomaly_summary", _with(T.SQL_DAILY_EVENTS) + """,
m AS (SELECT *, CASE WHEN COUNT(value) OVER f >= 5 THEN AVG(value) OVER f END AS m,
        CASE WHEN COUNT(value) OVER f >= 5 THEN STDDEV_SAMP(value) OVER f END AS s FROM daily_events
      WINDOW f AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
z AS (SELECT event_type, value,
  COALESCE(last_value(m IGNORE NULLS) OVER a, first_value(m IGNORE NULLS) OVER b) AS mm,
  COALESCE(last_value(s IGNORE NULLS) OVER a, first_value(s IGNORE NULLS) OVER b) AS ss FROM m
  WINDOW a AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT event_type, COALESCE(CASE WHEN ss <> 0 THEN abs(value - mm) / ss END, 0) > 1.5 AS flag FROM z)
SELECT event_type, COUNT(*) AS total_points, COUNT(*) FILTER (WHERE flag) AS anomaly_count,
  round(COUNT(*) FILTER (WHERE flag) * 100.0 / COUNT(*), 6) AS anomaly_percentage FROM f GROUP BY 1""")
def q_anomaly_summary(spark, sf):
    z = W.rolling_zscore(T.daily_events(spark, sf), "value", "ds", 5, 1.5, partition_cols=("event_type",))
    s = SE.anomaly_summary(z, "is_anomaly", ("event_type",))
    return s.withColumn("anomaly_percentage", F.round("anomaly_percentage", 6))


@register("forecast_compare_frame", _with(T.SQL_DAILY_SALES) + """,
s AS (SELECT *, row_number() OVER (ORDER BY ds) AS rn, COUNT(*) OVER () AS n FROM daily_sales),
fc AS (SELECT CAST(MAX(ds) + INTERVAL (i) DAY AS DATE) AS ds,
         (SELECT AVG(sales) FROM (SELECT sales FROM daily_sales ORDER BY ds DESC LIMIT 7)) AS value
       FROM daily_sales, range(1, 11) r(i) GROUP BY i)
SELECT ds, round(sales, 2) AS value, 'train' AS kind FROM s WHERE rn <= floor(n * 0.8)
UNION ALL SELECT ds, round(sales, 2), 'test' FROM s WHERE rn > floor(n * 0.8)
UNION ALL SELECT ds, round(value, 2), 'forecast' FROM fc""")
def q_forecast_compare_frame(spark, sf):
    ds = W.chronological_split(T.daily_sales(spark, sf), "ds")
    train = ds.where(F.col("split") == "train")
    test = ds.where(F.col("split") == "test")
    fut = _fc(ds)
    return rnd(SE.forecast_compare_frame(train, test, fut, "ds", "sales"), 2)


def _fc(ds):
    """Mean of the last 7 points repeated over the next 10 days (a naive forecast)."""
    from strata.functions.scalar import future_dates
    val = ds.orderBy(F.desc("ds")).limit(7).agg(F.avg("sales")).first()[0]
    return future_dates(ds, "ds", 10, "D").select("ds", F.lit(val).alias("sales"))


@register("resample_mean", """
WITH b AS (SELECT date_trunc('hour', ts) AS bucket, AVG(value) AS value FROM events GROUP BY 1),
cal AS (SELECT UNNEST(generate_series(MIN(bucket), MAX(bucket), INTERVAL 1 HOUR)) AS bucket FROM b)
SELECT cal.bucket, round(b.value, 6) AS value FROM cal LEFT JOIN b USING (bucket)""")
def q_resample_mean(spark, sf):
    ev = T.table(spark, sf, "events")
    return rnd(SE.resample_mean(ev, "ts", "value", "H"), 6)


@register("decompose_additive_long_series", """
WITH s AS (SELECT ts, event_id, CAST(round(value * 100) AS BIGINT) AS value_cents,
                  row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
t AS (SELECT *, CASE WHEN COUNT(value_cents) OVER f = 13
        THEN (SUM(value_cents) OVER f - (lag(value_cents, 6) OVER w + lead(value_cents, 6) OVER w) / 2) / 12 END AS trend,
        pos % 12 AS phase
      FROM s WINDOW w AS (ORDER BY pos), f AS (ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
ph AS (SELECT phase, AVG(value_cents - trend) AS pm FROM t GROUP BY 1),
ph2 AS (SELECT phase, pm - AVG(pm) OVER () AS seasonal FROM ph)
SELECT t.ts, t.event_id, t.pos, t.value_cents, 12 AS period, round(t.trend, 4) AS trend, round(ph2.seasonal, 4) AS seasonal,
  round(t.value_cents - t.trend - ph2.seasonal, 4) AS resid FROM t JOIN ph2 USING (phase)""")
def q_decompose_additive_long_series(spark, sf):
    """T3 on the raw event stream as one long series: distributed positions, halo frames."""
    ev = T.table(spark, sf, "events").select("ts", "event_id",
                                             F.round(F.col("value") * 100).cast("bigint").alias("value_cents"))
    d = SE.decompose_additive(ev, ["ts", "event_id"], "value_cents", 12, distributed=True)
    return rnd(d.withColumn("period", F.col("period").cast("int")), 4)
