"""Flagship plan: daily event series per type -> lags -> rolling stats -> z-score flags.

One scan of ``events`` (pruned to ts, event_type, value), one partial+final
aggregate to day x type, then every window is partitioned by ``event_type``
(bounded series: one row per day), so the ordered windows never collapse
the raw event volume into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import windows as W
from strata.sources import tables as T

R4 = 4


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    de = T.daily_events(spark, sf_dir)
    keys = ("event_type",)
    f = W.lag_features(de, "value", "ds", lags=(1, 2, 3, 7), fill_method="ffill", partition_cols=keys)
    f = W.rolling_features(f, "value", "ds", windows=(7,), fill_method="ffill", partition_cols=keys)
    f = W.rolling_zscore(f, "value", "ds", window_size=5, threshold=3.0, partition_cols=keys)
    out = [c for c in f.columns]
    return f.select(*[F.round(c, R4).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes if c in out])


SQL_FLAGSHIP = T.SQL_DAILY_EVENTS.join(["WITH ", ""]) + """,
lg AS (
  SELECT ds, event_type, value,
    lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3, lag(value, 7) OVER w AS l7,
    CASE WHEN COUNT(value) OVER w7 >= 1 THEN AVG(value) OVER w7 END AS rm7,
    CASE WHEN COUNT(value) OVER w7 >= 1 THEN STDDEV_SAMP(value) OVER w7 END AS rs7,
    CASE WHEN COUNT(value) OVER w7 >= 1 THEN MIN(value) OVER w7 END AS rmin7,
    CASE WHEN COUNT(value) OVER w7 >= 1 THEN MAX(value) OVER w7 END AS rmax7,
    CASE WHEN COUNT(value) OVER w5 >= 5 THEN AVG(value) OVER w5 END AS m5,
    CASE WHEN COUNT(value) OVER w5 >= 5 THEN STDDEV_SAMP(value) OVER w5 END AS s5
  FROM daily_events
  WINDOW w AS (PARTITION BY event_type ORDER BY ds),
         w7 AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w5 AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
ff AS (
  SELECT ds, event_type, value,
    last_value(l1 IGNORE NULLS) OVER a AS value_lag_1, last_value(l2 IGNORE NULLS) OVER a AS value_lag_2,
    last_value(l3 IGNORE NULLS) OVER a AS value_lag_3, last_value(l7 IGNORE NULLS) OVER a AS value_lag_7,
    last_value(rm7 IGNORE NULLS) OVER a AS value_rolling_mean_7, last_value(rs7 IGNORE NULLS) OVER a AS value_rolling_std_7,
    last_value(rmin7 IGNORE NULLS) OVER a AS value_rolling_min_7, last_value(rmax7 IGNORE NULLS) OVER a AS value_rolling_max_7,
    COALESCE(last_value(m5 IGNORE NULLS) OVER a, first_value(m5 IGNORE NULLS) OVER b) AS rolling_mean,
    COALESCE(last_value(s5 IGNORE NULLS) OVER a, first_value(s5 IGNORE NULLS) OVER b) AS rolling_std
  FROM lg
  WINDOW a AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY event_type ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (
  SELECT *, COALESCE(CASE WHEN rolling_std <> 0 THEN abs(value - rolling_mean) / rolling_std END, 0.0) AS z_score FROM ff)
SELECT ds, event_type, round(value, 4) AS value,
  round(value_lag_1, 4) AS value_lag_1, round(value_lag_2, 4) AS value_lag_2, round(value_lag_3, 4) AS value_lag_3,
  round(value_lag_7, 4) AS value_lag_7, round(value_rolling_mean_7, 4) AS value_rolling_mean_7,
  round(value_rolling_std_7, 4) AS value_rolling_std_7, round(value_rolling_min_7, 4) AS value_rolling_min_7,
  round(value_rolling_max_7, 4) AS value_rolling_max_7, round(rolling_mean, 4) AS rolling_mean,
  round(rolling_std, 4) AS rolling_std, round(z_score, 4) AS z_score, z_score > 3 AS is_anomaly
FROM z"""
