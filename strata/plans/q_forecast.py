"""Registered forecasting queries (F1-F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import forecast as FC
from strata.operators import learn as L
from strata.operators import series as SE
from strata.operators.windows import chronological_split
from strata.plans.q_windows import rnd
from strata.plans.registry import register
from strata.sources import tables as T


def _events(spark, sf):
    return T.daily_events(spark, sf)


@register("forecast_arima")
def q_forecast_arima(spark, sf):
    fc, _ = FC.forecast_series(_events(spark, sf), "ds", "value", ("event_type",), "arima", steps=10)
    return rnd(fc, 6)


@register("model_coefficients")
def q_model_coefficients(spark, sf):
    _, coef = FC.forecast_series(_events(spark, sf), "ds", "value", ("event_type",), "arima", steps=10)
    return coef


@register("forecast_sarima")
def q_forecast_sarima(spark, sf):
    fc, _ = FC.forecast_series(T.supplier_months(spark, sf), "ds", "sales", ("l_suppkey",), "sarima", steps=10, freq="M",
                               seasonal_order=(1, 1, 1, 12))
    return rnd(fc, 4)


@register("forecast_sarimax")
def q_forecast_sarimax(spark, sf):
    fc, _ = FC.forecast_series(T.supplier_months(spark, sf), "ds", "sales", ("l_suppkey",), "sarimax", steps=10, freq="M",
                               seasonal_order=(1, 1, 1, 12), exog_cols=("n_lines",))
    return rnd(fc, 4)


@register("forecast_holt_winters")
def q_forecast_holt_winters(spark, sf):
    fc, _ = FC.forecast_series(T.supplier_months(spark, sf), "ds", "price", ("l_suppkey",), "holt_winters", steps=10, freq="M",
                               trend="add", seasonal="add", seasonal_periods=12)
    return rnd(fc, 4)


@register("forecast_exp_smoothing")
def q_forecast_exp_smoothing(spark, sf):
    fc, _ = FC.forecast_series(_events(spark, sf), "ds", "value", ("event_type",), "exp_smoothing", steps=10,
                               seasonal_periods=7)
    return rnd(fc, 6)


@register("forecast_smoothing_fixed", "WITH RECURSIVE " + T.SQL_DAILY_EVENTS + """,
s AS (SELECT event_type, ds, value, row_number() OVER (PARTITION BY event_type ORDER BY ds) AS t FROM daily_events WHERE value IS NOT NULL),
r AS (SELECT a.event_type, 0 AS t, a.value AS level, b.value - a.value AS slope FROM s a JOIN s b ON b.event_type = a.event_type AND a.t = 1 AND b.t = 2
  UNION ALL SELECT r.event_type, s.t, 0.3 * s.value + 0.7 * (level + slope), 0.3 * (0.3 * s.value + 0.7 * (level + slope) - level) + 0.7 * slope
  FROM r JOIN s ON s.event_type = r.event_type AND s.t = r.t + 1),
e AS (SELECT event_type, level, slope FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY t DESC) = 1),
d AS (SELECT event_type, max(ds) AS last FROM s GROUP BY event_type)
SELECT event_type, CAST(h AS INTEGER) AS step, CAST(d.last + CAST(h AS INTEGER) AS DATE) AS ds, round(level + h * slope, 6) AS forecast
FROM e JOIN d USING (event_type), range(1, 11) x(h)""")
def q_forecast_smoothing_fixed(spark, sf):
    fc, _ = FC.forecast_series(_events(spark, sf), "ds", "value", ("event_type",), "holt_winters", steps=10, trend="add",
                               seasonal=None, seasonal_periods=1, grid=(0.3,), refine=False)
    return rnd(fc, 6)


@register("forecast_future")
def q_forecast_future(spark, sf):
    info = L.forecast_ml_train(T.daily_sales(spark, sf), "ds", "sales", "random_forest")
    return rnd(FC.forecast_future_ml(info, 10, "D", "zero"), 4)


@register("forecast_future_recursive")
def q_forecast_future_recursive(spark, sf):
    info = L.forecast_ml_train(T.daily_sales(spark, sf), "ds", "sales", "linear")
    return rnd(FC.forecast_future_ml(info, 10, "D", "recursive"), 4)


@register("evaluate_forecast")
def q_evaluate_forecast(spark, sf):
    ds = chronological_split(T.daily_sales(spark, sf), "ds")
    info = L.forecast_ml_train(ds.where("split = 'train'").drop("split"), "ds", "sales", "linear")
    return rnd(FC.evaluate_forecast(info, ds.where("split = 'test'").drop("split")), 6)
