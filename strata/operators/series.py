"""Time-series analytics.

A series is (partition_cols..., order key, value). Statistics that are sums over
the series (moments, regressions, autocovariances, Gram matrices) are grouped
aggregates keyed by the series, so millions of series run in parallel and a
single series is never copied to the driver. Per-series numerics that need an
FFT or a small matrix solve run in ``applyInPandas`` with one group per
(resampled, hence bounded) series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.windows import centered_moving_average


def _pw(partition_cols):
    return Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy()


def _ow(order_col, partition_cols):
    return (Window.partitionBy(*partition_cols).orderBy(order_col) if partition_cols
            else Window.orderBy(order_col))


# ------------------------------------------------------------------ preparation

def _week_end(d):
    # days until Sunday: weekday() is Monday=0 .. Sunday=6
    return F.date_add(d, 6 - F.weekday(d))


def resample_mean(df: DataFrame, ts_col: str, value_col: str, freq: str = "D", partition_cols=(),
                  out: str = "bucket") -> DataFrame:
    """Mean per bucket; empty buckets between first and last are kept with null.

    Partial aggregation shrinks raw rows to buckets before the shuffle; the calendar
    is generated per series from its (min, max) bucket, so the join is bounded by
    the number of buckets, not by raw rows.
    """
    d = F.to_date(F.col(ts_col))
    if freq == "D":
        lab, step = d, None
    elif freq == "W":
        lab, step = _week_end(d), 7
    elif freq == "M":
        lab, step = F.last_day(d), "M"
    elif freq == "H":
        lab, step = F.date_trunc("hour", F.col(ts_col)), "H"
    else:
        raise ValueError(freq)
    agg = df.groupBy(*partition_cols, lab.alias(out)).agg(F.avg(value_col).alias(value_col))
    rng = agg.groupBy(*partition_cols).agg(F.min(out).alias("__lo"), F.max(out).alias("__hi"))
    if step is None:
        seq = F.sequence("__lo", "__hi")
    elif step == 7:
        seq = F.sequence("__lo", "__hi", F.expr("INTERVAL 7 DAYS"))
    elif step == "M":
        n = F.months_between("__hi", "__lo").cast("int")
        seq = F.transform(F.sequence(F.lit(0), n), lambda i: F.last_day(F.add_months("__lo", i)))
    else:
        seq = F.sequence("__lo", "__hi", F.expr("INTERVAL 1 HOUR"))
    cal = rng.select(*partition_cols, F.explode(seq).alias(out))
    return cal.join(agg, [*partition_cols, out], "left")


def prepare_series(df: DataFrame, date_col: str, value_col: str, freq: str | None = None,
                   partition_cols=()) -> DataFrame:
    """Parse the date (strings via ``try_to_timestamp``), drop unparsable rows, sort,
    optionally resample."""
    t = dict(df.dtypes)[date_col]
    ts = F.try_to_timestamp(F.col(date_col)) if t == "string" else F.col(date_col).cast("timestamp_ntz")
    s = df.select(*partition_cols, ts.alias(date_col), F.col(value_col).cast("double").alias(value_col))
    s = s.where(F.col(date_col).isNotNull())
    if freq:
        return resample_mean(s, date_col, value_col, freq, partition_cols, out=date_col)
    return s.orderBy(*partition_cols, date_col)


# ------------------------------------------------------------------ decomposition

def _positions(df, order_col, value_col, partition_cols):
    clean = df.where(F.col(value_col).isNotNull())
    return clean.withColumn("pos", F.row_number().over(_ow(order_col, partition_cols)) - 1)


def decompose_additive(df: DataFrame, order_col: str, value_col: str, period: int | None = None,
                       partition_cols=(), distributed: bool = False) -> DataFrame:
    """Additive decomposition of the non-null series.

    period = min(12, n // 4) but at least 2 when not given; trend is the centred moving
    average (2 x p weights for even p); seasonal is the phase mean of the detrended values
    centred to mean zero; residual is what is left. ``distributed=True`` (one long series,
    no partition key) uses range partitions with halo frames (``operators.ordered``).
    """
    if distributed and not partition_cols:
        from strata.operators.ordered import decompose_additive_ordered
        order = [order_col] if isinstance(order_col, str) else list(order_col)
        if period is None:
            n = df.where(F.col(value_col).isNotNull()).count()
            period = max(2, min(12, n // 4))
        return decompose_additive_ordered(df, order, value_col, period)
    s = _positions(df, order_col, value_col, partition_cols)
    n = F.count(F.lit(1)).over(_pw(partition_cols))
    s = s.withColumn("period", F.greatest(F.lit(2), F.least(F.lit(12), F.floor(n / 4))) if period is None
                     else F.lit(period))
    if period is None:
        # period varies per series: compute the trend only for the periods that occur
        # (one small distinct over per-series counts) and pick per row
        occurring = sorted(r[0] for r in s.select(F.col("period").cast("int")).distinct().collect())
        trends = []
        for p in occurring:
            s = centered_moving_average(s, value_col, order_col, p, partition_cols, out=f"__t{p}")
            trends.append((p, f"__t{p}"))
        expr = None
        for p, c in trends:
            expr = F.when(F.col("period") == p, F.col(c)) if expr is None else expr.when(F.col("period") == p, F.col(c))
        s = s.withColumn("trend", expr).drop(*[c for _, c in trends])
    else:
        s = centered_moving_average(s, value_col, order_col, period, partition_cols, out="trend")
    s = s.withColumn("phase", F.col("pos") % F.col("period"))
    ph = (s.groupBy(*partition_cols, "phase").agg(F.avg(F.col(value_col) - F.col("trend")).alias("__pm")))
    ph = ph.withColumn("seasonal", F.col("__pm") - F.avg("__pm").over(_pw(partition_cols))).drop("__pm")
    out = s.join(ph, [*partition_cols, "phase"], "left")
    return out.select(*partition_cols, order_col, "pos", value_col, "period", "trend", "seasonal",
                      (F.col(value_col) - F.col("trend") - F.col("seasonal")).alias("resid"))


def trend_seasonality_strength(df: DataFrame, order_col: str, value_col: str, period: int | None = None,
                               partition_cols=()) -> DataFrame:
    """T4: population variance ratios of trend / seasonal / residual to the series, the
    slope against position, and the trend/seasonality flags. Fewer than 4 points: all false."""
    dec = decompose_additive(df, order_col, value_col, period, partition_cols)
    v = F.col(value_col)
    a = dec.groupBy(*partition_cols).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(v).alias("var"), F.var_pop("trend").alias("vt"),
        F.var_pop("seasonal").alias("vs"), F.var_pop("resid").alias("vr"),
        F.regr_slope(v, F.col("pos").cast("double")).alias("slope"), F.stddev_pop(v).alias("sd"))
    ok = F.col("n") >= 4
    return a.select(*partition_cols, "n",
                    F.when(ok, F.try_divide(F.col("vt"), F.col("var"))).otherwise(0.0).alias("trend_strength"),
                    F.when(ok, F.try_divide(F.col("vs"), F.col("var"))).otherwise(0.0).alias("seasonality_strength"),
                    F.when(ok, F.try_divide(F.col("vr"), F.col("var"))).otherwise(0.0).alias("residual_strength"),
                    F.when(ok, F.col("slope")).alias("slope"),
                    (ok & (F.abs("slope") > 0.01 * F.col("sd"))).alias("trend_detected"),
                    (ok & (F.try_divide(F.col("vs"), F.col("var")) > 0.1)).alias("seasonality_detected"))


def trend_line(df: DataFrame, order_col: str, value_col: str, partition_cols=()) -> DataFrame:
    """Least-squares line against position 0..n-1: slope, intercept and fitted values."""
    s = _positions(df, order_col, value_col, partition_cols)
    x = F.col("pos").cast("double")
    coef = s.groupBy(*partition_cols).agg(F.regr_slope(value_col, x).alias("slope"),
                                          F.regr_intercept(value_col, x).alias("intercept"))
    if partition_cols:
        j = s.join(coef, list(partition_cols), "left")
    else:
        c = coef.first()  # two numbers
        j = s.select("*", F.lit(c["slope"]).alias("slope"), F.lit(c["intercept"]).alias("intercept"))
    return j.select(*partition_cols, order_col, "pos", value_col, "slope", "intercept",
                    (F.col("intercept") + F.col("slope") * x).alias("fitted"))


def acf(df: DataFrame, order_col: str, value_col: str, nlags: int | None = None, partition_cols=()) -> DataFrame:
    """Sample autocorrelation r_k = sum (x_t - m)(x_{t+k} - m) / sum (x_t - m)^2.

    Lags come from ``lag`` windows on the (bounded) series and the sums from one
    grouped aggregate. ``nlags`` defaults to min(10 log10 n, n - 1) per series; as many lags are
    computed as the longest series gets (one small aggregate when ``nlags`` isn't given).
    """
    s = df.where(F.col(value_col).isNotNull())
    longest = s.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    max_lags = max(0, min(longest - 1, int(10 * math.log10(max(longest, 1))) if nlags is None else nlags))
    w = _ow(order_col, partition_cols)
    m = F.avg(value_col).over(_pw(partition_cols))
    n = F.count(F.lit(1)).over(_pw(partition_cols))
    s = s.select(*partition_cols, order_col, (F.col(value_col) - m).alias("d"), n.alias("n"))
    s = s.select("*", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, max_lags + 1)])
    aggs = [F.first("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0")]
    aggs += [F.sum(F.col("d") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, max_lags + 1)]
    a = s.groupBy(*partition_cols).agg(*aggs)
    items = [F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"c{k}"), F.col("c0")).alias("acf"))
             for k in range(0, max_lags + 1)]
    if nlags is None:
        lim = F.least(F.floor(10 * F.log10(F.col("n"))), F.col("n") - 1)
    else:
        lim = F.least(F.lit(nlags), F.col("n") - 1)
    out = a.select(*partition_cols, lim.alias("__lim"), F.explode(F.array(*items)).alias("s"))
    return out.where(F.col("s.lag") <= F.col("__lim")).select(*partition_cols, "s.lag", F.coalesce(
        F.col("s.acf"), F.lit(0.0)).alias("acf"))


def pacf(df: DataFrame, order_col: str, value_col: str, nlags: int | None = None, partition_cols=()) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson on the biased ACF (Yule-Walker MLE).

    Runs per series in ``applyInPandas`` on that series' ACF rows (one per lag)."""
    a = acf(df, order_col, value_col, nlags, partition_cols)
    keys = list(partition_cols)

    def dl(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(dtype=float)
        K = len(r) - 1
        out = [1.0]
        phi_prev = np.zeros(0)
        v = 1.0
        for k in range(1, K + 1):
            if k == 1:
                phi_kk = r[1]
                phi = np.array([phi_kk])
            else:
                num = r[k] - np.dot(phi_prev, r[1:k][::-1])
                phi_kk = num / v if v != 0 else 0.0
                phi = np.append(phi_prev - phi_kk * phi_prev[::-1], phi_kk)
            v = v * (1 - phi_kk ** 2)
            out.append(phi_kk)
            phi_prev = phi
        res = pd.DataFrame({"lag": np.arange(K + 1, dtype="int32"), "pacf": out})
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[keys + ["lag", "pacf"]]

    schema = ", ".join([f"{k} {t}" for k, t in a.dtypes if k in keys] + ["lag int", "pacf double"])
    if keys:
        return a.groupBy(*keys).applyInPandas(dl, schema)
    return a.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(
        lambda p: dl(p.drop(columns=["__g"])), schema)


def dominant_cycle(df: DataFrame, order_col: str, value_col: str, period: int | None = None,
                   partition_cols=()) -> DataFrame:
    """T5: periodogram of the mean-removed series (one-sided density, fs = 1); the
    strongest non-zero frequency, its period n/k, and a cycle flag when that period
    exceeds the seasonal period and its power exceeds 3x the mean power.

    One ``applyInPandas`` group per series with ``numpy.fft.rfft`` (O(n log n)); a SQL
    DFT would have to pair every point with every frequency.
    """
    keys = list(partition_cols)
    s = df.where(F.col(value_col).isNotNull()).select(*keys, order_col, F.col(value_col).cast("double").alias("v"))

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        x = pdf["v"].to_numpy(dtype=float)
        n = len(x)
        p = period if period is not None else max(2, min(12, n // 4))
        row = {k: pdf[k].iloc[0] for k in keys}
        if n < 4:
            row.update(n=n, period=p, dominant_period=None, dominant_power=None, mean_power=None,
                       cycle_detected=False)
            return pd.DataFrame([row])
        X = np.fft.rfft(x - x.mean())
        power = (np.abs(X) ** 2) / n
        if n % 2 == 0:
            power[1:-1] *= 2
        else:
            power[1:] *= 2
        k = int(np.argmax(power[1:]) + 1)
        dom_period = n / k
        cycle = bool(dom_period > p and power[k] > 3 * power.mean())
        row.update(n=n, period=p, dominant_period=float(dom_period), dominant_power=float(power[k]),
                   mean_power=float(power.mean()), cycle_detected=cycle)
        return pd.DataFrame([row])

    types = dict(s.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [
        "n long", "period int", "dominant_period double", "dominant_power double", "mean_power double",
        "cycle_detected boolean"])
    g = s if keys else s.withColumn("__g", F.lit(0))
    return g.groupBy(*(keys or ["__g"])).applyInPandas(
        (lambda p: per_series(p)) if keys else (lambda p: per_series(p.drop(columns=["__g"]))), schema)


# MacKinnon (2010) response-surface critical values for the ADF test
# with a constant (tau_c): c_inf + c1/T + c2/T^2 + c3/T^3 at 1 %, 5 %, 10 %.
ADF_CRIT_C = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


#: MacKinnon's published response surface of the p-value, with a constant.
ADF_SURFACE = {"min": -18.83, "star": -1.61, "max": 2.74,
               "small": [2.1659, 1.4412, 0.038269], "large": [1.7339, 0.93202, -0.12745, -0.010368]}


def adf_p_value(stat: float) -> float:
    """Approximate p-value of the Dickey-Fuller statistic with a constant."""
    if stat > ADF_SURFACE["max"]:
        return 1.0
    if stat < ADF_SURFACE["min"]:
        return 0.0
    z = sum(c * stat ** i for i, c in enumerate(ADF_SURFACE["small" if stat <= ADF_SURFACE["star"] else "large"]))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_stationarity(df: DataFrame, order_col: str, value_col: str, partition_cols=(),
                     maxlag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag by AIC.

    Per series (``applyInPandas``), dy_t on (1, y_{t-1}, dy_{t-1..t-p}) for p = 0..maxlag on a common sample: one
    Gram matrix of all columns gives every lag's regression as a leading part of it. The lag of the least
    AIC is fitted again on its own sample; reported are the t statistic of y_{t-1}, the critical values and the
    p-value of the published response surface. ``stationary`` means p <= 0.05; constant series or
    fewer than 3 points count as stationary with null statistics."""
    keys = list(partition_cols)
    s = df.where(F.col(value_col).isNotNull()).select(*keys, order_col, F.col(value_col).cast("double").alias("v"))

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        y = pdf["v"].to_numpy(dtype=float)
        n = len(y)
        row = {k: pdf[k].iloc[0] for k in keys}
        if n < 3 or np.all(y == y[0]):
            row.update(n=n, adf_stat=None, p_value=None, used_lag=None, crit_1=None, crit_5=None, crit_10=None, stationary=True)
            return pd.DataFrame([row])
        ml = maxlag if maxlag is not None else int(math.ceil(12 * (n / 100.0) ** 0.25))
        ml = max(0, min(ml, n // 2 - 2))
        dy, level = np.diff(y), y - y.mean()  # the constant takes the mean up
        dy, level = dy / dy.std() if dy.std() else dy, level / level.std()  # the statistic is free of scale

        def gram(p: int) -> tuple[np.ndarray, int]:
            idx = np.arange(p, len(dy))
            x = np.column_stack([np.ones(len(idx)), level[idx], *[dy[idx - j] for j in range(1, p + 1)], dy[idx]])
            return x.T @ x, len(idx)

        def regression(g: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float]:
            """(coefficients, inverse, residual sum of squares) with p lags, from the leading columns of a Gram matrix."""
            inv = np.linalg.pinv(g[:p + 2, :p + 2], hermitian=True)
            beta = inv @ g[:p + 2, -1]
            return beta, inv, max(float(g[-1, -1] - beta @ g[:p + 2, -1]), 0.0)

        g, size = gram(ml)
        best = None
        for p in range(ml + 1):
            if size <= p + 2:
                break
            rss = regression(g, p)[2]
            aic = size * math.log(rss / size) + 2 * (p + 2) if rss > 1e-14 * g[-1, -1] else -np.inf
            if best is None or aic < best[0]:
                best = (aic, p)
        p = best[1] if best else 0
        g, size = gram(p)
        beta, inv, rss = regression(g, p)
        var = rss / max(size - p - 2, 1) * inv[1, 1]
        stat = float(beta[1] / math.sqrt(var)) if var > 0 else None
        crit = {k: c[0] + c[1] / size + c[2] / size ** 2 + c[3] / size ** 3 for k, c in ADF_CRIT_C.items()}
        p_value = None if stat is None else adf_p_value(stat)
        row.update(n=n, adf_stat=stat, p_value=p_value, used_lag=p, crit_1=crit["1%"], crit_5=crit["5%"], crit_10=crit["10%"],
                   stationary=bool(p_value is not None and p_value <= 0.05))
        return pd.DataFrame([row])

    types = dict(s.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [
        "n long", "adf_stat double", "p_value double", "used_lag int", "crit_1 double", "crit_5 double", "crit_10 double",
        "stationary boolean"])
    g = s if keys else s.withColumn("__g", F.lit(0))
    return g.groupBy(*(keys or ["__g"])).applyInPandas(
        (lambda p: per_series(p)) if keys else (lambda p: per_series(p.drop(columns=["__g"]))), schema)


# ------------------------------------------------------------------ calendar profiles

def monthly_profile(df: DataFrame, ts_col: str, value_col: str) -> DataFrame:
    """Mean and sample std by calendar month 1..12; months without data give 0."""
    m = (df.where(F.col(value_col).isNotNull()).groupBy(F.month(ts_col).alias("month"))
         .agg(F.avg(value_col).alias("mean"), F.stddev_samp(value_col).alias("std")))
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(m, "month", "left").select("month", F.coalesce("mean", F.lit(0.0)).alias("mean"),
                                                   F.coalesce("std", F.lit(0.0)).alias("std"))


def seasonal_subseries(df: DataFrame, order_col: str, value_col: str, period: int, partition_cols=()) -> DataFrame:
    """Values grouped by phase (position mod period): count and the five box-plot numbers.

    Phase groups hold n/period values of one bounded series, so exact ``percentile``
    per group stays within a task's memory.
    """
    s = _positions(df, order_col, value_col, partition_cols).withColumn("phase", F.col("pos") % period)
    v = F.col(value_col)
    return s.groupBy(*partition_cols, "phase").agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.percentile(v, 0.25).alias("q1"),
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.75).alias("q3"), F.max(v).alias("max"))


# ------------------------------------------------------------------ forecast metrics

def _clean_pairs(df, actual, predicted):
    a, p = F.col(actual), F.col(predicted)
    ok = (a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p)
          & (F.abs(a) != float("inf")) & (F.abs(p) != float("inf")))
    return df.where(ok)


def forecast_metrics(df: DataFrame, actual: str, predicted: str, group_cols=(), smape: bool = False) -> DataFrame:
    """MAE, MSE, RMSE, MAPE % (non-zero actuals; null if none), R2, optionally SMAPE %.

    Null/NaN/inf pairs are dropped first; with no pairs every metric is null.
    R2 = 1 - SSE/SST (constant actuals: 1 if perfect else 0).
    """
    c = _clean_pairs(df, actual, predicted)
    a, p = F.col(actual), F.col(predicted)
    e = p - a
    aggs = [F.count(F.lit(1)).alias("n_samples"), F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"),
            F.avg(F.when(a != 0, F.abs(e / a))).alias("__mape"), F.count_if(a != 0).alias("__nz"),
            F.sum(e * e).alias("__sse"), (F.var_pop(a) * F.count(a)).alias("__sst")]
    if smape:
        aggs.append(F.avg(F.try_divide(2 * F.abs(e), F.abs(a) + F.abs(p))).alias("__smape"))
    g = c.groupBy(*group_cols).agg(*aggs)
    has = F.col("n_samples") > 0
    r2 = (F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst"))
          .when(F.col("__sse") == 0, 1.0).otherwise(0.0))
    cols = [*group_cols, "n_samples", F.when(has, F.col("MAE")).alias("MAE"), F.when(has, F.col("MSE")).alias("MSE"),
            F.when(has, F.sqrt("MSE")).alias("RMSE"),
            F.when(has & (F.col("__nz") > 0), F.col("__mape") * 100).alias("MAPE"),
            F.when(has, r2).alias("R2")]
    if smape:
        cols.append(F.when(has, F.col("__smape") * 100).alias("SMAPE"))
    return g.select(*cols)


def anomaly_summary(df: DataFrame, flag_col: str, group_cols=()) -> DataFrame:
    """Total points, anomaly count and percentage (per method / series)."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_points"), F.count_if(F.col(flag_col)).alias("anomaly_count"),
        (F.count_if(F.col(flag_col)) * 100.0 / F.count(F.lit(1))).alias("anomaly_percentage"))


def forecast_compare_frame(train: DataFrame, test: DataFrame, forecast: DataFrame, order_col: str,
                           value_col: str) -> DataFrame:
    """train / test / forecast rows in one frame with a ``kind`` tag."""
    parts = [(train, "train"), (test, "test"), (forecast, "forecast")]
    out = None
    for d, tag in parts:
        x = d.select(order_col, F.col(value_col).cast("double").alias("value"), F.lit(tag).alias("kind"))
        out = x if out is None else out.unionByName(x)
    return out
