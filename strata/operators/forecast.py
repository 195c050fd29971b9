"""Many-series forecasting (F1-F8).

The points of a series (one value of ``key_cols``) are gathered into one row, bounded by its length, and
Arrow batches of rows are fitted together in numpy, so any number of series fit in parallel:

* ARIMA / SARIMA / SARIMAX: exact Gaussian likelihood of the differenced series by a Kalman filter
  (``statespace``), searched from two starts: zero and the two-stage least squares of
  Hannan and Rissanen.
* Holt-Winters / exponential smoothing: additive or multiplicative trend and
  season; smoothing constants minimise the one-step SSE, by a compass search that starts at
  the best point of a grid, for all series of a batch at once.

Outputs are tidy frames: forecasts (keys, step, date, forecast) and
coefficients (keys, term, value).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import statespace

BATCH = 64  # series fitted together
MOST_MOVES = 150  # of the search for smoothing constants

# ------------------------------------------------------------------ numpy cores


def _ols(X: np.ndarray, y: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    return beta, resid


def _difference(y: np.ndarray, d: int, D: int, s: int) -> np.ndarray:
    z = y.copy()
    for _ in range(d):
        z = np.diff(z)
    for _ in range(D):
        z = z[s:] - z[:-s]
    return z


def _undifference(hist: np.ndarray, fc_diff: np.ndarray, d: int, D: int, s: int) -> np.ndarray:
    """Invert (1-B)^d (1-B^s)^D for forecasts appended after ``hist``."""
    levels = [hist.copy()]
    z = hist.copy()
    for _ in range(d):
        z = np.diff(z)
        levels.append(z.copy())
    for _ in range(D):
        z = z[s:] - z[:-s]
        levels.append(z.copy())
    out = fc_diff.copy()
    # undo seasonal differences (innermost first), then regular ones
    stages = [("s", levels[d + i]) for i in range(D)][::-1] + [("r", levels[i]) for i in range(d)][::-1]
    for kind, base in stages:
        ext = list(base)
        res = []
        for v in out:
            nxt = v + (ext[-s] if kind == "s" else ext[-1])
            ext.append(nxt)
            res.append(nxt)
        out = np.array(res)
    return out


def fit_arima_hr(y: np.ndarray, order=(1, 1, 1), seasonal=(0, 0, 0, 0), exog: np.ndarray | None = None,
                 exog_future: np.ndarray | None = None, steps: int = 10) -> dict:
    """Hannan-Rissanen ARIMA(p,d,q)(P,D,Q,s) with optional exogenous regressors.

    A constant is fitted only if nothing is differenced. Exogenous columns are differenced like the
    target; without ``exog_future`` (levels, one row per step) they stay at their last values."""
    p, d, q = order
    P, D, Q, s = seasonal
    z = _difference(y, d, D, s)
    n = len(z)
    ar_lags = sorted({i for i in range(1, p + 1)} | {s * i for i in range(1, P + 1)} |
                     {s * i + j for i in range(1, P + 1) for j in range(1, p + 1)})
    ma_lags = sorted({i for i in range(1, q + 1)} | {s * i for i in range(1, Q + 1)} |
                     {s * i + j for i in range(1, Q + 1) for j in range(1, q + 1)})
    ar_lags = [lag for lag in ar_lags if lag < n - 2]
    ma_lags = [lag for lag in ma_lags if lag < n - 2]
    ex, ex_future = None, None
    if exog is not None:
        future = np.repeat(exog[-1:], steps, axis=0) if exog_future is None else np.asarray(exog_future, dtype=float)[:steps]
        both = np.column_stack([_difference(c, d, D, s) for c in np.vstack([exog, future]).T])
        ex, ex_future = both[:n], both[n:]
    constant = d + D == 0
    # stage 1: long AR for innovations
    m = max(1, min(int(10 * math.log10(max(n, 2))), n // 3, max(ar_lags + ma_lags + [1]) * 2))
    X1 = np.column_stack([np.ones(n - m)] + [z[m - i:n - i] for i in range(1, m + 1)]) if n > m + 1 else None
    e = np.zeros(n)
    if X1 is not None:
        _, r = _ols(X1, z[m:])
        e[m:] = r
    start = max(ar_lags + ma_lags + [m])
    rows = range(start, n)
    cols = [np.ones(len(rows))] * constant + [z[start - lag:n - lag] for lag in ar_lags] + [e[start - lag:n - lag] for lag in ma_lags]
    if ex is not None:
        cols += [ex[start:, j] for j in range(ex.shape[1])]
    if not cols or len(rows) < len(cols) + 1:
        raise ValueError("series too short for the model order")
    X = np.column_stack(cols)
    beta, resid = _ols(X, z[start:])
    k = X.shape[1]
    nobs = len(resid)
    sigma2 = float(resid @ resid / nobs)
    llf = -nobs / 2 * (math.log(2 * math.pi * sigma2) + 1) if sigma2 > 0 else float("inf")
    aic = -2 * llf + 2 * (k + 1)
    bic = -2 * llf + math.log(nobs) * (k + 1)
    c = beta[0] if constant else 0.0
    rest = beta[int(constant):]
    phi = dict(zip(ar_lags, rest[:len(ar_lags)]))
    theta = dict(zip(ma_lags, rest[len(ar_lags):len(ar_lags) + len(ma_lags)]))
    gam = rest[len(ar_lags) + len(ma_lags):]
    zz, ee = list(z), list(e)
    ee[start:] = list(resid)
    fc = []
    for h in range(steps):
        v = c + sum(phi[lag] * zz[-lag] for lag in ar_lags) + sum(theta[lag] * ee[-lag] for lag in ma_lags)
        if ex is not None and len(gam):
            v += float(np.dot(gam, ex_future[h]))
        zz.append(v)
        ee.append(0.0)
        fc.append(v)
    fc = _undifference(y, np.array(fc), d, D, s) if (d or D) else np.array(fc)
    terms = {**({"const": c} if constant else {}), **{f"ar.L{lag}": v for lag, v in phi.items()}, **{f"ma.L{lag}": v for lag, v in theta.items()},
             **{f"exog{j}": v for j, v in enumerate(gam)}, "sigma2": sigma2, "aic": aic, "bic": bic,
             "mse": float(np.mean(resid ** 2))}
    return {"forecast": fc, "terms": terms}


def _partials(c: np.ndarray) -> np.ndarray:
    """Unconstrained numbers whose partial autocorrelations give (nearly, if not stationary) these coefficients."""
    c, out = np.asarray(c, dtype=float).copy(), []
    for k in range(len(c), 0, -1):
        r = float(np.clip(c[k - 1], -0.95, 0.95))
        out.append(math.atanh(r))
        c = (c[:k - 1] + r * c[:k - 1][::-1]) / (1 - r * r)
    return np.array(out[::-1])


def fit_arima_batch(ys: list[np.ndarray], order=(1, 1, 1), seasonal=(0, 0, 0, 0), exog: list[np.ndarray] | None = None,
                    exog_future: list[np.ndarray] | None = None, steps: int = 10) -> list[dict | Exception]:
    """ARIMA(p,d,q)(P,D,Q,s) with optional regressors of every series, by exact likelihood.

    A constant is fitted only if nothing is differenced. Regressors are differenced like the target;
    without ``exog_future`` (levels, one row per step) they stay at their last values."""
    model = statespace.Model(order, seasonal)
    d, D, s = model.d, model.D, model.s
    constant = d + D == 0
    out: list = [None] * len(ys)
    kept, zs, futures, starts = [], [], [], []
    for i, y in enumerate(ys):
        z = _difference(np.asarray(y, dtype=float), d, D, s)
        cols, future = [], []
        if constant:
            cols.append(np.ones(len(z)))
            future.append(np.ones(steps))
        if exog is not None:
            ahead = np.repeat(exog[i][-1:], steps, axis=0) if exog_future is None else np.asarray(exog_future[i], dtype=float)[:steps]
            for c in np.vstack([exog[i], ahead]).T:
                both = _difference(c, d, D, s)
                cols.append(both[:len(z)])
                future.append(both[len(z):])
        if len(z) < model.k + len(cols) + 2:
            out[i] = ValueError("series too short for the model order")
            continue
        start = np.zeros((2, model.k))
        try:
            t = fit_arima_hr(np.asarray(y, dtype=float), order, seasonal, None if exog is None else exog[i], None, 0)["terms"]
            first = lambda name, n, m: [t.get(f"{name}.L{(j + 1) * m}", 0.0) for j in range(n)]
            start[1] = np.concatenate([_partials(first("ar", model.p, 1)), _partials([-v for v in first("ma", model.q, 1)]),
                                       _partials(first("ar", model.P, s)), _partials([-v for v in first("ma", model.Q, s)])])
        except (ValueError, np.linalg.LinAlgError):
            pass
        kept.append(i)
        zs.append(np.column_stack([z, *cols]))
        futures.append(np.column_stack(future) if future else np.zeros((steps, 0)))
        starts.append(start)
    if not kept:
        return out
    n = np.array([len(z) for z in zs])
    z = np.zeros((len(zs), n.max(), zs[0].shape[1]))
    scale = np.array([max(float(np.abs(x[:, 0]).max()), 1e-300) for x in zs])  # the variance is concentrated out
    for i, x in enumerate(zs):
        z[i, :len(x)] = x
    z[:, :, 0] /= scale[:, None]
    x, found = statespace.fit(model, z, n, np.nan_to_num(np.stack(starts)))
    ahead = statespace.predict(found, np.stack(futures)) * scale[:, None]
    terms = model.polynomials(x)[2]
    for j, i in enumerate(kept):
        beta = found["beta"][j] * scale[j]
        sigma2 = float(found["sigma2"][j] * scale[j] ** 2)
        flat = found["sigma2"][j] <= 1e-290
        llf = math.inf if flat else float(found["llf"][j] - n[j] * math.log(scale[j]))
        k = model.k + len(beta) + 1
        fc = _undifference(np.asarray(ys[i], dtype=float), ahead[j], d, D, s) if (d or D) else ahead[j]
        out[i] = {"forecast": fc, "terms": {**({"const": float(beta[0])} if constant else {}), **{t: float(v[j]) for t, v in terms.items()},
                                            **{f"exog{c}": float(v) for c, v in enumerate(beta[int(constant):])}, "sigma2": 0.0 if flat else sigma2, "llf": llf,
                                            "aic": -2 * llf + 2 * k, "bic": -2 * llf + math.log(n[j]) * k, "mse": float(found["mse"][j] * scale[j] ** 2)}}
    return out


def _hw_run(y, n, col, alpha, beta, gamma, trend, seasonal, m):
    """One-step Holt-Winters recursion for arrays of series and smoothing constants at once.

    ``y`` (time, series) padded, ``n`` lengths; entry i runs series ``col[i]`` with constant i. Returns the squared
    one-step errors and the final (level, trend, season), one entry per constant."""
    ratio = lambda a, b, other: np.where(b != 0, a / np.where(b != 0, b, 1.0), other)
    if seasonal:
        l0 = y[:m].mean(axis=0)
        b0 = (y[m:2 * m].mean(axis=0) - l0) / m if trend else np.zeros_like(l0)
        s0 = y[:m] - l0 if seasonal == "add" else np.where(l0 != 0, y[:m] / np.where(l0 != 0, l0, 1.0), 1.0)
    else:
        l0 = y[0]
        b0 = np.where(n > 1, y[min(1, len(y) - 1)] - y[0], 0.0) if trend else np.zeros_like(l0)
        s0 = np.zeros((1, len(l0)))
    level, slope, sse, season, n = l0[col], b0[col], np.zeros(len(col)), s0[:, col], n[col]
    for t in range(len(y)):
        at = t % m if seasonal else 0
        on, x = t < n, y[t, col]
        base = level + slope if trend == "add" else (level * slope if trend == "mul" else level)
        old = season[at]
        guess = base + old if seasonal == "add" else (base * old if seasonal == "mul" else base)
        sse += np.where(on, (x - guess) ** 2, 0.0)
        seen = x - old if seasonal == "add" else (ratio(x, old, x) if seasonal == "mul" else x)
        new = alpha * seen + (1 - alpha) * base
        if trend == "add":
            slope = np.where(on, beta * (new - level) + (1 - beta) * slope, slope)
        elif trend == "mul":
            slope = np.where(on, beta * ratio(new, level, 1.0) + (1 - beta) * slope, slope)
        if seasonal == "add":
            season[at] = np.where(on, gamma * (x - new) + (1 - gamma) * old, old)
        elif seasonal == "mul":
            season[at] = np.where(on, gamma * ratio(x, new, 1.0) + (1 - gamma) * old, old)
        level = np.where(on, new, level)
    return sse, level, slope, season


def fit_holt_winters_batch(ys: list[np.ndarray], trend: str | None = "add", seasonal: str | None = "add", m: int = 12,
                           steps: int = 10, grid=(0.1, 0.3, 0.5, 0.7, 0.9), refine: bool = True) -> list[dict | Exception]:
    """Holt-Winters of every series with (alpha, beta, gamma) minimising the one-step SSE: the best point of a grid
    (first on ties) and, with ``refine``, a compass search from there on [0, 1], whose step grows with each success and
    shrinks to 1e-4, of at most ``MOST_MOVES`` moves."""
    out: list = [None] * len(ys)
    kept = []
    for i, y in enumerate(ys):
        if (trend == "mul" or seasonal == "mul") and np.any(y <= 0):
            out[i] = ValueError("multiplicative components need positive data")
        else:
            kept.append(i)
    if not kept:
        return out
    n = np.array([len(ys[i]) for i in kept])
    y = np.zeros((n.max(), len(kept)))
    for j, i in enumerate(kept):
        y[:n[j], j] = ys[i]
    points = np.array([(a, b, g) for a in grid for b in (grid if trend else (0.0,)) for g in (grid if seasonal else (0.0,))])
    every = np.arange(len(kept))
    with np.errstate(over="ignore", invalid="ignore"):
        run = lambda col, x: _hw_run(y, n, col, *x.T, trend, seasonal, m)
        sse = np.nan_to_num(run(np.repeat(every, len(points)), np.tile(points, (len(kept), 1)))[0].reshape(len(kept), -1), nan=np.inf)
        x, best = points[sse.argmin(axis=1)], sse.min(axis=1)
        free = np.flatnonzero([True, bool(trend), bool(seasonal)])
        moves = np.concatenate([np.eye(3)[free], -np.eye(3)[free]])
        step = np.full(len(kept), 0.1)
        for _ in range(MOST_MOVES if refine else 0):
            todo = np.flatnonzero(step > 1e-4)
            if not len(todo):
                break
            trial = (x[todo, None] + step[todo, None, None] * moves).clip(0, 1)
            f = np.nan_to_num(run(np.repeat(todo, len(moves)), trial.reshape(-1, 3))[0].reshape(len(todo), -1), nan=np.inf)
            at = f.argmin(axis=1)
            got = f[np.arange(len(todo)), at]
            better = got < best[todo] * (1 - 1e-7)
            x[todo[better]], best[todo[better]] = trial[better, at[better]], got[better]
            step[todo] = np.where(better, np.minimum(step[todo] * 2, 0.2), step[todo] / 4)
        sse, level, slope, season = run(every, x)
    for j, i in enumerate(kept):
        fc = []
        for h in range(1, steps + 1):
            base = level[j] + h * slope[j] if trend == "add" else (level[j] * slope[j] ** h if trend == "mul" else level[j])
            at = (n[j] + h - 1) % m if seasonal else 0
            fc.append(base + season[at, j] if seasonal == "add" else (base * season[at, j] if seasonal == "mul" else base))
        k = 1 + (trend is not None) + (seasonal is not None)
        aic = n[j] * math.log(sse[j] / n[j]) + 2 * k if sse[j] > 0 else float("-inf")
        out[i] = {"forecast": np.array(fc), "terms": {"smoothing_level": x[j, 0], "smoothing_trend": x[j, 1] if trend else None,
                                                      "smoothing_seasonal": x[j, 2] if seasonal else None, "sse": sse[j], "aic": aic, "mse": sse[j] / n[j]}}
    return out


# ------------------------------------------------------------------ Spark wrappers

def _fill_gaps(y: np.ndarray) -> np.ndarray:
    """Time-ordered linear interpolation, then ffill and bfill (reference pre-fill)."""
    s = pd.Series(y, dtype=float)
    return s.interpolate(method="linear", limit_direction="forward").ffill().bfill().to_numpy()


#: period ends after a date, by the name of the frequency
OFFSETS = {"D": pd.offsets.Day, "B": pd.offsets.BusinessDay, "W": pd.offsets.Week, "M": pd.offsets.MonthEnd,
           "Q": pd.offsets.QuarterEnd, "Y": pd.offsets.YearEnd}


def forecast_series(df: DataFrame, date_col: str, value_col: str, key_cols=(), model: str = "arima",
                    steps: int = 10, freq: str = "D", order=(1, 1, 1), seasonal_order=(1, 1, 1, 12),
                    exog_cols=(), trend="add", seasonal="add", seasonal_periods: int = 12,
                    fill: str = "interpolate", refine: bool = True,
                    grid=(0.1, 0.3, 0.5, 0.7, 0.9)) -> tuple[DataFrame, DataFrame]:
    """Fit one model per series and forecast ``steps`` periods.

    model: arima (>= 5 points), sarima (>= 10), sarimax (+ exog columns, which must exist),
    holt_winters (nulls dropped, >= 2 x period), exp_smoothing (nulls filled, >= 5, season
    only with >= 2 x period). Returns (forecasts, coefficients); a series that cannot be fit
    contributes an ``error`` coefficient row instead of forecasts.

    ``key_cols`` name the series: each is one row of its points, so there is no model of
    a whole table in one task. ``refine=False`` keeps the smoothing constants on their ``grid``. ``freq`` is one of D, B, W, M, Q, Y.
    """
    keys = list(key_cols)
    if not keys:
        raise ValueError("key_cols must name the series")
    if freq not in OFFSETS:
        raise ValueError(f"freq {freq!r} is none of {sorted(OFFSETS)}")
    missing = [c for c in exog_cols if c not in df.columns]
    if missing:
        raise ValueError(f"exogenous columns not found: {missing}")
    sel = df.select(*keys, F.col(date_col).cast("date").alias("__d"), F.col(value_col).cast("double").alias("__y"),
                    *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(exog_cols)])
    types = dict(sel.dtypes)
    points = F.sort_array(F.collect_list(F.struct("__d", "__y", *[f"__x{i}" for i in range(len(exog_cols))])))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)  # few rows, much work: not coalesced
    series = sel.repartition(tasks, *keys).groupBy(*keys).agg(points.alias("__s")).select(*keys, F.array_max("__s.__d").alias("__last"), F.col("__s.__y").alias("__y"),
                                                                *[F.col(f"__s.__x{i}").alias(f"__x{i}") for i in range(len(exog_cols))])

    def fit(ys: list[np.ndarray], exogs: list[np.ndarray] | None) -> list[dict | Exception]:
        """One result or error per series."""
        out: list = [None] * len(ys)
        deals: dict = {}
        for i, y in enumerate(ys):
            y = y[~np.isnan(y)] if model == "holt_winters" else _fill_gaps(y)
            need = {"holt_winters": 2 * seasonal_periods, "arima": 5, "exp_smoothing": 5}.get(model, 10)
            if len(y) < need or np.isnan(y).any():
                out[i] = ValueError(f"needs {need} points, has {len(y)}")
                continue
            season = seasonal if model == "holt_winters" or len(y) >= 2 * seasonal_periods else None
            deals.setdefault(season, []).append((i, y))
        for season, mine in deals.items():
            values = [y for _, y in mine]
            if model in ("holt_winters", "exp_smoothing"):
                found = fit_holt_winters_batch(values, trend, season, seasonal_periods, steps, grid, refine)
            else:
                ex = [exogs[i] for i, _ in mine] if model == "sarimax" and exog_cols else None
                found = fit_arima_batch(values, order, (0, 0, 0, 0) if model == "arima" else seasonal_order, ex, None, steps)
            for (i, _), r in zip(mine, found, strict=True):
                out[i] = r
        return out

    def per_batch(frames):
        for pdf in frames:
            for a in range(0, len(pdf), BATCH):
                part = pdf.iloc[a:a + BATCH]
                ys = [np.array(v, dtype=float) for v in part["__y"]]
                exogs = [np.column_stack([_fill_gaps(np.array(part[f"__x{i}"].iloc[j], dtype=float)) for i in range(len(exog_cols))])
                         for j in range(len(part))] if exog_cols else None
                rows = []
                for j, res in enumerate(fit(ys, exogs)):
                    key = {k: part[k].iloc[j] for k in keys}
                    if isinstance(res, Exception):
                        rows.append({**key, "kind": "coef", "step": None, "date": None, "value": None, "term": "error", "note": str(res)[:200]})
                        continue
                    for h, v in enumerate(res["forecast"], start=1):
                        dt = (pd.Timestamp(part["__last"].iloc[j]) + OFFSETS[freq](h)).date()
                        rows.append({**key, "kind": "forecast", "step": h, "date": dt, "value": float(v), "term": None, "note": None})
                    for t, v in res["terms"].items():
                        rows.append({**key, "kind": "coef", "step": None, "date": None, "value": None if v is None else float(v), "term": t, "note": None})
                yield pd.DataFrame(rows)

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [
        "kind string", "step int", "date date", "value double", "term string", "note string"])
    out = series.mapInPandas(per_batch, schema)
    fc = out.where(F.col("kind") == "forecast").select(*keys, "step", F.col("date").alias(date_col),
                                                      F.col("value").alias("forecast"))
    coef = out.where(F.col("kind") == "coef").select(*keys, "term", "value", "note")
    return fc, coef


def forecast_future_ml(info: dict, periods: int = 10, freq: str = "D", future_lags: str = "zero") -> DataFrame:
    """F6 for the ML forecaster: future dates after the last date, date features computed.

    ``future_lags`` "zero" sets lag and rolling features to 0, as the reference does; "recursive"
    appends each forecast to the last known values (as many as the longest lag or window) and
    computes the next step's features from them, one small prediction per step."""
    from strata.functions.scalar import date_features, future_dates
    f = info["train_frame"]
    dc, tgt = info["date_column"], info["target_column"]
    fut = date_features(future_dates(f.select(dc), dc, periods, freq), dc)
    made = [c for c in info["features"] if c.startswith(f"{tgt}_lag_") or c.startswith(f"{tgt}_rolling_")]
    if future_lags == "zero":
        fut = fut.select("*", *[F.lit(0.0).alias(c) for c in made])
        return info["model"].transform(fut).select(dc, F.col("prediction").alias("forecast"))
    if future_lags != "recursive":
        raise ValueError("future_lags is 'zero' or 'recursive'")
    size = {c: int(c.rsplit("_", 1)[1]) for c in made}
    known = [float(r[0]) for r in f.orderBy(F.desc(dc)).limit(max(size.values(), default=1)).select(tgt).collect()][::-1]
    spark, out = f.sparkSession, []
    base = [c for c in info["features"] if c not in made]
    for day in fut.orderBy(dc).select(dc, *base).collect():  # one row per step
        values = {c: float(day[c]) for c in base}
        for c, k in size.items():
            last = np.array(known[-k:])
            kind = "lag" if c.startswith(f"{tgt}_lag_") else c[len(f"{tgt}_rolling_"):].rsplit("_", 1)[0]
            values[c] = {"lag": lambda v: v[0], "mean": np.mean, "std": lambda v: v.std(ddof=1) if len(v) > 1 else 0.0,
                         "min": np.min, "max": np.max}[kind](last)
        row = spark.createDataFrame([tuple(float(values[c]) for c in info["features"])], ", ".join(f"`{c}` double" for c in info["features"]))
        known.append(float(info["model"].transform(row).select("prediction").first()[0]))
        out.append((day[dc], known[-1]))
    return spark.createDataFrame(out, f"`{dc}` {dict(fut.dtypes)[dc]}, forecast double")


def evaluate_forecast(info: dict, test: DataFrame) -> DataFrame:
    """rebuild features on the test frame, predict, and compute A20 metrics."""
    from strata.operators.learn import forecast_features
    from strata.operators.series import forecast_metrics
    f, _ = forecast_features(test, info["date_column"], info["target_column"])
    pred = info["model"].transform(f)
    return forecast_metrics(pred, info["target_column"], "prediction", smape=True)
