"""Series models: recovery of known processes, exact Holt-Winters, captured errors, recursion."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.operators import anomaly as AN
from strata.operators import forecast as FC
from strata.operators import learn as L


def test_no_constant_after_differencing():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=400)) + 50
    r = FC.fit_arima_hr(y, (1, 1, 1))
    assert "const" not in r["terms"] and "const" in FC.fit_arima_hr(np.diff(y), (1, 0, 0))["terms"]
    assert abs(r["forecast"][-1] - y[-1]) < 3  # no drift


def test_ar_recovery():
    rng = np.random.default_rng(1)
    y = np.zeros(4000)
    for t in range(1, len(y)):
        y[t] = 2 + 0.7 * y[t - 1] + rng.normal()
    terms = FC.fit_arima_hr(y, (1, 0, 0))["terms"]
    assert abs(terms["ar.L1"] - 0.7) < 0.05 and abs(terms["const"] - 2) < 0.35


def test_exogenous_columns_are_differenced_like_the_target():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=600))
    y = 3 * x + rng.normal(size=600) * 0.1 + 10
    future = x[-1] + np.cumsum(np.ones(5))
    r = FC.fit_arima_hr(y, (1, 1, 1), exog=x[:, None], exog_future=future[:, None], steps=5)
    assert abs(r["terms"]["exog0"] - 3) < 0.05
    assert np.allclose(r["forecast"], 3 * future + 10, atol=1.0)


def _plain_holt_winters(y, a, b, g, m):
    level, slope = y[:m].mean(), (y[m:2 * m].mean() - y[:m].mean()) / m
    season, sse = list(y[:m] - level), 0.0
    for t, v in enumerate(y):
        s = season[t % m]
        sse += (v - level - slope - s) ** 2
        new = a * (v - s) + (1 - a) * (level + slope)
        slope = b * (new - level) + (1 - b) * slope
        season[t % m] = g * (v - new) + (1 - g) * s
        level = new
    return sse, level, slope, season


def test_holt_winters_grid_equals_a_plain_recursion(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(4):
        y = 10 + np.arange(48) * 0.3 + 5 * np.sin(np.arange(48) * 2 * np.pi / 12) + rng.normal(size=48)
        days = pd.date_range("2020-01-31", periods=48, freq="ME")
        rows += [(k, d.date(), float(v)) for d, v in zip(days, y)]
        grid = (0.1, 0.3, 0.5, 0.7, 0.9)
        sse, a, b, g = min(((_plain_holt_winters(y, a, b, g, 12)[0], a, b, g) for a in grid for b in grid for g in grid))
        _, level, slope, season = _plain_holt_winters(y, a, b, g, 12)
        want[k] = [level + h * slope + season[(48 + h - 1) % 12] for h in range(1, 11)]
    df = spark.createDataFrame(rows, "k int, d date, y double")
    got = FC.forecast_series(df, "d", "y", ("k",), "holt_winters", 10, "M", refine=False)[0].toPandas()
    for k, g in got.groupby("k"):
        assert np.allclose(g.sort_values("step")["y" if "y" in g else "forecast"], want[k])
    assert got["d"].max() == pd.Timestamp("2024-10-31").date()


def test_frequencies(spark):
    df = spark.createDataFrame([(1, (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(i % 5)) for i in range(40)], "k int, d timestamp, y double")
    ends = {f: FC.forecast_series(df, "d", "y", ("k",), "arima", 2, f)[0].orderBy("step").toPandas()["d"].tolist() for f in ("D", "W", "Q")}
    assert [str(x) for x in ends["Q"]] == ["2020-03-31", "2020-06-30"] and [str(x) for x in ends["W"]] == ["2020-02-16", "2020-02-23"]
    with pytest.raises(ValueError):
        FC.forecast_series(df, "d", "y", ("k",), "arima", 2, "fortnight")
    with pytest.raises(ValueError):
        FC.forecast_series(df, "d", "y", (), "arima")


def test_errors_are_captured_per_series(spark):
    df = spark.createDataFrame([(k, i, float((i * 7 + k) % 11)) for k in range(3) for i in range(30)], "k int, t int, y double")
    flags, summary = AN.detect_anomalies(df, "t", "y", ("k",), ["statistical", "nonsense"])
    s = summary.toPandas().set_index(["k", "method"])
    assert (s.xs("statistical", level=1)["total_points"] == 30).all() and s.xs("statistical", level=1)["error"].isna().all()
    assert s.xs("nonsense", level=1)["error"].notna().all() and (s.xs("nonsense", level=1)["total_points"] == 0).all()
    assert flags.count() == 90


def test_recursive_forecast_feeds_itself(spark):
    days = pd.date_range("2021-01-01", periods=120)
    y = [float(np.sin(i / 5) * 10 + i * 0.1) for i in range(120)]
    df = spark.createDataFrame([(d.date(), v) for d, v in zip(days, y)], "ds date, y double")
    info = L.forecast_ml_train(df, "ds", "y", "linear")
    got = FC.forecast_future_ml(info, 6, "D", "recursive").orderBy("ds").toPandas()
    # the second step's lag 1 is the first step's forecast
    f = info["train_frame"].orderBy(F.desc("ds")).limit(1).select(*info["features"]).toPandas()
    first = got["forecast"].iloc[0]
    one = FC.forecast_future_ml(info, 1, "D", "recursive").toPandas()["forecast"].iloc[0]
    assert np.isclose(first, one) and len(f) == 1
    longer = spark.createDataFrame([(d.date(), v) for d, v in zip(pd.date_range("2021-01-01", periods=121), [*y, float(first)])], "ds date, y double")
    again = L.forecast_features(longer, "ds", "y")[0]
    again = FC.forecast_future_ml({**info, "train_frame": again}, 1, "D", "recursive").toPandas()["forecast"].iloc[0]
    assert np.isclose(again, got["forecast"].iloc[1])
    assert len(set(got["forecast"].round(6))) == 6 and got["forecast"].between(-20, 40).all()
    step = got["forecast"].diff().abs().max()
    assert step < 8


def test_likelihood_is_the_closed_one_of_ar1():
    from strata.operators import statespace as SS
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3, 50))
    for phi in (-0.8, 0.0, 0.7):
        got = SS.likelihood(np.full((3, 1), phi), np.zeros((3, 0)), z[:, :, None], np.array([50, 50, 31]))["llf"]
        for i, n in enumerate((50, 50, 31)):
            v = z[i, :n]
            s2 = ((1 - phi ** 2) * v[0] ** 2 + ((v[1:] - phi * v[:-1]) ** 2).sum()) / n
            assert np.isclose(got[i], -n / 2 * (np.log(2 * np.pi * s2) + 1) + 0.5 * np.log(1 - phi ** 2))


def test_likelihood_is_that_of_the_whole_covariance():
    """A seasonal model with a regressor against the multivariate normal density."""
    from strata.operators import statespace as SS
    rng = np.random.default_rng(1)
    n, model = 40, SS.Model((1, 0, 1), (1, 0, 1, 4))
    x = np.array([[0.4, -0.3, 0.5, 0.2]])
    phi, theta, _ = model.polynomials(x)
    impulse = np.zeros(4000)
    impulse[0] = 1
    for t in range(1, len(impulse)):
        impulse[t] = (theta[0][t - 1] if t <= theta.shape[1] else 0) + sum(p * impulse[t - 1 - i] for i, p in enumerate(phi[0]) if t > i)
    auto = np.array([(impulse[:len(impulse) - k] * impulse[k:]).sum() for k in range(n)])
    cov = auto[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    z, ex = rng.normal(size=n), rng.normal(size=(n, 2))
    inv = np.linalg.inv(cov)
    beta = np.linalg.solve(ex.T @ inv @ ex, ex.T @ inv @ z)
    e = z - ex @ beta
    s2 = e @ inv @ e / n
    got = SS.likelihood(phi, theta, np.column_stack([z, ex])[None], np.array([n]))
    assert np.allclose(got["beta"][0], beta) and np.isclose(got["sigma2"][0], s2)
    assert np.isclose(got["llf"][0], -n / 2 * (np.log(2 * np.pi * s2) + 1) - 0.5 * np.linalg.slogdet(cov)[1])


def test_exact_fit_recovers_parameters_and_forecasts():
    rng = np.random.default_rng(4)
    ys = []
    for _ in range(6):
        e = rng.normal(size=1700)
        z = np.zeros(1700)
        for t in range(1, 1700):
            z[t] = 0.6 * z[t - 1] + e[t] + 0.4 * e[t - 1]
        ys.append(z[200:] * 1e6 + 5e6)
    got = FC.fit_arima_batch([*ys, np.ones(3), np.full(30, 7.0)], (1, 0, 1), steps=4)
    for y, r in zip(ys, got, strict=False):
        t = r["terms"]
        assert abs(t["ar.L1"] - 0.6) < 0.08 and abs(t["ma.L1"] - 0.4) < 0.08 and abs(t["const"] - 5e6) < 5e5 and abs(t["sigma2"] / 1e12 - 1) < 0.15
        step = np.diff(r["forecast"] - t["const"]) / (r["forecast"][:-1] - t["const"])
        assert np.allclose(step, t["ar.L1"] - 1)  # beyond one step only the ar part is left
    assert isinstance(got[6], ValueError) and np.allclose(got[7]["forecast"], 7)
    walk = np.cumsum(rng.normal(size=300)) + 50
    alone, other = FC.fit_arima_batch([walk], (1, 1, 1))[0], FC.fit_arima_batch([ys[0][:90], walk], (1, 1, 1))[1]
    assert np.allclose(alone["forecast"], other["forecast"], rtol=1e-4)
    x = np.cumsum(rng.normal(size=400))
    future = (x[-1] + np.arange(1, 6))[:, None]
    r = FC.fit_arima_batch([3 * x + rng.normal(size=400) * 0.1 + 10], (1, 1, 1), exog=[x[:, None]], exog_future=[future], steps=5)[0]
    assert abs(r["terms"]["exog0"] - 3) < 0.05 and np.allclose(r["forecast"], 3 * future[:, 0] + 10, atol=1)


def test_exact_fit_is_never_worse_than_least_squares():
    from strata.operators import statespace as SS
    rng = np.random.default_rng(6)
    y = np.cumsum(rng.normal(size=150)) + 3 * np.sin(np.arange(150) * np.pi / 6)
    r = FC.fit_arima_batch([y], (1, 1, 1), (1, 1, 1, 12))[0]
    z = FC._difference(y, 1, 1, 12)
    model = SS.Model((1, 1, 1), (1, 1, 1, 12))
    zero = SS.likelihood(*model.polynomials(np.zeros((1, 4)))[:2], z[None, :, None], np.array([len(z)]))["llf"][0]
    assert r["terms"]["llf"] > zero and {"ar.L1", "ma.L1", "ar.S.L12", "ma.S.L12"} <= set(r["terms"])


def test_smoothing_search_beats_its_grid():
    rng = np.random.default_rng(8)
    ys = [10 + np.arange(n) * 0.3 + 5 * np.sin(np.arange(n) * 2 * np.pi / 12) + rng.normal(size=n) + 20 for n in (48, 60, 91)]
    for trend, season in (("add", "add"), ("add", "mul"), (None, "add"), ("mul", None), (None, None)):
        fine, coarse = (FC.fit_holt_winters_batch(ys, trend, season, 12, 5, refine=r) for r in (True, False))
        for y, a, b in zip(ys, fine, coarse, strict=True):
            assert a["terms"]["sse"] <= b["terms"]["sse"] * (1 + 1e-12)
            alone = FC.fit_holt_winters_batch([y], trend, season, 12, 5)[0]
            assert np.allclose(alone["forecast"], a["forecast"]) and all(0 <= a["terms"][k] <= 1 for k in ("smoothing_level",))
    assert isinstance(FC.fit_holt_winters_batch([np.array([1.0, -1, 2, 3])], None, "mul", 2, 1)[0], ValueError)


def test_adf_statistic_and_p_value(spark):
    """Against plain least squares per lag, and the known 1, 5 and 10 % points."""
    from strata.operators import series as SE
    assert [round(SE.adf_p_value(t), 3) for t in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.099]
    assert SE.adf_p_value(3) == 1 and SE.adf_p_value(-30) == 0 and 0.95 < SE.adf_p_value(0.0) < 0.97
    rng = np.random.default_rng(0)
    ar = np.zeros(300)
    for t in range(1, 300):
        ar[t] = 0.5 * ar[t - 1] + rng.normal()
    series = {"walk": np.cumsum(rng.normal(size=300)) + 1e6, "ar": ar + 1e5, "flat": np.full(20, 3.0)}
    df = spark.createDataFrame([(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)], "k string, t int, v double")
    got = {r["k"]: r for r in SE.adf_stationarity(df, "t", "v", partition_cols=("k",)).collect()}
    assert got["ar"]["stationary"] and not got["walk"]["stationary"] and got["flat"]["p_value"] is None
    for k in ("walk", "ar"):
        y, p = series[k], got[k]["used_lag"]
        dy = np.diff(y)
        idx = np.arange(p, len(dy))
        x = np.column_stack([np.ones(len(idx)), y[idx] - y.mean()] + [dy[idx - j] for j in range(1, p + 1)])
        beta, rss, *_ = np.linalg.lstsq(x, dy[idx], rcond=None)
        se = np.sqrt(rss[0] / (len(idx) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        assert np.isclose(got[k]["adf_stat"], beta[1] / se)
