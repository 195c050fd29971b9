"""Series anomaly detection.

A task gets its series in key order as Arrow batches, and scores those of about ``HELD_ROWS`` rows
together by all methods asked for; a series is a resampled calendar (bounded length) and any
number of series run in parallel. Re-aimed methods (not the reference's libraries):

* O9  isolation forest on (value, rolling mean 5, rolling std 5, first
  difference), standardised; the rolling features are real (D4 fixed).
* O10 kernel novelty: random Fourier features of the same standardised
  features; score = similarity to the mean embedding; lowest ``nu`` share
  flagged. This is a kernel mean-embedding detector, not a one-class SVM.
* O11 reconstruction: windows of 10 values, PCA fitted on the first 80 %
  (a linear autoencoder), error per window end; first 9 points score 0.
* O12 trend + seasonality regression: piecewise-linear trend with
  changepoints (ridge-penalised) and Fourier terms; residual magnitude.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.outliers import _c

HELD_ROWS = 100_000  # of the series that a task scores together; one long series may be more


def _features(y: np.ndarray) -> np.ndarray:
    s = pd.Series(y)
    m = s.rolling(5, min_periods=5).mean()
    sd = s.rolling(5, min_periods=5).std()
    d = s.diff()
    X = pd.concat([s, m, sd, d], axis=1).bfill().fillna(0.0).to_numpy(dtype=float)
    mu, sdv = X.mean(axis=0), X.std(axis=0)
    sdv[sdv == 0] = 1.0
    return (X - mu) / sdv


def _iforest(X: np.ndarray, seed: int, n_trees: int = 100, max_samples: int = 256) -> np.ndarray:
    return _iforests([X], seed, n_trees, max_samples)[0]


class _Draws:
    """One seed's default generator, read by many series each at a place of its own, as each would read a generator."""

    def __init__(self, seed: int, series: int, most: int):
        self.raw = np.random.PCG64(seed).random_raw(most)
        self.source = np.random.PCG64(seed)
        self.begin, self.generator = self.source.state, np.random.Generator(self.source)
        self.at = np.zeros(series, dtype=np.int64)
        self.half = np.zeros(series, dtype=bool)  # the upper half of a number is left for the next integer
        self.rest = np.zeros(series, dtype=np.uint64)

    def sample(self, i: int, n: int, size: int) -> np.ndarray:
        self.source.state = self.begin
        self.source.advance(int(self.at[i]))
        if self.half[i]:
            self.source.state = {**self.source.state, "has_uint32": 1, "uinteger": int(self.rest[i])}
        out = self.generator.choice(n, size=size, replace=False)
        state = self.source.state
        self.half[i], self.rest[i] = bool(state["has_uint32"]), state["uinteger"]
        self.at[i] += np.flatnonzero(self.raw[self.at[i]:self.at[i] + 3 * size + 64] == self.source.random_raw())[0]
        return out

    def below(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """An integer from 0 to k - 1 for each series i; the only one, 0, is not drawn."""
        out = np.zeros(len(i), dtype=np.int64)
        todo = np.flatnonzero(k > 1)
        while len(todo):
            s, half = i[todo], self.half[i[todo]]
            number = self.raw[self.at[s]]
            m = np.where(half, self.rest[s], number & np.uint64(0xFFFFFFFF)) * k[todo].astype(np.uint64)
            self.rest[s] = np.where(half, self.rest[s], number >> np.uint64(32))
            self.at[s] += ~half
            self.half[s] = ~half
            out[todo] = (m >> np.uint64(32)).astype(np.int64)
            todo = todo[(m & np.uint64(0xFFFFFFFF)).astype(np.int64) < (2 ** 32 - k[todo]) % k[todo]]
        return out

    def unit(self, i: np.ndarray) -> np.ndarray:
        number = self.raw[self.at[i]]
        self.at[i] += 1
        return (number >> np.uint64(11)).astype(float) * 2.0 ** -53


def _iforests(Xs: list[np.ndarray], seed: int, n_trees: int = 100, max_samples: int = 256) -> list[np.ndarray]:
    """Isolation scores of each series by a forest of its own. Tree by tree, all series split one node at a time
    together, depth first, with the draws that each alone would make (``outliers._build_tree``)."""
    n = np.array([len(X) for X in Xs])
    psi = np.minimum(max_samples, n)
    deepest = np.array([int(math.ceil(math.log2(max(k, 2)))) for k in psi.tolist()])
    p, width, nodes, every = Xs[0].shape[1], int(psi.max()), 2 * int(psi.max()) + 1, np.arange(len(Xs))
    draws = _Draws(seed, len(Xs), n_trees * 3 * width + 4096)
    points, owner = np.concatenate(Xs), np.repeat(every, n)
    normal = np.array([_c(k) for k in range(width + 1)])
    held = np.zeros((len(Xs) * width, p))
    h = np.zeros(len(points))
    for _ in range(n_trees):
        for i, X in enumerate(Xs):
            held[i * width:i * width + psi[i]] = X[draws.sample(i, int(n[i]), int(psi[i]))]
        feat = np.full((len(Xs), nodes), -1)
        thr, left, size = np.zeros((len(Xs), nodes)), np.zeros((len(Xs), nodes), dtype=np.int64), np.zeros((len(Xs), nodes), dtype=np.int64)
        size[:, 0] = psi
        used, top = np.ones(len(Xs), dtype=np.int64), (psi > 1).astype(np.int64)
        stack = np.zeros((len(Xs), int(deepest.max()) + 2, 4), dtype=np.int64)  # first row, rows, depth, node
        stack[:, 0, 1] = psi
        while len(act := np.flatnonzero(top)):
            top[act] -= 1
            first, rows, depth, node = stack[act, top[act]].T
            start = np.cumsum(rows) - rows
            place = np.arange(start[-1] + rows[-1])
            at = np.repeat(act * width + first - start, rows) + place
            x = held[at]
            low, high = np.minimum.reduceat(x, start, axis=0), np.maximum.reduceat(x, start, axis=0)
            some = high - low > 0
            k = some.sum(axis=1)
            if not k.all():  # equal rows stay together
                ok = np.flatnonzero(k)
                if not len(ok):
                    continue
                kept = np.repeat(k > 0, rows)
                act, first, rows, depth, node, low, high, some, k, at, x = act[ok], first[ok], rows[ok], depth[ok], node[ok], low[ok], high[ok], some[ok], k[ok], at[kept], x[kept]
                start = np.cumsum(rows) - rows
                place = np.arange(len(at))
            f = (np.cumsum(some, axis=1) == draws.below(act, k)[:, None] + 1).argmax(axis=1)
            one = np.arange(len(act))
            t = low[one, f] + (high[one, f] - low[one, f]) * draws.unit(act)
            less = x[place, np.repeat(f, rows)] < np.repeat(t, rows)
            n_left = np.add.reduceat(less.astype(np.int64), start)
            before = np.cumsum(less) - less
            before -= np.repeat(before[start], rows)
            begin = np.repeat(start, rows)
            held[(at - place + begin) + np.where(less, before, np.repeat(n_left, rows) + place - begin - before)] = x
            child = used[act]
            used[act] += 2
            feat[act, node], thr[act, node], left[act, node] = f, t, child
            size[act, child], size[act, child + 1] = n_left, rows - n_left
            for begin, count, c in ((first + n_left, rows - n_left, child + 1), (first, n_left, child)):  # the left one is next
                push = np.flatnonzero((count > 1) & (depth + 1 < deepest[act]))
                to = act[push]
                stack[to, top[to]] = np.stack([begin[push], count[push], depth[push] + 1, c[push]], axis=1)
                top[to] += 1
        feat, thr, left, size = feat.ravel(), thr.ravel(), left.ravel(), size.ravel()
        base = owner * nodes
        node, depth, go = base.copy(), np.zeros(len(points)), np.arange(len(points))
        while len(go):
            at = node[go]
            inner = feat[at] >= 0
            go, at = go[inner], at[inner]
            node[go] = base[go] + left[at] + ~(points[go, feat[at]] < thr[at])
            depth[go] += 1
        h += depth + normal[size[node]]
    return [np.power(2.0, -(part / n_trees) / _c(k)) for part, k in zip(np.split(h, np.cumsum(n)[:-1]), psi.tolist(), strict=True)]


def _flag_top(score: np.ndarray, share: float) -> np.ndarray:
    thr = np.percentile(score, 100 * (1 - share))
    return score > thr


def score_iforest(y, contamination=0.1, seed=42):
    s = _iforest(_features(y), seed)
    return s, _flag_top(s, contamination)


def score_kernel_novelty(y, nu=0.1, gamma=None, n_components=100, seed=42):
    X = _features(y)
    g = gamma if gamma is not None else 1.0 / (X.shape[1] * max(X.var(), 1e-12))
    rng = np.random.default_rng(seed)
    W = rng.normal(0, math.sqrt(2 * g), size=(X.shape[1], n_components))
    b = rng.uniform(0, 2 * math.pi, n_components)
    Z = math.sqrt(2.0 / n_components) * np.cos(X @ W + b)
    sim = Z @ Z.mean(axis=0)
    score = -sim
    return score, _flag_top(score, nu)


def score_reconstruction(y, sequence_length=10, contamination=0.1, n_components=3, train_fraction=0.8):
    n = len(y)
    score = np.zeros(n)
    if n <= sequence_length:
        return score, np.zeros(n, dtype=bool)
    mu, sd = np.mean(y), np.std(y) or 1.0
    z = (y - mu) / sd
    W = np.lib.stride_tricks.sliding_window_view(z, sequence_length)
    ntr = max(1, int(len(W) * train_fraction))
    mean = W[:ntr].mean(axis=0)
    U, S, Vt = np.linalg.svd(W[:ntr] - mean, full_matrices=False)
    V = Vt[:min(n_components, Vt.shape[0])].T
    R = (W - mean) @ V @ V.T + mean
    err = ((W - R) ** 2).mean(axis=1)
    score[sequence_length - 1:] = err
    return score, _flag_top(score, contamination)


def score_trend_season(y, t_days, contamination=0.1, changepoint_prior_scale=0.05, n_changepoints=25):
    n = len(y)
    t = (t_days - t_days.min()) / max(t_days.max() - t_days.min(), 1.0)
    mu, sd = y.mean(), y.std() or 1.0
    yy = (y - mu) / sd
    cps = np.quantile(t[: max(2, int(0.8 * n))], np.linspace(0, 1, n_changepoints + 2)[1:-1]) if n > 3 else []
    cols = [np.ones(n), t] + [np.maximum(0, t - c) for c in cps]
    pen = [0.0, 0.0] + [1.0 / changepoint_prior_scale ** 2 * 1e-3] * len(cps)
    span = t_days.max() - t_days.min()
    for period, order in ((7.0, 3), (365.25, 10)):
        if span >= 2 * period:
            for k in range(1, order + 1):
                cols += [np.sin(2 * math.pi * k * t_days / period), np.cos(2 * math.pi * k * t_days / period)]
                pen += [1e-3, 1e-3]
    X = np.column_stack(cols)
    beta = np.linalg.solve(X.T @ X + np.diag(pen), X.T @ yy)
    resid = np.abs(yy - X @ beta)
    return resid, _flag_top(resid, contamination)


def _fill(y: np.ndarray) -> np.ndarray:
    s = pd.Series(y, dtype=float)
    return s.interpolate(method="linear", limit_direction="forward").ffill().bfill().to_numpy()


METHODS = ("isolation_forest", "one_class_svm", "statistical", "lstm_autoencoder", "prophet")


def detect_series(df: DataFrame, order_col: str, value_col: str, key_cols=(), method: str = "isolation_forest",
                  contamination: float = 0.1, z_threshold: float = 3.0, window_size: int = 5,
                  seed: int = 42) -> DataFrame:
    """One method over every series: (keys, order, value, score, is_anomaly, method).

    Method names follow the reference: isolation_forest (O9), one_class_svm (O10, kernel
    novelty), statistical (W10 rolling z-score), lstm_autoencoder (O11, PCA reconstruction),
    prophet (O12, trend + seasonality regression). ``key_cols`` name the series: one group each."""
    flags = _detected(df, order_col, value_col, key_cols, [method], contamination, z_threshold, window_size, seed)
    return flags.drop("error")


def _firsts(cols: list[pa.Array]) -> np.ndarray:
    """The first row of each run of equal keys."""
    new = np.zeros(max(len(cols[0]) - 1, 0), dtype=bool)
    for c in cols:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        other = pc.not_equal(a, b)
        if pa.types.is_floating(c.type):
            other = pc.and_(other, pc.invert(pc.and_(pc.is_nan(a), pc.is_nan(b))))
        other = pc.or_(pc.fill_null(other, False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new |= other.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _detected(df, order_col, value_col, key_cols, methods, contamination, z_threshold, window_size=5, seed=42, capture=False) -> DataFrame:
    """``detect_series`` for several methods with an ``error`` column; with ``capture`` a failing series gives one
    row with its error instead of failing the job."""
    keys, methods = list(key_cols), list(methods)
    if not keys:
        raise ValueError("key_cols must name the series")
    sel = df.select(*keys, F.col(order_col).alias("__t"), F.col(value_col).cast("double").alias("__y"))
    types = dict(sel.dtypes)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    def one(method: str, y: np.ndarray, t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if method == "one_class_svm":
            return score_kernel_novelty(y, contamination, seed=seed)
        if method == "lstm_autoencoder":
            return score_reconstruction(y, 10, contamination)
        if method == "prophet":
            days = t.to_pandas()
            if pa.types.is_timestamp(t.type):
                days = (days.dt.tz_convert(zone).dt.tz_localize(None) if t.type.tz else days).astype("datetime64[ns]")
            return score_trend_season(y, pd.to_datetime(days).astype("int64").to_numpy() / 86400e9, contamination)
        if method == "statistical":
            ser = pd.Series(y)
            m = ser.rolling(window_size).mean().ffill().bfill()
            sd = ser.rolling(window_size).std().ffill().bfill()
            z = ((ser - m).abs() / sd).where(sd != 0, 0.0).fillna(0.0)
            return z.to_numpy(), (z > z_threshold).to_numpy()
        raise ValueError(method)

    def scored(t: pa.Table, firsts: np.ndarray):
        """One table per method."""
        cuts = list(zip(firsts.tolist(), [*firsts[1:].tolist(), t.num_rows], strict=True))
        values = t["__y"].to_numpy().astype(float)
        ys = [_fill(values[a:b]) for a, b in cuts]
        for method in methods:
            found: list = [None] * len(cuts)
            if method == "isolation_forest":
                found = [(s, _flag_top(s, contamination)) for s in _iforests([_features(y) for y in ys], seed)]
            else:
                for i, (a, b) in enumerate(cuts):
                    try:
                        found[i] = one(method, ys[i], t["__t"].slice(a, b - a))
                    except Exception as e:  # noqa: BLE001 - per-series capture, like the reference's per-method one
                        if not capture:
                            raise
                        found[i] = str(e)[:200]
            bad = [isinstance(f, str) for f in found]
            size = [1 if e else b - a for e, (a, b) in zip(bad, cuts, strict=True)]
            rows = t.select([*keys, "__t"]).take(pa.array(np.concatenate([np.arange(a, a + k) for (a, _), k in zip(cuts, size, strict=True)])))
            none = [np.full(1, np.nan)]
            floats = [pa.array(np.concatenate([none[0] if e else v for e, v in zip(bad, part, strict=True)]).astype(float), from_pandas=True)
                      for part in (ys, [f[0] for f in found])]
            flag = pa.array(np.concatenate([[False] if e else f[1] for e, f in zip(bad, found, strict=True)]).astype(bool), mask=np.repeat(bad, size))
            error = pa.array([f if e else None for e, f in zip(bad, found, strict=True)], pa.string()).take(pa.array(np.repeat(np.arange(len(cuts)), size)))
            yield pa.table([*rows.columns, *floats, flag, pa.array([method] * len(flag), pa.string()), error],
                           names=[*keys, "__t", "value", "score", "is_anomaly", "method", "error"])

    def per_task(batches):
        held, rows, most = [], 0, HELD_ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            firsts = _firsts([t[k].combine_chunks() for k in keys])
            if len(firsts) > 1:  # the last series may go on in the next batch
                for out in scored(t.slice(0, firsts[-1]), firsts[:-1]):
                    yield from out.to_batches()
            t = t.slice(firsts[-1])
            held, rows, most = t.to_batches(), t.num_rows, max(HELD_ROWS, 2 * t.num_rows)
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            for out in scored(t, _firsts([t[k].combine_chunks() for k in keys])):
                yield from out.to_batches()

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"__t {types['__t']}", "value double", "score double",
                                                              "is_anomaly boolean", "method string", "error string"])
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)  # few rows, much work: not coalesced
    res = sel.repartition(tasks, *keys).sortWithinPartitions(*keys, F.col("__t").asc_nulls_last()).mapInArrow(per_task, schema)
    return res.withColumnRenamed("__t", order_col)


def anomaly_ensemble(df: DataFrame, order_col: str, value_col: str, key_cols=(),
                     methods=("isolation_forest", "statistical"), vote: str = "any", **kw) -> DataFrame:
    """Combine method flags per point: any (reference OR), majority or all."""
    keys = list(key_cols)
    parts = [detect_series(df, order_col, value_col, keys, m, **kw).select(
        *keys, order_col, "value", F.col("is_anomaly").alias(f"f_{m}")) for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.drop("value"), [*keys, order_col])
    flags = [F.col(f"f_{m}").cast("int") for m in methods]
    need = {"any": 1, "all": len(methods), "majority": len(methods) // 2 + 1}[vote]
    return out.withColumn("is_anomaly", sum(flags, F.lit(0)) >= need)


def detect_anomalies(df: DataFrame, order_col: str, value_col: str, key_cols=(), methods=None,
                     contamination: float = 0.1, z_threshold: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Validate (column present, series of >= 10 points that aren't constant), run each method on
    every valid series with an error captured per series, and summarise (A22) per series and method.

    Returns (flags of all methods, summary with an ``error`` column)."""
    methods = list(methods or ["isolation_forest", "statistical"])
    if value_col not in df.columns:
        raise ValueError(f"target column '{value_col}' not found")
    keys = list(key_cols)
    stats = df.groupBy(*keys).agg(F.count(value_col).alias("n"), F.stddev_pop(value_col).alias("sd"))
    good = df.join(stats.where((F.col("n") >= 10) & (F.col("sd") > 0)).select(*keys), keys, "left_semi")
    every = _detected(good, order_col, value_col, keys, methods, contamination, z_threshold, capture=True)
    total = F.count_if(F.col("error").isNull())
    summary = every.groupBy(*keys, "method").agg(
        total.alias("total_points"), F.count_if("is_anomaly").alias("anomaly_count"),
        F.try_divide(F.count_if("is_anomaly") * 100.0, total.cast("double")).alias("anomaly_percentage"), F.max("error").alias("error"))
    return every.where("error IS NULL").drop("error"), summary
