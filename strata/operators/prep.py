"""Imputation, scaling, encoding and feature transforms.

Pattern everywhere: *fit* = one aggregate whose result is bounded by the
number of columns (or categories, checked), *transform* = a projection with
the fitted constants as literals. The projection is a single ``select`` so
it stays inside one whole-stage-codegen span and needs no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.stats import exact_quantiles, kurt_corrected, numeric_cols, skew_corrected
from strata.operators.profile import distinct_and_mode

MAX_ONEHOT = 10


def _num_cols(df: DataFrame, cols=None) -> list[str]:
    return list(cols) if cols else numeric_cols(df, include_decimal=False)


def _cat_cols(df: DataFrame, cols=None, include_bool: bool = True) -> list[str]:
    if cols:
        return list(cols)
    return [c for c, t in df.dtypes if t == "string" or (include_bool and t == "boolean")]


def _apply(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Replace / add columns in one projection."""
    out = [exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns]
    out += [e.alias(c) for c, e in exprs.items() if c not in df.columns]
    return df.select(*out)


# ------------------------------------------------------------------ imputation

def fit_simple_imputer(df: DataFrame, num=None, cat=None) -> dict:
    """I1 fit: numeric -> median when |skew| > 1 else mean; categorical -> mode or 'Unknown'.

    Only columns with nulls get a value (as in the reference)."""
    num, cat = _num_cols(df, num), _cat_cols(df, cat)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(num + cat)],
                 *[F.avg(c).alias(f"mu{i}") for i, c in enumerate(num)],
                 *[skew_corrected(F.col(c).cast("double")).alias(f"sk{i}") for i, c in enumerate(num)]).first()
    info = {}
    need_median = [c for i, c in enumerate(num) if row[f"m{i}"] > 0 and row[f"sk{i}"] is not None
                   and abs(row[f"sk{i}"]) > 1]
    med = exact_quantiles(df, need_median, [0.5]) if need_median else {}
    for i, c in enumerate(num):
        if row[f"m{i}"] > 0:
            if c in need_median:
                info[c] = ("median", med[(c, 0.5)])
            else:
                info[c] = ("mean", row[f"mu{i}"])
    cat_missing = [c for j, c in enumerate(cat) if row[f"m{len(num) + j}"] > 0]
    if cat_missing:
        modes = {r["column"]: r["most_frequent"] for r in distinct_and_mode(df, cat_missing).collect()}
        for c in cat_missing:
            info[c] = ("mode", modes.get(c) if modes.get(c) is not None else "Unknown")
    return info


def impute_simple(df: DataFrame, num=None, cat=None) -> DataFrame:
    """Fill with the fitted mean / median / mode."""
    info = fit_simple_imputer(df, num, cat)
    types = dict(df.dtypes)
    exprs = {}
    for c, (_, v) in info.items():
        lit = F.lit(v)
        if types[c] == "boolean" and isinstance(v, str):
            lit = F.lit(v).cast("boolean")
        exprs[c] = F.coalesce(F.col(c), lit.cast(types[c]) if types[c] != "string" else lit)
    return _apply(df, exprs)


def choose_imputation_strategy(total_missing_pct: float) -> str:
    """I2 rule: <5 simple, <20 knn, <40 iterative, else model."""
    if total_missing_pct < 5:
        return "simple"
    if total_missing_pct < 20:
        return "knn"
    if total_missing_pct < 40:
        return "iterative"
    return "model"


def total_missing_pct(df: DataFrame) -> float:
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}")
                                                  for i, c in enumerate(cols)]).first()
    n = row["n"]
    if not n:
        return 0.0
    return sum(row[f"m{i}"] for i in range(len(cols))) * 100.0 / (n * len(cols))


def impute_auto(df: DataFrame, order_col: str | None = None, **kw) -> tuple[str, DataFrame]:
    """Pick the strategy from the cell-missing percentage, then run it."""
    strategy = choose_imputation_strategy(total_missing_pct(df))
    if strategy == "simple":
        return strategy, impute_simple(df)
    if strategy == "knn":
        from strata.operators.neighbors import impute_knn
        return strategy, impute_knn(df, id_col=kw.get("id_col", order_col))
    if strategy == "iterative":
        return strategy, impute_iterative(df)
    from strata.operators.learn import impute_model
    return strategy, impute_model(df)


MOST_PATTERNS = 4096  # of missing columns; each is one row of k * k / 2 sums on the driver


def _bayes_ridge(g: np.ndarray, n: float, y: int, xs: list[int]) -> np.ndarray:
    """(intercept, coefficients) of Bayesian ridge regression from a Gram matrix of (1, columns), by the usual
    evidence updates: noise and weight precision with flat priors, until the coefficients move by
    less than 1e-3 in sum, at most 300 rounds."""
    mean = g[0] / n
    c = g - n * np.outer(mean, mean)  # centred
    xx, xy, yy = c[np.ix_(xs, xs)], c[xs, y], c[y, y]
    eig, vec = np.linalg.eigh((xx + xx.T) / 2)
    eig = np.maximum(eig, 0.0)
    turned = vec.T @ xy
    noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    tiny, old = 1e-6, None
    solve = lambda: vec @ np.where(eig + weight / noise > 0, turned / np.maximum(eig + weight / noise, 1e-300), 0.0)
    for _ in range(300):
        w = solve()
        rss = max(float(yy - 2 * w @ xy + w @ xx @ w), 0.0)
        used = float(np.sum(noise * eig / (weight + noise * eig)))
        weight = (used + 2 * tiny) / (float(w @ w) + 2 * tiny)
        noise = (n - used + 2 * tiny) / (rss + 2 * tiny)
        if old is not None and np.abs(w - old).sum() < 1e-3:
            break
        old = w
    w = solve()
    return np.concatenate([[mean[y] - mean[xs] @ w], w])


def impute_iterative(df: DataFrame, cols=None, max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """I4: round-robin regression imputation by Bayesian ridge, on sufficient statistics.

    Start from column means; each round, for every column with nulls (fewest missing first), regress it on
    the other columns over the rows where it is observed and replace its missing cells, until no column's
    missing cells move by more than ``tol`` of its size (root mean square), at most ``max_iter`` rounds.

    Rows with the same missing columns are all completed by one affine map of their observed values, so the Gram
    matrix of the completed rows follows from that of the observed ones. Two jobs do for all columns and
    rounds: means and deviations, and one Gram matrix per missing pattern (a partial aggregate); the
    rounds run on the driver on these matrices, and a last projection applies each pattern's map. More than
    ``MOST_PATTERNS`` patterns are refused. A column without any value stays null."""
    cols = _num_cols(df, cols)
    x = [F.col(c).cast("double") for c in cols]
    first = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count))], F.count(F.lit(1)).alias("rows")).first()
    known = [i for i in range(len(cols)) if first[f"n{i}"]]
    targets = sorted((i for i in known if first[f"n{i}"] < first["rows"]), key=lambda i: -first[f"n{i}"])
    if not targets or len(known) < 2:
        return _apply(df, {cols[i]: F.coalesce(x[i], F.lit(first[f"m{i}"])) for i in targets}) if targets else df
    k = len(known)
    mean = np.array([first[f"m{i}"] for i in known])
    size = np.array([first[f"s{i}"] or 1.0 for i in known])
    missing = F.concat(*[F.when(x[i].isNull(), "1").otherwise("0") for i in known])
    z = [F.lit(1.0)] + [F.coalesce((x[i] - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) for i, m, s in zip(known, mean, size, strict=True)]
    names = [f"z{i}" for i in range(k + 1)]
    rows = df.select(missing.alias("p"), *[c.alias(n) for c, n in zip(z, names, strict=True)]).groupBy("p").agg(
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of missing columns")
    grams, maps = {}, {}
    for r in rows:
        g = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        grams[r["p"]] = g
        maps[r["p"]] = np.eye(k + 1)  # observed and centred (a missing cell is 0, its mean) -> completed
    scale = np.diag(np.concatenate([[1.0], size]))  # the prior is not free of scale: fit in the columns' own units
    for _ in range(max_iter):
        moved = 0.0
        for t in targets:
            y = known.index(t) + 1
            xs = [j for j in range(1, k + 1) if j != y]
            g = sum((maps[p] @ grams[p] @ maps[p].T for p in grams if p[y - 1] == "0"), np.zeros((k + 1, k + 1)))
            beta = _bayes_ridge(scale @ g @ scale, g[0, 0], y, xs)
            row = np.zeros(k + 1)
            row[[0, *xs]] = np.concatenate([[beta[0]], beta[1:] * size[[j - 1 for j in xs]]]) / size[y - 1]
            change = n = 0.0
            for p in grams:
                if p[y - 1] == "1":
                    new = row @ maps[p]
                    d = new - maps[p][y]
                    change, n = change + float(d @ grams[p] @ d), n + grams[p][0, 0]
                    maps[p][y] = new
            moved = max(moved, math.sqrt(max(change, 0.0) / n))
        if moved <= tol:
            break
    filled = {}
    for t in targets:
        y = known.index(t) + 1
        cases = None
        for p in grams:
            if p[y - 1] == "1":
                value = F.lit(float(mean[y - 1] + size[y - 1] * maps[p][y][0]))
                for j in range(1, k + 1):
                    if p[j - 1] == "0":
                        value = value + F.lit(float(maps[p][y][j] * size[y - 1])) * z[j]
                cases = F.when(missing == p, value) if cases is None else cases.when(missing == p, value)
        filled[cols[t]] = F.coalesce(x[t], cases)
    return _apply(df, filled)


def missing_indicator(df: DataFrame, cols: list[str], suffix: str = "_missing") -> DataFrame:
    """I8: 0/1 null flags."""
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}{suffix}") for c in cols])


def clean_for_ml(df: DataFrame, target: str | None = None, features: list[str] | None = None,
                 max_missing_ratio: float = 0.5, min_samples: int = 10, handle_missing: str = "auto",
                 order_col: str | None = None) -> tuple[DataFrame | None, dict]:
    """Validate and clean a table for learning.

    Errors when rows < min_samples or columns are absent; with ``auto`` drops feature
    columns above the null limit and fills numeric columns with their median and text
    columns with their mode ('unknown' when none); ``drop`` removes rows with nulls;
    ``impute`` interpolates numeric columns linearly (by ``order_col``) then ffill/bfill.
    Returns (clean frame or None, report dict).
    """
    report = {"errors": [], "warnings": [], "missing_handled": {}}
    n = df.count()
    if n == 0:
        report["errors"].append("empty")
        return None, report
    if n < min_samples:
        report["errors"].append(f"rows {n} < min_samples {min_samples}")
        return None, report
    types = dict(df.dtypes)
    if features is None:
        features = [c for c in numeric_cols(df) if c != target]
    if target and target not in df.columns:
        report["errors"].append(f"target '{target}' not found")
        return None, report
    missing_feats = [c for c in features if c not in df.columns]
    if missing_feats:
        report["errors"].append(f"features not found: {missing_feats}")
        return None, report
    check = features + ([target] if target else [])
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(check)]).first()
    ratio = {c: row[f"m{i}"] / n for i, c in enumerate(check)}
    high = [c for c in check if ratio[c] > max_missing_ratio]
    out = df
    if high:
        report["warnings"].append(f"columns with missing > {max_missing_ratio:.0%}: {high}")
        if handle_missing == "auto":
            out = out.drop(*high)
            report["missing_handled"]["dropped_columns"] = high
            features = [c for c in features if c not in high]
    if handle_missing == "auto":
        fill_cols = [c for c in features + ([target] if target and target not in high else []) if ratio[c] > 0]
        nums = [c for c in fill_cols if types[c] in ("int", "bigint", "double", "float")]
        strs = [c for c in fill_cols if types[c] == "string"]
        med = exact_quantiles(out, nums, [0.5]) if nums else {}
        modes = {r["column"]: r["most_frequent"] for r in distinct_and_mode(out, strs).collect()} if strs else {}
        exprs = {}
        for c in nums:
            exprs[c] = F.coalesce(F.col(c), F.lit(med[(c, 0.5)]).cast(types[c]))
            report["missing_handled"][c] = f"filled_with_median({med[(c, 0.5)]:.2f})"
        for c in strs:
            v = modes.get(c) or "unknown"
            exprs[c] = F.coalesce(F.col(c), F.lit(v))
            report["missing_handled"][c] = f"filled_with_mode({v})"
        out = _apply(out, exprs)
    elif handle_missing == "drop":
        out = out.na.drop(subset=check)
    elif handle_missing == "impute":
        from strata.operators.windows import ffill, bfill, interpolate_linear
        if order_col is None:
            raise ValueError("impute needs order_col: Spark rows have no implicit order")
        for c in check:
            if ratio[c] > 0 and types[c] in ("int", "bigint", "double", "float"):
                out = interpolate_linear(out, c, order_col)
                out = out.withColumn(c, F.coalesce(ffill(c, order_col), bfill(c, order_col)))
                report["missing_handled"][c] = "interpolated_and_filled"
    return out, report


def prep_for_attribution(df: DataFrame, method: str = "shap", max_missing_ratio: float = 0.3) -> DataFrame:
    """SHAP input = all categoricals one-hot (no drop) + median fill; LIME input = drop
    columns over 30 % null, median / mode fill, categoricals kept; then +-inf -> median."""
    from strata.operators.relational import inf_to_median
    num = _num_cols(df)
    cat = _cat_cols(df)
    out = df
    if method == "lime":
        n = df.count()
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
        drop = [c for c in df.columns if n and row[c] / n > max_missing_ratio]
        out = out.drop(*drop)
        num = [c for c in num if c not in drop]
        cat = [c for c in cat if c not in drop]
        modes = {r["column"]: r["most_frequent"] for r in distinct_and_mode(out, cat).collect()} if cat else {}
        out = _apply(out, {c: F.coalesce(F.col(c), F.lit(modes.get(c) or "Unknown")) for c in cat})
    else:
        out = onehot_all(out, cat)
    if not num:
        return out
    nulls = out.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                                 | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in num]).first()
    fix = [c for c in num if nulls[c] > 0]
    med = exact_quantiles(out, fix, [0.5]) if fix else {}
    out = _apply(out, {c: F.coalesce(F.col(c).cast("double"), F.lit(med[(c, 0.5)])) for c in fix})
    return inf_to_median(out, fix) if fix else out


# ------------------------------------------------------------------ scaling

def _moments(df, cols):
    r = df.agg(*[F.avg(c).alias(f"mu{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(c).alias(f"sd{i}") for i, c in enumerate(cols)],
               *[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
               *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"mu{i}"], r[f"sd{i}"], r[f"mn{i}"], r[f"mx{i}"]) for i, c in enumerate(cols)}


def scale_standard(df: DataFrame, cols=None) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1. Nulls stay null."""
    cols = _num_cols(df, cols)
    m = _moments(df, cols)
    return _apply(df, {c: (F.col(c) - F.lit(mu)) / F.lit(sd if sd else 1.0) for c, (mu, sd, _, _) in m.items()})


def scale_minmax(df: DataFrame, cols=None) -> DataFrame:
    """(x - min) / (max - min); a zero range divides by 1."""
    cols = _num_cols(df, cols)
    m = _moments(df, cols)
    return _apply(df, {c: (F.col(c) - F.lit(mn)) / F.lit((mx - mn) if mx is not None and mx != mn else 1.0)
                       for c, (_, _, mn, mx) in m.items()})


def scale_robust(df: DataFrame, cols=None) -> DataFrame:
    """(x - median) / IQR with exact quantiles; a zero IQR divides by 1."""
    cols = _num_cols(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    exprs = {}
    for c in cols:
        iqr = (q[(c, 0.75)] - q[(c, 0.25)]) if q[(c, 0.5)] is not None else 1.0
        exprs[c] = (F.col(c) - F.lit(q[(c, 0.5)])) / F.lit(iqr if iqr else 1.0)
    return _apply(df, exprs)


# Published coefficients of Acklam's approximation of the inverse normal distribution.
PPF = (
    [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00],
    [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00])


def _norm_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse standard normal CDF (rational approximation, |rel err| < 1.2e-9)."""
    a, b, c, d = PPF
    p = np.asarray(p, dtype=float)
    out = np.empty_like(p)
    lo, hi = 0.02425, 1 - 0.02425
    m = p < lo
    q = np.sqrt(-2 * np.log(p[m]))
    out[m] = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
        ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    m2 = (p >= lo) & (p <= hi)
    q = p[m2] - 0.5
    r = q * q
    out[m2] = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
        (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    m3 = p > hi
    q = np.sqrt(-2 * np.log(1 - p[m3]))
    out[m3] = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
        ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    return out


def _quantile_udf(qs: np.ndarray, refs: np.ndarray):
    """Vectorised map through one column's references (shipped in the closure, <= 1000 values)."""
    @F.pandas_udf("double")
    def tr(s: pd.Series) -> pd.Series:
        x = s.to_numpy(dtype=float)
        u = 0.5 * (np.interp(x, qs, refs) - np.interp(-x, -qs[::-1], -refs[::-1]))
        u = np.clip(u, 1e-7, 1 - 1e-7)
        out = _norm_ppf(np.nan_to_num(u, nan=0.5))
        out[np.isnan(x)] = np.nan
        return pd.Series(out)
    return tr


def scale_quantile_normal(df: DataFrame, cols=None, n_quantiles: int = 1000) -> DataFrame:
    """Rank-based map to a normal distribution.

    References = min(1000, n) exact quantiles per column (radix histograms, all columns together);
    each value is interpolated to a uniform score (mean of the forward and backward
    interpolation, as the library does for repeated references), clipped to
    [1e-7, 1 - 1e-7] and mapped through the inverse normal CDF. A pandas UDF applies
    ``np.interp`` to Arrow batches with the references shipped in the closure
    (size bounded by n_quantiles). A column without values stays null.
    """
    cols = _num_cols(df, cols)
    n = df.count()
    nq = max(2, min(n_quantiles, n))
    probs = [i / (nq - 1) for i in range(nq)]
    q = exact_quantiles(df, cols, probs)
    refs = np.array(probs)
    exprs = {c: F.lit(None).cast("double") if q[c, 0.0] is None else
             _quantile_udf(np.array([q[c, p] for p in probs]), refs)(F.col(c).cast("double")) for c in cols}
    return _apply(df, exprs)


def _yj(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform with a literal lambda."""
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = (-F.log1p(-x)) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def _bc(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def _power_sums(df: DataFrame, lams: dict[str, list[float]], method: str) -> dict[str, tuple[int, float, list[tuple[float, float]]]]:
    """Per column: number of values, sum of the log-Jacobian and (sum of T, sum of T^2) of each lambda. A task sends one row per lambda."""
    yj = method == "yeo-johnson"

    def sums(batches):
        every = [(c, ls, np.zeros(len(ls)), np.zeros(len(ls)), np.zeros(2)) for c, ls in lams.items()]
        with np.errstate(all="ignore"):
            for batch in batches:
                for i, (_, ls, s, q, more) in enumerate(every):
                    values = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    more[0] += len(values)
                    for at in range(0, len(values), 4096):
                        x = values[at:at + 4096]
                        low = x < 0
                        neg, x = (x[low], x[~low]) if yj else (x[:0], x)
                        logs = np.concatenate([np.log1p(x), -np.log1p(-neg)]) if yj else np.log(x[~(x <= 0)])
                        more[1] += logs.sum()
                        for j, lam in enumerate(ls):
                            if not yj:
                                t = logs if abs(lam) < 1e-12 else (np.power(x, lam) - 1) / lam
                            else:
                                pos = np.log1p(x) if abs(lam) < 1e-12 else (np.power(x + 1, lam) - 1) / lam
                                t = pos if not len(neg) else np.concatenate([pos, -np.log1p(-neg) if abs(lam - 2) < 1e-12 else -(np.power(1 - neg, 2 - lam) - 1) / (2 - lam)])
                            s[j] += t.sum()
                            q[j] += (t * t).sum()
        if any(more[0] for *_, more in every):
            rows = [(i, j, *sq, *more) for i, (_, _, s, q, more) in enumerate(every) for j, sq in enumerate(zip(s, q, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), *[pa.float64()] * 4], strict=True)], names=["i", "j", "s", "q", "n", "jac"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in lams]).mapInArrow(sums, "i int, j int, s double, q double, n double, jac double")
    found = {(r["i"], r["j"]): r for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("s", "q", "n", "jac")]).collect()}
    out = {}
    for i, (c, ls) in enumerate(lams.items()):
        mine = [found.get((i, j)) for j in range(len(ls))]
        out[c] = (0, 0.0, [(0.0, 0.0)] * len(ls)) if mine[0] is None else (int(mine[0]["n"]), mine[0]["jac"], [(r["s"], r["q"]) for r in mine])
    return out


def fit_power_lambda(df: DataFrame, cols: list[str], method: str = "yeo-johnson",
                     grid=(-2.0, 2.0), steps: int = 41, refine: int = 2) -> dict[str, float]:
    """N5 fit: maximum-likelihood lambda per column by grid search in one aggregate per pass.

    log L(l) = -n/2 log var(T_l(x)) + (l - 1) * sum(sign(x) log(|x| + 1)) (Yeo-Johnson)
    or (l - 1) * sum(log x) (Box-Cox). Each pass evaluates every grid lambda for every
    column (sums of T and T^2, by vectors in the tasks), then the grid narrows around the
    best value. Values approach the library's Brent optimum to the final grid spacing.
    """
    lo, hi = {c: grid[0] for c in cols}, {c: grid[1] for c in cols}
    best = {}
    for _ in range(refine + 1):
        lams = {c: list(np.linspace(lo[c], hi[c], steps)) for c in cols}
        r = _power_sums(df, lams, method)
        for c in cols:
            n, jac, sums = r[c]
            lls = []
            for lam, (s, q) in zip(lams[c], sums, strict=True):
                if n == 0:
                    lls.append(-np.inf)
                    continue
                var = q / n - (s / n) ** 2
                lls.append(-n / 2 * math.log(var) + (lam - 1) * jac if var > 0 else -np.inf)
            k = int(np.argmax(lls))
            best[c] = float(lams[c][k])
            step = (hi[c] - lo[c]) / (steps - 1)
            lo[c], hi[c] = best[c] - step, best[c] + step
    return best


def scale_power(df: DataFrame, cols=None, method: str | None = None) -> tuple[str, DataFrame]:
    """Box-Cox when every value of every column is > 0, else Yeo-Johnson; then standardise."""
    cols = _num_cols(df, cols)
    if method is None:
        r = df.agg(*[F.min(c).alias(c) for c in cols]).first().asDict()
        method = "box-cox" if all(v is not None and v > 0 for v in r.values()) else "yeo-johnson"
    lam = fit_power_lambda(df, cols, method)
    t = _apply(df, {c: (_yj(F.col(c).cast("double"), lam[c]) if method == "yeo-johnson"
                        else _bc(F.col(c).cast("double"), lam[c])) for c in cols})
    return method, scale_standard(t, cols)


def scale_boxcox(df: DataFrame, cols=None) -> tuple[str, DataFrame]:
    """Box-Cox, falling back to Yeo-Johnson when any value is <= 0."""
    cols = _num_cols(df, cols)
    r = df.agg(*[F.min(c).alias(c) for c in cols]).first().asDict()
    method = "box-cox" if all(v is not None and v > 0 for v in r.values()) else "yeo-johnson"
    return scale_power(df, cols, method)


def scaling_stats(df: DataFrame, cols=None) -> dict:
    """Inputs of the N7 rule: IQR outlier count over columns, mean |skew|, mean |kurtosis|."""
    cols = _num_cols(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.75])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            aggs.append(F.lit(0).alias(f"o{i}"))
        else:
            iqr = q3 - q1
            aggs.append(F.count_if((F.col(c) < q1 - 1.5 * iqr) | (F.col(c) > q3 + 1.5 * iqr)).alias(f"o{i}"))
        aggs += [skew_corrected(F.col(c).cast("double")).alias(f"s{i}"),
                 kurt_corrected(F.col(c).cast("double")).alias(f"k{i}")]
    r = df.agg(*aggs).first()
    sk = [abs(r[f"s{i}"]) for i in range(len(cols)) if r[f"s{i}"] is not None]
    ku = [abs(r[f"k{i}"]) for i in range(len(cols)) if r[f"k{i}"] is not None]
    return {"rows": r["n"], "outliers": sum(r[f"o{i}"] for i in range(len(cols))),
            "mean_abs_skew": float(np.mean(sk)) if sk else None,
            "mean_abs_kurtosis": float(np.mean(ku)) if ku else None}


def choose_scaling(stats: dict) -> str:
    """N7 rule: outliers > 5 % of rows -> robust; mean |skew| > 1 -> power; > 0.5 -> quantile."""
    if stats["outliers"] > 0.05 * stats["rows"]:
        return "robust"
    s = stats["mean_abs_skew"] or 0.0
    if s > 1.0:
        return "power"
    if s > 0.5:
        return "quantile"
    return "standard"


def log_transform(df: DataFrame, cols=None) -> DataFrame:
    """ln(x), or ln(x + |global min| + 1) for every column if any value <= 0 anywhere."""
    cols = _num_cols(df, cols)
    r = df.agg(*[F.min(c).alias(c) for c in cols]).first().asDict()
    mins = [v for v in r.values() if v is not None]
    gmin = min(mins) if mins else 0.0
    shift = abs(gmin) + 1 if mins and gmin <= 0 else 0.0
    return _apply(df, {c: F.log(F.col(c) + F.lit(shift)) for c in cols})


def scale(df: DataFrame, method: str = "auto", cols=None) -> tuple[str, DataFrame]:
    """advanced scaling dispatcher."""
    cols = _num_cols(df, cols)
    if method == "auto":
        method = choose_scaling(scaling_stats(df, cols))
    if method == "standard":
        return method, scale_standard(df, cols)
    if method == "minmax":
        return method, scale_minmax(df, cols)
    if method == "robust":
        return method, scale_robust(df, cols)
    if method == "quantile":
        return method, scale_quantile_normal(df, cols)
    if method == "power":
        return scale_power(df, cols)
    if method == "boxcox":
        return scale_boxcox(df, cols)
    if method == "yeojohnson":
        return scale_power(df, cols, "yeo-johnson")
    if method == "log":
        return method, log_transform(df, cols)
    raise ValueError(method)


def skew_kurt_before_after(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Mean |skew| and mean |kurtosis| before and after scaling, and the reductions."""
    def agg(d, tag):
        return d.agg(*[F.abs(skew_corrected(F.col(c).cast("double"))).alias(f"s{i}") for i, c in enumerate(cols)],
                     *[F.abs(kurt_corrected(F.col(c).cast("double"))).alias(f"k{i}") for i, c in enumerate(cols)]) \
            .select((sum((F.col(f"s{i}") for i in range(len(cols))), F.lit(0.0)) / len(cols)).alias(f"skew_{tag}"),
                    (sum((F.col(f"k{i}") for i in range(len(cols))), F.lit(0.0)) / len(cols)).alias(f"kurt_{tag}"),
                    F.lit(1).alias("__k"))
    b, a = agg(before, "before"), agg(after, "after")
    j = b.join(a, "__k").drop("__k")
    return j.select("skew_before", "kurt_before", "skew_after", "kurt_after",
                    (F.col("skew_before") - F.col("skew_after")).alias("skew_reduction"),
                    (F.abs("kurt_before") - F.abs("kurt_after")).alias("kurt_reduction"))


# ------------------------------------------------------------------ encoding

def _categories(df: DataFrame, col: str, limit: int | None = None) -> list:
    """Sorted distinct non-null values; refuses more than ``limit`` (size check before collect)."""
    d = df.where(F.col(col).isNotNull()).select(col).distinct()
    if limit is not None:
        k = d.limit(limit + 1).count()
        if k > limit:
            raise ValueError(f"{col} has more than {limit} categories")
    return sorted(r[0] for r in d.collect())


def onehot_drop_first(df: DataFrame, cols: list[str], max_categories: int = MAX_ONEHOT) -> DataFrame:
    """<= 10 categories: sorted, first dropped, 0/1 columns named {f}_{cat}; null -> all 0."""
    exprs = {}
    for c in cols:
        cats = _categories(df, c, max_categories)
        for v in cats[1:]:
            exprs[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
    return _apply(df, exprs)


def onehot_all(df: DataFrame, cols: list[str], max_categories: int = 1000, drop_source: bool = True) -> DataFrame:
    """Dummies for every category (no drop), null -> all 0; source columns replaced."""
    sel = [F.col(c) for c in df.columns if not (drop_source and c in cols)]
    for c in cols:
        for v in _categories(df, c, max_categories):
            sel.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*sel)


def factorize(df: DataFrame, col: str, order_col: str, out: str | None = None) -> DataFrame:
    """Code by first appearance (in ``order_col`` order), null -> -1.

    First appearance per value is an aggregate; codes are distributed positions over
    the distinct values, joined back."""
    from strata.operators.ranks import prefix_count
    out = out or f"{col}_code"
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_col).alias("__first"))
    # codes = distributed positions over the distinct values (no one-task row_number,
    # so an ID-like column with billions of values is numbered in parallel)
    codes = prefix_count(first, ["__first", col], out="__pos").select(col, (F.col("__pos") - 1).alias(out))
    j = df.join(codes, col, "left")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def bin_equal_frequency(df: DataFrame, col: str, n_bins: int | None = None, out: str | None = None) -> tuple[int, DataFrame]:
    """C11: quantile bins (n_bins = min(10, unique // 5)); edges are exact linear quantiles,
    edges closer than 1e-8 are merged; code = number of inner edges <= x (0 .. bins-1)."""
    out = out or f"{col}_binned"
    if n_bins is None:
        u = df.agg(F.count_distinct(col)).first()[0]
        n_bins = max(1, min(10, u // 5))
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(df, [col], probs)
    edges = [q[(col, p)] for p in probs]
    keep = [edges[0]]
    for e in edges[1:]:
        if e - keep[-1] > 1e-8:
            keep.append(e)
    inner = keep[1:-1]
    code = sum((F.when(F.col(col) >= F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    nb = max(len(keep) - 1, 1)
    return nb, df.withColumn(out, F.when(F.col(col).isNotNull(), F.least(code, F.lit(nb - 1)).cast("double")))


def polynomial_features(df: DataFrame, cols: list[str], mode: str = "all") -> DataFrame:
    """Degree 2 without bias. ``auto``: {f}_poly_1 = f^2 per feature; ``all``: every
    square and pairwise product named poly_{a}^2 / poly_{a} {b} (library naming)."""
    exprs = {}
    if mode == "auto":
        for c in cols:
            exprs[f"{c}_poly_1"] = F.col(c) * F.col(c)
    else:
        for i, a in enumerate(cols):
            for b in cols[i:]:
                name = f"poly_{a}^2" if a == b else f"poly_{a} {b}"
                exprs[name] = F.col(a) * F.col(b)
    return _apply(df, exprs)


def interaction_features(df: DataFrame, cat_pairs=(), num_pairs=()) -> DataFrame:
    """Category crosses ({a}_x_{b} = a|b) and numeric products ({a}_x_{b})."""
    exprs = {}
    for a, b in cat_pairs:
        exprs[f"{a}_x_{b}"] = F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string"))
    for a, b in num_pairs:
        exprs[f"{a}_x_{b}"] = F.col(a) * F.col(b)
    return _apply(df, exprs)


def transform_auto(df: DataFrame, categorical=None, numerical=None, target: str | None = None) -> tuple[DataFrame, list]:
    """E5: numeric: unique > 20 and |skew| > 1 -> quantile bins; |skew| > 0.5 -> square;
    categorical: <= 10 values -> one-hot (drop first), else frequency encoding.
    Returns the frame and the list of (feature, method) decisions."""
    from strata.operators.relational import join_value_counts
    categorical = _cat_cols(df, categorical, include_bool=False) if categorical is None else categorical
    numerical = [c for c in _num_cols(df, numerical) if c != target] if numerical is None else numerical
    stats = df.agg(*[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(numerical + categorical)],
                   *[skew_corrected(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(numerical)]).first()
    info = []
    out = df
    for i, c in enumerate(numerical):
        u, s = stats[f"u{i}"], abs(stats[f"s{i}"] or 0.0)
        if u > 20 and s > 1.0:
            nb, out = bin_equal_frequency(out, c, min(10, u // 5))
            info.append((c, "binning"))
        elif s > 0.5:
            out = polynomial_features(out, [c], "auto")
            info.append((c, "polynomial"))
    for j, c in enumerate(categorical):
        u = stats[f"u{len(numerical) + j}"]
        if u <= MAX_ONEHOT:
            out = onehot_drop_first(out, [c])
            info.append((c, "onehot_encoding"))
        else:
            out = join_value_counts(out, c)
            info.append((c, "frequency_encoding"))
    return out, info
