"""Outlier detection per numeric column.

Columns with fewer than 10 non-null values are skipped. Fitted constants
(quartiles, moments) come from one aggregate; the 1-D neighbour methods
(DBSCAN eps counts, LOF) use exact distributed ranks instead of an
un-partitioned window, and the isolation forest fits one small tree per
task and scores with a vectorised pandas UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.stats import exact_quantiles, numeric_cols
from strata.operators.ordered import apply_between
from strata.operators.ranks import count_in_ranges, global_positions
from strata.session import checkpoint_dir

MIN_VALUES = 10
LOF_ROWS = 1 << 18  # of a range partition of sorted values
LOF_CHUNK = 1 << 14  # whose candidates are held at once


def _eligible(df: DataFrame, cols) -> list[str]:
    cols = list(cols or numeric_cols(df, include_decimal=False))
    r = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    return [c for c in cols if r[c] >= MIN_VALUES]


def iqr_fences(df: DataFrame, cols) -> dict[str, tuple[float, float]]:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def outlier_iqr(df: DataFrame, cols=None) -> DataFrame:
    """O1: flag {c}_outlier when x < Q1 - 1.5 IQR or x > Q3 + 1.5 IQR."""
    cols = _eligible(df, cols)
    f = iqr_fences(df, cols)
    return df.select("*", *[((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_outlier") for c, (lo, hi) in f.items()])


def outlier_zscore(df: DataFrame, cols=None, threshold: float = 3.0) -> DataFrame:
    """O2: |x - mean| / sample std > 3; no flags for a column with zero std."""
    cols = _eligible(df, cols)
    r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    flags = []
    for i, c in enumerate(cols):
        m, s = r[f"m{i}"], r[f"s{i}"]
        flags.append(((F.abs(F.col(c) - m) / s) > threshold if s and s > 0 else F.lit(None).cast("boolean"))
                     .alias(f"{c}_outlier"))
    return df.select("*", *flags)


def outlier_dbscan_1d(df: DataFrame, col: str, id_col: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Standardise (median-filled, population std), DBSCAN in 1-D: a point is core when at
    least ``min_samples`` values (itself included) lie within +-eps; noise = not core and no
    core point within +-eps. Adds {col}_outlier.

    Both neighbourhood counts are exact and distributed (``count_in_ranges``)."""
    med = exact_quantiles(df, [col], [0.5])[(col, 0.5)]
    filled = F.coalesce(F.col(col).cast("double"), F.lit(med))
    r = df.agg(F.avg(filled).alias("m"), F.stddev_pop(filled).alias("s")).first()
    s = r["s"] if r["s"] else 1.0
    z = df.select(id_col, ((filled - r["m"]) / s).alias("__z"))
    pts = z.select(id_col, "__z", (F.col("__z") - eps).alias("__lo"), (F.col("__z") + eps).alias("__hi"))
    cnt = count_in_ranges(pts, "__z", "__lo", "__hi", id_col)
    core = pts.join(cnt, id_col).withColumn("__core", F.col("count") >= min_samples)
    core_pts = core.where("__core").select(id_col, "__z")
    near = count_in_ranges(core.where(~F.col("__core")), "__z", "__lo", "__hi", id_col, data=core_pts,
                           data_value_col="__z", data_id_col=id_col)
    flags = (core.join(near.withColumnRenamed("count", "__near"), id_col, "left")
             .select(id_col, (~F.col("__core") & (F.coalesce("__near", F.lit(0)) == 0)).alias(f"{col}_outlier")))
    return df.join(flags, id_col, "left")


def lof_scores_1d(df: DataFrame, col: str, id_col: str, k: int | None = None) -> DataFrame:
    """LOF in one dimension with exact neighbours.

    Sorted by (value, id), the k nearest neighbours of a point are among the k positions on each side, ties broken
    by position; their k-distances and densities reach 2k positions further. So a range partition of the
    sorted rows has with the 3k rows before and after it all that its own rows need, and (id, value) moves
    once. Rows that share an id, or lack one, are scored together as one point by joins (``_lof_of_ids``).
    Returns (id, lof)."""
    med = exact_quantiles(df, [col], [0.5])[(col, 0.5)]
    base = df.select(id_col, F.coalesce(F.col(col).cast("double"), F.lit(med)).alias("v"))
    n = base.count()
    k = k or min(20, n - 1)
    if k < 1 or med is None or base.select(F.count_distinct(id_col)).first()[0] < n:
        return _lof_of_ids(base, id_col, k)
    k = min(k, n - 1)

    def score(t: pa.Table, first: int, last: int) -> pa.Table:
        lof = _lof_sorted(t["v"].to_numpy(), k)[first:last]
        return pa.table([t[id_col].slice(first, last - first), pa.array(lof)], names=[id_col, "lof"])

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LOF_ROWS))
    return apply_between(base, ["v", id_col], 3 * k, score, f"`{id_col}` {dict(base.dtypes)[id_col]}, lof double", min(parts, math.ceil(n / 1024)))


def _lof_sorted(v: np.ndarray, k: int) -> np.ndarray:
    """LOF of sorted values, the k neighbours of each being the nearest by (distance, step, left first)."""
    n = len(v)
    offs = np.array([o for step in range(1, k + 1) for o in (-step, step)])  # in the order that breaks ties
    near, d = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    for s in range(0, n, LOF_CHUNK):
        at = np.arange(s, min(s + LOF_CHUNK, n))[:, None] + offs[None, :]
        off_end = (at < 0) | (at >= n)
        at = np.clip(at, 0, n - 1)
        gap = np.abs(v[s:s + LOF_CHUNK, None] - v[at])
        order = (np.lexsort((gap, off_end), axis=1) if off_end.any() else np.argsort(gap, axis=1, kind="stable"))[:, :k]
        near[s:s + LOF_CHUNK], d[s:s + LOF_CHUNK] = np.take_along_axis(at, order, axis=1), np.take_along_axis(gap, order, axis=1)
    kdist = d.max(axis=1)
    lrd = np.empty(n)
    for s in range(0, n, LOF_CHUNK):
        lrd[s:s + LOF_CHUNK] = 1.0 / (np.maximum(d[s:s + LOF_CHUNK], kdist[near[s:s + LOF_CHUNK]]).mean(axis=1) + 1e-10)
    return np.concatenate([lrd[near[s:s + LOF_CHUNK]].mean(axis=1) for s in range(0, n, LOF_CHUNK)]) / lrd


def _lof_of_ids(base: DataFrame, id_col: str, k: int) -> DataFrame:
    """LOF of (id, v) where rows may share an id: candidates come from an equi-join on global position offsets
    (2k per row), then k-distance, reachability, local reachability density and LOF are grouped
    aggregates and equi-joins on ids."""
    pos = global_positions(base, ["v", id_col])
    offs = F.array(*[F.lit(o) for o in range(-k, k + 1) if o != 0])
    cand = pos.select(id_col, "v", "pos", F.explode(offs).alias("off")).withColumn("npos", F.col("pos") + F.col("off"))
    nb = pos.select(F.col("pos").alias("npos"), F.col(id_col).alias("nid"), F.col("v").alias("nv"))
    pairs = cand.join(nb, "npos").withColumn("d", F.abs(F.col("v") - F.col("nv")))
    w = Window.partitionBy(id_col).orderBy("d", F.abs("off"), "off")
    knn = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    kd = knn.groupBy(id_col).agg(F.max("d").alias("kdist"))
    reach = (knn.join(kd.select(F.col(id_col).alias("nid"), F.col("kdist").alias("nkd")), "nid")
             .withColumn("rd", F.greatest("d", "nkd")))
    lrd = reach.groupBy(id_col).agg((1.0 / (F.avg("rd") + 1e-10)).alias("lrd"))
    lof = (knn.select(id_col, "nid").join(lrd.select(F.col(id_col).alias("nid"), F.col("lrd").alias("nlrd")), "nid")
           .groupBy(id_col).agg(F.avg("nlrd").alias("__m"))
           .join(lrd, id_col).select(id_col, (F.col("__m") / F.col("lrd")).alias("lof")))
    return lof


def outlier_lof_1d(df: DataFrame, col: str, id_col: str, contamination: float = 0.1) -> DataFrame:
    """Flag the ``contamination`` share with the highest LOF (needs k >= 5, else IQR)."""
    n = df.count()
    if min(20, n - 1) < 5:
        return outlier_iqr(df, [col])
    # scores feed two passes (threshold, flags): checkpoint once so both see identical values
    lof = lof_scores_1d(df, col, id_col).checkpoint(eager=True)
    thr = exact_quantiles(lof, ["lof"], [1 - contamination])[("lof", 1 - contamination)]
    return df.join(lof.select(id_col, (F.col("lof") > thr).alias(f"{col}_outlier"), "lof"), id_col, "left")


# ------------------------------------------------------------------ isolation forest

def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search (normaliser of isolation depth)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _build_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Array-encoded isolation tree: feature, threshold, left, right, size per node."""
    feat, thr, left, right, size = [], [], [], [], []

    def grow(idx, depth):
        node = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return node
        Xs = X[idx]
        span = Xs.max(axis=0) - Xs.min(axis=0)
        cand = np.flatnonzero(span > 0)
        if len(cand) == 0:
            return node
        f = int(rng.choice(cand))
        t = float(rng.uniform(Xs[:, f].min(), Xs[:, f].max()))
        feat[node], thr[node] = f, t
        mask = Xs[:, f] < t
        left[node] = grow(idx[mask], depth + 1)
        right[node] = grow(idx[~mask], depth + 1)
        return node

    grow(np.arange(len(X)), 0)
    return np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(size)


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    feat, thr, left, right, size = tree
    node = np.zeros(len(X), dtype=np.int64)
    depth = np.zeros(len(X))
    active = np.ones(len(X), dtype=bool)
    while active.any():
        f = feat[node]
        leaf = f < 0
        done = active & leaf
        if done.any():
            depth[done] += np.array([_c(s) for s in size[node[done]]])
            active &= ~leaf
        if not active.any():
            break
        idx = np.flatnonzero(active)
        go_left = X[idx, feat[node[idx]]] < thr[node[idx]]
        node[idx] = np.where(go_left, left[node[idx]], right[node[idx]])
        depth[idx] += 1
    return depth


def isolation_forest_scores(df: DataFrame, cols: list[str], id_col: str, n_trees: int = 100,
                            max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Anomaly score 2^(-E[h(x)] / c(psi)) per row (higher = more anomalous).

    Sampling: each row joins tree t when a seeded hash of (id, t) falls below a rate
    that yields about 1.5 x max_samples rows per tree; the smallest ``max_samples`` hashes
    per tree are kept (a bounded top-n per group). Each tree is grown in its own
    ``applyInPandas`` group; the forest (<= n_trees x 2 psi nodes) is the only object
    shipped to the scoring UDF. Not the reference library's random stream: values
    differ, the method does not.
    """
    n = df.count()
    psi = min(max_samples, n)
    rate = min(1.0, 1.5 * psi / max(n, 1))
    x = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols])
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    u = lambda t: (F.abs(F.xxhash64(F.lit(seed), F.col(id_col), t)) % 1000003) / 1000003.0
    sampled = x.select("*", F.explode(F.filter(trees, lambda t: u(t) < rate)).alias("tree"))
    sampled = sampled.withColumn("__h", F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("tree")))
    w = Window.partitionBy("tree").orderBy("__h", id_col)
    sampled = sampled.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= psi)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        X = pdf[cols].to_numpy(dtype=float)
        tree = _build_tree(X, np.random.default_rng(seed * 1000 + t), max_depth)
        return pd.DataFrame({"tree": [t], "feat": [tree[0].tolist()], "thr": [tree[1].tolist()],
                             "left": [tree[2].tolist()], "right": [tree[3].tolist()], "size": [tree[4].tolist()]})

    forest = sampled.groupBy("tree").applyInPandas(
        fit, "tree int, feat array<long>, thr array<double>, left array<long>, right array<long>, size array<long>")
    model = [(np.array(r["feat"]), np.array(r["thr"]), np.array(r["left"]), np.array(r["right"]), np.array(r["size"]))
             for r in forest.collect()]
    cpsi = _c(psi)

    @F.pandas_udf("double")
    def score(*cs: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=float) for c in cs])
        h = np.mean([_path_lengths(X, tr) for tr in model], axis=0)
        return pd.Series(np.power(2.0, -h / cpsi))

    return x.select(id_col, score(*[F.col(c) for c in cols]).alias("score"))


def outlier_isolation_forest(df: DataFrame, cols, id_col: str, contamination: float = 0.1) -> DataFrame:
    """O3: per column (median-filled), flag scores above the (1 - contamination) quantile."""
    cols = _eligible(df, cols)
    checkpoint_dir(df.sparkSession)
    med = exact_quantiles(df, cols, [0.5])
    filled = df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(med[(c, 0.5)])).alias(c) for c in cols])
    out = df
    for c in cols:
        sc = isolation_forest_scores(filled.select(id_col, c), [c], id_col).checkpoint(eager=True)
        thr = exact_quantiles(sc, ["score"], [1 - contamination])[("score", 1 - contamination)]
        out = out.join(sc.select(id_col, (F.col("score") > thr).alias(f"{c}_outlier")), id_col, "left")
    return out


# ------------------------------------------------------------------ dispatch / actions / summary

def choose_outlier_method(n_rows: int, n_features: int) -> str:
    """O6 rule: n < 50 iqr; n < 1000 and features < 10 isolation_forest; features >= 10 lof; else iforest."""
    if n_rows < 50:
        return "iqr"
    if n_rows < 1000 and n_features < 10:
        return "isolation_forest"
    if n_features >= 10:
        return "lof"
    return "isolation_forest"


def detect_outliers(df: DataFrame, method: str = "iqr", cols=None, id_col: str | None = None,
                    contamination: float = 0.1) -> tuple[str, DataFrame]:
    """Outlier dispatcher; returns (resolved method, frame with {c}_outlier flags)."""
    cols = _eligible(df, cols)
    if method == "auto":
        method = choose_outlier_method(df.count(), len(cols))
    if method == "iqr":
        return method, outlier_iqr(df, cols)
    if method == "zscore":
        return method, outlier_zscore(df, cols)
    if id_col is None:
        raise ValueError(f"{method} needs id_col")
    if method == "isolation_forest":
        return method, outlier_isolation_forest(df, cols, id_col, contamination)
    out = df
    for c in cols:
        if method == "lof":
            out = outlier_lof_1d(out, c, id_col, contamination).drop("lof")
        elif method == "dbscan":
            out = outlier_dbscan_1d(out, c, id_col)
        else:
            raise ValueError(method)
    return method, out


def cap_outliers(df: DataFrame, cols=None) -> DataFrame:
    """Winsorise to the IQR fences."""
    cols = _eligible(df, cols)
    f = iqr_fences(df, cols)
    return df.select(*[F.greatest(F.least(F.col(c), F.lit(f[c][1])), F.lit(f[c][0])).alias(c) if c in f
                       else F.col(c) for c in df.columns])


def remove_outliers(flagged: DataFrame, flag_cols: list[str]) -> DataFrame:
    """Drop rows flagged by any method column."""
    cond = F.lit(False)
    for f in flag_cols:
        cond = cond | F.coalesce(F.col(f), F.lit(False))
    return flagged.where(~cond).drop(*flag_cols)


def outlier_summary(flagged: DataFrame, flag_cols: list[str]) -> DataFrame:
    """Per column count and %, totals over analysed columns, advice (>10 / >5 / else)."""
    n = F.count(F.lit(1))
    wide = flagged.agg(n.alias("n"), *[F.count_if(F.col(f)).alias(f"c{i}") for i, f in enumerate(flag_cols)])
    items = [F.struct(F.lit(f.removesuffix("_outlier")).alias("column"), F.col(f"c{i}").alias("count"),
                      (F.col(f"c{i}") * 100.0 / F.col("n")).alias("percentage")) for i, f in enumerate(flag_cols)]
    tot = sum((F.col(f"c{i}") for i in range(len(flag_cols))), F.lit(0))
    tot_pct = tot * 100.0 / (F.col("n") * len(flag_cols))
    advice = F.when(tot_pct > 10, "extreme_outliers").when(tot_pct > 5, "cap_outliers").otherwise("keep_outliers")
    return wide.select(F.explode(F.array(*items)).alias("s"), tot.alias("total_outliers"),
                       tot_pct.alias("total_percentage"), advice.alias("advice")).select(
        "s.*", "total_outliers", "total_percentage", "advice")
