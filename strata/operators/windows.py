"""Ordered window operators over series (W1-W16) and fill rules.

Spark has no implicit row order: every operator takes ``order_col`` and
``partition_cols`` (one logical series per partition). A window partition is
one task, so a series must be bounded; long raw event streams are resampled
first (``series.resample_mean``) which bounds a series by its calendar length.
Frames are bounded (``rowsBetween``) wherever the reference allows, so
Spark evaluates them with a sliding buffer rather than materialising the
partition for every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB_P, UNB_F = Window.unboundedPreceding, Window.unboundedFollowing


def _w(order_col: str | Sequence[str], partition_cols: Sequence[str] = ()):
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    w = Window.orderBy(*order)
    if partition_cols:
        w = Window.partitionBy(*partition_cols).orderBy(*order)
    return w


def _part(partition_cols: Sequence[str] = ()):
    return Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy()


# ------------------------------------------------------------------ fills

def ffill(c: Column | str, order_col, partition_cols=()) -> Column:
    """Last non-null value so far."""
    c = F.col(c) if isinstance(c, str) else c
    return F.last(c, ignorenulls=True).over(_w(order_col, partition_cols).rowsBetween(UNB_P, 0))


def bfill(c: Column | str, order_col, partition_cols=()) -> Column:
    """Next non-null value from here on."""
    c = F.col(c) if isinstance(c, str) else c
    return F.first(c, ignorenulls=True).over(_w(order_col, partition_cols).rowsBetween(0, UNB_F))


def fill_column(c: str, method: str, order_col, partition_cols=()) -> Column:
    """Fill rule used by lag/rolling features: none, ffill, bfill, zero, mean, median, else ffill+bfill."""
    col = F.col(c)
    if method == "none":
        return col
    if method == "ffill":
        return ffill(col, order_col, partition_cols)
    if method == "bfill":
        return bfill(col, order_col, partition_cols)
    if method == "zero":
        return F.coalesce(col, F.lit(0.0))
    if method == "mean":
        return F.coalesce(col, F.avg(col).over(_part(partition_cols)))
    if method == "median":
        return F.coalesce(col, F.percentile(col, 0.5).over(_part(partition_cols)))
    return F.coalesce(ffill(col, order_col, partition_cols), bfill(col, order_col, partition_cols))


def _interp(c: str, x: Column, order_col, partition_cols) -> Column:
    """Linear interpolation of ``c`` in ``x`` between known neighbours.

    Leading nulls stay null; trailing nulls carry the last known value (pandas).
    """
    w = _w(order_col, partition_cols)
    known = F.when(F.col(c).isNotNull(), F.struct(x.alias("x"), F.col(c).alias("y")))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(UNB_P, 0))
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(0, UNB_F))
    span = nxt["x"] - prev["x"]
    lin = prev["y"] + (nxt["y"] - prev["y"]) * F.try_divide(x - prev["x"], span)
    return (F.when(F.col(c).isNotNull(), F.col(c))
            .when(prev.isNotNull() & nxt.isNotNull(), F.when(span == 0, prev["y"]).otherwise(lin))
            .when(prev.isNotNull(), prev["y"]))


def interpolate_linear(df: DataFrame, c: str, order_col: str, partition_cols=(), out: str | None = None) -> DataFrame:
    """Interpolate by row position."""
    pos = F.row_number().over(_w(order_col, partition_cols)).cast("double")
    tmp = df.withColumn("__pos", pos)
    return tmp.withColumn(out or c, _interp(c, F.col("__pos"), order_col, partition_cols)).drop("__pos")


def interpolate_time(df: DataFrame, c: str, order_col, partition_cols=(), out: str | None = None,
                     then_fill: bool = True, distributed: bool = False, time_col: str | None = None) -> DataFrame:
    """Interpolate in time (epoch seconds of ``order_col``), then ffill and bfill.

    ``distributed=True`` (one long series): carries of the previous / next known point
    through range partitions (``operators.ordered``) instead of one-task windows."""
    if distributed and not partition_cols and then_fill and out in (None, c):
        from strata.operators.ordered import interpolate_time_ordered
        order = [order_col] if isinstance(order_col, str) else list(order_col)
        return interpolate_time_ordered(df, c, order, time_col or order[0])
    x = F.unix_micros(F.col(order_col).cast("timestamp")).cast("double")
    tgt = out or c
    res = df.withColumn(tgt, _interp(c, x, order_col, partition_cols))
    if then_fill:
        res = res.withColumn(tgt, F.coalesce(ffill(tgt, order_col, partition_cols),
                                             bfill(tgt, order_col, partition_cols)))
    return res


def fill_series(df: DataFrame, c: str, order_col: str, method: str = "auto", partition_cols=()) -> DataFrame:
    """Auto (time interpolation -> ffill -> bfill), ffill, bfill, zero, mean, median,
    interpolate (linear), drop."""
    if method == "drop":
        return df.where(F.col(c).isNotNull())
    if method == "auto":
        return interpolate_time(df, c, order_col, partition_cols)
    if method == "interpolate":
        return interpolate_linear(df, c, order_col, partition_cols)
    return df.withColumn(c, fill_column(c, method, order_col, partition_cols))


# ------------------------------------------------------------------ features

def _fill_distributed(base: DataFrame, names: list[str], order: list[str], method: str) -> DataFrame:
    """Fill rules for the long-series path without any un-partitioned window."""
    from strata.operators.ordered import fill_ordered
    if method == "none":
        return base
    if method == "zero":
        return base.na.fill(0.0, subset=names)
    if method in ("mean", "median"):
        if method == "mean":
            vals = base.agg(*[F.avg(n).alias(n) for n in names]).first().asDict()
        else:
            from strata.functions.stats import median_of
            vals = median_of(base, names)
        return base.na.fill({n: v for n, v in vals.items() if v is not None})
    steps = [method] if method in ("ffill", "bfill") else ["ffill", "bfill"]
    for n in names:
        for m in steps:
            base = fill_ordered(base, n, order, m)
    return base


def lag_features(df: DataFrame, target: str, order_col, lags=(1, 2, 3, 7, 14, 30),
                 fill_method: str = "ffill", partition_cols=(), distributed: bool = False) -> DataFrame:
    """``{target}_lag_{k}`` columns with the reference's fill rules.

    ``distributed=True`` (one long series, no partition key) computes the lags with
    range partitions and halo rows (``operators.ordered``) instead of a one-task window."""
    names = [f"{target}_lag_{k}" for k in lags]
    if distributed and not partition_cols:
        from strata.operators.ordered import fill_ordered, lag_features_ordered
        order = [order_col] if isinstance(order_col, str) else list(order_col)
        return _fill_distributed(lag_features_ordered(df, target, order, lags), names, order, fill_method)
    w = _w(order_col, partition_cols)
    base = df.select("*", *[F.lag(target, k).over(w).alias(n) for k, n in zip(lags, names)])
    return base.select(*[c for c in base.columns if c not in names],
                       *[fill_column(n, fill_method, order_col, partition_cols).alias(n) for n in names])


def rolling_features(df: DataFrame, target: str, order_col, windows=(7, 14, 30), fill_method: str = "ffill",
                     min_periods: int | None = None, partition_cols=(), exclude_current: bool = False,
                     distributed: bool = False) -> DataFrame:
    """Rolling mean / sample std / min / max over trailing windows.

    ``min_periods`` defaults to 1 (reference). ``exclude_current`` shifts the frame one
    row back to avoid the target leakage of the reference (D9). ``distributed=True`` (one
    long series) uses range partitions with halo rows instead of a one-task window.
    """
    mp = 1 if min_periods is None else min_periods
    if distributed and not partition_cols and not exclude_current:
        from strata.operators.ordered import fill_ordered, rolling_features_ordered
        order = [order_col] if isinstance(order_col, str) else list(order_col)
        names = [f"{target}_rolling_{st}_{w}" for w in windows for st in ("mean", "std", "min", "max")]
        return _fill_distributed(rolling_features_ordered(df, target, order, windows, mp), names, order, fill_method)
    w = _w(order_col, partition_cols)
    cols, names = [], []
    for win in windows:
        frame = w.rowsBetween(-win, -1) if exclude_current else w.rowsBetween(-(win - 1), 0)
        ok = F.count(target).over(frame) >= mp
        for stat, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            n = f"{target}_rolling_{stat}_{win}"
            cols.append(F.when(ok, fn(target).over(frame)).alias(n))
            names.append(n)
    base = df.select("*", *cols)
    return base.select(*[c for c in base.columns if c not in names],
                       *[fill_column(n, fill_method, order_col, partition_cols).alias(n) for n in names])


def rolling_mean_std_diff(df: DataFrame, target: str, order_col, window: int = 5, partition_cols=()) -> DataFrame:
    """Window mean/std needing a full window (min_periods = window) and first difference."""
    w = _w(order_col, partition_cols)
    frame = w.rowsBetween(-(window - 1), 0)
    full = F.count(target).over(frame) >= window
    return df.select("*", F.when(full, F.avg(target).over(frame)).alias("rolling_mean"),
                     F.when(full, F.stddev_samp(target).over(frame)).alias("rolling_std"),
                     (F.col(target) - F.lag(target, 1).over(w)).alias("diff"))


def rolling_zscore(df: DataFrame, target: str, order_col, window_size: int = 5, threshold: float = 3.0,
                   partition_cols=(), exclude_current: bool = False) -> DataFrame:
    """|x - rolling mean| / rolling std with ffill+bfill of the stats; 0 when std is 0.

    Reference mode keeps the tested point inside its window (D5); ``exclude_current``
    uses the previous ``window_size`` points instead.
    """
    w = _w(order_col, partition_cols)
    frame = w.rowsBetween(-window_size, -1) if exclude_current else w.rowsBetween(-(window_size - 1), 0)
    full = F.count(target).over(frame) >= window_size
    base = df.select("*", F.when(full, F.avg(target).over(frame)).alias("__m"),
                     F.when(full, F.stddev_samp(target).over(frame)).alias("__s"))
    m = F.coalesce(ffill("__m", order_col, partition_cols), bfill("__m", order_col, partition_cols))
    s = F.coalesce(ffill("__s", order_col, partition_cols), bfill("__s", order_col, partition_cols))
    base = base.select(*[c for c in base.columns if c not in ("__m", "__s")],
                       m.alias("rolling_mean"), s.alias("rolling_std"))
    z = F.coalesce(F.when(F.col("rolling_std") != 0,
                          F.abs(F.col(target) - F.col("rolling_mean")) / F.col("rolling_std")), F.lit(0.0))
    return base.withColumn("z_score", z).withColumn("is_anomaly", F.col("z_score") > threshold)


def pct_change_yoy(df: DataFrame, target: str, order_col, period: int = 365, partition_cols=()) -> DataFrame:
    """(x / x[-period] - 1) * 100; needs >= period points; rows with null change dropped."""
    w = _w(order_col, partition_cols)
    n = F.count(F.lit(1)).over(_part(partition_cols))
    prev = F.lag(target, period).over(w)
    out = df.select("*", F.when(n >= period, (F.try_divide(F.col(target), prev) - 1) * 100).alias("yoy_pct"))
    return out.where(F.col("yoy_pct").isNotNull())


def moving_averages(df: DataFrame, target: str, order_col, partition_cols=()) -> DataFrame:
    """Short window min(7, n//4) (needs >= 2) and long min(30, n//2) (needs > short).

    Window sizes depend on the series length, so they are resolved per series by
    a count window and applied with a frame as wide as the largest allowed (30).
    """
    w = _w(order_col, partition_cols)
    n = F.count(F.lit(1)).over(_part(partition_cols))
    short = F.least(F.lit(7), F.floor(n / 4))
    long_ = F.least(F.lit(30), F.floor(n / 2))
    pos = F.row_number().over(w)
    vals = F.collect_list(F.struct(pos.alias("p"), F.col(target).alias("v"))).over(w.rowsBetween(-29, 0))
    tmp = df.select("*", short.alias("__ws"), long_.alias("__wl"), pos.alias("__pos"), vals.alias("__vals"))

    def win_mean(wcol):
        sel = F.filter("__vals", lambda s: s["p"] > F.col("__pos") - F.col(wcol))
        cnt = F.size(sel)
        tot = F.aggregate(sel, F.lit(0.0), lambda acc, s: acc + s["v"])
        # pandas rolling(w) needs w non-null values
        nn = F.size(F.filter(sel, lambda s: s["v"].isNotNull()))
        return F.when((cnt == F.col(wcol)) & (nn == F.col(wcol)), tot / F.col(wcol))

    out = tmp.select(*df.columns,
                     F.when(F.col("__ws") >= 2, win_mean("__ws")).alias("ma_short"),
                     F.when((F.col("__ws") >= 2) & (F.col("__wl") > F.col("__ws")), win_mean("__wl")).alias("ma_long"),
                     F.col("__ws").cast("int").alias("short_window"), F.col("__wl").cast("int").alias("long_window"))
    return out


def lookback_sequences(df: DataFrame, target: str, order_col, look_back: int = 60, partition_cols=(),
                       train_fraction: float = 0.8) -> DataFrame:
    """Previous ``look_back`` values as an array, the current value as label,
    chronological 80/20 split tag over the rows that have a full history."""
    w = _w(order_col, partition_cols)
    hist = F.collect_list(target).over(w.rowsBetween(-look_back, -1))
    base = df.select("*", hist.alias("sequence")).where(F.size("sequence") == look_back)
    rn = F.row_number().over(_w(order_col, partition_cols))
    n = F.count(F.lit(1)).over(_part(partition_cols))
    return base.select("*", F.when(rn <= F.floor(n * train_fraction), "train").otherwise("test").alias("split"))


def sliding_windows(df: DataFrame, target: str, order_col, sequence_length: int = 10, partition_cols=()) -> DataFrame:
    """Arrays of ``sequence_length`` values ending at each row (full windows only)."""
    w = _w(order_col, partition_cols)
    seq = F.collect_list(target).over(w.rowsBetween(-(sequence_length - 1), 0))
    return df.select("*", seq.alias("window")).where(F.size("window") == sequence_length)


def keep_first_per_key_agg(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """W13, skew-safe form: min id per key by partial aggregation, then an equi-join."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("__first"))
    j = df.join(first, key, "left")
    return j.select(*[F.when(F.col(id_col) == F.col("__first"), F.col(key)).alias(key) if c == key else F.col(c)
                      for c in df.columns])


def latest_per_key(df: DataFrame, key: str, ts_col: str, tiebreak: str | None = None) -> DataFrame:
    """Newest row per key via ``max_by`` (aggregate with partial combine, no sort)."""
    order = F.struct(F.col(ts_col), F.col(tiebreak)) if tiebreak else F.col(ts_col)
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r"))
    return agg.select(key, "r.*")


def chronological_split(df: DataFrame, order_col, train_fraction: float = 0.8, partition_cols=(),
                        distributed: bool = False) -> DataFrame:
    """First int(0.8 n) rows by order are train, the rest test.

    ``distributed=True`` (one long series) takes positions from the distributed prefix
    count (range partitions) instead of a one-task ``row_number`` window."""
    if distributed and not partition_cols:
        from strata.operators.ranks import prefix_count
        order = [order_col] if isinstance(order_col, str) else list(order_col)
        n = df.count()
        cut = int(n * train_fraction)
        pos = prefix_count(df, order, out="__pos")
        return pos.select(*df.columns, F.when(F.col("__pos") <= cut, "train").otherwise("test").alias("split"))
    rn = F.row_number().over(_w(order_col, partition_cols))
    n = F.count(F.lit(1)).over(_part(partition_cols))
    return df.select("*", F.when(rn <= F.floor(n * train_fraction), "train").otherwise("test").alias("split"))


def centered_moving_average(df: DataFrame, target: str, order_col, period: int, partition_cols=(),
                            out: str = "trend") -> DataFrame:
    """Centred mean over one period (2xp weights for even p), null where the frame is short."""
    w = _w(order_col, partition_cols)
    if period % 2 == 1:
        h = period // 2
        frame = w.rowsBetween(-h, h)
        ok = F.count(target).over(frame) == period
        val = F.when(ok, F.avg(target).over(frame))
    else:
        h = period // 2
        frame = w.rowsBetween(-h, h)
        ok = F.count(target).over(frame) == period + 1
        s = F.sum(target).over(frame)
        ends = F.lag(target, h).over(w) + F.lead(target, h).over(w)
        val = F.when(ok, (s - ends / 2) / period)
    return df.withColumn(out, val)
