"""Ordered operators over one long, un-partitioned series without a one-task window.

``Window.orderBy(t)`` with no partition key sorts the whole series in one
task. Here the series is range-partitioned by the order key and sorted
within partitions (checkpointed so every pass sees the same partitions);
each partition then needs only

* a *halo*: the last ``h`` rows before it (lags and trailing frames of
  width <= h + 1), and
* a *carry*: the last / first non-null value before / after it (forward /
  backward fill),

both bounded by (partitions x h) rows and gathered by one small pass.
``mapInPandas`` streams each partition's Arrow batches in order, prepending
the halo (from earlier partitions, then from the previous batch), so memory
per task is one batch plus ``h`` rows. Order keys must be unique.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import checkpoint_dir


def _partitioned(df: DataFrame, order_cols: list[str], num_partitions: int | None, descending: bool = False):
    checkpoint_dir(df.sparkSession)
    p = num_partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.desc(c) for c in order_cols] if descending else [F.col(c) for c in order_cols]
    s = df.repartitionByRange(p, *keys).sortWithinPartitions(*keys).withColumn("__pid", F.spark_partition_id())
    return s.checkpoint(eager=True)


def _halo_rows(s: DataFrame, h: int) -> dict[int, pd.DataFrame]:
    """For each partition id: the last h rows of all earlier partitions (at most h rows).

    Each task streams its sorted batches and emits only its last h rows, so the driver
    receives at most partitions x h rows."""
    if h <= 0:
        return {}

    def tail(it):
        last = None
        for pdf in it:
            if len(pdf):
                last = pdf.tail(h) if last is None else pd.concat([last, pdf]).tail(h)
        if last is not None:
            yield last

    tails = s.mapInPandas(tail, s.schema).toPandas()
    n = int(tails["__pid"].max()) + 2 if len(tails) else 1
    out, acc = {}, None
    for pid in range(n):
        out[pid] = acc
        part = tails[tails["__pid"] == pid]
        if len(part):
            acc = part.tail(h) if acc is None else pd.concat([acc, part], ignore_index=True).tail(h)
    return out


def apply_ordered(df: DataFrame, order_cols: list[str], fn, out_schema: T.StructType, halo: int = 0,
                  num_partitions: int | None = None) -> DataFrame:
    """Run ``fn(pdf) -> pdf`` over each range partition batch by batch with ``halo`` preceding
    rows prepended (column ``__halo`` marks them); halo rows are dropped from the output."""
    s = _partitioned(df, order_cols, num_partitions)
    halos = _halo_rows(s, halo)
    cols = [c for c in s.columns if c != "__pid"]

    def run(it):
        prev, started = None, False
        for pdf in it:
            if len(pdf) == 0:
                continue
            if not started:
                prev, started = halos.get(int(pdf["__pid"].iloc[0])), True
            cur = pdf.assign(__halo=False)
            if prev is not None and len(prev):
                cur = pd.concat([prev.assign(__halo=True), cur], ignore_index=True)
            res = fn(cur[cols + ["__halo"]].reset_index(drop=True))
            yield res[~res["__halo"].astype(bool)].drop(columns=["__halo"])
            if halo > 0:  # a batch may be shorter than the halo
                prev = pdf.tail(halo) if prev is None else pd.concat([prev, pdf], ignore_index=True).tail(halo)

    return s.mapInPandas(run, out_schema)


def apply_between(df: DataFrame, order_cols: list[str], halo: int, fn, out_schema: str, num_partitions: int | None = None) -> DataFrame:
    """``fn(table, first, last)`` on each range partition's sorted rows as one Arrow table, with the ``halo`` rows before
    and after it; its own rows are first to last. The driver receives at most partitions x 2 ``halo`` rows."""
    s = _partitioned(df, order_cols, num_partitions)
    cols = [c for c in s.columns if c != "__pid"]

    def ends(batches):
        own = [b for b in batches if b.num_rows]
        if own:
            t = pa.Table.from_batches(own)
            yield from (t if t.num_rows <= 2 * halo else pa.concat_tables([t.slice(0, halo), t.slice(t.num_rows - halo)])).to_batches()

    edges = s.mapInArrow(ends, s.schema).toArrow()
    pids = edges["__pid"].to_numpy()
    edges = edges.select(cols)
    kept = {}
    for pid in np.unique(pids).tolist():
        before, after = np.flatnonzero(pids < pid), np.flatnonzero(pids > pid)
        before, after = before[np.argsort(pids[before], kind="stable")][-halo:], after[np.argsort(pids[after], kind="stable")][:halo]
        kept[pid] = (edges.take(pa.array(before)), edges.take(pa.array(after)))
    known = df.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if own:
            own = pa.Table.from_batches(own)
            before, after = known.value[own["__pid"][0].as_py()]
            own = own.select(cols)
            t = pa.concat_tables([before.cast(own.schema), own, after.cast(own.schema)])
            yield from fn(t, before.num_rows, before.num_rows + own.num_rows).to_batches()

    return s.mapInArrow(run, out_schema)


def lag_features_ordered(df: DataFrame, target: str, order_cols: list[str], lags=(1, 2, 3, 7, 14, 30),
                         num_partitions: int | None = None) -> DataFrame:
    """W1 for one long series (distributed): ``{target}_lag_{k}`` before fills."""
    fields = list(df.schema.fields) + [T.StructField(f"{target}_lag_{k}", T.DoubleType()) for k in lags]

    def fn(pdf):
        x = pdf[target].astype(float)
        for k in lags:
            pdf[f"{target}_lag_{k}"] = x.shift(k)
        return pdf

    return apply_ordered(df, order_cols, fn, T.StructType(fields), halo=max(lags), num_partitions=num_partitions)


def rolling_features_ordered(df: DataFrame, target: str, order_cols: list[str], windows=(7, 14, 30),
                             min_periods: int = 1, num_partitions: int | None = None) -> DataFrame:
    """W2 for one long series (distributed): trailing mean / sample std / min / max before fills."""
    fields = list(df.schema.fields)
    for w in windows:
        fields += [T.StructField(f"{target}_rolling_{s}_{w}", T.DoubleType()) for s in ("mean", "std", "min", "max")]

    def fn(pdf):
        x = pdf[target].astype(float)
        for w in windows:
            r = x.rolling(w, min_periods=min_periods)
            pdf[f"{target}_rolling_mean_{w}"] = r.mean()
            pdf[f"{target}_rolling_std_{w}"] = r.std()
            pdf[f"{target}_rolling_min_{w}"] = r.min()
            pdf[f"{target}_rolling_max_{w}"] = r.max()
        return pdf

    return apply_ordered(df, order_cols, fn, T.StructType(fields), halo=max(windows) - 1,
                         num_partitions=num_partitions)


def fill_ordered(df: DataFrame, col: str, order_cols: list[str], method: str = "ffill",
                 num_partitions: int | None = None) -> DataFrame:
    """W4 / W5 for one long series (distributed): forward / backward fill with a carry.

    A backward fill is a forward fill in descending order, so both stream batches in
    processing order; the carry into a partition is the last non-null value of the
    partitions processed before it (one value per partition reaches the driver)."""
    s = _partitioned(df, order_cols, num_partitions, descending=(method == "bfill"))

    def last_valid(it):
        pid, val = None, None
        for pdf in it:
            if len(pdf):
                pid = int(pdf["__pid"].iloc[0])
                v = pdf[col].dropna()
                if len(v):
                    val = float(v.iloc[-1])
        if pid is not None:
            yield pd.DataFrame({"pid": [pid], "v": [val]})

    edge = s.mapInPandas(last_valid, "pid int, v double").toPandas().sort_values("pid")
    carry, cur = {}, None
    for pid, v in zip(edge["pid"], edge["v"]):
        carry[int(pid)] = cur
        if v is not None and v == v:
            cur = v
    cols = [c for c in s.columns if c != "__pid"]

    def run(it):
        c, started = None, False
        for pdf in it:
            if len(pdf) == 0:
                continue
            if not started:
                c, started = carry.get(int(pdf["__pid"].iloc[0])), True
            v = pdf[col].astype(float).ffill()
            if c is not None:
                v = v.fillna(c)
            valid = v.dropna()
            if len(valid):
                c = float(valid.iloc[-1])
            pdf[col] = v
            yield pdf[cols]

    fields = [f if f.name != col else T.StructField(col, T.DoubleType()) for f in df.schema.fields]
    return s.mapInPandas(run, T.StructType(fields))


def interpolate_time_ordered(df: DataFrame, col: str, order_cols: list[str], time_col: str,
                             num_partitions: int | None = None) -> DataFrame:
    """W6 for one long series (distributed): linear interpolation in time between the
    previous and next known values, then forward and backward fill.

    The previous known (t, y) is a forward fill of two helper columns that are non-null on
    the same rows, the next known (t, y) a backward fill of the same helpers; each fill is
    the range-partitioned pass above, so no step sorts the series in one task."""
    t = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")
    known = F.col(col).isNotNull()
    base = df.select("*", F.when(known, t).alias("__pt"), F.when(known, F.col(col)).alias("__py"),
                     F.when(known, t).alias("__nt"), F.when(known, F.col(col)).alias("__ny"), t.alias("__t"))
    for c in ("__pt", "__py"):
        base = fill_ordered(base, c, order_cols, "ffill", num_partitions)
    for c in ("__nt", "__ny"):
        base = fill_ordered(base, c, order_cols, "bfill", num_partitions)
    span = F.col("__nt") - F.col("__pt")
    lin = F.col("__py") + (F.col("__ny") - F.col("__py")) * F.try_divide(F.col("__t") - F.col("__pt"), span)
    v = (F.when(known, F.col(col))
         .when(F.col("__py").isNotNull() & F.col("__ny").isNotNull(), F.when(span == 0, F.col("__py")).otherwise(lin))
         .when(F.col("__py").isNotNull(), F.col("__py"))
         .otherwise(F.col("__ny")))  # leading gap: backward fill
    return base.select(*[v.cast("double").alias(c) if c == col else F.col(c) for c in df.columns])


def decompose_additive_ordered(df: DataFrame, order_cols: list[str], value_col: str, period: int,
                               num_partitions: int | None = None) -> DataFrame:
    """T3 for one long series (distributed): additive decomposition without one-task windows.

    Positions come from the distributed prefix count. The centred moving average at
    position i equals a trailing frame of p (odd) or p + 1 (even, half weights at the ends)
    values ending at i + h, so it is computed with the halo mechanism and shifted back by an
    equi-join on position. Phase means (position mod p) are a grouped aggregate."""
    from strata.operators.ranks import prefix_count
    h = period // 2
    clean = df.where(F.col(value_col).isNotNull()).select(*order_cols, F.col(value_col).alias("__x"))
    pos = prefix_count(clean, order_cols, out="__p").withColumn("pos", F.col("__p") - 1).drop("__p")
    width = period + 1 if period % 2 == 0 else period
    fields = list(pos.schema.fields) + [T.StructField("__t", T.DoubleType())]

    def fn(pdf):
        x = pdf["__x"].astype(float)
        if period % 2 == 0:
            s = x.rolling(width).sum()
            pdf["__t"] = (s - (x.shift(width - 1) + x) / 2) / period
        else:
            pdf["__t"] = x.rolling(width).sum() / period
        return pdf

    trailing = apply_ordered(pos, ["pos"], fn, T.StructType(fields), halo=width - 1, num_partitions=num_partitions)
    trend = trailing.select((F.col("pos") - h).alias("pos"), F.col("__t").alias("trend"))
    s = pos.join(trend, "pos", "left").withColumn("phase", F.col("pos") % period)
    ph = s.groupBy("phase").agg(F.avg(F.col("__x") - F.col("trend")).alias("__pm"))
    mean_pm = ph.agg(F.avg("__pm")).first()[0]  # one number (period rows)
    ph = ph.select("phase", (F.col("__pm") - F.lit(mean_pm)).alias("seasonal"))
    out = s.join(F.broadcast(ph), "phase")  # period rows: bounded
    return out.select(*order_cols, "pos", F.col("__x").alias(value_col), F.lit(period).alias("period"), "trend",
                      "seasonal", (F.col("__x") - F.col("trend") - F.col("seasonal")).alias("resid"))
