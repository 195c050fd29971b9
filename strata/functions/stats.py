"""Aggregate expressions and exact, scale-safe quantiles.

pandas conventions reproduced here:
* ``skew``/``kurt`` are bias-corrected (G1/G2); Spark's are population moments.
* ``std`` is the sample deviation; numpy's is population.
* quantiles are linear-interpolated (= Spark ``percentile`` = DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("int", "bigint", "smallint", "tinyint", "double", "float")


def numeric_cols(df: DataFrame, include_decimal: bool = True) -> list[str]:
    """Columns whose dtype is a number (the pandas ``int64/float64`` classes)."""
    out = []
    for name, t in df.dtypes:
        if t in NUMERIC_TYPES or (include_decimal and t.startswith("decimal")):
            out.append(name)
    return out


def string_cols(df: DataFrame, include_bool: bool = False) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" or (include_bool and t == "boolean")]


def skew_corrected(c: Column | str) -> Column:
    """pandas ``Series.skew()``: G1 = g1 * sqrt(n(n-1)) / (n-2); null below 3 values."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_corrected(c: Column | str) -> Column:
    """pandas ``Series.kurt()``: G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); null below 4 values."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r that is null (not an error) when either side is constant."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def seeded_hash(c: Column, seed: int = 42, salt: int = 0) -> Column:
    """60-bit hash of a value (the first 15 hex digits of an md5) that DuckDB computes identically.

    Another ``salt`` gives an independent draw for the same value."""
    return seeded_hash_cols([c], seed, salt)


def seeded_hash_cols(cols: list, seed: int = 42, salt: int = 0) -> Column:
    """``seeded_hash`` of several columns together."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws(":", F.lit(f"{seed}:{salt}"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def seeded_hash_sql(cols: list[str], seed: int = 42, salt: int = 0) -> str:
    """DuckDB twin of ``seeded_hash`` / ``seeded_hash_cols``."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}:{salt}', {', '.join(cols)})), 1, 15) AS BIGINT)"


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


# ------------------------------------------------------------------ quantiles

DIGIT = 16  # bits that the first pass settles
MOST_BUCKETS = 1 << 20  # that a later pass may find: it settles fewer bits if many buckets are open
MOST_VALUES = 100_000  # rows left in all open buckets that end with a pass over their distinct values
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def _keys(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ _FLIP)


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= 0, keys, keys ^ _FLIP).view(np.float64)


def _bucket_counts(x: DataFrame, n_cols: int, shift: int, last: int, open_: dict[int, np.ndarray] | None) -> list:
    """(col, bucket, n, lo, hi): rows and range of keys of every bucket ``key >> shift`` within the open buckets
    ``key >> last`` of the pass before (per column; None: all), in one aggregate."""

    def group(parts):
        bucket, n, lo, hi = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        return (bucket[order][first], np.add.reduceat(n[order], first), np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first))

    def count(batches):
        held: list[list] = [[] for _ in range(n_cols)]
        for batch in batches:
            for i in range(n_cols):
                if open_ is not None and i not in open_:
                    continue
                keys = np.sort(_keys(batch.column(i).drop_null().to_numpy(zero_copy_only=False)))
                if open_ is not None:
                    above = keys >> np.int64(last)
                    at = np.minimum(np.searchsorted(open_[i], above), len(open_[i]) - 1)
                    keys = keys[open_[i][at] == above]
                if not len(keys):
                    continue
                bucket = keys >> np.int64(shift)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(first[1:], len(keys))
                held[i].append((bucket[first], ends - first, keys[first], keys[ends - 1]))
                if len(held[i]) >= 50:
                    held[i] = [group(held[i])]
        for i, parts in enumerate(held):
            if parts:
                cols = group(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), i, np.int32)), *map(pa.array, cols)], names=["col", "bucket", "n", "lo", "hi"])

    return (x.mapInArrow(count, "col int, bucket long, n long, lo long, hi long")
            .groupBy("col", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], _stable: bool = False) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles of whole columns by radix histograms.

    Doubles become order-preserving 64-bit keys. A pass counts, for all columns in one partial
    aggregate, the rows per leading ``DIGIT`` bits; each target rank lies in one bucket, and the next
    pass counts the next bits within those buckets only. A bucket with one value is settled at
    once, and as soon as all open buckets together hold at most ``MOST_VALUES`` rows, a pass
    over their distinct values ends the search: two passes for most tables, three for a thousand times the
    rows, never more than four for a few quantiles. Tasks hold counts of buckets, never rows; the driver gets at
    most 2**DIGIT buckets a column at first and ``MOST_BUCKETS`` later, and no value is sorted or ranked anywhere but within one Arrow batch.

    The input must give the same values each time (a scan or a checkpointed frame). If the passes disagree the
    whole computation is retried once on a checkpointed copy.

    Returns {(col, p): value}; null when the column has no values (nulls and NaN are none).
    """
    if not cols or not probs:
        return {}
    x = df.select([nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    ranks: dict[tuple[int, int], list] = {}  # (column, rank) -> [bucket, rank in it, rows in it, value]
    sizes: dict[int, int] = {}
    open_: dict[int, np.ndarray] | None = None
    shift, last = 64 - DIGIT, 63
    while open_ is None or open_:
        rows = _bucket_counts(x, len(cols), shift, last, open_)
        per: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["col"], r["bucket"])):
            per.setdefault(r["col"], []).append(r)
        if open_ is None:
            sizes = {i: sum(r["n"] for r in rs) for i, rs in per.items()}
            for i, n in sizes.items():
                for p in probs:
                    h = (n - 1) * p
                    for k in (int(math.floor(h)), int(math.ceil(h))):
                        ranks[i, k] = [None, k, n, None]
        bits = {i: np.array([r["bucket"] for r in rs], dtype=np.int64) for i, rs in per.items()}
        ends = {i: np.cumsum([r["n"] for r in rs]) for i, rs in per.items()}
        for (i, _), t in ranks.items():
            if t[3] is not None:
                continue
            # the buckets of this pass within the rank's bucket of the pass before
            a, b = (0, len(bits.get(i, ()))) if t[0] is None else np.searchsorted(bits[i] >> np.int64(last - shift), [t[0], t[0] + 1]) if i in bits else (0, 0)
            below = ends[i][a - 1] if a else 0
            if b <= a or ends[i][b - 1] - below != t[2]:
                # the passes saw different values: the input is recomputed non-deterministically
                # (e.g. floating sums after a shuffle). Retry once on a checkpointed copy.
                if _stable:
                    raise RuntimeError("exact_quantiles: inconsistent input across passes")
                from strata.session import checkpoint_dir
                checkpoint_dir(df.sparkSession)
                return exact_quantiles(df.select(*cols).checkpoint(), cols, probs, _stable=True)
            at = int(np.searchsorted(ends[i][a:b], below + t[1], side="right")) + a
            r = per[i][at]
            t[0], t[1], t[2] = r["bucket"], int(below + t[1] - (ends[i][at - 1] if at else 0)), r["n"]
            if r["lo"] == r["hi"]:
                t[3] = float(_doubles(np.array([r["lo"]], dtype=np.int64))[0])
        left: dict[int, dict[int, int]] = {}
        for (i, _), t in ranks.items():
            if t[3] is None:
                left.setdefault(i, {})[t[0]] = t[2]
        open_ = {i: np.array(sorted(b), dtype=np.int64) for i, b in left.items()}
        if open_ and sum(n for b in left.values() for n in b.values()) <= MOST_VALUES:
            _settle(x, len(cols), shift, open_, ranks)
            break
        buckets = sum(len(b) for b in open_.values())
        digit = min(DIGIT, max(4, (MOST_BUCKETS // max(buckets, 1)).bit_length() - 1))
        shift, last = max(0, shift - digit), shift
    out: dict[tuple[str, float], float | None] = {}
    for i, c in enumerate(cols):
        for p in probs:
            if not sizes.get(i):
                out[c, p] = None
                continue
            h = (sizes[i] - 1) * p
            v0, v1 = ranks[i, int(math.floor(h))][3], ranks[i, int(math.ceil(h))][3]
            out[c, p] = v0 if v0 == v1 else v0 + (v1 - v0) * (h - math.floor(h))
    return out


def _settle(x: DataFrame, n_cols: int, shift: int, open_: dict[int, np.ndarray], ranks: dict) -> None:
    """The values at all open ranks, from the (at most MOST_VALUES) rows in their buckets."""

    def pick(batches):
        for batch in batches:
            for i, buckets in open_.items():
                keys = _keys(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                above = keys >> np.int64(shift)
                at = np.minimum(np.searchsorted(buckets, above), len(buckets) - 1)
                value, n = np.unique(keys[buckets[at] == above], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(value), pa.array(n)], names=["col", "key", "n"])

    rows = x.mapInArrow(pick, "col int, key long, n long").groupBy("col", "key").agg(F.sum("n").alias("n")).collect()
    for i in open_:
        mine = sorted((r["key"], r["n"]) for r in rows if r["col"] == i)
        keys, ends = np.array([k for k, _ in mine], dtype=np.int64), np.cumsum([n for _, n in mine])
        for (j, _), t in ranks.items():
            if j == i and t[3] is None:
                a = int(np.searchsorted(keys >> np.int64(shift), t[0]))
                at = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + t[1], side="right"))
                t[3] = float(_doubles(keys[at:at + 1])[0])


def median_of(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    q = exact_quantiles(df, cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols}
