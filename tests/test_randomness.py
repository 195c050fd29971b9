"""Seeded hashes are uniform and independent; halos survive batches shorter than themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.stats import seeded_hash
from strata.operators import balance as B
from strata.operators import ordered as O


def test_seeded_hash_is_uniform(spark):
    h = np.array([r[0] for r in spark.range(20_000).select(seeded_hash(F.col("id"))).collect()], dtype=float) / 2**60
    low = np.sort(np.argsort(h)[:1000])
    gaps = np.diff(low)
    assert len(set(gaps.tolist())) > 50 and abs(gaps.std() / gaps.mean() - 1) < 0.15  # geometric gaps, no lattice
    counts = np.histogram(h, 20, (0, 1))[0]
    assert ((counts - 1000) ** 2 / 1000).sum() < 50
    bits = (h * 2**20).astype(int) & 1
    assert abs(np.corrcoef(bits, np.arange(20_000) % 2)[0, 1]) < 0.03


def test_salts_are_independent(spark):
    rows = spark.range(5000).select(*[(seeded_hash(F.col("id"), 42, s) / F.lit(float(1 << 60))).alias(f"s{s}") for s in (0, 2, 3, 4)]).toPandas()
    c = rows.corr().to_numpy()
    assert np.abs(c - np.eye(4)).max() < 0.06


@pytest.mark.parametrize("n_base", [50, 51, 55])
def test_smote_uses_all_neighbours(spark, n_base):
    """Every base row meets all its neighbours when each is drawn often."""
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y), "a") for i, (x, y) in enumerate(rng.normal(size=(n_base, 2)))]
    pts += [(1000 + i, float(x), float(y), "b") for i, (x, y) in enumerate(rng.normal(size=(n_base + 1500, 2)) + 9)]
    df = spark.createDataFrame(pts, "id long, x double, y double, label string")
    syn = B.balance_smote(df, "label", "id", ["x", "y"], k=5).where("synthetic").toPandas()
    base = np.array([(p[1], p[2]) for p in pts[:n_base]])
    d = np.linalg.norm(base[:, None] - base[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    hit, weights = set(), []
    for p in syn[["x", "y"]].to_numpy():
        for i in range(n_base):
            for j in near[i]:
                v = base[j] - base[i]
                u = (p - base[i]) @ v / (v @ v)
                if -1e-9 <= u < 1 and np.allclose(base[i] + u * v, p, atol=1e-9):
                    hit.add(frozenset((i, int(j))))
                    weights.append(u)
    segments = {frozenset((i, int(j))) for i in range(n_base) for j in near[i]}
    assert len(hit) > 0.97 * len(segments)
    assert abs(np.mean(weights) - 0.5) < 0.05


def test_synthetic_ids_are_stable(spark):
    df = spark.createDataFrame([(i, float(i), "a" if i < 12 else "b") for i in range(60)], "id long, x double, label string")
    a, b = (B.balance_smote(df.repartition(n), "label", "id", ["x"], k=3, synthetic_ids=True).where("synthetic").toPandas().sort_values("id") for n in (1, 5))
    assert a["id"].tolist() == b["id"].tolist() == list(range(60, 96)) and np.allclose(a["x"], b["x"])


@pytest.mark.parametrize("batch", [5, 10])
def test_halo_longer_than_batches(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = np.random.default_rng(2)
        y = rng.normal(size=200)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double")
        got = O.lag_features_ordered(df, "y", ["t"], lags=(1, 30), num_partitions=2).toPandas().sort_values("t")
        s = pd.Series(y)
        for k in (1, 30):
            assert np.allclose(got[f"y_lag_{k}"], s.shift(k), equal_nan=True)
        got = O.rolling_features_ordered(df, "y", ["t"], windows=(30,), num_partitions=2).toPandas().sort_values("t")
        assert np.allclose(got["y_rolling_mean_30"], s.rolling(30, min_periods=1).mean())
        dec = O.decompose_additive_ordered(df, ["t"], "y", 24, num_partitions=2).toPandas().sort_values("t")
        w = np.r_[0.5, np.ones(23), 0.5] / 24
        assert np.allclose(dec["trend"].to_numpy()[12:-12], np.convolve(y, w, "valid"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
