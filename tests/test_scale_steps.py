"""Steps that must not grow with the square of a state, the pairs of a table or the trees of a forest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from strata.operators import statespace


@pytest.mark.parametrize("order,seasonal", [((1, 1, 1), (1, 1, 1, 12)), ((2, 0, 1), (0, 0, 0, 0)), ((0, 1, 2), (0, 1, 1, 4))])
def test_likelihood_keeps_vectors_and_equals_the_dense_one(order, seasonal):
    model = statespace.Model(order, seasonal)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.7, (5, model.k))
    phi, theta, _ = model.polynomials(x)
    n = np.array([30, 41, 25, 41, 33])
    z = np.zeros((5, 41, 1))
    for i, k in enumerate(n):
        z[i, :k, 0] = rng.normal(size=k)
    found = statespace.likelihood(phi, theta, z, n)["llf"]
    for i, k in enumerate(n):  # covariances from a long expansion in innovations
        psi = np.zeros(4000)
        for j in range(4000):
            psi[j] = (1.0 if j == 0 else theta[i][j - 1] if j <= theta.shape[1] else 0.0) + sum(phi[i][m] * psi[j - 1 - m] for m in range(min(j, phi.shape[1])))
        gamma = np.array([psi[:4000 - h] @ psi[h:] for h in range(k)])
        cov = gamma[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        y = z[i, :k, 0]
        dense = -k / 2 * (math.log(2 * math.pi * (y @ np.linalg.solve(cov, y)) / k) + 1) - np.linalg.slogdet(cov)[1] / 2
        assert found[i] == pytest.approx(dense, abs=1e-6)
    r = max(phi.shape[1], theta.shape[1] + 1)
    load = np.concatenate([np.ones((5, 1)), np.pad(theta, ((0, 0), (0, r - 1 - theta.shape[1])))], axis=1)
    assert statespace._start(np.pad(phi, ((0, 0), (0, r - phi.shape[1]))), load).shape == (5, r)


def _silhouette(x, c):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    score = []
    for i in range(len(x)):
        mean = {k: d[i, (c == k) & (np.arange(len(x)) != i)].mean() for k in set(c.tolist()) if ((c == k) & (np.arange(len(x)) != i)).any()}
        a, b = mean.get(c[i]), min((v for k, v in mean.items() if k != c[i]), default=None)
        score.append(0.0 if a is None or b is None else (b - a) / max(a, b))
    return np.mean(score)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_silhouette_over_several_blocks(spark, monkeypatch, offset):
    from strata.operators import cluster, neighbors
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(cluster, "PAIR_CELLS", 500)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 3)), 3)
    x[:20] = x[20:40]
    c = rng.integers(0, 4, 150)
    c[7] = 9
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "cluster": c, "v": (x + offset).tolist()}))
    assert cluster.silhouette(df, "id", "v") == pytest.approx(_silhouette(x, c), abs=1e-7)


def test_silhouette_of_missing_rows(spark):
    from strata.operators import cluster
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [5.0, 0.0]), (4, 1, None), (5, None, [2.0, 0.0]), (6, 1, [None, 0.0])],
                               "id long, cluster int, v array<double>")
    assert cluster.silhouette(df, "id", "v") == pytest.approx(((5 - 1) / 5 + (4 - 1) / 4) / 6)


def test_forests_of_many_series_equal_those_grown_alone():
    from strata.operators import anomaly
    from strata.operators.outliers import _build_tree, _c, _path_lengths
    rng = np.random.default_rng(6)
    series = [rng.normal(size=300), np.arange(40) % 2.0, np.round(rng.normal(size=257)), rng.normal(size=2), np.ones(12), rng.normal(size=120)]
    xs = [anomaly._features(y) for y in series]
    for x, found in zip(xs, anomaly._iforests(xs, 42, n_trees=15), strict=True):
        draws, psi, h = np.random.default_rng(42), min(256, len(x)), 0.0
        for _ in range(15):
            idx = draws.choice(len(x), size=psi, replace=False)
            h = h + _path_lengths(x, _build_tree(x[idx], draws, math.ceil(math.log2(psi))))
        assert (found == np.power(2.0, -(h / 15) / _c(psi))).all()


def test_series_cut_by_batches_are_scored_whole(spark, monkeypatch):
    from strata.operators import anomaly
    rng = np.random.default_rng(8)
    days = pd.date_range("2024-01-01", periods=60).date
    frames = [pd.DataFrame({"k": k, "t": days[:n], "y": rng.normal(size=n)}) for k, n in (("a", 60), ("b", 25), (None, 30), ("c", 41))]
    data = pd.concat(frames).sample(frac=1, random_state=1)
    df = spark.createDataFrame(data, "k string, t date, y double")
    methods = ["isolation_forest", "lstm_autoencoder", "statistical", "prophet", "one_class_svm"]
    monkeypatch.setattr(anomaly, "HELD_ROWS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(m, r["k"], r["t"]): r for m in methods for r in anomaly.detect_series(df.coalesce(1), "t", "y", ("k",), m).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(methods) * len(data)
    for f in frames:
        y, key = f["y"].to_numpy(), f["k"].iloc[0]
        day = pd.to_datetime(f["t"]).astype("int64").to_numpy() / 86400e9
        for m, (s, flag) in {"isolation_forest": anomaly.score_iforest(y), "lstm_autoencoder": anomaly.score_reconstruction(y),
                             "prophet": anomaly.score_trend_season(y, day), "one_class_svm": anomaly.score_kernel_novelty(y)}.items():
            mine = [got[m, key, t] for t in f["t"]]
            assert np.allclose([r["score"] for r in mine], s, rtol=1e-9, atol=1e-12) and [r["is_anomaly"] for r in mine] == flag.tolist()
