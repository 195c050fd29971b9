"""Dimensionality reduction.

PCA and truncated SVD need only the d x d Gram / covariance matrix: each
partition sums X^T X in numpy (``mapInPandas``), one aggregate adds the
partials, the small eigenproblem is solved on the driver, and the
projection is a column expression over the rows. LDA uses class means and
scatter matrices from the same aggregate pattern.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _x(df: DataFrame, features) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("__x", F.transform(F.col(features), lambda v: v.cast("double")))
    return df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in features]))


def gram(df: DataFrame, features, group_col: str | None = None) -> dict:
    """Sums n, sum x and X^T X (per group when given) from per-partition numpy partials."""
    x = _x(df, features).select(*( [group_col] if group_col else []), "__x")

    def part(it):
        acc = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            keys = pdf[group_col].to_numpy() if group_col else np.zeros(len(pdf), dtype=np.int64)
            X = np.vstack(pdf["__x"].to_numpy()).astype(float)
            for g in np.unique(keys):
                Xg = X[keys == g]
                n, s, G = acc.get(g, (0, 0.0, 0.0))
                acc[g] = (n + len(Xg), s + Xg.sum(axis=0), G + Xg.T @ Xg)
        for g, (n, sums, G) in acc.items():
            flat = np.concatenate([[n], sums, G.ravel()])
            yield pd.DataFrame({"g": str(g), "i": np.arange(len(flat)), "v": flat})

    # tasks' matrices are added by Spark: one matrix per group reaches the driver
    total = x.mapInPandas(part, "g string, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    out = {}
    for g, cells in total.groupby("g"):
        v = cells.sort_values("i")["v"].to_numpy()
        d = int(round((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2))
        out[g] = (int(v[0]), v[1:1 + d], v[1 + d:].reshape(d, d))
    return out


def _project(df: DataFrame, features, comps: np.ndarray, center: np.ndarray | None, prefix: str) -> DataFrame:
    x = _x(df, features)
    cols = []
    for j in range(comps.shape[1]):
        w = [float(v) for v in comps[:, j]]
        shift = float(center @ comps[:, j]) if center is not None else 0.0
        cols.append((F.aggregate(F.zip_with("__x", F.array(*[F.lit(v) for v in w]), lambda a, b: a * b),
                                 F.lit(0.0), lambda acc, v: acc + v) - F.lit(shift)).alias(f"{prefix}{j + 1}"))
    return x.select(*df.columns, *cols)


def reduce_pca(df: DataFrame, features, k: int) -> tuple[DataFrame, np.ndarray]:
    """Principal components of the centred data (covariance eigenvectors), scores pc1..pck.
    Returns (frame, explained variance ratios). Component signs: largest |loading| positive."""
    g = gram(df, features)["0"]
    n, s, G = g
    mu = s / n
    cov = (G - n * np.outer(mu, mu)) / (n - 1)
    w, V = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:k]
    V = V[:, order]
    V = V * np.sign(V[np.abs(V).argmax(axis=0), range(V.shape[1])])
    return _project(df, features, V, mu, "pc"), w[order] / w.sum()


def reduce_truncated_svd(df: DataFrame, features, k: int) -> tuple[DataFrame, np.ndarray]:
    """R2: truncated SVD without centring: right singular vectors from X^T X, scores X V."""
    n, s, G = gram(df, features)["0"]
    w, V = np.linalg.eigh(G)
    order = np.argsort(w)[::-1][:k]
    V = V[:, order]
    V = V * np.sign(V[np.abs(V).argmax(axis=0), range(V.shape[1])])
    return _project(df, features, V, None, "svd"), np.sqrt(np.maximum(w[order], 0))


def reduce_lda(df: DataFrame, features, label: str, k: int | None = None) -> DataFrame:
    """Linear discriminant directions: eigenvectors of S_W^-1 S_B from per-class sums."""
    parts = gram(df.withColumn("__lab", F.col(label).cast("string")), features, "__lab")
    n_tot = sum(v[0] for v in parts.values())
    mu = sum(v[1] for v in parts.values()) / n_tot
    d = len(mu)
    Sw, Sb = np.zeros((d, d)), np.zeros((d, d))
    for n, s, G in parts.values():
        m = s / n
        Sw += G - n * np.outer(m, m)
        Sb += n * np.outer(m - mu, m - mu)
    k = k or min(len(parts) - 1, d)
    w, V = np.linalg.eig(np.linalg.pinv(Sw) @ Sb)
    order = np.argsort(w.real)[::-1][:k]
    V = V[:, order].real
    V = V / np.linalg.norm(V, axis=0)
    return _project(df, features, V, mu, "ld")


def reduce_kernel_pca(df: DataFrame, features: list[str], k: int, gamma: float = 1.0, n_components: int = 200,
                      seed: int = 42) -> DataFrame:
    """RBF kernel PCA approximated by random Fourier features followed by PCA."""
    from strata.operators.learn import random_fourier_features
    f = random_fourier_features(df, features, gamma, n_components, seed, out="__rff")
    f = f.withColumn("__rffa", vector_to_array("__rff")).drop("__rff")
    out, _ = reduce_pca(f, "__rffa", k)
    return out.drop("__rffa")
