"""The power transforms' lambda against the likelihood of all values at once."""

import math

import numpy as np
import pytest

from strata.operators import prep as PR


def best(x, method, steps=41):
    lo, hi, found = -2.0, 2.0, None
    for _ in range(3):
        score = []
        grid = np.linspace(lo, hi, steps)
        for lam in grid:
            if method == "box-cox":
                t, jac = np.log(x) if abs(lam) < 1e-12 else (x ** lam - 1) / lam, np.log(x)
            else:
                up, down = np.maximum(x, 0), np.maximum(-x, 0)
                pos = np.log1p(up) if abs(lam) < 1e-12 else ((up + 1) ** lam - 1) / lam
                neg = -np.log1p(down) if abs(lam - 2) < 1e-12 else -((down + 1) ** (2 - lam) - 1) / (2 - lam)
                t, jac = np.where(x >= 0, pos, neg), np.sign(x) * np.log1p(np.abs(x))
            score.append(-len(x) / 2 * math.log(t.var()) + (lam - 1) * jac.sum())
        found = float(grid[int(np.argmax(score))])
        step = (hi - lo) / (steps - 1)
        lo, hi = found - step, found + step
    return found


@pytest.mark.parametrize("method", ["yeo-johnson", "box-cox"])
def test_power_lambda_of_vectors(spark, method, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.lognormal(size=3000), rng.gamma(2.0, size=3000)
    if method == "yeo-johnson":
        b -= 1.0
    rows = [(None if i % 40 == 0 else float(x), float(y), None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    expressions = []
    monkeypatch.setattr(PR, "_yj", lambda x, lam: expressions.append(lam))
    monkeypatch.setattr(PR, "_bc", lambda x, lam: expressions.append(lam))
    got = PR.fit_power_lambda(df, ["a", "b", "c"], method)
    a = a[np.arange(3000) % 40 != 0]
    assert got["a"] == pytest.approx(best(a, method), abs=1e-12) and got["b"] == pytest.approx(best(b, method), abs=1e-12)
    assert not expressions  # no expression per value and lambda
    assert got["c"] == PR.fit_power_lambda(df.limit(0), ["c"], method)["c"] == pytest.approx(-2.105)  # no value, no likelihood
