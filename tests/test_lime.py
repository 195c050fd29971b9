"""LIME's weighted ridge by sums against a plain solution over all samples of a row."""

import numpy as np
from pyspark.sql import functions as F

from strata.operators import explain as X


class Model:
    def transform(self, df):
        self.out = df.withColumn("prediction", F.sin("a") + 0.3 * F.col("b") - 0.1 * F.col("c") * F.col("a"))
        return self.out


def test_lime_by_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(i // 2 if i < 6 else i, *map(float, rng.normal(size=3) * [1, 2, 3])) for i in range(30)]  # three ids come twice
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4)
    model = Model()
    res = X.lime_tabular(model, df, df, "id", ["a", "b", "c"], num_samples=150, num_features=2)
    assert "FlatMapGroups" not in res._jdf.queryExecution().toString()  # a row's samples never leave their task
    got = {k: list(zip(g["feature"], g["attribution"], strict=True)) for k, g in res.toPandas().groupby("id")}
    samples = model.out.toPandas()
    assert len(got) == 27
    for k, g in samples.groupby("__rid"):
        z = np.column_stack([np.ones(len(g)), g[["z_a", "z_b", "z_c"]]])
        w = g["__w"].to_numpy()
        beta = np.linalg.solve(z.T @ (z * w[:, None]) + np.diag([0.0, 1, 1, 1]), z.T @ (w * g["prediction"].to_numpy()))[1:]
        order = np.argsort(-np.abs(beta))[:2]
        assert [f for f, _ in got[k]] == [["a", "b", "c"][i] for i in order] and np.allclose([v for _, v in got[k]], beta[order], rtol=1e-9)
