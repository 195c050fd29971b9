"""Forests grown from sums per bin against Spark's own, tree by tree and as a whole."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from strata.operators import explain as X
from strata.operators import forest as FO
from strata.operators import learn as L

FEATS = ["a", "b", "c"]


def _rows(spark, n=4000):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 50, n).astype(float), rng.integers(0, 6, n) / 10, rng.normal(size=n)
    y = 1000 * a + 800 * (b > 0.2) * a + 3000 * np.sign(c) + rng.normal(size=n) * 500
    kind = np.array(["x", "y", "z"])[rng.integers(0, 3, n)]
    y = y + 20_000 * (kind == "y")
    rows = [(i, *map(float, r), str(k)) for i, (r, k) in enumerate(zip(zip(a, b, c, y), kind))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, kind string").repartition(3, "id")


def test_forest_from_sums_predicts_as_sparks(spark, monkeypatch):
    df = StringIndexer(inputCol="kind", outputCol="k", handleInvalid="keep").fit(_rows(spark)).transform(_rows(spark)).localCheckpoint()
    feats = [*FEATS, "k"]
    monkeypatch.setattr(FO, "FEW_ROWS", 1)
    monkeypatch.setattr(Pipeline, "fit", lambda *a: pytest.fail("Spark's passes over all rows"))
    rf = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=20, seed=5)
    got = FO.fit_forest(df, feats, rf)
    monkeypatch.undo()
    want = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"), rf]).fit(df)
    model = got.stages[-1]
    assert model.getNumTrees == 20 and len(model.trees) == 20 and {t.depth for t in model.trees} == {5} and model.numFeatures == 4
    both = [m.transform(df).select("y", "prediction").toPandas() for m in (got, want)]
    error = [float(np.mean((p["y"] - p["prediction"]) ** 2)) for p in both]
    assert error[0] < 1.15 * error[1] < 0.5 * float(both[0]["y"].var())
    # bootstrap: each tree has its own number of draws, near the number of rows
    drawn = [t._call_java("rootNode").impurityStats().count() for t in model.trees]
    assert len(set(drawn)) > 10 and abs(np.mean(drawn) - 4000) < 4 * np.sqrt(4000 / 20)
    assert "categories" in model.toDebugString or "in {" in model.toDebugString


def test_tree_of_cells_is_the_tree_of_rows(spark):
    """With each row drawn once, a tree on all features grown from cells is Spark's tree on the rows."""
    df = _rows(spark, 1500).withColumn("c", F.floor("c")).withColumn("a", F.floor(F.col("a") / 5)).localCheckpoint()
    rf = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=2, seed=5, featureSubsetStrategy="all", maxDepth=4)
    points = FO._points(df, FEATS, 32, 1500, 5)
    assert points[0].tolist() == list(range(10)) and len(points[1]) == 6
    place = lambda f, p: F.array_position(F.array(*[F.lit(float(v)) for v in p]), F.col(f).cast("double")) - 1
    cell = (place("a", points[0]) * len(points[1]) + place("b", points[1])) * len(points[2]) + place("c", points[2])
    cells = df.groupBy(cell.cast("int").alias("cell")).agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    each = cells.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"), "cell", (F.col("n") / 2).alias("weight"), "m", "v")
    rows = each.select("tree", "cell", "weight", F.explode(F.array(F.col("m") - F.sqrt("v"), F.col("m") + F.sqrt("v"))).alias("label"))
    got = FO._grown(rows, df, FEATS, points, VectorAssembler(inputCols=FEATS, outputCol="features"), rf)
    d = VectorAssembler(inputCols=FEATS, outputCol="features").transform(df)
    want = rf.copy({rf.numTrees: 1, rf.bootstrap: False}).fit(d)
    a, b = (np.array([r["prediction"] for r in m.transform(d).orderBy("id").collect()]) for m in (got, want))
    assert np.allclose(a, b, rtol=1e-9)
    roots = [m.trees[0]._call_java("rootNode") for m in (got, want)]
    assert np.isclose(roots[0].impurity(), roots[1].impurity()) and roots[0].impurityStats().count() == roots[1].impurityStats().count() == 1500


def test_sums_are_those_of_drawn_rows(spark):
    df = _rows(spark, 3000)
    rf = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=200, seed=5)
    points = [np.array([5.0, 20.0, 40.0]), np.array([0.1, 0.4])]  # edges 12.5, 30 and 0.25
    got = FO._sums(df, ["a", "b"], points, rf).groupBy("tree", "cell").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("s"),
                                                                     F.sum(F.col("weight") * F.col("label") ** 2).alias("q")).toPandas()
    p = df.toPandas()
    cell = (np.searchsorted([12.5, 30], p["a"]) * 2 + (p["b"] > 0.25)).to_numpy()
    for name, each in (("w", np.ones(len(p))), ("s", p["y"]), ("q", p["y"] ** 2)):
        want, spread = (np.bincount(cell, v, 6) for v in (each, np.square(each)))
        mean = got.groupby("cell")[name].sum().to_numpy() / 200
        assert (np.abs(mean - want) < 5 * np.sqrt(spread / 200)).all()  # each row is drawn a Poisson(1) number of times
        seen = got.groupby("cell")[name].var().to_numpy()
        assert np.allclose(seen, spread, rtol=0.5)


def test_forest_of_missing_values_fails_and_few_rows_are_sparks(spark, monkeypatch):
    df = _rows(spark, 200)
    a, b = (m.transform(df).select("prediction").collect() for m in (
        L.fit_random_forest_regressor(df, FEATS, "y", n_estimators=5),
        Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"), RandomForestRegressor(featuresCol="features", labelCol="y", seed=42, numTrees=5)]).fit(df)))
    assert a == b
    monkeypatch.setattr(FO, "FEW_ROWS", 1)
    with pytest.raises(Exception, match="null, NaN or infinite"):
        L.fit_random_forest_regressor(df.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), FEATS, "y", n_estimators=2)


def test_tree_attributions_are_made_once_per_cell(spark, monkeypatch):
    """Rows between the same thresholds share their attributions, which equal those of a row by itself."""
    df = _rows(spark, 3000).coalesce(1)
    model = L.fit_random_forest_regressor(df, FEATS, "y", n_estimators=3, max_depth=2)
    forest, _ = X._ensemble(model)
    cuts = [np.unique([e for _, b in forest for e in b.get(j, ())[:2] if np.isfinite(e)]) for j in range(3)]
    x = df.select(*FEATS).toPandas().to_numpy()
    assert len(np.unique(X._cells(x, cuts))) < 300
    got = X.shap_tree(model, df, "id", FEATS).toPandas()
    for kept in (1, 64):  # cells that a task keeps
        monkeypatch.setattr(X, "KEPT", kept)
        assert X.shap_tree(model, df, "id", FEATS).toPandas().equals(got)
    alone = X.shap_tree(model, df.repartition(64, "id"), "id", FEATS).toPandas()
    order = ["id", "feature"]
    assert alone.sort_values(order, ignore_index=True).equals(got.sort_values(order, ignore_index=True))
