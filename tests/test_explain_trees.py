"""Tree attributions against coalitions enumerated over the trees; clusters and lags without caps."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from strata.operators import cluster as CL
from strata.operators import explain as X
from strata.operators import reduce as RD
from strata.operators import series as SE

FEATS = ["a", "b", "c"]


def _data(spark, n=300):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = x[:, 0] * 2 + (x[:, 1] > 0) * x[:, 2] + rng.normal(size=n) * 0.1
    rows = [(i, *map(float, r), float(v), float(min(2, max(0, round(v + 1))))) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k double")


def _conditional(node, x, known, classes):
    """E[f(x) | features in known], by training covers."""
    if node.subtreeDepth() == 0:
        if classes:
            s = np.array(list(node.impurityStats().stats()))
            return s / s.sum()
        return np.array([node.prediction()])
    f, at = node.split().featureIndex(), node.split().threshold()
    left, right = node.leftChild(), node.rightChild()
    if f in known:
        return _conditional(left if x[f] <= at else right, x, known, classes)
    n, l, r = (c.impurityStats().count() for c in (node, left, right))
    return (l * _conditional(left, x, known, classes) + r * _conditional(right, x, known, classes)) / n


@pytest.mark.parametrize("kind", ["forest", "boosted", "classes"])
def test_tree_attributions_equal_enumeration(spark, kind):
    df = _data(spark)
    va = VectorAssembler(inputCols=FEATS, outputCol="features")
    est = {"forest": RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=4, seed=1), "boosted": GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1),
           "classes": RandomForestClassifier(labelCol="k", numTrees=4, maxDepth=4, seed=1)}[kind]
    model = Pipeline(stages=[va, est]).fit(df)
    forest = model.stages[-1]
    some = df.limit(6)
    got = X.shap_tree(model, some, "id", FEATS).toPandas()
    if kind != "classes":
        got["class"] = 0
    classes = 3 if kind == "classes" else 0
    weights = list(forest.treeWeights) if kind == "boosted" else [1 / 4] * 4
    predicted = {r["id"]: (r["probability"].toArray() if classes else np.array([r["prediction"]])) for r in model.transform(some).collect()}
    for row in some.collect():
        x = [row[f] for f in FEATS]
        v = {}
        for n in range(4):
            for s in itertools.combinations(range(3), n):
                v[s] = sum(w * _conditional(t._call_java("rootNode"), x, set(s), classes) for t, w in zip(forest.trees, weights))
        for i, f in enumerate(FEATS):
            phi = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (v[tuple(sorted((*s, i)))] - v[s]) for s in v if i not in s)
            for c in range(max(classes, 1)):
                r = got[(got.id == row["id"]) & (got.feature == f) & (got["class"] == c)].iloc[0]
                assert np.isclose(r.attribution, phi[c]) and np.isclose(r.base_value, v[()][c])
                assert np.isclose(r.prediction, predicted[row["id"]][c])


def test_kernel_method_is_the_callers_choice():
    assert X._masks(3, 0)[1] and X._masks(12, 0)[1]
    masks, exact = X._masks(14, 0, "sampled")
    assert not exact and len(masks) == 2 * 14 + 2048
    with pytest.raises(ValueError):
        X._masks(17, 0)


def test_acf_returns_the_lags_asked_for(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=200)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double")
    got = SE.acf(df, "t", "y", nlags=60).orderBy("lag").toPandas()
    d = y - y.mean()
    assert got["lag"].tolist() == list(range(61))
    assert np.allclose(got["acf"], [(d[k:] * d[:len(d) - k]).sum() / (d * d).sum() for k in range(61)])


def test_dbscan_follows_a_long_chain(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(300)] + [(1000, 5000.0)], "id long, x double")
    got = CL.cluster_dbscan(df, "id", ["x"], 1.0, 2).toPandas().set_index("id")["cluster"].sort_index()
    assert (got.loc[:299] == 0).all() and got.loc[1000] == -1


def test_kmodes_ends(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 2) for i in range(40)], "id int, s string, n int")
    got = CL.cluster_kmodes(df, ["s", "n"], 2, "id").toPandas()
    assert got.groupby("s")["cluster"].nunique().max() == 1 and got["cluster"].nunique() == 2


def test_gram_is_one_matrix_per_group(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i % 2, *map(float, r)) for i, r in enumerate(x)], "g int, a double, b double, c double, d double")
    got = RD.gram(df.repartition(5), ["a", "b", "c", "d"], "g")
    for g in (0, 1):
        n, s, G = got[str(g)]
        xs = x[np.arange(50) % 2 == g]
        assert n == 25 and np.allclose(s, xs.sum(axis=0)) and np.allclose(G, xs.T @ xs)


def test_kernel_averages_over_the_whole_background(spark, monkeypatch):
    from pyspark.ml.feature import SQLTransformer
    rng = np.random.default_rng(3)
    train = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (700, 2)))]
    test = [(1000 + i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (30, 2)))]
    model = SQLTransformer(statement="SELECT *, a * b + 3 * a AS prediction FROM __THIS__")
    monkeypatch.setattr(X, "BLOCK", 16, raising=False)  # several blocks
    frames = [spark.createDataFrame(rows, "id long, a double, b double") for rows in (test, train)]
    got = {(r.id, r.feature): r for r in X.shap_values(model, *frames, "id", ["a", "b"], positive_class=None).collect()}
    f = lambda a, b: a * b + 3 * a
    A, B = np.array(train)[:, 1], np.array(train)[:, 2]
    for i, a, b in test:
        v = {0: f(A, B).mean(), 1: f(a, B).mean(), 2: f(A, b).mean(), 3: f(a, b)}
        assert np.isclose(got[i, "a"].attribution, (v[1] - v[0] + v[3] - v[2]) / 2)
        assert np.isclose(got[i, "b"].attribution, (v[2] - v[0] + v[3] - v[1]) / 2)
        assert np.isclose(got[i, "a"].base_value, v[0]) and np.isclose(got[i, "a"].prediction, v[3])
    assert len(got) == 2 * len(test)
    assert X.coalition_expansion(*frames, "id", ["a", "b"]).count() == 30 * 4 * 700


@pytest.mark.parametrize("kind", ["forest", "boosted", "classes"])
def test_tree_background_attributions_equal_brute_force(spark, kind):
    """Every coalition's mean prediction over all background rows, scored by the model itself."""
    df = _data(spark, 200)
    va = VectorAssembler(inputCols=FEATS, outputCol="features")
    est = {"forest": RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=5, seed=1), "boosted": GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1),
           "classes": RandomForestClassifier(labelCol="k", numTrees=4, maxDepth=5, seed=1)}[kind]
    model = Pipeline(stages=[va, est]).fit(df)
    some, background = df.limit(50), df.where("id >= 40")
    got = {(r["id"], r["feature"]): r for r in X.shap_values(model, some, background, "id", FEATS, positive_class=1).collect()}
    assert X._interventional(model, FEATS, 1) is not None and X._interventional(model, FEATS[::-1], 1) is None
    x, z = (np.array([[r[f] for f in FEATS] for r in d.collect()]) for d in (some, background))
    rows = [(i, m, *(float(v) for v in np.where([m >> j & 1 for j in range(3)], x[i], b))) for i in range(len(x)) for m in range(8) for b in z]
    scored = model.transform(spark.createDataFrame(rows, "i int, m int, a double, b double, c double"))
    v = {(r["i"], r["m"]): r["v"] for r in scored.groupBy("i", "m").agg(F.avg(X._pred_col(scored, 1)).alias("v")).collect()}
    for i, r in enumerate(some.collect()):
        for j, f in enumerate(FEATS):
            phi = sum(math.factorial(bin(s).count("1")) * math.factorial(2 - bin(s).count("1")) / 6 * (v[i, s | 1 << j] - v[i, s]) for s in range(8) if not s >> j & 1)
            g = got[r["id"], f]
            assert np.isclose(g.attribution, phi) and np.isclose(g.base_value, v[i, 0]) and np.isclose(g.prediction, v[i, 7])


def test_sampled_background_has_standard_errors(spark):
    from pyspark.ml.feature import SQLTransformer
    rng = np.random.default_rng(5)
    train = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    test = [(10_000 + i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(5, 2)))]
    frames = [spark.createDataFrame(rows, "id long, a double, b double") for rows in (test, train)]
    model = SQLTransformer(statement="SELECT *, a * b + 3 * a AS prediction FROM __THIS__")
    whole = {(r.id, r.feature): r.attribution for r in X.shap_values(model, *frames, "id", ["a", "b"], positive_class=None).collect()}
    part = X.shap_values(model, *frames, "id", ["a", "b"], positive_class=None, max_background=400).collect()
    assert len(part) == 10 and all(0 < r.std_error < 1 for r in part)
    assert all(abs(r.attribution - whole[r.id, r.feature]) < 5 * r.std_error + 0.02 for r in part)


def test_coalition_counts(spark):
    rows = [(i, float(i % 3), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {(r["id"], r["mask"]): (r["background_rows"], r["patterns"]) for r in X.coalition_counts(df.limit(2), df, "id", ["a", "b"]).collect()}
    assert {m: got[0, m] for m in range(4)} == {0: (60, 15), 1: (60, 5), 2: (60, 3), 3: (60, 1)} and len(got) == 8
