"""Property and brute-force tests for operators without an exact SQL twin."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.stats import exact_quantiles
from strata.operators import balance as B
from strata.operators import explain as X
from strata.operators import learn as L
from strata.operators import neighbors as NB
from strata.operators import outliers as O
from strata.operators import prep as PR
from strata.operators import ranks as RK
from strata.operators import relational as RL
from strata.operators import series as SE
from strata.sources import tables as T
from strata.streaming import streams as ST


def test_exact_quantiles_match_numpy_and_partitioning(spark):
    rng = np.random.default_rng(0)
    x = rng.exponential(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for parts in (1, 7):
        q = exact_quantiles(df.repartition(parts), ["x"], [0.0, 0.1, 0.5, 0.77, 1.0])
        for p in (0.0, 0.1, 0.5, 0.77, 1.0):
            assert q[("x", p)] == pytest.approx(np.quantile(x, p), rel=1e-12)


@pytest.mark.parametrize("most", [0, 300, 10**6])
def test_exact_quantiles_over_several_passes(spark, monkeypatch, most):
    """Hot values, both zeros, infinities, tiny and huge numbers, nulls and NaN, with and without the last pass."""
    from strata.functions import stats
    monkeypatch.setattr(stats, "MOST_VALUES", most)
    monkeypatch.setattr(stats, "MOST_BUCKETS", 1 << 12)
    rng = np.random.default_rng(2)
    a = np.concatenate([np.full(700, 2.5), rng.normal(size=900), [-0.0, 0.0, 5e-324, -5e-324, 1e308, -1e308], 2.5 + rng.random(400) * 1e-9])
    b = np.concatenate([rng.integers(-3, 4, 1500).astype(float), [np.inf, -np.inf] * 3, np.full(500, np.nan)])
    rows = [(float(x), None if i % 7 == 0 else float(y)) for i, (x, y) in enumerate(zip(rng.permutation(a), rng.permutation(b)[:len(a)], strict=True))]
    df = spark.createDataFrame(rows, "a double, b double").withColumn("c", F.lit(None).cast("double")).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.6, 0.9, 0.999, 1.0] + [i / 97 for i in range(98)]
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    want = {"a": np.array([r[0] for r in rows]), "b": np.array([r[1] for r in rows if r[1] is not None and r[1] == r[1]])}
    for c, x in want.items():
        x = np.sort(x)
        for p in probs:
            h = (len(x) - 1) * p
            lo, hi = x[int(np.floor(h))], x[int(np.ceil(h))]
            assert got[c, p] == (lo if lo == hi else lo + (hi - lo) * (h - np.floor(h)))
    assert all(got["c", p] is None for p in probs)
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {("a", 0.5): None}


def test_global_positions_are_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    pos = RK.global_positions(df.repartition(5), ["v", "id"]).toPandas().sort_values("pos")
    assert list(pos["pos"]) == list(range(1000))
    assert list(pos["v"]) == sorted(pos["v"])


def test_count_in_ranges_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=400), 1)  # many ties
    pdf = pd.DataFrame({"id": np.arange(400), "v": v})
    pts = spark.createDataFrame(pdf).select("id", "v", (F.col("v") - 0.3).alias("lo"), (F.col("v") + 0.3).alias("hi"))
    got = dict(RK.count_in_ranges(pts, "v", "lo", "hi", "id").toPandas().values.tolist())
    for i in range(400):
        assert got[i] == int(((v >= v[i] - 0.3) & (v <= v[i] + 0.3)).sum())


def test_knn_brute_force(spark):
    rng = np.random.default_rng(2)
    X_ = rng.normal(size=(300, 3))
    pdf = pd.DataFrame({"id": np.arange(300), "a": X_[:, 0], "b": X_[:, 1], "c": X_[:, 2]})
    df = spark.createDataFrame(pdf)
    nb = NB.knn(df, df, "id", "id", ["a", "b", "c"], 4, exclude_self=True, block_rows=64).toPandas()
    D = np.sqrt(((X_[:, None, :] - X_[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(D, np.inf)
    for i in range(0, 300, 37):
        exp = list(np.lexsort((np.arange(300), D[i]))[:4])
        got = list(nb[nb["id"] == i].sort_values("rank")["nid"])
        assert got == exp


def test_impute_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X_ = rng.normal(size=(120, 3))
    X_[rng.random((120, 3)) < 0.1] = np.nan
    pdf = pd.DataFrame({"id": np.arange(120), "a": X_[:, 0], "b": X_[:, 1], "c": X_[:, 2]})
    df = spark.createDataFrame(pdf).select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    got = NB.impute_knn(df, ["a", "b", "c"], "id", k=5, block_rows=32).toPandas().sort_values("id")
    # brute force nan-euclidean KNN imputation
    p = 3
    exp = X_.copy()
    for i in range(120):
        for j in range(3):
            if not np.isnan(X_[i, j]):
                continue
            d = []
            for r in range(120):
                if r == i or np.isnan(X_[r, j]):
                    continue
                both = ~np.isnan(X_[i]) & ~np.isnan(X_[r])
                if both.sum() == 0:
                    continue
                d.append((math.sqrt(p / both.sum() * ((X_[i, both] - X_[r, both]) ** 2).sum()), r))
            d.sort()
            top = d[:5]
            if not top:
                exp[i, j] = np.nanmean(X_[:, j])
                continue
            if any(t[0] == 0 for t in top):
                w = np.array([1.0 if t[0] == 0 else 0.0 for t in top])
            else:
                w = np.array([1 / t[0] for t in top])
            exp[i, j] = (w * np.array([X_[t[1], j] for t in top])).sum() / w.sum()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), exp, atol=1e-9)


def test_lof_1d_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=200), [8.0, -7.5]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": v}))
    got = O.lof_scores_1d(df, "v", "id", k=5).toPandas().set_index("id")["lof"]
    D = np.abs(v[:, None] - v[None, :])
    np.fill_diagonal(D, np.inf)
    k = 5
    nn = np.argsort(D, axis=1, kind="stable")[:, :k]
    kd = D[np.arange(len(v))[:, None], nn].max(axis=1)
    reach = np.maximum(D[np.arange(len(v))[:, None], nn], kd[nn])
    lrd = 1 / (reach.mean(axis=1) + 1e-10)
    lof = lrd[nn].mean(axis=1) / lrd
    assert np.allclose(got.sort_index().to_numpy(), lof, rtol=1e-9)
    assert got.idxmax() in (200, 201)


def test_dbscan_1d_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=300), [9.0, -9.0, 12.0]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x}))
    got = O.outlier_dbscan_1d(df, "x", "id").toPandas().set_index("id")["x_outlier"].sort_index().to_numpy()
    z = (x - x.mean()) / x.std()
    D = np.abs(z[:, None] - z[None, :])
    core = (D <= 0.5).sum(axis=1) >= 5
    noise = ~core & ~((D <= 0.5) & core[None, :]).any(axis=1)
    assert (got == noise).all()


def test_scalers_moments(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    s = PR.scale_standard(li).agg(F.avg("l_extendedprice"), F.stddev_pop("l_extendedprice")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9
    m = PR.scale_minmax(li).agg(F.min("l_quantity"), F.max("l_quantity")).first()
    assert m[0] == 0 and m[1] == 1


def test_cap_is_idempotent(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_extendedprice")
    once = O.cap_outliers(li)
    twice = O.cap_outliers(once)
    a = sorted(r[0] for r in once.collect())
    b = sorted(r[0] for r in twice.collect())
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-6


def test_decomposition_adds_up(spark, sf):
    d = SE.decompose_additive(T.daily_sales(spark, sf), "ds", "sales").toPandas().dropna()
    assert np.allclose(d["trend"] + d["seasonal"] + d["resid"], d["sales"])


def test_balancing_counts_and_smote_segments(spark, sf):
    bs = T.balance_set(spark, sf)
    counts = dict(B.class_counts(bs, "label"))
    over = B.balance_random_over(bs, "label", "doc_id")
    c = dict((r[0], r[1]) for r in over.groupBy("label").count().collect())
    assert c[0] == c[1] == max(counts.values())
    under = B.balance_random_under(bs, "label", "doc_id")
    c = dict((r[0], r[1]) for r in under.groupBy("label").count().collect())
    assert c[0] == c[1] == min(counts.values())
    sm = B.balance_smote(bs, "label", "doc_id", ["n_chars", "n_words"]).where("synthetic").toPandas()
    mino = min(counts, key=counts.get)
    pts = bs.where(F.col("label") == mino).toPandas()[["n_chars", "n_words"]].to_numpy()
    lo, hi = pts.min(axis=0), pts.max(axis=0)
    assert len(sm) == max(counts.values()) - min(counts.values())
    assert ((sm[["n_chars", "n_words"]].to_numpy() >= lo - 1e-9) & (sm[["n_chars", "n_words"]].to_numpy() <= hi + 1e-9)).all()


def test_seeded_sample_partition_invariant(spark, sf):
    li = T.table(spark, sf, "lineitem")
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = sorted(tuple(r) for r in RL.seeded_sample(li.repartition(1), 50, ids).select(*ids).collect())
    b = sorted(tuple(r) for r in RL.seeded_sample(li.repartition(7), 50, ids).select(*ids).collect())
    assert a == b


def test_stratified_split_partition_invariant(spark, sf):
    bs = T.balance_set(spark, sf)
    a = sorted(tuple(r) for r in L.train_test_split(bs.repartition(1), "doc_id", "label").select("doc_id", "split").collect())
    b = sorted(tuple(r) for r in L.train_test_split(bs.repartition(7), "doc_id", "label").select("doc_id", "split").collect())
    assert a == b


def test_shapley_additivity(spark, sf):
    s = L.train_test_split(T.balance_set(spark, sf), "doc_id", "label")
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    model = L.fit_random_forest_classifier(train, ["n_chars", "n_words"], "label", n_estimators=20)
    attr = X.shap_values(model, test, train, "doc_id", ["n_chars", "n_words"]).toPandas()
    g = attr.groupby("doc_id").agg(s=("attribution", "sum"), p=("prediction", "first"), b=("base_value", "first"))
    assert np.allclose(g["s"], g["p"] - g["b"], atol=1e-9)


def test_lockout_stream_equals_batch_twin(spark, sf, tmp_path):
    # split events into several files so the stream runs several micro-batches with state
    ev = T.table(spark, sf, "events")
    path = str(tmp_path / "events_by_day")
    ev.withColumn("d", F.to_date("ts")).repartition("d").write.partitionBy("d").parquet(path)
    schema = ev.schema
    stream = ST.dir_stream(spark, path + "/*", schema, max_files=3)
    s = ST.run_lockout(stream, delay="40 days").toPandas()  # days arrive in any order
    b = ST.lockout_batch(ev).toPandas()
    key = ["username", "event_id"]
    s = s.sort_values(key).reset_index(drop=True)
    b = b.sort_values(key).reset_index(drop=True)
    assert len(s) == len(b)
    assert (s["outcome"] == b["outcome"]).all() and (s["failed_attempts"] == b["failed_attempts"]).all()


def test_long_series_ops_match_windows(spark, sf):
    """Range-partitioned lags / rolling stats / fills equal the one-task window versions,
    across partition and Arrow batch boundaries."""
    from pyspark.sql import Window
    from strata.operators import ordered as OD
    from strata.operators import windows as W
    g = T.daily_sales_gaps(spark, "/root/testdata/sf0.01")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for m in ("ffill", "bfill"):
            a = OD.fill_ordered(g, "sales", ["ds"], m, num_partitions=7).toPandas().sort_values("ds")["sales"]
            b = W.fill_series(g, "sales", "ds", m).toPandas().sort_values("ds")["sales"]
            assert np.allclose(a.to_numpy(), b.astype(float).to_numpy(), equal_nan=True)
        a = OD.lag_features_ordered(g, "sales", ["ds"], (1, 30), num_partitions=7).toPandas().sort_values("ds")
        b = g.withColumn("l30", F.lag("sales", 30).over(Window.orderBy("ds"))).toPandas().sort_values("ds")
        assert np.allclose(a["sales_lag_30"].to_numpy(), b["l30"].astype(float).to_numpy(), equal_nan=True)
        r = OD.rolling_features_ordered(g, "sales", ["ds"], (7,), num_partitions=7).toPandas().sort_values("ds")
        x = g.toPandas().sort_values("ds")["sales"].astype(float).rolling(7, min_periods=1)
        assert np.allclose(r["sales_rolling_std_7"].to_numpy(), x.std().to_numpy(), equal_nan=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_queries_pin_utc(spark, sf):
    import __spark_entry__ as E
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = E.queries()["date_features"](spark, sf)
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_distributed_chronological_split_matches_window(spark, sf):
    from strata.operators import windows as W
    ev = T.table(spark, sf, "events").select("event_id", "ts")
    a = W.chronological_split(ev, ["ts", "event_id"], 0.8, distributed=True).toPandas()
    b = W.chronological_split(ev, ["ts", "event_id"], 0.8).toPandas()
    m = a.merge(b, on="event_id", suffixes=("_a", "_b"))
    assert len(m) == len(a) == len(b) and (m["split_a"] == m["split_b"]).all()


def test_distributed_decomposition_matches_window(spark):
    from strata.operators import ordered as OD
    ds = T.daily_sales(spark, "/root/testdata/sf0.01").select(
        "ds", F.round(F.col("sales") * 100).cast("bigint").alias("sales"))
    for p in (12, 7):
        a = OD.decompose_additive_ordered(ds, ["ds"], "sales", p, num_partitions=7).toPandas().sort_values("ds")
        b = SE.decompose_additive(ds, "ds", "sales", p).toPandas().sort_values("ds")
        for c in ("trend", "seasonal", "resid"):
            assert np.allclose(a[c].astype(float).to_numpy(), b[c].astype(float).to_numpy(), equal_nan=True,
                               rtol=1e-9, atol=1e-6)


def test_forest_queries_run_the_operators_defaults(spark, sf, monkeypatch):
    from strata.plans import q_learn

    class Asked(Exception):
        pass

    def ask(*args, **params):
        raise Asked(params)

    for name, query in (("fit_random_forest_regressor", q_learn.q_fit_rf_regressor), ("forecast_ml_train", q_learn.q_forecast_ml_train)):
        monkeypatch.setattr(L, name, ask)
        with pytest.raises(Asked) as e:
            query(spark, sf)
        assert e.value.args == ({},)


def test_iterative_imputation_equals_a_plain_loop(spark):
    """Rows completed one by one, the regressions on whole matrices."""
    rng = np.random.default_rng(9)
    n = 400
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) * [1, 100, 0.01, 5] + [3, 5000, 0, -20]
    x[rng.random((n, 4)) < [0.1, 0.0, 0.2, 0.05]] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    got = PR.impute_iterative(df, ["a", "b", "c", "d"]).toPandas().sort_values("id")[["a", "b", "c", "d"]].to_numpy()
    gone = np.isnan(x)
    want = np.where(gone, np.nanmean(x, axis=0), x)
    for _ in range(10):
        before = want.copy()
        for y in sorted(np.flatnonzero(gone.any(axis=0)), key=lambda j: gone[:, j].sum()):
            xs = [j for j in range(4) if j != y]
            m = np.column_stack([np.ones(n), want])[~gone[:, y]]
            beta = PR._bayes_ridge(m.T @ m, len(m), y + 1, [j + 1 for j in xs])
            want[gone[:, y], y] = beta[0] + want[gone[:, y]][:, xs] @ beta[1:]
        if max(np.sqrt(((want - before)[gone[:, j], j] ** 2).mean()) / np.nanstd(x[:, j]) for j in (0, 2, 3)) <= 1e-3:
            break
    assert np.allclose(got, want, rtol=1e-6, atol=1e-8)
    ols = np.linalg.lstsq(np.column_stack([np.ones(n), want[:, [1, 2, 3]]])[~gone[:, 0]], x[~gone[:, 0], 0], rcond=None)[0]
    assert np.allclose(np.column_stack([np.ones(n), want[:, [1, 2, 3]]])[gone[:, 0]] @ ols, got[gone[:, 0], 0], atol=0.05 * np.nanstd(x[:, 0]))


def test_iterative_imputation_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, None, None), (3.0, None, None)], "a double, b double, c double")
    assert [tuple(r) for r in PR.impute_iterative(df, ["a", "b", "c"]).collect()] == [(1.0, None, None), (2.0, None, None), (3.0, None, None)]
    assert PR.impute_iterative(df.limit(0), ["a", "b"]).count() == 0
