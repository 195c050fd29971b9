"""The pivot join, components and DBSCAN against brute force, over many partitions and odd data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import cluster as CL
from strata.operators import graph as GR
from strata.operators import metric_join as MJ
from strata.operators import neighbors as NB
from strata.operators.graph import components


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "id long, x array<double>")


def plain(x, y, metric):
    d = x[:, None] - y[None]
    return np.abs(d).sum(2) if metric == "manhattan" else np.sqrt((d ** 2).sum(2))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("part", [None, 60])
def test_knn_with_a_hot_vector_ties_and_clusters(spark, metric, part):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(200, 3)).round(1), np.tile([0.3, 0.1, -0.2], (150, 1)), rng.normal(size=(100, 3)).round(1) + 40, np.zeros((3, 3))])
    q = np.concatenate([x[::9], rng.normal(size=(20, 3)) * 100])
    got = NB.knn(frame(spark, q), frame(spark, x, np.arange(len(x))[::-1] * 3), "id", "id", "x", 6, metric=metric, block_rows=part).toPandas()
    nid = np.arange(len(x))[::-1] * 3
    d = plain(q, x, metric)
    for i in range(len(q)):
        order = np.lexsort((nid, d[i]))[:6]
        mine = got[got["id"] == i].sort_values("rank")
        assert mine["nid"].tolist() == nid[order].tolist() and np.allclose(mine["dist"], d[i][order], atol=0, rtol=1e-12)


def test_knn_prunes_partitions(spark):
    """Of far clusters, a query meets its own one's partitions only."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 4)) + 1000 * c for c in range(8)])
    points = frame(spark, x).select(F.lit("").alias("space"), "x", "id")
    space = MJ.Space(points, ["id"], part_rows=100)
    routed = space.routed(points.select(F.col("id").alias("qid"), "space", "x"), 5.0)
    assert len(space.sizes) >= 10 and routed.agg(F.max(F.size("parts"))).first()[0] <= 5


def test_knn_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, None]), (3, [float("nan"), 1.0]), (4, None), (5, [0.0, 3.0]), (6, [float("inf"), 0.0])], "id long, x array<double>")
    got = NB.knn(df, df, "id", "id", "x", 3, exclude_self=True).collect()
    assert sorted((r["id"], r["nid"], r["dist"], r["rank"]) for r in got) == [(1, 5, 3.0, 1), (5, 1, 3.0, 1)]
    assert NB.knn(df, df.limit(0), "id", "id", "x", 3).count() == 0 and NB.knn(df.limit(0), df, "id", "id", "x", 3).count() == 0


def test_weighted_vote_of_near_zero_distances(spark):
    train = spark.createDataFrame([(1, 0.0, "a"), (2, 1e-13, "b"), (3, 1e-13, "b")], "id long, x double, label string")
    test = spark.createDataFrame([(9, 0.0)], "id long, x double")
    assert NB.predict_knn_classifier(train, test, "id", "label", ["x"], 3, weights="distance").first()["prediction"] == "a"


def brute_dbscan(x, eps, least):
    m = plain(x, x, "euclidean") <= eps
    core = m.sum(1) >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[m[i] & core].min() if core[i] else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return core, np.array([label[i] if core[i] else label[m[i] & core].min() if (m[i] & core).any() else -1 for i in range(len(x))])


@pytest.mark.parametrize("case", ["blobs", "hot", "dense", "line"])
def test_dbscan_over_many_partitions(spark, monkeypatch, case):
    rng = np.random.default_rng(4)
    x, eps, least = {
        "blobs": (np.concatenate([rng.normal(size=(150, 2)) * 0.3 + c for c in (0, 2, 5)]).round(2), 0.12, 4),
        "hot": (np.concatenate([np.zeros((200, 3)), rng.normal(size=(200, 3)).round(1)]), 0.4, 5),
        "dense": (rng.random((500, 2)) * 0.1, 0.5, 5),
        "line": (rng.permutation(400)[:, None] * 1.0, 1.0, 3)}[case]
    monkeypatch.setattr(MJ, "PART_BYTES", 60 * 8 * x.shape[1])
    got = CL.cluster_dbscan(frame(spark, x), "id", "x", eps, least).toPandas().sort_values("id")
    core, label = brute_dbscan(x, eps, least)
    assert (got["core"].to_numpy() == core).all() and (got["cluster"].to_numpy() == label).all()


def test_dbscan_of_few_neighbours_meets_once(spark, monkeypatch):
    """Rows with few neighbours are linked by the ids that counting found, without a second comparison."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    eps = float(np.quantile(np.sort(plain(x, x, "euclidean"), axis=1)[:, 4], 0.6))
    monkeypatch.setattr(CL, "_core_links", None)
    monkeypatch.setattr(MJ, "PART_BYTES", 400 * 8 * 12)
    got = CL.cluster_dbscan(frame(spark, x), "id", "x", eps, 5).toPandas().sort_values("id")
    core, label = brute_dbscan(x, eps, 5)
    assert (got["core"].to_numpy() == core).all() and (got["cluster"].to_numpy() == label).all() and 0 < core.sum() < 900


def test_dbscan_of_few_and_many_neighbours_with_null_ids(spark):
    """A dense group beside sparse rows, repeated rows, and rows without an id, which count as neighbours only."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(120, 8)) * 0.01, rng.normal(size=(400, 8)), np.ones((3, 8))])
    x = np.concatenate([x, x[200:230]])
    ids = [None if i in (300, 301, 521) else i for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id long, x array<double>")
    got = {r["id"]: (r["core"], r["cluster"]) for r in CL.cluster_dbscan(df, "id", "x", 1.4, 4).collect() if r["id"] is not None}
    m = plain(x, x, "euclidean") <= 1.4
    unknown = np.isin(np.arange(len(x)), (300, 301))
    core = (m.sum(1) >= 4) & ~unknown
    link = m & core[:, None] & core[None]
    label = np.arange(len(x))
    for _ in x:
        label = np.array([label[link[i]].min() if core[i] else label[i] for i in range(len(x))])
    for i, known in enumerate(ids):
        if known is not None:
            near = m[i] & core
            assert got[i] == (core[i], label[i] if core[i] else label[near].min() if near.any() else -1)


def test_dbscan_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [-0.0]), (3, [None]), (4, None), (5, [9.0])], "id long, x array<double>")
    got = {r["id"]: (r["core"], r["cluster"]) for r in CL.cluster_dbscan(df, "id", "x", 0.5, 2).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, -1), 4: (False, -1), 5: (False, -1)}
    assert CL.cluster_dbscan(df.limit(0), "id", "x", 0.5, 2).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = rng.permutation(200)
    edges = [(int(a), int(b)) for a, b in zip(chain, chain[1:], strict=False)] + [(1000, 1000 + i) for i in range(100)] + [(5000, 5000), (2**40, 2**40 - 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 200 + 100 + 2
    assert {got[i] for i in range(200)} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and got[2**40] == 2**40 - 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components_by_rounds_and_by_the_driver(spark, monkeypatch, local):
    """Edges beyond ``LOCAL_EDGES`` are joined in rounds, with the same roots."""
    monkeypatch.setattr(GR, "LOCAL_EDGES", local)
    rng = np.random.default_rng(15)
    chain = (rng.permutation(100) + 10).tolist()
    edges = list(zip(chain, chain[1:], strict=False)) + [(500, 501), (501, 500), (7, 7), (2**41, 2**40), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(chain, 10), 500: 500, 501: 500, 2**41: 2**40, 2**40: 2**40}


def test_copies_of_queries_do_not_grow_with_the_rows(spark):
    """Rows without structure are copied once per partition, so a table of four times the rows has no more partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rng = np.random.default_rng(3)
        parts = []
        for n in (9000, 36000):
            points = frame(spark, rng.normal(size=(n, 3))).select(F.lit("").alias("space"), "x", "id")
            space = MJ.Space(points, ["id"])
            parts.append(len(space.sizes))
            assert sum(space.sizes.values()) == n
        assert parts == [MJ.LEAST_PARTS] * 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_a_task_holds_bounds_of_few_queries(monkeypatch, metric):
    rng = np.random.default_rng(4)
    y, x = rng.normal(size=(3000, 3)), rng.normal(size=(10_000, 3))
    pivots = y[:20]
    d = MJ.distances(y, pivots, metric)
    task = MJ.Task(y, d.argmin(1), d.min(1), pivots, np.array([""] * 20, dtype=object), metric)
    held, bounds = [], MJ.Task.bounds
    monkeypatch.setattr(MJ.Task, "bounds", lambda self, q, *rest: held.append(len(q)) or bounds(self, q, *rest))
    near, space = MJ.distances(x, pivots, metric).min(1), np.array([""] * len(x), dtype=object)
    i, j, dist = task.nearest(x, near, space, np.full(len(x), np.inf), 3)
    some = plain(x[::500], y, metric)
    for row, true in zip(range(0, len(x), 500), some, strict=True):
        assert set(np.argsort(true)[:3]) <= set(j[i == row]) and np.allclose(sorted(dist[i == row])[:3], np.sort(true)[:3], rtol=1e-12)
    hits = np.zeros(len(x), np.int64)
    for q, donors, m in task.within(x, near, space, 0.5):
        hits[q] += len(donors) if m is None else m.sum(1)
    assert hits[::500].tolist() == (some <= 0.5).sum(1).tolist()
    assert max(held) <= MJ.QUERIES


def test_recommend_eps_joins_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def curve(df, id_col, features, k):
        def count(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b
        return df.select("id", F.col("x")[0].alias("k_distance")).mapInArrow(count, "id long, k_distance double")

    monkeypatch.setattr(NB, "k_distance_curve", curve)
    got = NB.recommend_eps(frame(spark, np.arange(101.0)[:, None]), "id", "x").first()
    assert (got["recommended_eps"], got["mean_k_distance"]) == (90.0, 50.0) and made.value == 101


def test_donors_are_shuffled_once_and_not_stored(spark, monkeypatch):
    """Only the queries' rows are checkpointed, and one shuffle brings the donors to them."""
    rng = np.random.default_rng(6)
    points = frame(spark, rng.normal(size=(9000, 3))).select(F.lit("").alias("space"), "x", F.col("id").alias("nid"), F.lit(None).cast("int").alias("label"))
    queries = points.where("nid % 300 = 0").select(F.col("nid").alias("qid"), "space", "x")
    stored, kind = [], type(points)
    keep = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: stored.append(self.count()) or keep(self, *a))
    got = MJ.nearest(queries, points, 4)
    assert got.count() >= 4 * 30 and sum(stored) <= 30
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "rangepartitioning" not in plan


@pytest.mark.parametrize("sample", [(1, 0, 0), (20, 2, 3), (1 << 14, 64, 1 << 10)])
def test_nearest_of_any_sample(spark, monkeypatch, sample):
    """Spaces, ties, hot vectors and null ids against brute force, also where the sample misses whole spaces."""
    for name, value in zip(("SAMPLE_ROWS", "SAMPLE_OF_PART", "SAMPLE_OF_SPACE"), sample, strict=True):
        monkeypatch.setattr(MJ, name, value)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(500, 2)).round(1), np.tile([0.2, 0.1], (200, 1)), rng.normal(size=(100, 2)).round(1) + 50, [[np.nan, 0.0], [0.0, np.inf]]])
    space = rng.choice(["a", "b", "c"], len(x), p=[0.8, 0.19, 0.01])
    order = rng.permutation(len(x))
    ids = [None if i == 0 else f"n{i:04d}" for i in order]
    donors = spark.createDataFrame([(i, str(s), v.tolist(), j) for j, (i, s, v) in enumerate(zip(ids, space, x, strict=True))], "nid string, space string, x array<double>, label int")
    asked = [(int(j), str(s), x[j].tolist()) for j in range(0, len(x), 7) for s in ("a", "b", "c", "none")]
    got = MJ.nearest(spark.createDataFrame([(f"{j}{s}", s, v) for j, s, v in asked], "qid string, space string, x array<double>"), donors, 5, part_rows=50).collect()
    mine = {}
    for r in got:
        mine.setdefault(r["qid"], []).append((r["dist"], r["nid"] or "", r["label"]))
    for j, s, v in asked:
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        best = sorted((d[i], ids[i] or "", i) for i in range(len(x)) if space[i] == s and np.isfinite(d[i]))[:5]
        found = sorted(mine.get(f"{j}{s}", []))[:5]
        assert [f[1:] for f in found] == [b[1:] for b in best] and np.allclose([f[0] for f in found], [b[0] for b in best], atol=0, rtol=1e-12)


def test_cells_do_not_depend_on_products(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(0, 4, (500, 3)) + 1e7, rng.normal(size=(500, 3)) * 1e-6 + 1e7])
    pivots = np.unique(x[::5], axis=0)
    at, radius = MJ._cells(x, pivots, "euclidean")
    assert (at == plain(x, pivots, "euclidean").argmin(1)).all() and np.allclose(radius, plain(x, pivots, "euclidean").min(1), rtol=1e-12)


def test_impute_knn_of_repeated_and_null_ids(spark):
    """Rows of one id share the estimates of all of them; a row without an id gets the mean."""
    rows = [(1, None, 0.0), (1, 5.0, 9.0), (2, 2.0, 0.0), (3, 4.0, 1.0), (None, None, 3.0), (4, None, None)]
    got = NB.impute_knn(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], "id", k=1).collect()
    mean_a, mean_b = 11 / 3, 13 / 5
    assert sorted(((r["id"] or 0, r["a"], r["b"]) for r in got)) == sorted([(1, 2.0, 0.0), (1, 5.0, 9.0), (2, 2.0, 0.0), (3, 4.0, 1.0), (0, mean_a, 3.0), (4, mean_a, mean_b)])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_queries_look_at_the_cells_around_them(monkeypatch, metric):
    """Bounds to slices are made for cells near enough, not for all slices of a task."""
    rng = np.random.default_rng(13)
    y = np.concatenate([rng.random((4000, 1)) * 1e5, rng.random((4000, 2))], axis=1)
    y[:50] = y[50:100]
    pivots = y[np.argsort(y[:160, 0])]
    cell, radius = MJ._cells(y, pivots, metric)
    plainly = MJ.distances(y, pivots, metric)
    assert (cell == plainly.argmin(axis=1)).all() and np.allclose(radius, plainly.min(axis=1), rtol=1e-12, atol=0)
    task = MJ.Task(y, cell, radius, pivots, np.array([""] * 160, dtype=object), metric)
    monkeypatch.setattr(MJ, "NEAR_QUERIES", 128, raising=False)
    made = []
    gap = MJ._gap
    monkeypatch.setattr(MJ, "_gap", lambda d, *a: made.append(d.size) or gap(d, *a))
    q = np.concatenate([y[::2], rng.random((2, 3)) * 1e5])
    d = plain(q, y, metric)
    upper = np.sort(d, axis=1)[:, 9]
    row, at, dist = task.nearest(q, MJ._cells(q, pivots, metric)[1], np.array([""] * len(q), dtype=object), upper, 5)
    assert sum(made) < len(q) * len(task.slices) / 4
    for i in range(len(q)):
        mine = np.lexsort((at[row == i], dist[row == i]))[:5]
        exactly = MJ.exact(np.repeat(q[i:i + 1], len(y), axis=0), y, metric)
        assert at[row == i][mine].tolist() == np.lexsort((np.arange(len(y)), exactly))[:5].tolist()


def test_routes_by_close_cells_and_by_all_cells(spark):
    """A query gets the same partitions whether few or most cells are close to it."""
    rng = np.random.default_rng(14)
    x = rng.random((1500, 2)) * [1000, 1]
    points = frame(spark, x).select(F.lit("").alias("space"), "x", "id")
    space = MJ.Space(points, ["id"], part_rows=60)
    part, cell, lo, hi = space.rings.value
    u = np.where(np.arange(len(x)) % 3 == 0, 400.0, 2.0)
    queries = points.select(F.col("id").alias("qid"), "space", "x", F.when(F.col("id") % 3 == 0, 400.0).otherwise(2.0).alias("u"))
    d = plain(x, space.pivots, "euclidean")
    hit = MJ._gap(d[:, cell], lo, hi, d.min(axis=1)) <= u[:, None]
    for some in (queries, queries.where("u = 2")):
        for r in space._route(some).collect():
            assert sorted(r["parts"]) == sorted(set(part[hit[r["qid"]]].tolist())) and r["near"] == pytest.approx(d[r["qid"]].min())
