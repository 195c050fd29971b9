"""Single-linkage trees against a plain spanning tree: heights, edges under ties, cuts, odd rows."""

import numpy as np
import pytest

from strata.operators import linkage as LK
from strata.operators import metric_join as MJ

SCHEMA = "id long, x array<double>"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_tree(ids, x):
    """Kruskal on all pairs by (height, a, b)."""
    order = np.argsort(ids)
    ids, x = [ids[i] for i in order], np.array([x[i] for i in order], dtype=float)
    pairs = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for d, a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((d, a, b))
    return out


def clusters(ids, tree):
    root = {i: i for i in ids}
    for _ in ids:
        for _, a, b in tree:
            root[a] = root[b] = min(root[a], root[b])
    return root


def sample(kind):
    rng = np.random.default_rng(5)
    if kind == "blobs":  # separate groups: most points have no foreign point near
        x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 20)])
    elif kind == "grid":  # ties everywhere, repeated points
        x = rng.integers(0, 6, (120, 2)).astype(float)
    else:
        x = rng.normal(size=(150, 4))
    return rng.permutation(len(x) * 3)[:len(x)].tolist(), x.tolist()


@pytest.mark.parametrize("kind", ["blobs", "grid", "noise"])
def test_tree_and_cuts_against_kruskal(spark, kind):
    ids, x = sample(kind)
    df = spark.createDataFrame(list(zip(ids, x, strict=True)), SCHEMA)
    tree = LK.linkage_tree(df, "id", "x", part_rows=25).checkpoint()
    got = sorted((r["height"], r["a"], r["b"]) for r in tree.collect())
    want = plain_tree(ids, x)
    assert np.allclose([g[0] for g in got], [w[0] for w in want], atol=1e-12)
    if kind != "grid":  # equal vectors merge with the least id first, any other tie by ids
        assert [g[1:] for g in got] == [w[1:] for w in want]
    height = want[len(want) * 3 // 4][0]
    cut = {r["id"]: r["cluster"] for r in LK.cut_tree(df, "id", tree, height=height).collect()}
    assert cut == clusters(ids, [w for w in want if w[0] <= height])
    if kind == "blobs":
        three = {r["id"]: r["cluster"] for r in LK.cut_tree(df, "id", tree, n_clusters=3).collect()}
        assert three == clusters(ids, want[:-2]) and len(set(three.values())) == 3


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [-0.0]), (4, [None]), (5, None), (6, [float("nan")]), (None, [1.0]), (8, [2.0])], SCHEMA)
    assert sorted(map(tuple, LK.linkage_tree(df, "id", "x").collect())) == [(1, 2, 0.0), (1, 3, 0.0), (1, 8, 2.0)]
    for some in (df.where("id = 1"), df.where("false")):
        assert LK.linkage_tree(some, "id", "x").count() == 0
    tree = LK.linkage_tree(df, "id", "x")
    assert {r["id"]: r["cluster"] for r in LK.cut_tree(df, "id", tree, n_clusters=1).collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 4: 4, 5: 5, 6: 6, None: None}
    with pytest.raises(ValueError):
        LK.cut_tree(df, "id", tree)


def test_rows_without_structure_are_compared_once(spark, monkeypatch):
    """One neighbour join gives the edges of most rounds: rounds that search rings are few, and the tree is the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x[:40] = x[0] + rng.normal(size=(40, 16)) * 1e-3  # more near copies than a list holds
    routes = []
    route = LK._route
    monkeypatch.setattr(LK, "_route", lambda *a: routes.append(a[3]) or route(*a))
    df = spark.createDataFrame([(i * 7, r) for i, r in enumerate(x.tolist())], SCHEMA)
    got = sorted((r["height"], r["a"], r["b"]) for r in LK.linkage_tree(df, "id", "x", part_rows=150).collect())
    want = plain_tree([i * 7 for i in range(len(x))], x.tolist())
    assert np.allclose([g[0] for g in got], [w[0] for w in want], atol=1e-12) and [g[1:] for g in got] == [w[1:] for w in want]
    assert len(routes) <= 4


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e30])
def test_products_in_single_precision_leave_exact_results(scale):
    """Donors compared by products are the nearest by plain distances, whatever the vectors' size."""
    rng = np.random.default_rng(9)
    y = rng.normal(size=(1500, 24))
    y[700:] = y[:800] + rng.normal(size=(800, 24)) * 1e-7  # pairs that single precision can't tell from equal ones
    y *= scale
    pivots = y[:20]
    cell, radius = MJ._cells(y, pivots, "euclidean")
    task = MJ.Task(y, cell, radius, pivots, np.array([""] * 20, dtype=object), "euclidean")
    q, space = y[::5], np.array([""] * 300, dtype=object)
    row, at, dist = task.nearest(q, radius[::5], space, np.full(300, np.inf), 4)
    eps = float(np.median(MJ.distances(q, y, "euclidean")))
    near = np.zeros((300, 1500), dtype=bool)
    for i, j, m in task.within(q, radius[::5], space, eps):
        near[np.ix_(i, j)] = True if m is None else m
    assert scale != 1 or task._blocks is not None
    for i in range(300):
        d = MJ.exact(np.repeat(q[i:i + 1], len(y), axis=0), y, "euclidean")
        order = np.lexsort((at[row == i], dist[row == i]))[:4]
        want = np.lexsort((np.arange(len(y)), d))[:4]
        assert at[row == i][order].tolist() == want.tolist() and dist[row == i][order].tolist() == d[want].tolist()
        assert (near[i] == (d <= eps)).all()
