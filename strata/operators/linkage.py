"""Single-linkage trees: the minimum spanning tree of a metric space by Boruvka rounds.

Every round components but the largest find their shortest edge to another component, and the edges chosen merge
components (``graph.components``), so that rounds grow with log(n). The ``LISTED`` nearest points of each point come from one
neighbour join. A point's first listed point of another component is its nearest one; where a list has no such
point left, its last distance bounds the point's edges from below. A component whose best listed edge is below these bounds
merges without a search. Where fewer than ``SURE`` of the components can, the other components' points whose lists have
ended search the rings of ``metric_join``: a component's bound is the shortest edge that any of its points has found so
far, and rings that are farther than the bound, or hold only the component itself, are not visited. A point first
goes to its nearest foreign ring; the best edges found there bound the second visit of the whole component. A
task passes on one edge per component, never pairs. Equal vectors are one point, merged at height 0.

Edges are ordered by (height, smaller id, larger id), so ties give one tree whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import components
from strata.operators.metric_join import CELLS, ROOM, Space, Task, _gap, by_part, distances, exact, matrix, names, nearest_lists, part_lists, single
from strata.session import checkpoint_dir

LISTED = 8  # nearest points of a point that are found at once
SURE = 0.25  # of the components but the largest, that merge by lists in a round without a search
EDGE = "comp long, dist double, a long, b long, other long"


class _Best:
    """The least edge (dist, a, b) of each component of a task's queries, and the component it leads to."""

    def __init__(self, comp: np.ndarray, bound: np.ndarray):
        self.comps, self.at = np.unique(comp, return_inverse=True)
        self.bound = np.full(len(self.comps), np.inf)
        np.minimum.at(self.bound, self.at, bound)
        self.edges = [np.zeros(0)] + [np.zeros(0, np.int64) for _ in range(4)]  # dist, a, b, other, component's place

    def add(self, dist: np.ndarray, a: np.ndarray, b: np.ndarray, other: np.ndarray, at: np.ndarray) -> None:
        every = [np.concatenate(p) for p in zip(self.edges, (dist, np.minimum(a, b), np.maximum(a, b), other, at), strict=True)]
        order = np.lexsort((every[2], every[1], every[0], every[4]))
        place = every[4][order]
        first = order[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else order
        self.edges = [e[first] for e in every]
        np.minimum.at(self.bound, self.edges[4], self.edges[0])

    def table(self) -> pa.Table:
        dist, a, b, other, at = self.edges
        return pa.table([pa.array(self.comps[at]), pa.array(dist), pa.array(a), pa.array(b), pa.array(other)], names=["comp", "dist", "a", "b", "other"])


def _foreign(task: Task, q: pa.Table, y: pa.Table, chunk: int = 512) -> pa.Table:
    """The least edge from each component's queries to donors of other components, if within the queries' bound."""
    x, near, qid, comp = matrix(q["x"]), q["near"].to_numpy(), q["qid"].to_numpy(), q["comp"].to_numpy()
    yid, ycomp = y["id"].to_numpy()[task.order], y["comp"].to_numpy()[task.order]
    best = _Best(comp, q["u"].to_numpy())
    spaces = names(q["space"])
    for c in range(0, len(x), 4096):
        part = slice(c, min(c + 4096, len(x)))
        low, _ = task.bounds(x[part], near[part], spaces[part])
        mine = comp[part]
        for s, (a, b) in enumerate(task.slices):
            if (ycomp[a:b] == ycomp[a]).all():
                low[mine == ycomp[a], s] = np.inf
        top = task.value(best.bound[best.at[part]] * (1 + ROOM))
        flat, terms, qq, most = task.flat(x[part], np.arange(len(top)), low, top)
        if len(flat):
            low[flat] = np.inf
            flat, off = flat + c, task.error(qq, most)
            limit = single(top[flat - c] + off - qq)
            for i, j, _ in task.products(terms, limit):
                some = comp[flat[i]] != ycomp[j]
                if some.any():
                    i, j = flat[i[some]], j[some]
                    best.add(exact(x[i], task.y[j], task.metric), qid[i], yid[j], ycomp[j], best.at[i])
                    limit[:] = single(task.value(best.bound[best.at[flat]] * (1 + ROOM)) + off - qq)
        for s in np.argsort(low.min(axis=0)).tolist():
            a, b = task.slices[s]
            some = np.isfinite(low[:, s]) & (low[:, s] <= best.bound[best.at[part]] * (1 + ROOM))
            rows = np.flatnonzero(some) + c
            for r in range(0, len(rows), chunk):
                i = rows[r:r + chunk]
                v, off = task.compare(x[i], s)
                v = np.where(comp[i][:, None] == ycomp[None, a:b], np.inf, v)
                top = np.minimum(task.value(best.bound[best.at[i]] * (1 + ROOM)), v.min(axis=1) + off)
                p, j = np.nonzero(np.isfinite(v) & (v - off[:, None] <= top[:, None]))
                if len(p):
                    best.add(exact(x[i[p]], task.y[a + j], task.metric), qid[i[p]], yid[a + j], ycomp[a + j], best.at[i[p]])
    return best.table()


def _route(space: Space, queries: DataFrame, rings: list[tuple], home: bool) -> DataFrame:
    """Adds ``near`` and ``parts``: with ``home`` the partition of the nearest foreign ring, else all others
    with a foreign ring within ``u``. ``rings``: (part, cell, low, high, its only component or None)."""
    known, metric = space.known, space.metric
    table = np.array([(p, c, lo, hi) for p, c, lo, hi, _ in rings], dtype=float).reshape(-1, 4)
    only = np.array([-1 if o is None else o for *_, o in rings], dtype=np.int64)
    pure = np.array([o is not None for *_, o in rings], dtype=bool)
    shared = space.spark.sparkContext.broadcast((table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2], table[:, 3], only, pure))
    kept = [c for c in queries.columns if c not in ("near", "parts")]
    kinds = ", ".join(f"{c} {t}" for c, t in queries.dtypes if c in kept)

    def route(batches):
        pivots, _ = known.value
        part, cell, lo, hi, only, pure = shared.value
        step = max(1, CELLS // max(len(part), len(pivots), 1))
        for batch in batches:
            x, comp, u = matrix(batch.column("x")), batch.column("comp").to_numpy(), batch.column("u").to_numpy()
            own = np.full(len(comp), -1) if home else batch.column("home").to_numpy()
            near, reached = np.full(len(comp), np.inf), []
            for c in range(0, len(comp), step):
                d = distances(x[c:c + step], pivots, metric)
                near[c:c + step] = least = d.min(axis=1)
                gap = _gap(d[:, cell], lo, hi, least)
                gap[pure[None, :] & (only[None, :] == comp[c:c + step, None])] = np.inf
                if home:
                    at = gap.argmin(axis=1)
                    q = np.flatnonzero(np.isfinite(gap[np.arange(len(at)), at]))
                    p = part[at[q]]
                else:
                    q, p = by_part(gap <= (u[c:c + step] * (1 + ROOM))[:, None], part)
                    q, p = q[p != own[c + q]], p[p != own[c + q]]
                reached.append((c + q, p))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(near), part_lists(reached, len(comp))], names=[*kept, "near", "parts"])

    return queries.mapInArrow(route, f"{kinds}, near double, parts array<int>").where(F.size("parts") > 0)


def _shortest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("comp").agg(F.min(F.struct("dist", "a", "b", "other")).alias("e")).select("comp", "e.*")


def linkage_tree(df: DataFrame, id_col: str, features, metric: str = "euclidean", part_rows: int | None = None) -> DataFrame:
    """(a, b, height) for each merge of single linkage, a < b, one row fewer than rows in the tree.

    ``features``: one array column or a list of numeric columns. Ids are unique integers. Rows
    without an id or with a missing or infinite feature are in no tree; no or one row gives no merges."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    x = F.transform(F.col(features), lambda v: v.cast("double")) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: v + F.lit(0.0)).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))))
    first = rows.groupBy("x").agg(F.min("id").alias("first"))
    equal = rows.join(first, "x").where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"))
    tree = [equal.checkpoint()]
    points = first.select(F.col("first").alias("id"), F.lit("").alias("space"), "x").checkpoint()
    if points.isEmpty():
        return tree[0]
    e, p = _listed(points, metric, part_rows)
    space = None
    while True:
        sizes = p.groupBy("comp").count()
        largest = sizes.agg(F.max(F.struct("count", "comp")).alias("m"), F.count("*").alias("n")).first()
        if largest["n"] == 1:
            return _union(tree)
        asking = F.col("comp") != largest["m"]["comp"]
        best = _shortest(e.where(asking).select("comp", "dist", F.least("id", "nid").alias("a"), F.greatest("id", "nid").alias("b"), "other"))
        ended = p.where(asking).join(e.select("id"), "id", "left_anti")
        least = ended.groupBy("comp").agg(F.min("last").alias("least"))
        state = least.join(best, "comp", "full").withColumn("sure", F.col("dist").isNotNull() & (F.col("least").isNull() | (F.col("dist") < F.col("least")))).checkpoint()
        edges = state.where("sure").select("comp", "dist", "a", "b", "other")
        if edges.count() < SURE * (largest["n"] - 1):
            space = space or Space(points, ["id"], metric, part_rows)
            searched = ended.join(state.where("not sure").select("comp", "dist"), "comp").where("dist is null or last <= dist")
            edges = _searched(space, p, searched.select("id", F.coalesce("dist", F.lit(float("inf"))).alias("u")), state)
        edges = edges.checkpoint()
        tree.append(edges.select("a", "b", F.col("dist").alias("height")).distinct().checkpoint())
        root = components(edges.select("comp", "other"), "comp", "other").select(F.col("node").alias("comp"), "root")
        p = _merged(p, root, "comp").checkpoint()
        e = _merged(_merged(e, root, "comp"), root, "other").where("comp <> other").checkpoint()


def _listed(points: DataFrame, metric: str, part_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Edges (id, comp, other, dist, nid) to the ``LISTED`` nearest points of each point, and the points (id, comp, last): ``last``
    is the distance at which a point's list ends, infinite where it has all points."""
    asked = points.select(F.col("id").alias("qid"), "space", "x")
    lists = nearest_lists(asked, points.select(F.col("id").alias("nid"), "space", "x", F.lit(None).cast("int").alias("label")), LISTED + 1, metric, part_rows)
    each = lists.groupBy(F.col("qid").alias("id")).agg(F.flatten(F.collect_list(F.arrays_zip(F.col("dists").alias("dist"), F.col("ids").alias("nid")))).alias("near"))
    each = each.select("id", F.slice(F.array_sort("near"), 1, LISTED + 1).alias("near")).checkpoint()
    ended = F.when(F.size("near") > LISTED, F.element_at("near", -1)["dist"]).otherwise(float("inf"))
    edges = each.select("id", F.explode("near").alias("n")).select("id", F.col("id").alias("comp"), F.col("n.nid").alias("other"), "n.dist", "n.nid")
    return edges.where("id <> nid"), each.select("id", F.col("id").alias("comp"), ended.alias("last"))


def _merged(rows: DataFrame, root: DataFrame, comp: str) -> DataFrame:
    return rows.join(root.withColumnRenamed("comp", comp), comp, "left").withColumn(comp, F.coalesce("root", comp)).drop("root")


def _searched(space: Space, points: DataFrame, asked: DataFrame, state: DataFrame) -> DataFrame:
    """The shortest edges of ``state``'s components, after the points asked (id, u) have looked for edges up to ``u``."""
    make = space.tasks()

    def search(q: pa.Table, y: pa.Table) -> pa.Table:
        if not q.num_rows or not y.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())], names=["comp", "dist", "a", "b", "other"])
        return _foreign(make(y), q, y)

    donors = space.donors.join(points.select("id", "comp"), "id").checkpoint()
    # at most one row per range partition and pivot's cell
    rings = [tuple(r) for r in donors.groupBy("part", "cell").agg(F.min("radius"), F.max("radius"), F.min("comp").alias("c"), F.max("comp").alias("d"))
             .withColumn("only", F.when(F.col("c") == F.col("d"), F.col("c"))).drop("c", "d").collect()]
    rings.sort(key=lambda r: r[:2])
    asking = donors.join(asked, "id").select(F.col("id").alias("qid"), "space", "x", "comp", "u")
    near = _route(space, asking, rings, True).checkpoint()
    listed = state.where("dist is not null").select("comp", "dist", "a", "b", "other")
    # every component that asks has an edge in its lists or finds some foreign point, hence has a bound
    found = _shortest(listed.unionByName(space._meet(near, donors, search, EDGE))).checkpoint()
    again = near.select("qid", "space", "x", "comp", F.col("parts")[0].alias("home")).join(found.select("comp", F.col("dist").alias("u")), "comp")
    far = _route(space, again, rings, False).checkpoint()
    return _shortest(found.unionByName(space._meet(far, donors, search, EDGE)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cut_tree(rows: DataFrame, id_col: str, tree: DataFrame, n_clusters: int | None = None, height: float | None = None) -> DataFrame:
    """``rows`` with ``cluster``, the least id of the cluster: merges above ``height``, or the ``n_clusters`` - 1 highest
    (ties by the larger ids), are undone. Rows that are in no tree are clusters of their own."""
    if (n_clusters is None) == (height is None):
        raise ValueError("give n_clusters or height")
    if height is not None:
        kept = tree.where(F.col("height") <= height)
    else:
        undone = tree.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(n_clusters - 1)
        kept = tree.join(undone, ["a", "b"], "left_anti") if n_clusters > 1 else tree
    root = components(kept.select("a", "b")).withColumnRenamed("node", "__node")
    out = rows.join(root, F.col(id_col).cast("long") == F.col("__node"), "left")
    return out.withColumn("cluster", F.coalesce("root", F.col(id_col).cast("long"))).drop("__node", "root")
