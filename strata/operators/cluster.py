"""Clustering.

k-means and bisecting k-means are Spark ML. Spectral clustering runs power
iteration clustering on the exact kNN graph (k edges per row, bounded).
DBSCAN in n dimensions is an eps join over pivots and rings that counts neighbours and
links core rows as spanning forests, joined by star contraction. The exact
Euclidean silhouette uses block pairs to sum distances per cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import components, forest
from strata.operators.metric_join import Space, exact, matrix, names
from strata.operators.neighbors import block_pairs, knn
from strata.session import checkpoint_dir

PAIR_CELLS = 2_000_000  # distances held at once
LISTED = 32  # rows within eps of a row in a partition whose ids are kept


def _vec_col(df: DataFrame, features) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("__x", F.transform(F.col(features), lambda v: v.cast("double")))
    return df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in features]))


def cluster_kmeans(df: DataFrame, features, k: int, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """G1: k-means (k-means|| init, Spark ML); adds ``cluster``."""
    v = _vec_col(df, features).withColumn("__v", array_to_vector("__x"))
    m = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v)
    return m.transform(v).drop("__x", "__v")


def cluster_hierarchical(df: DataFrame, features, k: int, seed: int = 42) -> DataFrame:
    """Divisive hierarchical clustering (bisecting k-means)."""
    v = _vec_col(df, features).withColumn("__v", array_to_vector("__x"))
    m = BisectingKMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v)
    return m.transform(v).drop("__x", "__v")


def cluster_spectral(df: DataFrame, id_col: str, features, k: int, n_neighbors: int = 10,
                     gamma: float = 1.0, max_iter: int = 20) -> DataFrame:
    """Power iteration clustering on the symmetrised kNN graph with RBF weights."""
    nb = knn(df, df, id_col, id_col, features, n_neighbors, exclude_self=True)
    e = nb.select(F.col(id_col).cast("long").alias("src"), F.col("nid").cast("long").alias("dst"),
                  F.exp(-gamma * F.col("dist") * F.col("dist")).alias("weight"))
    sym = (e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
           .where(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    pic = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="weight", initMode="degree")
    a = pic.assignClusters(sym)
    return df.join(a.withColumnRenamed("id", id_col), id_col, "left")


def _chunk_links(m: np.ndarray) -> np.ndarray:
    """For each column of a matrix of links, the first row of its connected part (rows linked over columns)."""
    n, k = m.shape
    row = np.arange(n)
    while True:
        col = np.where(m, row[:, None], n).min(axis=0)
        new = np.minimum(row, np.where(m, col[None, :], n).min(axis=1, initial=n))
        if (new == row).all():
            return col
        row = new


def _eps_counts(space: Space, routed: DataFrame, eps: float) -> DataFrame:
    """(qid, part, cnt, many, near): per query and partition the weight of the rows within eps, and their ids, itself left out;
    of more than ``LISTED`` rows no ids, but ``many``."""
    make = space.tasks()

    def count(q: pa.Table, y: pa.Table) -> pa.Table:
        qid = pc.fill_null(q["qid"], 0).to_numpy()
        n, size = np.zeros(len(qid), dtype=np.int64), np.zeros(len(qid), dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        pairs = [(none, none)]
        if len(qid) and y.num_rows:
            yid, known, weight = pc.fill_null(y["id"], 0).to_numpy(), pc.is_valid(y["id"]).to_numpy(), y["weight"].to_numpy()
            single = (weight == 1).all()
            for rows, donors, m in make(y).within(matrix(q["x"]), q["near"].to_numpy(), names(q["space"]), eps):
                hits = np.full(len(rows), len(donors)) if m is None else np.count_nonzero(m, axis=1)
                size[rows] += hits
                n[rows] += hits if single else weight[donors].sum() if m is None else m @ weight[donors]
                kept = np.flatnonzero((size[rows] <= LISTED) & (hits > 0))
                i, j = np.nonzero(np.ones((len(kept), len(donors)), dtype=bool) if m is None else m[kept])
                pairs.append((rows[kept[i]], donors[j]))
                if len(pairs) > 1 << 16:
                    pairs = [_joined(pairs)]
            rows, donors = _joined(pairs)
            kept = (size[rows] <= LISTED) & (qid[rows] != yid[donors]) & known[donors]
            rows, ids = rows[kept], yid[donors[kept]]
            order = np.argsort(rows, kind="stable")
            rows, ids = rows[order], ids[order]
        else:
            rows = ids = none
        ends = np.searchsorted(rows, np.arange(len(n) + 1))
        some = np.flatnonzero(size)
        near = pa.ListArray.from_arrays(pa.array(np.append(ends[some], len(rows)), pa.int32()), pa.array(ids))
        return pa.table([q["qid"].take(pa.array(some)), q["part"].take(pa.array(some)), pa.array(n[some]), pa.array(size[some] > LISTED), near], names=["qid", "part", "cnt", "many", "near"])

    return space._meet(routed, space.donors, count, "qid long, part int, cnt long, many boolean, near array<long>")


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _core_links(space: Space, routed: DataFrame, cores: DataFrame, eps: float) -> DataFrame:
    """(a, b, core): links that join core rows as all pairs within eps would, at most one per row of a task, and
    (core false) border rows a with one core row b of each part of the cores near them."""
    make = space.tasks()

    def link(q: pa.Table, y: pa.Table) -> pa.Table:
        qid, core = q["qid"].to_numpy(), q["core"].to_numpy(zero_copy_only=False).astype(bool)
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], names=["a", "b", "core"])
        if not len(qid) or not y.num_rows:
            return none
        yid = y["id"].to_numpy()
        ids, at = np.unique(np.concatenate([qid, yid]), return_inverse=True)
        iq, iy = at[:len(qid)], at[len(qid):]
        label = np.arange(len(ids))
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        border: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, donors, m in make(y).within(matrix(q["x"]), q["near"].to_numpy(), names(q["space"]), eps):
            mine = core[rows]
            if m is None and mine.any():  # a core row links all of them
                first = iy[donors[0]]
                edges += [(iy[donors], np.full(len(donors), first)), (iq[rows[mine]], np.full(mine.sum(), first))]
                border.append((rows[~mine], np.full((~mine).sum(), first)))
                continue
            if m is None:  # fewer donors than min_samples, or the rows were core
                m = np.ones((len(rows), len(donors)), dtype=bool)
            if mine.any():
                c = m[mine]
                hit = c.any(axis=0)
                root = iq[rows[mine]][_chunk_links(c[:, hit])] if hit.any() else np.zeros(0, np.int64)
                edges.append((iy[donors[hit]], root))
                linked = np.flatnonzero(c.any(axis=1))
                edges.append((iq[rows[mine]][linked], iy[donors[c[linked].argmax(axis=1)]]))
            i, j = np.nonzero(m[~mine])
            border.append((rows[~mine][i], iy[donors[j]]))
            if sum(len(a) for a, _ in edges) > 500_000 or sum(len(a) for a, _ in border) > 500_000:
                label = forest(np.concatenate([np.arange(len(ids)), *(a for a, _ in edges)]), np.concatenate([label, *(b for _, b in edges)]), len(ids))
                edges, border = [], [_least(border, label)]
        label = forest(np.concatenate([np.arange(len(ids)), *(a for a, _ in edges)]), np.concatenate([label, *(b for _, b in edges)]), len(ids))
        some = np.flatnonzero(label != np.arange(len(ids)))
        rows, near = _least(border, label)
        return pa.table([pa.array(np.concatenate([ids[some], qid[rows]])), pa.array(np.concatenate([ids[label[some]], ids[near]])),
                         pa.array(np.concatenate([np.ones(len(some), bool), np.zeros(len(rows), bool)]))], names=["a", "b", "core"])

    return space._meet(routed, cores, link, "a long, b long, core boolean")


def _least(border: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, part) of border rows, parts by their least core row so far."""
    none = np.zeros(0, dtype=np.int64)
    rows = np.concatenate([none, *(a for a, _ in border)])
    pairs = np.unique(np.stack([rows, label[np.concatenate([none, *(b for _, b in border)])]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def cluster_dbscan(df: DataFrame, id_col: str, features, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """DBSCAN. Core = at least ``min_samples`` rows (itself included) within eps; clusters
    are connected components of core rows; a border row joins the smallest adjacent cluster; the rest is
    noise (-1). Cluster ids are the minimum member id of each component (not renumbered).

    Equal vectors are one point with a weight. Points meet in the partitions of the pivot join that can
    hold a point within eps; a task passes on their number, and their ids where they are no more than ``LISTED``. Points that
    have more in a partition meet it once more to link: a task passes on a spanning forest of its core
    links and not the pairs, and ``graph.components`` joins the forests with the ids. Rows with a missing or infinite
    feature are noise."""
    checkpoint_dir(df.sparkSession)
    x = _vec_col(df.select(F.col(id_col).cast("long").alias("__id"), *([features] if isinstance(features, str) else features)), features)
    good = F.col("__x").isNotNull() & F.forall("__x", lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    rows = x.where(good).select(F.col("__id"), F.transform("__x", lambda e: e + F.lit(0.0)).alias("x"))
    points = rows.groupBy("x").agg(F.min("__id").alias("id"), F.count("*").alias("weight")).withColumn("space", F.lit("")).checkpoint()
    space = Space(points, ["id", "weight"])
    routed = space.routed(points.select(F.col("id").alias("qid"), "space", "x"), eps)
    met = _eps_counts(space, routed, eps).checkpoint()
    core = met.groupBy("qid").agg((F.sum("cnt") >= min_samples).alias("core")).checkpoint()
    near = met.where(~F.col("many")).select(F.col("qid").alias("a"), F.explode("near").alias("b"))
    links = (near.join(core.where("core").select(F.col("qid").alias("b")), "b", "left_semi")
             .join(core.withColumnRenamed("qid", "a"), "a").where("not core or a < b").select("a", "b", "core"))
    again = met.where("many").groupBy("qid").agg(F.collect_list("part").alias("parts")).checkpoint()
    if not again.isEmpty():
        cores = space.donors.join(core.where("core").select(F.col("qid").alias("id")), "id", "left_semi")
        links = links.unionByName(_core_links(space, routed.drop("parts").join(again, "qid").join(core, "qid"), cores, eps))
    links = links.checkpoint()
    root = components(links.where("core").select("a", "b"))
    cluster = core.where("core").select(F.col("qid").alias("node")).join(root, "node", "left").select("node", F.coalesce("root", "node").alias("cl"))
    border = (links.where(~F.col("core")).select(F.col("a").alias("qid"), F.col("b").alias("node")).join(cluster, "node")
              .groupBy("qid").agg(F.min("cl").alias("bl")))
    lab = (core.join(cluster.withColumnRenamed("node", "qid"), "qid", "left").join(border, "qid", "left")
           .select("qid", "core", F.coalesce("cl", "bl", F.lit(-1)).alias("cluster")))
    lab = rows.join(points.select("x", F.col("id").alias("qid")), "x").join(lab, "qid").select(F.col("__id").alias("__jid"), "core", "cluster")
    out = df.join(lab, F.col(id_col).cast("long") == F.col("__jid"), "left").drop("__jid")
    return out.withColumns({"core": F.coalesce("core", F.lit(False)), "cluster": F.coalesce("cluster", F.lit(-1).cast("long"))})


def silhouette(df: DataFrame, id_col: str, features, cluster_col: str = "cluster",
               exact: bool = True) -> float:
    """Mean silhouette with Euclidean distance (exact, block pairs) or Spark's
    squared-Euclidean evaluator (``exact=False``, linear time)."""
    if not exact:
        v = _vec_col(df, features).withColumn("__v", array_to_vector("__x"))
        return ClusteringEvaluator(featuresCol="__v", predictionCol=cluster_col).evaluate(v)
    x = _vec_col(df.select(F.col(id_col).cast("long").alias("__id"), F.col(cluster_col).cast("long").alias("__c"),
                           *([features] if isinstance(features, str) else features)), features).select(
        "__id", "__c", F.col("__x").alias("x"))
    good = x.where("__id IS NOT NULL AND __c IS NOT NULL AND x IS NOT NULL").where(F.forall("x", lambda e: e.isNotNull()))
    sums = block_pairs(good, _distance_sums, "__id long, oc long, s double, n long", "__id")
    per = sums.groupBy("__id", "oc").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    j = per.join(good.select("__id", "__c"), "__id").withColumn("mean_d", F.try_divide(F.col("s"), F.col("n")))
    ab = j.groupBy("__id").agg(F.max(F.when(F.col("oc") == F.col("__c"), F.col("mean_d"))).alias("a"),
                               F.min(F.when(F.col("oc") != F.col("__c"), F.col("mean_d"))).alias("b"),
                               F.max(F.when(F.col("oc") == F.col("__c"), F.col("n"))).alias("na"))
    sil = F.when((F.col("na") > 0) & F.col("b").isNotNull(),
                 (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return x.select("__id").distinct().join(ab, "__id", "left").agg(F.avg(sil)).first()[0]


def _all_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b by a matrix product; near ones, which it gives with few digits, plainly."""
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = a @ b.T
    d *= -2
    d += aa[:, None]
    d += bb[None, :]
    i, j = np.nonzero(d <= 1e8 * (a.shape[1] + 16) * 1e-15 * (aa[:, None] + bb.max()))
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    d[i, j] = exact(a[i], b[j], "euclidean")
    return d


def _distance_sums(a: pa.Table, b: pa.Table | None) -> pa.Table:
    """(__id, oc, s, n): sum of the distances of each row to the other block's rows of each cluster, and their number,
    for the rows of both blocks; without ``b`` to the other rows of a itself. Rows of equal id are not compared."""
    def block(t: pa.Table):
        c = t["__c"].to_numpy()
        order = np.argsort(c, kind="stable")
        labels, first = np.unique(c[order], return_index=True)
        return matrix(t["x"])[order], t["__id"].to_numpy()[order], labels, first, np.diff(np.append(first, len(c)))

    if not a.num_rows or (b is not None and not b.num_rows):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=["__id", "oc", "s", "n"])
    left = block(a)
    right = left if b is None else block(b)
    (xa, ia, la, fa, _), (xb, ib, lb, fb, nb) = left, right
    center = xa.mean(axis=0)
    xa, xb = xa - center, xb - center
    forth, back = np.zeros((len(xa), len(lb))), np.zeros((len(la), len(xb)))
    count = np.tile(nb, (len(xa), 1))
    step = max(1, PAIR_CELLS // len(xb))
    for s in range(0, len(xa), step):
        d = _all_distances(xa[s:s + step], xb)
        if b is None:
            i, j = np.nonzero(ia[s:s + step, None] == ib[None, :])
            d[i, j] = 0.0
            np.subtract.at(count, (s + i, np.searchsorted(fb, j, side="right") - 1), 1)
        forth[s:s + step] = np.add.reduceat(d, fb, axis=1)
        if b is not None:
            e = s + len(d)
            mine = np.flatnonzero((fa < e) & (np.append(fa[1:], len(xa)) > s))  # clusters of this chunk's rows
            back[mine] += np.add.reduceat(d, np.maximum(fa[mine] - s, 0), axis=0)
    out = [(np.repeat(ia, len(lb)), np.tile(lb, len(ia)), forth.ravel(), count.ravel())]
    if b is not None:
        out.append((np.repeat(ib, len(la)), np.tile(la, len(ib)), back.T.ravel(), np.tile(left[4], len(ib))))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["__id", "oc", "s", "n"])


def cluster_kmodes(df: DataFrame, cols: list[str], k: int, id_col: str, seed: int = 42) -> DataFrame:
    """K-modes for categorical columns: assign rows to the mode with fewest mismatches
    (modes are k x d values, shipped as literals), recompute every cluster's modes of all columns in
    one grouped count, and repeat until the modes are ones that were seen before (a fixed point,
    or the first of a cycle between ties). Initial modes: k distinct rows by seeded hash."""
    init = (df.select(*cols).distinct().withColumn("__h", F.xxhash64(F.lit(seed), *cols))
            .orderBy("__h").limit(k).collect())
    modes, seen = [[r[c] for c in cols] for r in init], []

    def assigned() -> DataFrame:
        dist = [sum((F.coalesce(F.col(c) != F.lit(m[i]), F.lit(True))).cast("int") for i, c in enumerate(cols))
                for m in modes]
        best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(j).alias("j")) for j, d in enumerate(dist)]))
        return df.withColumn("cluster", best["j"])

    while modes and modes not in seen:
        seen.append(modes)
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
        counts = assigned().select("cluster", cells.alias("c")).where("c.v IS NOT NULL").groupBy("cluster", "c.i", "c.v").count()
        best = counts.groupBy("cluster", "i").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("m")).collect()
        modes = [list(m) for m in modes]
        kinds = {i: df.schema[c].dataType for i, c in enumerate(cols)}
        for r in best:  # k x d values
            modes[r["cluster"]][r["i"]] = r["m"] if kinds[r["i"]].typeName() == "string" else _typed(df, r["m"], kinds[r["i"]])
    return assigned() if modes else df.withColumn("cluster", F.lit(None).cast("int"))


def _typed(df: DataFrame, text: str, kind):
    return df.sparkSession.range(1).select(F.lit(text).cast(kind)).first()[0]
