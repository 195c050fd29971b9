"""Exact k-nearest neighbours and the operators built on them.

All of them use the pivot join of ``metric_join``: queries go only to partitions whose rings
the triangle inequality cannot rule out. ``block_pairs``, which compares all pairs of
a table's rows block by block, is for sums over all pairs (the exact silhouette).
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.metric_join import nearest, nearest_lists
from strata.session import checkpoint_dir

BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20
MOST_SPACES = 10_000  # rows of a few bytes


def _vec(df: DataFrame, cols) -> tuple[DataFrame, str]:
    """Ensure a single array<double> column named __x (from an array column or feature list)."""
    if isinstance(cols, str):
        return df.withColumn("__x", F.transform(F.col(cols), lambda v: v.cast("double"))), "__x"
    return df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in cols])), "__x"


def _blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / block_rows))


def _points(df: DataFrame, features) -> tuple[DataFrame, str]:
    """Rows whose features are all finite numbers; others have no neighbours."""
    v, x = _vec(df, features)
    return v.where(F.col(x).isNotNull() & F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))), x


def knn(queries: DataFrame, donors: DataFrame, q_id: str, d_id: str, features, k: int,
        exclude_self: bool = False, metric: str = "euclidean", block_rows: int | None = None,
        donor_label: str | None = None) -> DataFrame:
    """Exact k nearest donors per query: (q_id, nid, dist, rank[, label]).

    Ties on distance resolve to the smaller donor id. ``exclude_self`` drops a donor
    whose id equals the query id (self-join use). ``block_rows`` sets the donors of a partition."""
    q, x = _points(queries, features)
    d, _ = _points(donors, features)
    label = F.col(donor_label) if donor_label else F.lit(None).cast("int")
    d = d.select(F.col(d_id).alias("nid"), F.lit("").alias("space"), F.col(x).alias("x"), label.alias("label"))
    q = q.select(F.col(q_id).alias("qid"), F.lit("").alias("space"), F.col(x).alias("x"))
    cand = nearest(q, d, k + 1 if exclude_self else k, metric, block_rows)
    if exclude_self:
        cand = cand.where(~F.col("nid").eqNullSafe(F.col("qid")))
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("qid").alias(q_id), "nid", "dist", "rank", *(["label"] if donor_label else []))


def range_neighbors_1d(df: DataFrame, value_col: str, id_col: str, eps: float) -> DataFrame:
    """J5 (1-D): number of values within +-eps of each row (exact, distributed ranks)."""
    from strata.operators.ranks import count_in_ranges
    pts = df.select(id_col, F.col(value_col).cast("double").alias("__v"),
                    (F.col(value_col) - eps).alias("__lo"), (F.col(value_col) + eps).alias("__hi"))
    return count_in_ranges(pts, "__v", "__lo", "__hi", id_col)


def k_distance_curve(df: DataFrame, id_col: str, features, k: int = 5) -> DataFrame:
    """K4: distance to the k-th neighbour counting the point itself (so the (k-1)-th other
    point), sorted ascending."""
    n = df.count()
    kk = min(k, n - 1)
    nb = knn(df, df, id_col, id_col, features, kk - 1, exclude_self=True) if kk > 1 else None
    if nb is None:
        return df.select(id_col, F.lit(0.0).alias("k_distance"))
    kd = nb.where(F.col("rank") == kk - 1).select(id_col, F.col("dist").alias("k_distance"))
    return kd.orderBy("k_distance", id_col)


def recommend_eps(df: DataFrame, id_col: str, features) -> DataFrame:
    """eps = P90 of the k-distance curve (k = min(5, n-1) including self), min_samples =
    min(5, n // 10), density from the mean k-distance (<0.5 dense, >2 sparse). n <= 10: empty."""
    from strata.functions.stats import exact_quantiles
    n = df.count()
    spark = df.sparkSession
    schema = "recommended_eps double, recommended_min_samples int, mean_k_distance double, density string"
    if n <= 10:
        return spark.createDataFrame([], schema)
    checkpoint_dir(spark)
    kd = k_distance_curve(df, id_col, features, min(5, n - 1)).checkpoint()  # read by several passes
    p90 = exact_quantiles(kd, ["k_distance"], [0.9])[("k_distance", 0.9)]
    dens = F.when(F.col("m") < 0.5, "dense").when(F.col("m") > 2.0, "sparse").otherwise("moderate")
    return kd.agg(F.avg("k_distance").alias("m")).select(
        F.lit(p90).alias("recommended_eps"), F.lit(min(5, n // 10)).alias("recommended_min_samples"),
        F.col("m").alias("mean_k_distance"), dens.alias("density"))


def recommend_k(n_samples: int) -> int:
    """min(int(sqrt(n / 2)), 10, n // 5)."""
    return min(int(math.sqrt(n_samples / 2)), 10, n_samples // 5)


def validate_cluster_params(n_samples: int, method: str = "kmeans", n_clusters=None, eps=None,
                            min_samples=None) -> dict:
    """K < 2 -> 2; k > n // 2 -> 3; eps <= 0 error; min_samples < 1 or > n // 2 -> 5;
    warnings below 10 samples and for spectral below 50."""
    res = {"valid": True, "warnings": [], "errors": [], "n_clusters": None, "eps": None, "min_samples": None}
    if n_samples == 0:
        res["valid"] = False
        res["errors"].append("empty")
        return res
    if method in ("kmeans", "hierarchical", "spectral") and n_clusters is not None:
        if n_clusters < 2:
            res["warnings"].append("n_clusters_below_2")
            res["n_clusters"] = 2
        elif n_clusters > n_samples // 2:
            res["warnings"].append("n_clusters_too_large")
            res["n_clusters"] = 3
        else:
            res["n_clusters"] = n_clusters
    elif method == "dbscan":
        if eps is not None:
            if eps <= 0:
                res["errors"].append("eps_not_positive")
                res["valid"] = False
            else:
                res["eps"] = float(eps)
        if min_samples is not None:
            if min_samples < 1:
                res["warnings"].append("min_samples_below_1")
                res["min_samples"] = 5
            elif min_samples > n_samples // 2:
                res["warnings"].append("min_samples_too_large")
                res["min_samples"] = 5
            else:
                res["min_samples"] = min_samples
    if n_samples < 10:
        res["warnings"].append("few_samples")
    if n_samples < 50 and method == "spectral":
        res["warnings"].append("spectral_needs_50")
    return res


# ------------------------------------------------------------------ kNN imputation

def impute_knn(df: DataFrame, cols=None, id_col: str | None = None, k: int = 5,
               block_rows: int | None = None) -> DataFrame:
    """KNN imputation with nan-Euclidean distance and 1/d weights.

    d(x, y) = sqrt(p / m * sum over the m coordinates present in both of (x - y)^2) for
    p features; donors for column c are the rows where c is present; the k nearest
    donors (ties by id) are averaged with weights 1/d, an exact match taking all the
    weight; with no usable donor the column mean is used.

    That distance is a metric only among rows with the same missing columns, so every pair of a receiver's and
    a donor's missing pattern with data is a space of its own in the pivot join, on the coordinates that
    both have; the k nearest of each space are ranked together. A donor carries its values in the columns that the receiver
    lacks, and only rows with a missing value are joined with their estimates.
    """
    from strata.functions.stats import numeric_cols
    cols = list(cols or [c for c in numeric_cols(df, include_decimal=False) if c != id_col])
    if id_col is None:
        raise ValueError("impute_knn needs a unique id_col")
    p = len(cols)
    have = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    x = df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"), have.alias("have"))
    patterns = x.groupBy("have").count()
    recv = x.where(F.col("have").contains("0"))
    if recv.isEmpty():
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    # pairs of patterns that share a coordinate, and where the donor has one that the receiver lacks
    mine, theirs = patterns.select(F.col("have").alias("r")).where(F.col("r").contains("0")), patterns.select(F.col("have").alias("t"))
    bit = lambda c, i: F.substring(c, i + 1, 1) == "1"
    cells = F.array(*[F.struct(F.lit(i).alias("i"), bit("r", i).alias("has")) for i in range(p)])
    gives = F.array(*[F.struct(F.lit(i).alias("i"), bit("t", i).alias("has")) for i in range(p)])
    r_side = mine.select("r", F.explode(cells).alias("c")).select("r", "c.*")
    t_side = theirs.select("t", F.explode(gives).alias("c")).where("c.has").select("t", F.col("c.i").alias("i"))
    pairs = (r_side.join(t_side, "i").groupBy("r", "t").agg(F.count_if("has").alias("m"), F.count_if(~F.col("has")).alias("g"))
             .where("m > 0 and g > 0").withColumn("space", F.concat_ws("/", "r", "t"))
             .withColumn("both", F.array(*[bit("r", i) & bit("t", i) for i in range(p)])).checkpoint())
    known = F.broadcast(pairs) if pairs.count() <= MOST_SPACES else pairs
    shared = F.array(*[F.when(F.get("both", F.lit(i)), F.get("v", F.lit(i))).otherwise(0.0) for i in range(p)])
    lacks = F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.substr("r", i + 1, F.lit(1)) == "0")
    q = recv.join(known, F.col("have") == F.col("r")).select(F.struct("id", "space").alias("qid"), "space", shared.alias("x"))
    d = x.join(known, F.col("have") == F.col("t")).select(F.col("id").alias("nid"), "space", shared.alias("x"), F.transform(lacks, lambda i: F.get("v", i)).alias("label"))
    # lists of a receiver meet before they become rows; what follows needs no further shuffle of them
    near = nearest_lists(q, d, k, "euclidean", block_rows).select(F.col("qid.id").alias("rid"), "qid.space", "ids", "labels", "dists").repartition("rid")
    near = near.join(known.select("space", "m", "r"), "space")
    each = near.select("rid", "m", lacks.alias("lacks"), F.explode(F.arrays_zip("ids", "labels", "dists")).alias("e"))
    each = each.select("rid", F.col("e.ids").alias("did"), F.sqrt(F.lit(float(p)) / F.col("m") * F.col("e.dists") * F.col("e.dists")).alias("dist"),
                       F.explode(F.arrays_zip(F.col("lacks").alias("ci"), F.col("e.labels").alias("val"))).alias("v"))
    cand = each.select("rid", "did", "dist", "v.ci", "v.val").where(F.col("val").isNotNull())
    w = Window.partitionBy("rid", "ci").orderBy("dist", "did")
    top = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    has_zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("rid", "ci"))
    wgt = F.when(has_zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    est = (top.withColumn("w", wgt).groupBy("rid", "ci")
           .agg((F.sum(F.col("w") * F.col("val")) / F.sum("w")).alias("est")))
    wide = est.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("ci", "est"))).alias("__m"))
    lacking = F.lit(False)
    for c in cols:
        lacking = lacking | F.col(c).isNull()
    j = df.where(lacking).join(wide.withColumnRenamed("rid", id_col), id_col, "left")
    filled = [F.coalesce(F.col(c).cast("double"), F.coalesce(F.col("__m")[F.lit(i)], F.lit(means[c]))).alias(c) for i, c in enumerate(cols)]
    others = [F.col(c) for c in df.columns if c not in cols]
    whole = df.where(~lacking).select(*[F.col(c).cast("double").alias(c) for c in cols], *others)
    return j.select(*filled, *others).unionByName(whole).select(*df.columns)


def predict_knn_classifier(train: DataFrame, test: DataFrame, id_col: str, label_col: str, features,
                           k: int = 5, weights: str = "uniform", metric: str = "euclidean") -> DataFrame:
    """M4: majority (or 1/d-weighted) vote of the k nearest training rows; ties -> smallest label."""
    nb = knn(test, train, id_col, id_col, features, k, metric=metric, donor_label=label_col)
    met = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(id_col)) == 1  # exact matches take all the weight
    w = F.lit(1.0) if weights == "uniform" else F.when(met, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    votes = nb.withColumn("w", w).groupBy(id_col, "label").agg(F.sum("w").alias("score"))
    return votes.groupBy(id_col).agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("prediction"))


def block_pairs(rows: DataFrame, fn, schema: str, key: str) -> DataFrame:
    """``fn(a, b)`` on Arrow tables, once per pair of blocks of the rows (``b`` is None for a block with itself);
    callers aggregate inside ``fn`` so only per-row summaries leave a task. ``rows`` have a vector ``x``.

    Rows are dealt to blocks by the hash of ``key``, equal keys to the same one. A block has at most about
    ``BLOCK_BYTES`` of vectors, so a row is copied once per block."""
    n, d = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(n * max(d or 1, 1) * 8 / BLOCK_BYTES), min(_blocks(n, BLOCK_ROWS), math.isqrt(2 * tasks)), 1)
    mine = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("__own", o).alias("i"), F.greatest("__own", o).alias("j")))
    each = rows.withColumn("__own", mine).withColumn("__pair", F.explode(pairs)).select("*", "__pair.i", "__pair.j").drop("__pair")
    each = each.repartition(blocks * (blocks + 1) // 2, "i", "j")  # few rows, much work: not coalesced

    def both(t: pa.Table) -> pa.Table:
        first = pc.equal(t["__own"], t["i"])
        return fn(t.filter(first), None if t["i"][0].as_py() == t["j"][0].as_py() else t.filter(pc.invert(first)))

    return each.groupBy("i", "j").applyInArrow(both, schema)
