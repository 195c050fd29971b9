"""Registered learning queries: split, classifiers, regressors, grid search, clustering, reduction."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strata.operators import cluster as CL
from strata.operators import linkage as LK
from strata.operators import learn as L
from strata.operators import reduce as RD
from strata.operators.neighbors import recommend_eps
from strata.plans.q_neighbors import EMB_D, _test_sql, hash_test_flag
from strata.plans.q_windows import rnd
from strata.functions.stats import seeded_hash_sql
from strata.plans.registry import register
from strata.session import checkpoint_dir
from strata.sources import tables as T

FEATS = ["n_chars", "n_words"]


def _split(spark, sf):
    return L.train_test_split(T.balance_set(spark, sf), "doc_id", "label", 0.2, 42)


def _h(x: str, salt: int, seed: int = 42) -> str:
    return seeded_hash_sql([x], seed, salt)



@register("train_test_split", f"""WITH {T.SQL_BALANCE_SET}
SELECT doc_id, n_chars, n_words, label,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_h('doc_id', 0)}, doc_id) - 1
            < floor(COUNT(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM balance_set""")
def q_train_test_split(spark, sf):
    return _split(spark, sf)


def _pred_out(pred, id_col="doc_id"):
    cols = [id_col, F.col("prediction").cast("double").alias("prediction")]
    if "probability" in pred.columns:
        cols.append(vector_to_array("probability")[1].alias("p1"))
    return pred.select(*cols)


@register("fit_random_forest_classifier")
def q_fit_rf_classifier(spark, sf):
    s = _split(spark, sf)
    m = L.fit_random_forest_classifier(s.where("split = 'train'"), FEATS, "label", n_estimators=100)
    return _pred_out(m.transform(s.where("split = 'test'")))


@register("fit_logistic_regression")
def q_fit_logistic_regression(spark, sf):
    s = _split(spark, sf)
    m = L.fit_logistic_regression(s.where("split = 'train'"), FEATS, "label", C=1.0, class_weight="balanced")
    return _pred_out(m.transform(s.where("split = 'test'")))


@register("fit_svc")
def q_fit_svc(spark, sf):
    s = _split(spark, sf)
    m, _ = L.fit_svc(s.where("split = 'train'"), FEATS, "label", C=1.0, kernel="linear")
    return _pred_out(m.transform(s.where("split = 'test'")))


@register("fit_svc_rbf")
def q_fit_svc_rbf(spark, sf):
    s = _split(spark, sf)
    train = s.where("split = 'train'")
    m, info = L.fit_svc(train, FEATS, "label", C=1.0, kernel="rbf", gamma="scale")
    test = L.random_fourier_features(s.where("split = 'test'"), FEATS, info["gamma"], out="features")
    return _pred_out(m.transform(test))


def _li_reg(spark, sf):
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@register("fit_random_forest_regressor")
def q_fit_rf_regressor(spark, sf):
    li = _li_reg(spark, sf)
    m = L.fit_random_forest_regressor(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return m.transform(li).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction")


@register("fit_gbt_regressor")
def q_fit_gbt_regressor(spark, sf):
    info = L.forecast_ml_train(T.daily_sales(spark, sf), "ds", "sales", "gradient_boosting")
    return info["model"].transform(info["train_frame"]).select("ds", "sales", "prediction")


@register("fit_linear_regression", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS coef, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
FROM lineitem""")
def q_fit_linear_regression(spark, sf):
    li = _li_reg(spark, sf)
    m = L.fit_linear_regression(li, ["l_quantity"], "l_extendedprice").stages[-1]
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 4))],
                                 "coef double, intercept double")


@register("preset_grid_search")
def q_preset_grid_search(spark, sf):
    s = _split(spark, sf).where("split = 'train'")
    _, table = L.preset_grid_search(s, FEATS, "label", "LogisticRegression", "Default", folds=3)
    return table


KNN_GRID_SQL = """
WITH emb AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
pairs AS (SELECT a.vec_id, a.label AS truth, b.label AS nlabel, b.vec_id AS nid,
  sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS euclidean,
  list_sum(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2]))) AS manhattan
  FROM emb a, emb b WHERE """ + _test_sql('a.vec_id') + " AND NOT " + _test_sql('b.vec_id') + """),
far AS (UNPIVOT pairs ON euclidean, manhattan INTO NAME metric VALUE dist),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric, vec_id ORDER BY dist, nid) AS r, min(dist) OVER (PARTITION BY metric, vec_id) = 0 AS met FROM far),
grid AS (SELECT * FROM (SELECT UNNEST([3, 5, 7, 9]) AS k), (SELECT UNNEST(['uniform', 'distance']) AS weights)),
votes AS (SELECT k, weights, metric, vec_id, truth, nlabel,
  sum(CASE WHEN weights = 'uniform' THEN 1.0 WHEN met THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(1 AS DOUBLE) / dist END) AS score
  FROM ranked, grid WHERE r <= k GROUP BY ALL),
pred AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY k, weights, metric, vec_id ORDER BY score DESC, nlabel) = 1)
SELECT CAST(k AS INTEGER) AS n_neighbors, weights, metric, round(AVG(CASE WHEN nlabel = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY k, weights, metric"""


@register("knn_grid_search", KNN_GRID_SQL)
def q_knn_grid_search(spark, sf):
    e = T.table(spark, sf, "embeddings")
    g = L.knn_grid_search(e.where(~hash_test_flag()), e.where(hash_test_flag()), "vec_id",
                          "label", "embedding")
    return g.withColumn("accuracy", F.round("accuracy", 6))


@register("forecast_ml_train")
def q_forecast_ml_train(spark, sf):
    info = L.forecast_ml_train(T.daily_sales(spark, sf), "ds", "sales", "random_forest")
    return info["model"].transform(info["train_frame"]).select("ds", "sales", "prediction")


@register("assemble_features", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity, l_discount, l_tax] AS features FROM lineitem""")
def q_assemble_features(spark, sf):
    li = _li_reg(spark, sf)
    a = L.assemble_features(li, ["l_quantity", "l_discount", "l_tax"])
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", vector_to_array("features").alias("features"))


@register("impute_model")
def q_impute_model(spark, sf):
    d = T.lineitem_nulls(spark, sf).select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                           "l_returnflag")
    return L.impute_model(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("save_pipeline")
def q_save_pipeline(spark, sf):
    s = _split(spark, sf)
    m = L.fit_logistic_regression(s.where("split = 'train'"), FEATS, "label")
    path = f"{checkpoint_dir(spark)}/models/logreg-{uuid.uuid4().hex}"
    L.save_pipeline(m, path)
    return _pred_out(L.load_pipeline(path).transform(s.where("split = 'test'")))


def _emb(spark, sf):
    return T.table(spark, sf, "embeddings")


@register("cluster_kmeans")
def q_cluster_kmeans(spark, sf):
    return CL.cluster_kmeans(_emb(spark, sf), "embedding", 10).select("vec_id", "label", "cluster")


@register("cluster_hierarchical")
def q_cluster_hierarchical(spark, sf):
    return CL.cluster_hierarchical(_emb(spark, sf), "embedding", 10).select("vec_id", "label", "cluster")


@register("linkage_tree")
def q_linkage_tree(spark, sf):
    return LK.linkage_tree(_emb(spark, sf), "vec_id", "embedding")


LINKAGE_SQL = f"""WITH RECURSIVE {EMB_D},
least AS (SELECT avg(d) AS height FROM (SELECT vec_id, min(dist) AS d FROM pairs GROUP BY 1)),
links AS (SELECT vec_id AS a, nid AS b FROM pairs, least WHERE dist <= height),
reach AS (SELECT vec_id AS a, vec_id AS b FROM emb UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, any_value(e.label) AS label, min(b) AS cluster FROM emb e JOIN reach r ON r.a = e.vec_id GROUP BY 1"""


@register("cluster_linkage", LINKAGE_SQL)
def q_cluster_linkage(spark, sf):
    """The tree cut at the mean distance of a row to its nearest other row (each row's least edge in the tree)."""
    e = _emb(spark, sf)
    tree = LK.linkage_tree(e, "vec_id", "embedding").checkpoint()
    ends = tree.select(F.explode(F.array("a", "b")).alias("v"), "height")
    height = ends.groupBy("v").agg(F.min("height").alias("h")).agg(F.avg("h")).first()[0]
    return LK.cut_tree(e, "vec_id", tree, height=height or 0.0).select("vec_id", "label", "cluster")


@register("cluster_spectral")
def q_cluster_spectral(spark, sf):
    return CL.cluster_spectral(_emb(spark, sf), "vec_id", "embedding", 10).select("vec_id", "label", "cluster")


DBSCAN_SQL = f"""WITH RECURSIVE {EMB_D},
ranked AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nid) AS r FROM pairs),
p AS (SELECT quantile_cont(dist, 0.9) AS eps, least(5, COUNT(*) // 10) AS least FROM ranked WHERE r = 4),
near AS (SELECT vec_id, nid FROM pairs, p WHERE dist <= eps),
core AS (SELECT e.vec_id, e.label, COUNT(n.nid) + 1 >= any_value(p.least) AS core FROM emb e LEFT JOIN near n USING (vec_id), p GROUP BY 1, 2),
links AS (SELECT n.vec_id AS a, n.nid AS b FROM near n JOIN core c ON c.vec_id = n.vec_id AND c.core JOIN core d ON d.vec_id = n.nid AND d.core),
reach AS (SELECT vec_id AS a, vec_id AS b FROM core WHERE core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
border AS (SELECT c.vec_id, min(root) AS root FROM core c JOIN near n USING (vec_id) JOIN roots ON a = n.nid WHERE NOT c.core GROUP BY 1)
SELECT c.vec_id, c.label, c.core, coalesce(r.root, b.root, -1) AS cluster FROM core c LEFT JOIN roots r ON r.a = c.vec_id LEFT JOIN border b ON b.vec_id = c.vec_id"""


@register("cluster_dbscan", DBSCAN_SQL)
def q_cluster_dbscan(spark, sf):
    e = _emb(spark, sf)
    r = recommend_eps(e, "vec_id", "embedding").first()
    return CL.cluster_dbscan(e, "vec_id", "embedding", eps=r["recommended_eps"],
                             min_samples=r["recommended_min_samples"]).select("vec_id", "label", "core", "cluster")


@register("silhouette", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.x, b.x)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT e.vec_id, max(CASE WHEN other = e.label THEN d END) AS a, min(CASE WHEN other <> e.label THEN d END) AS b
  FROM e LEFT JOIN p ON p.vec_id = e.vec_id GROUP BY 1)
SELECT count(*) AS rows, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def q_silhouette(spark, sf):
    e = _emb(spark, sf).withColumn("cluster", F.col("label"))
    s = CL.silhouette(e, "vec_id", "embedding")
    return e.agg(F.count("*").alias("rows")).withColumn("silhouette", F.round(F.lit(float(s)), 6))


@register("silhouette_kmeans")
def q_silhouette_kmeans(spark, sf):
    k = CL.cluster_kmeans(_emb(spark, sf), "embedding", 10)
    s = CL.silhouette(k, "vec_id", "embedding")
    return spark.createDataFrame([(10, float(s))], "k int, silhouette double")


@register("cluster_kmodes")
def q_cluster_kmodes(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", "c_mktsegment",
                                             F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return CL.cluster_kmodes(c, ["c_mktsegment", "c_nationkey"], 5, "c_custkey")


@register("reduce_pca")
def q_reduce_pca(spark, sf):
    out, _ = RD.reduce_pca(_emb(spark, sf), "embedding", 5)
    return rnd(out.drop("embedding"), 6)


@register("reduce_truncated_svd")
def q_reduce_truncated_svd(spark, sf):
    out, _ = RD.reduce_truncated_svd(_emb(spark, sf), "embedding", 5)
    return rnd(out.drop("embedding"), 6)


@register("reduce_lda")
def q_reduce_lda(spark, sf):
    return rnd(RD.reduce_lda(_emb(spark, sf), "embedding", "label", 3).drop("embedding"), 6)


@register("reduce_kernel_pca")
def q_reduce_kernel_pca(spark, sf):
    return rnd(RD.reduce_kernel_pca(_emb(spark, sf).select("vec_id", "embedding"), "embedding", 3, gamma=0.5).drop("embedding"), 6)
