"""Registered outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import outliers as O
from strata.operators import relational as RL
from strata.plans.q_windows import rnd
from strata.plans.registry import register
from strata.sources import tables as T

OC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, sf):
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *OC)


Q_SQL = "q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in OC) + " FROM lineitem)"


def _iqr_flag(c):
    return f"({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))"


@register("outlier_iqr", f"WITH {Q_SQL}\nSELECT l_orderkey, l_linenumber, " + ", ".join(OC) + ", " + ", ".join(
    f"{_iqr_flag(c)} AS {c}_outlier" for c in OC) + " FROM lineitem, q")
def q_outlier_iqr(spark, sf):
    return O.outlier_iqr(_li(spark, sf), OC)


@register("outlier_zscore", "WITH s AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in OC) + " FROM lineitem)\nSELECT l_orderkey, l_linenumber, "
    + ", ".join(OC) + ", " + ", ".join(
    f"CASE WHEN s_{c} > 0 THEN abs({c} - m_{c}) / s_{c} > 3 END AS {c}_outlier" for c in OC) + " FROM lineitem, s")
def q_outlier_zscore(spark, sf):
    return O.outlier_zscore(_li(spark, sf), OC)


@register("outlier_dbscan_1d", """
WITH f AS (SELECT o_orderkey, COALESCE(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) AS x FROM orders),
z AS (SELECT o_orderkey, (x - AVG(x) OVER ()) / STDDEV_POP(x) OVER () AS z FROM f),
c AS (SELECT *, COUNT(*) OVER (ORDER BY z RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) >= 5 AS core FROM z),
n AS (SELECT *, SUM(CASE WHEN core THEN 1 ELSE 0 END) OVER (ORDER BY z RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS near FROM c)
SELECT o.o_orderkey, o.o_totalprice, (NOT n.core AND n.near = 0) AS o_totalprice_outlier
FROM orders o JOIN n USING (o_orderkey)""")
def q_outlier_dbscan_1d(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return O.outlier_dbscan_1d(o, "o_totalprice", "o_orderkey")


LOF_SQL = """
WITH b AS (SELECT o_orderkey AS id, COALESCE(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) AS v FROM orders),
p AS (SELECT id, v, row_number() OVER (ORDER BY v, id) - 1 AS pos FROM b),
c AS (SELECT a.id, n.id AS nid, n.pos - a.pos AS off, abs(a.v - n.v) AS d
      FROM p a JOIN p n ON n.pos BETWEEN a.pos - 20 AND a.pos + 20 AND n.pos <> a.pos),
knn AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, abs(off), off) <= 20),
kd AS (SELECT id, MAX(d) AS kdist FROM knn GROUP BY id),
r AS (SELECT knn.id, greatest(knn.d, kd.kdist) AS rd FROM knn JOIN kd ON kd.id = knn.nid),
lrd AS (SELECT id, 1 / (AVG(rd) + 1e-10) AS lrd FROM r GROUP BY id),
lof AS (SELECT knn.id, AVG(l2.lrd) / MAX(l1.lrd) AS lof FROM knn JOIN lrd l2 ON l2.id = knn.nid
        JOIN lrd l1 ON l1.id = knn.id GROUP BY knn.id),
t AS (SELECT quantile_cont(lof, 0.9) AS thr FROM lof)
SELECT o.o_orderkey, o.o_totalprice, lof.lof > t.thr AS o_totalprice_outlier, round(lof.lof, 6) AS lof
FROM orders o JOIN lof ON lof.id = o.o_orderkey, t"""


@register("outlier_lof_1d", LOF_SQL)
def q_outlier_lof_1d(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return O.outlier_lof_1d(o, "o_totalprice", "o_orderkey").withColumn("lof", F.round("lof", 6))


@register("outlier_isolation_forest")
def q_outlier_isolation_forest(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return O.outlier_isolation_forest(o, ["o_totalprice"], "o_orderkey")


@register("outlier_auto_choice", f"""
SELECT n_rows, n_features, CASE WHEN n_rows < 50 THEN 'iqr' WHEN n_rows < 1000 AND n_features < 10 THEN 'isolation_forest'
  WHEN n_features >= 10 THEN 'lof' ELSE 'isolation_forest' END AS method
FROM (SELECT COUNT(*) AS n_rows, {len(OC)} AS n_features FROM lineitem)""")
def q_outlier_auto_choice(spark, sf):
    li = _li(spark, sf).select(*OC)
    n = li.count()
    feats = len(O._eligible(li, OC))
    return spark.createDataFrame([(n, feats, O.choose_outlier_method(n, feats))],
                                 "n_rows long, n_features int, method string")


@register("cap_outliers", f"WITH {Q_SQL}\nSELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(greatest(least({c}, q3_{c} + 1.5 * (q3_{c} - q1_{c})), q1_{c} - 1.5 * (q3_{c} - q1_{c})), 6) AS {c}"
    for c in OC) + " FROM lineitem, q")
def q_cap_outliers(spark, sf):
    return rnd(O.cap_outliers(_li(spark, sf), OC), 6)


@register("remove_outliers", f"WITH {Q_SQL}\nSELECT l_orderkey, l_linenumber, " + ", ".join(OC) +
          " FROM lineitem, q WHERE NOT (" + " OR ".join(_iqr_flag(c) for c in OC) + ")")
def q_remove_outliers(spark, sf):
    flagged = O.outlier_iqr(_li(spark, sf), OC)
    return O.remove_outliers(flagged, [f"{c}_outlier" for c in OC])


@register("outlier_summary", f"WITH {Q_SQL},\nf AS (SELECT " + ", ".join(
    f"COUNT(*) FILTER (WHERE {_iqr_flag(c)}) AS c_{c}" for c in OC) + ", COUNT(*) AS n FROM lineitem, q),\n"
    + "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", c_{c} AS count, n FROM f" for c in OC) + ")\n"
    + f"""SELECT "column", count, round(count * 100.0 / n, 6) AS percentage, SUM(count) OVER () AS total_outliers,
  round(SUM(count) OVER () * 100.0 / (n * {len(OC)}), 6) AS total_percentage,
  CASE WHEN SUM(count) OVER () * 100.0 / (n * {len(OC)}) > 10 THEN 'extreme_outliers'
       WHEN SUM(count) OVER () * 100.0 / (n * {len(OC)}) > 5 THEN 'cap_outliers' ELSE 'keep_outliers' END AS advice FROM u""")
def q_outlier_summary(spark, sf):
    flagged = O.outlier_iqr(_li(spark, sf), OC)
    s = O.outlier_summary(flagged, [f"{c}_outlier" for c in OC])
    return s.withColumn("percentage", F.round("percentage", 6)).withColumn("total_percentage",
                                                                          F.round("total_percentage", 6))


@register("union_masks", f"""WITH {Q_SQL},
s AS (SELECT AVG(l_extendedprice) AS m, STDDEV_SAMP(l_extendedprice) AS sd FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, {_iqr_flag('l_extendedprice')} AS iqr_flag,
        abs(l_extendedprice - m) / sd > 3 AS z_flag,
        {_iqr_flag('l_quantity')} AS q_flag FROM lineitem, q, s)
SELECT l_orderkey, l_linenumber, iqr_flag, z_flag, q_flag,
  (CAST(iqr_flag AS INT) + CAST(z_flag AS INT) + CAST(q_flag AS INT)) >= 1 AS any_flag,
  (CAST(iqr_flag AS INT) + CAST(z_flag AS INT) + CAST(q_flag AS INT)) >= 2 AS majority_flag FROM f""")
def q_union_masks(spark, sf):
    li = _li(spark, sf)
    a = O.outlier_iqr(li, ["l_extendedprice", "l_quantity"])
    a = (a.withColumnRenamed("l_extendedprice_outlier", "iqr_flag").withColumnRenamed("l_quantity_outlier", "q_flag"))
    b = O.outlier_zscore(a, ["l_extendedprice"]).withColumnRenamed("l_extendedprice_outlier", "z_flag")
    flags = ["iqr_flag", "z_flag", "q_flag"]
    j = RL.union_masks(b, flags, "any", "any_flag")
    j = RL.union_masks(j, flags, "majority", "majority_flag")
    return j.select("l_orderkey", "l_linenumber", *flags, "any_flag", "majority_flag")


# ------------------------------------------------------------------ series anomalies

from strata.operators import anomaly as AN  # noqa: E402


def _ev(spark, sf):
    return T.daily_events(spark, sf)


@register("anomaly_iforest_series")
def q_anomaly_iforest_series(spark, sf):
    return rnd(AN.detect_series(_ev(spark, sf), "ds", "value", ("event_type",), "isolation_forest"), 6)


@register("anomaly_kernel_novelty")
def q_anomaly_kernel_novelty(spark, sf):
    return rnd(AN.detect_series(_ev(spark, sf), "ds", "value", ("event_type",), "one_class_svm"), 6)


@register("anomaly_reconstruction")
def q_anomaly_reconstruction(spark, sf):
    return rnd(AN.detect_series(T.supplier_weeks_spiked(spark, sf), "ds", "sales", ("l_suppkey",), "lstm_autoencoder"), 6)


@register("anomaly_trend_season_residual")
def q_anomaly_trend_season_residual(spark, sf):
    return rnd(AN.detect_series(T.supplier_weeks_spiked(spark, sf), "ds", "sales", ("l_suppkey",), "prophet"), 6)


@register("anomaly_ensemble")
def q_anomaly_ensemble(spark, sf):
    return AN.anomaly_ensemble(_ev(spark, sf), "ds", "value", ("event_type",))


@register("anomaly_detect_all")
def q_anomaly_detect_all(spark, sf):
    _, summary = AN.detect_anomalies(T.supplier_weeks_spiked(spark, sf), "ds", "sales", ("l_suppkey",),
                                     methods=["isolation_forest", "one_class_svm", "statistical",
                                              "lstm_autoencoder", "prophet"])
    return summary
