"""Both sides of every rule threshold."""

import pytest
from pyspark.sql import functions as F

from strata.operators import balance as B
from strata.operators import prep as PR
from strata.operators import profile as P


@pytest.mark.parametrize("pct,level", [(4.9, "low"), (5.0, "moderate"), (19.9, "moderate"), (20.0, "high"),
                                       (39.9, "high"), (40.0, "very_high")])
def test_missing_levels(spark, pct, level):
    n = 1000
    k = int(round(pct * 10))
    df = spark.range(n).select(F.when(F.col("id") < k, None).otherwise(F.col("id")).alias("x"))
    r = P.missing_levels(df).collect()
    assert r[0]["level"] == level


@pytest.mark.parametrize("ratio,method", [(3.0, "none"), (3.01, "ros"), (5.0, "ros"), (5.01, "borderline_smote"),
                                          (10.0, "borderline_smote"), (10.01, "smote")])
def test_balancing_rule(ratio, method):
    assert B.choose_balancing(ratio) == method


@pytest.mark.parametrize("pct,strategy", [(4.99, "simple"), (5.0, "knn"), (19.99, "knn"), (20.0, "iterative"),
                                          (39.99, "iterative"), (40.0, "model")])
def test_imputation_rule(pct, strategy):
    assert PR.choose_imputation_strategy(pct) == strategy


def test_imbalance_levels(spark):
    for counts, level in (([30, 10], "slight"), ([31, 10], "moderate"), ([101, 10], "severe")):
        rows = [(0,)] * counts[0] + [(1,)] * counts[1]
        r = P.class_imbalance(spark.createDataFrame(rows, "y int"), "y").first()
        assert r["imbalance_level"] == level


def test_potential_categorical_boundary(spark):
    # 20 distinct values over 201 rows: ratio < 0.1 -> potential categorical; 21 values -> not
    a = spark.createDataFrame([(float(i % 20),) for i in range(201)], "x double")
    b = spark.createDataFrame([(float(i % 21),) for i in range(201)], "x double")
    assert P.numeric_moments(a).first()["potential_categorical"]
    assert not P.numeric_moments(b).first()["potential_categorical"]


def test_scaling_rule():
    assert PR.choose_scaling({"rows": 100, "outliers": 6, "mean_abs_skew": 0.0}) == "robust"
    assert PR.choose_scaling({"rows": 100, "outliers": 5, "mean_abs_skew": 1.01}) == "power"
    assert PR.choose_scaling({"rows": 100, "outliers": 0, "mean_abs_skew": 0.51}) == "quantile"
    assert PR.choose_scaling({"rows": 100, "outliers": 0, "mean_abs_skew": 0.5}) == "standard"
