"""The reference's own test cases, re-expressed on Spark frames."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strata.functions import scalar as S
from strata.functions import types as TY
from strata.operators import quality as Q


def _sample_data(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"feature1": rng.normal(0, 1, 100), "feature2": rng.normal(5, 2, 100),
                        "category": rng.choice(["A", "B", "C"], 100), "target": rng.integers(0, 2, 100)})
    return spark.createDataFrame(pdf)


def test_type_detection_numeric_and_category(spark):
    d = {r["column"]: r for r in TY.detect_column_types(_sample_data(spark)).collect()}
    assert d["feature1"]["detected_type"] == "numeric" and d["feature1"]["confidence"] > 0.8
    assert d["category"]["detected_type"] == "object" and d["category"]["confidence"] > 0.8
    # 0.7 + 0.2 (ratio 0.03, 3 values) + 0.2 (small object) -> clamped to 1.0
    assert d["category"]["confidence"] == 1.0


def test_datetime_series_confidence(spark):
    pdf = pd.DataFrame({"date": pd.date_range("2023-01-01", periods=100), "value": np.arange(100.0)})
    d = {r["column"]: r for r in TY.detect_column_types(spark.createDataFrame(pdf)).collect()}
    assert d["date"]["detected_type"] == "datetime" and d["date"]["confidence"] > 0.9


def test_mixed_classification(spark):
    pdf = pd.DataFrame({"numeric_col": np.linspace(0, 1, 50), "categorical_col": ["x", "y"] * 25,
                        "datetime_col": pd.date_range("2023-01-01", periods=50)})
    c = {r["column"]: r["classification"] for r in TY.classify_columns(spark.createDataFrame(pdf)).collect()}
    assert c == {"numeric_col": "numerical", "categorical_col": "categorical", "datetime_col": "datetime"}


def test_upload_gate_valid_and_empty(spark):
    rows = {r["check"]: r["status"] for r in Q.gate_upload(_sample_data(spark)).collect()}
    assert set(rows.values()) == {"pass"}
    empty = spark.createDataFrame([], "a int")
    st = {r["check"]: r["status"] for r in Q.gate_upload(empty).collect()}
    assert st["data_not_empty"] == "error" and st["minimum_rows"] == "error" and st["minimum_columns"] == "error"
    missing = Q.gate_transition("upload", "eda", None).collect()
    assert missing[0]["status"] == "error" and "data" in missing[0]["message"]


def test_error_classes(spark):
    df = spark.createDataFrame([("MemoryError", "Out of memory"), ("KeyError", "Column not found"),
                                ("ValueError", "Invalid parameter"), (None, "request timeout"),
                                (None, "something else")], "kind string, message string")
    got = [r[0] for r in df.select(S.classify_error_text("message", "kind")).collect()]
    assert got == ["memory_error", "column_not_found", "invalid_parameter", "timeout_error", "unknown_error"]


def test_param_range_check(spark):
    df = spark.createDataFrame([("10",), ("invalid",), ("150",)], "value string")
    r = df.select(S.param_range_check(F.col("value"), "p", "int", 0, 100).alias("r")).select("r.*").collect()
    assert r[0]["valid"] and r[0]["value"] == 10
    assert not r[1]["valid"] and "type int" in r[1]["error"]
    assert not r[2]["valid"] and "<= 100" in r[2]["error"]


def test_log_lines_parse(spark):
    df = spark.createDataFrame([("2024-05-01 10:00:00,123 - app - ERROR - boom - again",), ("junk",)], "value string")
    r = S.parse_log_lines(df).collect()
    assert r[0]["logger"] == "app" and r[0]["level"] == "ERROR" and r[0]["message"] == "boom - again"
    assert r[1]["ts"] is None and r[1]["level"] is None
