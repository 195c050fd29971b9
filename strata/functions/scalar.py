"""Scalar Column functions: dates, JSON metadata, error text, log lines, parameter checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_features(df: DataFrame, date_col: str) -> DataFrame:
    """Year, month, day, dayofweek (Monday = 0), quarter, is_month_start, is_month_end."""
    d = F.to_date(F.col(date_col))
    return df.select("*", F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
                     F.weekday(d).alias("dayofweek"), F.quarter(d).alias("quarter"),
                     (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
                     (d == F.last_day(d)).cast("int").alias("is_month_end"))


def future_dates(df: DataFrame, date_col: str, periods: int = 10, freq: str = "D",
                 partition_cols=()) -> DataFrame:
    """The next ``periods`` dates after the last date (per series), at D, W or M steps."""
    last = df.groupBy(*partition_cols).agg(F.max(date_col).alias("__last"))
    idx = F.sequence(F.lit(1), F.lit(periods))
    if freq == "D":
        seq = F.transform(idx, lambda i: F.date_add(F.col("__last"), i))
    elif freq == "W":
        seq = F.transform(idx, lambda i: F.date_add(F.col("__last"), i * 7))
    elif freq == "M":
        seq = F.transform(idx, lambda i: F.add_months(F.col("__last"), i))
    else:
        seq = F.transform(idx, lambda i: F.col("__last") + F.make_dt_interval(hours=i))
    return last.select(*partition_cols, F.explode(seq).alias(date_col))


def json_field(c: Column | str, field: str, cast: str = "long") -> Column:
    """One field of a JSON metadata string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.get_json_object(c, f"$.{field}").cast(cast)


# Error classes by keyword, checked in this order (first match wins).
ERROR_KEYWORDS = [
    ("memory_error", ["memory", "ram"]),
    ("timeout_error", ["timeout", "time"]),
    ("column_not_found", ["column", "key"]),
    ("data_empty", ["empty", "none"]),
    ("invalid_parameter", ["parameter", "argument"]),
    ("model_training_failed", ["model", "training"]),
    ("prediction_failed", ["prediction", "predict"]),
]

# Exception kinds that decide the class before any keyword.
ERROR_KINDS = {"MemoryError": "memory_error", "KeyError": "column_not_found",
               "ValueError": "invalid_parameter", "TimeoutError": "timeout_error"}


def classify_error_text(text: Column | str, kind: Column | str | None = None) -> Column:
    """Error class from the exception kind, else the first keyword rule on lower(text)."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    expr = None
    if kind is not None:
        k = F.col(kind) if isinstance(kind, str) else kind
        for name, cls in ERROR_KINDS.items():
            expr = (F.when(k == name, cls) if expr is None else expr.when(k == name, cls))
    for cls, words in ERROR_KEYWORDS:
        cond = None
        for w in words:
            cond = t.contains(w) if cond is None else (cond | t.contains(w))
        expr = F.when(cond, cls) if expr is None else expr.when(cond, cls)
    return expr.otherwise("unknown_error")


# Log record layout "asctime - name - levelname - message".
LOG_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (.*?) - ([A-Z]+) - (.*)$"


def parse_log_lines(df: DataFrame, col: str = "value", keep=()) -> DataFrame:
    """Split log lines back into (ts, logger, level, message); non-matching lines give nulls."""
    c = F.col(col)
    ts = F.regexp_extract(c, LOG_PATTERN, 1)
    return df.select(*keep,
        F.try_to_timestamp(F.nullif(ts, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        F.nullif(F.regexp_extract(c, LOG_PATTERN, 2), F.lit("")).alias("logger"),
        F.nullif(F.regexp_extract(c, LOG_PATTERN, 3), F.lit("")).alias("level"),
        F.nullif(F.regexp_extract(c, LOG_PATTERN, 4), F.lit("")).alias("message"))


def scan_error_log(spark, path: str) -> DataFrame:
    """S4 source: read a log file as lines and parse it (splits are per file block)."""
    return parse_log_lines(spark.read.text(path), "value")


def format_log_line(ts: Column, logger: Column, level: Column, message: Column) -> Column:
    return F.concat_ws(" - ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"), logger, level, message)


def param_range_check(value: Column, param_name: str, expected_type: str = "int",
                      min_value=None, max_value=None) -> Column:
    """P10: coerce to the type, then range-check; returns struct(valid, value, error)."""
    py_name = {"int": "int", "bigint": "int", "double": "float"}.get(expected_type, expected_type)
    v = value.try_cast(expected_type)
    err = F.when(v.isNull(), F.lit(f"Parameter '{param_name}' must be of type {py_name}"))
    if min_value is not None:
        err = err.when(v < min_value, F.lit(f"Parameter '{param_name}' must be >= {min_value}"))
    if max_value is not None:
        err = err.when(v > max_value, F.lit(f"Parameter '{param_name}' must be <= {max_value}"))
    return F.struct(err.isNull().alias("valid"), v.alias("value"), err.alias("error"))
