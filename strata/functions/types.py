"""Column type detection with confidence scores.

Scores are computed as Column expressions over the per-column profile
(``operators.profile.profile_columns``): one wide aggregate and one
value-count aggregate for the whole table, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.profile import profile_columns

# Column-name keywords that mark a time column (English, Indonesian).
TIME_NAME_KEYWORDS = ["date", "time", "year", "month", "day", "tanggal", "waktu", "tahun", "bulan", "hari"]


def confidence_expr() -> Column:
    """Score: base 0.7, datetime +0.4 (+0.2 if unique_ratio > 0.9) and stop; else the
    ratio, frequency, mixed-text, numeric-quality and small-category adjustments; clamp to [0, 1]."""
    t = F.col("detected_type")
    ur, uc = F.col("unique_ratio"), F.col("unique_count")
    fr = F.coalesce(F.col("frequency_ratio"), F.lit(0.0))
    has_stats = uc > 0
    num = t == "numeric"
    obj = t == "object"

    def add(cond, v):
        return F.when(cond, F.lit(v)).otherwise(F.lit(0.0))

    dt = F.lit(0.7) + 0.4 + add(ur > 0.9, 0.2)
    other = (F.lit(0.7)
             + F.when(num & (ur > 0.9), 0.2).when(ur > 0.9, -0.2).otherwise(0.0)
             + add((ur < 0.1) & (uc <= 20), 0.2)
             + add(fr > 0.5, 0.1)
             + add(obj & F.coalesce(F.col("has_numbers"), F.lit(False)), -0.1)
             + add(num, 0.2)
             # the reference reads std/skew/min/max only when values exist; defaults apply otherwise
             + add(num & has_stats & (F.coalesce(F.col("std"), F.lit(0.0)) > 0), 0.1)
             + add(num & (~has_stats | (F.col("skewness") < 10)), 0.1)
             + add(num & (~has_stats | (F.col("min") != F.col("max"))), 0.1)
             + add(num & (F.col("null_percentage") < 0.1), 0.1)
             + add(obj & (uc <= 20) & (ur < 0.5), 0.2))
    raw = F.when(F.coalesce(F.col("is_datetime"), F.lit(False)), dt).otherwise(other)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def recommendations_expr() -> Column:
    """Recommendation codes in the reference's order."""
    t = F.col("detected_type")
    items = [
        F.when(F.col("null_percentage") > 0.5, F.lit("drop_high_missing")),
        F.when(F.coalesce(F.col("potential_categorical"), F.lit(False)), F.lit("treat_as_categorical")),
        F.when(F.col("unique_ratio") > 0.9, F.lit("id_column")),
        F.when((F.col("unique_count") <= 2) & (F.coalesce(F.col("frequency_ratio"), F.lit(0.0)) > 0.9),
               F.lit("binary")),
        F.when(t == "object", F.when(F.coalesce(F.col("is_datetime"), F.lit(False)), F.lit("convert_datetime"))
               .when(~F.coalesce(F.col("has_special_chars"), F.lit(False))
                     & (F.coalesce(F.col("avg_length"), F.lit(0.0)) < 20), F.lit("categorical_encoding"))),
    ]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def detect_column_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C1+C2: (column, detected_type, confidence, is_datetime, potential_categorical, recommendations)."""
    p = profile_columns(df, cols)
    return p.select("column", "detected_type", F.round(confidence_expr(), 6).alias("confidence"),
                    F.coalesce("is_datetime", F.lit(False)).alias("is_datetime"),
                    F.coalesce("potential_categorical", F.lit(False)).alias("potential_categorical"),
                    recommendations_expr().alias("recommendations"))


def classify_columns(df: DataFrame, confidence_threshold: float = 0.8, cols: list[str] | None = None) -> DataFrame:
    """(column, classification) in numerical / datetime / categorical; low confidence skipped."""
    d = detect_column_types(df, cols)
    t = F.col("detected_type")
    cls = (F.when((t == "numeric") & ~F.col("potential_categorical"), "numerical")
           .when((t == "datetime") | F.col("is_datetime"), "datetime")
           .when(t.isin("object", "categorical") | F.col("potential_categorical"), "categorical"))
    return (d.where(F.col("confidence") >= confidence_threshold)
            .select("column", cls.alias("classification")).where(F.col("classification").isNotNull()))


def detect_timeseries_columns(df: DataFrame, numeric_parse_as_datetime: bool = True) -> DataFrame:
    """Columns that parse as datetime (C4) or whose name has a time keyword.

    The reference's parser accepts numbers as epoch nanoseconds, so every numeric column
    qualifies; ``numeric_parse_as_datetime=False`` turns that quirk off.
    """
    d = profile_columns(df)
    pattern = "(?i)(" + "|".join(TIME_NAME_KEYWORDS) + ")"
    cond = F.col("column").rlike(pattern) | F.coalesce(F.col("is_datetime"), F.lit(False))
    if numeric_parse_as_datetime:
        cond = cond | (F.col("detected_type") == "numeric")
    return d.where(cond).select("column", F.col("column").rlike(pattern).alias("name_match"),
                                F.coalesce(F.col("is_datetime"), F.lit(False)).alias("parses_as_datetime"))
