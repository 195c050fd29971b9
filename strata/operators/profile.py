"""Column profiling, missing-value analysis and frequency aggregates.

All per-column statistics come from two jobs whatever the column count:
one wide single-pass aggregate (moments, null counts, text flags) and one
unpivoted ``groupBy(column, value)`` for distinct counts and modes. Both
use map-side partial aggregation, so a hot value (a third of all rows)
collapses before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.stats import (kurt_corrected, numeric_cols, safe_corr,
                                    skew_corrected)

R = 6  # digits kept on ratios and moments


def _basic_type(t: str) -> str:
    if t in ("int", "bigint", "smallint", "tinyint", "double", "float") or t.startswith("decimal"):
        return "numeric"
    if t == "boolean":
        return "boolean"
    if t.startswith("timestamp") or t == "date":
        return "datetime"
    return "object"


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot to (column, vn, v): vn orders numbers numerically, v is the text form."""
    types = dict(df.dtypes)
    items = []
    for c in cols:
        num = _basic_type(types[c]) == "numeric"
        items.append(F.struct(F.lit(c).alias("column"),
                              (F.col(c).cast("double") if num else F.lit(None).cast("double")).alias("vn"),
                              F.col(c).cast("string").alias("v")))
    return df.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def distinct_and_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, unique_count, top_count, most_frequent): exact, shuffle-bounded by distinct values.

    Ties on the top count resolve to the smallest value (numeric order for numbers).
    """
    vc = (_long_values(df, cols).where(F.col("v").isNotNull())
          .groupBy("column", "vn", "v").agg(F.count(F.lit(1)).alias("cnt")))
    # one aggregate: distinct count, top count, and the top value (highest count, then
    # smallest value) via min_by over (-count, numeric value, text value)
    return vc.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.max("cnt").alias("top_count"),
        F.min_by("v", F.struct(-F.col("cnt"), F.col("vn"), F.col("v"))).alias("most_frequent"))


def _wide_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One pass: per column null count, numeric moments and text flags, unpivoted."""
    types = dict(df.dtypes)
    aggs: list[Column] = [F.count(F.lit(1)).alias("__total")]
    for i, c in enumerate(cols):
        col = F.col(c)
        bt = _basic_type(types[c])
        aggs.append(F.count(col).alias(f"nn{i}"))
        if bt == "numeric":
            d = col.cast("double")
            aggs += [F.min(d).alias(f"mn{i}"), F.max(d).alias(f"mx{i}"), F.avg(d).alias(f"mu{i}"),
                     F.stddev_samp(d).alias(f"sd{i}"), skew_corrected(d).alias(f"sk{i}"),
                     kurt_corrected(d).alias(f"ku{i}")]
        if bt == "object":
            s = col.cast("string")
            aggs += [F.avg(F.length(s)).alias(f"al{i}"),
                     F.bool_or(s.rlike(r"\d")).alias(f"hn{i}"),
                     F.bool_or(s.rlike(r"[^\w\s]")).alias(f"hs{i}"),
                     F.bool_and(F.try_to_timestamp(s).isNotNull()).alias(f"dt{i}")]
    wide = df.agg(*aggs)
    null_d, null_b = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    rows = []
    for i, c in enumerate(cols):
        bt = _basic_type(types[c])
        num, obj = bt == "numeric", bt == "object"
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(bt).alias("detected_type"),
            F.col("__total").alias("total"),
            (F.col("__total") - F.col(f"nn{i}")).alias("null_count"),
            (F.col(f"mn{i}") if num else null_d).alias("min"),
            (F.col(f"mx{i}") if num else null_d).alias("max"),
            (F.col(f"mu{i}") if num else null_d).alias("mean"),
            (F.col(f"sd{i}") if num else null_d).alias("std"),
            (F.col(f"sk{i}") if num else null_d).alias("skewness"),
            (F.col(f"ku{i}") if num else null_d).alias("kurtosis"),
            (F.col(f"al{i}") if obj else null_d).alias("avg_length"),
            (F.col(f"hn{i}") if obj else null_b).alias("has_numbers"),
            (F.col(f"hs{i}") if obj else null_b).alias("has_special_chars"),
            (F.coalesce(F.col(f"dt{i}"), F.lit(False)) if obj else F.lit(bt == "datetime")).alias("is_datetime"),
        ))
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def profile_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Everything the type detector needs, one row per column (internal full form)."""
    cols = list(cols or df.columns)
    st = _wide_stats(df, cols)
    dm = distinct_and_mode(df, cols)
    p = st.join(dm, "column", "left")
    uc = F.coalesce(F.col("unique_count"), F.lit(0))
    total = F.col("total").cast("double")
    return p.select(
        "column", "detected_type", "total", "null_count",
        F.try_divide(F.col("null_count"), total).alias("null_percentage"),
        uc.alias("unique_count"),
        F.coalesce(F.try_divide(uc, total), F.lit(0.0)).alias("unique_ratio"),
        F.when(uc > 0, F.col("most_frequent")).alias("most_frequent"),
        F.when(uc > 0, F.try_divide(F.col("top_count"), total)).alias("frequency_ratio"),
        F.when(uc > 0, F.col("avg_length")).alias("avg_length"),
        F.when(uc > 0, F.col("has_numbers")).alias("has_numbers"),
        F.when(uc > 0, F.col("has_special_chars")).alias("has_special_chars"),
        (F.col("is_datetime") & (uc > 0)).alias("is_datetime"),
        "min", "max", "mean", "std", "skewness", "kurtosis",
        ((F.col("detected_type") == "numeric") & (uc <= 20)
         & (F.try_divide(uc, total) < 0.1)).alias("potential_categorical"))


def column_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A1: total, nulls, distinct, mode and text flags per column."""
    p = profile_columns(df, cols)
    return p.select("column", "total", "null_count", F.round("null_percentage", R).alias("null_percentage"),
                    "unique_count", F.round("unique_ratio", R).alias("unique_ratio"), "most_frequent",
                    F.round("frequency_ratio", R).alias("frequency_ratio"),
                    F.round("avg_length", R).alias("avg_length"), "has_numbers", "has_special_chars")


def numeric_moments(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: min, max, mean, sample std, corrected skew/kurtosis, potential_categorical.

    potential_categorical needs an exact distinct count only when it can be <= 20: one pass
    computes the moments and a HyperLogLog screen; only columns whose estimate is <= 50
    (HLL++ is exact-sparse at such sizes) get an exact distinct count, so a high-cardinality
    column never pays for a value-count shuffle."""
    cols = list(cols or numeric_cols(df))
    st = _wide_stats(df, cols)
    hll = df.agg(*[F.approx_count_distinct(c).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    low = [c for i, c in enumerate(cols) if hll[f"h{i}"] <= 50]
    if low:
        uc = distinct_count(df, low)
    else:
        uc = df.sparkSession.createDataFrame([], "column string, unique_count long")
    p = st.join(F.broadcast(uc), "column", "left")
    pc = (F.coalesce(F.col("unique_count"), F.lit(10**9)) <= 20) & \
        (F.coalesce(F.col("unique_count"), F.lit(10**9)) / F.col("total") < 0.1)
    return p.select("column", F.round("min", R).alias("min"), F.round("max", R).alias("max"),
                    F.round("mean", R - 1).alias("mean"), F.round("std", R).alias("std"),
                    F.round("skewness", R).alias("skewness"), F.round("kurtosis", R).alias("kurtosis"),
                    pc.alias("potential_categorical"))


# ------------------------------------------------------------- missing values

def _null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, missing_count, rows) from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    items = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"),
                      F.col("__n").alias("rows")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def missing_level(pct: Column) -> Column:
    """A4 level codes; only defined for pct > 0."""
    return (F.when(pct <= 0, None).when(pct < 5, "low").when(pct < 20, "moderate")
            .when(pct < 40, "high").otherwise("very_high"))


def missing_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: per column with nulls: count and %, plus table totals repeated on each row."""
    cols = list(cols or df.columns)
    nc = _null_counts(df, cols)
    pct = F.col("missing_count") * 100.0 / F.col("rows")
    # nc holds one row per column (bounded by the schema), so a global window is safe here
    w = Window.partitionBy()
    tot = nc.select("*", F.sum("missing_count").over(w).alias("total_missing"),
                    F.count_if(F.col("missing_count") > 0).over(w).alias("columns_with_missing"))
    return (tot.where(F.col("missing_count") > 0)
            .select("column", "missing_count", F.round(pct, R).alias("missing_percentage"),
                    "total_missing", "columns_with_missing",
                    F.round(F.col("total_missing") * 100.0 / (F.col("rows") * len(cols)), R)
                    .alias("total_percentage")))


def missing_levels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A4: level per column with nulls: <5 low, <20 moderate, <40 high, else very_high."""
    cols = list(cols or df.columns)
    nc = _null_counts(df, cols).where(F.col("missing_count") > 0)
    pct = F.col("missing_count") * 100.0 / F.col("rows")
    return nc.select("column", F.round(pct, R).alias("missing_percentage"), missing_level(pct).alias("level"))


def missing_recommendations(df: DataFrame, target_column: str | None = None,
                            cols: list[str] | None = None) -> DataFrame:
    """Strategy codes per column by level (indicator skipped for the target at <5 %)."""
    cols = list(cols or df.columns)
    nc = _null_counts(df, cols).where(F.col("missing_count") > 0)
    pct = F.col("missing_count") * 100.0 / F.col("rows")
    is_target = F.col("column") == F.lit(target_column) if target_column else F.lit(False)
    strategies = (F.when(pct < 5, F.when(is_target, F.array(F.lit("simple_imputation")))
                         .otherwise(F.array(F.lit("simple_imputation"), F.lit("missing_indicator"))))
                  .when(pct < 20, F.array(F.lit("advanced_imputation"), F.lit("missing_indicator")))
                  .when(pct < 40, F.array(F.lit("model_based"), F.lit("advanced_imputation")))
                  .otherwise(F.array(F.lit("delete_columns"), F.lit("model_based"))))
    return nc.select("column", F.round(pct, R).alias("missing_percentage"),
                     missing_level(pct).alias("level"), strategies.alias("strategies"))


def _indicator_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r of every pair of null indicators from exact counts (one aggregate).

    For 0/1 indicators r = (n*n_ab - n_a*n_b) / sqrt(n_a(n-n_a) * n_b(n-n_b)); null when
    either indicator is constant (as pandas gives NaN).
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"a{i}") for i, c in enumerate(cols)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    aggs += [F.count_if(F.col(cols[i]).isNull() & F.col(cols[j]).isNull()).alias(f"p{i}_{j}")
             for i, j in pairs]
    wide = df.agg(*aggs)
    n = F.col("n").cast("double")
    items = []
    for i, j in pairs:
        na, nb, nab = F.col(f"a{i}"), F.col(f"a{j}"), F.col(f"p{i}_{j}")
        den = F.sqrt(na * (n - na) * nb * (n - nb))
        r = F.when(den > 0, (n * nab - na * nb) / den)
        items.append(F.struct(F.lit(cols[i]).alias("column_a"), F.lit(cols[j]).alias("column_b"),
                              r.alias("correlation"), F.col("n").alias("rows")))
    if not items:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double, rows long")
    return wide.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def missing_correlation(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """A5: indicator pairs with |r| > 0.5 (only when the table has more than 10 rows)."""
    cols = list(cols or df.columns)
    c = _indicator_corr(df, cols)
    return (c.where((F.col("rows") > 10) & (F.abs("correlation") > threshold))
            .select("column_a", "column_b", F.round("correlation", R).alias("correlation")))


def missing_pattern(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """MCAR when no pair |r|>0.5, MNAR when any |r|>0.7, else MAR (null below 11 rows)."""
    cols = list(cols or df.columns)
    c = _indicator_corr(df, cols)
    a = F.abs("correlation")
    agg = c.agg(F.max("rows").alias("rows"), F.count_if(a > 0.5).alias("n_high"),
                F.count_if(a > 0.7).alias("n_very_high"))
    pattern = (F.when(F.col("rows") <= 10, None).when(F.col("n_high") == 0, "MCAR")
               .when(F.col("n_very_high") > 0, "MNAR").otherwise("MAR"))
    return agg.select(pattern.alias("pattern"), F.col("n_high").alias("high_corr_pairs"))


# ------------------------------------------------------------- frequencies

def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) sorted by count desc then value."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value"))


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    """Ratio max/min, minority/majority class (smallest label on ties), Gini, level, advice."""
    vc = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("cnt"))
    n = F.sum("cnt")
    k = F.count(F.lit(1))
    a = vc.agg(n.alias("n"), k.alias("k"), F.max("cnt").alias("mx"), F.min("cnt").alias("mn"),
               F.min_by("cls", F.struct(F.col("cnt"), F.col("cls"))).alias("minority_class"),
               F.min_by("cls", F.struct(-F.col("cnt"), F.col("cls"))).alias("majority_class"),
               F.sum(F.col("cnt") * F.col("cnt")).alias("ss"),
               F.collect_list(F.col("cnt")).alias("counts"))
    ratio = F.try_divide(F.col("mx").cast("double"), F.col("mn"))
    avg = F.col("n") / F.col("k")
    level = F.when(ratio > 10, "severe").when(ratio > 3, "moderate").otherwise("slight")
    recs = F.concat(F.when(ratio > 3, F.array(F.lit("ensemble_methods"), F.lit("threshold_tuning")))
                    .otherwise(F.array().cast("array<string>")),
                    F.when(F.col("k") > 2, F.array(F.lit("multiclass_strategies")))
                    .otherwise(F.array().cast("array<string>")))
    return a.select(
        F.round(ratio, R).alias("imbalance_ratio"), F.col("minority_class").cast("string").alias("minority_class"),
        F.col("majority_class").cast("string").alias("majority_class"),
        F.round(1 - F.col("ss") / (F.col("n") * F.col("n")), R).alias("gini"),
        level.alias("imbalance_level"),
        F.size(F.filter("counts", lambda x: x < avg)).alias("minority_classes"),
        F.size(F.filter("counts", lambda x: x >= avg)).alias("majority_classes"),
        recs.alias("recommendations"))


def distinct_count(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """A10: distinct non-null values per column (exact via unpivot+groupBy, or HLL++)."""
    cols = list(cols or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)])
        items = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("unique_count"))
                 for i, c in enumerate(cols)]
        return wide.select(F.explode(F.array(*items)).alias("s")).select("s.*")
    return (_long_values(df, cols).where(F.col("v").isNotNull()).distinct()
            .groupBy("column").agg(F.count(F.lit(1)).alias("unique_count")))


def mode_value(df: DataFrame, cols: list[str], default: str = "Unknown") -> DataFrame:
    """Most frequent value (smallest on ties), default when a column is all null."""
    dm = distinct_and_mode(df, cols)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(dm, "column", "left")
            .select("column", F.coalesce("most_frequent", F.lit(default)).alias("mode")))


def count_by(df: DataFrame, key: str, alias: str = "total") -> DataFrame:
    """GROUP BY key, COUNT, ORDER BY count desc."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(alias))
            .orderBy(F.desc(alias), key))


def usage_by_feature(df: DataFrame, feature: str, count_col: str, ts_col: str) -> DataFrame:
    """SUM(use_count), MAX(last_used) per feature, ORDER BY total desc."""
    return (df.groupBy(feature).agg(F.sum(count_col).alias("total_uses"),
                                    F.max(ts_col).alias("last_used"))
            .orderBy(F.desc("total_uses"), feature))


def having_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1))


def duplicate_ratio(df: DataFrame) -> DataFrame:
    """Full-row duplicates beyond the first / rows; warn above 0.1 (null-safe grouping)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c"))
    a = g.agg(F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("duplicates"))
    ratio = F.coalesce(F.try_divide(F.col("duplicates").cast("double"), F.col("rows")), F.lit(0.0))
    return a.select(F.coalesce("rows", F.lit(0)).alias("rows"),
                    F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
                    F.round(ratio, R).alias("duplicate_ratio"), (ratio > 0.1).alias("warn"))
