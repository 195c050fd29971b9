"""Projections, filters, joins, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.stats import exact_quantiles, numeric_cols, string_cols

# ------------------------------------------------------------------ projections / filters


def select_by_type(df: DataFrame, kind: str = "numeric") -> DataFrame:
    """Keep columns of a type class: numeric, categorical (strings and booleans), all_numbers."""
    if kind == "numeric":
        cols = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    elif kind == "categorical":
        cols = string_cols(df, include_bool=True)
    else:
        cols = numeric_cols(df)
    return df.select(*cols)


def drop_high_null_columns(df: DataFrame, max_missing_ratio: float = 0.5, keep=()) -> DataFrame:
    """Drop columns whose null ratio exceeds the limit (one aggregate decides)."""
    cols = list(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = row["__n"] or 0
    drop = [c for i, c in enumerate(cols) if c not in keep and n and row[f"m{i}"] / n > max_missing_ratio]
    return df.drop(*drop)


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows with a null in any checked column removed."""
    return df.na.drop(how="any", subset=subset)


def filter_by_mask(df: DataFrame, mask: str | Column) -> DataFrame:
    """Rows where a boolean flag holds."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return df.where(F.coalesce(m, F.lit(False)))


def lookup_by_key(df: DataFrame, keys: DataFrame, on: str | list | Column) -> DataFrame:
    """P5 bulk lookup: rows of ``df`` whose key occurs in ``keys`` (left semi join)."""
    return df.join(keys, on, "left_semi")


def keys_available(keys: DataFrame, existing: DataFrame, on) -> DataFrame:
    """P5 availability: requested keys that do not exist yet (left anti join)."""
    return keys.join(existing, on, "left_anti")


def filter_unexpired(df: DataFrame, ts_col: str, asof, ttl: str = "24 HOURS") -> DataFrame:
    """Rows still valid at ``asof`` (created + ttl > asof)."""
    return df.where(F.col(ts_col) + F.expr(f"INTERVAL {ttl}") > F.lit(asof).cast("timestamp_ntz"))


def seeded_sample(df: DataFrame, n: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """N rows without replacement, stable under repartitioning: smallest seeded hash.

    ``orderBy(...).limit(n)`` plans as a per-partition top-n then a merge of n rows per
    partition, so no task sees more than n rows per input partition.
    """
    from strata.functions.stats import seeded_hash_cols
    return df.withColumn("__h", seeded_hash_cols(id_cols, seed)).orderBy("__h", *id_cols).limit(n).drop("__h")


def inf_to_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """+-inf (and NaN) become null, then nulls take the column median of the finite values."""
    fin = {c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in cols}
    clean = df.select(*[fin[c].alias(c) if c in fin else F.col(c) for c in df.columns])
    med = exact_quantiles(clean, cols, [0.5])
    return clean.select(*[F.coalesce(F.col(c), F.lit(med[(c, 0.5)])).alias(c) if c in fin else F.col(c)
                          for c in df.columns])


def project_prediction_inputs(df: DataFrame, features: list[str], order_col: str, sample_index: int,
                              partition_cols=()) -> DataFrame:
    """The chosen features of the row at ``sample_index`` (clamped to the last row) per series."""
    w = Window.partitionBy(*partition_cols).orderBy(order_col) if partition_cols else Window.orderBy(order_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy())
    rn = F.row_number().over(w)
    t = df.select(*partition_cols, order_col, *features, rn.alias("__rn"), n.alias("__n"))
    return t.where(F.col("__rn") == F.least(F.lit(sample_index), F.col("__n") - 1) + 1).drop("__rn", "__n")


# ------------------------------------------------------------------ joins

def join_value_counts(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """J1 frequency encoding: each row gets its value's count (null value -> null).

    The count table has one row per distinct value; AQE turns the join into a
    broadcast when that table is small at run time, else it stays a shuffle join.
    """
    out = out or f"{col}_freq"
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, col, "left")


def join_on_index(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left-outer alignment of a derived frame on the order key."""
    return left.join(right, key, "left")


def split_missing(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows to predict: target null, rows to train on: target known)."""
    return df.where(F.col(target).isNull()), df.where(F.col(target).isNotNull())


def foreign_key_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (left anti join)."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


# ------------------------------------------------------------------ set operations

def union_long(df: DataFrame, id_cols: list[str], features: list[str], value_name: str = "value") -> DataFrame:
    """Stack per-feature frames into (ids..., feature, value)."""
    return df.unpivot(id_cols, features, "feature", value_name)


def columns_frame(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "column string")


def intersect_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names present in both column lists."""
    return a.select("column").intersect(b.select("column"))


def except_columns(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected names that are missing."""
    return expected.select("column").exceptAll(present.select("column"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """U4: drop duplicate rows."""
    return df.distinct()


def union_masks(df: DataFrame, flags: list[str], vote: str = "any", out: str = "combined") -> DataFrame:
    """Combine method flags: any (reference OR), majority, or all."""
    s = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    need = {"any": 1, "all": len(flags), "majority": len(flags) // 2 + 1}[vote]
    return df.withColumn(out, s >= need)


# ------------------------------------------------------------------ sorts

def sort_by_time(df: DataFrame, date_col: str) -> DataFrame:
    """K1: rows ordered by the parsed date (range-partitioned global sort)."""
    return df.withColumn(date_col, F.col(date_col).cast("timestamp_ntz")).orderBy(date_col)


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """K2: the k highest scores; ties broken by ``tie`` so the cut is deterministic."""
    return df.orderBy(F.desc(score), F.asc(tie)).limit(k)


def sort_by_abs(df: DataFrame, col: str, tie: str) -> DataFrame:
    """K3: rows ordered by |value| descending."""
    return df.orderBy(F.abs(F.col(col)).desc(), F.asc(tie))


def head_non_null(df: DataFrame, col: str, order_cols: list[str], n: int = 10) -> DataFrame:
    """K5: first n non-null values by order."""
    return df.where(F.col(col).isNotNull()).orderBy(*order_cols).limit(n).select(*order_cols, col)


def top_one_class(df: DataFrame, class_col: str, value_col: str) -> DataFrame:
    """K6: the class with the largest total |value| (smallest class on ties)."""
    tot = df.groupBy(class_col).agg(F.sum(F.abs(F.col(value_col))).alias("total"))
    return tot.agg(F.min_by(class_col, F.struct(-F.col("total"), F.col(class_col))).alias(class_col),
                   F.max("total").alias("total"))
