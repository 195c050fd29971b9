"""Data-quality gates (V1-V8): each returns rows (check, status, message).

Every gate reads its table once: one aggregate gives row count, null
counts, distinct counts and (when needed) the duplicate count from a
``groupBy`` over all columns; the check rows are built from that single
result, so their number is bounded by the number of checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Gate and readiness messages (English texts of the reference).
M = {
    'empty': 'Dataset is empty or not loaded',
    'min_rows': 'Dataset has insufficient rows (minimum 10 required)',
    'min_cols': 'Dataset needs at least 2 columns (1 feature + 1 target)',
    'num_missing': 'Numerical columns not found in data: {cols}',
    'cat_missing': 'Categorical columns not found in data: {cols}',
    'overlap': 'Columns appear in both numerical and categorical lists: {cols}',
    'target_missing': "Target column '{target}' not found in dataset",
    'target_nulls': 'Target column has too many missing values ({ratio:.1%})',
    'high_missing': 'High percentage of missing values ({ratio:.1%})',
    'high_duplicates': 'High percentage of duplicate rows ({ratio:.1%})',
    'no_problem_type': 'Problem type not specified',
    'clf_classes': 'Classification requires at least 2 unique target values',
    'reg_continuous': 'Regression requires continuous target values',
    'split_missing': 'Missing {name}',
    'split_empty': 'Empty {name}',
    'train_len': 'X_train and y_train have different lengths',
    'test_len': 'X_test and y_test have different lengths',
    'feature_cols': 'X_train and X_test have different feature columns',
    'unknown_transition': 'Unknown workflow transition: {key}',
    'missing_data': 'Missing required data: data',
    'no_models': 'No trained models found',
    'no_interpretable': 'No interpretable models found. Consider training Random Forest, Gradient Boosting, or Linear models',
    'rows_ok': 'Dataset has sufficient rows ({n}) for training.',
    'rows_small': 'Dataset is relatively small ({n} rows). Consider cross-validation.',
    'rows_tiny': 'Dataset is very small ({n} rows). Machine learning might not be effective.',
    'cols_ok': 'Dataset has {c} columns, sufficient for feature engineering.',
    'cols_few': 'Dataset has very few columns. Limit feature engineering potential.',
    'miss_none': 'No missing values detected in the dataset.',
    'miss_low': 'Low percentage of missing values ({ratio:.1%}). Easy to handle.',
    'miss_moderate': 'Moderate percentage of missing values ({ratio:.1%}). Imputation recommended.',
    'miss_high': 'High percentage of missing values ({ratio:.1%}). Data cleaning is critical.',
    'numeric_target': 'Numeric columns detected, suitable for regression or time series.',
    'categorical_target': 'Categorical columns detected, suitable for classification.',
    'ready_optimal': 'Dataset is highly optimal for machine learning.',
    'ready_considerations': 'Dataset is ready for machine learning with some considerations.',
    'not_ready': 'Dataset requires significant cleaning before machine learning.',
    'rec_impute': 'Apply missing value imputation in Preprocessing tab.',
    'rec_small': 'Use robust models like Random Forest or Cross-Validation.',
    'rec_cleaning': 'Review data quality in EDA tab.',
    'eda_clean': 'Dataset is clean (no missing values).',
    'eda_missing': 'Dataset has {m} missing values. Preprocessing recommended.',
    'eda_corr_ok': 'Correlation analysis possible for {k} numerical features.',
    'eda_corr_few': 'Too few numerical features for correlation analysis.',
    'eda_dist': 'Distribution analysis available for numerical features.',
    'eda_outliers': 'Consider checking for outliers in numerical features before training.',
    'eda_ready': 'Exploratory Data Analysis is sufficient for basic ML transition.',
    'eda_rec_missing': 'Handle missing values in the Preprocessing tab.',
    'eda_rec_corr': 'Add more numerical features if possible for better insight.',
    'train_insufficient': 'Insufficient data for training ({n} samples).',
    'train_small': 'Small dataset ({n} samples). Results might be unstable.',
    'train_ok': 'Training data has {n} samples.',
    'classes_few': 'Classification requires at least 2 unique target classes.',
    'classes_ok': 'Found {u} classes for classification.',
    'scaling_hint': '{model} assumes feature scaling. Check if scaling was applied.',
    'gradient_nulls': '{model} might be sensitive to missing values.',
}


SCHEMA = "seq int, check string, status string, message string"


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Check rows with their position (seq) so reports keep the checks' order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def table_stats(df: DataFrame, with_duplicates: bool = False) -> dict:
    """rows, columns, total null cells and (optionally) duplicate rows beyond the first."""
    cols = df.columns
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}")
                                               for i, c in enumerate(cols)]).first()
    out = {"rows": r["n"], "columns": len(cols), "missing": sum(r[f"m{i}"] for i in range(len(cols))),
           "missing_by_col": {c: r[f"m{i}"] for i, c in enumerate(cols)}}
    if with_duplicates:
        d = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1)).first()[0]
        out["duplicates"] = d or 0
    return out


# ------------------------------------------------------------------ transition gates

def upload_checks(st: dict) -> list[tuple]:
    """V1: not empty, >= 10 rows, >= 2 columns."""
    out = []
    if st["rows"] == 0:
        out.append(("data_not_empty", "error", M["empty"]))
    else:
        out.append(("data_not_empty", "pass", ""))
    if st["rows"] < 10:
        out.append(("minimum_rows", "error", M["min_rows"]))
    else:
        out.append(("minimum_rows", "pass", ""))
    if st["columns"] < 2:
        out.append(("minimum_columns", "error", M["min_cols"]))
    else:
        out.append(("minimum_columns", "pass", ""))
    return out


def gate_upload(df: DataFrame) -> DataFrame:
    return _rows(df.sparkSession, upload_checks(table_stats(df)))


def preprocessing_checks(df: DataFrame, st: dict, numerical: list[str], categorical: list[str],
                         target: str | None) -> list[tuple]:
    """V2: listed columns exist, overlap warning, target exists and is <= 50 % null,
    missing cells > 30 % and duplicate rows > 10 % warnings."""
    out = []
    cols = set(df.columns)
    miss_num = [c for c in numerical if c not in cols]
    miss_cat = [c for c in categorical if c not in cols]
    overlap = sorted(set(numerical) & set(categorical))
    if miss_num:
        out.append(("column_consistency", "error", M["num_missing"].format(cols=miss_num)))
    if miss_cat:
        out.append(("column_consistency", "error", M["cat_missing"].format(cols=miss_cat)))
    if overlap:
        out.append(("column_consistency", "warning", M["overlap"].format(cols=overlap)))
    if not (miss_num or miss_cat or overlap):
        out.append(("column_consistency", "pass", ""))
    if target:
        if target not in cols:
            out.append(("target_validity", "error", M["target_missing"].format(target=target)))
        else:
            ratio = st["missing_by_col"][target] / st["rows"] if st["rows"] else 0.0
            if ratio > 0.5:
                out.append(("target_validity", "error", M["target_nulls"].format(ratio=ratio)))
            else:
                out.append(("target_validity", "pass", ""))
    else:
        out.append(("target_validity", "pass", ""))
    cells = st["rows"] * st["columns"]
    mp = st["missing"] / cells if cells else 0.0
    dp = st["duplicates"] / st["rows"] if st["rows"] else 0.0
    if mp > 0.3:
        out.append(("data_quality", "warning", M["high_missing"].format(ratio=mp)))
    if dp > 0.1:
        out.append(("data_quality", "warning", M["high_duplicates"].format(ratio=dp)))
    if mp <= 0.3 and dp <= 0.1:
        out.append(("data_quality", "pass", ""))
    return out


def gate_preprocessing(df: DataFrame, numerical: list[str], categorical: list[str],
                       target: str | None = None) -> DataFrame:
    st = table_stats(df, with_duplicates=True)
    return _rows(df.sparkSession, preprocessing_checks(df, st, numerical, categorical, target))


def problem_type_check(y: DataFrame | None, label: str | None, problem_type: str | None) -> tuple:
    """Classification needs >= 2 distinct targets, regression >= 10."""
    if problem_type is None:
        return ("problem_type", "error", M["no_problem_type"])
    if y is not None and problem_type in ("Classification", "Regression"):
        u = y.agg(F.count_distinct(label)).first()[0]
        if problem_type == "Classification" and u < 2:
            return ("problem_type", "error", M["clf_classes"])
        if problem_type == "Regression" and u < 10:
            return ("problem_type", "error", M["reg_continuous"])
    return ("problem_type", "pass", "")


def gate_training(x_train: DataFrame, x_test: DataFrame, y_train: DataFrame, y_test: DataFrame,
                  label: str, problem_type: str | None) -> DataFrame:
    """V3: split parts present and non-empty, equal X/y lengths, same feature columns, M11."""
    parts = {"X_train": x_train, "X_test": x_test, "y_train": y_train, "y_test": y_test}
    n = {k: (v.count() if v is not None else None) for k, v in parts.items()}
    errs = []
    for k, v in parts.items():
        if v is None:
            errs.append(M["split_missing"].format(name=k))
        elif n[k] == 0:
            errs.append(M["split_empty"].format(name=k))
    if x_train is not None and y_train is not None and n["X_train"] != n["y_train"]:
        errs.append(M["train_len"])
    if x_test is not None and y_test is not None and n["X_test"] != n["y_test"]:
        errs.append(M["test_len"])
    rows = [("train_test_split", "error", e) for e in errs] or [("train_test_split", "pass", "")]
    if x_train is not None and x_test is not None and x_train.columns != x_test.columns:
        rows.append(("feature_consistency", "error", M["feature_cols"]))
    else:
        rows.append(("feature_consistency", "pass", ""))
    rows.append(problem_type_check(y_train, label, problem_type))
    spark = (x_train or x_test).sparkSession
    return _rows(spark, rows)


# Workflow transitions and their checks.
TRANSITIONS = {
    "upload_to_eda": ["data_not_empty", "minimum_rows", "minimum_columns"],
    "eda_to_preprocessing": ["column_consistency", "target_validity", "data_quality"],
    "preprocessing_to_training": ["train_test_split", "feature_consistency", "problem_type"],
    "training_to_interpretation": ["model_results", "model_availability"],
}


def gate_transition(from_step: str, to_step: str, df: DataFrame | None = None, **kw) -> DataFrame:
    """V8: run the checks of a transition; an unknown transition is one error row."""
    key = f"{from_step}_to_{to_step}"
    spark = SparkSession.getActiveSession()
    if key not in TRANSITIONS:
        return _rows(spark, [("transition", "error", M["unknown_transition"].format(key=key))])
    if df is None and key in ("upload_to_eda", "eda_to_preprocessing"):
        return _rows(spark, [("required", "error", M["missing_data"])])
    if key == "upload_to_eda":
        return gate_upload(df)
    if key == "eda_to_preprocessing":
        return gate_preprocessing(df, kw.get("numerical", []), kw.get("categorical", []), kw.get("target"))
    if key == "preprocessing_to_training":
        return gate_training(kw.get("x_train"), kw.get("x_test"), kw.get("y_train"), kw.get("y_test"),
                             kw.get("label"), kw.get("problem_type"))
    results = kw.get("model_results") or []
    rows = [("model_results", "error", M["no_models"])] if not results else [("model_results", "pass", "")]
    interp = {"Random Forest", "Gradient Boosting", "Logistic Regression", "Linear Regression"}
    if results and not any(r in interp for r in results):
        rows.append(("model_availability", "warning", M["no_interpretable"]))
    else:
        rows.append(("model_availability", "pass", ""))
    return _rows(spark, rows)


# ------------------------------------------------------------------ readiness reports

def readiness_checks(st: dict, numerical: list[str], categorical: list[str]) -> list[tuple]:
    """V4 rows."""
    n, c = st["rows"], st["columns"]
    out = []
    if n >= 100:
        out.append(("rows", "success", M["rows_ok"].format(n=n)))
    elif n >= 20:
        out.append(("rows", "warning", M["rows_small"].format(n=n)))
    else:
        out.append(("rows", "error", M["rows_tiny"].format(n=n)))
    if c >= 3:
        out.append(("columns", "success", M["cols_ok"].format(c=c)))
    else:
        out.append(("columns", "warning", M["cols_few"]))
    mp = st["missing"] / (n * c) if n * c else 0.0
    if mp == 0:
        out.append(("missing", "success", M["miss_none"]))
    elif mp < 0.1:
        out.append(("missing", "success", M["miss_low"].format(ratio=mp)))
    elif mp < 0.3:
        out.append(("missing", "warning", M["miss_moderate"].format(ratio=mp)))
    else:
        out.append(("missing", "error", M["miss_high"].format(ratio=mp)))
    if numerical:
        out.append(("numeric_target", "success", M["numeric_target"]))
    if categorical:
        out.append(("categorical_target", "success", M["categorical_target"]))
    return out


def data_readiness(df: DataFrame, numerical: list[str], categorical: list[str]) -> DataFrame:
    return _rows(df.sparkSession, readiness_checks(table_stats(df), numerical, categorical))


def ml_readiness(checks: DataFrame) -> DataFrame:
    """V5: ready when no error; message; available workflows; advice by keyword."""
    st = F.col("status")
    msg = F.lower(F.col("message"))
    bad = checks.where(st.isin("error", "warning"))
    recs = F.filter(F.array(
        F.when(msg.contains("imputation") | msg.contains("missing"), F.lit(M["rec_impute"])),
        F.when(msg.contains("small"), F.lit(M["rec_small"])),
        F.when(msg.contains("cleaning"), F.lit(M["rec_cleaning"]))), lambda x: x.isNotNull())
    per = bad.select(F.when(st == "error", 0).otherwise(1).alias("__o"), "seq", recs.alias("r"))
    errs = checks.agg(F.count_if(st == "error").alias("e"), F.count_if(st == "warning").alias("w"))
    rec = per.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__o", "seq", "r"))),
                                        lambda s: s["r"])).alias("recommendations"))
    ready = F.col("e") == 0
    msg_out = (F.when(ready & (F.col("w") == 0), M["ready_optimal"])
               .when(ready, M["ready_considerations"])
               .otherwise(M["not_ready"]))
    flows = F.when(ready, F.array(*[F.lit(x) for x in ("Exploratory Data Analysis", "Preprocessing", "Model Training",
                                                        "Model Interpretation")])) \
        .otherwise(F.array(F.lit("Exploratory Data Analysis")))
    return errs.withColumn("__k", F.lit(1)).join(rec.withColumn("__k", F.lit(1)), "__k").select(
        ready.alias("ready"), msg_out.alias("message"), flows.alias("available_workflows"),
        F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"))


def eda_completeness(df: DataFrame, numerical: list[str], categorical: list[str]) -> DataFrame:
    """V6 rows."""
    st = table_stats(df)
    out = []
    if st["missing"] == 0:
        out.append(("missing", "success", M["eda_clean"]))
    else:
        out.append(("missing", "warning", M["eda_missing"].format(m=st["missing"])))
    if len(numerical) > 1:
        out.append(("correlation", "success", M["eda_corr_ok"].format(k=len(numerical))))
    else:
        out.append(("correlation", "warning", M["eda_corr_few"]))
    if numerical:
        out.append(("distribution", "success", M["eda_dist"]))
        out.append(("outliers", "info", M["eda_outliers"]))
    return _rows(df.sparkSession, out)


def eda_readiness(checks: DataFrame) -> DataFrame:
    """V6 summary: always ready; advice from warning rows."""
    msg = F.lower(F.col("message"))
    w = checks.where(F.col("status") == "warning")
    recs = F.filter(F.array(F.when(msg.contains("missing"), F.lit(M["eda_rec_missing"])),
                            F.when(msg.contains("correlation"),
                                   F.lit(M["eda_rec_corr"]))),
                    lambda x: x.isNotNull())
    r = w.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", recs.alias("r")))),
                                    lambda s: s["r"])).alias("recommendations"))
    return r.select(F.lit(True).alias("ready"),
                    F.lit(M["eda_ready"]).alias("message"),
                    F.array(F.lit("Preprocessing"), F.lit("Feature Engineering")).alias("available_transitions"),
                    F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"))


def training_readiness(x_train: DataFrame, y_train: DataFrame, label: str, problem_type: str,
                       model_type: str) -> DataFrame:
    """V7 rows: sample count, classes, scaling hint (linear), null hint (gradient)."""
    st = table_stats(x_train)
    n = st["rows"]
    out = []
    if n < 10:
        out.append(("rows", "error", M["train_insufficient"].format(n=n)))
    elif n < 50:
        out.append(("rows", "warning", M["train_small"].format(n=n)))
    else:
        out.append(("rows", "success", M["train_ok"].format(n=n)))
    if problem_type == "Classification":
        u = y_train.where(F.col(label).isNotNull()).agg(F.count_distinct(label)).first()[0]
        if u < 2:
            out.append(("classes", "error", M["classes_few"]))
        else:
            out.append(("classes", "success", M["classes_ok"].format(u=u)))
    if "Linear" in model_type or "Logistic" in model_type:
        out.append(("scaling", "info", M["scaling_hint"].format(model=model_type)))
    if "Gradient" in model_type and st["missing"] > 0:
        out.append(("missing", "warning", M["gradient_nulls"].format(model=model_type)))
    return _rows(x_train.sparkSession, out)
