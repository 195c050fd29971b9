"""Supervised learning with preset grids (M1-M12, E6, I5, S5) on ``pyspark.ml``.

Estimators are Spark ML (distributed fits); preset grids become
``ParamGridBuilder`` grids searched by ``CrossValidator`` or
``TrainValidationSplit`` with ``parallelism``. Library parameters map to
Spark's: C -> regParam = 1 / (C * n), max_depth None -> 20 (Spark's limit
is 30), max_features -> featureSubsetStrategy, class_weight 'balanced'
-> a weight column n / (k * n_class). ``min_samples_split`` has no Spark
counterpart and is ignored; poly/sigmoid SVC kernels are not offered.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.forest import fit_forest

# Parameter presets per model and preset name (library parameter names).
PARAMETER_PRESETS = {
    "RandomForestClassifier": {
        "Default": {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7, None], "min_samples_split": [2, 5, 10],
                    "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2", None]},
        "Fast Training": {"n_estimators": [50, 100], "max_depth": [3, 5], "min_samples_split": [2, 5],
                          "min_samples_leaf": [1, 2], "max_features": ["sqrt"]},
        "High Accuracy": {"n_estimators": [200, 300, 500], "max_depth": [5, 7, 10, None],
                          "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                          "max_features": ["sqrt", "log2", None]},
        "Small Dataset": {"n_estimators": [50, 100], "max_depth": [3, 5, 7], "min_samples_split": [5, 10, 15],
                          "min_samples_leaf": [2, 4, 6], "max_features": ["sqrt", "log2"]},
    },
    "LogisticRegression": {
        "Default": {"C": [0.1, 1.0, 10.0], "penalty": ["l2"], "solver": ["lbfgs"], "max_iter": [1000]},
        "Fast Training": {"C": [0.1, 1.0], "penalty": ["l2"], "solver": ["lbfgs"], "max_iter": [500]},
        "High Accuracy": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2", "elasticnet"],
                          "solver": ["saga"], "max_iter": [2000]},
        "Balanced Dataset": {"C": [0.1, 1.0, 10.0], "penalty": ["l2"], "solver": ["lbfgs"],
                             "class_weight": ["balanced"]},
    },
    "SVC": {
        "Default": {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]},
        "Fast Training": {"C": [0.1, 1.0], "kernel": ["linear"], "gamma": ["scale"]},
        "High Accuracy": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "kernel": ["rbf", "poly", "sigmoid"],
                          "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0]},
        "Linear Kernel": {"C": [0.1, 1.0, 10.0], "kernel": ["linear"], "gamma": ["scale"]},
    },
    "KNeighborsClassifier": {
        "Default": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"],
                    "metric": ["euclidean", "manhattan"]},
        "Fast Training": {"n_neighbors": [3, 5], "weights": ["uniform"], "metric": ["euclidean"]},
        "High Accuracy": {"n_neighbors": [3, 5, 7, 9, 11, 15], "weights": ["uniform", "distance"],
                          "metric": ["euclidean", "manhattan", "minkowski"]},
        "Small Dataset": {"n_neighbors": [1, 3, 5], "weights": ["uniform"], "metric": ["euclidean"]},
    },
    "RandomForestRegressor": {
        "Default": {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7, None], "min_samples_split": [2, 5, 10],
                    "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2", None]},
        "Fast Training": {"n_estimators": [50, 100], "max_depth": [3, 5], "min_samples_split": [2, 5],
                          "min_samples_leaf": [1, 2], "max_features": ["sqrt"]},
        "High Accuracy": {"n_estimators": [200, 300, 500], "max_depth": [5, 7, 10, None],
                          "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                          "max_features": ["sqrt", "log2", None]},
        "Small Dataset": {"n_estimators": [50, 100], "max_depth": [3, 5, 7], "min_samples_split": [5, 10, 15],
                          "min_samples_leaf": [2, 4, 6], "max_features": ["sqrt", "log2"]},
    },
}

MAX_DEPTH_NONE = 20


def get_preset_params(model_type: str, preset_name: str = "Default") -> dict:
    return PARAMETER_PRESETS.get(model_type, {}).get(preset_name, {})


def assemble_features(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Numeric columns -> one ML vector column (nulls kept as NaN would fail: callers fill first)."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def train_test_split(df: DataFrame, id_col: str, label: str | None = None, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """M9: adds ``split`` in {train, test}. Stratified by ``label`` when given: within each class
    the first floor((1 - f) n_c) rows in seeded-hash order train (distributed per-class ranks);
    otherwise a seeded hash of the id decides. Stable under repartitioning."""
    from strata.functions.stats import seeded_hash
    from strata.operators.balance import _class_ranks
    if label is None:
        u = seeded_hash(F.col(id_col), seed, 5) % 1000000 / 1000000.0
        return df.withColumn("split", F.when(u < test_fraction, "test").otherwise("train"))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    ranked = _class_ranks(df, label, id_col, seed).join(counts, label)
    keep = F.floor(F.col("__n") * (1 - test_fraction))
    return ranked.select(*df.columns, F.when(F.col("__rank") < keep, "train").otherwise("test").alias("split"))


# ------------------------------------------------------------------ estimators

def _rf_params(est, p: dict):
    kw = {}
    if "n_estimators" in p:
        kw["numTrees"] = int(p["n_estimators"])
    if "max_depth" in p:
        kw["maxDepth"] = MAX_DEPTH_NONE if p["max_depth"] is None else int(p["max_depth"])
    if "min_samples_leaf" in p:
        kw["minInstancesPerNode"] = int(p["min_samples_leaf"])
    if "max_features" in p:
        kw["featureSubsetStrategy"] = {"sqrt": "sqrt", "log2": "log2", None: "all"}[p["max_features"]]
    return est.copy().setParams(**kw) if kw else est


def fit_random_forest_classifier(train: DataFrame, features: list[str], label: str, seed: int = 42,
                                 **params) -> PipelineModel:
    """M1: random forest classifier (defaults: 100 trees)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, numTrees=100)
    rf = _rf_params(rf, params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), rf]).fit(train)


def _balanced_weights(df: DataFrame, label: str, out: str = "__w") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    k = counts.count()
    n = df.count()
    return df.join(counts, label).withColumn(out, F.lit(n) / (F.lit(k) * F.col("__c"))).drop("__c")


def fit_logistic_regression(train: DataFrame, features: list[str], label: str, C: float = 1.0,
                            penalty: str = "l2", max_iter: int = 100, class_weight: str | None = None,
                            **_) -> PipelineModel:
    """M2: logistic regression; C -> regParam 1/(C n), penalty -> elasticNetParam (l1 1, l2 0, elasticnet 0.5)."""
    n = train.count()
    enet = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5, "none": 0.0}[penalty]
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * n), elasticNetParam=enet,
                            maxIter=max_iter)
    if class_weight == "balanced":
        train = _balanced_weights(train, label)
        lr.setWeightCol("__w")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), lr]).fit(train)


def random_fourier_features(df: DataFrame, features: list[str] | str, gamma: float, n_components: int = 100,
                            seed: int = 42, out: str = "rff") -> DataFrame:
    """RBF-kernel features z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).

    ``features``: columns, or one array column. W and b are drawn on the driver from the seed
    (size D x d, independent of rows) and multiplied block by block of rows in Arrow batches."""
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(c) for c in features])
    one = df.withColumn("__rx", F.transform(x, lambda v: v.cast("double")))
    d = len(features) if not isinstance(features, str) else (one.agg(F.max(F.size("__rx"))).first()[0] or 1)
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, d))
    b = rng.uniform(0, 2 * math.pi, size=n_components)

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(math.sqrt(2.0 / n_components) * np.cos(np.vstack(rows.to_numpy()) @ W.T + b)))

    return one.withColumn(out, array_to_vector(project("__rx"))).drop("__rx")


def svc_gamma(df: DataFrame, features: list[str], gamma) -> float:
    """'scale' = 1 / (d * var(X)) over all feature values, 'auto' = 1 / d, else the number."""
    d = len(features)
    if gamma == "auto":
        return 1.0 / d
    if gamma == "scale":
        arr = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in features])).alias("v"))
        var = arr.agg(F.var_pop("v")).first()[0] or 1.0
        return 1.0 / (d * var)
    return float(gamma)


def fit_svc(train: DataFrame, features: list[str], label: str, C: float = 1.0, kernel: str = "linear",
            gamma="scale", seed: int = 42, **_) -> tuple[PipelineModel, dict]:
    """M3: linear SVM; RBF through random Fourier features; multi-class by one-vs-rest."""
    n = train.count()
    k = train.select(label).distinct().count()
    svm = LinearSVC(featuresCol="features", labelCol=label, regParam=1.0 / (C * n), maxIter=100)
    info = {"kernel": kernel}
    if kernel == "rbf":
        g = svc_gamma(train, features, gamma)
        info["gamma"] = g
        train = random_fourier_features(train, features, g, seed=seed, out="features")
        stages = []
    elif kernel == "linear":
        stages = [VectorAssembler(inputCols=features, outputCol="features")]
    else:
        raise ValueError(f"kernel {kernel} is not offered")
    est = OneVsRest(classifier=svm, featuresCol="features", labelCol=label) if k > 2 else svm
    return Pipeline(stages=stages + [est]).fit(train), info


def fit_random_forest_regressor(train, features, label, seed: int = 42, **params) -> PipelineModel:
    """M5."""
    rf = _rf_params(RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, numTrees=100), params)
    return fit_forest(train, features, rf)


def fit_gbt_regressor(train, features, label, seed: int = 42, max_iter: int = 100, max_depth: int = 3) -> PipelineModel:
    """M6: gradient-boosted trees (library defaults: 100 stages, depth 3)."""
    g = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, maxIter=max_iter, maxDepth=max_depth)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), g]).fit(train)


def fit_linear_regression(train, features, label) -> PipelineModel:
    """M7: ordinary least squares (normal equations)."""
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), lr]).fit(train)


# ------------------------------------------------------------------ grid search

def preset_grid(model_type: str, preset: str, n_rows: int) -> tuple:
    """Preset -> (estimator, ParamGridBuilder grid) for the Spark estimator."""
    p = get_preset_params(model_type, preset)
    if model_type in ("RandomForestClassifier", "RandomForestRegressor"):
        est = (RandomForestClassifier if model_type.endswith("Classifier") else RandomForestRegressor)(
            featuresCol="features", seed=42)
        g = ParamGridBuilder()
        g = g.addGrid(est.numTrees, p["n_estimators"])
        g = g.addGrid(est.maxDepth, [MAX_DEPTH_NONE if d is None else d for d in p["max_depth"]])
        g = g.addGrid(est.minInstancesPerNode, p["min_samples_leaf"])
        g = g.addGrid(est.featureSubsetStrategy,
                      [{"sqrt": "sqrt", "log2": "log2", None: "all"}[m] for m in p["max_features"]])
        return est, g.build()
    if model_type == "LogisticRegression":
        est = LogisticRegression(featuresCol="features", maxIter=max(p.get("max_iter", [100])))
        enet = [{"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}[x] for x in p["penalty"]]
        g = (ParamGridBuilder().addGrid(est.regParam, [1.0 / (c * n_rows) for c in p["C"]])
             .addGrid(est.elasticNetParam, enet).build())
        return est, g
    if model_type == "SVC":
        est = LinearSVC(featuresCol="features")
        g = ParamGridBuilder().addGrid(est.regParam, [1.0 / (c * n_rows) for c in p["C"]]).build()
        return est, g
    raise ValueError(f"no Spark grid for {model_type}")


def preset_grid_search(train: DataFrame, features: list[str], label: str, model_type: str,
                       preset: str = "Default", folds: int = 3, parallelism: int = 4,
                       task: str = "classification") -> tuple[object, DataFrame]:
    """M8: search a preset grid by k-fold CV (or a single 80/20 split when folds < 2).

    Returns (best pipeline model, table of (params, metric) per grid point)."""
    n = train.count()
    est, grid = preset_grid(model_type, preset, n)
    est.setLabelCol(label)
    if task == "classification":
        ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    else:
        ev = RegressionEvaluator(labelCol=label, metricName="rmse")
    data = VectorAssembler(inputCols=features, outputCol="features").transform(train)
    if folds >= 2:
        cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, seed=42,
                            parallelism=parallelism)
        model = cv.fit(data)
        metrics = model.avgMetrics
    else:
        tv = TrainValidationSplit(estimator=est, estimatorParamMaps=grid, evaluator=ev, trainRatio=0.8, seed=42,
                                  parallelism=parallelism)
        model = tv.fit(data)
        metrics = model.validationMetrics
    rows = [(", ".join(f"{k.name}={v}" for k, v in sorted(pm.items(), key=lambda kv: kv[0].name)), float(m))
            for pm, m in zip(grid, metrics)]
    table = train.sparkSession.createDataFrame(rows, f"params string, {ev.getMetricName()} double")
    return model.bestModel, table


def knn_grid_search(train: DataFrame, valid: DataFrame, id_col: str, label: str, features,
                    preset: str = "Default") -> DataFrame:
    """M4 presets: accuracy of every (k, weights, metric) on a validation split.

    One neighbour join per metric finds the most neighbours that any point asks for; all points of the
    grid vote on those in one aggregate."""
    from strata.operators.neighbors import knn
    p = get_preset_params("KNeighborsClassifier", preset)
    points = [(k, w, m) for k, w, m in itertools.product(p["n_neighbors"], p["weights"], p["metric"])]
    tables = []
    for m in p["metric"]:
        nb = knn(valid, train, id_col, id_col, features, max(p["n_neighbors"]), metric="euclidean" if m == "minkowski" else m, donor_label=label)
        grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w, x in points if x == m]))
        nb = nb.withColumn("__met", F.min("dist").over(Window.partitionBy(id_col)) == 0)  # exact matches take all the weight
        weight = F.when(F.col("w") == "uniform", 1.0).when(F.col("__met"), (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), "dist"))
        votes = nb.withColumn("g", grid).select(id_col, "label", "rank", "dist", "__met", "g.*").where("rank <= k").groupBy(id_col, "k", "w", "label").agg(F.sum(weight).alias("score"))
        pred = votes.groupBy(id_col, "k", "w").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("prediction"))
        tables.append(pred.join(valid.select(id_col, F.col(label).alias("__truth")), id_col).groupBy(F.col("k").alias("n_neighbors"), F.col("w").alias("weights"))
                      .agg(F.avg((F.col("prediction") == F.col("__truth")).cast("double")).alias("accuracy")).withColumn("metric", F.lit(m)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("n_neighbors", "weights", "metric", "accuracy")


# ------------------------------------------------------------------ forecasting features / model imputation

def forecast_features(df: DataFrame, date_col: str, target: str, partition_cols=()) -> tuple[DataFrame, list[str]]:
    """M12 features: date parts + lags [1,2,3,7,14,30] + rolling [7,14,30] stats, rows with nulls dropped."""
    from strata.functions.scalar import date_features
    from strata.operators.windows import lag_features, rolling_features
    f = date_features(df, date_col)
    f = lag_features(f, target, date_col, partition_cols=partition_cols)
    f = rolling_features(f, target, date_col, partition_cols=partition_cols)
    feats = ["year", "month", "day", "dayofweek", "quarter", "is_month_start", "is_month_end"]
    feats += [c for c in f.columns if c.startswith(f"{target}_lag_")]
    feats += [c for c in f.columns if c.startswith(f"{target}_rolling_")]
    return f.na.drop(subset=feats + [target]), feats


def forecast_ml_train(df: DataFrame, date_col: str, target: str, model_type: str = "random_forest",
                      partition_cols=(), **params) -> dict:
    """Fit RF / GBT / linear on the forecasting features; remembers the last date."""
    f, feats = forecast_features(df, date_col, target, partition_cols)
    if model_type == "random_forest":
        model = fit_random_forest_regressor(f, feats, target, **params)
    elif model_type == "gradient_boosting":
        model = fit_gbt_regressor(f, feats, target)
    else:
        model = fit_linear_regression(f, feats, target)
    last = df.agg(F.max(date_col)).first()[0]
    return {"model": model, "features": feats, "date_column": date_col, "target_column": target,
            "last_date": last, "model_type": model_type, "train_frame": f}


def impute_model(df: DataFrame, cols=None, num_trees: int = 50, seed: int = 42) -> DataFrame:
    """Per numeric column with nulls and > 10 known rows, a 50-tree random forest on the
    columns under 50 % null (median / mode pre-filled, text columns indexed) predicts the
    missing cells; otherwise the median. Text columns take their mode."""
    from pyspark.ml.feature import StringIndexer
    from strata.functions.stats import exact_quantiles, numeric_cols
    from strata.operators.profile import distinct_and_mode
    num = list(cols or numeric_cols(df, include_decimal=False))
    cat = [c for c, t in df.dtypes if t == "string"]
    n = df.count()
    miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in num + cat]).first().asDict()
    med = exact_quantiles(df, num, [0.5])
    modes = {r["column"]: r["most_frequent"] for r in distinct_and_mode(df, cat).collect()} if cat else {}
    usable = [c for c in num + cat if miss[c] / n < 0.5]
    pre = df
    for c in num:
        pre = pre.withColumn(f"__f_{c}", F.coalesce(F.col(c).cast("double"), F.lit(med[(c, 0.5)])))
    for c in cat:
        pre = pre.withColumn(f"__f_{c}", F.coalesce(F.col(c), F.lit(modes.get(c) or "Unknown")))
    idx = [StringIndexer(inputCol=f"__f_{c}", outputCol=f"__i_{c}", handleInvalid="keep") for c in cat if c in usable]
    if idx:
        pre = Pipeline(stages=idx).fit(pre).transform(pre)
    feat_of = {c: (f"__i_{c}" if c in cat else f"__f_{c}") for c in usable}
    out = pre
    for c in num:
        if miss[c] == 0:
            continue
        known = n - miss[c]
        feats = [feat_of[x] for x in usable if x != c]
        if known > 10 and feats:
            rf = RandomForestRegressor(featuresCol="__v", labelCol=c, numTrees=num_trees, seed=seed,
                                       predictionCol=f"__p_{c}")
            model = fit_forest(out.where(F.col(c).isNotNull()), feats, rf, known)
            out = model.transform(out).drop("__v")
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"__p_{c}"))).drop(f"__p_{c}")
        else:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(med[(c, 0.5)])))
    for c in cat:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(modes.get(c) or "Unknown")))
    return out.select(*df.columns)


# ------------------------------------------------------------------ persistence

def save_pipeline(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (shared filesystem path)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
