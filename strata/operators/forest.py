"""Regression forests on many rows (M5, I5, X3): rows are read once, trees are grown from sums per bin.

Spark's forest reads every row once per level and tree. Its splits lie between at most ``maxBins`` bins of a
feature, so rows in the same bins of all features never part, and a tree depends on them only through their drawn number, sum and
sum of squares of labels. One pass draws every row's bootstrap counts for every tree and adds up these sums per tree and cell of
bins; ``RandomForestRegressor`` then grows each tree from its weighted cells, as two rows of the cell's mean and deviation.

A forest of few rows, or of so many features that cells do not stay few whatever the rows (``MOST_SUMS``), is Spark's own.
"""

from __future__ import annotations

import math
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

FEW_ROWS = 1_000_000  # Spark's own passes take less time
MOST_SUMS = 1 << 23  # trees x cells, 24 bytes each in a task
SAMPLE_ROWS = 10_000  # for the bins, as in Spark's forest
BLOCK = 1 << 17
FITS = 8  # trees grown at the same time


def fit_forest(train: DataFrame, features: list[str], rf: RandomForestRegressor, rows: int | None = None) -> PipelineModel:
    """``VectorAssembler`` and the forest ``rf`` (its featuresCol and labelCol set) fitted on all rows."""
    va = VectorAssembler(inputCols=features, outputCol=rf.getFeaturesCol())
    n = train.count() if rows is None else rows
    plain = n < FEW_ROWS or rf.getMinInstancesPerNode() > 1 or rf.getSubsamplingRate() < 1 or not rf.getBootstrap() or rf.getNumTrees() < 2 or rf.isDefined(rf.weightCol)
    points = None if plain else _points(train, features, rf.getMaxBins(), n, rf.getSeed())
    if points is None or rf.getNumTrees() * math.prod(len(p) for p in points) > MOST_SUMS:
        return Pipeline(stages=[va, rf]).fit(train)
    return PipelineModel([va, _grown(_sums(train, features, points, rf), train, features, points, va, rf)])


def _points(train: DataFrame, features: list[str], bins: int, n: int, seed: int) -> list[np.ndarray] | None:
    """Each feature's values that stand for its bins, ascending: its categories, else the values themselves or quantiles in a
    sample. A row's bin is the nearest value's; the splits that Spark puts between them are the bins' edges."""
    some = train.select(*[F.col(f).cast("double").alias(f) for f in features]).sample(min(1.0, SAMPLE_ROWS / n), seed).toPandas()
    out = []
    for f in features:
        attr = train.schema[f].metadata.get("ml_attr", {})
        if attr.get("type") == "nominal":
            if "vals" not in attr:
                return None
            out.append(np.arange(len(attr["vals"]), dtype=float))
            continue
        v = np.sort(some[f].to_numpy(dtype=float))
        each = np.unique(v)
        if len(each) > bins:
            each = np.unique(v[((np.arange(bins) + 0.5) * len(v) / bins).astype(np.int64)])
        if not len(each) or not np.isfinite(each).all():
            return None
        out.append(each)
    return out


def _sums(train: DataFrame, features: list[str], points: list[np.ndarray], rf: RandomForestRegressor) -> DataFrame:
    """(tree, cell, w, s, q): number of draws, sum and sum of squares of the labels drawn, less their rough mean."""
    trees, seed, sizes = rf.getNumTrees(), rf.getSeed() & 0x7FFFFFFF, [len(p) for p in points]
    edges, cells = [(p[:-1] + p[1:]) / 2 for p in points], math.prod(sizes)
    label = F.col(rf.getLabelCol()).cast("double").alias("__y")

    def add(batches):
        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        w, s, q = (np.zeros((trees, cells)) for _ in range(3))

        def block(tables) -> None:
            t = pa.Table.from_batches(tables)
            x = [t[f].to_numpy().astype(float) for f in [*features, "__y"]]
            if any(c.null_count for c in t.columns) or not all(np.isfinite(v).all() for v in x):
                raise ValueError("null, NaN or infinite value in a forest's features or label")
            cell, y = np.zeros(len(x[0]), np.int64), x[-1]
            for v, at, size in zip(x, edges, sizes, strict=False):
                cell = cell * size + np.searchsorted(at, v, "left")  # up to a split goes to its left
            for k in range(trees):  # Poisson(1) draws of each row: a Poisson number of draws among the rows
                i = draw.integers(0, len(y), draw.poisson(len(y)))
                c, z = cell[i], y[i]
                w[k] += np.bincount(c, minlength=cells)
                s[k] += np.bincount(c, z, minlength=cells)
                q[k] += np.bincount(c, z * z, minlength=cells)

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK:
                block(held)
                held, size = [], 0
        if size:
            block(held)
        for k in range(trees):
            c = np.flatnonzero(w[k])
            yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(c), k, np.int32)), "cell": pa.array(c.astype(np.int32)),
                                              "w": pa.array(w[k][c]), "s": pa.array(s[k][c]), "q": pa.array(q[k][c])})

    each = train.select(*[F.col(f).cast("double").alias(f) for f in features], label)
    sums = each.mapInArrow(add, "tree int, cell int, w double, s double, q double").groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in "wsq"])
    mean = F.col("s") / F.col("w")
    dev = F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0)))
    return sums.withColumn("label", F.explode(F.array(mean - dev, mean + dev))).select("tree", "cell", (F.col("w") / 2).alias("weight"), "label")


def _grown(sums: DataFrame, train: DataFrame, features: list[str], points: list[np.ndarray], va: VectorAssembler, rf: RandomForestRegressor) -> RandomForestRegressionModel:
    spark, trees, step = train.sparkSession, rf.getNumTrees(), 1
    path = os.path.join(checkpoint_dir(spark), "forests", uuid.uuid4().hex)
    columns = []
    for f, p in reversed(list(zip(features, points, strict=True))):
        at = F.expr(f"cast(cell div {step} % {len(p)} as int)")
        columns.append(F.get(F.array(*[F.lit(float(v)) for v in p]), at).alias(f))
        step *= len(p)
    # in order, so that the sums within a tree's fit do not depend on the shuffle
    sums.select("tree", "cell", *columns, F.col("label").alias(rf.getLabelCol()), "weight").repartition(trees, "tree").sortWithinPartitions(
        "tree", "cell", "label").write.partitionBy("tree").parquet(path)
    kinds = spark.read.parquet(path).schema
    rows = 2 * step
    one = rf.copy({rf.numTrees: 1, rf.bootstrap: False, rf.weightCol: "weight", rf.maxBins: max(rf.getMaxBins(), math.isqrt(rows) + 1),
                   rf.featureSubsetStrategy: "onethird" if rf.getFeatureSubsetStrategy() == "auto" else rf.getFeatureSubsetStrategy()})

    # far apart: java.util.Random begins alike for neighbouring seeds, and trees would draw the same features
    seeds = np.random.default_rng(rf.getSeed() & 0x7FFFFFFF).integers(1 << 62, size=trees).tolist()

    def grow(tree: int):
        d = spark.read.schema(kinds).parquet(os.path.join(path, f"tree={tree}"))
        named = [F.col(f).alias(f, metadata=train.schema[f].metadata) for f in features]
        return one.copy({one.seed: seeds[tree]}).fit(va.transform(d.select(*named, rf.getLabelCol(), "weight")))

    with ThreadPoolExecutor(FITS) as pool:
        grown = list(pool.map(grow, range(trees)))
    jvm = spark.sparkContext._jvm.org.apache.spark.ml.regression
    array = spark.sparkContext._gateway.new_array(jvm.DecisionTreeRegressionModel, trees)
    for i, m in enumerate(grown):
        array[i] = m._java_obj.trees()[0]
    model = RandomForestRegressionModel(jvm.RandomForestRegressionModel(rf.uid, array, len(features)))
    return rf._copyValues(model)
