"""Model explanations as Spark jobs.

Attributions are a long frame (row_id, feature, value, attribution).

Shapley values (X2/X3) average the prediction over the whole background for each explained
row and coalition. Tree models need no pairs for that: a leaf counts for a coalition if the explained row
lies in the leaf's intervals of the coalition's features and the background row in the others, so the mass of
background rows per leaf and pattern of satisfied intervals, one grouped count, gives every
coalition's average, and each explained row costs one lookup per leaf. Other models: the background
is every row given (``max_background=None``) or a seeded sample, an explicit argument whose
result has a standard error per value. The coalitions are all 2^M subsets (``method="exact"``) or a seeded
sample of 2M + 2048 subsets solved by the Kernel SHAP weighted least squares
(``method="sampled"``); the caller chooses, the number of features does not. Per coalition only
the distinct values of its features among the explained rows meet the distinct values of the other
features in the background, with counts, in blocks of rows; one ``model.transform`` scores the
pairs, and per-row solves run in ``applyInPandas`` over that row's coalitions. The pairs grow with the
product of the two numbers of distinct values.
Tree models have their own path (``shap_tree``): closed Shapley values of every
leaf's product game, weighted by the training rows' covers, in one pass over the
explained rows - no coalitions, no background sample.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

GROUPS = 10  # parts of a sampled background, whose spread gives the standard errors
MOST_PATH = 14  # features on a leaf's path of the linear tree path
MOST_TABLE = 20_000_000  # entries of all leaves' tables, 160 MB
KEPT = 1 << 22  # attributions that a task keeps for further rows
BLOCK = 1000  # distinct values of each side that one key of the expansion pairs
EXACT_MAX_FEATURES = 16  # 2^16 coalitions a row; beyond it "exact" is refused


def _pred_col(pred: DataFrame, positive_class: int | None) -> F.Column:
    if positive_class is not None and "probability" in pred.columns:
        return vector_to_array("probability")[positive_class]
    return F.col("prediction").cast("double")


def _masks(M: int, seed: int, method: str = "exact") -> tuple[list[int], bool]:
    if method == "exact":
        if M > EXACT_MAX_FEATURES:
            raise ValueError(f"{M} features: ask for method='sampled'")
        return list(range(1 << M)), True
    if method != "sampled":
        raise ValueError("method is 'exact' or 'sampled'")
    if M < 2 or (1 << M) <= 2 * M + 2048:
        return list(range(1 << M)), True  # the sample would hold every subset
    rng = np.random.default_rng(seed)
    n = 2 * M + 2048
    sizes = np.arange(1, M)
    w = (M - 1) / (sizes * (M - sizes))
    w = w / w.sum()
    masks = {0, (1 << M) - 1}
    while len(masks) < n:
        k = int(rng.choice(sizes, p=w))
        idx = rng.choice(M, size=k, replace=False)
        masks.add(int(sum(1 << int(i) for i in idx)))
    return sorted(masks), False


def _on(j: int) -> F.Column:
    """Feature j belongs to the coalition."""
    return F.shiftright(F.col("__mask"), j).bitwiseAND(F.lit(1)) == 1


def _coalition_means(model, explain: DataFrame, background: DataFrame, id_col: str, features: list[str],
                     positive_class: int | None, masks: list[int], groups: int = 1) -> DataFrame:
    """(__rid, __mask, __g, s, n): sum of predictions over the background rows of each group, and their
    number, the coalition's features taken from the explained row."""
    checkpoint_dir(explain.sparkSession)
    every = F.explode(F.array(*[F.lit(m) for m in masks])).alias("__mask")
    as_double = [F.col(f).cast("double").alias(f) for f in features]
    own = [F.when(_on(j), F.col(f)).alias(f"__x_{f}") for j, f in enumerate(features)]
    other = [F.when(~_on(j), F.col(f)).alias(f"__y_{f}") for j, f in enumerate(features)]
    x_cols, y_cols = [f"__x_{f}" for f in features], [f"__y_{f}" for f in features]
    ex = explain.select(F.col(id_col).alias("__rid"), *as_double).dropDuplicates(["__rid"]).checkpoint()
    rows = ex.select("__rid", every, *features).select("__rid", "__mask", *own)
    left = rows.select("__mask", *x_cols).distinct().checkpoint()
    number = F.pmod(F.xxhash64(*([id_col] if id_col in background.columns else features), F.lit(1)), F.lit(groups)).alias("__g")
    bg = background.select(number, *as_double).groupBy("__g", *features).agg(F.count(F.lit(1)).alias("__n"))
    right = bg.select("__g", "__n", every, *features).select("__g", "__n", "__mask", *other).groupBy("__mask", "__g", *y_cols).agg(F.sum("__n").alias("__n")).checkpoint()
    n_left, n_right = (max(r["n"] for r in d.groupBy("__mask").agg(F.count(F.lit(1)).alias("n")).collect() or [{"n": 0}]) for d in (left, right))
    if not n_right:
        raise ValueError("empty background")
    blocks = lambda n: max(1, -(-n // BLOCK))
    bl, br = blocks(n_left), blocks(n_right)
    block = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n))
    tasks = min(len(masks) * bl * br, 4000)
    keys = ["__mask", "__i", "__j"]
    left = left.select("*", block(x_cols, bl).alias("__i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(br - 1).cast("long"))).alias("__j"))
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bl - 1).cast("long"))).alias("__i"), block(y_cols, br).alias("__j"))
    pairs = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
    pairs = pairs.select("__mask", "__g", "__n", *x_cols, *[F.when(_on(j), F.col(f"__x_{f}")).otherwise(F.col(f"__y_{f}")).alias(f) for j, f in enumerate(features)])
    pred = model.transform(pairs)
    means = pred.groupBy("__mask", "__g", *x_cols).agg(F.sum(_pred_col(pred, positive_class) * F.col("__n")).alias("s"), F.sum("__n").alias("n"))
    means = means.select(F.col("__mask").alias("__m"), "__g", "s", "n", *[F.col(c).alias(f"{c}_") for c in x_cols])
    same = F.col("__mask") == F.col("__m")
    for c in x_cols:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return rows.join(means, same).select("__rid", "__mask", "__g", "s", "n")


def coalition_counts(explain: DataFrame, background: DataFrame, id_col: str, features: list[str], seed: int = 42, method: str = "exact") -> DataFrame:
    """J6 over the whole background without its product: (id, mask, background_rows, patterns) per explained row and
    coalition, ``patterns`` being the distinct values that the background gives the features outside the
    coalition: the model inputs that really differ. One grouped count per coalition, joined on the coalition."""
    masks, _ = _masks(len(features), seed, method)
    every = F.explode(F.array(*[F.lit(m) for m in masks])).alias("__mask")
    other = [F.when(~_on(j), F.col(f)).alias(f) for j, f in enumerate(features)]
    bg = background.select(*[F.col(f).cast("double").alias(f) for f in features]).groupBy(*features).agg(F.count(F.lit(1)).alias("__n"))
    inputs = bg.select("__n", every, *features).select("__n", "__mask", *other).groupBy("__mask", *features).agg(F.sum("__n").alias("__n"))
    per = inputs.groupBy("__mask").agg(F.sum("__n").alias("background_rows"), F.count(F.lit(1)).alias("patterns"))  # a row per coalition
    return explain.select(F.col(id_col), every).join(F.broadcast(per), "__mask").withColumnRenamed("__mask", "mask").select(id_col, "mask", "background_rows", "patterns")


def coalition_expansion(explain: DataFrame, background: DataFrame, id_col: str, features: list[str],
                        max_background: int | None = None, seed: int = 42, method: str = "exact") -> DataFrame:
    """Every explained row x every coalition x every background row, as model inputs.

    Coalitions <= 2^16 (or 2M + 2048 sampled). With ``max_background`` the background is a seeded sample
    of so many rows, shipped as literal arrays and produced by ``explode``; without, every block of it
    meets every row, and ``__b`` is a unique number of the background row. The result is as large as that product;
    ``coalition_counts`` and ``shap_values`` don't make it."""
    from strata.operators.relational import seeded_sample
    M = len(features)
    if max_background is None:
        checkpoint_dir(explain.sparkSession)
        masks, _ = _masks(M, seed, method)
        bg = background.select(F.monotonically_increasing_id().alias("__b"), *[F.col(f).cast("double").alias(f"__b_{f}") for f in features]).checkpoint()
        if bg.isEmpty():
            raise ValueError("empty background")
        ex = explain.select(F.col(id_col).alias("__rid"), *[F.col(f).cast("double").alias(f) for f in features])
        ex = ex.select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("__mask"))
        parts = -(-bg.count() // BLOCK)
        ex = ex.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        ex = ex.join(bg.withColumn("__block", F.pmod(F.xxhash64("__b"), F.lit(parts)).cast("int")), "__block")
        return ex.select("__rid", "__mask", "__b", *[F.when(_on(j), F.col(f)).otherwise(F.col(f"__b_{f}")).alias(f) for j, f in enumerate(features)])
    bg_ids = [id_col] if id_col in background.columns else features
    bg = seeded_sample(background.select(*features, *([id_col] if id_col in background.columns else [])),
                       max_background, bg_ids, seed).collect()
    if not bg:
        raise ValueError("empty background")
    masks, _ = _masks(M, seed, method)
    bgv = {f: [float(r[f]) for r in bg] for f in features}
    ex = explain.select(F.col(id_col).alias("__rid"), *[F.col(f).cast("double").alias(f) for f in features])
    ex = ex.select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("__mask"))
    ex = ex.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(bg)))).alias("__b"))
    cols = []
    for j, f in enumerate(features):
        cols.append(F.when(_on(j), F.col(f)).otherwise(F.element_at(F.array(*[F.lit(v) for v in bgv[f]]),
                                                                  F.col("__b"))).alias(f))
    return ex.select("__rid", "__mask", "__b", *cols)


def shap_values(model, explain: DataFrame, background: DataFrame, id_col: str, features: list[str],
                positive_class: int | None = 1, max_background: int | None = None, seed: int = 42, method: str = "exact") -> DataFrame:
    """Shapley attributions against the whole background (or a seeded sample of ``max_background`` rows).

    Returns (id, feature, value, attribution, base_value, prediction); per row the attributions add up to
    prediction - base_value (efficiency). With a sample there is a column ``std_error`` of each attribution, from
    the spread between ``GROUPS`` parts of the sample. Tree ensembles on ``features`` take the linear path of
    ``shap_tree_background`` for ``method="exact"`` and the whole background."""
    M = len(features)
    masks, exact = _masks(M, seed, method)
    if max_background is None and exact and (leaves := _interventional(model, features, positive_class)) is not None:
        return _background_attributions(leaves, explain.dropDuplicates([id_col]), background, id_col, features, positive_class)
    groups = 1
    if max_background is not None:
        from strata.operators.relational import seeded_sample
        background = seeded_sample(background, max_background, [id_col] if id_col in background.columns else features, seed).checkpoint()
        groups = GROUPS
    v = _coalition_means(model, explain, background, id_col, features, positive_class, masks, groups)
    rtype = dict(explain.dtypes)[id_col]
    fact = [math.factorial(i) for i in range(M + 1)]

    def shapley(vals: dict[int, float]) -> np.ndarray:
        full, empty = vals[(1 << M) - 1], vals[0]
        phi = np.zeros(M)
        if exact:
            for S, vs in vals.items():
                k = bin(S).count("1")
                for j in range(M):
                    if not (S >> j) & 1:
                        phi[j] += fact[k] * fact[M - k - 1] / fact[M] * (vals[S | (1 << j)] - vs)
            return phi
        Z, y, w = [], [], []
        for S, vs in vals.items():
            k = bin(S).count("1")
            if 0 < k < M:
                Z.append([(S >> j) & 1 for j in range(M)])
                y.append(vs - empty)
                w.append((M - 1) / (math.comb(M, k) * k * (M - k)))
        Z, y, w = np.array(Z, float), np.array(y), np.array(w)
        # eliminate the last feature with the efficiency constraint sum(phi) = full - empty
        tot = full - empty
        Zr = Z[:, :-1] - Z[:, [-1]]
        yr = y - Z[:, -1] * tot
        W = np.sqrt(w)
        sol, *_ = np.linalg.lstsq(Zr * W[:, None], yr * W, rcond=None)
        phi[:-1] = sol
        phi[-1] = tot - sol.sum()
        return phi

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf.groupby("__mask")[["s", "n"]].sum()
        vals = dict(zip(whole.index.astype(np.int64), (whole["s"] / whole["n"]).astype(float)))
        phi = shapley(vals)
        rid = pdf["__rid"].iloc[0]
        out = pd.DataFrame({"__rid": [rid] * M, "feature": features, "attribution": phi, "base_value": [vals[0]] * M, "prediction": [vals[(1 << M) - 1]] * M})
        parts = [(g["n"].max(), shapley(dict(zip(g["__mask"].astype(np.int64), (g["s"] / g["n"]).astype(float))))) for _, g in pdf.groupby("__g")] if groups > 1 else []
        k, n = len(parts), sum(p for p, _ in parts)
        out["std_error"] = np.sqrt(sum((p / n * (f - phi)) ** 2 for p, f in parts) * k / (k - 1)) if k > 1 else np.full(M, np.nan)
        return out

    sh = v.groupBy("__rid").applyInPandas(
        solve, f"__rid {rtype}, feature string, attribution double, base_value double, prediction double, std_error double")
    vals = (explain.select(F.col(id_col).alias("__rid"), *[F.col(f).cast("double").alias(f) for f in features])
            .dropDuplicates(["__rid"]).unpivot("__rid", features, "feature", "value"))
    return sh.join(vals, ["__rid", "feature"]).withColumnRenamed("__rid", id_col).select(
        id_col, "feature", "value", "attribution", "base_value", "prediction", *(["std_error"] if groups > 1 else []))


def _leaves(tree, weight: float, classes: int) -> list[tuple]:
    """(values, {feature: (low, high, cover share)}) of every leaf; a row takes the left branch if
    its value is at most the threshold."""
    out = []

    def count(node):
        return float(node.impurityStats().count())

    def walk(node, bounds):
        if node.subtreeDepth() == 0:
            if classes:
                stats = np.array(list(node.impurityStats().stats()), dtype=float)
                values = stats / max(stats.sum(), 1e-300)
            else:
                values = np.array([float(node.prediction())])
            out.append((values * weight, bounds))
            return
        split = node.split()
        if not hasattr(split, "threshold") or "Categorical" in split.getClass().getSimpleName():
            raise ValueError("categorical splits are not supported")
        f, at, n = int(split.featureIndex()), float(split.threshold()), count(node)
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            low, high, share = bounds.get(f, (-math.inf, math.inf, 1.0))
            new = (low, min(high, at), share * count(child) / n) if left else (max(low, at), high, share * count(child) / n)
            walk(child, {**bounds, f: new})

    walk(tree._call_java("rootNode"), {})
    return out


def _leaf_table(shares: list[float]) -> np.ndarray:
    """Shapley values of the game v(S) = prod_{S} o_i * prod_{not S} share_i, for each pattern of o in
    {0, 1}: array (pattern, feature)."""
    m = len(shares)
    table = np.zeros((1 << m, m))
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    for pattern in range(1 << m):
        o = [float(pattern >> i & 1) for i in range(m)]
        for i in range(m):
            poly = np.array([1.0])  # sums of products by the size of S among the others
            for j in range(m):
                if j != i:
                    poly = np.convolve(poly, [shares[j], o[j]])
            table[pattern, i] = (o[i] - shares[i]) * sum(w * c for w, c in zip(weight, poly))
    return table


def shap_tree(model, explain: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """Exact path-dependent Shapley attributions of a tree ensemble, for every explained row.

    Per leaf the features on its path play a product game (inside the leaf's interval, or the share
    of training rows that go its way); its Shapley values are tabulated per pattern of satisfied
    intervals, so a row costs one lookup per leaf. Returns (id, feature, value, attribution,
    base_value, prediction) and, for classifiers, one set of rows per class with ``class``;
    attributions add up to prediction - base_value."""
    leaves, classes = _ensemble(model)
    base = sum(v * math.prod(b[2] for b in bounds.values()) for v, bounds in leaves)
    packed = [(v, [(f, lo, hi) for f, (lo, hi, _) in bounds.items()], _leaf_table([b[2] for b in bounds.values()])) for v, bounds in leaves]
    return _by_leaves(explain, packed, base, classes, id_col, features)


def _ensemble(model) -> tuple[list[tuple], int]:
    """(leaves, weighted by their tree; number of classes) of a tree ensemble."""
    forest = model.stages[-1] if hasattr(model, "stages") else model
    classes = int(getattr(forest, "numClasses", 0) or 0)
    trees = list(getattr(forest, "trees", [forest]))
    weights = list(forest.treeWeights) if hasattr(forest, "treeWeights") else [1.0]
    if type(forest).__name__.startswith("GBT"):
        if classes:
            raise ValueError("boosted classifiers add margins, not probabilities")
    else:
        weights = [1.0 / len(trees)] * len(trees)
    return [leaf for t, w in zip(trees, weights) for leaf in _leaves(t, float(w), classes)], classes


def _by_leaves(explain: DataFrame, packed: list[tuple], base, classes: int, id_col: str, features: list[str]) -> DataFrame:
    """Attributions as sums over leaves (values, path, table by pattern of satisfied intervals)."""
    shared = explain.sparkSession.sparkContext.broadcast((packed, base))  # as large as the model
    M, C = len(features), max(classes, 1)

    def attributions(x: np.ndarray, leaves_: list[tuple]) -> np.ndarray:
        phi = np.zeros((len(x), C, M))
        for values, path, table in leaves_ if len(x) else []:
            got = table[_patterns(x, path)]
            for i, (f, _, _) in enumerate(path):
                phi[:, :, f] += got[:, i, None] * values
        return phi

    def run(batches):
        leaves_, base_ = shared.value
        # rows between the same neighbouring thresholds of every feature lie in the same leaves' intervals
        cuts = [np.unique([e for _, path, _ in leaves_ for f, lo, hi in path if f == j for e in (lo, hi) if math.isfinite(e)]) for j in range(M)]
        known: dict = {}
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, M)
            new, first, of = np.unique(_cells(x, cuts), axis=0, return_index=True, return_inverse=True)
            names = list(map(tuple, new.tolist())) if new.ndim > 1 else new.tolist()
            fresh = [i for i, name in enumerate(names) if name not in known]
            own = attributions(x[first[fresh]], leaves_)
            if len(known) + len(fresh) > KEPT // (C * M):
                known.clear()  # those of this batch are made anew
                fresh, own = list(range(len(names))), attributions(x[first], leaves_)
            known.update(zip([names[i] for i in fresh], own, strict=True))
            phi = np.array([known[name] for name in names]).reshape(len(names), C, M)
            pred = (base_ + phi.sum(axis=2))[of.reshape(-1)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (v.size // max(len(x), 1))), pa.array(v.reshape(-1)))
                     for v in (phi[of.reshape(-1)], pred)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=[id_col, "__x", "__phi", "__pred"])

    kind = dict(explain.dtypes)[id_col]
    made = explain.select(id_col, F.array(*[F.col(f).cast("double") for f in features]).alias("__x")).mapInArrow(
        run, f"`{id_col}` {kind}, __x array<double>, __phi array<double>, __pred array<double>")
    literals = lambda values: F.array(*[F.lit(v) for v in values])
    k, j = F.expr(f"cast(pos div {M} as int)"), F.expr(f"pos % {M}")
    value = F.get("__x", j)
    out = made.select(id_col, "__x", "__pred", F.posexplode("__phi").alias("pos", "attribution")).select(
        id_col, k.alias("class"), F.get(literals(features), j).alias("feature"), F.when(~F.isnan(value), value).alias("value"), "attribution",
        F.get(literals(np.broadcast_to(base, C).astype(float).tolist()), k).alias("base_value"), F.get("__pred", k).alias("prediction"))
    return out if classes else out.drop("class")


def _cells(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A number per row, or a row of them, of the intervals (threshold, next threshold] that hold its values; what is no number is apart."""
    where = np.stack([np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], "left") + 1) for j, c in enumerate(cuts)], axis=1)
    sizes = [len(c) + 2 for c in cuts]
    return np.ravel_multi_index(where.T, sizes) if math.prod(sizes) < 1 << 62 else where


def _patterns(x: np.ndarray, path: list[tuple]) -> np.ndarray:
    """Bit i: the row lies in the path's interval i."""
    pattern = np.zeros(len(x), dtype=np.int64)
    for i, (f, lo, hi) in enumerate(path):
        pattern |= ((x[:, f] > lo) & (x[:, f] <= hi)).astype(np.int64) << i
    return pattern


def _interventional(model, features: list[str], positive_class: int | None):
    """(leaves, classes) if the model is a tree ensemble straight on ``features`` whose averages over the background
    are sums over leaves, and its tables are of bounded size."""
    stages = list(model.stages) if hasattr(model, "stages") else [model]
    forest = stages[-1]
    if not hasattr(forest, "toDebugString") or not hasattr(forest, "getFeaturesCol") or type(forest).__name__ == "GBTClassificationModel":
        return None
    for s in stages[:-1]:
        if type(s).__name__ != "VectorAssembler" or list(s.getInputCols()) != list(features):
            return None
    try:
        leaves, classes = _ensemble(model)
    except ValueError:  # categorical splits
        return None
    if classes and positive_class is None:
        return None  # a predicted label is no sum over leaves
    sizes = [len(b) for _, b in leaves]
    if max(sizes, default=0) > MOST_PATH or sum(m << m for m in sizes) > MOST_TABLE:
        return None
    return leaves, classes


def _masses(leaves: list[tuple], background: DataFrame, features: list[str]) -> list[np.ndarray]:
    """For every leaf the share of background rows with each pattern of satisfied intervals."""
    paths = [[(f, lo, hi) for f, (lo, hi, _) in bounds.items()] for _, bounds in leaves]
    shared = background.sparkSession.sparkContext.broadcast(paths)

    def count(frames):
        counts = [np.zeros(1 << len(p), dtype=np.int64) for p in shared.value]
        for pdf in frames:
            x = pdf[features].to_numpy(dtype=float)
            for c, path in zip(counts, shared.value, strict=True):
                c += np.bincount(_patterns(x, path), minlength=len(c))
        some = [(i, int(p), int(c[p])) for i, c in enumerate(counts) for p in np.flatnonzero(c)]
        yield pd.DataFrame(some, columns=["leaf", "pattern", "n"])

    rows = (background.select(*[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(count, "leaf int, pattern long, n long")
            .groupBy("leaf", "pattern").agg(F.sum("n").alias("n")).collect())  # at most the model's patterns
    mass = [np.zeros(1 << len(p)) for p in paths]
    for r in rows:
        mass[r["leaf"]][r["pattern"]] = r["n"]
    if not mass or not mass[0].sum():
        raise ValueError("empty background")
    return [m / m.sum() for m in mass]


def _over_bits(a: np.ndarray, up: bool) -> np.ndarray:
    """Sums over all supersets (``up``) or subsets of each pattern."""
    a = a.copy()
    n = len(a)
    for i in range(n.bit_length() - 1):
        b = a.reshape(n >> (i + 1), 2, 1 << i, *a.shape[1:])
        if up:
            b[:, 0] += b[:, 1]
        else:
            b[:, 1] += b[:, 0]
    return a


def _game_table(mass: np.ndarray) -> tuple[np.ndarray, float]:
    """(Shapley values by the explained row's pattern, value without any feature) of a leaf of value 1: the
    coalition S is worth the mass of rows in all intervals outside S, if the explained row is in those of S."""
    n = len(mass)
    m = n.bit_length() - 1
    inside = _over_bits(mass, True)  # rows in all intervals of a set
    sets = np.arange(n)
    size = np.array([bin(x).count("1") for x in range(n)])
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)] + [0.0])
    rest = inside[n - 1 - sets]
    c = np.stack([np.where(sets >> i & 1, weight[size - 1], -weight[size]) * rest for i in range(m)], axis=1) if m else np.zeros((1, 0))
    return _over_bits(c, False), float(inside[-1])


def _background_attributions(model: tuple, explain: DataFrame, background: DataFrame, id_col: str, features: list[str], positive_class: int | None) -> DataFrame:
    leaves, classes = model
    games = [_game_table(m) for m in _masses(leaves, background, features)]
    base = sum(v * g[1] for (v, _), g in zip(leaves, games, strict=True))
    packed = [(v, [(f, lo, hi) for f, (lo, hi, _) in bounds.items()], g[0]) for (v, bounds), g in zip(leaves, games, strict=True)]
    out = _by_leaves(explain, packed, base, classes, id_col, features)
    return out.where(F.col("class") == positive_class).drop("class") if classes else out


def shap_linear_classes(coefficients: np.ndarray, explain: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """X1 for every class of a linear model at once: (id, class, feature, value, attribution), from one
    aggregate of the means and one projection."""
    x = F.array(*[F.col(f).cast("double") if isinstance(f, str) else f for f in features])
    d = explain.select(id_col, x.alias("x"))
    m = d.agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(features))]).first()
    means = F.lit([float(a) for a in m])

    def cells_of(k: int):
        weights = F.lit([float(c) for c in coefficients[k]])
        return F.transform("x", lambda v, i: F.struct(F.lit(k).alias("class"), i.alias("i"), v.alias("value"),
                                                     (F.get(weights, i) * (v - F.get(means, i))).alias("attribution")))

    cells = F.explode(F.flatten(F.array(*[cells_of(k) for k in range(len(coefficients))])))
    names = F.lit([f if isinstance(f, str) else f"f{i}" for i, f in enumerate(features)])
    return d.select(id_col, cells.alias("c")).select(id_col, F.col("c.class").alias("class"), F.get(names, F.col("c.i")).alias("feature"),
                                                     F.col("c.value").alias("value"), F.col("c.attribution").alias("attribution"))


def shap_linear(coefs: dict[str, float], explain: DataFrame, background: DataFrame, id_col: str) -> DataFrame:
    """coef_j * (x_j - mean of background x_j); background means from one aggregate."""
    feats = list(coefs)
    means = background.agg(*[F.avg(f).alias(f) for f in feats]).first().asDict()
    long = explain.select(id_col, *feats).unpivot(id_col, feats, "feature", "value")
    c = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(f), F.lit(float(coefs[f]))) for f in feats)),
                     F.col("feature"))
    m = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(f), F.lit(float(means[f]))) for f in feats)),
                     F.col("feature"))
    return long.withColumn("attribution", c * (F.col("value") - m))


def lime_tabular(model, explain: DataFrame, training: DataFrame, id_col: str, features: list[str],
                 num_samples: int = 1000, num_features: int = 10, positive_class: int | None = 1,
                 kernel_width: float | None = None, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """LIME for tabular data with continuous features.

    Per explained row: ``num_samples`` perturbations drawn from N(mean, std) of the
    training data (seeded hash normals), weights exp(-d^2 / width^2) on the standardised
    distance to the row (width 0.75 sqrt(M)), a weighted ridge on standardised features;
    the top ``num_features`` coefficients by |value| are returned."""
    M = len(features)
    width = kernel_width or 0.75 * math.sqrt(M)
    st = training.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                      *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mu = {f: st[f"m_{f}"] for f in features}
    sd = {f: (st[f"s_{f}"] or 1.0) for f in features}
    ex = explain.select(F.col(id_col).alias("__rid"), *[F.col(f).cast("double").alias(f"x_{f}") for f in features])
    ex = ex.select("*", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))).alias("__s"))

    def normal(j):
        u1 = (F.abs(F.xxhash64(F.lit(seed), F.col("__rid"), F.col("__s"), F.lit(2 * j))) % 1000003 + 1) / 1000004.0
        u2 = (F.abs(F.xxhash64(F.lit(seed), F.col("__rid"), F.col("__s"), F.lit(2 * j + 1))) % 1000003) / 1000003.0
        return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)

    # sample 0 is the row itself (as LIME does)
    zs = {f: F.when(F.col("__s") == 0, (F.col(f"x_{f}") - mu[f]) / sd[f]).otherwise(normal(j))
          for j, f in enumerate(features)}
    pert = ex.select("__rid", "__s", *[zs[f].alias(f"z_{f}") for f in features],
                     *[(F.col(f"x_{f}") - mu[f]) / sd[f] for f in features])
    pert = pert.toDF("__rid", "__s", *[f"z_{f}" for f in features], *[f"xs_{f}" for f in features])
    d2 = sum(((F.col(f"z_{f}") - F.col(f"xs_{f}")) ** 2 for f in features), F.lit(0.0))
    pert = pert.withColumn("__w", F.exp(-d2 / (width * width)))
    scored_in = pert.select("__rid", "__s", "__w", *[f"z_{f}" for f in features],
                            *[(F.col(f"z_{f}") * sd[f] + mu[f]).alias(f) for f in features])
    pred = model.transform(scored_in)
    pr = pred.select("__rid", "__w", *[f"z_{f}" for f in features], _pred_col(pred, positive_class).alias("__y"))
    rtype = dict(ex.dtypes)["__rid"]

    # the normal equations of a row are sums over its samples, added up where these are made; a null makes them unknown
    nan = F.lit(float("nan"))
    cols = [F.lit(1.0), *[F.coalesce(f"z_{f}", nan) for f in features], F.coalesce(F.col("__y").cast("double"), nan)]
    w = F.coalesce("__w", nan)
    sums = pr.groupBy("__rid").agg(*[F.sum(w * (cols[i] * cols[j])).alias(f"a_{i}_{j}") for i in range(M + 1) for j in range(i, M + 2)])

    def ridge(batches):
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            A, y = np.empty((n, M + 1, M + 1)), np.stack([pdf[f"a_{i}_{M + 1}"].to_numpy(float) for i in range(M + 1)], axis=1)
            for i in range(M + 1):
                for j in range(i, M + 1):
                    A[:, i, j] = A[:, j, i] = pdf[f"a_{i}_{j}"].to_numpy(float)
            A += alpha * np.diag([0.0] + [1.0] * M)
            beta = np.linalg.solve(A, y[:, :, None])[:, :, 0]
            order = np.argsort(-np.abs(beta[:, 1:]), axis=1, kind="stable")[:, :num_features]
            yield pd.DataFrame({"__rid": pdf["__rid"].repeat(order.shape[1]).reset_index(drop=True), "feature": np.array(features, dtype=object)[order].ravel(),
                                "attribution": np.take_along_axis(beta[:, 1:], order, axis=1).ravel(), "intercept": beta[:, 0].repeat(order.shape[1])})

    return sums.mapInPandas(
        ridge, f"__rid {rtype}, feature string, attribution double, intercept double").withColumnRenamed(
        "__rid", id_col)


# ------------------------------------------------------------------ reporting

def mean_abs_importance(attr: DataFrame, group_cols=()) -> DataFrame:
    """Mean |attribution| per feature."""
    return attr.groupBy(*group_cols, "feature").agg(F.avg(F.abs("attribution")).alias("importance"))


def importance_table(attr: DataFrame, k: int = 10, class_name: str | None = None) -> DataFrame:
    """Top-k features by mean |attribution| (ties by name), with the class name."""
    imp = mean_abs_importance(attr)
    top = imp.orderBy(F.desc("importance"), "feature").limit(k)
    return top.withColumn("class_name", F.lit(class_name).cast("string"))


def attribution_histogram(attr: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins of attribution values between min and max."""
    r = attr.agg(F.min("attribution").alias("lo"), F.max("attribution").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    width = (hi - lo) / bins if hi is not None and hi > lo else 1.0
    b = F.least(F.floor((F.col("attribution") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (attr.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_start"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_end"), "count"))


def combine_multiclass(attr: DataFrame, id_col: str, method: str = "mean_abs",
                       predicted_class: int | None = None) -> DataFrame:
    """Attributions per (row, class, feature) -> one class view: 'individual' (the given
    class), 'mean_abs' (mean |value| over classes), 'max_importance' (the class with the
    largest total |value|, smallest class on ties)."""
    if method == "individual":
        return attr.where(F.col("class") == F.lit(predicted_class)).drop("class")
    if method == "mean_abs":
        return attr.groupBy(id_col, "feature").agg(F.avg(F.abs("attribution")).alias("attribution"))
    tot = attr.groupBy("class").agg(F.sum(F.abs("attribution")).alias("t"))
    best = tot.agg(F.min_by("class", F.struct(-F.col("t"), F.col("class")))).first()[0]
    return attr.where(F.col("class") == F.lit(best)).drop("class").withColumn("class", F.lit(best))


def attribution_scatter_data(attr: DataFrame) -> DataFrame:
    """(feature, feature_value, attribution) rows."""
    return attr.select("feature", F.col("value").alias("feature_value"), "attribution")


def batch_explain(fn, batches: list[DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """Run ``fn(frame)`` per batch with its index; failures are isolated per batch.
    Returns (union of attributions with batch_id, status table). Each batch's attributions are
    checkpointed: computed once, kept when executors are lost, and held by no cache."""
    from strata.session import checkpoint_dir
    spark = batches[0].sparkSession
    checkpoint_dir(spark)
    out, status = None, []
    for i, b in enumerate(batches):
        try:
            r = fn(b).withColumn("batch_id", F.lit(i)).checkpoint()
            out = r if out is None else out.unionByName(r)
            status.append((i, "success", r.count(), None))
        except Exception as e:  # noqa: BLE001
            status.append((i, "failed", 0, str(e)[:200]))
    return out, spark.createDataFrame(status, "batch_id int, status string, rows long, error string")


def explanation_report(attr: DataFrame, method: str = "shap", n_failed: int = 0) -> DataFrame:
    """Status, top 5 and top 10 features by mean |attribution|, counts, advice."""
    imp = mean_abs_importance(attr)
    ranked = imp.agg(F.sort_array(F.collect_list(F.struct(-F.col("importance"), F.col("feature")))).alias("r"),
                     F.count(F.lit(1)).alias("nf"))
    n_rows = attr.select(attr.columns[0]).distinct().count()
    feats = F.transform("r", lambda s: s.getField("feature"))
    top1 = F.element_at(feats, 1)
    advice = F.array(F.concat(F.lit("focus_on_feature:"), top1))
    if method == "shap":
        advice = F.concat(advice, F.array(F.lit("consider_tree_explainer_for_tree_models"),
                                          F.lit("validate_with_domain_knowledge")))
    if n_failed > 0:
        advice = F.concat(advice, F.array(F.lit("check_input_and_model_compatibility"),
                                          F.lit("improve_preprocessing")))
    return ranked.select(F.when(F.col("nf") > 0, "success").otherwise("failed").alias("status"),
                         F.lit(method).alias("method"), F.slice(feats, 1, 5).alias("top_5"),
                         F.slice(feats, 1, 10).alias("top_10"), F.lit(n_rows).alias("explained_ok"),
                         F.lit(n_failed).alias("explained_failed"), advice.alias("advice"))
