"""Class balancing (B1-B9): random over/under sampling, SMOTE family, cleaning, report.

Randomness is a seeded integer hash of the row id, so results are stable
under any partitioning and reproducible in SQL. Per-class ranks use the
distributed prefix count (no per-class window: one class may hold most rows),
draws with replacement come from ``spark.range`` (so a large deficit is
spread over tasks), and neighbour searches use the exact blocked kNN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.stats import seeded_hash
from strata.operators.neighbors import knn
from strata.operators.ranks import prefix_count
from strata.session import checkpoint_dir


def class_counts(df: DataFrame, label: str) -> list[tuple]:
    """(class, count) sorted by class: one row per class reaches the driver."""
    return [(r[0], r[1]) for r in df.groupBy(label).count().orderBy(label).collect()]


def _class_ranks(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """0-based rank of each row inside its class in seeded-hash order (distributed)."""
    h = df.withColumn("__h", seeded_hash(F.col(id_col), seed))
    pos = prefix_count(h, [label, "__h", id_col], out="__pos")
    start = pos.groupBy(label).agg(F.min("__pos").alias("__start"))
    return pos.join(start, label).withColumn("__rank", F.col("__pos") - F.col("__start")).drop(
        "__pos", "__start", "__h")


def _draws(spark, needs: dict, seed: int, salt: int) -> DataFrame:
    """One row per draw: (class, j, draw number, u) where u is a seeded hash; generated by spark.range.

    ``needs`` is {class: number of draws} (one entry per class)."""
    items = [(c, n) for c, n in needs.items() if n > 0]
    total = sum(n for _, n in items)
    if total == 0:
        return None
    r = spark.range(total)
    cls, start, off = None, 0, None
    for c, n in items:
        cond = F.col("id") < start + n
        cls = F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c))
        off = F.when(cond, F.lit(start)) if off is None else off.when(cond, F.lit(start))
        start += n
    return r.select(cls.alias("__cls"), (F.col("id") - off).alias("__j"), F.col("id").alias("__draw"),
                    seeded_hash(F.col("id"), seed, salt).alias("__u"))


def balance_random_over(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """B1: the minority class is resampled with replacement up to the majority count."""
    counts = class_counts(df, label)
    mx = max(n for _, n in counts)
    mn_cls = min(counts, key=lambda t: t[1])[0]  # first (smallest) class on ties
    nmin = dict(counts)[mn_cls]
    draws = _draws(df.sparkSession, {mn_cls: mx - nmin}, seed, 1)
    if draws is None:
        return df.withColumn("synthetic", F.lit(False))
    ranked = _class_ranks(df.where(F.col(label) == F.lit(mn_cls)), label, id_col, seed)
    picks = draws.select(F.pmod(F.col("__u"), F.lit(nmin)).alias("__rank"), "__j")
    extra = (picks.join(ranked, "__rank").select(*df.columns).withColumn("synthetic", F.lit(True)))
    return df.withColumn("synthetic", F.lit(False)).unionByName(extra)


def balance_random_under(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """B2: the majority class keeps its first n_min rows in seeded-hash order."""
    counts = class_counts(df, label)
    mj_cls = max(counts, key=lambda t: t[1])[0]  # first (smallest) class on ties
    nmin = min(n for _, n in counts)
    ranked = _class_ranks(df.where(F.col(label) == F.lit(mj_cls)), label, id_col, seed)
    keep = ranked.where(F.col("__rank") < nmin).select(*df.columns)
    return df.where(F.col(label) != F.lit(mj_cls)).unionByName(keep)


def _smote_from(base: DataFrame, minority: DataFrame, label: str, id_col: str, features: list[str], k: int,
                needs_per_row: DataFrame | None, n_new: int, seed: int, cls) -> DataFrame:
    """Synthetic rows x + u (nb - x) with their draw: base rows drawn uniformly (or by per-row
    quotas); base row, neighbour and u come from hashes of the draw with a salt each, so they
    are independent."""
    spark = base.sparkSession
    nb = knn(base, minority, id_col, id_col, features, k, exclude_self=True)
    kk = nb.groupBy(id_col).agg(F.max("rank").alias("__k"))
    if needs_per_row is None:
        nbase = base.count()
        ranked = _class_ranks(base, label, id_col, seed)
        draws = _draws(spark, {cls: n_new}, seed, 2)
        if draws is None:
            return None
        picked = (draws.select(F.pmod("__u", F.lit(nbase)).alias("__rank"), F.col("__draw").cast("string").alias("__draw"))
                  .join(ranked.select("__rank", id_col, *features), "__rank"))
    else:
        picked = (needs_per_row.where(F.col("__g") > 0)
                  .select(id_col, F.explode(F.sequence(F.lit(0), F.col("__g") - 1)).alias("__j"))
                  .withColumn("__draw", F.concat_ws("/", F.col(id_col).cast("string"), F.col("__j").cast("string")))
                  .join(base.select(id_col, *features), id_col))
    picked = picked.join(kk, id_col).withColumn("__nr", F.pmod(seeded_hash(F.col("__draw"), seed, 3), F.col("__k")) + 1)
    nbv = nb.select(F.col(id_col), F.col("rank").alias("__nr"), F.col("nid"))
    feats_n = minority.select(F.col(id_col).alias("nid"), *[F.col(c).alias(f"__n_{c}") for c in features])
    j = picked.join(nbv, [id_col, "__nr"]).join(feats_n, "nid")
    u = seeded_hash(F.col("__draw"), seed, 4) / F.lit(float(1 << 60))
    return j.select("__draw", *[(F.col(c) + u * (F.col(f"__n_{c}") - F.col(c))).alias(c) for c in features],
                    F.lit(cls).alias(label))


def balance_smote(df: DataFrame, label: str, id_col: str, features: list[str], k: int = 5,
                  seed: int = 42, synthetic_ids: bool = False) -> DataFrame:
    """SMOTE on the minority class up to the majority count. Synthetic rows have a null id, or
    with ``synthetic_ids`` the largest id plus one plus the number of their draw."""
    counts = class_counts(df, label)
    mx = max(n for _, n in counts)
    mn_cls, nmin = min(counts, key=lambda t: t[1])
    mino = df.where(F.col(label) == F.lit(mn_cls))
    syn = _smote_from(mino, mino, label, id_col, features, min(k, nmin - 1), None, mx - nmin, seed, mn_cls)
    base = df.select(id_col, *features, label).withColumn("synthetic", F.lit(False))
    if syn is None:
        return base
    new_id = F.lit(None)
    if synthetic_ids:
        new_id = F.lit((df.agg(F.max(id_col)).first()[0] or 0) + 1) + F.col("__draw").cast("long")
    return base.unionByName(syn.select(new_id.cast(dict(df.dtypes)[id_col]).alias(id_col), *features, label,
                                       F.lit(True).alias("synthetic")))


def _neighbour_class_share(df, label, id_col, features, m, cls):
    """For rows of class ``cls``: how many of their m nearest neighbours (all classes) are of another class."""
    mino = df.where(F.col(label) == F.lit(cls))
    nb = knn(mino, df, id_col, id_col, features, m, exclude_self=True, donor_label=label)
    return nb.groupBy(id_col).agg(F.count_if(F.col("label") != F.lit(cls)).alias("__other"),
                                  F.count(F.lit(1)).alias("__m"))


def balance_adasyn(df: DataFrame, label: str, id_col: str, features: list[str], k: int = 5,
                   seed: int = 42) -> DataFrame:
    """ADASYN: each minority row gets synthetics in proportion to the share of
    other-class rows among its k neighbours (rounded quotas of the total deficit)."""
    counts = class_counts(df, label)
    mx = max(n for _, n in counts)
    mn_cls, nmin = min(counts, key=lambda t: t[1])
    G = mx - nmin
    share = _neighbour_class_share(df, label, id_col, features, k, mn_cls)
    tot = share.agg(F.sum(F.col("__other") / F.col("__m"))).first()[0] or 0.0
    base = df.select(id_col, *features, label).withColumn("synthetic", F.lit(False))
    if tot == 0:
        return base
    quotas = share.select(id_col, F.round(F.col("__other") / F.col("__m") / F.lit(tot) * G).cast("int").alias("__g"))
    mino = df.where(F.col(label) == F.lit(mn_cls))
    syn = _smote_from(mino, mino, label, id_col, features, min(k, nmin - 1), quotas, 0, seed, mn_cls)
    return base.unionByName(syn.select(F.lit(None).cast(dict(df.dtypes)[id_col]).alias(id_col), *features, label,
                                       F.lit(True).alias("synthetic")))


def balance_borderline_smote(df: DataFrame, label: str, id_col: str, features: list[str], k: int = 5,
                             m: int = 10, seed: int = 42) -> DataFrame:
    """SMOTE from minority rows "in danger": m/2 <= other-class neighbours < m (of m = 10)."""
    counts = class_counts(df, label)
    mx = max(n for _, n in counts)
    mn_cls, nmin = min(counts, key=lambda t: t[1])
    share = _neighbour_class_share(df, label, id_col, features, m, mn_cls)
    danger = share.where((F.col("__other") >= F.col("__m") / 2) & (F.col("__other") < F.col("__m"))).select(id_col)
    mino = df.where(F.col(label) == F.lit(mn_cls))
    base_rows = mino.join(danger, id_col, "left_semi")
    out = df.select(id_col, *features, label).withColumn("synthetic", F.lit(False))
    if base_rows.limit(1).count() == 0:
        return out
    syn = _smote_from(base_rows, mino, label, id_col, features, min(k, nmin - 1), None, mx - nmin, seed, mn_cls)
    return out.unionByName(syn.select(F.lit(None).cast(dict(df.dtypes)[id_col]).alias(id_col), *features, label,
                                      F.lit(True).alias("synthetic")))


def _smote_once(df, label, id_col, features, seed):
    """SMOTE's rows, materialised once: cleaning reads them several times and refers to their ids."""
    checkpoint_dir(df.sparkSession)
    return balance_smote(df, label, id_col, features, seed=seed, synthetic_ids=True).checkpoint()


def edited_nearest_neighbours(df: DataFrame, label: str, id_col: str, features: list[str], k: int = 3) -> DataFrame:
    """ENN cleaning: drop rows where any of the k nearest neighbours has another class."""
    nb = knn(df, df, id_col, id_col, features, k, exclude_self=True, donor_label=label)
    own = df.select(id_col, F.col(label).alias("__own"))
    bad = (nb.join(own, id_col).where(F.col("label") != F.col("__own")).select(id_col).distinct())
    return df.join(bad, id_col, "left_anti")


def tomek_links_removed(df: DataFrame, label: str, id_col: str, features: list[str]) -> DataFrame:
    """Drop both rows of every Tomek link: mutual nearest neighbours with different classes."""
    nb = knn(df, df, id_col, id_col, features, 1, exclude_self=True, donor_label=label)
    a = nb.select(F.col(id_col).alias("__a"), F.col("nid").alias("__b"), F.col("label").alias("__lb"))
    b = nb.select(F.col(id_col).alias("__b"), F.col("nid").alias("__a"))
    own = df.select(F.col(id_col).alias("__a"), F.col(label).alias("__la"))
    links = a.join(b, ["__a", "__b"]).join(own, "__a").where(F.col("__la") != F.col("__lb")).select(
        F.col("__a").alias(id_col))
    return df.join(links, id_col, "left_anti")


def balance_smote_enn(df, label, id_col, features, seed: int = 42):
    """SMOTE then ENN (k = 3) over all classes."""
    s = _smote_once(df, label, id_col, features, seed)
    return edited_nearest_neighbours(s, label, id_col, features, 3)


def balance_smote_tomek(df, label, id_col, features, seed: int = 42):
    """SMOTE then removal of Tomek links."""
    s = _smote_once(df, label, id_col, features, seed)
    return tomek_links_removed(s, label, id_col, features)


# Method aliases accepted by the balancing entry point.
METHOD_ALIASES = {"over": "smote", "under": "rus", "combine": "smoteenn", "hybrid": "smotetomek"}


def choose_balancing(ratio: float) -> str:
    """B8 rule: ratio > 10 smote, > 5 borderline_smote, > 3 ros, else none."""
    if ratio > 10:
        return "smote"
    if ratio > 5:
        return "borderline_smote"
    if ratio > 3:
        return "ros"
    return "none"


def balance(df: DataFrame, label: str, id_col: str, features: list[str], method: str = "auto",
            seed: int = 42) -> tuple[str, DataFrame]:
    """Balancing dispatcher."""
    method = METHOD_ALIASES.get(method, method)
    if method == "auto":
        counts = class_counts(df, label)
        ratio = max(n for _, n in counts) / min(n for _, n in counts)
        method = choose_balancing(ratio)
    sel = df.select(id_col, *features, label)
    if method == "none":
        return method, sel
    fn = {"ros": lambda: balance_random_over(sel, label, id_col, seed),
          "rus": lambda: balance_random_under(sel, label, id_col, seed),
          "smote": lambda: balance_smote(sel, label, id_col, features, seed=seed),
          "adasyn": lambda: balance_adasyn(sel, label, id_col, features, seed=seed),
          "borderline_smote": lambda: balance_borderline_smote(sel, label, id_col, features, seed=seed),
          "smoteenn": lambda: balance_smote_enn(sel, label, id_col, features, seed),
          "smotetomek": lambda: balance_smote_tomek(sel, label, id_col, features, seed)}[method]
    return method, fn()


def balance_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Per class counts before/after, with both ratios, the improvement, the sample
    change and the advice repeated on each row."""
    def dist(d, tag):
        return d.groupBy(label).agg(F.count(F.lit(1)).alias(f"n_{tag}"))
    j = dist(before, "before").join(dist(after, "after"), label, "full")
    tot = j.agg(F.sum("n_before").alias("rows_before"), F.sum("n_after").alias("rows_after"),
                (F.max("n_before") / F.min("n_before")).alias("ratio_before"),
                (F.max("n_after") / F.min("n_after")).alias("ratio_after")).withColumn("__k", F.lit(1))
    advice = (F.when(F.col("ratio_after") > 5, F.array(F.lit("severe_imbalance"), F.lit("ensemble_methods"),
                                                       F.lit("cost_sensitive")))
              .when(F.col("ratio_after") > 3, F.array(F.lit("moderate_imbalance"), F.lit("threshold_tuning")))
              .otherwise(F.array(F.lit("slight_imbalance"))))
    # one row per class joined to the one-row totals on a constant key (both sides bounded by classes)
    return j.withColumn("__k", F.lit(1)).join(F.broadcast(tot), "__k").select(
        F.col(label).cast("string").alias("class"), "n_before", "n_after", "ratio_before", "ratio_after",
        (F.col("ratio_before") - F.col("ratio_after")).alias("improvement"),
        (F.col("rows_after") - F.col("rows_before")).alias("samples_change"), advice.alias("advice"))
