"""Exact global ranks without a single-partition window.

``Window.orderBy(x)`` without ``partitionBy`` moves every row into one task.
Instead: range-partition and sort, checkpoint (so the partition boundaries
are fixed for both passes), count rows per partition (one row per
partition reaches the driver), and add the preceding partitions' counts to a
local prefix sum computed in ``mapInPandas``. Every task holds one range
partition; the driver holds only the per-partition counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import checkpoint_dir


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def prefix_count(df: DataFrame, order_cols: list[str], weight_col: str | None = None,
                 out: str = "__cum", num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = running sum of ``weight_col`` (or 1) in ``order_cols`` order, inclusive.

    With weight 1 this is the 1-based global row position (a distributed row_number).
    ``order_cols`` must make the order total for results to be deterministic.
    """
    checkpoint_dir(df.sparkSession)
    p = num_partitions or _partitions(df)
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    s = (df.withColumn("__w", w).repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("__pid", F.spark_partition_id()))
    s = s.checkpoint(eager=True)
    counts = {r["__pid"]: r["s"] for r in s.groupBy("__pid").agg(F.sum("__w").alias("s")).collect()}
    offsets, run = {}, 0
    for pid in sorted(counts):
        offsets[pid] = run
        run += counts[pid] or 0
    schema = T.StructType(s.schema.fields + [T.StructField(out, T.LongType())])

    # batches of one partition arrive in order within a task: carry a per-task running sum
    def run_sum(it):
        carry = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            pid = int(pdf["__pid"].iloc[0])
            base = carry.get(pid, offsets.get(pid, 0))
            cs = np.cumsum(pdf["__w"].to_numpy(dtype=np.int64)) + base
            carry[pid] = int(cs[-1])
            pdf[out] = cs
            yield pdf
    res = s.mapInPandas(run_sum, schema)
    return res.drop("__w", "__pid")


def count_in_ranges(points: DataFrame, value_col: str, lo_col: str, hi_col: str, id_col: str,
                    data: DataFrame | None = None, data_value_col: str | None = None,
                    data_id_col: str | None = None) -> DataFrame:
    """For each point, how many data values v satisfy lo <= v <= hi (exact, distributed).

    Data values and both thresholds of every point are sorted together: a lower
    threshold sorts before equal data values, an upper one after them, so the number
    of data values below a threshold is the running data count at its position.
    Returns (id_col, count).
    """
    data = data if data is not None else points
    dv = data_value_col or value_col
    # __u makes every sort key unique, so even one value held by a third of all rows
    # is split across range partitions instead of landing in one task
    did = data_id_col or (id_col if data is points or id_col in data.columns else None)
    # a deterministic unique tie-breaker (the row id) keeps re-executed tasks identical;
    # without an id the generated one is used
    u = F.xxhash64(F.col(did)) if did else F.monotonically_increasing_id()
    d = data.select(F.col(dv).cast("double").alias("__v"), F.lit(1).alias("__tag"),
                    F.lit(None).cast(dict(points.dtypes)[id_col]).alias("__id"), F.lit(1).alias("__isdata"),
                    u.alias("__u"))
    lo = points.select(F.col(lo_col).cast("double").alias("__v"), F.lit(0).alias("__tag"),
                       F.col(id_col).alias("__id"), F.lit(0).alias("__isdata"), F.xxhash64(id_col).alias("__u"))
    hi = points.select(F.col(hi_col).cast("double").alias("__v"), F.lit(2).alias("__tag"),
                       F.col(id_col).alias("__id"), F.lit(0).alias("__isdata"), F.xxhash64(id_col).alias("__u"))
    allr = d.unionByName(lo).unionByName(hi).where(F.col("__v").isNotNull())
    cum = prefix_count(allr, ["__v", "__tag", "__u"], weight_col="__isdata")
    th = cum.where(F.col("__isdata") == 0)
    agg = th.groupBy("__id").agg(F.max(F.when(F.col("__tag") == 2, F.col("__cum"))).alias("__up"),
                                 F.max(F.when(F.col("__tag") == 0, F.col("__cum"))).alias("__low"))
    return agg.select(F.col("__id").alias(id_col), (F.col("__up") - F.col("__low")).alias("count"))


def global_positions(df: DataFrame, order_cols: list[str], out: str = "pos") -> DataFrame:
    """0-based global position in ``order_cols`` order (distributed row_number - 1)."""
    return prefix_count(df, order_cols, out="__cum").withColumn(out, F.col("__cum") - 1).drop("__cum")
