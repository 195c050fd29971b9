"""Activity and feature-usage stores as append-only fact tables.

The reference keeps these as single-row SQLite writes; here they are batch
(or micro-batch) appends and an aggregate upsert expressed as
``union -> groupBy -> rewrite``, which is idempotent per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_activity(events: DataFrame, path: str, now_col: str = "created_at") -> None:
    """Append activity rows; a missing timestamp defaults to the write time."""
    out = events.withColumn(now_col, F.coalesce(F.col(now_col), F.current_timestamp().cast("timestamp_ntz")))
    out.write.mode("append").parquet(path)


def feature_usage_from_log(log: DataFrame) -> DataFrame:
    """(feature_name, username, use_count, last_used) from an activity log."""
    return (log.groupBy(F.col("action").alias("feature_name"), "username")
            .agg(F.count(F.lit(1)).alias("use_count"), F.max("created_at").alias("last_used")))


def upsert_feature_usage(current: DataFrame, delta: DataFrame) -> DataFrame:
    """S3: merge new uses into the counter table: counts add up, last use is the max.

    Both inputs have (feature_name, username, use_count, last_used); the merge is one
    shuffle on the key with map-side combine, so a hot feature is pre-aggregated.
    """
    cols = ["feature_name", "username", "use_count", "last_used"]
    return (current.select(*cols).unionByName(delta.select(*cols))
            .groupBy("feature_name", "username")
            .agg(F.sum("use_count").alias("use_count"), F.max("last_used").alias("last_used")))
