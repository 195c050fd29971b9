"""Structured Streaming forms.

Sources are file streams over the table's parquet files; every query runs
with ``trigger(availableNow=True)`` into a sink and checkpoint under the
cluster checkpoint folder (a fresh sub-folder per run), so a restarted or
re-tried job resumes from its checkpoint instead of recomputing. Timestamps
are ``TIMESTAMP_NTZ`` in the tables and are cast to ``timestamp`` before a
watermark (UTC session).
"""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir
from strata.streaming.event_order import FAR, in_event_order, many_in_event_order, run_closed


def _run_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Child directory names under ``path`` on whatever filesystem holds it (HDFS, S3, local)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A streaming read of one table's parquet files (schema from the files, no inference)."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def dir_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame to completion (availableNow) and read the written result back.

    append mode writes a parquet sink; update/complete modes replace a parquet table per
    micro-batch through ``foreachBatch``."""
    spark = df.sparkSession
    base = _run_dir(spark, name)
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    w = df.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).outputMode("append").start()
    else:
        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch:09d}"))
        q = w.foreachBatch(sink).outputMode(mode).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    epochs = [d for d in _list_dirs(spark, out) if d.startswith("epoch=")]
    if not epochs:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(os.path.join(out, epochs[-1]))


# ------------------------------------------------------------------ L1

def stream_activity_counts(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """L1: actions per tumbling window; rows later than the watermark are dropped."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = ev.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "total")


# ------------------------------------------------------------------ L2

LOCK_AFTER = 5
LOCK_MINUTES = 15


def _lockout_fold(failed: int, locked: int | None, us: np.ndarray, success: np.ndarray):
    """Failures and successes of one account in time order (microseconds): (outcome, failed, locked until) after each
    attempt, -1 where no lock was set. One step per lock: between two locks the counter is failures since a success."""
    n = len(us)
    fails = np.cumsum(~success)
    last = np.maximum.accumulate(np.where(success, np.arange(n), -1))  # the last success up to each row
    run = fails - np.where(last >= 0, fails[last], 0)  # failures since then, this one included
    locks = np.flatnonzero(~success & (run > LOCK_AFTER))
    good = np.flatnonzero(success)
    outcome = np.where(success, "success", "failure").astype(object)
    count, until = np.zeros(n, dtype=np.int64), np.full(n, -1 if locked is None else locked, dtype=np.int64)
    i = 0
    while i < n:
        if locked is not None and locked > us[i]:
            j = int(np.searchsorted(us, locked, "left"))
            outcome[i:j], count[i:j], until[i:j] = "refused_locked", failed, locked
            i = j
            continue
        # the counter starts at ``failed`` and restarts at the next success; then it is ``run``
        p = np.searchsorted(good, i)
        reset = int(good[p]) if p < len(good) else n
        k = i + max(LOCK_AFTER - failed, 0)
        if k >= reset:
            after = np.searchsorted(locks, reset)
            k = int(locks[after]) if after < len(locks) else n
        end, cut = min(k + 1, n), min(reset, k + 1, n)
        count[i:cut] = failed + np.arange(1, cut - i + 1)
        count[cut:end] = run[cut:end]
        until[i:cut] = -1 if locked is None else locked
        until[cut:end] = -1
        if k < n:
            locked = int(us[k]) + LOCK_MINUTES * 60_000_000
            outcome[k], until[k] = "failure_locked", locked
        elif reset < n:
            locked = None
        failed, i = int(count[end - 1]), end
    return outcome, count, until


def _lockout_rows(username, rows: pd.DataFrame, failed: int = 0, locked: int | None = None) -> tuple[pd.DataFrame, tuple[int, int | None]]:
    """The attempts of one account, in order, with their outcomes; and the state after the last."""
    us = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
    outcome, count, until = _lockout_fold(failed, locked, us, rows["success"].to_numpy(dtype=bool))
    times = pd.Series(until.astype("datetime64[us]")).where(until >= 0)
    out = pd.DataFrame({"username": username, "ts": rows["ts"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "outcome": outcome,
                        "failed_attempts": count, "locked_until": times.to_numpy()})
    if not len(rows):
        return out, (failed, locked)
    return out, (int(count[-1]), int(until[-1]) if until[-1] >= 0 else None)


LOCKOUT_SCHEMA = ("username long, ts timestamp, event_id long, outcome string, failed_attempts long, "
                  "locked_until timestamp")


def _login_attempts(events: DataFrame, mark: str | None = None) -> DataFrame:
    """Login attempts from activity: event_type 'error' = failure, 'purchase' = success; and a closing marker at ``mark``."""
    wanted = F.col("event_type").isin("error", "purchase")
    return (events.where(wanted | (F.col("ts") >= F.lit(mark).cast("timestamp_ntz")) if mark else wanted)
            .select(F.col("user_id").alias("username"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                    (F.col("event_type") == "purchase").alias("success")))


def stream_lockout(events: DataFrame, delay: str = "1 hour", forget_after: timedelta | None = None) -> DataFrame:
    """L2 (streaming): per-user lockout state, folded in event-time order (``event_order``).

    A failure increments the counter and locks the account for 15 minutes when the
    counter was already >= 5 (so from the 6th failure on); attempts during a lock are
    refused and not counted; a success resets the counter. An attempt is answered when the watermark
    (``delay`` behind the latest event) has passed it, so attempts that arrive late take their place.

    A user whose counter is zero has no state. Counters of others are kept for good, as they change later answers,
    unless ``forget_after`` (time since the user's last attempt) is given."""
    columns = ["known", "name", "us", "unnumbered", "number", "success"]  # nulls are flags, all else is long

    def fold(rows, starts, before):
        n, after = len(rows), []
        outcome, count, until = np.empty(n, dtype=object), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for a, b, carried in zip(starts.tolist(), [*starts[1:].tolist(), n], before, strict=True):
            failed, locked = carried or (0, -1)
            outcome[a:b], count[a:b], until[a:b] = _lockout_fold(failed, None if locked < 0 else locked, rows[a:b, 2], rows[a:b, 5].astype(bool))
            after.append((int(count[b - 1]), int(until[b - 1])) if count[b - 1] else None)
        known = pd.DataFrame(dict(zip(columns, rows.T, strict=True)))[columns[:5]]
        return known.assign(outcome=outcome, failed_attempts=count, until=until), after

    flag = lambda c: c.cast("long")
    tries = _login_attempts(events, mark=FAR).select(
        "ts", flag(F.col("username").isNotNull()).alias("known"), F.coalesce("username", F.lit(0)).cast("long").alias("name"), F.unix_micros("ts").alias("us"),
        flag(F.col("event_id").isNull()).alias("unnumbered"), F.coalesce("event_id", F.lit(0)).cast("long").alias("number"), flag(F.coalesce("success", F.lit(False))).alias("success"))
    expire = int(forget_after.total_seconds() * 1000) if forget_after else None
    done = many_in_event_order(tries, "ts", columns, 2, fold, ", ".join(f"{c} long" for c in columns[:5]) + ", outcome string, failed_attempts long, until long",
                               delay, 2, expire_after_ms=expire)
    return done.select(F.when(F.col("known") == 1, F.col("name")).alias("username"), F.timestamp_micros("us").alias("ts"),
                       F.when(F.col("unnumbered") == 0, F.col("number")).alias("event_id"), "outcome", "failed_attempts",
                       F.when(F.col("until") >= 0, F.timestamp_micros("until")).alias("locked_until"))


def run_lockout(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """L2 to the end of a stream: every attempt's outcome."""
    return run_closed(lambda s: stream_lockout(s, delay), events, _run_dir(events.sparkSession, "lockout"))


def lockout_batch(events: DataFrame) -> DataFrame:
    """L2 batch twin: the same fold per user with ``applyInPandas``."""
    def fn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _lockout_rows(key[0], pdf.sort_values(["ts", "event_id"], ignore_index=True))[0]

    return _login_attempts(events).groupBy("username").applyInPandas(fn, LOCKOUT_SCHEMA)


# ------------------------------------------------------------------ L3

def _rolling(values: np.ndarray, window: int, threshold: float) -> dict[str, np.ndarray]:
    """Mean, sample deviation, z-score and flag of the full window that ends at each value, null before the first."""
    n = len(values)
    mean, sd, z = (np.full(n, np.nan) for _ in range(3))
    if n >= window:
        w = np.lib.stride_tricks.sliding_window_view(values, window)
        m, s = w.mean(axis=1), w.std(axis=1, ddof=1)
        mean[window - 1:], sd[window - 1:] = m, s
        z[window - 1:] = np.where(s != 0, np.abs(w[:, -1] - m) / np.where(s != 0, s, 1.0), 0.0)
    flag = np.where(np.isnan(mean), None, z > threshold)
    return {"rolling_mean": mean, "rolling_std": sd, "z_score": z, "is_anomaly": pd.array(flag, dtype="boolean")}


def _rolling_schema(key: str, kind: str) -> str:
    return (f"{key} {kind}, event_id long, ts timestamp, value double, rolling_mean double, rolling_std double, "
            "z_score double, is_anomaly boolean")


def stream_bucket_anomaly(events: DataFrame, window_size: int = 5, threshold: float = 3.0, key: str = "event_type",
                          bucket: timedelta = timedelta(days=1), delay: str = "1 hour") -> DataFrame:
    """L3, first stream: each (key, time bucket) is a state of its own, so that one busy key is many tasks.

    A bucket is answered when the watermark passes its end. Rows with a full window inside it are final (``edge``
    null). Its first ``window_size`` - 1 rows ("head") and, to be carried on, its last ones ("tail", "both" where
    a row is head and tail) go to ``stream_edge_anomaly``."""
    width, h = int(bucket.total_seconds() * 1_000_000), window_size - 1
    src = events.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    src = src.withColumn("bucket", F.floor(F.unix_micros("ts") / F.lit(width)).cast("long"))

    def fold(k, carried, rows):
        n = len(rows)
        head, tail = np.arange(n) < h, np.arange(n) >= n - h
        edge = np.where(head & tail, "both", np.where(head, "head", np.where(tail, "tail", None)))
        out = rows[["event_id", "ts", "value"]].assign(**{key: k[0]}, **_rolling(rows["value"].to_numpy(dtype=float), window_size, threshold), edge=edge)
        return out[[key, "event_id", "ts", "value", "rolling_mean", "rolling_std", "z_score", "is_anomaly", "edge"]], None

    schema = _rolling_schema(key, dict(src.dtypes)[key]) + ", edge string"
    return in_event_order(src, [key, "bucket"], ["ts", "event_id"], fold, schema, delay, release=lambda us: (us // width + 1) * width)


def stream_edge_anomaly(buckets: DataFrame, window_size: int = 5, threshold: float = 3.0, key: str = "event_type",
                        delay: str = "1 hour") -> DataFrame:
    """L3, second stream: the head rows of all buckets, from a stream of the first one's output. A key's
    state is its last ``window_size`` - 1 values, and it is sent at most twice as many rows per bucket."""
    h = window_size - 1
    src = buckets.where(F.col("edge").isNotNull() | (F.col("ts") >= F.lit(FAR).cast("timestamp"))).select(key, "event_id", "ts", "value", "edge")

    def fold(k, carried, rows):
        before = np.array([np.nan if v is None else v for v in (carried[0] if carried else [])], dtype=float)
        values = np.concatenate([before, rows["value"].to_numpy(dtype=float)])
        stats = {c: v[len(before):] for c, v in _rolling(values, window_size, threshold).items()}
        out = rows[["event_id", "ts", "value"]].assign(**{key: k[0]}, **stats)[(rows["edge"] != "tail").to_numpy()]
        last = values[len(values) - min(h, len(values)):] if h else values[:0]
        return out[[key, "event_id", "ts", "value", "rolling_mean", "rolling_std", "z_score", "is_anomaly"]], (last.tolist(),)

    return in_event_order(src, [key], ["ts", "event_id"], fold, _rolling_schema(key, dict(src.dtypes)[key]), delay, "hist array<double>")


def run_rolling_anomaly(events: DataFrame, window_size: int = 5, threshold: float = 3.0, key: str = "event_type",
                        bucket: timedelta = timedelta(days=1), delay: str = "1 hour") -> DataFrame:
    """L3: rolling z-score over the points of a stream per key, to the stream's end.

    Stats include the current point (reference mode) and need a full
    window (no back-fill on a stream); zero std gives z = 0. Windows with a missing value have null stats."""
    base = _run_dir(events.sparkSession, "rolling_anomaly")
    inner = run_closed(lambda s: stream_bucket_anomaly(s, window_size, threshold, key, bucket, delay), events, os.path.join(base, "buckets"))
    # files of one batch of the first stream are read together; batches release buckets in time order
    source = dir_stream(events.sparkSession, os.path.join(base, "buckets", "out"), inner.schema)
    heads = run_closed(lambda s: stream_edge_anomaly(s, window_size, threshold, key, delay), source, os.path.join(base, "edges"))
    done = inner.where("edge IS NULL OR edge = 'tail'").drop("edge")
    return done.unionByName(heads)


# ------------------------------------------------------------------ L4

def stream_sessions(events: DataFrame, gap: str = "24 hours", watermark: str = "1 hour") -> DataFrame:
    """L4: per-user sessions that stay valid while events arrive within ``gap`` of the last one."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = ev.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "events")


# ------------------------------------------------------------------ S2 / S3

def stream_append_activity(events: DataFrame, name: str = "activity") -> DataFrame:
    """S2 streaming: activity rows appended by a file sink (exactly-once through the checkpoint)."""
    act = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("username"),
                        F.col("event_type").alias("action"), F.col("props").alias("metadata"),
                        F.col("ts").alias("created_at"))
    return run_to_table(act, name, "append")


def stream_feature_usage(events: DataFrame) -> DataFrame:
    """S3 streaming: per micro-batch, merge (action, user) counts into the usage table.

    The merge is union -> groupBy(sum, max) -> write a new table version; the batch id is
    part of the version path so a replayed batch rewrites the same version (idempotent)."""
    from strata.sources.activity import upsert_feature_usage
    spark = events.sparkSession
    base = _run_dir(spark, "feature_usage")
    ck = os.path.join(base, "checkpoint")
    delta_cols = events.select(F.col("event_type").alias("feature_name"), F.col("user_id").alias("username"),
                               F.col("ts").alias("created_at"))

    def merge(batch: DataFrame, epoch: int) -> None:
        delta = (batch.groupBy("feature_name", "username")
                 .agg(F.count(F.lit(1)).alias("use_count"), F.max("created_at").alias("last_used")))
        prev = [d for d in _list_dirs(spark, base) if d.startswith("v=") and d < f"v={epoch:09d}"]
        cur = (spark.read.parquet(os.path.join(base, prev[-1])) if prev else
               spark.createDataFrame([], "feature_name string, username long, use_count long, last_used timestamp_ntz"))
        upsert_feature_usage(cur, delta).write.mode("overwrite").parquet(os.path.join(base, f"v={epoch:09d}"))

    q = delta_cols.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    vs = [d for d in _list_dirs(spark, base) if d.startswith("v=")]
    if not vs:
        return spark.createDataFrame([], "feature_name string, username long, use_count long, last_used timestamp_ntz")
    return spark.read.parquet(os.path.join(base, vs[-1]))
