"""Registered streaming queries (L1-L4, S2, S3): each runs a stream to completion
(availableNow) over the given table and returns the sink's contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.plans.q_windows import rnd
from strata.plans.registry import register
from strata.sources import tables as T
from strata.streaming import streams as ST


@register("stream_activity_counts", """
WITH w AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
                  event_type, COUNT(*) AS total FROM events GROUP BY 1, 2, 3)
SELECT * FROM w WHERE window_end <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_activity_counts(spark, sf):
    return ST.run_to_table(ST.stream_activity_counts(ST.table_stream(spark, sf, "events")), "activity_counts")


@register("stream_lockout", """
WITH RECURSIVE att AS (SELECT user_id AS username, ts, event_id, event_type = 'purchase' AS success,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'purchase')),
st AS (
  SELECT username, 0 AS rn, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome,
    CAST(0 AS BIGINT) AS failed, CAST(NULL AS TIMESTAMP) AS locked FROM att WHERE rn = 1
  UNION ALL
  SELECT a.username, a.rn, a.ts, a.event_id,
    CASE WHEN s.locked > a.ts THEN 'refused_locked' WHEN a.success THEN 'success' WHEN s.failed >= 5 THEN 'failure_locked' ELSE 'failure' END,
    CASE WHEN s.locked > a.ts THEN s.failed WHEN a.success THEN 0 ELSE s.failed + 1 END,
    CASE WHEN s.locked > a.ts THEN s.locked WHEN a.success THEN NULL WHEN s.failed >= 5 THEN a.ts + INTERVAL 15 MINUTE ELSE s.locked END
  FROM st s JOIN att a ON a.username = s.username AND a.rn = s.rn + 1)
SELECT username, ts, event_id, outcome, failed AS failed_attempts, locked AS locked_until FROM st WHERE rn > 0""")
def q_stream_lockout(spark, sf):
    out = ST.run_lockout(ST.table_stream(spark, sf, "events"))
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


@register("stream_rolling_anomaly", """
WITH s AS (SELECT event_type, event_id, ts, value,
  CASE WHEN COUNT(value) OVER f = 5 THEN AVG(value) OVER f END AS m,
  CASE WHEN COUNT(value) OVER f = 5 THEN STDDEV_SAMP(value) OVER f END AS sd
  FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_type, event_id, ts, value, round(m, 6) AS rolling_mean, round(sd, 6) AS rolling_std,
  round(CASE WHEN m IS NULL THEN NULL WHEN sd <> 0 THEN abs(value - m) / sd ELSE 0 END, 6) AS z_score,
  CASE WHEN m IS NULL THEN NULL WHEN sd <> 0 THEN abs(value - m) / sd > 3 ELSE false END AS is_anomaly FROM s""")
def q_stream_rolling_anomaly(spark, sf):
    out = ST.run_rolling_anomaly(ST.table_stream(spark, sf, "events"))
    return rnd(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 6)


@register("stream_session_expiry", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
             OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new_s FROM events),
i AS (SELECT user_id, ts, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 24 HOUR AS session_end, COUNT(*) AS events
FROM i GROUP BY user_id, sid""")
def q_stream_session_expiry(spark, sf):
    return ST.run_to_table(ST.stream_sessions(ST.table_stream(spark, sf, "events")), "sessions", "complete")


@register("append_activity", f"WITH {T.SQL_ACTIVITY_LOG} SELECT * FROM activity_log")
def q_append_activity(spark, sf):
    return ST.stream_append_activity(ST.table_stream(spark, sf, "events"))


@register("upsert_feature_usage", """
SELECT event_type AS feature_name, user_id AS username, COUNT(*) AS use_count, MAX(ts) AS last_used
FROM events GROUP BY 1, 2""")
def q_upsert_feature_usage(spark, sf):
    return ST.stream_feature_usage(ST.table_stream(spark, sf, "events"))


@register("scan_table", "SELECT * FROM customer")
def q_scan_table(spark, sf):
    return T.scan_table(spark, f"{sf}/customer.parquet")
