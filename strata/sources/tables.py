"""Table scans and the derived inputs every engine builds the same way.

Each derived input has a Spark builder and a DuckDB CTE twin (used by the
oracle SQL) so both engines start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
               header: bool = True, infer_schema: bool = False) -> DataFrame:
    """Load an uploaded dataset. CSV reads infer only when asked (one extra pass)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", header).option("inferSchema", infer_schema).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.format(fmt).load(path)


# ---------------------------------------------------------------- derived inputs

def lineitem_nulls(spark, sf_dir) -> DataFrame:
    """lineitem with deterministic, correlated nulls (tax nulls are a subset of quantity nulls)."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(k % 7 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount",
        F.when(k % 21 == 0, None).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(k % 11 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate")


SQL_LINEITEM_NULLS = """lineitem_nulls AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice, l_discount,
         CASE WHEN l_orderkey % 21 = 0 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem)"""


def daily_sales(spark, sf_dir) -> DataFrame:
    """Sum of extended price per ship day over the full day calendar; gap days are null.

    The calendar is generated from the min/max day (one tiny aggregate), and the
    left join is on a date key: both sides are bounded by the number of days.
    """
    li = table(spark, sf_dir, "lineitem")
    per_day = (li.groupBy(F.to_date("l_shipdate").alias("ds"))
               .agg(F.round(F.sum("l_extendedprice"), 2).alias("sales")))
    cal = (per_day.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
           .select(F.explode(F.sequence("lo", "hi")).alias("ds")))
    return cal.join(per_day, "ds", "left").select("ds", "sales")


SQL_DAILY_SALES = """per_day AS (
  SELECT CAST(l_shipdate AS DATE) AS ds, round(SUM(l_extendedprice), 2) AS sales
  FROM lineitem GROUP BY 1),
cal AS (
  SELECT CAST(d AS DATE) AS ds FROM (
    SELECT UNNEST(generate_series(MIN(ds)::TIMESTAMP, MAX(ds)::TIMESTAMP, INTERVAL 1 DAY)) AS d
    FROM per_day)),
daily_sales AS (
  SELECT cal.ds, per_day.sales FROM cal LEFT JOIN per_day USING (ds))"""


def daily_events(spark, sf_dir) -> DataFrame:
    """Total event value by day and event type (many short series).

    A total of cent values is exact in both engines; a mean of k such values can land on
    an exact decimal half (k = 8, 16, ...) that the two engines round differently, so the
    series uses totals (rounded to cents) rather than means."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.to_date("ts").alias("ds"), "event_type")
            .agg(F.round(F.sum("value"), 2).alias("value")))


SQL_DAILY_EVENTS = """daily_events AS (
  SELECT CAST(ts AS DATE) AS ds, event_type, round(SUM(value), 2) AS value
  FROM events GROUP BY 1, 2)"""


def hourly_events(spark, sf_dir) -> DataFrame:
    """Mean event value per hour with every hour present (empty hours null)."""
    ev = table(spark, sf_dir, "events")
    per_hour = (ev.groupBy(F.date_trunc("hour", "ts").alias("hr"))
                .agg(F.round(F.avg("value"), 4).alias("value")))
    cal = (per_hour.agg(F.min("hr").alias("lo"), F.max("hr").alias("hi"))
           .select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hr")))
    return cal.join(per_hour, "hr", "left").select("hr", "value")


SQL_HOURLY_EVENTS = """per_hour AS (
  SELECT date_trunc('hour', ts) AS hr, round(AVG(value), 4) AS value FROM events GROUP BY 1),
hcal AS (
  SELECT UNNEST(generate_series(MIN(hr), MAX(hr), INTERVAL 1 HOUR)) AS hr FROM per_hour),
hourly_events AS (
  SELECT hcal.hr, per_hour.value FROM hcal LEFT JOIN per_hour USING (hr))"""


def spiked_series(spark, sf_dir) -> DataFrame:
    ds = daily_sales(spark, sf_dir)
    return ds.select("ds", F.when(F.dayofyear("ds") % 97 == 0, F.col("sales") * 10)
                     .otherwise(F.col("sales")).alias("sales"))


SQL_SPIKED_SERIES = SQL_DAILY_SALES + """,
spiked_series AS (
  SELECT ds, CASE WHEN dayofyear(ds) % 97 = 0 THEN sales * 10 ELSE sales END AS sales
  FROM daily_sales)"""


def supplier_months(spark, sf_dir) -> DataFrame:
    """One series per supplier: month end, sales, mean price and order lines of every month of the
    table's span; months without a line have no row."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_suppkey", F.last_day(F.to_date("l_shipdate")).alias("ds"))
            .agg(F.round(F.sum("l_extendedprice"), 2).cast("double").alias("sales"), F.avg("l_extendedprice").cast("double").alias("price"),
                 F.count("*").cast("double").alias("n_lines")))


def supplier_weeks_spiked(spark, sf_dir) -> DataFrame:
    """One weekly sales series per supplier, with every 13th week of the year multiplied by ten."""
    li = table(spark, sf_dir, "lineitem")
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    sales = li.groupBy("l_suppkey", week.alias("ds")).agg(F.round(F.sum("l_extendedprice"), 2).cast("double").alias("sales"))
    return sales.withColumn("sales", F.when(F.weekofyear("ds") % 13 == 0, F.col("sales") * 10).otherwise(F.col("sales")))


def activity_log(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("username"),
                     F.col("event_type").alias("action"), F.col("props").alias("metadata"),
                     F.col("ts").alias("created_at"))


SQL_ACTIVITY_LOG = """activity_log AS (
  SELECT event_id AS id, user_id AS username, event_type AS action,
         props AS metadata, ts AS created_at FROM events)"""


def dup_emails(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                    F.concat(F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("email"))


SQL_DUP_EMAILS = """dup_emails AS (
  SELECT c_custkey AS id, c_name AS username,
         c_mktsegment || CAST(c_nationkey AS VARCHAR) AS email FROM customer)"""


def balance_set(spark, sf_dir) -> DataFrame:
    """labels joined to documents: numeric features and the toxic label."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return (lab.join(doc, "doc_id")
            .select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"),
                    F.col("toxic").alias("label")))


SQL_BALANCE_SET = """balance_set AS (
  SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(len(regexp_split_to_array(trim(d.text), '\\s+')) AS DOUBLE) AS n_words,
         l.toxic AS label
  FROM labels l JOIN documents d USING (doc_id))"""


def daily_sales_gaps(spark, sf_dir) -> DataFrame:
    """daily_sales with deterministic gaps (days 3-5 of each month, and dayofyear % 17 = 0)
    so that fills and interpolation have runs of nulls to work on."""
    ds = daily_sales(spark, sf_dir)
    gap = F.dayofmonth("ds").between(3, 5) | (F.dayofyear("ds") % 17 == 0)
    return ds.select("ds", F.when(gap, None).otherwise(F.col("sales")).alias("sales"))


SQL_DAILY_SALES_GAPS = SQL_DAILY_SALES + """,
daily_sales_gaps AS (
  SELECT ds, CASE WHEN dayofmonth(ds) BETWEEN 3 AND 5 OR dayofyear(ds) % 17 = 0 THEN NULL ELSE sales END AS sales
  FROM daily_sales)"""
