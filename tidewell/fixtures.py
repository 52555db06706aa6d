"""Deterministic inputs derived from the test tables, in Spark and as SQL: a stale target, a
change feed, a run log. SQL texts are subqueries that DuckDB and Spark both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import ordering
from .model import CHANGED_AT, OPERATION, ORDERING
from .operators.verify import drift

SHIFT = 10_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stale_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with rows missing, altered and added."""
    return drift(load(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


STALE = f"""(
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL
  SELECT o_orderkey + {SHIFT}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 13 = 0)"""


def feed(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """events as a change log: seq, k, op, v, changed_at."""
    events = load(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    v = F.when(F.col("event_id") % 5 != 0, F.col("event_type")) if nulls else F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("k"), op.alias("op"), v.alias("v"), F.col("ts").alias("changed_at")
    )


def _feed_sql(v: str) -> str:
    return f"""(
  SELECT event_id AS seq, user_id AS k,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
         {v} AS v, ts AS changed_at
  FROM events)"""


FEED = _feed_sql("event_type")
FEED_NULLS = _feed_sql("CASE WHEN event_id % 5 <> 0 THEN event_type END")


def half(spark: SparkSession, sf_dir: str) -> int:
    """The sequence that parts the feed into what is applied and what a pass brings."""
    return load(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 2


HALF = "(SELECT max(event_id) // 2 FROM events)"


def staged_feed(rows: DataFrame) -> DataFrame:
    """Feed rows as staged changes with their order and time."""
    return rows.select(
        "k", "v", F.col("op").alias(OPERATION), ordering(F.col("seq"), F.lit(0).cast("long")).alias(ORDERING),
        F.col("changed_at").alias(CHANGED_AT),
    )


def open_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's first half as a dimension table: for each key, its last live value."""
    log = feed(spark, sf_dir, nulls=True).filter(F.col("seq") <= half(spark, sf_dir))
    last = log.groupBy("k").agg(F.max_by(F.struct("op", "v", "changed_at", "seq"), "seq").alias("l")).filter("l.op <> 'D'")
    return last.select(
        F.concat(F.lit("old-"), F.col("l.seq").cast("string")).alias("version_key"), "k", "l.v",
        F.col("l.changed_at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"),
    )


OPEN = f"""(
  SELECT 'old-' || CAST(seq AS VARCHAR) AS version_key, k, v, changed_at AS valid_from,
         CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {FEED_NULLS} f WHERE seq <= {HALF}) x
  WHERE r = 1 AND op <> 'D')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run log; every 97th run hasn't ended."""
    ms = F.col("value").cast("decimal(18,2)") * 100
    events = load(spark, sf_dir, "events").withColumn("ms", ms.cast("long"))
    end = F.expr("timestampadd(MILLISECOND, ms, ts)")
    return events.select(
        F.col("event_id").alias("run_id"), F.lit("main").alias("task"), (F.col("user_id") % 10).alias("mapping"),
        F.when(F.col("event_type") == "error", "Failed").otherwise("Succeeded").alias("status"),
        F.col("ts").alias("enqueued_at"), F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 97 != 0, end).alias("ended_at"),
        F.col("ms").alias("rows_read"), F.expr("ms div 2").alias("rows_written"), F.expr("event_id div 50").alias("batch_id"),
    )


RUNS = """(
  SELECT event_id AS run_id, 'main' AS task, user_id % 10 AS mapping,
         CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Succeeded' END AS status,
         ts AS enqueued_at, ts AS started_at,
         CASE WHEN event_id % 97 <> 0
              THEN ts + to_milliseconds(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)) END AS ended_at,
         CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS rows_read,
         CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) // 2 AS rows_written, event_id // 50 AS batch_id
  FROM events)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a work queue."""
    state = F.when(F.col("event_type") == "error", "Running").when(F.col("event_type") == "click", "Done").otherwise("Pending")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"), F.lit("main").alias("task"), F.lit("sync").alias("kind"),
        F.col("user_id").alias("mapping"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), F.col("event_id") % 2)).alias("segment"), state.alias("state"),
        (F.col("event_id") % 3).alias("priority"), F.col("ts").alias("enqueued_at"), F.col("ts").alias("available_at"),
    )


QUEUE = """(
  SELECT event_id AS item_id, 'main' AS task, 'sync' AS kind, user_id AS mapping, CASE WHEN event_id % 4 <> 0 THEN 's' || (event_id % 2) END AS segment,
         CASE event_type WHEN 'error' THEN 'Running' WHEN 'click' THEN 'Done' ELSE 'Pending' END AS state,
         event_id % 3 AS priority, ts AS enqueued_at, ts AS available_at
  FROM events)"""
