"""A query for each operator over the test tables, with the SQL that it is checked against."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures as X
from .functions import transforms, typed
from .functions.expressions import operation_code, ordering
from .functions.project import auto_map, join_relationships, split_keys
from .model import CHANGED_AT, OPERATION, ORDERING, Auto, ColumnMapping, Intent, ListOf, Mapping, Range, Relationship
from .operators import metrics, scd2, verify, writers
from .plans import passes, provision, segments
from .plans.buckets import BUCKET, KeyedTable
from .plans.store import Positions, VersionedTable
from .sources import changelog, connectors, readers
from .streaming import capped, continuous
from .types import samples, to_spark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = dt.datetime(2024, 6, 1, 12, 30, 15, 250000)
NOW_SQL = "TIMESTAMP '2024-06-01 12:30:15.25'"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _op(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(OPERATION, "op")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return X.load(spark, d, "orders")


ORDERS = Mapping(
    (
        ColumnMapping("o_orderkey", "id"),
        ColumnMapping("o_custkey", "customer"),
        ColumnMapping("o_orderstatus", "status", "lower({{column}})"),
        ColumnMapping("o_totalprice", "total"),
    ),
    ("id",),
)
ORDERS_SQL = "SELECT o_orderkey AS id, o_custkey AS customer, lower(o_orderstatus) AS status, o_totalprice AS total, 'I' AS op FROM orders"


def _customers(spark: SparkSession, d: str) -> Relationship:
    return Relationship("customer", X.load(spark, d, "customer"), (("o_custkey", "c_custkey"),))


# reloads


@query(ORDERS_SQL)
def batch_reload_full(spark, d):
    return _op(readers.reload(_orders(spark, d), ORDERS).rows)


@query(f"{ORDERS_SQL} WHERE o_orderkey >= (SELECT max(o_orderkey) // 4 FROM orders) AND o_orderkey < (SELECT max(o_orderkey) // 4 * 3 FROM orders)")
def batch_reload_range(spark, d):
    orders = _orders(spark, d)
    quarter = orders.agg(F.max("o_orderkey")).first()[0] // 4
    return _op(readers.reload(orders, ORDERS, Range("o_orderkey", quarter, 3 * quarter)).rows)


@query(f"{ORDERS_SQL} WHERE lower(o_orderstatus) IN ('f', 'p')")
def batch_reload_list(spark, d):
    return _op(readers.reload(_orders(spark, d), ORDERS, ListOf("o_orderstatus", ("f", "p"))).rows)


@query(
    "SELECT o_orderkey, o_orderkey * 2 + 1 AS twice, upper(o_orderpriority) AS priority, 7 AS seven, 'I' AS op "
    "FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'"
)
def source_filter_transform(spark, d):
    mapping = Mapping(
        (
            ColumnMapping("o_orderkey"),
            ColumnMapping("o_orderkey", "twice", "{{column}} * 2 + 1"),
            ColumnMapping("o_orderpriority", "priority", "upper({{column}})"),
            ColumnMapping("o_custkey", "seven", "7"),
        ),
        filter="o_totalprice > 200000 AND o_orderstatus <> 'F'",
    )
    return _op(readers.reload(_orders(spark, d), mapping).rows)


@query("SELECT o_custkey AS customer, n, 'I' AS op FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 8")
def query_source(spark, d):
    _orders(spark, d).createOrReplaceTempView("q_orders")
    mapping = Mapping((ColumnMapping("o_custkey", "customer"), ColumnMapping("n")), filter="n > 8")
    return _op(readers.query(spark, "SELECT o_custkey, count(*) AS n FROM q_orders GROUP BY o_custkey", mapping).rows)


@query("SELECT o_orderpriority, count(*) AS n, 'I' AS op FROM orders GROUP BY o_orderpriority")
def query_source_verbatim(spark, d):
    _orders(spark, d).createOrReplaceTempView("q_orders")
    return _op(readers.query(spark, "SELECT o_orderpriority, count(*) AS n FROM q_orders GROUP BY o_orderpriority", wrap=False).rows)


@query("SELECT o_orderkey AS id, 'I' AS op FROM orders WHERE o_orderkey >= 50 AND o_orderkey < (SELECT max(o_orderkey) // 4 * 3 FROM orders)")
def key_read(spark, d):
    orders = _orders(spark, d)
    quarter = orders.agg(F.max("o_orderkey")).first()[0] // 4
    return _op(readers.keys_only(orders, ORDERS, ["o_orderkey"], Range("o_orderkey", 50, 3 * quarter)).rows)


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events WHERE event_id > 40")
def scripted_query(spark, d):
    build = lambda p: X.load(spark, d, "events").filter(F.col("event_id") > p).select("event_id", "event_type")
    return _op(readers.scripted(build, 40, "event_type", {"signup": "I", "error": "D"}, "U").rows)


@query("SELECT o_orderkey, o_custkey, 'I' AS op FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 21)")
def preview_limit(spark, d):
    rows = readers.reload(_orders(spark, d), Mapping((ColumnMapping("o_orderkey"), ColumnMapping("o_custkey")))).rows
    return _op(readers.preview(rows.orderBy("o_orderkey"), 21)[0])


@query("SELECT o_orderkey, o_orderdate, 'I' AS op FROM orders")
def auto_mapped_columns(spark, d):
    orders = _orders(spark, d)
    mapping = Mapping(tuple(auto_map(orders.columns, ["o_orderdate", "o_orderkey", "O_CUSTKEY"])))
    return _op(readers.reload(orders, mapping).rows)


# incremental reads


@query("SELECT o_orderkey, o_orderdate, 'I' AS op FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01'")
def watermark_read(spark, d):
    mapping = Mapping((ColumnMapping("o_orderkey"), ColumnMapping("o_orderdate")))
    return _op(readers.watermark(_orders(spark, d), mapping, "o_orderdate", dt.datetime(1997, 6, 1)).rows)


@query(
    "SELECT o_orderkey, o_orderdate, 'I' AS op FROM (SELECT *, rank() OVER (ORDER BY o_orderdate) AS r FROM orders "
    "WHERE o_orderdate > TIMESTAMP '1993-01-01') WHERE r <= 103"
)
def watermark_bounded_ties(spark, d):
    mapping = Mapping((ColumnMapping("o_orderkey"), ColumnMapping("o_orderdate")))
    return _op(readers.watermark(_orders(spark, d), mapping, "o_orderdate", dt.datetime(1993, 1, 1), 103).rows)


@query("SELECT o_orderkey, c_name, 'I' AS op FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def watermark_relationship(spark, d):
    mapping = Mapping((ColumnMapping("o_orderkey"), ColumnMapping("c_name", relationship="customer")), relationships=(_customers(spark, d),))
    return _op(readers.watermark(_orders(spark, d), mapping, "c_acctbal", 5000.0, relationship="customer").rows)


@query("SELECT o_orderkey * 10 AS ten, 'I' AS op FROM orders WHERE o_orderkey * 10 > 5000")
def watermark_transform(spark, d):
    mapping = Mapping((ColumnMapping("o_orderkey", "ten", "{{column}} * 10"),))
    return _op(readers.watermark(_orders(spark, d), mapping, "o_orderkey", 5000).rows)


@query("SELECT max(o_orderdate) AS position, 0 AS row_count FROM orders")
def changes_from_latest(spark, d):
    found = readers.watermark(_orders(spark, d), Mapping(), "o_orderdate", intent=Intent.FROM_LATEST)
    return found.rows.agg(F.lit(found.position).alias("position"), F.count("*").cast("int").alias("row_count"))


@query("SELECT max(o_orderdate) AS position FROM orders")
def max_position(spark, d):
    position = readers.capture(_orders(spark, d), Mapping(), "o_orderdate")
    return spark.range(1).select(F.lit(position).alias("position"))


# change logs


@query(
    f"""SELECT l.k, CASE WHEN op <> 'D' THEN c_name END AS c_name, op, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {X.FEED} f WHERE seq > 100) l
      LEFT JOIN customer ON c_custkey = l.k AND c_custkey % 4 <> 0 WHERE r = 1 AND (op = 'D' OR c_custkey IS NOT NULL)"""
)
def net_changes(spark, d):
    base = X.load(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), "c_name")
    rows = changelog.net_changes(X.feed(spark, d), base, ["k"], "seq", "op", 100).rows
    return _op(rows).withColumnRenamed(changelog.SEQUENCE, "seq")


@query(
    f"""SELECT k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {X.FEED} f WHERE seq > 100) l
      WHERE r = 1 AND op <> 'D' AND k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)"""
)
def base_missing_skipped(spark, d):
    base = X.load(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return changelog.vanished(X.feed(spark, d), base, ["k"], "seq", "op", 100)


@query(
    f"""SELECT k, v, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r
      FROM {X.FEED_NULLS} f WHERE seq > {X.HALF} // 3 AND seq <= {X.HALF}) WHERE r = 1"""
)
def captured_net_changes(spark, d):
    last = X.half(spark, d)
    rows = changelog.captured_net(X.feed(spark, d, nulls=True), ["k"], ["v"], "seq", "op", last // 3, last).rows
    return _op(rows).withColumnRenamed(changelog.SEQUENCE, "seq")


@query(f"SELECT k, v, op, lpad(hex(seq // 10), 20, '0') || lpad(hex(seq), 20, '0') AS change_order, changed_at FROM {X.FEED} f WHERE seq // 10 > 20")
def all_changes_ordered(spark, d):
    log = X.feed(spark, d).withColumn("lsn", F.expr("seq div 10"))
    rows = changelog.all_changes(log, ["k", "v"], "lsn", "seq", F.col("op"), "changed_at", 20).rows
    return _op(rows).withColumnRenamed(ORDERING, "change_order").withColumnRenamed(CHANGED_AT, "changed_at")


@query(
    f"""SELECT k, op, seq // 10 AS reached FROM (SELECT *, rank() OVER (ORDER BY seq // 10) AS r FROM {X.FEED} f WHERE seq // 10 > 5) WHERE r <= 203"""
)
def bounded_lsn_ties(spark, d):
    log = X.feed(spark, d).withColumn("lsn", F.expr("seq div 10"))
    found = changelog.all_changes(log, ["k", "lsn"], "lsn", "seq", F.col("op"), "changed_at", 5, 203)
    return _op(found.rows).select("k", "op", F.col("lsn").alias("reached"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'I' ELSE 'U' END AS op FROM events")
def operation_decode(spark, d):
    code = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 2).otherwise(4)
    return X.load(spark, d, "events").select("event_id", operation_code(code).alias("op"))


@query(
    f"""SELECT l.k, op, seq, CASE WHEN op <> 'D' THEN c_acctbal END AS c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r
      FROM {X.FEED} f WHERE seq > {X.HALF} // 3 AND seq <= {X.HALF}) l LEFT JOIN customer ON c_custkey = k WHERE r = 1 AND (op = 'D' OR c_custkey IS NOT NULL)"""
)
def trigger_audit_window(spark, d):
    base = X.load(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    last = X.half(spark, d)
    rows = changelog.net_changes(X.feed(spark, d), base, ["k"], "seq", "op", last // 3, last).rows
    return _op(rows).withColumnRenamed(changelog.SEQUENCE, "seq").orderBy("seq")


@query(f"SELECT count(*) AS row_count, min(seq) - 1 AS position FROM {X.FEED} f WHERE seq > 17")
def changes_from_earliest(spark, d):
    log = X.feed(spark, d).filter("seq > 17")
    first = changelog.earliest(log, "seq")
    return changelog.window(log, "seq", first, None).agg(F.count("*").alias("row_count"), F.lit(first).cast("long").alias("position"))


@query(f"SELECT seq, k, op FROM {X.FEED} f WHERE seq > 250")
def log_prune(spark, d):
    return changelog.prune(X.feed(spark, d), "seq", 250).select("seq", "k", "op")


@query(f"SELECT k, op, seq FROM {X.FEED} f WHERE seq > 10 AND seq <= {X.HALF}")
def flashback_versions(spark, d):
    return _op(changelog.versions(X.feed(spark, d), ["k", "seq"], "seq", "op", 10, X.half(spark, d)).rows)


@query(
    f"""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_totalprice,
      CASE WHEN a.o_orderkey IS NULL THEN 'I' WHEN b.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op
      FROM {X.STALE} a FULL JOIN orders b ON a.o_orderkey = b.o_orderkey
      WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice"""
)
def snapshot_log(spark, d):
    rows = changelog.snapshot_log(X.stale_orders(spark, d), _orders(spark, d), ["o_orderkey"])
    return _op(rows).select("o_orderkey", "o_totalprice", "op")


@query(f"SELECT seq, k, CASE WHEN op <> 'D' THEN v END AS v, op FROM {X.FEED_NULLS} f")
def wal_json_decode(spark, d):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
    record = F.struct(
        F.col("op").alias("action"),
        F.when(F.col("op") != "D", F.array(pair("k", "k"), pair("v", "v"))).alias("columns"),
        F.when(F.col("op") != "I", F.array(pair("k", "k"))).alias("identity"),
    )
    log = X.feed(spark, d, nulls=True).select("seq", F.to_json(record, {"ignoreNullFields": "false"}).alias("data"))
    return _op(changelog.logical_records(log, "data", {"k": "bigint", "v": "string"}, ["seq"]))


# user transforms


@query(f"SELECT k, CASE WHEN op <> 'D' THEN upper(v) ELSE v END AS v, op FROM {X.FEED} f")
def value_transform(spark, d):
    staged = X.staged_feed(X.feed(spark, d)).drop(ORDERING, CHANGED_AT)
    return _op(transforms.map_values(staged, {"v": F.upper}))


@query(f"SELECT k, v || '!' AS v, op FROM {X.FEED} f WHERE k % 3 <> 0")
def row_transform_drop(spark, d):
    def change(frames):
        for frame in frames:
            frame = frame[frame["k"] % 3 != 0]
            yield frame.assign(v=frame["v"] + "!")

    staged = X.staged_feed(X.feed(spark, d)).drop(ORDERING, CHANGED_AT)
    return _op(transforms.map_rows(staged, lambda rows: rows.mapInPandas(change, rows.schema)))


@query("SELECT o_orderkey AS id, o_custkey AS customer, lower(o_orderstatus) AS status, -o_totalprice AS total, 'I' AS op FROM orders")
def generated_expression(spark, d):
    mapping = transforms.generated(ORDERS, lambda c: "-{{column}}" if c.name == "total" else " ")
    return _op(readers.reload(_orders(spark, d), mapping).rows)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def hook_sql(spark, d):
    _orders(spark, d).createOrReplaceTempView("hook_orders")
    text = "SELECT o_orderstatus, count(*) AS n FROM {{target}} WHERE o_totalprice > :least GROUP BY o_orderstatus"
    return transforms.run_hook(spark, text, {"target": "hook_orders"}, {"least": 100000})


# segments


def _as_rows(spark: SparkSession, found: list, kind: str) -> DataFrame:
    rows = [(i, r.low, r.high) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, f"bucket int, low {kind}, high {kind}")


@query(
    """WITH r AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders)
      SELECT CAST(i AS INTEGER) AS bucket, a + (b - a) * i // 7 AS low, CASE WHEN i = 6 THEN b + 1 ELSE a + (b - a) * (i + 1) // 7 END AS high
      FROM r, range(7) t(i)"""
)
def auto_buckets_int(spark, d):
    return _as_rows(spark, segments.expand(Auto("o_orderkey", 7), _orders(spark, d)), "long")


@query(
    """WITH r AS (SELECT min(CAST(round(o_totalprice) AS BIGINT)) AS a, max(CAST(round(o_totalprice) AS BIGINT)) AS b FROM orders)
      SELECT CAST(i AS INTEGER) AS bucket, CAST(a + (b - a) * i / 4.0 AS DOUBLE) AS low,
             CAST(CASE WHEN i = 3 THEN b + 1 ELSE a + (b - a) * (i + 1) / 4.0 END AS DOUBLE) AS high
      FROM r, range(4) t(i)"""
)
def auto_buckets_decimal(spark, d):
    orders = _orders(spark, d).withColumn("price", F.round("o_totalprice").cast("long").cast("decimal(18,0)"))
    found = segments.expand(Auto("price", 4), orders)
    rows = [(i, float(r.low), float(r.high)) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "bucket int, low double, high double")


@query(
    """WITH r AS (SELECT min(ts) AS a, epoch_us(max(ts)) - epoch_us(min(ts)) AS span, max(ts) AS b FROM events)
      SELECT CAST(i AS INTEGER) AS bucket, a + to_microseconds(span * i // 5) AS low,
             CASE WHEN i = 4 THEN b + INTERVAL 1 DAY ELSE a + to_microseconds(span * (i + 1) // 5) END AS high
      FROM r, range(5) t(i)"""
)
def auto_buckets_temporal(spark, d):
    return _as_rows(spark, segments.expand(Auto("ts", 5), X.load(spark, d, "events")), "timestamp_ntz")


MONTHS = """SELECT date_format(m, 'yyyy-MM') AS label, CAST(m AS TIMESTAMP_NTZ) AS range_start,
  CAST(add_months(m, 1) AS TIMESTAMP_NTZ) AS range_end, m >= DATE '1998-05-01' AS selected
  FROM (SELECT explode(sequence(DATE '1998-01-01', DATE '1998-07-01', INTERVAL 1 MONTH)) AS m)"""


@query(
    """SELECT strftime(m, '%Y-%m') AS label, count(o_orderkey) AS row_count
      FROM (SELECT unnest(generate_series(TIMESTAMP '1998-05-01', TIMESTAMP '1998-07-01', INTERVAL 1 MONTH)) AS m) t
      LEFT JOIN orders ON o_orderdate >= m AND o_orderdate < m + INTERVAL 1 MONTH GROUP BY m"""
)
def custom_segments(spark, d):
    found = segments.custom(spark, MONTHS, "o_orderdate")
    parts = [
        readers.reload(_orders(spark, d), Mapping(), s).rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("label"), "row_count")
        for name, s in segments.labelled(found).items()
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query(ORDERS_SQL)
def segmented_reload_union(spark, d):
    """All segments in one scan, each row marked with its own."""
    orders = _orders(spark, d)
    found = segments.expand(Auto("o_orderkey", 5), orders, ORDERS)
    rows = readers.reload_segments(orders, ORDERS, found).rows
    return _op(rows.drop(readers.SEGMENT))


# relationships


@query(
    """SELECT o_orderkey AS id, c_name AS customer, n_name AS nation, lower(c_mktsegment) AS segment, 'I' AS op
      FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey
      LEFT JOIN nation ON o_custkey % 25 = n_nationkey"""
)
def relationship_left_join(spark, d):
    orders = _orders(spark, d).withColumn("nation", (F.col("o_custkey") % 25).cast("int"))
    customer = Relationship("customer", X.load(spark, d, "customer").filter("c_custkey % 3 <> 0"), (("o_custkey", "c_custkey"),))
    nation = Relationship("nation", X.load(spark, d, "nation"), (("nation", "n_nationkey"),))
    unused = Relationship("region", X.load(spark, d, "region"), (("nation", "r_regionkey"),))
    columns = (
        ColumnMapping("o_orderkey", "id"),
        ColumnMapping("c_name", "customer", relationship="customer"),
        ColumnMapping("n_name", "nation", relationship="nation"),
        ColumnMapping("c_mktsegment", "segment", "lower({{column}})", "customer"),
    )
    return _op(readers.reload(orders, Mapping(columns, relationships=(customer, nation, unused))).rows)


# writers


def _staged_orders(spark: SparkSession, d: str) -> DataFrame:
    """The source's rows as staged changes: some are deletes, some are not there."""
    orders = _orders(spark, d).filter("o_orderkey % 3 <> 0").drop("o_orderpriority")
    return orders.withColumn(OPERATION, F.when(F.col("o_orderkey") % 10 == 1, "D").otherwise("U"))


STAGED = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 10 = 1 THEN 'D' ELSE 'U' END AS op FROM orders WHERE o_orderkey % 3 <> 0)"
_TAKEN = ", ".join(f"CASE WHEN s.op IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in ORDER_COLUMNS.split(", ")[:5])


@query(
    f"""SELECT {_TAKEN}, t.o_orderpriority FROM {X.STALE} t FULL JOIN {STAGED} s ON t.o_orderkey = s.o_orderkey
      WHERE s.op IS NULL OR s.op <> 'D'"""
)
def upsert_merge(spark, d):
    staged = writers.one_per_key(_staged_orders(spark, d), ["o_orderkey"])
    return writers.upsert(X.stale_orders(spark, d), staged, ["o_orderkey"])


@query(
    f"""SELECT {ORDER_COLUMNS} FROM {X.STALE} t WHERE NOT (o_orderkey >= 500 AND o_orderkey < 5000)
      UNION ALL SELECT s.o_orderkey, s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, t.o_orderpriority
      FROM (SELECT * FROM {STAGED} x WHERE op <> 'D' AND o_orderkey >= 500 AND o_orderkey < 5000) s
      LEFT JOIN {X.STALE} t ON s.o_orderkey = t.o_orderkey"""
)
def merge_reconcile_scope(spark, d):
    target, scope = X.stale_orders(spark, d), (F.col("o_orderkey") >= 500) & (F.col("o_orderkey") < 5000)
    return writers.merge_reconcile(target, _staged_orders(spark, d).filter(scope), ["o_orderkey"], scope)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 1 AND o_orderkey % 7 <> 0 AND o_orderkey < 500")
def merge_scope_collisions(spark, d):
    scope = F.col("o_orderkey") >= 500
    return writers.scope_collisions(X.stale_orders(spark, d), _staged_orders(spark, d), ["o_orderkey"], scope)


_LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate"


@query(
    f"""SELECT {_LINES} FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate >= TIMESTAMP '1997-01-01'
      UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 1, l_shipdate FROM lineitem
      WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_linenumber <> 2"""
)
def delete_insert_scope(spark, d):
    lines = X.load(spark, d, "lineitem").select(*_LINES.split(", "))
    segment = Range("l_shipdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1))
    scope = segments.target_scope(segment, Mapping(), lines)
    op = F.when(F.col("l_linenumber") == 2, "D").otherwise("I")
    staged = lines.filter(scope).withColumn("l_quantity", F.col("l_quantity") + 1).withColumn(OPERATION, op)
    return writers.delete_insert(lines, staged, scope)


@query(
    f"""SELECT k, v, CAST(TIMESTAMP '2024-01-01' AS TIMESTAMP) AS snapshot_at FROM {X.FEED} f WHERE seq <= 50
      UNION ALL SELECT k, v, {NOW_SQL} FROM {X.FEED} f WHERE seq > 50"""
)
def snapshot_append(spark, d):
    staged = X.staged_feed(X.feed(spark, d).filter("seq > 50"))
    target = writers.stamped(X.staged_feed(X.feed(spark, d).filter("seq <= 50")), dt.datetime(2024, 1, 1))
    return writers.snapshot(target, staged, NOW)


@query(
    f"""SELECT {ORDER_COLUMNS} FROM {X.STALE} t
      WHERE NOT (o_totalprice > 50000) OR EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = t.o_orderkey)"""
)
def key_reconcile_delete(spark, d):
    keys = readers.keys_only(_orders(spark, d), Mapping(), ["o_orderkey"]).rows
    scope = F.col("o_totalprice") > 50000
    return writers.reconcile_deletes(X.stale_orders(spark, d), keys, ["o_orderkey"], scope, writers.Guard("ratio", 0.5))


@query(
    f"""SELECT count(*) AS scope_rows, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS deleted_rows
      FROM {X.STALE} t WHERE o_totalprice > 50000"""
)
def delete_guard_counts(spark, d):
    keys = readers.keys_only(_orders(spark, d), Mapping(), ["o_orderkey"]).rows
    return writers.guard_counts(X.stale_orders(spark, d), keys, ["o_orderkey"], F.col("o_totalprice") > 50000)


@query(f"SELECT {ORDER_COLUMNS} FROM {X.STALE} t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def missing_keys(spark, d):
    return writers.missing_keys(X.stale_orders(spark, d), _orders(spark, d), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS \"rows\" FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return writers.duplicate_keys(X.load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT k, v, op FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {X.FEED_NULLS} f) WHERE r = 1")
def last_staged_per_key(spark, d):
    return _op(writers.one_per_key(X.staged_feed(X.feed(spark, d, nulls=True)), ["k"])).select("k", "v", "op")


@query("SELECT 'U' AS op, count(*) AS \"rows\" FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 1 UNION ALL SELECT 'D', count(*) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 = 1")
def rows_by_operation(spark, d):
    return _op(writers.written(_staged_orders(spark, d)))


@query(
    """SELECT CAST(i AS INTEGER) AS place, name, kind, is_key, (SELECT count(*) FROM orders) AS filled FROM (VALUES (0, 'id', 'bigint', true), (1, 'customer', 'bigint', false),
      (2, 'status', 'string', false), (3, 'total', 'decimal(12,2)', false)) t(i, name, kind, is_key)"""
)
def provision_create(spark, d):
    """A created table takes all rows in its own types."""
    plan = provision.create_plan(_orders(spark, d), ORDERS, {"total": "decimal(12,2)"})
    table = provision.create(spark, plan)
    rows = readers.reload(_orders(spark, d), ORDERS).rows.drop(OPERATION)
    loaded = table.unionByName(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]))
    told = [(f.name, i, f.dataType.simpleString(), f.name in plan.keys) for i, f in enumerate(table.schema)]
    return _filled(loaded, told, "name string, place int, kind string, is_key boolean")


@query(
    """SELECT o_orderkey AS id, o_custkey AS customer, lower(o_orderstatus) AS state, CAST(round(o_totalprice) AS DECIMAL(12,0)) AS total,
      CAST(NULL AS VARCHAR) AS note FROM orders"""
)
def provision_alter(spark, d):
    target = readers.reload(_orders(spark, d), ORDERS).rows.drop(OPERATION).withColumn("total", F.round("total"))
    wanted = provision.create_plan(target.withColumnRenamed("status", "state").withColumn("note", F.lit("")), Mapping(), {"total": "decimal(12,0)"}).schema
    return provision.alter(target, provision.alter_plan(target, wanted, {"status": "state"}))


# tables in buckets: only what a pass touches is written


def _buckets(spark: SparkSession, rows: DataFrame, keys: list[str], buckets: int = 32) -> KeyedTable:
    """A table with these rows, loaded by a first pass."""
    table = KeyedTable.create(spark, f"{_place(spark)}/table", rows.schema, keys, buckets)
    table.apply(writers.with_operation(rows), lambda _, staged: staged.drop(OPERATION))
    return table


@query(ORACLE_SQL["upsert_merge"])
def upsert_by_bucket(spark, d):
    table = _buckets(spark, X.stale_orders(spark, d), ["o_orderkey"])
    table.upsert(_staged_orders(spark, d))
    return table.read()


@query(
    f"""SELECT 1 AS buckets_written, count(*) AS row_count, CAST(sum(CAST(round(CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM {X.STALE} m) THEN 1 ELSE o_totalprice END * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM {X.STALE} t"""
)
def upsert_one_bucket(spark, d):
    """A pass of one key writes one of the buckets, and the table has all rows with the change."""
    stale = X.stale_orders(spark, d)
    table = _buckets(spark, stale, ["o_orderkey"])
    names = lambda: {b: table.folder.names(b) for b in table.folder.names("") if b.startswith(BUCKET)}
    before, last = names(), stale.agg(F.max("o_orderkey")).first()[0]
    table.upsert(stale.filter(F.col("o_orderkey") == last).withColumn("o_totalprice", F.lit(1.0)).withColumn(OPERATION, F.lit("U")))
    written = sum(before.get(b) != found for b, found in names().items())
    return table.read().agg(F.lit(written).alias("buckets_written"), F.count("*").alias("row_count"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query(ORACLE_SQL["merge_reconcile_scope"])
def merge_reconcile_by_bucket(spark, d):
    scope = (F.col("o_orderkey") >= 500) & (F.col("o_orderkey") < 5000)
    table = _buckets(spark, X.stale_orders(spark, d), ["o_orderkey"])
    table.merge_reconcile(_staged_orders(spark, d).filter(scope), scope)
    return table.read()


@query(ORACLE_SQL["delete_insert_scope"])
def delete_insert_by_bucket(spark, d):
    lines = X.load(spark, d, "lineitem").select(*_LINES.split(", "))
    table = _buckets(spark, lines, ["l_orderkey"])
    scope = segments.target_scope(Range("l_shipdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1)), Mapping(), lines)
    op = F.when(F.col("l_linenumber") == 2, "D").otherwise("I")
    table.delete_insert(lines.filter(scope).withColumn("l_quantity", F.col("l_quantity") + 1).withColumn(OPERATION, op), scope)
    return table.read()


@query(ORACLE_SQL["key_reconcile_delete"])
def key_reconcile_by_bucket(spark, d):
    table = _buckets(spark, X.stale_orders(spark, d), ["o_orderkey"])
    keys = readers.keys_only(_orders(spark, d), Mapping(), ["o_orderkey"]).rows
    table.reconcile_deletes(keys, F.col("o_totalprice") > 50000, writers.Guard("ratio", 0.5))
    return table.read()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders")
def snapshot_schema_growth(spark, d):
    """An append with a new column: it is null in the rows that were there before."""
    table, orders = VersionedTable(spark, f"{_place(spark)}/table"), _orders(spark, d)
    table.publish(orders.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey"))
    table.append(orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderpriority", "o_custkey"))
    return table.read()


# typed staging

_TARGET = T.StructType(
    [
        T.StructField("id", T.LongType(), False), T.StructField("customer", T.ShortType()), T.StructField("half", T.IntegerType()),
        T.StructField("day", T.DateType(), False), T.StructField("note", T.VarcharType(6)), T.StructField("whole", T.IntegerType()),
    ]
)
_AS_TEXT = """(SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey * 100 AS customer, o_custkey / 2.0 AS half,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '1996-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderpriority AS note,
  CASE o_orderkey % 5 WHEN 0 THEN '12' WHEN 1 THEN '12.5' WHEN 2 THEN 'twelve' WHEN 3 THEN '99999999999' END AS whole FROM orders)"""


def _as_text(spark: SparkSession, d: str) -> DataFrame:
    """orders as they might come from a text file, some with values that the target can't hold."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    whole = F.when(key % 5 == 0, "12").when(key % 5 == 1, "12.5").when(key % 5 == 2, "twelve").when(key % 5 == 3, "99999999999")
    return _orders(spark, d).select(
        key.cast("string").alias("id"), (F.col("o_custkey") * 100).alias("customer"), (F.col("o_custkey") / 2).cast("double").alias("half"),
        F.when(key % 17 == 0, None).when(key % 19 == 0, "1996-13-45").otherwise(day).alias("day"), F.col("o_orderpriority").alias("note"), whole.alias("whole"),
    )


_REASONS = """CASE WHEN customer > 32767 THEN 'not of the type' END AS customer, CASE WHEN day IS NULL THEN 'null' WHEN day = '1996-13-45' THEN 'not of the type' END AS day,
  CASE WHEN length(note) > 6 THEN 'too long' END AS note, CASE WHEN floor(half) <> half THEN 'inexact' END AS half, CASE WHEN whole <> '12' THEN 'not of the type' END AS whole"""


@query(
    f"""SELECT "column", reason, count(*) AS "values" FROM (
      SELECT unnest(['customer', 'day', 'note', 'half', 'whole']) AS "column", unnest([customer, day, note, half, whole]) AS reason FROM (SELECT {_REASONS} FROM {_AS_TEXT} t))
      WHERE reason IS NOT NULL GROUP BY 1, 2"""
)
def staging_refusals(spark, d):
    """How many values of each column the target can't hold, and why."""
    return typed.refusals(_as_text(spark, d), _TARGET)


@query(
    f"""SELECT CAST(t.id AS BIGINT) AS id, CAST(t.customer AS SMALLINT) AS customer, CAST(t.half AS INTEGER) AS half, CAST(t.day AS DATE) AS day, t.note, CAST(t.whole AS INTEGER) AS whole
      FROM {_AS_TEXT} t WHERE t.customer <= 32767 AND floor(t.half) = t.half AND t.day IS NOT NULL AND t.day <> '1996-13-45' AND length(t.note) <= 6 AND (t.whole IS NULL OR t.whole = '12')"""
)
def staging_typed(spark, d):
    """The rows that fit, in the target's types; a strict pass over them finds nothing to refuse."""
    good, _ = typed.split(_as_text(spark, d), _TARGET)
    return typed.strict(good, _TARGET)


# slowly changing dimensions

_VERSIONS = "version_key, k, v, valid_from, valid_to, is_current"
_SECOND_LAST = f"(SELECT k, v, op, seq, changed_at FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {X.FEED_NULLS} f WHERE seq > {X.HALF}) x WHERE r = 1)"


def _second(spark: SparkSession, d: str) -> DataFrame:
    return X.staged_feed(X.feed(spark, d, nulls=True).filter(F.col("seq") > X.half(spark, d)))


@query(
    f"""SELECT t.version_key, t.k, t.v, t.valid_from,
        CASE WHEN s.op = 'D' OR s.k IS NOT NULL AND s.v IS DISTINCT FROM t.v THEN {NOW_SQL} ELSE t.valid_to END AS valid_to,
        NOT coalesce(s.op = 'D' OR s.k IS NOT NULL AND s.v IS DISTINCT FROM t.v, false) AS is_current
      FROM {X.OPEN} t LEFT JOIN {_SECOND_LAST} s ON t.k = s.k
      UNION ALL
      SELECT '20240601123015250-' || CAST(s.k AS VARCHAR), s.k, s.v, {NOW_SQL}, NULL, true
      FROM {_SECOND_LAST} s LEFT JOIN {X.OPEN} t ON t.k = s.k AND t.v IS NOT DISTINCT FROM s.v WHERE s.op <> 'D' AND t.k IS NULL"""
)
def scd2_close_open(spark, d):
    staged = writers.one_per_key(_second(spark, d), ["k"]).drop(ORDERING, CHANGED_AT)
    return scd2.apply(X.open_versions(spark, d), staged, ["k"], ["v"], NOW).select(*_VERSIONS.split(", "))


@query(ORACLE_SQL["scd2_close_open"])
def scd2_by_bucket(spark, d):
    """The same pass over a dimension in buckets of its key."""
    table = _buckets(spark, X.open_versions(spark, d), ["k"])
    staged = writers.one_per_key(_second(spark, d), ["k"]).drop(ORDERING, CHANGED_AT)
    table.apply(staged, lambda target, rows: scd2.apply(target, rows, ["k"], ["v"], NOW))
    return table.read().select(*_VERSIONS.split(", "))


@query(f"SELECT k, count(*) AS \"rows\" FROM {X.FEED} f WHERE seq > {X.HALF} GROUP BY k HAVING count(*) > 1")
def scd2_duplicate_keys(spark, d):
    return writers.duplicate_keys(_second(spark, d), ["k"])


def _chain(staged: str, target: str) -> str:
    """The edges of versions as SQL: staged has k, v, op, seq, changed_at."""
    return f"""
      numbered AS (SELECT s.*, row_number() OVER w AS nth, lag(op) OVER w AS op_before, lag(v) OVER w AS v_before
        FROM {staged} s WINDOW w AS (PARTITION BY k ORDER BY seq)),
      marked AS (SELECT n.*, n.op <> 'D' AND CASE WHEN nth = 1 THEN NOT (t.k IS NOT NULL AND t.v IS NOT DISTINCT FROM n.v)
          ELSE op_before = 'D' OR n.v IS DISTINCT FROM v_before END AS opens
        FROM numbered n LEFT JOIN (SELECT * FROM {target} o WHERE is_current) t ON nth = 1 AND t.k = n.k),
      edges AS (SELECT *, lead(changed_at) OVER w AS next_at, row_number() OVER w AS edge FROM marked WHERE opens OR op = 'D'
        WINDOW w AS (PARTITION BY k ORDER BY seq))"""


_NEW = "lpad(hex(seq), 20, '0') || lpad('0', 20, '0') || '|' || CAST(k AS VARCHAR)"


@query(
    f"""WITH {_chain(f"(SELECT * FROM {X.FEED_NULLS} f WHERE seq > {X.HALF})", X.OPEN)}
      SELECT t.version_key, t.k, t.v, t.valid_from, coalesce(e.changed_at, t.valid_to) AS valid_to, e.k IS NULL AS is_current
      FROM {X.OPEN} t LEFT JOIN (SELECT * FROM edges WHERE edge = 1) e ON t.k = e.k
      UNION ALL SELECT {_NEW}, k, v, changed_at, next_at, next_at IS NULL FROM edges WHERE opens"""
)
def scd2_multi_version(spark, d):
    return scd2.many_versions(X.open_versions(spark, d), _second(spark, d), ["k"], ["v"]).select(*_VERSIONS.split(", "))


@query(
    f"""WITH {_chain(X.FEED_NULLS, f"(SELECT * FROM {X.OPEN} p WHERE false)")}
      SELECT {_NEW} AS version_key, k, v, changed_at AS valid_from, next_at AS valid_to, next_at IS NULL AS is_current FROM edges WHERE opens"""
)
def scd2_history(spark, d):
    staged = X.staged_feed(X.feed(spark, d, nulls=True))
    target = scd2.empty_target(staged, ["k"], ["v"])
    return scd2.apply(target, staged, ["k"], ["v"], NOW).select(*_VERSIONS.split(", "))


_TAIL = f"(SELECT * FROM {X.FEED_NULLS} f WHERE seq > {X.HALF})"


@query(
    f"""WITH counted AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {_TAIL} f),
      {_chain("(SELECT * FROM counted WHERE n > 1)", X.OPEN)},
      once AS (SELECT * FROM counted WHERE n = 1),
      closed AS (
        SELECT t.version_key, t.k, t.v, t.valid_from,
          CASE WHEN s.op = 'D' OR s.k IS NOT NULL AND s.v IS DISTINCT FROM t.v THEN s.changed_at
               WHEN e.k IS NOT NULL THEN e.changed_at ELSE t.valid_to END AS valid_to,
          NOT coalesce(s.op = 'D' OR s.k IS NOT NULL AND s.v IS DISTINCT FROM t.v, false) AND e.k IS NULL AS is_current
        FROM {X.OPEN} t LEFT JOIN once s ON t.k = s.k LEFT JOIN (SELECT * FROM edges WHERE edge = 1) e ON t.k = e.k)
      SELECT * FROM closed
      UNION ALL SELECT '20240601123015250-' || CAST(s.k AS VARCHAR), s.k, s.v, s.changed_at, NULL, true
      FROM once s LEFT JOIN {X.OPEN} t ON t.k = s.k AND t.v IS NOT DISTINCT FROM s.v WHERE s.op <> 'D' AND t.k IS NULL
      UNION ALL SELECT {_NEW}, k, v, changed_at, next_at, next_at IS NULL FROM edges WHERE opens"""
)
def scd2_mixed_pass(spark, d):
    return scd2.apply(X.open_versions(spark, d), _second(spark, d), ["k"], ["v"], NOW).select(*_VERSIONS.split(", "))


@query(
    f"""SELECT version_key, k, v, valid_from, CASE WHEN k % 4 = 1 AND k < (SELECT max(user_id) // 2 FROM events) THEN {NOW_SQL} ELSE valid_to END AS valid_to,
      NOT (k % 4 = 1 AND k < (SELECT max(user_id) // 2 FROM events)) AS is_current FROM {X.OPEN} t"""
)
def scd2_reconcile_close(spark, d):
    keys = X.feed(spark, d).filter("k % 4 <> 1").select("k")
    middle = X.feed(spark, d).agg(F.max("k")).first()[0] // 2
    return scd2.reconcile_close(X.open_versions(spark, d), keys, ["k"], NOW, F.col("k") < middle, writers.Guard("ratio", 0.9))


@query(
    f"""WITH {_chain(X.FEED_NULLS, f"(SELECT * FROM {X.OPEN} p WHERE false)")}
      SELECT k, v FROM edges WHERE opens AND next_at IS NULL"""
)
def scd2_current_only(spark, d):
    return scd2.current_only(scd2_history(spark, d)).select("k", "v")


# verification

CENTS = Mapping((ColumnMapping("o_orderstatus", "status"), ColumnMapping("o_totalprice", "cents", "cast(round({{column}} * 100) as bigint)"), ColumnMapping("o_custkey", "customer")))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    stale = X.stale_orders(spark, d)
    return stale.select(
        F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_custkey").alias("customer")
    )


_SIDES = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _compared(group: str, measures: dict[str, str], off: str, where: str = "true") -> str:
    """Grouped sides of orders and the stale copy, compared, as SQL."""
    sums = ", ".join(f"CAST({e} AS DOUBLE) AS {m}" for m, e in measures.items())
    shown = ", ".join(f"s.{m} AS {m}_source, t.{m} AS {m}_target, coalesce(t.{m}, 0) - coalesce(s.{m}, 0) AS {m}_difference" for m in measures)
    return f"""SELECT coalesce(s.g, t.g) AS grp, {shown},
      CASE WHEN t.g IS NULL THEN 'MissingFromTarget' WHEN s.g IS NULL THEN 'MissingFromSource' WHEN {off} THEN 'Differs' ELSE 'Match' END AS status
      FROM (SELECT {group} AS g, {sums} FROM orders GROUP BY 1) s
      FULL JOIN (SELECT {group} AS g, {sums} FROM {X.STALE} x WHERE {where} GROUP BY 1) t ON s.g = t.g"""


@query(_compared("o_orderstatus", {"row_count": "count(*)"}, "s.row_count <> t.row_count"))
def verify_rowcount(spark, d):
    source = verify.source_side(_orders(spark, d), CENTS, ["status"])
    found = verify.compare(source, verify.target_side(_checked(spark, d), ["status"]), ["status"], [verify.ROWS])
    return _grouped(found)


def _grouped(found: DataFrame) -> DataFrame:
    """Renames the group column, which here is called like the status."""
    return found.toDF("grp", *found.columns[1:])


@query(_compared("o_orderstatus", {"cents": f"sum({_SIDES})", "customer": "sum(o_custkey)"}, "abs(t.cents - s.cents) / greatest(s.cents, t.cents) > 0.05 OR abs(t.customer - s.customer) / greatest(s.customer, t.customer) > 0.05"))
def verify_sum_multi(spark, d):
    names = ["cents", "customer"]
    source = verify.source_side(_orders(spark, d), CENTS, ["status"], names)
    target = verify.target_side(_checked(spark, d), ["status"], names)
    return _grouped(verify.compare(source, target, ["status"], names, 0.05))


@query(_compared("CAST(o_orderkey AS VARCHAR)", {"cents": f"sum({_SIDES})"}, "s.cents <> t.cents"))
def verify_status_full(spark, d):
    source = verify.grouped(_orders(spark, d), {"grp": F.col("o_orderkey")}, {"cents": F.round(F.col("o_totalprice") * 100).cast("bigint")})
    target = verify.grouped(X.stale_orders(spark, d), {"grp": F.col("o_orderkey")}, {"cents": F.round(F.col("o_totalprice") * 100).cast("bigint")})
    return verify.compare(source, target, ["grp"], ["cents"])


@query(_compared("o_orderpriority", {"cents": f"max({_SIDES})"}, "s.cents <> t.cents"))
def verify_sql_check(spark, d):
    _orders(spark, d).createOrReplaceTempView("v_source")
    X.stale_orders(spark, d).createOrReplaceTempView("v_target")
    text = "SELECT o_orderpriority AS grp, max(cast(round(o_totalprice * 100) as bigint)) AS cents FROM {} GROUP BY 1"
    target = text.format("v_target")
    target = verify.scripted_side(lambda: spark.sql(target), ["grp"], ["cents"])
    return verify.compare(verify.sql_side(spark, text.format("v_source"), ["grp"], ["cents"]), target, ["grp"], ["cents"])


@query(f"SELECT count(*) AS groups, count(*) FILTER (WHERE status <> 'Match') AS differing FROM ({_compared('CAST(o_orderkey AS VARCHAR)', {'cents': f'sum({_SIDES})'}, 's.cents <> t.cents')})")
def verify_summary(spark, d):
    return verify.summary(verify_status_full(spark, d))


@query(f"SELECT * FROM ({_compared('CAST(o_orderkey AS VARCHAR)', {'cents': f'sum({_SIDES})'}, 's.cents <> t.cents')}) WHERE status <> 'Match' ORDER BY grp LIMIT 40 OFFSET 20")
def verify_page(spark, d):
    return verify.page(verify_status_full(spark, d), ["grp"], 20, 40, differing=True)


@query(
    f"""SELECT count(v) AS n FROM ({f"WITH {_chain(X.FEED_NULLS, f'(SELECT * FROM {X.OPEN} p WHERE false)')} SELECT coalesce(v, '') AS v, count(*) AS n FROM edges WHERE opens AND next_at IS NULL GROUP BY 1"})"""
)
def verify_current_only(spark, d):
    side = verify.target_side(scd2_history(spark, d), ["v"], only_current=True)
    return side.agg(F.count("v").alias("n"))


@query(
    f"""SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra'
      WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'different' ELSE 'matched' END AS kind
      FROM orders s FULL JOIN {X.STALE} t ON s.o_orderkey = t.o_orderkey"""
)
def row_diff(spark, d):
    return verify.row_difference(_orders(spark, d), X.stale_orders(spark, d), ["o_orderkey"])


@query(ORACLE_SQL["row_diff"])
def row_diff_checksums(spark, d):
    """The same differences from checksums of key ranges: rows meet only in ranges that differ."""
    return verify.checked_difference(_orders(spark, d), X.stale_orders(spark, d), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'different' ELSE 'matched' END AS kind FROM orders")
def row_diff_one_change(spark, d):
    """One changed row of the whole table: only the rows of its range meet, all others match by checksum."""
    orders = _orders(spark, d)
    last = orders.agg(F.max("o_orderkey")).first()[0]
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == last, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return verify.checked_difference(orders, changed, ["o_orderkey"])


@query(f"SELECT o_orderkey AS gap_after, nxt AS gap_before FROM (SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM {X.STALE} t) WHERE nxt > o_orderkey + 1")
def gap_finder(spark, d):
    return verify.gaps(X.stale_orders(spark, d), "o_orderkey")


@query(f"SELECT {ORDER_COLUMNS} FROM {X.STALE} t")
def drift_fixture(spark, d):
    return X.stale_orders(spark, d)


# reports


@query(
    f"""SELECT mapping, count(*) AS runs, count(*) FILTER (WHERE status = 'Succeeded') AS succeeded, count(*) FILTER (WHERE status = 'Failed') AS failed,
      CAST(coalesce(sum(rows_read), 0) AS BIGINT) AS rows_read, CAST(coalesce(sum(rows_written), 0) AS BIGINT) AS rows_written FROM {X.RUNS} r GROUP BY mapping"""
)
def run_totals(spark, d):
    return metrics.totals(X.runs(spark, d), "mapping")


@query(
    f"""SELECT mapping, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY rows_read) AS DOUBLE) AS p50,
      CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY rows_read) AS DOUBLE) AS p95, CAST(max(rows_read) AS DOUBLE) AS max FROM {X.RUNS} r GROUP BY mapping"""
)
def run_percentiles(spark, d):
    return metrics.percentiles(X.runs(spark, d), "rows_read", "mapping")


@query(
    f"""SELECT CAST(i AS INTEGER) AS bucket, coalesce(n, 0) AS runs, coalesce(f, 0) AS failed, coalesce(w, 0) AS rows_written FROM range(30) t(i) LEFT JOIN (
      SELECT least(greatest((epoch_us(started_at) - epoch_us(TIMESTAMP '2024-01-02')) // 86400000000, 0), 29) AS b, count(*) AS n,
        count(*) FILTER (WHERE status = 'Failed') AS f, CAST(sum(rows_written) AS BIGINT) AS w
      FROM {X.RUNS} r WHERE started_at >= TIMESTAMP '2024-01-02' AND started_at < TIMESTAMP '2024-02-01' GROUP BY 1) ON b = i"""
)
def run_histogram(spark, d):
    return metrics.histogram(X.runs(spark, d), "started_at", dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 1), 30)


@query(
    f"""SELECT batch_id, segments, succeeded, failed, CASE WHEN succeeded + failed < segments THEN 'Running' WHEN failed > 0 THEN 'CompletedWithFailures' ELSE 'Completed' END AS state
      FROM (SELECT batch_id, 50 AS segments, count(*) FILTER (WHERE status = 'Succeeded') AS succeeded, count(*) FILTER (WHERE status = 'Failed') AS failed
        FROM {X.RUNS} r WHERE ended_at IS NOT NULL OR batch_id % 2 = 0 GROUP BY batch_id)"""
)
def batch_progress(spark, d):
    runs = X.runs(spark, d)
    done = runs.filter("ended_at IS NOT NULL OR batch_id % 2 = 0").select("batch_id", "status")
    return metrics.batch_progress(runs.select("batch_id", F.lit(50).alias("segments")).distinct(), done)


@query(f"SELECT mapping, max(ended_at) AS last_completed FROM {X.RUNS} r WHERE status = 'Succeeded' GROUP BY mapping")
def last_completed(spark, d):
    return metrics.last_completed(X.runs(spark, d), "mapping")


@query(f"SELECT mapping, max(enqueued_at) AS latest_enqueued FROM {X.RUNS} r GROUP BY mapping")
def latest_enqueued(spark, d):
    return metrics.latest_enqueued(X.runs(spark, d), "mapping")


@query(
    f"""SELECT r.mapping, CAST(sum(rows_read) AS BIGINT) AS rows_read FROM {X.RUNS} r
      JOIN (SELECT mapping, min(ended_at) + INTERVAL 2 DAY AS since FROM {X.RUNS} x GROUP BY mapping) c ON r.mapping = c.mapping AND ended_at > since GROUP BY r.mapping"""
)
def rows_since_cutoff(spark, d):
    runs = X.runs(spark, d)
    cutoffs = runs.groupBy("mapping").agg((F.min("ended_at") + F.expr("INTERVAL 2 DAYS")).alias("since"))
    return metrics.read_since(runs, cutoffs, "mapping")


@query(
    f"""SELECT run_id, mapping FROM (SELECT *, row_number() OVER (PARTITION BY task, mapping ORDER BY enqueued_at DESC, run_id DESC) AS r FROM {X.RUNS} x WHERE ended_at IS NOT NULL)
      WHERE r > 40 OR enqueued_at < TIMESTAMP '2024-01-03'"""
)
def retention_doomed(spark, d):
    return metrics.doomed(X.runs(spark, d), ["task", "mapping"], dt.datetime(2024, 1, 3), 40).select("run_id", "mapping")


@query(
    f"""SELECT run_id, mapping FROM (SELECT *, row_number() OVER (PARTITION BY task, mapping, ended_at IS NOT NULL ORDER BY enqueued_at DESC, run_id DESC) AS r FROM {X.RUNS} x)
      WHERE r <= 25 OR ended_at IS NULL"""
)
def retention_kept(spark, d):
    return metrics.retained(X.runs(spark, d), ["task", "mapping"], None, 25).select("run_id", "mapping")


@query(
    f"""SELECT run_id, enqueued_at FROM {X.RUNS} r WHERE enqueued_at < TIMESTAMP '2024-01-10' OR enqueued_at = TIMESTAMP '2024-01-10' AND run_id < 77
      ORDER BY enqueued_at DESC, run_id DESC LIMIT 26"""
)
def keyset_page(spark, d):
    return metrics.keyset_page(X.runs(spark, d), "enqueued_at", "run_id", 25, (dt.datetime(2024, 1, 10), 77)).select("run_id", "enqueued_at")


@query(f"SELECT run_id, status FROM {X.RUNS} r WHERE run_id > 321")
def feed_since(spark, d):
    return metrics.feed(X.runs(spark, d), "run_id", 321).select("run_id", "status")


@query("SELECT u AS user, u * 13 AS seen, (SELECT count(*) FROM events WHERE event_id > u * 13) AS unread FROM (SELECT DISTINCT user_id AS u FROM events) t")
def unread_counts(spark, d):
    cursors = X.load(spark, d, "events").select(F.col("user_id").alias("user"), (F.col("user_id") * 13).alias("seen")).distinct()
    return metrics.unread(X.load(spark, d, "events").select(F.col("event_id").alias("id")), cursors)


@query(
    f"""SELECT item_id, mapping, priority FROM {X.QUEUE} q WHERE state = 'Pending' AND available_at <= TIMESTAMP '2024-01-20'
      AND NOT EXISTS (SELECT 1 FROM {X.QUEUE} b WHERE b.mapping = q.mapping AND coalesce(b.segment, '') = coalesce(q.segment, '') AND b.state IN ('Claimed', 'Running'))
      ORDER BY priority DESC, enqueued_at, item_id LIMIT 1"""
)
def queue_claim(spark, d):
    return metrics.claim(X.queue(spark, d), dt.datetime(2024, 1, 20)).select("item_id", "mapping", "priority")


@query(
    f"""WITH q AS (SELECT *, coalesce(segment, '') AS part FROM {X.QUEUE} x),
      flying AS (SELECT mapping, part FROM q WHERE item_id <= {X.HALF} AND state IN ('Pending', 'Claimed', 'Running')),
      fresh AS (SELECT *, row_number() OVER (PARTITION BY mapping, part ORDER BY item_id) AS r FROM q WHERE item_id > {X.HALF}
        AND NOT EXISTS (SELECT 1 FROM flying b WHERE b.mapping = q.mapping AND b.part = q.part))
      SELECT item_id, mapping, segment FROM q WHERE item_id <= {X.HALF} UNION ALL SELECT item_id, mapping, segment FROM fresh WHERE r = 1"""
)
def queue_put(spark, d):
    queue, last = X.queue(spark, d), X.half(spark, d)
    return metrics.put(queue.filter(F.col("item_id") <= last), queue.filter(F.col("item_id") > last)).select("item_id", "mapping", "segment")


@query(
    f"""SELECT mapping, coalesce(segment, '') AS part, min(item_id) AS item_id FROM {X.QUEUE} q GROUP BY 1, 2"""
)
def queue_put_conflicts(spark, d):
    """An empty queue takes one item of each mapping and segment, however many come."""
    queue = X.queue(spark, d)
    found = metrics.put(metrics.put(queue.limit(0), queue).withColumn("state", F.lit("Running")), queue)
    return found.select("mapping", F.coalesce("segment", F.lit("")).alias("part"), "item_id")


@query(f"SELECT DISTINCT task, mapping FROM {X.RUNS} r")
def distinct_tasks(spark, d):
    return X.runs(spark, d).select("task", "mapping").distinct()


@query(
    f"""SELECT k, greatest((epoch_us((SELECT max(changed_at) FROM {X.FEED} f)) - epoch_us(max(changed_at))) // 1000, 0) AS lag_ms FROM {X.FEED} g GROUP BY k"""
)
def lag_exact(spark, d):
    feed = X.feed(spark, d)
    head = feed.agg(F.max("changed_at").alias("source_at"))
    positions = feed.groupBy("k").agg(F.max("changed_at").alias("applied_at")).join(F.broadcast(head))
    return metrics.exact_lag(positions).select("k", "lag_ms")


@query(
    """SELECT id, id * 37 AS target, CASE WHEN id * 37 > (SELECT min(event_id) FROM events) THEN (SELECT min(ts) FROM events WHERE event_id >= id * 37) END AS crossed_at
      FROM (SELECT DISTINCT user_id AS id FROM events)"""
)
def lag_first_crossing(spark, d):
    events = X.load(spark, d, "events")
    positions = events.select(F.col("user_id").alias("id"), (F.col("user_id") * 37).alias("target")).distinct()
    return metrics.first_crossing(events.select(F.col("event_id").alias("value"), F.col("ts").alias("at")), positions)


_CHECKS = "(SELECT event_id % 5 AS grp, event_id AS value, ts AS seen_at, CASE WHEN event_id % 3 <> 0 THEN ts - INTERVAL 1 MINUTE END AS source_at FROM events)"
_APPLIED = """(SELECT u AS id, u % 6 AS grp, CASE u % 4 WHEN 0 THEN 'log' WHEN 3 THEN 'full' ELSE 'version' END AS kind, CASE WHEN u % 13 <> 0 THEN u * 37 END AS applied,
  CASE WHEN u % 5 <> 0 THEN first + to_minutes(u) END AS applied_at FROM (SELECT DISTINCT user_id AS u FROM events), (SELECT min(ts) AS first FROM events))"""
_MS = "greatest((epoch_us({1}) - epoch_us({0})) // 1000, 0)"


@query(
    f"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seen_at DESC, value DESC) AS r FROM {_CHECKS} c) WHERE r = 1),
      timed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seen_at DESC, value DESC) AS r FROM {_CHECKS} c WHERE source_at IS NOT NULL) WHERE r = 1),
      met AS (SELECT p.*, l.value AS version, l.seen_at AS last_at, l.source_at AS last_source, t.source_at AS timed_at, kind <> 'full' AS supported,
          CASE WHEN applied IS NULL OR kind = 'full' THEN NULL WHEN kind = 'log' THEN t.source_at ELSE l.source_at END AS source_time
        FROM {_APPLIED} p LEFT JOIN last l ON l.grp = p.grp LEFT JOIN timed t ON t.grp = p.grp)
      SELECT id, supported, CASE WHEN source_time IS NOT NULL AND applied_at IS NOT NULL THEN {_MS.format('applied_at', 'source_time')} END AS exact_ms,
        CASE WHEN kind = 'version' AND applied IS NOT NULL AND version IS NOT NULL THEN greatest(version - applied, 0) END AS versions_behind,
        CASE WHEN kind = 'version' AND applied IS NOT NULL AND (source_time IS NULL OR applied_at IS NULL) AND last_at IS NOT NULL AND crossed_at IS NOT NULL
          THEN {_MS.format('crossed_at', 'last_at')} END AS estimated_ms,
        CASE WHEN applied IS NULL OR kind = 'full' THEN NULL WHEN kind = 'log' THEN timed_at ELSE coalesce(last_source, last_at) END AS as_of
      FROM (SELECT *, (SELECT min(c.seen_at) FROM {_CHECKS} c WHERE c.grp = met.grp AND c.value >= met.applied) AS crossed_at FROM met)"""
)
def reader_lag(spark, d):
    """Exact, in versions, estimated or unknown: one answer for each mapping."""
    events = X.load(spark, d, "events")
    at = F.when(F.col("event_id") % 3 != 0, F.col("ts") - F.expr("INTERVAL 1 MINUTE"))
    checks = events.select((F.col("event_id") % 5).alias("grp"), F.col("event_id").alias("value"), F.col("ts").alias("at"), at.alias("source_at"))
    first, u = events.agg(F.min("ts").alias("first")), F.col("u")
    kind = F.when(u % 4 == 0, "log").when(u % 4 == 3, "full").otherwise("version")
    positions = events.select(F.col("user_id").alias("u")).distinct().join(F.broadcast(first)).select(
        u.alias("id"), (u % 6).alias("grp"), kind.alias("kind"), F.when(u % 13 != 0, u * 37).alias("applied"),
        F.when(u % 5 != 0, F.expr("timestampadd(MINUTE, u, first)")).alias("applied_at"),
    )
    return metrics.reader_lag(positions, checks)


# state and streams: the final state of a run against the batch result


def _place(spark: SparkSession) -> str:
    """A new folder in the shared place of the session's scratch tables."""
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="tidewell-state-")
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root}/state-{uuid.uuid4().hex}"


@query(f"SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM {X.FEED} f) WHERE r = 1 AND op <> 'D'")
def stream_foreachbatch_merge(spark, d):
    place, feed = _place(spark), X.staged_feed(X.feed(spark, d))
    ids = F.conv(F.substring(ORDERING, 1, 20), 16, 10).cast("long")
    size = (feed.agg(F.max(ids)).first()[0] or 0) // 3 + 1
    for part in range(3):
        feed.filter((ids >= part * size) & (ids < (part + 1) * size)).write.mode("append").parquet(f"{place}/changes/part={part}")
    table = VersionedTable(spark, f"{place}/table")
    table.publish(feed.select("k", "v").limit(0))
    apply = lambda target, batch: writers.upsert(target, writers.one_per_key(batch, ["k"]), ["k"])
    # the folders one after the other, each in batches of so many files: the writer orders a batch
    for part in range(3):
        stream = continuous.change_stream(spark, f"{place}/changes/part={part}", feed.schema, files=1024)
        continuous.start(stream, table, apply, f"{place}/checkpoint-{part}", name=f"part {part}").awaitTermination()
    return table.read()


@query(ORDERS_SQL.replace(", 'I' AS op", ""))
def passes_until_idle(spark, d):
    place, orders = _place(spark), _orders(spark, d)
    table, positions = VersionedTable(spark, f"{place}/table"), Positions(spark, f"{place}/positions")
    target = readers.reload(orders, ORDERS).rows.drop(OPERATION)
    table.publish(target.limit(0))
    most = max(orders.count() // 3, 1)

    def read(position, intent):
        return readers.watermark(orders, ORDERS, "o_orderkey", position, most, intent=intent)

    apply = lambda t, s: writers.upsert(t, s, ["id"])
    passes.run_until_idle(passes.Job(("main", "orders", "orders"), read, apply, table, positions, staging=f"{place}/staged"))
    return table.read()


@query(ORDERS_SQL.replace(", 'I' AS op", ""))
def position_handoff(spark, d):
    """A bulk load by segments that captures its position first, then passes of what came
    after."""
    place, orders = _place(spark), _orders(spark, d)
    early = orders.filter("o_orderkey % 5 <> 0")
    table, positions = VersionedTable(spark, f"{place}/table"), Positions(spark, f"{place}/positions")
    table.publish(readers.reload(orders, ORDERS).rows.drop(OPERATION).limit(0))
    # rows of the last fifth arrive with later positions
    late = orders.withColumn("at", F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1))
    read = lambda position, intent: readers.watermark(late, ORDERS, "at", position, intent=intent, ordered=False)
    job = passes.Job(
        ("main", "orders", "orders"), read, lambda t, s: writers.upsert(t, s, ["id"]), table, positions, capture=lambda: 1
    )
    parts = segments.expand(Auto("o_orderkey", 3), early, ORDERS)
    target = table.read()
    passes.bulk_load(job, parts, lambda parts: readers.reload_segments(early, ORDERS, parts).rows, lambda s: segments.target_scope(s, ORDERS, target))
    passes.run_pass(replace(job, capture=None))
    return table.read()


@query("SELECT o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def joined_lookup(spark, d):
    joined = join_relationships(_orders(spark, d), [_customers(spark, d)])
    return joined.select("o_custkey", "c_name")


# smaller pieces


@query(f"SELECT k, max(seq) AS reached, max(seq) < {X.HALF} AS expired FROM {X.FEED} f GROUP BY k")
def position_expiry(spark, d):
    """A log pruned up to its middle no longer holds what follows the positions of keys that changed before."""
    reached = X.feed(spark, d).groupBy("k").agg(F.max("seq").alias("reached"))
    return reached.withColumn("expired", changelog.expired(F.col("reached"), X.half(spark, d)))


@query("SELECT min(o_orderdate) AS low, max(o_orderdate) AS high, CAST(max(o_totalprice) AS DOUBLE) AS price FROM orders")
def position_text(spark, d):
    """Positions go to text and come back with their types."""
    first = _orders(spark, d).agg(F.min("o_orderdate"), F.max("o_orderdate"), F.max("o_totalprice").cast("double")).first()
    return spark.createDataFrame([tuple(readers.parse_position(readers.format_position(x)) for x in first)], "low timestamp_ntz, high timestamp_ntz, price double")


@query(
    """SELECT c_nationkey AS database, count(*) AS mappings, count(*) FILTER (WHERE stored >= counter) AS skipped FROM (
      SELECT c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 40 END AS stored, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey * 2 END AS counter FROM customer) GROUP BY 1"""
)
def poll_gate(spark, d):
    """How many mappings of each database a pass would skip; what isn't known is read."""
    stored = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 40)
    counter = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") * 2)
    marked = X.load(spark, d, "customer").select(F.col("c_nationkey").alias("database"), readers.is_unchanged(stored, counter).alias("same"))
    return marked.groupBy("database").agg(F.count("*").alias("mappings"), F.count_if("same").alias("skipped"))


@query(
    """SELECT 'key' AS part, 'id' AS name, count(DISTINCT o_orderkey) AS distinct_values FROM orders UNION ALL SELECT 'value', 'customer', count(DISTINCT o_custkey) FROM orders
      UNION ALL SELECT 'value', 'status', count(DISTINCT lower(o_orderstatus)) FROM orders UNION ALL SELECT 'value', 'total', count(DISTINCT o_totalprice) FROM orders"""
)
def key_value_split(spark, d):
    """The key and the value columns of a mapping, with how many values each has."""
    keys, values = split_keys(ORDERS)
    rows = readers.reload(_orders(spark, d), ORDERS).rows
    counted = rows.agg(*[F.count_distinct(c).alias(c) for c in [*keys, *values]])
    parts = F.array(*[F.struct(F.lit("key" if c in keys else "value").alias("part"), F.lit(c).alias("name"), F.col(c).alias("distinct_values")) for c in [*keys, *values]])
    return counted.select(F.inline(parts))


@query(
    f"""SELECT mapping, max(enqueued_at) AS last, max(enqueued_at) + to_hours(mapping) <= (SELECT max(enqueued_at) + INTERVAL 4 HOUR FROM {X.RUNS} x) AS due
      FROM {X.RUNS} r GROUP BY mapping"""
)
def cron_due(spark, d):
    """Mappings whose next time, some hours after their last run, has come four hours after the last run of all."""
    runs = X.runs(spark, d)
    now = runs.agg(F.max("enqueued_at")).first()[0] + dt.timedelta(hours=4)
    last = runs.groupBy("mapping").agg(F.max("enqueued_at").alias("last"))
    return last.withColumn("due", metrics.is_due(F.expr("timestampadd(HOUR, mapping, last)"), F.col("last"), now))


@query(f"SELECT mapping, sum(rows_read) > 0 AND max(mapping) <> 3 AS due FROM {X.RUNS} r GROUP BY mapping")
def reconcile_trigger(spark, d):
    """Mappings that changes ask a reconciliation for; one has just had it."""
    rows = X.runs(spark, d).groupBy("mapping").agg(F.sum("rows_read").cast("long").alias("n")).collect()
    last = lambda m: NOW - dt.timedelta(minutes=1) if m == 3 else None
    due = [(r["mapping"], metrics.reconcile_due(r["n"], last(r["mapping"]), NOW, "changes", dt.timedelta(hours=1))) for r in rows]
    return spark.createDataFrame(due, "mapping long, due boolean")


@query("SELECT count(*) AS row_count, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders")
def held_mapping(spark, d):
    """A paused mapping isn't run; after it is resumed its pass reads what there is."""
    place, orders = _place(spark), _orders(spark, d).select("o_orderkey", "o_custkey")
    table, positions = VersionedTable(spark, f"{place}/table"), Positions(spark, f"{place}/positions")
    table.publish(orders.limit(0))
    read = lambda position, intent: readers.watermark(orders, Mapping(), "o_orderkey", position, intent=intent)
    job = passes.Job(("main", "held", "orders"), read, lambda t, s: writers.upsert(t, s, ["o_orderkey"]), table, positions)
    passes.pause(job)
    passes.run_pass(job)
    if not table.read().isEmpty():
        raise AssertionError("a held mapping ran")
    passes.resume(job)
    passes.run_pass(job)
    return table.read().agg(F.count("*").alias("row_count"), F.sum("o_custkey").cast("long").alias("customers"))


@query(_compared("o_orderstatus", {"row_count": "count(*)"}, "s.row_count <> t.row_count"))
def verification_saved(spark, d):
    """A result as it is read back from where it was saved."""
    place = _place(spark)
    verify.save(verify_rowcount(spark, d), f"{place}/result", {"check": "orders"})
    return spark.read.parquet(f"{place}/result")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def connector_round_trip(spark, d):
    """The same rows through each file format in turn."""
    rows, place = _orders(spark, d).select("o_orderkey", "o_custkey", "o_totalprice"), _place(spark)
    for kind in ("parquet", "orc", "json"):
        rows.write.format(kind).save(f"{place}/{kind}")
        rows = spark.read.format(kind).schema(rows.schema).load(f"{place}/{kind}")
    return rows


@query(ORDERS_SQL)
def jdbc_segments(spark, d):
    """orders written to a database and read back by automatic ranges: one scan, a task for each."""
    url, orders = connectors.derby(spark, _place(spark)), _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    connectors.write(orders, "jdbc", url, dbtable="orders", driver=connectors.DERBY, createTableColumnTypes="o_orderstatus VARCHAR(8)", batchsize="5000")
    source = connectors.Source("jdbc", url, options={"driver": connectors.DERBY})
    found = segments.expand(Auto("o_orderkey", 6), connectors.jdbc_table(spark, source, "orders"))
    back = connectors.jdbc_segments(spark, source, "orders", found)
    return _op(readers.reload(back, ORDERS).rows)


@query("SELECT o_orderstatus, count(*) AS row_count, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderstatus")
def jdbc_pushdown(spark, d):
    """The filter, the columns and the aggregation are the database's work."""
    url, orders = connectors.derby(spark, _place(spark)), _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    connectors.write(orders, "jdbc", url, dbtable="orders", driver=connectors.DERBY, createTableColumnTypes="o_orderstatus VARCHAR(8)", batchsize="5000")
    source = connectors.Source("jdbc", url, options={"driver": connectors.DERBY})
    rows = connectors.jdbc_table(spark, source, "orders").filter("o_totalprice > 50000")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("row_count"), F.sum(F.col("o_custkey").cast("long")).alias("customers"))


@query(f"SELECT seq, k, op, (SELECT max(ts) FROM events e WHERE e.event_id // 50 = f.seq // 50) AS committed_at FROM {X.FEED} f")
def lsn_commit_time(spark, d):
    """Changes of a log that knows transactions only get their transaction's time."""
    log = X.feed(spark, d).withColumn("lsn", ordering(F.expr("seq div 50")))
    commits = log.groupBy("lsn").agg(F.max("changed_at").alias("at"))
    found = changelog.with_commit_time(log.select("lsn", "seq", "k", "op"), commits, "lsn", "at")
    return found.select("seq", "k", "op", F.col(CHANGED_AT).alias("committed_at"))


@query(
    """SELECT o_orderkey AS id, CAST(o_custkey AS INTEGER) AS customer, CAST(o_custkey AS DECIMAL(12,2)) AS money, CAST(o_custkey AS DOUBLE) / 4 AS ratio,
      o_custkey % 2 = 0 AS even, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) AS moment, hex(o_orderstatus) AS bytes, o_orderpriority AS note
      FROM orders"""
)
def wal_typed_values(spark, d):
    """Each type's text form, as a log writes it, comes back as the column's type."""
    texts = {
        "id": F.col("o_orderkey").cast("string"), "customer": F.col("o_custkey").cast("string"), "money": F.concat(F.col("o_custkey").cast("string"), F.lit("00e-2")),
        "ratio": (F.col("o_custkey").cast("double") / 4).cast("string"), "even": F.when(F.col("o_custkey") % 2 == 0, "t").otherwise("f"),
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "moment": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "bytes": F.concat(F.lit("\\x"), F.hex("o_orderstatus")), "note": F.col("o_orderpriority"),
    }
    kinds = ["bigint", "int", "decimal(12,2)", "double", "boolean", "date", "timestamp_ntz", "binary", "string"]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("value")) for n, t in texts.items()])
    log = _orders(spark, d).select(F.to_json(F.struct(F.lit("I").alias("action"), pairs.alias("columns"))).alias("data"))
    return changelog.logical_records(log, "data", dict(zip(texts, kinds)), []).withColumn("bytes", F.hex("bytes")).drop(OPERATION)


@query("SELECT c_custkey AS mapping, c_nationkey AS database, c_custkey % 40 AS stored FROM customer WHERE NOT coalesce(c_custkey % 40 >= CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey * 2 END, false)")
def poll_gate_mappings(spark, d):
    """A counter for each nation's database; every fifth has none."""
    customer = X.load(spark, d, "customer")
    due = customer.select(F.col("c_custkey").alias("mapping"), F.col("c_nationkey").alias("database"), (F.col("c_custkey") % 40).alias("stored"))
    counters = due.select("database").distinct().filter("database % 5 <> 0").withColumn("counter", F.col("database") * 2)
    return readers.to_dispatch(due, counters, ("database",))


@query("SELECT target, refused, CASE WHEN refused THEN 0 ELSE (SELECT count(*) FROM orders) END AS row_count FROM (VALUES ('nation', true), ('NAME', true), ('customer_name', false)) t(target, refused)")
def collision_guard(spark, d):
    """A joined column can't take the name of another column, whatever its case; with another name all rows are read."""
    found = []
    for name in ("nation", "NAME", "customer_name"):
        mapping = Mapping(
            (ColumnMapping("o_orderkey", "nation"), ColumnMapping("o_custkey", "name"), ColumnMapping("c_name", name, None, "customer")),
            relationships=(_customers(spark, d),),
        )
        try:
            found.append((name, False, readers.reload(_orders(spark, d), mapping).rows.filter(F.col(name).isNotNull()).count()))
        except ValueError:
            found.append((name, True, 0))
    return spark.createDataFrame(found, "target string, refused boolean, row_count long")


def _filled(table: DataFrame, told: list[tuple], schema: str) -> DataFrame:
    """Facts about columns (their name first), each with how many rows have a value there."""
    counts = table.agg(*[F.count(c).alias(c) for c in table.columns]).first()
    return table.sparkSession.createDataFrame([(*t, counts[t[0]]) for t in told], schema + ", filled long")


@query(
    """SELECT history, name, is_key, CASE WHEN name = 'valid_to' THEN 0 ELSE (SELECT count(*) FROM orders) END AS filled FROM (VALUES
      ('snapshot', 'id', false), ('snapshot', 'customer', false), ('snapshot', 'status', false), ('snapshot', 'total', false), ('snapshot', 'snapshot_at', false),
      ('scd2', 'version_key', true), ('scd2', 'id', false), ('scd2', 'customer', false), ('scd2', 'status', false), ('scd2', 'total', false), ('scd2', 'valid_from', false),
      ('scd2', 'valid_to', false), ('scd2', 'is_current', false)) t(history, name, is_key)"""
)
def history_columns(spark, d):
    """The columns of historized targets, loaded with all orders."""
    plans = {h: provision.create_plan(_orders(spark, d), ORDERS, history=h) for h in ("snapshot", "scd2")}
    staged = readers.reload(_orders(spark, d), ORDERS).rows
    empty = {h: provision.create(spark, p) for h, p in plans.items()}
    loaded = {"snapshot": writers.snapshot(empty["snapshot"], staged, NOW), "scd2": scd2.apply(empty["scd2"], staged, ["id"], ["customer", "status", "total"], NOW)}
    parts = [_filled(loaded[h], [(c, h, c in plans[h].keys) for c in empty[h].columns], "name string, history string, is_key boolean") for h in plans]
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def pinned_version(spark, d):
    """A version is read as it was, whatever was published since."""
    table, orders = VersionedTable(spark, f"{_place(spark)}/table"), _orders(spark, d).select("o_orderkey", "o_custkey")
    first = table.publish(orders.filter("o_orderkey % 2 = 0"))
    pinned = table.read(first.number)
    table.append(orders.filter("o_orderkey % 2 = 1"))
    table.publish(orders.filter("o_orderkey % 3 = 0"))
    return pinned


@query("SELECT max(o_orderkey) AS acknowledged, count(*) AS row_count FROM orders")
def slot_advance(spark, d):
    """The source hears of a position only when its rows are in the target."""
    place, orders, heard = _place(spark), _orders(spark, d).select("o_orderkey", "o_custkey"), []
    table, positions = VersionedTable(spark, f"{place}/table"), Positions(spark, f"{place}/positions")
    table.publish(orders.limit(0))
    read = lambda position, intent: readers.watermark(orders, Mapping(), "o_orderkey", position, intent=intent, ordered=False)
    tell = lambda position: heard.append((position, table.read().count()))
    passes.run_pass(passes.Job(("main", "slot", "orders"), read, lambda t, s: writers.upsert(t, s, ["o_orderkey"]), table, positions, acknowledge=tell))
    return spark.createDataFrame(heard, "acknowledged long, row_count long")


@query("SELECT count(*) AS row_count, CAST(sum(o_custkey) AS BIGINT) AS customers, 3 AS passes FROM orders")
def continuous_idle_exit(spark, d):
    """A stream on Spark's own trigger, which a listener ends when nothing came for a while."""
    place, orders = _place(spark), _orders(spark, d).select("o_orderkey", "o_custkey")
    table = KeyedTable.create(spark, f"{place}/table", orders.schema, ["o_orderkey"], 8)
    apply = lambda rows, _: table.upsert(writers.with_operation(rows.select("o_orderkey", "o_custkey")))
    stream = capped.writer(spark, f"{d}/orders.parquet", "o_orderkey", orders.count() // 3 + 1, apply, f"{place}/checkpoint")
    moved = capped.run_until_idle(spark, stream, 1.0)
    return table.read().agg(F.count("*").alias("row_count"), F.sum("o_custkey").cast("long").alias("customers"), F.lit(moved).alias("passes"))


@query(
    """WITH RECURSIVE days AS (SELECT o_orderdate AS at, sum(count(*)) OVER (ORDER BY o_orderdate) AS upto FROM orders GROUP BY o_orderdate),
      total AS (SELECT count(*) AS n, count(*) // 5 AS most FROM orders),
      slices AS (
        SELECT CAST(-1 AS BIGINT) AS batch, CAST(0 AS HUGEINT) AS upto
        UNION ALL
        SELECT s.batch + 1, coalesce((SELECT min(d.upto) FROM days d WHERE d.upto >= s.upto + (SELECT most FROM total)), (SELECT n FROM total))
        FROM slices s WHERE s.upto < (SELECT n FROM total))
      SELECT s.batch, count(*) AS row_count, min(o_orderdate) AS low, max(o_orderdate) AS high, CAST(sum(o_custkey) AS BIGINT) AS customers
      FROM slices s JOIN slices p ON p.batch = s.batch - 1 JOIN days d ON d.upto > p.upto AND d.upto <= s.upto JOIN orders ON o_orderdate = d.at GROUP BY s.batch"""
)
def stream_row_cap(spark, d):
    """orders as a stream whose batches hold a fifth of the rows each, and those of the same day."""
    place, orders = _place(spark), _orders(spark, d)
    keep = lambda rows, n: rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{place}/batches/n={n}")
    stream = capped.writer(spark, f"{d}/orders.parquet", "o_orderdate", max(orders.count() // 5, 1), keep, f"{place}/checkpoint")
    capped.run_until_idle(spark, stream, 1.0)
    found = spark.read.parquet(f"{place}/batches").groupBy("batch")
    return found.agg(F.count("*").alias("row_count"), F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"), F.sum("o_custkey").cast("long").alias("customers"))


@query(f"SELECT v, count(*) AS n FROM {X.FEED} f WHERE seq > 50 GROUP BY v")
def snapshot_current(spark, d):
    """Of a table of snapshots, the last one is current."""
    return verify.target_side(snapshot_append(spark, d), ["v"], only_current=True).select("v", F.col("row_count").cast("long").alias("n"))


@query(
    """SELECT id, customer, lower(status) AS status, total, 'I' AS op FROM (SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS total FROM orders
      UNION ALL SELECT * FROM (VALUES (1, 1, 'text', 0.5), (0, 0, '', 0.0), (-1, -1, 'xxxxxx', NULL), (NULL, NULL, NULL, NULL)) v)"""
)
def sample_values(spark, d):
    """A mapping is tried with each type's edges beside the source's own rows."""
    orders = _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    edges = [samples(kind) for kind in ("int64", "int64", "string(6)", "double")]
    rows = [tuple(e[i] if i < len(e) else None for e in edges) for i in range(max(map(len, edges)))]
    return _op(readers.reload(orders.unionByName(spark.createDataFrame(rows, orders.schema)), ORDERS).rows)


@query("SELECT name, kind, key_place, (SELECT count(*) FROM orders) AS filled FROM (VALUES ('id', 'bigint', 0), ('customer', 'bigint', NULL), ('status', 'varchar(1)', NULL)) t(name, kind, key_place)")
def catalog_adapter(spark, d):
    """A user's adapter hides a column and retypes another; the others are there with all rows."""
    rows = readers.reload(_orders(spark, d), ORDERS).rows.drop(OPERATION)
    adapter = lambda found: [c | ({"type": "varchar(1)"} if c["name"] == "status" else {}) for c in found if c["name"] != "total"]
    found = connectors.described(rows, ["id"], adapter)
    return _filled(rows, [(c["name"], c["type"], c["key"]) for c in found], "name string, kind string, key_place int")

# calls beside a pass


@query(
    """SELECT * FROM (SELECT 1 AS step, 'before_stage' AS point, 0 AS row_count UNION ALL SELECT 2, 'after_stage', count(*) FROM orders
      UNION ALL SELECT 3, 'before_load', 0 UNION ALL SELECT 4, 'after_load', count(*) FROM orders UNION ALL SELECT 5, 'refused', count(*) FROM orders)"""
)
def hooks_in_pass(spark, d):
    """Hooks at the four points of a pass see what is staged and loaded by then; one that only warns lets
    the pass go on, one that fails stops the next pass before it has changed anything."""
    place, orders, seen = _place(spark), _orders(spark, d).select("o_orderkey", "o_custkey"), []
    table, positions = VersionedTable(spark, f"{place}/table"), Positions(spark, f"{place}/positions")
    table.publish(orders.limit(0))
    staged = lambda: spark.read.parquet(f"{place}/staged/main/hooks/orders/{1:012d}").count()
    note = lambda point, rows: transforms.Hook(lambda: seen.append((len(seen) + 1, point, rows())))
    loaded = lambda: table.read().count()
    broken = lambda on_error: transforms.Hook(lambda: 1 // 0, on_error)
    hooks = {"before_stage": [note("before_stage", loaded)], "after_stage": [broken("warn"), note("after_stage", staged)], "before_load": [note("before_load", loaded)], "after_load": [note("after_load", loaded)]}
    read = lambda position, intent: readers.watermark(orders, Mapping(), "o_orderkey", position, intent=intent)
    job = passes.Job(("main", "hooks", "orders"), read, lambda t, s: writers.upsert(t, s, ["o_orderkey"]), table, positions, hooks=hooks, staging=f"{place}/staged")
    passes.run_pass(job)
    before = passes.status(job)
    try:
        passes.run_pass(replace(job, hooks={"before_load": [broken("fail")]}, read=lambda p, i: read(None, Intent.INITIAL_LOAD)))
    except ZeroDivisionError:
        if passes.status(job) == before:
            seen.append((5, "refused", loaded()))
    return spark.createDataFrame(seen, "step int, point string, row_count long")


@query(ORACLE_SQL["key_reconcile_delete"])
def reconcile_job(spark, d):
    """The reconciliation of a job: keys against the target, behind a guard, as its next version."""
    place, orders = _place(spark), _orders(spark, d)
    table, positions = VersionedTable(spark, f"{place}/table"), Positions(spark, f"{place}/positions")
    table.publish(X.stale_orders(spark, d))
    job = passes.Job(("main", "reconcile", "orders"), lambda p, i: readers.watermark(orders, Mapping(), "o_orderkey", p, intent=i), writers.upsert, table, positions)
    keys = readers.keys_only(orders, Mapping(), ["o_orderkey"]).rows
    passes.reconcile(job, keys, ["o_orderkey"], F.col("o_totalprice") > 50000, writers.Guard("ratio", 0.5))
    return table.read()


@query(
    f"""SELECT r.*, p.p50, p.p95, p.max, c.last_completed, e.latest_enqueued FROM ({ORACLE_SQL["run_totals"]}) r JOIN ({ORACLE_SQL["run_percentiles"]}) p ON p.mapping = r.mapping
      LEFT JOIN ({ORACLE_SQL["last_completed"]}) c ON c.mapping = r.mapping JOIN ({ORACLE_SQL["latest_enqueued"]}) e ON e.mapping = r.mapping"""
)
def run_overview(spark, d):
    """All figures of each mapping in one table."""
    return metrics.overview(X.runs(spark, d), "rows_read", "mapping")


@query(ORACLE_SQL["verify_sum_multi"])
def verify_job(spark, d):
    """A check of a mapping's target against its source in one call."""
    return _grouped(verify.check(_orders(spark, d), CENTS, _checked(spark, d), ["status"], ["cents", "customer"], 0.05))
