"""Ranges by rank, and keys whose changes are more than a task should hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.expressions import ordering
from tidewell.model import CHANGED_AT, OPERATION, ORDERING
from tidewell.operators import metrics, ranges, scd2, verify


def test_an_outlier_leaves_the_ranges_even(spark):
    ids = spark.range(200_000).unionByName(spark.createDataFrame([(10**12,)], "id long"))
    sizes = [r["count"] for r in ids.groupBy(ranges.block_of(ids, "id")("id").alias("b")).count().collect()]
    n = ranges.how_many(ids)
    assert len(sizes) > 0.9 * n and max(sizes) <= 2 * 200_001 / n


@pytest.mark.parametrize("kind", ["int", "double", "decimal(12,2)", "bigint"])
def test_numbers_of_ranges_keep_the_order(spark, kind):
    values = spark.range(3000).select((F.pow(F.col("id") % 500, 3) / 7 - 1000).cast(kind).alias("v"))
    block = ranges.block_of(values, "v")
    found = values.select("v", block("v").alias("b")).orderBy("v").collect()
    numbers = [r["b"] for r in found]
    assert numbers == sorted(numbers) and len(set(numbers)) > 20
    assert len({(r["v"], r["b"]) for r in found}) == len({r["v"] for r in found})
    beyond = spark.range(1).select(F.lit(10**9).cast("double").cast(kind).alias("a"), F.lit(-(10**6)).cast(kind).alias("z"), F.lit(None).cast(kind).alias("n"))
    high, low, null = beyond.select(block("a"), block("z"), block("n")).first()
    assert high == max(numbers) and low == null == 0


def test_orders_over_skewed_values(spark):
    """Percentiles, gaps, unread notes and crossings where most values lie together."""
    rng = random.Random(4)
    ids = sorted({rng.randrange(300) for _ in range(150)} | {10**9 + rng.randrange(50) for _ in range(20)})
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = [(a, b) for a, b in zip(ids, ids[1:]) if b > a + 1]
    assert sorted(map(tuple, verify.gaps(df, "id").collect())) == want
    cursors = spark.createDataFrame([(u, rng.choice([-5, 0, 150, 10**9 + 10, 10**12, rng.choice(ids)])) for u in range(60)], "user long, seen long")
    assert all(r["unread"] == sum(i > r["seen"] for i in ids) for r in metrics.unread(df, cursors).collect())
    values = [rng.choice([1, 1, 1, 2, 10**8, rng.randrange(1000)]) for _ in range(400)]
    runs = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g long, v long")
    for r in metrics.percentiles(runs, "v", "g").collect():
        own = sorted(v for i, v in enumerate(values) if i % 3 == r["g"])
        rank = lambda p: own[max(-(-len(own) * p // 100), 1) - 1]
        assert (r["p50"], r["p95"], r["max"]) == (rank(50), rank(95), own[-1])


# chains of versions in segments


def feed(spark, n, hot):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        k = 1 if rng.random() < hot else rng.randrange(2, 30)
        rows.append((k, rng.choice(["a", "b", None]), "D" if rng.random() < 0.1 else "U", i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)))
    df = spark.createDataFrame(rows, "k long, v string, op string, seq long, at timestamp_ntz")
    return df.select("k", "v", F.col("op").alias(OPERATION), ordering(F.col("seq"), F.lit(0).cast("long")).alias(ORDERING), F.col("at").alias(CHANGED_AT))


def versions(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hot", [0.9, 0.3, 1.0])
def test_a_hot_key_in_segments(spark, monkeypatch, hot):
    staged = feed(spark, 1500, hot)
    target = scd2.apply(scd2.empty_target(staged, ["k"], ["v"]), feed(spark, 40, 0.2), ["k"], ["v"], dt.datetime(2024, 1, 1))
    target = spark.createDataFrame(target.collect(), target.schema)
    now = dt.datetime(2025, 1, 1)
    whole = versions(scd2.apply(target, staged, ["k"], ["v"], now))
    monkeypatch.setattr(ranges, "TOGETHER", 60)
    monkeypatch.setattr(ranges, "SAMPLED", 8)
    cut = ranges.hot_keys(staged, ["k"], ORDERING)
    assert cut is not None and 1 in {r["k"] for r in cut.collect()}
    sizes = [r["count"] for r in ranges.segmented(staged, ["k"], ORDERING, cut).groupBy("k", "__segment").count().collect()]
    assert max(sizes) <= 60 * 3 and len(sizes) > 10
    assert versions(scd2.apply(target, staged, ["k"], ["v"], now)) == whole


def test_segments_without_edges(spark, monkeypatch):
    """Long stretches that change nothing: the next boundary is some segments away."""
    rows = [(1, "a" if i < 500 else "b", "U", i) for i in range(900)] + [(1, None, "D", 900)] + [(1, None, "D", 901 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v string, op string, seq long")
    staged = df.select("k", "v", F.col("op").alias(OPERATION), ordering(F.col("seq"), F.lit(0).cast("long")).alias(ORDERING), F.expr("timestampadd(MINUTE, seq, TIMESTAMP_NTZ '2024-01-01')").alias(CHANGED_AT))
    target = scd2.empty_target(staged, ["k"], ["v"])
    whole = versions(scd2.many_versions(target, staged, ["k"], ["v"]))
    monkeypatch.setattr(ranges, "TOGETHER", 50)
    monkeypatch.setattr(ranges, "SAMPLED", 8)
    assert versions(scd2.many_versions(target, staged, ["k"], ["v"])) == whole and len(whole) == 2


def test_a_chain_is_shuffled_once(spark):
    """All windows over the changes share one exchange by key and segment."""
    staged = feed(spark, 200, 0.2)
    plan = scd2.boundaries(scd2.empty_target(staged, ["k"], ["v"]), staged, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") <= 2 and plan.count("Window") >= 2


def test_retention_by_thresholds(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"t{i % 2}" if i % 11 else None, rng.choice([1, 1, 1, 2, 3]), start + dt.timedelta(hours=rng.randrange(40)), start if rng.random() < 0.9 else None) for i in range(800)]
    runs = spark.createDataFrame(rows, "run_id long, task string, mapping long, enqueued_at timestamp_ntz, ended_at timestamp_ntz")
    for most in (0, 1, 7, 100, 5000):
        groups = {}
        for r in rows:
            if r[4] is not None:
                groups.setdefault(r[1:3], []).append((r[3], r[0]))
        want = sorted(i for g in groups.values() for _, i in sorted(g, reverse=True)[most:])
        found = metrics.doomed(runs, ["task", "mapping"], None, most)
        assert sorted(r["run_id"] for r in found.collect()) == want and found.columns == runs.columns
    plan = metrics.kept_from(runs, ["task", "mapping"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") >= 1 and "__later" in plan


def test_reader_lag(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    checks = [("g", 10, t(1), None), ("g", 20, t(5), None), ("g", 20, t(6), None), ("g", 35, t(9), None), ("h", 7, t(3), t(2)), ("h", None, t(4), None), ("c", 5, t(3), t(2)), ("c", 9, t(8), t(7))]
    checks = spark.createDataFrame(checks, "grp string, value long, at timestamp_ntz, source_at timestamp_ntz")
    rows = [
        (1, "g", "version", 15, None), (2, "g", "version", 20, t(1)), (3, "g", "version", 99, None), (4, "g", "version", None, None), (5, "h", "version", 3, t(1)), (6, "h", "log", 3, t(1)),
        (7, "c", "version", 5, t(2)), (8, "c", "log", 5, t(9)), (9, "c", "log", 5, None), (10, "none", "version", 5, t(1)), (11, "c", "full", 5, t(1)), (12, None, "log", 5, t(1)), (13, "g", "version", 36, None),
    ]
    found = metrics.reader_lag(spark.createDataFrame(rows, "id long, grp string, kind string, applied long, applied_at timestamp_ntz"), checks)
    minute = 60_000
    assert {r["id"]: tuple(r)[1:] for r in found.collect()} == {
        1: (True, None, 20, 4 * minute, t(9)), 2: (True, None, 15, 4 * minute, t(9)), 3: (True, None, 0, None, t(9)), 4: (True, None, None, None, None),
        5: (True, None, None, minute, t(4)), 6: (True, minute, None, None, t(2)), 7: (True, 5 * minute, 4, None, t(7)), 8: (True, 0, None, None, t(7)), 9: (True, None, None, None, t(7)),
        10: (True, None, None, None, None), 11: (False, None, None, None, None), 12: (True, None, None, None, None), 13: (True, None, 0, None, t(9)),
    }
