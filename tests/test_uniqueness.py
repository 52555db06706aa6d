"""What must be refused: repeated keys, a second writer, a second item of a key. And orders over
many ids, in a time that doesn't grow with their square."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions.transforms import Hook, run_hooks
from tidewell.operators import metrics, scd2, verify, writers
from tidewell.plans.passes import Job, run_pass
from tidewell.plans.store import Positions, VersionedTable
from tidewell.model import Mapping
from tidewell.sources import readers


def staged(spark, *rows):
    return spark.createDataFrame(rows, "k long, v string, __operation string")


def test_repeated_staged_keys_are_refused(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    twice = staged(spark, (1, "x", "U"), (1, "y", "U"))
    for write in (lambda s: writers.upsert(target, s, ["k"]), lambda s: writers.merge_reconcile(target, s, ["k"])):
        with pytest.raises(Exception, match="several staged rows of one key.*1"):
            write(twice).collect()
        assert write(staged(spark, (1, "x", "U"))).filter("k = 1").collect()[0]["v"] == "x"
    # a null key meets nothing: a repeated pass would add its row again
    with pytest.raises(Exception, match="a staged row has no key"):
        writers.upsert(target, staged(spark, (None, "x", "U")), ["k"]).collect()
    versions = scd2.empty_target(target, ["k"], ["v"]).limit(0)
    with pytest.raises(Exception, match="several staged rows"):
        scd2.close_and_open(versions, twice, ["k"], ["v"], dt.datetime(2024, 1, 1)).collect()


def test_a_staged_key_out_of_scope_is_refused(spark):
    target = spark.createDataFrame([(1, "a"), (20, "b")], "k long, v string")
    with pytest.raises(Exception, match="exists out of scope"):
        writers.merge_reconcile(target, staged(spark, (1, "x", "U"), (20, "y", "U")), ["k"], F.col("k") < 10).collect()
    found = writers.merge_reconcile(target, staged(spark, (1, "x", "U"), (3, "y", "U")), ["k"], F.col("k") < 10)
    assert sorted(map(tuple, found.collect())) == [(1, "x"), (3, "y"), (20, "b")]


def test_segments_are_items_of_their_own(spark):
    now = dt.datetime(2024, 1, 1)
    item = lambda i, segment, state="Pending": (i, "t", "sync", 7, segment, state, 0, now, now)
    kind = "item_id long, task string, kind string, mapping long, segment string, state string, priority int, enqueued_at timestamp_ntz, available_at timestamp_ntz"
    queue = spark.createDataFrame([item(1, "a", "Running")], kind)
    more = spark.createDataFrame([item(2, "a"), item(3, "b"), item(4, "b"), item(5, None), item(6, None)], kind)
    after = metrics.put(queue, more)
    assert sorted(r["item_id"] for r in after.collect()) == [1, 3, 5]
    assert metrics.claim(after, now).first()["item_id"] == 3
    assert metrics.put(queue.drop("segment"), more.drop("segment")).count() == 1


def test_of_two_writers_one_leaves_no_trace(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(0))
    outcome, gate = [], threading.Barrier(2)

    def write(n):
        gate.wait()
        try:
            table.publish(spark.range(n), expected=1, by=n)
            outcome.append(n)
        except RuntimeError:
            outcome.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n in outcome if n]
    assert len(won) == 1 and table.current().number == 2
    assert table.read().count() == won[0] == table.current().facts["by"]
    assert len([n for n in table.folder.names("") if n.startswith("data-")]) == 2
    with pytest.raises(Exception):
        table.folder.create("_published/000000000002", "{}")
    assert table.folder.names("_aside") == []


def test_appends_keep_the_files_before(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(3))
    table.append(spark.range(2))
    table.append(spark.range(4), expected=2)
    assert table.read().count() == 9 and table.read(2).count() == 5 and table.read(1).count() == 3
    assert len(table.current().files) == 3
    assert table.retire(1) == [1, 2] and table.read().count() == 9
    table.publish(spark.range(1))
    table.retire(1)
    assert len([n for n in table.folder.names("") if n.startswith("data-")]) == 1


def test_staged_rows_are_written_once(spark, tmp_path):
    """The writer reads what was staged, whatever the source says then; hooks run at four points."""
    table, positions = VersionedTable(spark, str(tmp_path / "t")), Positions(spark, str(tmp_path / "p"))
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    table.publish(source.limit(0))
    points = []
    hooks = {p: [Hook(lambda p=p: points.append(p))] for p in ("before_stage", "after_stage", "before_load", "after_load")}

    def apply(target, rows):
        assert all(str(tmp_path / "s") in f for f in rows.inputFiles())
        return writers.upsert(target, rows, ["k"])

    job = Job(("a", "b", "c"), lambda position, intent: readers.watermark(source, Mapping(), "k", position, intent=intent), apply, table, positions, hooks=hooks, staging=str(tmp_path / "s"))
    run_pass(job)
    assert table.read().count() == 2 and points == ["before_stage", "after_stage", "before_load", "after_load"]


def test_hooks_fail_or_warn():
    bad = lambda: 1 / 0
    with pytest.raises(ZeroDivisionError):
        run_hooks({"after_load": [Hook(bad)]}, "after_load")
    with pytest.warns(UserWarning, match="after_load"):
        run_hooks({"after_load": [Hook(bad, "warn")]}, "after_load")
    with pytest.raises(ValueError):
        run_hooks({"later": []}, "after_load")


def test_orders_over_many_ids(spark):
    """A million ids in a few seconds, and right."""
    ids = spark.range(1_000_000).select((F.col("id") * 3).alias("id"))
    began = time.time()
    cursors = spark.createDataFrame([(1, -5), (2, 0), (3, 2_999_996), (4, 2_999_997), (5, 10**9)], "user long, seen long")
    assert {r["user"]: r["unread"] for r in metrics.unread(ids, cursors).collect()} == {1: 1_000_000, 2: 999_999, 3: 1, 4: 0, 5: 0}
    checks = ids.select(F.col("id").alias("value"), F.timestamp_micros(F.col("id")).cast("timestamp_ntz").alias("at"))
    positions = spark.createDataFrame([(1, 1), (2, 3_000_000), (3, 2_999_997), (4, 0)], "id long, target long")
    found = {r["id"]: r["crossed_at"] for r in metrics.first_crossing(checks, positions).collect()}
    at = lambda n: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=n)
    assert found == {1: at(3), 2: None, 3: at(2_999_997), 4: None}
    gaps = verify.gaps(ids.filter("id NOT IN (300, 303)").select(F.floor(F.col("id") / 3).alias("id")), "id").collect()
    assert [tuple(r) for r in gaps] == [(99, 102)]
    values = ids.select((F.col("id") % 1001).alias("x"), (F.col("id") % 2).alias("g"))
    want = values.groupBy("g").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("p"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x)").alias("q"))
    assert {r["g"]: (r["p50"], r["p95"]) for r in metrics.percentiles(values, "x", "g").collect()} == {r["g"]: (r["p"], r["q"]) for r in want.collect()}
    assert metrics.percentiles(values.limit(0), "x", "g").count() == 0
    assert time.time() - began < 120
