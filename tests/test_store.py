"""Versions that grow columns, partitions and staging folders; tables in buckets of their key."""

import os

import pytest
from pyspark.sql import functions as F

from tidewell.model import DELETE, INSERT, OPERATION, UPDATE, Intent, Read
from tidewell.operators import scd2, writers
from tidewell.plans import buckets, passes
from tidewell.plans.buckets import KeyedTable
from tidewell.plans.store import Positions, VersionedTable, key_path
from tidewell.streaming import continuous


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_keeps_new_columns(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(2))
    table.append(spark.range(2, 3).withColumn("extra", F.lit("x")))
    table.append(spark.range(3, 4).select(F.lit(7).alias("more"), "id"))
    found = table.read()
    assert found.columns == ["id", "extra", "more"]
    assert rows(found) == [(0, None, None), (1, None, None), (2, "x", None), (3, None, 7)]
    assert table.read(1).columns == ["id"] and table.read(2).columns == ["id", "extra"]
    with pytest.raises(ValueError, match="column id is bigint, not string"):
        table.append(spark.range(1).select(F.col("id").cast("string")))
    assert table.current().number == 3


def test_append_to_a_partitioned_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    made = lambda a, b: spark.range(a, b).select((F.col("id") % 2).cast("int").alias("k"), "id")
    table.publish(made(0, 4), partition_by=("k",))
    table.append(made(4, 6).withColumn("extra", F.lit(1)))
    table.append(spark.range(6, 7))
    assert table.read().columns == ["k", "id", "extra"]
    assert rows(table.read()) == sorted([(i % 2, i, 1 if i >= 4 else None) for i in range(6)] + [(None, 6, None)], key=repr)
    assert "k=1" in table.folder.names(table.current().files[1])
    assert "PartitionFilters: [isnotnull(k" in table.read().filter("k = 1")._jdf.queryExecution().executedPlan().toString()


def test_keys_that_join_alike(spark, tmp_path):
    """Two jobs whose keys look alike when joined have staging folders and passes of their own."""
    one, other = ("main", "a-b", "c"), ("main-a", "b", "c")
    slashed = ("main", "a/b", "c"), ("main/a", "b", "c")
    assert len({key_path(k) for k in (one, other, *slashed)}) == 4
    found = {}
    for key, start in ((one, 0), (other, 100), (slashed[0], 200), (slashed[1], 300)):
        table = VersionedTable(spark, str(tmp_path / f"t{start}"))
        table.publish(spark.range(0))
        job = passes.Job(
            key, lambda p, i, start=start: Read(spark.range(start, start + 2), start), lambda t, s: t.unionByName(s), table,
            Positions(spark, str(tmp_path / "p")), staging=str(tmp_path / "staged"),
        )
        passes.run_pass(job)
        found[key] = passes.staged(job, job.read(None, Intent.CHANGES).rows, 9)
        assert rows(table.read()) == [(start,), (start + 1,)]
    assert [sorted(r[0] for r in f.collect()) for f in found.values()] == [[0, 1], [100, 101], [200, 201], [300, 301]]


def test_a_marker_of_any_length(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(1), note="x" * (1 << 25))
    assert len(table.current().facts["note"]) == 1 << 25


# tables in buckets


@pytest.fixture
def keyed(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), spark.range(0).select("id", F.lit("a").alias("v"), F.lit(0).alias("n")).schema, ["id"], 16)
    table.upsert(start(spark))
    return table


def start(spark):
    return spark.range(400).select("id", F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 10).cast("int").alias("n"), F.lit(INSERT).alias(OPERATION))


def files(table):
    return {b: tuple(n for n in table.folder.names(b) if n.startswith("part")) for b in table.folder.names("") if b.startswith(buckets.BUCKET)}


def changed(before, after):
    return {b for b in {*before, *after} if before.get(b) != after.get(b)}


def changes(spark, *given):
    return spark.createDataFrame(given, f"id int, v string, {OPERATION} string")


def test_a_pass_of_one_key_rewrites_one_bucket(spark, keyed):
    state, before = spark.createDataFrame(keyed.read().collect(), keyed.schema), files(keyed)
    assert len(before) == 16
    staged = changes(spark, (5, "new", UPDATE))
    assert len(keyed.upsert(staged)) == 1
    assert len(changed(before, files(keyed))) == 1
    assert rows(keyed.read()) == rows(writers.upsert(state, staged, ["id"]))
    # its key is an int here, a long there: they meet in one bucket
    assert keyed.read().filter("id = 5").first()["v"] == "new" and keyed.read().count() == 400


def test_only_buckets_of_the_pass_are_read(spark, keyed):
    plan = keyed.read(keyed.buckets_of(keyed.read().filter("id = 5")))._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({buckets.BUCKET}" in plan
    assert keyed.read([3]).select(F.input_file_name()).distinct().count() == 1 and keyed.read([]).count() == 0


def test_bucket_writers_agree_with_whole_table_writers(spark, keyed):
    whole = lambda: spark.createDataFrame(keyed.read().collect(), keyed.schema)
    staged = changes(spark, *[(i, f"u{i}", DELETE if i % 3 == 0 else UPDATE) for i in range(0, 60, 4)], (1000, "in", INSERT))
    before = whole()
    keyed.upsert(staged)
    assert rows(keyed.read()) == rows(writers.upsert(before, staged, ["id"]))
    scope, before, listed = F.col("id") >= 380, whole(), files(keyed)
    inside = staged.filter("id >= 380")
    touched = keyed.merge_reconcile(inside, scope)
    assert rows(keyed.read()) == rows(writers.merge_reconcile(before, inside, ["id"], scope))
    assert len(changed(listed, files(keyed))) == len(touched) < 16
    before, lines = whole(), changes(spark, (3, "z", INSERT), (4, "z", INSERT))
    keyed.delete_insert(lines, F.col("id").isin(3, 4))
    assert rows(keyed.read()) == rows(writers.delete_insert(before, lines.select("id", "v", OPERATION), F.col("id").isin(3, 4)))
    before = whole()
    keys = before.filter("id NOT IN (7, 9)").select("id")
    assert len(keyed.reconcile_deletes(keys, None, writers.Guard("ratio", 0.5))) <= 2
    assert rows(keyed.read()) == rows(writers.reconcile_deletes(before, keys, ["id"]))
    with pytest.raises(writers.GuardRefused):
        keyed.reconcile_deletes(keys.limit(3), None, writers.Guard("ratio", 0.5))


def test_a_bucket_that_empties(spark, keyed):
    bucket = keyed.buckets_of(keyed.read().filter("id = 5"))
    keyed.upsert(keyed.read(bucket).withColumn(OPERATION, F.lit(DELETE)))
    assert f"{buckets.BUCKET}={bucket[0]}" not in files(keyed) and keyed.read(bucket).count() == 0
    keyed.upsert(changes(spark, (5, "again", INSERT)))
    assert rows(keyed.read(bucket)) == [(5, "again", None)]
    assert keyed.upsert(changes(spark, (5, "x", INSERT)).limit(0)) == []


@pytest.mark.parametrize("step", ["rows", "ready", "half"])
def test_an_interrupted_pass(spark, keyed, monkeypatch, step):
    """Before the new rows are whole nothing has changed; after that the pass is carried out, even from
    the point where Spark has deleted a bucket and not yet put the new one in its place."""
    staged = changes(spark, *[(i, "new", UPDATE) for i in range(40)])
    state = spark.createDataFrame(keyed.read().collect(), keyed.schema)

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(keyed.folder if step == "rows" else keyed, "create" if step == "rows" else "recover", stop)
    with pytest.raises(KeyboardInterrupt):
        keyed.upsert(staged)
    monkeypatch.undo()
    if step == "half":
        keyed.folder.delete(f"{buckets.BUCKET}={keyed.buckets_of(staged.select(F.col('id').cast('long')))[0]}")
    again = KeyedTable(spark, keyed.folder.path)
    assert rows(again.read()) == rows(state if step == "rows" else writers.upsert(state, staged, ["id"]))
    assert again.folder.names(buckets.PENDING) == []
    again.upsert(staged)
    assert rows(again.read()) == rows(writers.upsert(state, staged, ["id"]))


def test_a_pass_interrupted_between_two_buckets(spark, keyed, monkeypatch):
    """Some buckets are in their places and some aside; one is emptied."""
    gone = keyed.buckets_of(keyed.read().filter("id = 5"))
    before = keyed.read()
    staged = before.withColumn(OPERATION, F.when(keyed.bucket() == gone[0], DELETE).otherwise(UPDATE)).withColumn("n", F.lit(77))
    want = rows(writers.upsert(spark.createDataFrame(before.collect(), keyed.schema), spark.createDataFrame(staged.collect(), staged.schema), ["id"]))
    move, moved = keyed.folder.move, []

    def stop(name, place):
        if len(moved) == 3:
            raise KeyboardInterrupt
        moved.append(place)
        move(name, place)

    monkeypatch.setattr(keyed.folder, "move", stop)
    with pytest.raises(KeyboardInterrupt):
        keyed.upsert(staged)
    assert len(keyed.filled(f"{buckets.PENDING}/rows")) == 12
    again = KeyedTable(spark, keyed.folder.path)
    assert rows(again.read()) == want and gone[0] not in again.filled() and len(again.filled()) == 15
    assert again.folder.names(buckets.PENDING) == []


def test_new_rows_are_written_once(spark, keyed, monkeypatch):
    """What was written aside is moved to the table, not read and written again."""
    recover = keyed.recover
    monkeypatch.setattr(keyed, "recover", lambda: None)
    keyed.upsert(changes(spark, (5, "new", UPDATE), (6, "new", UPDATE)))
    aside = {f"{buckets.BUCKET}={b}": keyed.folder.names(f"{buckets.PENDING}/rows/{buckets.BUCKET}={b}") for b in keyed.filled(f"{buckets.PENDING}/rows")}
    assert 1 <= len(aside) <= 2
    recover()
    assert all(keyed.folder.names(b) == names for b, names in aside.items())
    assert rows(keyed.read().filter("v = 'new'").select("id")) == [(5,), (6,)] and keyed.read().count() == 400


def test_staged_rows_are_read_once(spark, keyed, tmp_path):
    """By a first load, and where a scope meets all buckets; else twice, so that only their buckets are read."""
    seen = spark.sparkContext.accumulator(0)

    def count(_):
        seen.add(1)
        return True

    counted = F.udf(count, "boolean").asNondeterministic()  # else Spark infers the same filter for the target

    def read_by(action):
        before = seen.value
        action()
        return seen.value - before

    table = KeyedTable.create(spark, str(tmp_path / "u"), keyed.schema, ["id"], 16)
    staged = start(spark).filter(counted("id"))
    assert read_by(lambda: table.upsert(staged.limit(0))) == 0 and table.filled() == []
    assert read_by(lambda: table.upsert(staged)) == 400 and table.filled() == list(range(16))
    assert read_by(lambda: table.delete_insert(staged, F.col("id") >= 0)) == 400
    assert read_by(lambda: table.merge_reconcile(staged, F.col("id") >= 0)) == 400
    assert read_by(lambda: table.upsert(staged)) == 800
    assert rows(table.read()) == rows(start(spark).drop(OPERATION))


def test_null_and_repeated_keys_without_a_key_to_match(spark, keyed):
    """A delete-insert needs no key: rows without one and repeated rows stay, in a bucket of their own hash."""
    lines = changes(spark, (None, "x", INSERT), (None, "x", INSERT), (3, "y", INSERT), (3, "y", INSERT), (4, "z", DELETE))
    before = spark.createDataFrame(keyed.read().collect(), keyed.schema)
    for scope in (F.col("id") < 10, F.col("id").isNull(), F.col("id") >= 0):
        keyed.delete_insert(lines, scope)
        before = spark.createDataFrame(writers.delete_insert(before, keyed.conformed(lines), scope).collect(), keyed.schema)
        assert rows(keyed.read()) == rows(before)


def test_passes_and_streams_into_buckets(spark, keyed, tmp_path):
    source = start(spark).withColumn("v", F.lit("s")).withColumn("id", F.col("id") + 390)
    read = lambda p, i: Read(source.filter(F.col("id") > (p or 0)), 789)
    job = passes.Job(("m", "a", "b"), read, lambda t, s: writers.upsert(t, s, ["id"]), keyed, Positions(spark, str(tmp_path / "p")), staging=str(tmp_path / "s"))
    passes.run_pass(job)
    passes.run_pass(job)
    assert keyed.read().count() == 790 and keyed.read().filter("v = 's'").count() == 400
    each = continuous.upsert_batches(keyed)
    for _ in range(2):
        each(changes(spark, (1, "stream", UPDATE), (2, None, DELETE)), 0)
    assert keyed.read().filter("v = 'stream'").count() == 1 and keyed.read().count() == 789


def test_a_dimension_in_buckets(spark, tmp_path):
    staged = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(INSERT).alias(OPERATION))
    now, later = __import__("datetime").datetime(2024, 1, 1), __import__("datetime").datetime(2024, 2, 1)
    empty = scd2.empty_target(staged, ["k"], ["v"])
    table = KeyedTable.create(spark, str(tmp_path / "d"), empty.schema, ["k"], 8)
    table.apply(staged, lambda t, s: scd2.apply(t, s, ["k"], ["v"], now))
    state, before = spark.createDataFrame(table.read().collect(), table.schema), files(table)
    change = staged.filter("k = 7").withColumn("v", F.lit("b"))
    table.apply(change, lambda t, s: scd2.apply(t, s, ["k"], ["v"], later))
    assert rows(table.read()) == rows(scd2.apply(state, change, ["k"], ["v"], later)) and table.read().count() == 101
    assert len(changed(before, files(table))) == 1


def test_bad_tables(spark, tmp_path):
    for keys, n in ((["x"], 4), ([], 4), (["id"], 0)):
        with pytest.raises(ValueError):
            KeyedTable.create(spark, str(tmp_path / f"b{n}{len(keys)}"), spark.range(0).schema, keys, n)
    KeyedTable.create(spark, str(tmp_path / "t"), spark.range(0).schema, ["id"], 4)
    with pytest.raises(Exception):
        KeyedTable.create(spark, str(tmp_path / "t"), spark.range(0).schema, ["id"], 8)
    assert os.path.exists(tmp_path / "t" / buckets.ABOUT) and KeyedTable(spark, str(tmp_path / "t")).buckets == 4


def test_null_keys_are_refused(spark, keyed):
    with pytest.raises(Exception, match="a staged row has no key"):
        writers.upsert(keyed.read(), changes(spark, (None, "x", INSERT)), ["id"]).collect()
    with pytest.raises(Exception, match="several staged rows of one key"):
        writers.upsert(keyed.read(), changes(spark, (1, "x", INSERT), (1, "y", INSERT)), ["id"]).collect()
