"""The cases that queries over the test tables don't reach."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import types
from tidewell.functions import transforms
from tidewell.functions.expressions import operation_code, ordering
from tidewell.functions.project import auto_map, natural_key, split_keys, used_relationships
from tidewell.model import (
    CHANGED_AT, IS_CURRENT, OPERATION, ORDERING, VALID_FROM, VALID_TO, VERSION_KEY, Auto, ColumnMapping, DuplicateKeys, Full,
    GuardRefused, Hold, Intent, ListOf, Mapping, PositionExpired, Range, Relationship,
)
from tidewell.operators import metrics, scd2, verify, writers
from tidewell.plans import passes, provision, segments
from tidewell.plans.store import Positions, ReadState, VersionedTable
from tidewell.sources import changelog, connectors, readers

NOW = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# segments


@pytest.mark.parametrize(
    "low, high, n, expected",
    [
        (1, 10, 3, [(1, 4), (4, 7), (7, 11)]),
        (1, 10, 4, [(1, 3), (3, 5), (5, 7), (7, 11)]),
        (5, 42, 1, [(5, 43)]),
        (7, 7, 5, [(7, 8)]),
        (-9, -1, 2, [(-9, -5), (-5, 0)]),
    ],
)
def test_whole_number_ranges(low, high, n, expected):
    assert segments.cut(low, high, n, "integral") == expected


def test_decimal_and_time_ranges():
    d = Decimal
    assert segments.cut(d(0), d(10), 4, "numeric") == [(d(0), d("2.5")), (d("2.5"), d(5)), (d(5), d("7.5")), (d("7.5"), d(11))]
    found = segments.cut(dt.date(2024, 1, 1), dt.date(2024, 1, 11), 2, "temporal")
    assert found == [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 6)), (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 12))]


def test_segments_that_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    with pytest.raises(ValueError):
        segments.cut(1, 2, 0, "integral")
    with pytest.raises(ValueError):
        segments.expand(Auto("s", 2), df)
    with pytest.raises(ValueError):
        readers.reload(df, Mapping(), ListOf("i", ()))
    with pytest.raises(ValueError):
        readers.reload(df, Mapping(), Auto("i", 2))
    with pytest.raises(ValueError):
        readers.reload(df, Mapping(), Range("nowhere", 1, 2))
    assert segments.expand(Auto("i", 3), df.limit(0)) == [Full()]


def test_custom_segments_need_selected_and_bounds(spark):
    assert segments.custom(spark, "SELECT 'a' AS label, 1 AS range_start, 2 AS range_end", "i") == []
    with pytest.raises(ValueError):
        segments.custom(spark, "SELECT 'a' AS label, 1 AS range_start, CAST(NULL AS INT) AS range_end, true AS selected", "i")


def test_range_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("x", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = readers.reload(df, Mapping((ColumnMapping("id"),)), Range("id", 5, 9)).rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,5)" in plan and "LessThan(id,9)" in plan
    assert "ReadSchema: struct<id:bigint>" in plan


# reading


def test_unused_relationships_are_not_joined(spark):
    base, other = spark.range(3), spark.range(3).withColumnRenamed("id", "k")
    mapping = Mapping((ColumnMapping("id"),), relationships=(Relationship("r", other, (("id", "k"),)),))
    assert used_relationships(mapping) == []
    assert "Join" not in readers.reload(base, mapping).rows._jdf.queryExecution().toString()


def test_watermark_positions(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30), (5, None)], "id int, v int")
    first = readers.watermark(df, Mapping(), "v", None, 2)
    assert [r[0] for r in rows(first.rows, "id")] == [1, 2, 3, 5] and first.position == 20
    then = readers.watermark(df, Mapping(), "v", first.position, 2)
    assert [r[0] for r in rows(then.rows, "id")] == [4] and then.position == 30
    last = readers.watermark(df, Mapping(), "v", 30, 2)
    assert rows(last.rows, "id") == [] and last.position == 30
    assert readers.watermark(df, Mapping(), "v", 10).position == 30
    assert readers.watermark(df.limit(0), Mapping(), "v", 10).position == 10
    latest = readers.watermark(df, Mapping(), "v", intent=Intent.FROM_LATEST)
    assert latest.rows.count() == 0 and latest.position == 30


def test_positions_as_text():
    for value in (None, 7, 1.5, "x", dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.date(2024, 1, 2), Decimal("1.20"), b"\x00\xff"):
        assert readers.parse_position(readers.format_position(value)) == value


def test_keys_that_cannot_be_read(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        readers.keys_only(df, Mapping(), [])
    with pytest.raises(ValueError):
        readers.keys_only(df, Mapping((ColumnMapping("other"),)), ["id"])


def test_poll_gate():
    assert readers.unchanged(5, 5) and readers.unchanged(6, 5)
    assert not readers.unchanged(4, 5) and not readers.unchanged(None, 5) and not readers.unchanged(5, None)


def test_expired_position(spark):
    log = spark.createDataFrame([(10, 1, "U"), (14, 2, "D")], "seq long, k long, op string")
    for read in (
        lambda at: changelog.captured_net(log, ["k"], [], "seq", "op", at, reaches=9),
        lambda at: changelog.net_changes(log, log.select("k"), ["k"], "seq", "op", at, reaches=9),
        lambda at: changelog.versions(log, ["k"], "seq", "op", at, None, reaches=9),
        lambda at: changelog.all_changes(log, ["k"], "seq", "seq", F.col("op"), "seq", at, reaches=9),
    ):
        assert read(9).rows.count() == 2 and read(None).rows.count() == 2
        with pytest.raises(PositionExpired):
            read(8)


def test_before_images_are_refused(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "c int")
    assert [r[0] for r in df.select(operation_code(F.col("c"))).collect()] == ["D", "I", "U"]
    with pytest.raises(Exception, match="unknown change operation 3"):
        spark.createDataFrame([(3,)], "c int").select(operation_code(F.col("c"))).collect()


def test_ordering_text_sorts_like_numbers(spark):
    df = spark.createDataFrame([(9, 300), (10, 2), (10, 17), (255, 1), (256, 0)], "a long, b long")
    assert rows(df.select("a", "b", ordering(F.col("a"), F.col("b")).alias("o")).orderBy("o"), "a") == rows(df, "a")


def test_log_record_keys_of_an_update(spark):
    text = '{"action":"U","columns":[{"name":"v","value":null}],"identity":[{"name":"k","value":"7"},{"name":"v","value":"old"}]}'
    log = spark.createDataFrame([(1, text), (2, '{"action":"B"}')], "seq int, data string")
    found = changelog.logical_records(log, "data", {"k": "int", "v": "string"}, ["seq"])
    assert rows(found, "seq", "k", "v", OPERATION) == [(1, 7, None, "U")]


def test_connectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        at = str(tmp_path / kind)
        connectors.write(df, kind, at, **({"header": "true"} if kind == "csv" else {}))
        back = connectors.open_source(spark, connectors.Source(kind, at, "i int, s string"))
        assert rows(back, "i", "s") == [(1, "a"), (2, "b")]
    assert connectors.columns(df, ["s"])[1] == {"name": "s", "type": "string", "nullable": True, "key": 0}
    assert connectors.row_estimate(df) == 2


# mapping


def test_mapping_helpers():
    assert [c.name for c in auto_map(["a", "B"], ["A", "B"])] == ["B"]
    assert [c.name for c in auto_map(["a"], [])] == ["a"] and auto_map([], ["a"]) == []
    mapping = Mapping((ColumnMapping("OrderId", "id"), ColumnMapping("Sku")), ("id",))
    assert natural_key(mapping, ["OrderId"]) == ["id"] and natural_key(mapping, ["OrderId", "Line"]) == []
    assert split_keys(mapping) == (["id"], ["Sku"])
    with pytest.raises(ValueError):
        split_keys(Mapping((ColumnMapping("Sku"),), ("id",)))


def test_types():
    assert types.to_spark("decimal(18,2)").type == T.DecimalType(18, 2)
    assert types.to_spark("string(max)").type == T.StringType()
    assert types.to_spark("decimal(40,2)").fidelity and types.to_spark("timestamp(7)").fidelity and types.to_spark("guid").fidelity
    assert types.to_spark("timestamp(3)").fidelity is None
    for kind in (T.LongType(), T.DoubleType(), T.TimestampNTZType(), T.DecimalType(9, 1), T.BinaryType(), T.DateType()):
        assert types.to_spark(types.to_canonical(kind)).type == kind
    with pytest.raises(types.UnmappableType):
        types.to_spark("geometry")
    with pytest.raises(types.UnmappableType):
        types.to_canonical(T.ArrayType(T.LongType()))


def test_hooks(spark):
    assert transforms.render_hook("x {{target}}", {"target": "t"}) == "x t"
    with pytest.raises(ValueError):
        transforms.render_hook("{{staging}}", {"target": "t"})
    with pytest.raises(Exception):
        transforms.run_hook(spark, "SELECT * FROM nowhere_at_all", {})
    with pytest.warns(UserWarning):
        assert transforms.run_hook(spark, "SELECT * FROM nowhere_at_all", {}, on_error="warn") is None


# writers


def staged(spark, *values):
    return spark.createDataFrame(list(values), f"id int, name string, {OPERATION} string")


def test_upsert_refuses_two_rows_of_a_key(spark):
    with pytest.raises(DuplicateKeys):
        writers.one_per_key(staged(spark, (1, "a", "I"), (1, "b", "U")), ["id"])


def test_upsert_keeps_unmapped_columns_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "id int, name string, note string")
    new = writers.upsert(target, staged(spark, (1, "A", "U"), (2, "b", "D"), (3, "c", "I"), (9, "z", "D")), ["id"])
    assert rows(new, "id", "name", "note") == sorted([(1, "A", "x"), (3, "c", None), (None, "n", "z")], key=repr)


def test_scope_that_is_null_is_out_of_scope(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    new = writers.delete_insert(target, staged(spark, (5, "a", "I"), (6, "a", "D")), F.col("name") == "a")
    assert rows(new, "id") == [(2,), (5,)]


@pytest.mark.parametrize("deleted, scope, fine", [(40, 100, True), (50, 100, True), (60, 100, False), (0, 0, True)])
def test_guard(deleted, scope, fine):
    guard = writers.Guard("ratio", 0.5)
    if fine:
        guard.check(deleted, scope)
    else:
        with pytest.raises(GuardRefused):
            guard.check(deleted, scope)
    writers.Guard("none").check(100, 100)


def test_snapshot_twice(spark):
    one = staged(spark, (1, "a", "I"), (1, "a", "D"))
    empty = writers.stamped(one.limit(0), NOW)
    assert writers.snapshot(writers.snapshot(empty, one, NOW), one, NOW).count() == 4


# dimensions


def dimension(spark, *values):
    return spark.createDataFrame(list(values), f"{VERSION_KEY} string, id int, name string, {VALID_FROM} timestamp_ntz, {VALID_TO} timestamp_ntz, {IS_CURRENT} boolean")


@pytest.mark.parametrize(
    "before, change, after",
    [
        ("a", (1, "a", "U"), [("a", True)]),
        ("a", (1, None, "U"), [("a", False), (None, True)]),
        (None, (1, "a", "U"), [("a", True), (None, False)]),
        ("a", (1, "a", "D"), [("a", False)]),
        ("a", (2, "b", "I"), [("a", True), ("b", True)]),
        ("a", (2, "b", "D"), [("a", True)]),
    ],
)
def test_close_and_open(spark, before, change, after):
    target = dimension(spark, ("v", 1, before, dt.datetime(2023, 1, 1), None, True))
    found = scd2.apply(target, staged(spark, change), ["id"], ["name"], NOW)
    assert rows(found, "name", IS_CURRENT) == sorted(after, key=repr)


def test_version_chain(spark):
    """Keys with several changes chain; a change of nothing is no version; single ones get
    the pass's prefix."""
    at = lambda i: dt.datetime(2024, 1, 1, 0, i)
    changes = [
        (1, "a", "I", "01", at(1)), (1, "b", "U", "02", at(2)), (1, "c", "U", "03", at(3)),
        (2, "p", "I", "04", at(4)), (2, "p", "U", "05", at(5)), (2, "q", "U", "06", at(6)), (2, "q", "D", "07", at(7)),
        (3, "x", "I", "08", at(8)),
    ]
    log = spark.createDataFrame(changes, f"id int, name string, {OPERATION} string, {ORDERING} string, {CHANGED_AT} timestamp_ntz")
    target = dimension(spark, ("old", 1, "z", dt.datetime(2023, 1, 1), None, True))
    found = scd2.apply(target, log, ["id"], ["name"], NOW)
    assert rows(found, "id", "name", VALID_TO, IS_CURRENT, VERSION_KEY) == sorted(
        [
            (1, "z", at(1), False, "old"),
            (1, "a", at(2), False, "01|1"),
            (1, "b", at(3), False, "02|1"),
            (1, "c", None, True, "03|1"),
            (2, "p", at(6), False, "04|2"),
            (2, "q", at(7), False, "06|2"),
            (3, "x", None, True, "20240102030405678-3"),
        ],
        key=repr,
    )
    assert scd2.apply(found, log, ["id"], ["name"], NOW).select(VERSION_KEY).distinct().count() >= 7


def test_replayed_chain_adds_nothing(spark):
    log = spark.createDataFrame(
        [(1, "a", "I", "01", NOW), (1, "b", "U", "02", NOW)], f"id int, name string, {OPERATION} string, {ORDERING} string, {CHANGED_AT} timestamp_ntz"
    )
    empty = scd2.empty_target(log, ["id"], ["name"])
    once = scd2.apply(empty, log, ["id"], ["name"], NOW)
    twice = scd2.apply(once, log, ["id"], ["name"], NOW)
    assert rows(twice, VERSION_KEY) == rows(once, VERSION_KEY)


# verification


def test_compare_counts_missing_as_zero(spark):
    s = spark.createDataFrame([("n", 10.0), ("s", None), ("w", 0.0)], "g string, m double")
    t = spark.createDataFrame([("n", 7.0), ("s", 0.0), ("e", 1.0)], "g string, m double")
    found = {r["g"]: r for r in verify.compare(s, t, ["g"], ["m"]).collect()}
    assert found["n"]["m_difference"] == -3 and found["n"]["status"] == verify.DIFFERS
    assert found["s"]["status"] == verify.MATCH and found["s"]["m_source"] is None
    assert found["w"]["status"] == verify.ONLY_SOURCE and found["e"]["status"] == verify.ONLY_TARGET
    relaxed = {r["g"]: r["status"] for r in verify.compare(s, t, ["g"], ["m"], 0.3).collect()}
    assert relaxed["n"] == verify.MATCH
    whole = verify.compare(s.agg(F.sum("m").alias("m")), t.agg(F.sum("m").alias("m")), [], ["m"])
    assert rows(whole, "m_difference", "status") == [(-2.0, verify.DIFFERS)]


def test_sum_check_needs_a_measure(spark):
    with pytest.raises(ValueError):
        verify.grouped(spark.range(2), {}, {})


def test_saved_result(spark, tmp_path):
    result = verify.compare(spark.createDataFrame([("a", 1.0)], "g string, m double"), spark.createDataFrame([("a", 1.0)], "g string, m double"), ["g"], ["m"])
    verify.save(result, str(tmp_path / "r"), {"check": "c"})
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    assert spark.read.text(str(tmp_path / "r.facts")).first()[0] == '{"check": "c"}'


# reports and schedule


def test_empty_window_and_limits(spark):
    none = spark.createDataFrame([], "run_id long, status string, started_at timestamp_ntz, rows_read long, ended_at timestamp_ntz, enqueued_at timestamp_ntz")
    assert rows(metrics.totals(none)) == [(0, 0, 0, 0)]
    assert metrics.histogram(none, "started_at", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 999).count() == 200
    assert metrics.doomed(none, ["status"]).count() == 0


def test_due():
    t = dt.datetime(2024, 1, 1)
    assert metrics.due(None, None, t) and metrics.due(t, t, t) and not metrics.due(t + dt.timedelta(1), t, t)
    hour = dt.timedelta(hours=1)
    assert metrics.reconcile_due(1, None, t, "any", hour) and not metrics.reconcile_due(0, None, t, "any", hour)
    assert not metrics.reconcile_due(1, t, t, "any", hour) and not metrics.reconcile_due(1, None, t, "none", hour)


# state


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    table.publish(spark.range(2), note="x")
    pinned = table.read()
    table.publish(table.read().union(spark.range(3)), 1)
    assert pinned.count() == 2 and table.read().count() == 5 and table.current().number == 2
    with pytest.raises(RuntimeError):
        table.publish(spark.range(1), expected=1)
    table.publish(spark.range(1))
    assert table.retire(1) == [1, 2] and table.read().count() == 1


def test_a_pass_that_is_repeated_after_a_crash(spark, tmp_path):
    """The data was published and the position was not: the replay doesn't append again."""
    table, positions = VersionedTable(spark, str(tmp_path / "t")), Positions(spark, str(tmp_path / "p"))
    source = spark.range(5).withColumn("v", F.col("id"))
    table.publish(source.limit(0))
    read = lambda position, intent: readers.watermark(source, Mapping(), "v", position)
    append = lambda target, rows_: target.unionByName(rows_.drop(OPERATION))
    job = passes.Job(("t", "m", "s"), read, append, table, positions)
    passes.run_pass(job)
    positions.put(job.key, ReadState(Intent.INITIAL_LOAD, Hold.NONE, None, None, 0))
    after = passes.run_pass(job)
    assert table.read().count() == 5 and after.position == 4 and after.pass_id == 1


def test_holds(spark, tmp_path):
    table, positions = VersionedTable(spark, str(tmp_path / "t")), Positions(spark, str(tmp_path / "p"))
    table.publish(spark.range(0))

    def expired(position, intent):
        raise PositionExpired("gone")

    job = passes.Job(("t", "m", "s/x"), expired, lambda t, s: t, table, positions)
    with pytest.raises(PositionExpired):
        passes.run_pass(job)
    assert positions.get(job.key).hold is Hold.EXPIRED
    assert passes.run_pass(job).hold is Hold.EXPIRED
    passes.resume(job, Intent.INITIAL_LOAD)
    passes.pause(job)
    assert positions.get(job.key).hold is Hold.PAUSED


# provisioning


def test_create_plans(spark):
    source = spark.createDataFrame([], "k int, v string, a array<int>")
    mapping = Mapping((ColumnMapping("k", "id"), ColumnMapping("v"), ColumnMapping("a")), ("id",))
    plan = provision.create_plan(source, mapping, {"v": "guid"})
    assert plan.schema.names == ["id", "v"] and not plan.schema["id"].nullable and plan.keys == ("id",)
    assert set(plan.fidelity) == {"v"} and set(plan.unsupported) == {"a"}
    with pytest.raises(types.UnmappableType):
        provision.create(spark, plan)
    history = provision.create_plan(source, Mapping(mapping.columns[:2], ("id",)), history="scd2")
    assert history.schema.names == [VERSION_KEY, "id", "v", VALID_FROM, VALID_TO, IS_CURRENT] and history.keys == (VERSION_KEY,)
    assert provision.create(spark, history).count() == 0


def test_alter_plans(spark):
    target = spark.createDataFrame([(1, "7")], "id int, a string")
    wanted = T.StructType([T.StructField("id", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DateType())])
    plan = provision.alter_plan(target, wanted, {"a": "b"})
    assert plan.renames == {"a": "b"} and set(plan.added) == {"c"} and set(plan.changed) == {"id"}
    changed = provision.alter(target, plan)
    assert changed.schema.simpleString() == "struct<id:bigint,b:string,c:date>" and rows(changed) == [(1, "7", None)]
    assert provision.alter_plan(changed, wanted).empty
    for bad in ({"a": "id"}, {"a": "x", "id": "x"}):
        with pytest.raises(ValueError):
            provision.alter_plan(target, wanted, bad)
