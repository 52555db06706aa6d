"""Values that a target's column can't hold; databases; differences by checksums; segments in one scan."""

import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import typed
from tidewell.model import ColumnMapping, Full, ListOf, Mapping, Range
from tidewell.operators import verify
from tidewell.sources import connectors, readers


def field(kind, nullable=True):
    return T.StructType([T.StructField("c", kind, nullable)])


CASES = [
    ("string", "12", T.IntegerType(), 12, None), ("string", " 12 ", T.IntegerType(), 12, None), ("string", "", T.IntegerType(), None, typed.NO_TYPE), ("string", "12.0", T.IntegerType(), None, typed.NO_TYPE),
    ("string", "12.5", T.IntegerType(), None, typed.NO_TYPE), ("string", "3000000000", T.IntegerType(), None, typed.NO_TYPE), ("string", "x", T.DoubleType(), None, typed.NO_TYPE),
    ("string", "1.239", T.DecimalType(4, 2), Decimal("1.24"), typed.INEXACT), ("string", "123.4", T.DecimalType(4, 2), None, typed.NO_TYPE), ("string", "yes", T.BooleanType(), True, None), ("string", "perhaps", T.BooleanType(), None, typed.NO_TYPE),
    ("string", "2024-02-30", T.DateType(), None, typed.NO_TYPE), ("string", "2024-02-29", T.DateType(), dt.date(2024, 2, 29), None), ("string", "abc", T.VarcharType(3), "abc", None), ("string", "abcd", T.VarcharType(3), "abcd", typed.TOO_LONG),
    ("bigint", 40000, T.ShortType(), None, typed.NO_TYPE), ("bigint", -5, T.ByteType(), -5, None), ("bigint", 123456, T.DecimalType(4, 0), None, typed.NO_TYPE), ("bigint", 7, T.StringType(), "7", None), ("bigint", 1234, T.VarcharType(3), "1234", typed.TOO_LONG),
    ("double", 1.5, T.IntegerType(), 1, typed.INEXACT), ("double", 2.0, T.IntegerType(), 2, None), ("double", float("nan"), T.IntegerType(), None, typed.NO_TYPE), ("double", 0.1, T.FloatType(), pytest.approx(0.1), None),
    ("decimal(10,4)", Decimal("1.5000"), T.DecimalType(4, 2), Decimal("1.50"), None), ("decimal(10,4)", Decimal("1.5001"), T.DecimalType(4, 2), Decimal("1.50"), typed.INEXACT), ("int", None, T.ShortType(), None, None),
]


def test_values_and_reasons(spark):
    for given, value, kind, want, reason in CASES:
        row = typed.typed(spark.createDataFrame([(value,)], f"c {given}"), field(kind)).first()
        reasons = [r["reason"] for r in row[typed.REFUSED]]
        assert reasons == ([reason] if reason else []), (given, value, kind)
        assert row["c"] == want, (given, value, kind)


def test_rows_that_fit_and_rows_that_do_not(spark):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("n", T.ByteType()), T.StructField("must", T.StringType(), False)])
    rows = spark.createDataFrame([("1", 5, "a", "U"), ("x", 500, "b", "I"), (None, 1, "c", "D"), ("4", None, None, "U")], "id string, n int, must string, `__operation` string")
    good, refused = typed.split(rows, schema)
    assert [tuple(r) for r in good.collect()] == [(1, 5, "a", "U")] and good.schema["id"].dataType == T.LongType() and good.columns == rows.columns
    found = sorted(((r["row"]["id"], r["column"], r["value"], r["reason"]) for r in refused.collect()), key=repr)
    assert found == sorted([("x", "id", "x", typed.NO_TYPE), ("x", "n", "500", typed.NO_TYPE), (None, "id", None, typed.MISSING), ("4", "must", None, typed.MISSING)], key=repr)
    with pytest.raises(Exception, match="column id can't hold x: not of the type"):
        typed.strict(rows.filter("id = 'x'"), schema).collect()
    assert typed.strict(rows.limit(1), schema).collect() == good.collect()
    counts = {(r["column"], r["reason"]): r["values"] for r in typed.refusals(rows.drop("must"), schema).collect()}
    assert counts[("must", typed.MISSING)] == 4 and counts[("n", typed.NO_TYPE)] == 1


def test_whole_numbers_are_those_of_a_cast(spark):
    """Texts and numbers at the ends of each type, and texts with signs, spaces, control characters and other digits."""
    texts = ["12", "+12", "-12", "\t12\n", "\x00 12\x7f", "0000000000000000000000012", "12\u0085", "\u00a012", "\u0661\u0662", "1e2", "1.0", "1 2", "--1", "+", "-", "", " ", "x", "99999999999999999999", None]
    ends = [sign * (1 << bits) + more for bits in (7, 15, 31, 63) for sign in (1, -1) for more in (-1, 0, 1)]
    longs = [(n,) for n in ends if -(1 << 63) <= n < 1 << 63] + [(None,)]
    for rows in (spark.createDataFrame([(t,) for t in [*texts, *map(str, ends)]], "c string"), spark.createDataFrame(longs, "c bigint")):
        for kind in (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()):
            found = typed.typed(rows.select("c", F.col("c").alias("given"), F.col("c").try_cast(kind).alias("cast")), field(kind)).collect()
            assert all(r["c"] == r["cast"] for r in found), kind
            assert all([x["reason"] for x in r[typed.REFUSED]] == [typed.NO_TYPE] * (r["cast"] is None and r["given"] is not None) for r in found), kind


def test_refusals_are_found_once(spark):
    rows = spark.range(100).select(F.concat(F.col("id"), F.lit("0")).alias("t"), (F.col("id") * 1000).alias("n"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"))
    schema = T.StructType([T.StructField("t", T.ByteType()), T.StructField("n", T.ShortType()), T.StructField("k", T.LongType(), False), T.StructField("gone", T.DateType(), False)])
    found = typed.refusals(rows, schema)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "Filter " not in plan  # compiled, and no filter that computes it all again
    assert {(r["column"], r["reason"]): r["values"] for r in found.collect()} == {("t", typed.NO_TYPE): 87, ("n", typed.NO_TYPE): 67, ("k", typed.MISSING): 66, ("gone", typed.MISSING): 100}
    assert typed.refusals(rows.limit(0), schema).collect() == [] and typed.refusals(rows, T.StructType([])).collect() == []


# databases


@pytest.fixture
def database(spark):
    url = connectors.derby(spark, f"/t{id(object())}x{dt.datetime.now().microsecond}")
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("n"), F.concat(F.lit("o'"), F.col("id") % 3).alias("s"), F.expr("timestampadd(HOUR, id, TIMESTAMP_NTZ '2024-01-01')").alias("at"))
    connectors.write(rows, "jdbc", url, dbtable="t", driver=connectors.DERBY, createTableColumnTypes="s VARCHAR(16)")
    return connectors.Source("jdbc", url, options={"driver": connectors.DERBY}), rows


def test_segments_of_a_database(spark, database):
    source, rows = database
    parts = [Range("id", 0, 400), Range("id", 400, 401), Range("id", 401, 900)]
    found = connectors.jdbc_segments(spark, source, "t", parts)
    assert found.rdd.getNumPartitions() == 3 and found.count() == 900
    assert [len(p) for p in found.select("id").rdd.glom().collect()] == [400, 1, 499]
    assert connectors.jdbc_segments(spark, source, "t", [ListOf("s", ("o'1", "zz"))]).count() == 333
    assert connectors.jdbc_segments(spark, source, "t", [Range("at", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))]).count() == 24
    assert connectors.jdbc_segments(spark, source, "t", [Full()]).count() == 1000 and connectors.jdbc_segments(spark, source, "t", []).count() == 0
    with pytest.raises(ValueError):
        connectors.jdbc_segments(spark, source, "t", [ListOf("s", ())])


@pytest.mark.parametrize("master", ["local-cluster[2,2,1024]", "spark://host:7077", "yarn"])
def test_a_cluster_gets_no_embedded_database(master):
    session = SimpleNamespace(sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="driver's alone"):
        connectors.derby(session, "/t")


def test_a_database_gets_the_filters(spark, database):
    source, _ = database
    rows = connectors.jdbc_table(spark, source, "t").filter("n = 3 AND id > 10").select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(n), *IsNotNull(id), *EqualTo(n,3), *GreaterThan(id,10)]" in plan.replace("ID", "id").replace("N)", "n)")
    assert rows.count() == len([i for i in range(11, 1000) if i % 7 == 3])


def test_rows_go_through_a_database(spark, database):
    source, rows = database
    back = readers.watermark(connectors.jdbc_table(spark, source, "t"), Mapping((ColumnMapping("id"), ColumnMapping("at"))), "at", dt.datetime(2024, 2, 1))
    assert back.rows.count() == 1000 - 31 * 24 - 1 and back.position == dt.datetime(2024, 1, 1) + dt.timedelta(hours=999)


# checksums


def both(spark):
    source = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("a"), F.when(F.col("id") % 4 != 0, "x").alias("b"))
    changed = F.when(F.col("k").isin(10, 20), F.lit(None)).otherwise(F.col("a"))
    target = source.filter("k NOT IN (5, 6)").withColumn("a", changed).withColumn("b", F.when(F.col("k") == 8, "y").otherwise(F.col("b")))
    return source, target.unionByName(spark.createDataFrame([(9999, 1, "e")], target.schema))


def test_differences_by_checksums(spark):
    source, target = both(spark)
    want = sorted(map(tuple, verify.row_difference(source, target, ["k"]).collect()))
    for fanout in (2, 16, 1024):
        assert sorted(map(tuple, verify.checked_difference(source, target, ["k"], fanout).collect())) == want
    assert verify.differing_ranges(source, target, ["k"]).count() == 6
    # columns in another order and of another type, as long as the values are the same
    same = source.select("b", F.col("a").cast("decimal(20,0)").alias("a"), F.col("k").cast("int").alias("k"))
    assert verify.differing_ranges(source, same, ["k"]).count() == 0
    one = source.withColumn("a", F.when(F.col("k") == 7, None).otherwise(F.col("a")))
    assert verify.differing_ranges(source, one, ["k"]).count() == 1
    assert verify.checked_difference(source, same, ["k"]).filter("kind = 'matched'").count() == 3000


def test_swapped_values_and_nulls_are_differences(spark):
    kind = "k long, a string, b string"
    source = spark.createDataFrame([(1, "x", None), (2, "p", "q"), (3, "r", "s")], kind)
    target = spark.createDataFrame([(1, None, "x"), (2, "q", "p"), (3, "r", "s")], kind)
    found = {r["k"]: r["kind"] for r in verify.checked_difference(source, target, ["k"]).collect()}
    assert found == {1: "different", 2: "different", 3: "matched"}
    assert verify.checked_difference(source.limit(0), target.limit(0), ["k"]).count() == 0
    assert {r["kind"] for r in verify.checked_difference(source, target.limit(0), ["k"]).collect()} == {"missing"}


# segments


def test_segments_in_one_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("v")).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    mapping = Mapping((ColumnMapping("id", "k"), ColumnMapping("v", "w", "{{column}} + 1")), ("k",))
    parts = [Range("id", 0, 10), Range("id", 20, 30), ListOf("v", (101, 9))]
    found = readers.reload_segments(source, mapping, parts).rows
    counts = {r[0]: r[1] for r in found.groupBy(readers.SEGMENT).count().collect()}
    assert counts == {"id [0, 10)": 10, "id [20, 30)": 10, "v in (101, 9)": 1}
    plan = readers.reload_segments(source, mapping, parts[:2]).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PushedFilters: [Or(" in plan
    assert readers.reload_segments(source, mapping, []).rows.count() == 0
    assert readers.reload_segments(source, Mapping(), [Full()]).rows.count() == 100
