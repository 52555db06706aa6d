from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.text import pieces, rows


def test_join_with_heavy_keys(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 700).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).filter("k <> 5")
    found = common.join_hot(left, right, "k", "n", 6000)
    want = left.join(right.drop("n"), "k")
    assert found.columns == ["k", "id", "m"] and sorted(found.collect()) == sorted(want.collect())
    assert common.join_hot(left.limit(0), right, "k", "n", 0).count() == 0


def test_join_without_heavy_keys_is_plain(spark):
    left = spark.range(6000).select((F.col("id") % 700).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).filter("k <> 5")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(left.join(right.drop("n"), "k").collect())
    for total, most in ((6000, 9), (6000, 1000), (1000, None)):
        found = common.join_hot(left, right, "k", "n", total, most)
        assert "LeftAnti" not in plan(found) and "broadcast" not in plan(found)
        assert found.columns == ["k", "id", "m"] and sorted(found.collect()) == want
    for total, most in ((6000, 1001), (6000, None)):
        found = common.join_hot(left, right, "k", "n", total, most)
        assert "LeftAnti" in plan(found) and sorted(found.collect()) == want


def test_scratch_tables(spark):
    for narrow in (False, True):
        df = spark.range(100).select("id", F.struct("id").alias("s"))
        back = common.materialize(df, "t", narrow)
        assert back.count() == 100 and back.dtypes == df.dtypes
        assert common.materialize(df.filter("id < 0"), "t", narrow).count() == 0
    assert back.inputFiles()[0].startswith("file:/") and common.scratch_root(spark).rpartition("/")[2] == "shared"


def test_wrapped_rows(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `row` int, text int")
    assert common.wrapped(df, "text").select("row.*").columns == ["a.b", "row", "text"]


def test_word_count(spark):
    texts = ["", None, " a  b\t\nc\x0b\x0cd\r", "x\x1cy z\xa0w"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(common.word_count(F.col("t"))).collect()] == [0, 0, 4, 2]


def test_pieces():
    text = ("word " * 50 + "\n\n  " + "x" * 300 + " end ").encode()
    for limit in (1, 7, 64, 10_000):
        parts = list(pieces(text, limit))
        assert b"".join(parts) == text
        assert all(p[:1].isspace() and not q[-1:].isspace() for q, p in zip(parts, parts[1:]))
    assert list(pieces(b"")) == [b""]


def test_rows_of_a_sliced_array():
    import pyarrow as pa

    array = pa.array(["a", None, "é", "d"]).slice(1, 2)
    assert list(rows(array, 1)) == [b"", "é".encode()]
