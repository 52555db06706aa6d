"""The driver's functions, and the engine without the training-data operators."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewell.model import CHANGED_AT, OPERATION, ORDERING
from tidewell.operators import scd2, writers
from tidewell.plans.store import VersionedTable
from tidewell.streaming import continuous

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_flagship(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and found.columns == ["version_key", "k", "v", "valid_from", "valid_to", "is_current"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators():
    """They may be deleted: the entry still imports and has the engine's queries."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("True"), done.stderr


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidewell")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"import.*\bllm\b|\bllm\b.*import", f.read()), name


def test_a_batch_that_comes_twice(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(0))
    each = continuous.apply_batches(table, lambda target, batch: target.unionByName(batch))
    each(spark.range(3), 0)
    each(spark.range(3), 0)
    each(spark.range(2), 1)
    assert table.read().count() == 5 and table.current().number == 3


def test_plans_shuffle_once(spark):
    """An upsert needs one exchange for each side."""
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"), F.lit("U").alias("__operation"))
    plan = writers.upsert(rows.select("k", "v").groupBy("k").agg(F.max("v").alias("v")), rows.dropDuplicates(["k"]), ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(k") <= 2 and "Cartesian" not in text and "NestedLoop" not in text


def test_a_chain_shuffles_once(spark):
    """A chain of versions needs one exchange of the changes, which its windows and its join share, and
    one of the dimension's open rows."""
    at = F.timestamp_seconds("id").cast("timestamp_ntz")
    staged = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").cast("string").alias("v"), F.lit("U").alias(OPERATION), F.lpad(F.col("id").cast("string"), 9, "0").alias(ORDERING), at.alias(CHANGED_AT))
    target = scd2.many_versions(scd2.empty_target(staged, ["k"], ["v"]), staged.filter("k < 40"), ["k"], ["v"])
    dimension = spark.createDataFrame(target.collect(), target.schema)
    assert dimension.count() == 800
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = scd2.boundaries(dimension, staged, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert text.count("Window [") == 2 and text.count("Exchange hashpartitioning(k") == 2
    assert text.count("Exchange") == 2 and "Cartesian" not in text and "NestedLoop" not in text
