import pytest

from tidewell.model import Mapping
from tidewell.operators import writers
from tidewell.plans import passes
from tidewell.plans.store import Positions, VersionedTable
from tidewell.sources import readers

ROWS = [(1, None), (2, 5), (3, 6), (4, 6), (5, 7), (6, None)]


def test_null_positions_come_with_the_first_capped_read(spark):
    source = spark.createDataFrame(ROWS, "id int, at int")
    ids = lambda read: sorted(r["id"] for r in read.rows.collect())
    first = readers.watermark(source, Mapping(), "at", None, 2)
    assert ids(first) == [1, 2, 3, 4, 6] and first.position == 6
    assert ids(readers.watermark(source, Mapping(), "at", 6, 2)) == [5]
    none = readers.watermark(source.filter("at IS NULL"), Mapping(), "at", None, 1)
    assert ids(none) == [1, 6] and none.position is None


def test_passes_that_do_not_end_raise(spark, tmp_path):
    source = spark.createDataFrame(ROWS, "id int, at int")
    table, positions = VersionedTable(spark, f"{tmp_path}/table"), Positions(spark, f"{tmp_path}/positions")
    table.publish(source.limit(0))
    read = lambda position, intent: readers.watermark(source, Mapping(), "at", position, 1, intent=intent)
    job = passes.Job(("t", "m", "s"), read, lambda t, s: writers.upsert(t, s, ["id"]), table, positions)
    with pytest.raises(RuntimeError):
        passes.run_until_idle(job, 2)
    passes.run_until_idle(job)
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 3, 4, 5, 6]
