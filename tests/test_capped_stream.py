"""Streams in exact batches of rows, and streams that end when nothing comes any more."""

import datetime as dt

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.streaming import capped

IDLE = 1.0


def write(path, name, positions, group=7, kind=pa.int64()):
    path.mkdir(exist_ok=True)
    table = pa.table({"at": pa.array(positions, kind), "v": pa.array([f"{name}-{i}" for i in range(len(positions))])})
    pq.write_table(table, path / f"{name}.parquet", row_group_size=group)


def expected(positions, most):
    """Batches of the sorted positions."""
    left, out = sorted(p for p in positions if p is not None), []
    while left:
        last = left[min(most, len(left)) - 1]
        out.append([p for p in left if p <= last])
        left = [p for p in left if p > last]
    return out


POSITIONS = [i // 3 for i in range(50)] + [5] * 9 + [100, 40, 41, 41, 2]


@pytest.mark.parametrize("most", [1, 4, 10, 1000])
@pytest.mark.parametrize("group", [1, 8, 1000])
def test_slices_of_row_groups(tmp_path, most, group):
    write(tmp_path / "t", "a", POSITIONS[:30], group)
    write(tmp_path / "t", "b", POSITIONS[30:] + [None, None], group)
    data, after, found = ds.dataset(tmp_path / "t", format="parquet"), None, []
    while True:
        upto, n = capped.next_slice(data, "at", after, most)
        if not n:
            break
        found.append((upto, n))
        after = upto
    assert found == [(b[-1], len(b)) for b in expected(POSITIONS, most)]


def test_a_slice_reads_its_own_row_groups(tmp_path, monkeypatch):
    write(tmp_path / "t", "a", list(range(1000)), 10)
    data, read = ds.dataset(tmp_path / "t", format="parquet"), []
    every = capped.row_groups(data, "at", 499)
    assert len(every) == 50

    class Group:
        def __init__(self, least, group):
            self.least, self.group = least, group

        def to_table(self, columns):
            read.append(self.least)
            return self.group.to_table(columns=columns)

    monkeypatch.setattr(capped, "row_groups", lambda *_: [(least, Group(least, g)) for least, g in every])
    assert capped.next_slice(data, "at", 499, 25) == (524, 25) and read == [500, 510, 520]


def collect(spark, path, most, place, found, fail_at=None):
    def apply(rows, number):
        if number == fail_at:
            raise RuntimeError("this batch fails")
        found.setdefault(number, []).append(sorted((r["at"] for r in rows.collect()), key=lambda x: (x is not None, x)))

    return capped.run_until_idle(spark, capped.writer(spark, str(path), "at", most, apply, f"{place}/checkpoint"), IDLE)


def test_batches_have_the_cap(spark, tmp_path):
    write(tmp_path / "t", "a", POSITIONS + [None])
    found = {}
    assert collect(spark, tmp_path / "t", 10, tmp_path, found) == len(found)
    want = expected(POSITIONS, 10)
    assert [found[i] for i in sorted(found)] == [[[None] + want[0]]] + [[b] for b in want[1:]]


def test_a_restart_repeats_nothing(spark, tmp_path):
    """A batch that failed is repeated with the same rows, those before are not; later files are seen."""
    write(tmp_path / "t", "a", POSITIONS)
    found, want = {}, expected(POSITIONS, 8)
    with pytest.raises(Exception, match="this batch fails"):
        collect(spark, tmp_path / "t", 8, tmp_path, found, fail_at=3)
    assert sorted(found) == [0, 1, 2]
    collect(spark, tmp_path / "t", 8, tmp_path, found)
    assert [found[i] for i in sorted(found)] == [[b] for b in want]
    assert collect(spark, tmp_path / "t", 8, tmp_path, found) == 0
    write(tmp_path / "t", "b", [7, 200, 201])  # 7 comes too late, as for any reader of positions
    assert collect(spark, tmp_path / "t", 8, tmp_path, found) == 1
    assert found[len(want)] == [[200, 201]]


def test_kinds_of_positions(spark, tmp_path):
    times = [dt.datetime(2024, 1, 1, 0, 0, 0, i // 2) for i in range(9)]
    write(tmp_path / "times", "a", times, 2, pa.timestamp("us"))
    write(tmp_path / "texts", "a", ["b", "a", "c", "c", "d"], 2, pa.string())
    for name, positions in (("times", times), ("texts", ["b", "a", "c", "c", "d"])):
        found = {}
        collect(spark, tmp_path / name, 3, tmp_path / f"of-{name}", found)
        assert [found[i][0] for i in sorted(found)] == expected(positions, 3)


def test_the_filter_reaches_the_scan(spark, tmp_path):
    write(tmp_path / "t", "a", POSITIONS)
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = rows.filter(capped.inside("at", 3, 9, "bigint"))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(at,9)" in plan and "GreaterThan(at,3)" in plan
    with pytest.raises(ValueError):
        capped.slices(spark, str(tmp_path / "t"), "at", 0)


def test_an_empty_table_and_a_stream_of_files(spark, tmp_path):
    write(tmp_path / "t", "a", [])
    found = {}
    assert collect(spark, tmp_path / "t", 3, tmp_path, found) == 0 and not found
    write(tmp_path / "f", "f0", [0, 0])
    stream = spark.readStream.schema("at long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    for i in range(3):
        write(tmp_path / "f", f"f{i}", [i, i])
    out = str(tmp_path / "out")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c2"))
    assert capped.run_until_idle(spark, writer, IDLE, "1 second") == 3
    assert spark.read.parquet(out).agg(F.count("*"), F.sum("at")).first() == (6, 6)
