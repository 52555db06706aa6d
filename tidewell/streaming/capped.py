"""Streams with an exact cap on rows: a table is cut into slices of its position column.

A Python data source plans the slices: each batch is one row that says from which position (exclusive)
to which (inclusive) it goes, the first that hold the cap's number of rows; rows that tie with the last
one belong to it. The rows themselves never pass through the driver: foreachBatch reads them
with Spark, by a filter that reaches the scan. Spark keeps the slices in the checkpoint, so
that a batch that is repeated has the same rows, and a restart goes on where the last one ended.

To find where a slice ends, the source looks at row groups in the order of their least position, by
Parquet's statistics, and stops when no later one can hold a row of the slice: a log that is
about in order costs the slice's own row groups.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..sources.readers import format_position, parse_position

FORMAT = "position_slices"
NOTHING = format_position(None)


def plain(values: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Positions as one array; times to the microsecond, as Spark reads them."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    kind = values.type
    return values.cast(pa.timestamp("us"), safe=False) if pa.types.is_timestamp(kind) else values


def row_groups(data: ds.Dataset, column: str, after: Any) -> list[tuple[Any, ds.Fragment]]:
    """(least position, row group) of those that may hold later positions, in order; one without
    statistics comes first."""
    unknown, known = [], []
    for fragment in data.get_fragments():
        for group in fragment.split_by_row_group():
            found = group.row_groups[0].statistics
            limits = found.get(column) if found else None
            if limits is None or limits["min"] is None:
                unknown.append((None, group))
            elif after is None or limits["max"] > after:
                known.append((limits["min"], group))
    return unknown + sorted(known, key=lambda x: x[0])


def next_slice(data: ds.Dataset, column: str, after: Any, most: int) -> tuple[Any, int]:
    """Where the slice after a position ends, and its rows; (None, 0) where nothing follows."""
    held = None
    for least, group in row_groups(data, column, after):
        full = held is not None and len(held) >= most
        if full and least is not None and least > held[-1].as_py():
            break
        values = plain(group.to_table(columns=[column])[column]).drop_null()
        if after is not None:
            values = values.filter(pc.greater(values, pa.scalar(after, values.type)))
        held = values if held is None else pa.concat_arrays([held, values])
        held = held.take(pc.array_sort_indices(held))
        if len(held) > most:  # ties with the last one stay
            held = held.filter(pc.less_equal(held, held[most - 1]))
    if held is None or not len(held):
        return None, 0
    return held[-1].as_py(), len(held)


class SliceReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.column, self.most = options["path"], options["column"], int(options["most"])

    def initialOffset(self) -> dict:
        return {"after": NOTHING}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        data = ds.dataset(self.path.removeprefix("file://"), format="parquet")
        upto, rows = next_slice(data, self.column, parse_position(start["after"]), self.most)
        if not rows:
            return iter([]), start
        end = {"after": format_position(upto)}
        return iter([(start["after"], end["after"])]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["after"], end["after"])] if start != end else [])  # a first batch may be empty


class SliceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "after string, upto string"

    def simpleStreamReader(self, schema) -> SliceReader:
        return SliceReader(self.options)


def slices(spark: SparkSession, path: str, column: str, most: int) -> DataFrame:
    """The slices of a Parquet table as a stream, one to a batch."""
    if most < 1:
        raise ValueError("a batch holds at least one row")
    spark.dataSource.register(SliceSource)
    return spark.readStream.format(FORMAT).option("path", path).option("column", column).option("most", str(most)).load()


def inside(column: str, after: Any, upto: Any, kind: str) -> Column:
    """The condition of a slice; the first one also has the rows without a position."""
    at = F.col(column)
    test = at <= F.lit(upto).cast(kind)
    return test | at.isNull() if after is None else test & (at > F.lit(after).cast(kind))


def apply_slices(source: DataFrame | Callable[[], DataFrame], column: str, apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: apply gets the rows of the batch's slice and its number. A
    callable source is opened anew for each batch, to see files that came since."""

    def each(batch: DataFrame, number: int) -> None:
        for row in batch.collect():  # one, of two positions
            table = source() if callable(source) else source
            kind = table.schema[column].dataType.simpleString()
            apply(table.filter(inside(column, parse_position(row["after"]), parse_position(row["upto"]), kind)), number)

    return each


def writer(spark: SparkSession, path: str, column: str, most: int, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A stream of the Parquet table at path in batches of most rows by position, and ties."""
    source = lambda: spark.read.parquet(path)
    return slices(spark, path, column, most).writeStream.foreachBatch(apply_slices(source, column, apply)).option("checkpointLocation", checkpoint)


class IdleListener(StreamingQueryListener):
    """Tells when a query has had no rows for some seconds, or has ended."""

    def __init__(self, seconds: float):
        self.seconds, self.since, self.query = seconds, time.monotonic(), None
        self.batches, self.over = 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.since = time.monotonic()

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.query:
            if event.progress.numInputRows > 0:
                self.since, self.batches = time.monotonic(), self.batches + 1
            else:
                self._look()

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self.query:
            self._look()

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query:
            self.over.set()

    def _look(self) -> None:
        if time.monotonic() - self.since >= self.seconds:
            self.over.set()


def run_until_idle(spark: SparkSession, stream: DataStreamWriter, idle_after: float, every: str = "0 seconds") -> int:
    """Runs a stream on Spark's own trigger, a batch every so often, until none has had rows for idle_after
    seconds; then it is stopped. Gives the batches that had rows. What fails in it is raised here."""
    key = "spark.sql.streaming.noDataProgressEventInterval"
    before, listener = spark.conf.get(key), IdleListener(idle_after)
    spark.streams.addListener(listener)
    try:
        spark.conf.set(key, str(max(int(idle_after * 500), 50)))
        query: StreamingQuery = stream.trigger(processingTime=every).start()
        spark.conf.set(key, before)
        listener.query = str(query.id)
        while not listener.over.wait(0.2) and query.isActive:
            pass
        failed = query.exception()
        query.stop()
        if failed is not None:
            raise failed
        return listener.batches
    finally:
        spark.conf.set(key, before)
        spark.streams.removeListener(listener)
