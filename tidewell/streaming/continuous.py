"""Continuous operation with Structured Streaming: each micro-batch is applied by a writer.

The checkpoint keeps the source's offsets; the table's published version keeps the last batch
applied, so a batch that is delivered again after a crash is not applied twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.writers import one_per_key
from ..plans.buckets import KeyedTable
from ..plans.store import VersionedTable


def change_stream(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """A folder of change files as a stream, so many files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def apply_batches(table: VersionedTable, apply: Callable[[DataFrame, DataFrame], DataFrame], name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: the table's next version is the batch applied to it."""

    def each(batch: DataFrame, number: int) -> None:
        current = table.current()
        facts = dict(current.facts) if current else {}
        if facts.get(name, -1) >= number:
            return
        new = apply(table.read(), batch)
        table.publish(new, current.number if current else None, **(facts | {name: number}))

    return each


def upsert_batches(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each batch is upserted into the buckets of its keys, the last row of
    each key where changes carry their order. A batch that comes twice gives the same rows."""
    return lambda batch, _: table.upsert(one_per_key(batch, table.keys))


def start(changes: DataFrame, table: VersionedTable, apply: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, every: str | None = None, name: str = "stream") -> StreamingQuery:
    """Runs until stopped, a batch every so often; without a time, until what is there now
    is applied."""
    writer = changes.writeStream.foreachBatch(apply_batches(table, apply, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
