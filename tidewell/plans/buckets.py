"""Tables in buckets of their key: a pass rewrites the buckets that its keys hash to, and no other.

The rows are Parquet, partitioned by the hash of the key into a fixed number of buckets, and a writer
sees and replaces only what it may change: Spark prunes the read to the buckets of the
staged keys, and only their folders are replaced. What a pass costs
follows from its changes, not from the table.

New rows are written aside first, in a folder for each bucket, and a file tells that they are whole. Then
each folder is moved to its place: the old one is deleted and the new one renamed, one after the other, as Spark
overwrites partitions. A pass that is interrupted after the rows are whole is carried out
from there before anything else is done to the table; one that is interrupted earlier has changed
nothing. Readers that run meanwhile may see some buckets before and some after: what needs
pinned states is a VersionedTable.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.expressions import quoted
from ..operators import writers
from ..operators.writers import MARKS, Guard, in_scope
from .store import Folder

BUCKET, ABOUT = "__bucket", "_table.json"
PENDING, READY = "_pending", "_ready.json"

Writer = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        """A table that was created; a pass that was interrupted is finished."""
        self.spark, self.folder = spark, Folder(spark, path)
        about = json.loads(self.folder.read(ABOUT))
        self.keys: list[str] = about["keys"]
        self.buckets: int = about["buckets"]
        self.schema = StructType.fromJson(about["schema"])
        self._full = StructType([*self.schema, StructField(BUCKET, IntegerType())])
        self.recover()

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int) -> KeyedTable:
        """An empty table. A bucket is rewritten whole by one task, so there should be as many as
        keep a bucket below about a gigabyte at the size that the table will reach."""
        if not keys or buckets < 1 or BUCKET in schema.names or set(keys) - set(schema.names):
            raise ValueError("a table in buckets needs a key among its columns and at least one bucket")
        schema = StructType([StructField(f.name, f.dataType) for f in schema])
        about = {"keys": list(keys), "buckets": buckets, "schema": schema.jsonValue()}
        Folder(spark, path).create(ABOUT, json.dumps(about))
        return cls(spark, path)

    def current(self) -> None:
        """There are no versions; passes are told apart by their keys alone."""
        return None

    def bucket(self) -> Column:
        """The bucket of a row; the key must have the table's types."""
        return F.pmod(F.xxhash64(*[F.col(quoted(k)) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def conformed(self, rows: DataFrame) -> DataFrame:
        """rows with the table's types, as far as they have its columns: a key hashes by its type."""
        own = {f.name: f.dataType for f in self.schema}
        return rows.select(*[F.col(quoted(c)).cast(own[c]).alias(c) if c in own else F.col(quoted(c)) for c in rows.columns])

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self._full).parquet(self.folder.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; others aren't listed, let alone read."""
        stored = self._stored()
        stored = stored if buckets is None else stored.filter(F.col(BUCKET).isin(*buckets) if buckets else F.lit(False))
        return stored.select(*[quoted(c) for c in self.schema.names])

    def filled(self, folder: str = "") -> list[int]:
        """The buckets that have rows, as their folders tell: the table's, or those of a folder in it."""
        start = f"{BUCKET}="
        return sorted(int(n.removeprefix(start)) for n in self.folder.names(folder) if n.startswith(start))

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that these keys hash to: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def buckets_in(self, scope: Column | None) -> list[int]:
        """The buckets with rows in a scope: a scan of the scope's columns."""
        found = self._stored().filter(in_scope(scope)).select(BUCKET).distinct()
        return sorted(r[0] for r in found.collect())

    def apply(self, staged: DataFrame, writer: Writer, more: list[int] = ()) -> list[int]:
        """Replaces the buckets of the staged keys, and more, by what a writer makes of them; gives
        their numbers, of a first load those that have rows now. The writer must leave other keys' rows
        alone, and give the same state again when the pass is repeated. The staged rows are read for
        their buckets only where that spares reading the table's."""
        staged = self.conformed(staged)
        if not self.filled():
            self._replace(list(range(self.buckets)), writer(self.read([]), staged))
            return self.filled()
        every = len({*more}) == self.buckets
        touched = sorted({*more} if every else {*self.buckets_of(staged), *more})
        return self._replace(touched, writer(self.read(touched), staged))

    def upsert(self, staged: DataFrame) -> list[int]:
        return self.apply(staged, lambda t, s: writers.upsert(t, s, self.keys))

    def merge_reconcile(self, staged: DataFrame, scope: Column | None = None) -> list[int]:
        return self.apply(staged, lambda t, s: writers.merge_reconcile(t, s, self.keys, scope), self.buckets_in(scope))

    def delete_insert(self, staged: DataFrame, scope: Column | None = None) -> list[int]:
        return self.apply(staged, lambda t, s: writers.delete_insert(t, s, scope), self.buckets_in(scope))

    def reconcile_deletes(self, staged_keys: DataFrame, scope: Column | None = None, guard: Guard = Guard("none")) -> list[int]:
        """Deletes the rows in scope whose key isn't staged, unless the guard refuses. Keys are
        compared over the whole table; only the buckets of missing ones are rewritten."""
        keys = self.conformed(staged_keys.select(*self.keys))
        if guard.kind != "none":
            counts = writers.guard_counts(self.read(), keys, self.keys, scope).first()
            guard.check(counts["deleted_rows"], counts["scope_rows"])
        touched = self.buckets_of(writers.missing_keys(self.read(), keys, self.keys, scope))
        here = keys.filter(self.bucket().isin(*touched)) if touched else keys.limit(0)
        return self._replace(touched, writers.reconcile_deletes(self.read(touched), here, self.keys, scope))

    def _replace(self, touched: list[int], rows: DataFrame) -> list[int]:
        if touched:
            rows = self.conformed(rows.select(*[quoted(c) for c in self.schema.names])).drop(*MARKS).withColumn(BUCKET, self.bucket())
            writer = rows.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).mode("overwrite")
            writer.option("partitionOverwriteMode", "static").parquet(f"{self.folder.path}/{PENDING}/rows")
            self.folder.create(f"{PENDING}/{READY}", json.dumps({"touched": touched, "filled": self.filled(f"{PENDING}/rows")}))
            self.recover()
        return touched

    def recover(self) -> None:
        """Carries out what an interrupted pass has written aside whole, or clears it away."""
        if READY in self.folder.names(PENDING):
            ready = json.loads(self.folder.read(f"{PENDING}/{READY}"))
            for b in self.filled(f"{PENDING}/rows"):  # those that aren't here any more are in their places
                self.folder.move(f"{PENDING}/rows/{BUCKET}={b}", f"{BUCKET}={b}")
            for b in {*ready["touched"]} & {*self.filled()} - {*ready["filled"]}:
                self.folder.delete(f"{BUCKET}={b}")
        self.folder.delete(PENDING)
