"""Versioned tables and stored positions: the only state of the engine.

A table is a folder of complete versions. Each attempt writes its rows to a folder of its own and
is published by a marker file that names it. A marker is written aside and renamed to a name that
must not exist yet, so readers see a version whole or not at all, and of two writers of the same
version one fails and leaves no trace in it. Nothing is overwritten in place; old versions serve
running readers. The rename must be atomic and refuse an existing name, as on HDFS; local file
systems check first and then rename; object stores without it need a single writer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.expressions import quoted
from ..model import Hold, Intent
from ..sources.readers import format_position, parse_position


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def create(self, name: str, text: str) -> None:
        """Makes a new file, whole or not at all; fails if it is there."""
        jvm, aside = self.spark.sparkContext._jvm, self._path(f"{self.path}/_aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        at = self._fs.makeQualified(self._path(f"{self.path}/{name}"))
        self._fs.mkdirs(at.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(aside), at, none)
        except Exception:
            self._fs.delete(aside, False)
            raise

    def read(self, name: str) -> str:
        at = self._path(f"{self.path}/{name}")
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def move(self, name: str, place: str) -> None:
        """Puts a folder in the place of another, which is deleted first."""
        self.delete(place)
        if not self._fs.rename(self._path(f"{self.path}/{name}"), self._path(f"{self.path}/{place}")):
            raise OSError(f"{self.path}/{name} can't be moved to {place}")


def key_path(key: tuple[str, ...]) -> str:
    """A key's parts as a path; different keys have different ones."""
    return "/".join(k.replace("%", "%25").replace("/", "%2F") for k in key)


def widened(old: StructType, new: StructType) -> StructType:
    """The columns of both, those of old first; one that has another type in new is an error."""
    known = {f.name: f for f in old}
    for f in new:
        if f.name in known and f.dataType != known[f.name].dataType:
            raise ValueError(f"column {f.name} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType) for f in [*old, *(f for f in new if f.name not in known)]])


@dataclass(frozen=True)
class Version:
    """facts: what a publisher tells with it. files: the folders that hold its rows, each
    partitioned by partition_by. schema: of all of them; what a folder lacks is null there."""

    number: int
    facts: dict[str, Any]
    files: tuple[str, ...] = ()
    schema: StructType | None = None
    partition_by: tuple[str, ...] = ()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def versions(self) -> list[int]:
        return [int(n) for n in self.folder.names("_published") if n.isdigit()]

    def current(self) -> Version | None:
        found = self.versions()
        return self.version(found[-1]) if found else None

    def version(self, number: int) -> Version:
        raw = json.loads(self.folder.read(f"_published/{number:012d}"))
        schema = StructType.fromJson(raw["schema"]) if "schema" in raw else None
        return Version(number, raw["facts"], tuple(raw["files"]), schema, tuple(raw.get("partition_by", ())))

    def read(self, number: int | None = None) -> DataFrame:
        """A version, pinned: what is published later doesn't change it."""
        version = self.current() if number is None else self.version(number)
        if version is None:
            raise FileNotFoundError(f"{self.folder.path} has no version")
        paths = [f"{self.folder.path}/{f}" for f in version.files]
        reader = self.spark.read if version.schema is None else self.spark.read.schema(version.schema)
        if not version.partition_by:
            return reader.parquet(*paths)
        # folders that are partitioned each have their own values: one scan for each
        every = reduce(DataFrame.unionByName, [reader.parquet(p) for p in paths])
        return every.select(*[quoted(c) for c in version.schema.names])

    def publish(self, state: DataFrame, expected: int | None = None, partition_by: tuple[str, ...] = (), **facts: Any) -> Version:
        """Writes a state as the next version and then makes it the current one. expected: the
        version that the state was made from; if another came meanwhile, this is an error."""
        return self._publish(state, (), expected, partition_by, state.schema, facts)

    def append(self, rows: DataFrame, expected: int | None = None, **facts: Any) -> Version:
        """A version that adds rows to the current one, whose files it keeps: what a snapshot
        appends, without rewriting the history. The rows are partitioned as those are. Columns
        that the table hasn't are null in its old rows, and the other way round; a column of another
        type is an error."""
        now = self.current()
        if now is None:
            return self._publish(rows, (), expected, (), rows.schema, facts)
        schema = widened(now.schema or self.read(now.number).schema, rows.schema)
        missing = [c for c in now.partition_by if c not in rows.columns]
        return self._publish(rows.withColumns({c: F.lit(None).cast(schema[c].dataType) for c in missing}), now.files, expected, now.partition_by, schema, facts)

    def _publish(self, rows: DataFrame, kept: tuple[str, ...], expected: int | None, partition_by: tuple[str, ...], schema: StructType, facts: dict[str, Any]) -> Version:
        now = self.current()
        last = now.number if now else 0
        if expected is not None and expected != last:
            raise RuntimeError(f"{self.folder.path} is at version {last}, not {expected}")
        if kept and kept != (now.files if now else ()):
            raise RuntimeError(f"{self.folder.path} moved on while rows were appended")
        number, name = last + 1, f"data-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.folder.path}/{name}")
        files = (*kept, name)
        try:
            self.folder.create(f"_published/{number:012d}", json.dumps({"facts": facts, "files": files, "schema": schema.jsonValue(), "partition_by": partition_by}))
        except Exception as error:
            self.folder.delete(name)
            raise RuntimeError(f"{self.folder.path} got a version {number} meanwhile") from error
        return Version(number, facts, files, schema, partition_by)

    def retire(self, keep: int = 2) -> list[int]:
        """Deletes all but the last versions, and files that no other has; returns those deleted."""
        every = self.versions()
        old = every[:-keep] if keep else every
        used = {f for n in every if n not in old for f in self.version(n).files}
        for n in old:
            files = self.version(n).files
            self.folder.delete(f"_published/{n:012d}")
            for f in set(files) - used:
                self.folder.delete(f)
        return old


@dataclass(frozen=True)
class ReadState:
    """What the next pass of a mapping starts from."""

    intent: Intent = Intent.INITIAL_LOAD
    hold: Hold = Hold.NONE
    position: Any = None
    pending: Any = None
    pass_id: int = 0


class Positions:
    """Read states by (task, mapping, source). Each is a chain of small files, the last of
    which counts; a new one is created whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def get(self, key: tuple[str, ...]) -> ReadState:
        found = self.folder.names(key_path(key))
        if not found:
            return ReadState()
        raw = json.loads(self.folder.read(f"{key_path(key)}/{found[-1]}"))
        return ReadState(
            Intent(raw["intent"]), Hold(raw["hold"]), parse_position(raw["position"]), parse_position(raw["pending"]), raw["pass_id"]
        )

    def put(self, key: tuple[str, ...], state: ReadState) -> None:
        found = self.folder.names(key_path(key))
        number = int(found[-1]) + 1 if found else 1
        raw = asdict(state) | {
            "intent": state.intent.value, "hold": state.hold.value,
            "position": format_position(state.position), "pending": format_position(state.pending),
        }
        self.folder.create(f"{key_path(key)}/{number:012d}", json.dumps(raw))
        for old in found[:-1]:
            self.folder.delete(f"{key_path(key)}/{old}")
