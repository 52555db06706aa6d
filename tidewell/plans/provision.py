"""Provisioning of targets: what table a mapping needs, and how an existing one changes.

A plan is made first and shows what it would do and what is lost; applying it writes a new
version. Nothing is changed unasked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import quoted
from ..functions.project import join_relationships, project, used_relationships
from ..model import IS_CURRENT, SNAPSHOT_AT, VALID_FROM, VALID_TO, VERSION_KEY, Mapping
from ..types import UnmappableType, to_canonical, to_spark


@dataclass(frozen=True)
class TablePlan:
    """The target's schema, its key in order, what is lost by column, and what can't be held."""

    schema: T.StructType
    keys: tuple[str, ...] = ()
    fidelity: dict[str, str] = field(default_factory=dict)
    unsupported: dict[str, str] = field(default_factory=dict)


def create_plan(source: DataFrame, mapping: Mapping, target_types: dict[str, str] | None = None, history: str | None = None) -> TablePlan:
    """The table for a mapping: columns by their target names, keys not null. target_types
    gives canonical types that differ from the source's. history adds the columns of a
    snapshot or scd2 table; there the version key is the key."""
    rows = project(join_relationships(source, used_relationships(mapping)), mapping)
    fields, fidelity, unsupported = [], {}, {}
    for f in rows.schema:
        try:
            rendered = to_spark((target_types or {}).get(f.name) or to_canonical(f.dataType))
        except UnmappableType as error:
            unsupported[f.name] = str(error)
            continue
        if rendered.fidelity:
            fidelity[f.name] = rendered.fidelity
        fields.append(T.StructField(f.name, rendered.type, history is not None or f.name not in mapping.keys))
    keys = mapping.keys
    moment = T.TimestampNTZType()
    if history == "snapshot":
        fields.append(T.StructField(SNAPSHOT_AT, moment, False))
        keys = ()
    elif history == "scd2":
        fields.insert(0, T.StructField(VERSION_KEY, T.StringType(), False))
        fields += [T.StructField(VALID_FROM, moment), T.StructField(VALID_TO, moment), T.StructField(IS_CURRENT, T.BooleanType())]
        keys = (VERSION_KEY,)
    elif history is not None:
        raise ValueError(f"unknown kind of history: {history}")
    return TablePlan(T.StructType(fields), tuple(keys), fidelity, unsupported)


def create(spark: SparkSession, plan: TablePlan) -> DataFrame:
    """The table without rows."""
    if plan.unsupported:
        raise UnmappableType(f"columns that can't be held: {plan.unsupported}")
    return spark.createDataFrame([], plan.schema)


@dataclass(frozen=True)
class AlterPlan:
    renames: dict[str, str]
    added: dict[str, T.DataType]
    changed: dict[str, T.DataType]

    @property
    def empty(self) -> bool:
        return not (self.renames or self.added or self.changed)


def alter_plan(target: DataFrame, wanted: T.StructType, renames: dict[str, str] | None = None) -> AlterPlan:
    """What makes a target fit: one pending rename for a column (old to new name), columns to
    add, which are null, and types to change. A rename onto a column that is there, or of a
    column that is renamed to in turn, is refused. No column is dropped."""
    renames = {a: b for a, b in (renames or {}).items() if a != b and a in target.columns}
    if set(renames.values()) & set(target.columns) or len(set(renames.values())) < len(renames):
        raise ValueError(f"renames collide: {renames}")
    now = {renames.get(f.name, f.name): f.dataType for f in target.schema}
    added = {f.name: f.dataType for f in wanted if f.name not in now}
    changed = {f.name: f.dataType for f in wanted if f.name in now and now[f.name] != f.dataType}
    return AlterPlan(renames, added, changed)


def alter(target: DataFrame, plan: AlterPlan) -> DataFrame:
    """The target's rows in the new shape, to be published as its next version."""
    columns = []
    for name in target.columns:
        new = plan.renames.get(name, name)
        column = F.col(quoted(name))
        columns.append((column.cast(plan.changed[new]) if new in plan.changed else column).alias(new))
    return target.select(*columns, *[F.lit(None).cast(kind).alias(name) for name, kind in plan.added.items()])
