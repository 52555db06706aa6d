"""Projection: mapped columns, transforms, joined relationships, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ColumnMapping, Mapping, Relationship
from .expressions import quoted, transformed


def auto_map(source: list[str], target: list[str]) -> list[ColumnMapping]:
    """Columns of both sides, by exact name. Without target columns each maps to itself."""
    if not target:
        return [ColumnMapping(c) for c in source]
    return [ColumnMapping(c) for c in source if c in set(target)]


def used_relationships(mapping: Mapping, more: list[str] | None = None) -> list[Relationship]:
    """Those that a column (or more, by name) refers to; the others are not joined."""
    names = {c.relationship for c in mapping.columns if c.relationship} | set(more or [])
    unknown = names - {r.name for r in mapping.relationships}
    if unknown:
        raise ValueError(f"unknown relationships: {sorted(unknown)}")
    return [r for r in mapping.relationships if r.name in names]


def join_relationships(base: DataFrame, used: list[Relationship]) -> DataFrame:
    """base (alias base) left-joined to each relationship (alias its name). Which side is
    broadcast is left to the optimizer, which knows the sizes."""
    df = base.alias("base")
    for r in used:
        on = [F.col(f"base.{quoted(b)}") == F.col(f"{r.name}.{quoted(f)}") for b, f in r.keys]
        condition = on[0]
        for more in on[1:]:
            condition = condition & more
        df = df.join(r.table.alias(r.name), condition, "left")
    return df


def expression(column: ColumnMapping) -> Column:
    """The column's own expression over the joined source."""
    return transformed(f"{column.relationship or 'base'}.{quoted(column.source)}", column.transform)


def projection(mapping: Mapping) -> list[tuple[str, Column]]:
    """(target name, expression) of each mapped column; a target must not repeat."""
    seen: set[str] = set()
    for c in mapping.columns:
        if c.name.lower() in seen:
            raise ValueError(f"two columns map to {c.name}")
        seen.add(c.name.lower())
    return [(c.name, expression(c)) for c in mapping.columns]


def source_columns(mapping: Mapping) -> list[tuple[str | None, str]]:
    """(relationship, column) pairs that a read needs, each once without regard to case."""
    found, seen = [], set()
    for c in mapping.columns:
        key = (c.relationship, c.source.lower())
        if key not in seen:
            seen.add(key)
            found.append((c.relationship, c.source))
    return found


def project(joined: DataFrame, mapping: Mapping) -> DataFrame:
    """The mapped columns under their target names; without mapping, all of the base's."""
    if not mapping.columns:
        return joined.select("base.*")
    return joined.select(*[e.alias(name) for name, e in projection(mapping)])


def find(mapping: Mapping, column: str) -> ColumnMapping:
    """The mapping of a source column; an unmapped one stands for itself."""
    for c in mapping.columns:
        if c.source.lower() == column.lower() and c.relationship is None:
            return c
    return ColumnMapping(column)


def target_of(mapping: Mapping, column: str) -> str:
    """The target name of a source column, which must be mapped."""
    for c in mapping.columns:
        if c.source.lower() == column.lower() and c.relationship is None:
            return c.name
    if mapping.columns:
        raise ValueError(f"{column} isn't mapped")
    return column


def natural_key(mapping: Mapping, primary_key: list[str]) -> list[str]:
    """Target names of the source's primary key, in its order; none if a part isn't mapped."""
    try:
        return [target_of(mapping, k) for k in primary_key]
    except ValueError:
        return []


def split_keys(mapping: Mapping) -> tuple[list[str], list[str]]:
    """The target's keys and its other columns; every key must be mapped."""
    missing = [k for k in mapping.keys if k not in mapping.targets]
    if not mapping.keys or missing:
        raise ValueError(f"keys that aren't mapped: {missing}" if missing else "a key is needed")
    return list(mapping.keys), mapping.values
