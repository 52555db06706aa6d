"""Segments of a table: predicates, and cutting a column's range into parts."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.project import expression, find, join_relationships, target_of, used_relationships
from ..model import Auto, Full, ListOf, Mapping, Range, Segment
from ..types import bucketable


def predicate(segment: Segment, column: Column, kind: str | None = None) -> Column | None:
    """The segment's condition on a column. Constants get the column's type, so that the
    column itself stays bare and the condition reaches the scan."""
    if isinstance(segment, Full):
        return None
    literal = lambda v: F.lit(v).cast(kind) if kind else F.lit(v)
    if isinstance(segment, ListOf):
        if not segment.values:
            raise ValueError("a list segment needs values")
        return column.isin(*[literal(v) for v in segment.values])
    if isinstance(segment, Range):
        return (column >= literal(segment.low)) & (column < literal(segment.high))
    raise ValueError("an auto segment must be expanded before it is read")


def source_scope(segment: Segment, mapping: Mapping, joined: DataFrame, base: DataFrame) -> Column | None:
    """The condition on the source: on the column's own transform, where it has one."""
    if isinstance(segment, Full):
        return None
    column = find(mapping, segment.column)
    if column.source not in base.columns:
        raise ValueError(f"the source has no column {segment.column}")
    e = expression(column)
    return predicate(segment, e, joined.select(e.alias("c")).schema["c"].dataType.simpleString())


def target_scope(segment: Segment, mapping: Mapping, target: DataFrame) -> Column | None:
    """The same condition on the target's column."""
    if isinstance(segment, Full):
        return None
    name = target_of(mapping, segment.column)
    if name not in target.columns:
        raise ValueError(f"the target has no column {name}")
    return predicate(segment, F.col(name), target.schema[name].dataType.simpleString())


def cut(low: Any, high: Any, buckets: int, kind: str) -> list[tuple[Any, Any]]:
    """Half-open ranges that hold low to high. integral: whole numbers; numeric: decimals;
    temporal: microseconds. The last one ends one (a day) after high."""
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    if kind == "integral":
        edges = [low + (high - low) * i // buckets for i in range(buckets)] + [high + 1]
    elif kind == "numeric":
        low, high = Decimal(str(low)), Decimal(str(high))
        edges = [low + (high - low) * i / buckets for i in range(buckets)] + [high + 1]
    elif kind == "temporal":
        if not isinstance(low, dt.datetime):
            low, high = (dt.datetime(x.year, x.month, x.day) for x in (low, high))
        micro = dt.timedelta(microseconds=1)
        span = (high - low) // micro
        edges = [low + micro * (span * i // buckets) for i in range(buckets)] + [high + dt.timedelta(days=1)]
    else:
        raise ValueError(f"unknown kind of range: {kind}")
    return [(a, b) for a, b in zip(edges, edges[1:]) if a != b]


def expand(segment: Segment, source: DataFrame, mapping: Mapping = Mapping()) -> list[Segment]:
    """An auto segment as ranges over what the source holds; the whole table if that is
    nothing. Others stay as they are. One aggregation, answered from Parquet statistics where
    the column is bare."""
    if not isinstance(segment, Auto):
        return [segment]
    joined = join_relationships(source, used_relationships(mapping))
    if mapping.filter:
        joined = joined.filter(mapping.filter)
    e = expression(find(mapping, segment.column))
    ranged = joined.agg(F.min(e).alias("low"), F.max(e).alias("high"))
    kind = bucketable(ranged.schema["low"].dataType)
    low, high = ranged.first()
    if low is None:
        return [Full()]
    return [Range(segment.column, a, b) for a, b in cut(low, high, segment.buckets, kind)]


def custom(spark: SparkSession, sql: str, column: str) -> list[Range]:
    """Ranges from a strategy's SQL, which gives label, range_start, range_end and selected;
    only selected ones run, and without that column none does. A null bound is an error."""
    found = spark.sql(sql)
    if "selected" not in found.columns:
        return []
    rows = found.filter(F.coalesce(F.col("selected"), F.lit(False))).orderBy("range_start").collect()
    if any(r["range_start"] is None or r["range_end"] is None for r in rows):
        raise ValueError("a segment's bounds must not be null")
    return [Range(column, r["range_start"], r["range_end"], r["label"]) for r in rows]


def labelled(segments: list[Segment]) -> dict[str, Segment]:
    """Segments by their description, which is what tells them apart."""
    return {s.describe(): s for s in segments}

