"""Readers: full and segmented reloads, incremental reads from a position, keys only, queries.

Each gives a lazy DataFrame of the mapped columns and the position after it. The only actions
are those that find a position.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.project import expression, find, join_relationships, natural_key, project, source_columns, used_relationships
from ..model import DELETE, INSERT, OPERATION, ColumnMapping, Full, Intent, Mapping, Read, Segment
from ..plans.segments import source_scope

#: The segment that a row of a segmented reload belongs to.
SEGMENT = "__segment"


def joined_source(source: DataFrame, mapping: Mapping, more: list[str] | None = None) -> DataFrame:
    joined = join_relationships(source, used_relationships(mapping, more))
    return joined.filter(mapping.filter) if mapping.filter else joined


def reload(source: DataFrame, mapping: Mapping = Mapping(), segment: Segment = Full(), position: Any = None) -> Read:
    """All rows of a segment, as inserts; the position stays what it was."""
    joined = joined_source(source, mapping)
    scope = source_scope(segment, mapping, joined, source)
    rows = project(joined if scope is None else joined.filter(scope), mapping)
    return Read(rows.withColumn(OPERATION, F.lit(INSERT)), position)


def reload_segments(source: DataFrame, mapping: Mapping, parts: list[Segment], position: Any = None) -> Read:
    """The rows of several segments in one scan, each with the description of its segment (the first
    that holds it) in SEGMENT. What is in none of them isn't read: their union reaches the scan."""
    joined = joined_source(source, mapping)
    scopes = [F.lit(True) if s is None else s for s in (source_scope(p, mapping, joined, source) for p in parts)]
    if not scopes:
        return Read(project(joined.limit(0), mapping).withColumns({OPERATION: F.lit(INSERT), SEGMENT: F.lit("")}), position)
    label = F.lit(None).cast("string")
    for scope, part in reversed(list(zip(scopes, parts))):
        label = F.when(scope, part.describe()).otherwise(label)
    rows = joined.filter(reduce(lambda a, b: a | b, scopes)).withColumn(SEGMENT, label)
    columns = mapping.columns or tuple(ColumnMapping(c) for c in source.columns)
    kept = Mapping((*columns, ColumnMapping(source.columns[0], SEGMENT, f"`{SEGMENT}`")), mapping.keys, mapping.relationships)
    return Read(project(rows, kept).withColumn(OPERATION, F.lit(INSERT)), position)


def query(spark: SparkSession, sql: str, mapping: Mapping = Mapping(), segment: Segment = Full(), wrap: bool = True) -> Read:
    """A user's SQL as the source. It runs as it is where nothing has to be wrapped round it
    (and then no projection or filter applies); else it is the base of a reload."""
    source = spark.sql(sql)
    if not wrap:
        if not isinstance(segment, Full) or mapping.relationships:
            raise ValueError("a query that must not be wrapped has no segments or relationships")
        return Read(source.withColumn(OPERATION, F.lit(INSERT)))
    return reload(source, mapping, segment)


def keys_only(source: DataFrame, mapping: Mapping, primary_key: list[str], segment: Segment = Full()) -> Read:
    """The mapped primary key of each row in scope, and no other column."""
    if not primary_key:
        raise ValueError("the source has no primary key")
    names = natural_key(mapping, primary_key) if mapping.columns else list(primary_key)
    if not names:
        raise ValueError("the primary key isn't mapped")
    joined = joined_source(source, mapping)
    scope = source_scope(segment, mapping, joined, source)
    scoped = joined if scope is None else joined.filter(scope)
    columns = [expression(find(mapping, k)).alias(n) for k, n in zip(primary_key, names)]
    return Read(scoped.select(*columns).withColumn(OPERATION, F.lit(INSERT)))


def position_column(mapping: Mapping, column: str, relationship: str | None = None) -> Column:
    """The expression of the position column: its own transform applies."""
    if relationship:
        return expression(ColumnMapping(column, relationship=relationship))
    return expression(find(mapping, column))


def capture(source: DataFrame, mapping: Mapping, column: str, relationship: str | None = None) -> Any:
    """The position a pass would reach now, without reading rows."""
    joined = joined_source(source, mapping, [relationship] if relationship else None)
    return joined.agg(F.max(position_column(mapping, column, relationship))).first()[0]


def with_ties(rows: DataFrame, position: Column, most: int, nulls: bool = False) -> tuple[DataFrame, Any]:
    """The first rows by position, at most as many but for ties on the last one; and that
    position. The last one is found by a top-n without sorting the rest, and then filters.
    nulls: rows without a position come with them, beyond the cap; else they don't come."""
    firsts = rows.select(position.alias("p")).filter("p IS NOT NULL").orderBy("p").limit(most)
    last = firsts.agg(F.max("p")).first()[0]
    if last is None:
        return (rows if nulls else rows.limit(0)), last
    first = position <= F.lit(last)
    return rows.filter(first | position.isNull() if nulls else first), last


def watermark(
    source: DataFrame,
    mapping: Mapping,
    column: str,
    previous: Any = None,
    most: int | None = None,
    relationship: str | None = None,
    intent: Intent = Intent.CHANGES,
    ordered: bool = False,
) -> Read:
    """Rows whose position is beyond the previous one; ordered, for a sink that needs the order.

    Unbounded, the new position is the largest before the read, so that a row which arrives
    meanwhile may be read twice and never lost. Bounded, it is that of the last row read, and
    rows that tie with it are read too. A first read, without a previous position, has the
    rows whose position is null, too, bounded or not; later ones don't. The column may belong
    to a relationship: then a change there emits all base rows that refer to it."""
    joined = joined_source(source, mapping, [relationship] if relationship else None)
    at = position_column(mapping, column, relationship)
    if intent is Intent.FROM_LATEST:
        return Read(project(joined.limit(0), mapping).withColumn(OPERATION, F.lit(INSERT)), capture(source, mapping, column, relationship))
    kind = joined.select(at.alias("p")).schema["p"].dataType
    if intent is not Intent.CHANGES:
        previous = None
    rows = joined if previous is None else joined.filter(at > F.lit(previous).cast(kind))
    if most is None:
        reached = joined.agg(F.max(at)).first()[0]
        reached = previous if reached is None else reached
    else:
        rows, reached = with_ties(rows, at, most, nulls=previous is None)
        reached = previous if reached is None else reached
    rows = rows.orderBy(at) if ordered else rows
    return Read(project(rows, mapping).withColumn(OPERATION, F.lit(INSERT)), reached)


def scripted(build: Callable[[Any], DataFrame], position: Any = None, operation: str | None = None, codes: dict[Any, str] | None = None, default: str = INSERT, without: tuple[str, ...] = ()) -> Read:
    """A callable's rows. operation names the column of its operations, codes what its values
    mean; a value without meaning is default."""
    rows = build(position)
    if operation:
        value = F.col(operation)
        if codes:
            value = F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), value)
        rows = rows.withColumn(OPERATION, F.coalesce(value, F.lit(default)))
        without = (*without, operation) if operation != OPERATION else without
    else:
        rows = rows.withColumn(OPERATION, F.lit(default))
    return Read(rows.drop(*without), position)


def needed_columns(mapping: Mapping) -> list[str]:
    """What a scan of the base reads for this mapping, relationships' keys included."""
    own = [c for r, c in source_columns(mapping) if r is None]
    keys = [b for r in used_relationships(mapping) for b, _ in r.keys]
    return list(dict.fromkeys(own + keys))


def preview(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first rows, and whether there are more; most 0 gives the schema only."""
    if most == 0:
        return rows.limit(0), False
    return rows.limit(most), len(rows.limit(most + 1).take(most + 1)) > most


def format_position(value: Any) -> str:
    """A position as JSON with its type, to be stored as text."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, float, str)):
        return json.dumps({"type": type(value).__name__, "value": value})
    if isinstance(value, dt.datetime):
        return json.dumps({"type": "datetime", "value": value.isoformat()})
    if isinstance(value, dt.date):
        return json.dumps({"type": "date", "value": value.isoformat()})
    if isinstance(value, Decimal):
        return json.dumps({"type": "decimal", "value": str(value)})
    if isinstance(value, (bytes, bytearray)):
        return json.dumps({"type": "bytes", "value": bytes(value).hex()})
    raise TypeError(f"no position: {value!r}")


def parse_position(text: str) -> Any:
    found = json.loads(text)
    kind, value = found["type"], found["value"]
    if kind == "datetime":
        return dt.datetime.fromisoformat(value)
    if kind == "date":
        return dt.date.fromisoformat(value)
    if kind == "decimal":
        return Decimal(value)
    return bytes.fromhex(value) if kind == "bytes" else value


def unchanged(stored: Any, counter: Any) -> bool:
    """True where a source's change counter shows that a pass would find nothing. What isn't
    known counts as changed."""
    return stored is not None and counter is not None and stored >= counter


def is_unchanged(stored: Column, counter: Column) -> Column:
    """unchanged() for each row."""
    return F.coalesce(stored >= counter, F.lit(False))


def deleted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(OPERATION) == DELETE)


def to_dispatch(due: DataFrame, counters: DataFrame, database: tuple[str, ...] = ("connection", "database", "kind")) -> DataFrame:
    """The due mappings whose database has changed: one counter for each database decides for
    all of its mappings (column stored). As in unchanged(), what isn't known is dispatched."""
    skipped = is_unchanged(F.col("stored"), F.col("counter"))
    return due.join(counters.select(*database, "counter"), list(database), "left").filter(~skipped).select(*due.columns)
