"""Change logs: net and ordered changes, log windows, snapshots as logs, JSON log records.

A log has a sequence column, an operation column (I, U, D) and key columns.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import differs, ordering, quoted, same_keys
from ..model import CHANGED_AT, DELETE, INSERT, OPERATION, ORDERING, UPDATE, PositionExpired, Read
from .readers import with_ties

SEQUENCE = "__sequence"


def window(log: DataFrame, sequence: str, previous: Any, target: Any) -> DataFrame:
    """The log's rows in (previous, target]; None is open."""
    rows = log
    if previous is not None:
        rows = rows.filter(F.col(sequence) > F.lit(previous))
    return rows if target is None else rows.filter(F.col(sequence) <= F.lit(target))


def expired(position: Column, reaches: Any) -> Column:
    """check_retained() for each row: whether what follows a position is gone already."""
    return F.coalesce(position < F.lit(reaches), F.lit(False))


def check_retained(previous: Any, reaches: Any) -> None:
    """Refuses a position that the log no longer reaches back to. reaches: up to where the log
    was pruned, None if it wasn't. The first row there is can't tell, as positions have gaps."""
    if previous is not None and reaches is not None and previous < reaches:
        raise PositionExpired(f"the log reaches back to {reaches}, the position is {previous}")


def earliest(log: DataFrame, sequence: str) -> Any:
    """The position before the first row; None for an empty log."""
    first = log.agg(F.min(sequence)).first()[0]
    return None if first is None else first - 1


def latest(log: DataFrame, sequence: str) -> Any:
    return log.agg(F.max(sequence)).first()[0]


def prune(log: DataFrame, sequence: str, position: Any) -> DataFrame:
    """What a log keeps after everything up to a position is acknowledged."""
    return log.filter(F.col(sequence) > F.lit(position))


def last_of_key(log: DataFrame, keys: list[str], sequence: str, columns: list[str]) -> DataFrame:
    """The last row of each key. An aggregation, whose map side reduces a hot key to one row
    in each task before the shuffle, where a window would send all its rows to one."""
    last = F.max_by(F.struct(*[F.col(c) for c in columns]), F.col(sequence)).alias("last")
    grouped = log.groupBy(*keys).agg(F.max(sequence).alias(SEQUENCE), last)
    return grouped.select(*keys, SEQUENCE, *[F.col(f"last.{quoted(c)}").alias(c) for c in columns])


def net_changes(log: DataFrame, base: DataFrame, keys: list[str], sequence: str, operation: str, previous: Any = None, target: Any = None, reaches: Any = None) -> Read:
    """One change for each key, its last, with values from the base table. A delete has its
    key only; another change whose row is gone from the base is skipped (see vanished)."""
    check_retained(previous, reaches)
    last = last_of_key(window(log, sequence, previous, target), keys, sequence, [operation])
    values = [c for c in base.columns if c not in keys]
    met = last.alias("l").join(base.alias("b"), same_keys("l", "b", keys), "left")
    there = F.col(f"b.{quoted(keys[0])}").isNotNull()
    gone = F.col(operation) == DELETE
    rows = met.filter(gone | there).select(
        *[F.col(f"l.{quoted(k)}").alias(k) for k in keys],
        *[F.when(~gone, F.col(f"b.{quoted(c)}")).alias(c) for c in values],
        F.col(operation).alias(OPERATION),
        SEQUENCE,
    )
    return Read(rows, target)


def vanished(log: DataFrame, base: DataFrame, keys: list[str], sequence: str, operation: str, previous: Any = None, target: Any = None) -> DataFrame:
    """The keys that net_changes skips."""
    last = last_of_key(window(log, sequence, previous, target), keys, sequence, [operation])
    return last.filter(F.col(operation) != DELETE).join(base, keys, "left_anti").select(*keys)


def captured_net(log: DataFrame, keys: list[str], values: list[str], sequence: str, operation: str, previous: Any = None, target: Any = None, reaches: Any = None) -> Read:
    """One change for each key with the values that the log itself holds."""
    check_retained(previous, reaches)
    last = last_of_key(window(log, sequence, previous, target), keys, sequence, [operation, *values])
    rows = last.select(*keys, *values, F.col(operation).alias(OPERATION), SEQUENCE)
    return Read(rows, target)


def all_changes(log: DataFrame, columns: list[str], position: str, sequence: str, operation: Column, changed_at: str, previous: Any = None, most: int | None = None, target: Any = None, reaches: Any = None, ordered: bool = False) -> Read:
    """Every change, with an ordering text and the time of the change. A cap never
    splits a position (a transaction): rows that tie with the last one come too. The position
    after is the last one's if the cap was reached, else the target."""
    check_retained(previous, reaches)
    target = latest(log, position) if target is None else target
    rows = window(log, position, previous, target)
    reached = target
    if most is not None:
        rows, last = with_ties(rows, F.col(position), most)
        if last is not None and rows.limit(most).count() >= most:
            reached = last
    marked = rows.select(
        *columns,
        operation.alias(OPERATION),
        ordering(F.col(position), F.col(sequence)).alias(ORDERING),
        F.col(changed_at).alias(CHANGED_AT),
    )
    return Read(marked.orderBy(ORDERING) if ordered else marked, reached)


def versions(log: DataFrame, columns: list[str], sequence: str, operation: str, previous: Any, target: Any, reaches: Any = None, ordered: bool = False) -> Read:
    """Every version between two positions, without ordering columns."""
    check_retained(previous, reaches)
    rows = window(log, sequence, previous, target)
    rows = rows.orderBy(sequence) if ordered else rows
    return Read(rows.select(*columns, F.col(operation).alias(OPERATION)), target)


def snapshot_log(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """A change log from two states of a table: what a trigger would have written."""
    values = [c for c in after.columns if c not in keys]
    met = before.alias("a").join(after.alias("b"), same_keys("a", "b", keys), "full")
    old, new = F.col(f"a.{quoted(keys[0])}").isNotNull(), F.col(f"b.{quoted(keys[0])}").isNotNull()
    code = F.when(~old, INSERT).when(~new, DELETE).when(differs("a", "b", values), UPDATE)
    rows = met.select(
        *[F.coalesce(F.col(f"b.{quoted(k)}"), F.col(f"a.{quoted(k)}")).alias(k) for k in keys],
        *[F.col(f"b.{quoted(c)}").alias(c) for c in values],
        code.alias(OPERATION),
    )
    return rows.filter(F.col(OPERATION).isNotNull())


_RECORD = "action string, columns array<struct<name: string, value: string>>, identity array<struct<name: string, value: string>>"


def decoded(value: Column, kind: str) -> Column:
    """A value of a log's JSON, which is text, as its column's SQL type. Bytes are hex with or
    without a \\x or 0x before it. Text that is no value of the type is an error."""
    if kind != "binary":
        return value.cast(kind)
    digits = F.regexp_replace(value, r"^(\\x|0[xX])", "")
    bad = F.raise_error(F.concat(F.lit("no bytes in hex: "), value)).cast("binary")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits)).when(value.isNotNull(), bad)


def with_commit_time(changes: DataFrame, commits: DataFrame, position: str, at: str) -> DataFrame:
    """Changes with the time at which their position was committed, from a table of commits
    (position, at; one row each); null where it isn't known."""
    times = commits.select(F.col(quoted(position)), F.col(quoted(at)).alias(CHANGED_AT))
    return changes.join(times, position, "left")


def logical_records(log: DataFrame, text: str, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """JSON log records (action I, U or D, columns and identity as name and value) as change
    rows. columns gives each column's SQL type. The identity fills keys; what the record's
    columns hold takes precedence; other actions are left out."""
    record = F.from_json(F.col(text), _RECORD)
    pairs = lambda field: F.map_from_entries(F.coalesce(field, F.array().cast("array<struct<name: string, value: string>>")))
    rows = log.withColumn("r", record).filter(F.col("r.action").isin(INSERT, UPDATE, DELETE))
    rows = rows.withColumn("c", pairs(F.col("r.columns"))).withColumn("i", pairs(F.col("r.identity")))
    new = F.when(F.col("r.action") == DELETE, F.lit(None)).otherwise(F.lit(True))
    each = []
    for name, kind in columns.items():
        own = F.when(new.isNotNull(), F.element_at("c", name))
        has = new.isNotNull() & F.map_contains_key("c", F.lit(name))
        each.append(decoded(F.when(has, own).otherwise(F.element_at("i", name)), kind).alias(name))
    return rows.select(*keep, *each, F.col("r.action").alias(OPERATION))
