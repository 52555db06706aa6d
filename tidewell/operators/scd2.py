"""Slowly changing dimensions, type 2: versions that open and close.

A version has version_key, valid_from, valid_to and is_current beside its key and values. Both
what closes and what opens follow from the target before the pass, so a pass that is replayed
on it gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import differs, quoted, same_keys
from ..model import CHANGED_AT, DELETE, IS_CURRENT, OPERATION, ORDERING, VALID_FROM, VALID_TO, VERSION_KEY
from .ranges import hot_keys, segmented
from .writers import Guard, has_ordering, in_scope, unique


def key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in keys])


def version_prefix(now: Any) -> str:
    """The time of a pass, to milliseconds, as the start of its version keys."""
    return now.strftime("%Y%m%d%H%M%S") + f"{now.microsecond // 1000:03d}"


def _moment(staged: DataFrame, now: Any, alias: str = "s") -> Column:
    """When a change took effect: its own time where changes carry it, else the pass's."""
    fixed = F.lit(now).cast("timestamp_ntz")
    return F.coalesce(F.col(f"{alias}.{CHANGED_AT}").cast("timestamp_ntz"), fixed) if has_ordering(staged) else fixed


def close_and_open(target: DataFrame, staged: DataFrame, keys: list[str], values: list[str], now: Any) -> DataFrame:
    """With one staged row for each key (two are an error): open versions close where the row is
    a delete or any value differs, and a version opens for a live row whose key then has no open
    one. What is unchanged writes nothing."""
    staged = unique(staged, keys)
    met = target.alias("t").join(staged.alias("s"), same_keys("t", "s", keys), "left")
    hit = F.col(f"s.{OPERATION}").isNotNull() & F.col(f"t.{IS_CURRENT}")
    closing = hit & ((F.col(f"s.{OPERATION}") == DELETE) | differs("t", "s", values))
    moment = _moment(staged, now)
    changed = {VALID_TO: F.when(closing, moment).otherwise(F.col(f"t.{VALID_TO}")), IS_CURRENT: F.col(f"t.{IS_CURRENT}") & ~closing}
    old = met.select(*[changed.get(c, F.col(f"t.{quoted(c)}")).alias(c) for c in target.columns])
    live = staged.filter(F.col(OPERATION) != DELETE).alias("s")
    current = target.filter(IS_CURRENT).alias("t")
    # open already and equal: nothing to write (values of an open version differ, or it closes)
    same = same_keys("s", "t", keys) & ~differs("s", "t", values)
    fresh = live.join(current, same, "left_anti")
    prefix = F.concat(F.lit(version_prefix(now) + "-"), key_text(keys))
    moment = _moment(staged, now)
    new = fresh.select(
        *[F.col(f"s.{quoted(c)}").alias(c) for c in [*keys, *values]],
        prefix.alias(VERSION_KEY),
        moment.alias(VALID_FROM),
        F.lit(None).cast("timestamp_ntz").alias(VALID_TO),
        F.lit(True).alias(IS_CURRENT),
    )
    return old.unionByName(new, allowMissingColumns=True)


def boundaries(target: DataFrame, staged: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Where versions begin or end, for keys with several staged changes in order. The first
    change of a key opens a version unless the key has an open one with equal values; a later
    one does if the change before was a delete or any value differs. Deletes open nothing. Rows
    that change nothing are no boundary.

    The windows run over a key's changes, and over segments of them where a key has more than may
    stay in a task (ranges.hot_keys): what a segment needs of those before and after it is one row of each,
    which is broadcast. All windows share one shuffle by key and segment."""
    hot = hot_keys(staged, keys, ORDERING)
    parts = [*keys, "__segment"]
    dealt = staged.withColumn("__segment", F.lit(0).cast("long")) if hot is None else segmented(staged, keys, ORDERING, hot)
    order = Window.partitionBy(*parts).orderBy(ORDERING)
    row = F.struct(F.lit(True).alias("there"), F.col(OPERATION).alias("operation"), *[F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(values)])
    numbered = dealt.select("*", F.lag(row).over(order).alias("__before"))
    if hot is not None:
        numbered = _carried(numbered, hot, keys, F.max_by(row, ORDERING), F.lag, "__before")
    first = F.col("s.__before").isNull()
    open_now = target.filter(IS_CURRENT).select(*keys, *values)
    met = numbered.alias("s").join(open_now.alias("t"), same_keys("s", "t", keys) & first, "left")
    known = F.col(f"t.{quoted(keys[0])}").isNotNull() & ~differs("s", "t", values)
    moved = reduce(
        lambda a, b: a | b,
        [~F.col(f"s.{quoted(c)}").eqNullSafe(F.col(f"s.__before.v{i}")) for i, c in enumerate(values)],
        F.col("s.__before.operation") == DELETE,
    )
    opens = (F.col(f"s.{OPERATION}") != DELETE) & F.when(first, ~known).otherwise(moved)
    marked = met.select("s.*", F.coalesce(opens, F.lit(False)).alias("__opens"))
    edges = marked.filter(F.col("__opens") | (F.col(OPERATION) == DELETE))
    at = F.struct(F.col(CHANGED_AT).alias("at"))
    edges = edges.select("*", F.lead(at).over(order).alias("__after"), F.lag(F.lit(True)).over(order).alias("__edges_before"))
    if hot is not None:
        edges = _carried(edges, hot, keys, F.min_by(at, ORDERING), F.lead, "__after")
        edges = _carried(edges, hot, keys, F.bool_or(F.lit(True)), F.lag, "__edges_before")
    number = F.when(F.col("__edges_before").isNull(), 1).otherwise(2)
    return edges.select(*keys, *values, OPERATION, ORDERING, CHANGED_AT, "__opens", F.col("__after.at").alias("__next"), number.alias("__edge"))


def _carried(rows: DataFrame, hot: DataFrame, keys: list[str], end: Column, side: Callable[[Column], Column], name: str) -> DataFrame:
    """Fills a column that is null at a segment's end from the segment beside it that has rows: end is
    what it gives, side is lag or lead. One row for each segment of a hot key."""
    own = rows.join(F.broadcast(hot.select(*keys)), keys, "left_semi")
    ends = own.groupBy(*keys, "__segment").agg(end.alias("__end"))
    beside = ends.select(*keys, "__segment", side(F.col("__end")).over(Window.partitionBy(*keys).orderBy("__segment")).alias("__beside"))
    met = rows.join(F.broadcast(beside), [*keys, "__segment"], "left")
    return met.select(*[F.coalesce(name, "__beside").alias(name) if c == name else F.col(quoted(c)) for c in rows.columns])


def many_versions(target: DataFrame, staged: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Applies several ordered changes for each key: each boundary that opens is a version
    until the next boundary, and the version open before closes at the first. A version that
    is there already, by its key, isn't added again."""
    edges = boundaries(target, staged, keys, values)
    first = edges.filter("__edge = 1").select(*keys, F.col(CHANGED_AT).alias("__until"))
    met = target.alias("t").join(first.alias("f"), same_keys("t", "f", keys), "left")
    closing = F.col(f"t.{IS_CURRENT}") & F.col("f.__until").isNotNull()
    changed = {
        VALID_TO: F.when(closing, F.col("f.__until").cast("timestamp_ntz")).otherwise(F.col(f"t.{VALID_TO}")),
        IS_CURRENT: F.col(f"t.{IS_CURRENT}") & ~closing,
    }
    old = met.select(*[changed.get(c, F.col(f"t.{quoted(c)}")).alias(c) for c in target.columns])
    new = edges.filter("__opens").select(
        *keys,
        *values,
        F.concat(F.col(ORDERING), F.lit("|"), key_text(keys)).alias(VERSION_KEY),
        F.col(CHANGED_AT).cast("timestamp_ntz").alias(VALID_FROM),
        F.col("__next").cast("timestamp_ntz").alias(VALID_TO),
        F.col("__next").isNull().alias(IS_CURRENT),
    )
    new = new.join(target.select(VERSION_KEY), VERSION_KEY, "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def apply(target: DataFrame, staged: DataFrame, keys: list[str], values: list[str], now: Any) -> DataFrame:
    """A pass of either kind: keys with several ordered changes get their chain of versions,
    the others are closed and opened. Without ordering there must be one row for each key."""
    if not has_ordering(staged):
        return close_and_open(target, staged, keys, values, now)
    counts = staged.groupBy(*keys).agg(F.count("*").alias("__rows"))
    counted = staged.join(counts, keys).select(*staged.columns, "__rows")
    once = counted.filter("__rows = 1").drop("__rows")
    many = counted.filter("__rows > 1").drop("__rows")
    return many_versions(close_and_open(target, once, keys, values, now), many, keys, values)


def reconcile_close(target: DataFrame, staged_keys: DataFrame, keys: list[str], now: Any, scope: Column | None = None, guard: Guard = Guard("none")) -> DataFrame:
    """Closes open versions in scope whose key isn't staged, unless the guard refuses."""
    there = staged_keys.select(*keys).distinct().withColumn("__there", F.lit(True))
    met = target.join(there, keys, "left")
    scoped = F.col(IS_CURRENT) & in_scope(scope)
    gone = scoped & F.col("__there").isNull()
    if guard.kind != "none":
        counts = met.agg(F.count_if(scoped), F.count_if(gone)).first()
        guard.check(counts[1], counts[0])
    changed = {VALID_TO: F.when(gone, F.lit(now).cast("timestamp_ntz")).otherwise(F.col(VALID_TO)), IS_CURRENT: F.col(IS_CURRENT) & ~gone}
    return met.select(*[changed.get(c, F.col(quoted(c))).alias(c) for c in target.columns])


def current_only(target: DataFrame) -> DataFrame:
    """The open versions; of a table of snapshots, the last one."""
    if IS_CURRENT in target.columns:
        return target.filter(IS_CURRENT)
    from ..model import SNAPSHOT_AT

    last = target.agg(F.max(SNAPSHOT_AT)).first()[0]
    return target.filter(F.col(SNAPSHOT_AT) == F.lit(last)) if last is not None else target.limit(0)


def empty_target(staged: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A dimension table for these columns, without rows."""
    columns = staged.select(*keys, *values).limit(0)
    return columns.select(
        F.lit("").alias(VERSION_KEY), *keys, *values,
        F.lit(None).cast("timestamp_ntz").alias(VALID_FROM), F.lit(None).cast("timestamp_ntz").alias(VALID_TO),
        F.lit(True).alias(IS_CURRENT),
    )
