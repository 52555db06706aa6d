"""Writers: each takes the target's state and staged changes and gives the target's new state.

Parquet tables know no MERGE, so a writer is a function of two tables, whose result is published
as the table's next version (see plans.store). Staged rows carry __operation; the same
plan serves a batch and each micro-batch of a stream. Keys match by plain equality (a null key
never does, and none may be staged), values compare null-safely, and a scope that is null for a row doesn't hold it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import quoted, same_keys
from ..model import CHANGED_AT, DELETE, INSERT, OPERATION, ORDERING, SNAPSHOT_AT, DuplicateKeys, GuardRefused

MARKS = (OPERATION, ORDERING, CHANGED_AT)


def has_ordering(staged: DataFrame) -> bool:
    """Whether changes carry their order and time; known from the columns, even without rows."""
    return {ORDERING, CHANGED_AT} <= set(staged.columns)


def duplicate_keys(staged: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one staged row has, and how many."""
    return staged.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def one_per_key(staged: DataFrame, keys: list[str]) -> DataFrame:
    """The last staged row of each key where changes carry their order. Else a key with two
    rows is an error, found by an aggregation on the keys."""
    if has_ordering(staged):
        last = F.max_by(F.struct(*[F.col(quoted(c)) for c in staged.columns]), ORDERING).alias("last")
        return staged.groupBy(*keys).agg(last).select("last.*")
    some = duplicate_keys(staged, keys).limit(3).collect()
    if some:
        raise DuplicateKeys(f"several staged rows of one key: {[r.asDict() for r in some]}")
    return staged


def unique(staged: DataFrame, keys: list[str]) -> DataFrame:
    """staged, in whose plan a key with two rows is an error, and so is a row with a null in its
    key: nothing could find it again, and a repeated pass would add it a second time. One
    aggregation by the key, which reduces a hot key before it moves; its shuffle and order
    serve the join by key that follows."""
    columns = [F.col(quoted(k)) for k in keys]
    some_null = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
    key = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    row = F.any_value(F.struct(*[F.col(quoted(c)) for c in staged.columns])).alias("__row")
    counted = staged.groupBy(*columns).agg(F.count("*").alias("__rows"), row)
    said = F.when(some_null, F.concat(F.lit("a staged row has no key: "), key)).otherwise(F.concat(F.lit("several staged rows of one key: "), key))
    passes = F.when((F.col("__rows") == 1) & ~some_null, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    # the key comes from the grouping, by which the rows are partitioned now
    return counted.filter(passes).select(*[F.col(quoted(c)) if c in keys else F.col(f"__row.{quoted(c)}") for c in staged.columns])


def upsert(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Deletes, updates and inserts by key; rows that nothing is staged for stay. Columns of
    the target that aren't staged keep their values, and are null in new rows. Two staged rows
    of a key are an error. One full outer join, which shuffles each side once by the key."""
    given = [c for c in staged.columns if c not in MARKS]
    met = target.alias("t").join(unique(staged, keys).alias("s"), same_keys("t", "s", keys), "full")
    staged_here = F.col(f"s.{OPERATION}").isNotNull()
    kept = met.filter(~staged_here | (F.col(f"s.{OPERATION}") != DELETE))
    columns = [
        (F.when(staged_here, F.col(f"s.{quoted(c)}")).otherwise(F.col(f"t.{quoted(c)}")) if c in given else F.col(f"t.{quoted(c)}")).alias(c)
        for c in target.columns
    ]
    return kept.select(*columns)


def in_scope(scope: Column | None) -> Column:
    return F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))


def merge_reconcile(target: DataFrame, staged: DataFrame, keys: list[str], scope: Column | None = None) -> DataFrame:
    """Like upsert within a scope of the target, whose rows that aren't staged go. Rows out
    of scope are neither matched nor touched, so a staged key among them would be there twice:
    that is an error when the table is read, as are two staged rows of a key."""
    outside = target.filter(~in_scope(scope))
    given = [c for c in staged.columns if c not in MARKS]
    live = unique(staged.filter(F.col(OPERATION) != DELETE), keys)
    own = [c for c in target.columns if c not in given]
    every = target.select(*keys, *own, in_scope(scope).alias("__inside"))
    met = live.alias("s").join(every.alias("t"), same_keys("s", "t", keys), "left")
    said = F.concat(F.lit("a staged key exists out of scope: "), F.to_json(F.struct(*[F.col(f"s.{quoted(k)}").alias(k) for k in keys])))
    met = met.filter(F.when(F.coalesce(F.col("t.__inside"), F.lit(True)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    new = met.select(*[F.col(f"{'t' if c in own else 's'}.{quoted(c)}").alias(c) for c in target.columns])
    return outside.unionByName(new)


def scope_collisions(target: DataFrame, staged: DataFrame, keys: list[str], scope: Column | None) -> DataFrame:
    """Staged keys that exist out of scope, which merge_reconcile must not be given."""
    live = staged.filter(F.col(OPERATION) != DELETE)
    return live.join(target.filter(~in_scope(scope)), keys, "left_semi").select(*keys)


def delete_insert(target: DataFrame, staged: DataFrame, scope: Column | None = None) -> DataFrame:
    """The scope's rows go and the staged ones come; no key is needed. Columns that aren't
    staged are null. No shuffle."""
    live = staged.filter(F.col(OPERATION) != DELETE).drop(*MARKS)
    return target.filter(~in_scope(scope)).unionByName(live, allowMissingColumns=True).select(*target.columns)


def snapshot(target: DataFrame, staged: DataFrame, now: Any) -> DataFrame:
    """Every staged row is appended with the time of the snapshot, deletes and repeats too."""
    return target.unionByName(stamped(staged, now), allowMissingColumns=True)


def stamped(staged: DataFrame, now: Any) -> DataFrame:
    """The rows that a snapshot appends; they can be written in append mode as they are."""
    return staged.drop(*MARKS).withColumn(SNAPSHOT_AT, F.lit(now).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Guard:
    """kind none, or ratio: at most that share of the scope may go."""

    kind: str = "ratio"
    most: float = 0.5

    def check(self, deleted: int, scope: int) -> None:
        if self.kind == "ratio" and scope and deleted / scope > self.most:
            raise GuardRefused(f"{deleted} of {scope} rows would go, more than {self.most:.0%}")


def missing_keys(target: DataFrame, staged_keys: DataFrame, keys: list[str], scope: Column | None = None) -> DataFrame:
    """Target rows in scope whose key isn't staged. An anti join of the keys."""
    return target.filter(in_scope(scope)).join(staged_keys.select(*keys), keys, "left_anti")


def guard_counts(target: DataFrame, staged_keys: DataFrame, keys: list[str], scope: Column | None = None) -> DataFrame:
    """One row: scope_rows and deleted_rows, in one pass over the target."""
    scoped = target.filter(in_scope(scope)).select(*keys)
    there = staged_keys.select(*keys).distinct().withColumn("__there", F.lit(1))
    met = scoped.join(there, keys, "left")
    return met.agg(F.count("*").alias("scope_rows"), F.count_if(F.col("__there").isNull()).alias("deleted_rows"))


def reconcile_deletes(target: DataFrame, staged_keys: DataFrame, keys: list[str], scope: Column | None = None, guard: Guard = Guard("none")) -> DataFrame:
    """The target without the rows in scope whose key isn't staged, unless its guard refuses."""
    if guard.kind != "none":
        counts = guard_counts(target, staged_keys, keys, scope).first()
        guard.check(counts["deleted_rows"], counts["scope_rows"])
    there = staged_keys.select(*keys).distinct().withColumn("__there", F.lit(True))
    met = target.join(there, keys, "left")
    return met.filter(~in_scope(scope) | F.col("__there").isNotNull()).select(*target.columns)


def written(staged: DataFrame) -> DataFrame:
    """How many rows a writer takes, by operation."""
    return staged.groupBy(OPERATION).agg(F.count("*").alias("rows"))


def with_operation(rows: DataFrame, operation: str = INSERT) -> DataFrame:
    return rows.withColumn(OPERATION, F.lit(operation))
