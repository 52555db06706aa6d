"""Verification of a target against its source: grouped measures, statuses, row differences."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import differs, quoted, same_keys
from ..functions.project import expression, join_relationships, used_relationships
from ..model import ColumnMapping, Mapping
from .ranges import block_of
from .scd2 import current_only

MATCH, DIFFERS, ONLY_SOURCE, ONLY_TARGET = "Match", "Differs", "MissingFromTarget", "MissingFromSource"
ROWS = "row_count"
#: Parts that a range of keys is cut into where checksums are compared, and ranges that are broadcast.
FANOUT, FEW = 1024, 1 << 20


def _text(e: Column) -> Column:
    """A group value as text; null and empty text are one group."""
    return F.coalesce(e.cast("string"), F.lit(""))


def grouped(side: DataFrame, groups: dict[str, Column], measures: dict[str, Column] | None = None) -> DataFrame:
    """One side of a check: the number of rows, or sums of the measures, for each group."""
    keyed = side.groupBy(*[_text(e).alias(g) for g, e in groups.items()])
    if measures is None:
        return keyed.agg(F.count("*").cast("double").alias(ROWS))
    if not measures:
        raise ValueError("a sum check needs a measure")
    return keyed.agg(*[F.sum(e).cast("double").alias(m) for m, e in measures.items()])


def source_side(source: DataFrame, mapping: Mapping, groups: list[str], measures: list[str] | None = None, filter: str | None = None) -> DataFrame:
    """The source's side, by target names: each stands for its column's own expression."""
    joined = join_relationships(source, used_relationships(mapping))
    joined = joined.filter(filter) if filter else joined
    by = {c.name: expression(c) for c in mapping.columns}
    own = lambda n: by[n] if n in by else expression(ColumnMapping(n))
    return grouped(joined, {g: own(g) for g in groups}, None if measures is None else {m: own(m) for m in measures})


def target_side(target: DataFrame, groups: list[str], measures: list[str] | None = None, filter: str | None = None, only_current: bool = False) -> DataFrame:
    target = current_only(target) if only_current else target
    target = target.filter(filter) if filter else target
    col = lambda n: F.col(quoted(n))
    return grouped(target, {g: col(g) for g in groups}, None if measures is None else {m: col(m) for m in measures})


def sql_side(spark: SparkSession, sql: str, groups: list[str], measures: list[str]) -> DataFrame:
    """A side from a user's SQL, which gives the group and measure columns."""
    found = spark.sql(sql)
    return found.select(*[_text(F.col(g)).alias(g) for g in groups], *[F.col(m).cast("double").alias(m) for m in measures])


def scripted_side(build: Callable[[], DataFrame], groups: list[str], measures: list[str]) -> DataFrame:
    found = build()
    return found.select(*[_text(F.col(g)).alias(g) for g in groups], *[F.col(m).cast("double").alias(m) for m in measures])


def exceeds(source: Column, target: Column, threshold: float) -> Column:
    """Whether two measures differ: at all, or by more than that share of the larger."""
    s, t = F.coalesce(source, F.lit(0.0)), F.coalesce(target, F.lit(0.0))
    gap = F.abs(t - s)
    if threshold <= 0:
        return gap != 0
    return (gap != 0) & (gap / F.greatest(F.abs(s), F.abs(t)) > threshold)


def compare(source: DataFrame, target: DataFrame, groups: list[str], measures: list[str], threshold: float = 0.0) -> DataFrame:
    """For each group of either side: <m>_source, <m>_target, <m>_difference (target less
    source, a missing measure counting as 0 there) and its status. Only grouped rows are
    joined, so the join is as small as the groups."""
    names = groups or ["__all"]
    if not groups:
        source, target = (x.withColumn("__all", F.lit("")) for x in (source, target))
    s = source.withColumn("__source", F.lit(True)).alias("s")
    t = target.withColumn("__target", F.lit(True)).alias("t")
    met = s.join(t, same_keys("s", "t", names), "full")
    each = []
    for m in measures:
        a, b = F.col(f"s.{quoted(m)}"), F.col(f"t.{quoted(m)}")
        gap = F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))
        each += [a.alias(f"{m}_source"), b.alias(f"{m}_target"), gap.alias(f"{m}_difference")]
    off = reduce(lambda x, y: x | y, [exceeds(F.col(f"s.{quoted(m)}"), F.col(f"t.{quoted(m)}"), threshold) for m in measures])
    status = (
        F.when(F.col("t.__target").isNull(), ONLY_SOURCE)
        .when(F.col("s.__source").isNull(), ONLY_TARGET)
        .when(off, DIFFERS)
        .otherwise(MATCH)
    )
    keys = [F.coalesce(F.col(f"s.{quoted(g)}"), F.col(f"t.{quoted(g)}")).alias(g) for g in groups]
    return met.select(*keys, *each, status.alias("status"))


def check(source: DataFrame, mapping: Mapping, target: DataFrame, groups: list[str], measures: list[str] | None = None, threshold: float = 0.0, filter: str | None = None, only_current: bool = False) -> DataFrame:
    """A mapping's target against its source: row counts, or sums of measures, for each group. The
    filter holds on both sides, by the names that each has."""
    sides = source_side(source, mapping, groups, measures, filter), target_side(target, groups, measures, filter, only_current)
    return compare(*sides, groups, measures or [ROWS], threshold)


def summary(result: DataFrame) -> DataFrame:
    return result.agg(F.count("*").alias("groups"), F.count_if(F.col("status") != MATCH).alias("differing"))


def page(result: DataFrame, order: list[str], offset: int, limit: int, differing: bool = False, most: int = 500) -> DataFrame:
    """A page of a result, in order; at most 500 rows."""
    rows = result.filter(F.col("status") != MATCH) if differing else result
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 0), most))


def save(result: DataFrame, path: str, facts: dict[str, str]) -> None:
    """Writes a result as Parquet, with the check's facts in a JSON file beside it."""
    spark = result.sparkSession
    result.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.facts")


def row_difference(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose rows are missing, extra or different, null equalling null, and those
    that match."""
    values = [c for c in source.columns if c not in keys]
    met = source.alias("s").join(target.alias("t"), same_keys("s", "t", keys), "full")
    s, t = F.col(f"s.{quoted(keys[0])}"), F.col(f"t.{quoted(keys[0])}")
    kind = F.when(t.isNull(), "missing").when(s.isNull(), "extra").when(differs("s", "t", values), "different").otherwise("matched")
    return met.select(*[F.coalesce(F.col(f"s.{quoted(k)}"), F.col(f"t.{quoted(k)}")).alias(k) for k in keys], kind.alias("kind"))


def _checksums(side: DataFrame, keys: list[str], columns: list[str], ranges: Column, name: str) -> DataFrame:
    """Rows, and the sum and the exclusive or of the rows' hashes, of each range."""
    whole = F.xxhash64(F.lit(1), *[F.col(quoted(c)) for c in columns])
    other = F.xxhash64(F.lit(2), *[F.isnull(quoted(c)) for c in columns], *[F.col(quoted(c)) for c in columns])
    low, high = F.sum(F.shiftrightunsigned(whole, 32)), F.sum(whole.bitwiseAND(0xFFFFFFFF))
    return side.groupBy(ranges.alias("__range")).agg(F.struct(F.count("*"), low, high, F.bit_xor(other)).alias(name))


def _differing(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], ranges: Column) -> DataFrame:
    s, t = (_checksums(side, keys, columns, ranges, n) for side, n in ((source, "__s"), (target, "__t")))
    return s.join(t, "__range", "full").filter(~F.col("__s").eqNullSafe(F.col("__t"))).select("__range")


def differing_ranges(source: DataFrame, target: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """The ranges of the keys' hashes in which the sides differ, as numbers below fanout * fanout. Checksums
    of fanout ranges are compared first, then those of the differing ranges' parts: in the first
    comparison fanout rows of a task move, in the second those of the ranges that differ. null equals
    null; a difference that no checksum shows has a probability of about 2 ** -64 for each range."""
    columns = [*keys, *[c for c in source.columns if c not in keys]]
    target = _alike(source, target)
    coarse = _differing(source, target, keys, columns, _range(keys, fanout))
    numbers = [r[0] for r in coarse.collect()]  # fanout at most
    if not numbers:
        return coarse.select(F.col("__range").cast("long")).limit(0)
    if len(numbers) == fanout:  # all of them: no part can be left out first
        inside = (source, target)
    else:
        inside = tuple(side.filter(_range(keys, fanout).isin(numbers)) for side in (source, target))
    fine = _range(keys, fanout) * fanout + _range(keys, fanout, 1)
    return _differing(*inside, keys, columns, fine)


def _range(keys: list[str], fanout: int, level: int = 0) -> Column:
    digest = F.xxhash64(F.lit("range"), *[F.col(quoted(k)) for k in keys])
    for _ in range(level):
        digest = F.xxhash64(digest)
    return F.pmod(digest, F.lit(fanout).cast("long"))


def _alike(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target with the source's columns and types, by which values hash."""
    return target.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in source.schema])


def checked_difference(source: DataFrame, target: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """row_difference by checksums: the rows of ranges that differ are joined, all columns of
    them; of other ranges the source's keys are given as matched, without a shuffle."""
    found = differing_ranges(source, target, keys, fanout)
    numbers = found.distinct()
    fine = (_range(keys, fanout) * fanout + _range(keys, fanout, 1)).alias("__range")
    few = numbers.count() <= FEW
    pick = lambda side, how: side.withColumn("__range", fine).join(F.broadcast(numbers) if few else numbers, "__range", how).drop("__range")
    target = _alike(source, target)
    same = pick(source.select(*keys), "left_anti").select(*keys, F.lit("matched").alias("kind"))
    return same.unionByName(row_difference(pick(source, "left_semi"), pick(target, "left_semi"), keys))


def gaps(df: DataFrame, column: str) -> DataFrame:
    """Where whole numbers are missing: the last before a gap and the first after it. Windows
    run over ranges of ids, and one more over the ranges' ends, of which there is a bounded
    number, so that no task has to sort all ids."""
    ids = df.select(F.col(column).alias("id")).filter("id IS NOT NULL").distinct()
    inner = ids.withColumn("block", block_of(ids, "id")("id")).withColumn("next", F.lead("id").over(Window.partitionBy("block").orderBy("id")))
    ends = inner.groupBy("block").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    across = ends.select(F.col("last").alias("id"), F.lead("first").over(Window.orderBy("block")).alias("next"))
    both = inner.filter("next IS NOT NULL").select("id", "next").unionByName(across.filter("next IS NOT NULL"))
    return both.filter(F.col("next") > F.col("id") + 1).select(F.col("id").alias("gap_after"), F.col("next").alias("gap_before"))


def drift(df: DataFrame, key: str, value: str, lose: int = 7, alter: int = 11, phantom: int = 13, shift: int = 10_000_000) -> DataFrame:
    """A copy with known faults, to test checks on: rows missing, values altered, rows added."""
    kept = df.filter(F.col(key) % lose != 0)
    altered = kept.withColumn(value, F.when(F.col(key) % alter == 0, F.col(value) + 1).otherwise(F.col(value)))
    return altered.unionByName(df.filter(F.col(key) % phantom == 0).withColumn(key, F.col(key) + shift))
