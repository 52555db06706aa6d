"""Ranges by rank: rows in parts of about equal size, whatever their values are.

Split points are quantiles of what is there, not equal widths, so one far value doesn't
put all others in one range. Both kinds are a bounded number of values that the driver keeps.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges at most; there are as many as some for each shuffle partition.
BLOCKS, PER_PARTITION = 4096, 4
#: Rows of a key that stay together, and the most segments that all hot keys are cut into.
TOGETHER, SEGMENTS = 1 << 20, 1024
#: Rows that are sampled for each segment to find its ends.
SAMPLED = 64


def how_many(df: DataFrame) -> int:
    return min(BLOCKS, max(2, PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def split_points(df: DataFrame, column: str, ranges: int) -> list:
    """The values that part a column of numbers into ranges of about as many rows: at most one
    less than ranges, in order. One aggregation, of sketches that are merged."""
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 8 * ranges))).first()[0]
    return sorted(set(found or []))


def number_in(value: Column, points: Column, heads: Column) -> Column:
    """How many points are not beyond the value. points: arrays of them, in order; heads: their first
    ones. Two short searches in place of one long one."""
    group = F.size(F.filter(heads, lambda p: p <= value))
    inner = F.size(F.filter(F.element_at(points, F.greatest(group, F.lit(1))), lambda p: p <= value))
    step = F.size(F.element_at(points, 1))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inner).cast("long")


def grouped(points: list) -> list[list]:
    step = max(1, math.isqrt(len(points)))
    return [points[i : i + step] for i in range(0, len(points), step)]


def block_of(df: DataFrame, column: str) -> Callable[[str], Column]:
    """The number of the range that a value lies in, of ranges that hold about equally many rows of
    the column; values beyond all are in the first or the last, and null in the first."""
    points = split_points(df, column, how_many(df))
    if not points:
        return lambda c: F.lit(0).cast("long")
    kind = df.schema[column].dataType.simpleString()
    parts = grouped(points)
    text = lambda x: json.dumps(x, default=str)
    every = F.from_json(F.lit(text(parts)), f"array<array<{kind}>>")  # folded to a constant
    heads = F.from_json(F.lit(text([p[0] for p in parts])), f"array<{kind}>")
    return lambda c: F.coalesce(number_in(F.col(c), every, heads), F.lit(0).cast("long"))


def hot_keys(rows: DataFrame, keys: list[str], order: str, together: int = 0, segments: int = 0) -> DataFrame | None:
    """The keys with more rows than may stay together, with the values of order that cut them into
    segments: keys, __points, __heads. None if there are none. A segment has about as many rows as
    may stay together, or a share of all rows, so that keys and segments are few; the ends
    come from a sample that a hash draws."""
    together, segments = together or TOGETHER, segments or SEGMENTS
    total = rows.count()
    most = max(together, math.ceil(total / segments))
    if total <= most:
        return None
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).dropna(subset=list(keys))
    hot = rows.sparkSession.createDataFrame(counted.select(*keys).collect(), counted.select(*keys).schema)
    if hot.isEmpty():
        return None
    drawn = F.pmod(F.xxhash64(*keys, order), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLED / most)))
    sample = rows.select(*keys, order).filter(drawn).join(F.broadcast(hot), keys)
    listed = sample.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("__all"))
    kind = rows.schema[order].dataType
    schema = T.StructType([*hot.schema, T.StructField("__points", T.ArrayType(T.ArrayType(kind))), T.StructField("__heads", T.ArrayType(kind))])
    found = []
    for row in listed.collect():  # SAMPLED * segments values at most, about
        points = sorted(set(row["__all"][SAMPLED::SAMPLED]))
        if points:
            parts = grouped(points)
            found.append((*[row[k] for k in keys], parts, [p[0] for p in parts]))
    return rows.sparkSession.createDataFrame(found, schema) if found else None


def segmented(rows: DataFrame, keys: list[str], order: str, hot: DataFrame) -> DataFrame:
    """rows with __segment: of a hot key, by its order; 0 of another."""
    met = rows.join(F.broadcast(hot), keys, "left")
    number = F.coalesce(number_in(F.col(order), F.col("__points"), F.col("__heads")), F.lit(0).cast("long"))
    return met.select(*rows.columns, F.when(F.col("__heads").isNull(), F.lit(0).cast("long")).otherwise(number).alias("__segment"))
