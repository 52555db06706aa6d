"""Mixing sources to target weights (native: DataFrame functions only).

Each source gets a share of all words by its weight. A source repeats its documents
``rate`` = target / size times, at most ``cap`` times; what the cap frees goes to the other
sources by weight. A document is taken floor(rate) times, and once more with a probability
of rate's fraction, drawn from a hash of its id and a seed, so that reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 times in words (its row
still gets copies); a null source is a source of its own, ordered last; repeated rows
each count; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count, wrapped

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def draw(key: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), 52 bits of an MD5 of the key: the same in any engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rank_sources(sizes: DataFrame) -> DataFrame:
    """Adds index, from 0, in code point order with null last. The order is made by ranges:
    a source's index is its place in its range after the rows of the ranges before."""
    ranged = sizes.orderBy(F.col("source").asc_nulls_last())
    placed = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(parts), "part").select(
        "source", "source_size", (F.col("before") + local).alias("index")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size. Adds target (double), at most cap * source_size.

    The targets are min(cap * size, level * weight), with the level at which they sum to all
    sizes. It is found by raising it until no further source meets its cap; every step is
    one small aggregation over the sources."""
    cases = [(F.col("index") % len(weights) == i, w) for i, w in enumerate(weights)]
    weight = reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).cast("long")
    ranked = rank_sources(sizes).withColumn("weight", weight)
    limit, level, step = F.col("source_size") * cap, None, -1.0
    while level != step:
        level = step
        full = limit < F.col("weight") * F.lit(level)
        total, capped, free = ranked.agg(
            F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not free:
            break
        step = max(level, ((total or 0) - (capped or 0)) / free)
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(max(level, 0.0)))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs has doc_id, text and source. Returns doc_id, size, source_size, target, copies.

    The table of sources is as small as the number of sources; Spark broadcasts it when its
    measured size is small, else the join shuffles and splits a hot source (AQE)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = materialize(sized, "sizes")
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    joined = sized.alias("d").join(per_source.alias("s"), F.expr("d.source <=> s.source"))
    return joined.select("doc_id", "size", "source_size", "target", copies(seed).alias("copies"))


def copies(seed: str = SEED) -> Column:
    """How often a row with source_size and target is taken."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return F.floor(rate) + extra


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs, with all its columns, as often as it is taken."""
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    per_source = targets(sizes, weights, cap).withColumnRenamed("source", "__source")
    joined = wrapped(docs, "doc_id", "source").join(per_source, F.col("source").eqNullSafe(F.col("__source")))
    taken = joined.withColumn("copies", copies(seed).cast("int")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """What the query op9 returns: the mix with the words taken instead of copies."""
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT CAST((SELECT sum(source_size) FROM sources)
         - coalesce(sum({CAP} * source_size) OVER w, 0) AS DOUBLE)
         / CAST((SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM sources
  WINDOW w AS (ORDER BY source_size / CAST(weight AS DOUBLE), source ASC NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size,
         least(CAST({CAP} * source_size AS DOUBLE), weight * (SELECT max(level) FROM levels)) AS target
  FROM sources),
rated AS (
  SELECT d.doc_id, d.size, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS u
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
