"""What both vector searches share: finite vectors, blocks of queries, and the best of all tasks.

A query set is searched in blocks of at most ``BLOCK`` queries, whose size bounds what is
broadcast; each task holds at most ``SHARD`` rows at a time, answers the block's queries
over them and keeps the best k of each query so far. One shuffle then brings a query's best
of all tasks together, k rows from each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K, EVERY = 5, 50
BLOCK, SHARD = 1 << 15, 1 << 14

#: (query matrix, rows' matrix, row ids, query ids, further columns, bound) to the best of each query
Answer = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def finite(vector: str = "embedding") -> Column:
    """True for a vector that is neither null nor empty and has finite components only."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ok


def is_query(every: int = EVERY) -> Column:
    return F.col("vec_id") % every == 0


def matrices(batch: pa.Table, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a batch."""
    column = batch[vector].combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[:-1][rows][:, None] + np.arange(size)]


def tables(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches joined or cut to tables of at most this many rows."""
    held, size = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, most - size)
            batch = batch.slice(len(part))
            held.append(part)
            size += len(part)
            if size == most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Best:
    """The best k rows of each query so far: higher score first, ties to the smaller id."""

    def __init__(self, queries: int, k: int, dtype: type):
        least = -np.inf if dtype is np.float64 else np.iinfo(dtype).min
        self.score = np.full((queries, k), least, dtype)
        self.id = np.full((queries, k), -1, np.int64)
        self.found = np.zeros(queries, np.int64)
        self.k = k

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        have = self.found[query]
        if have == self.k:
            may = scores >= self.score[query, -1]
            scores, ids = scores[may], ids[may]
        elif len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            may = scores >= cut
            scores, ids = scores[may], ids[may]
        if not len(scores):
            return
        scores = np.r_[self.score[query, :have], scores]
        ids = np.r_[self.id[query, :have], ids]
        order = np.lexsort((ids, -scores))[: self.k]
        n = self.found[query] = len(order)
        self.score[query, :n], self.id[query, :n] = scores[order], ids[order]

    def bound(self, query: int):
        """What a row must reach to count, or None while there are too few."""
        return self.score[query, -1] if self.found[query] == self.k else None

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        q, at = np.nonzero(np.arange(self.k) < self.found[:, None])
        columns = [ids[q], q, self.id[q, at], self.score[q, at]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "nth", "vec_id", "score"])


def query_blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[pd.DataFrame]:
    """The queries, a block at a time: a block's number is drawn from a hash, which deals them
    out evenly, and each is fetched by its own job."""
    count = queries.count()
    blocks = max(1, math.ceil(count / (size * 0.9)))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    for b in range(blocks if count else 0):
        yield queries.filter(number == b).toPandas()


def search(rows: DataFrame, queries: DataFrame, task: Callable, score_type: str, k: int = K, block: int = BLOCK) -> DataFrame:
    """rows, queries: stored tables. task(queries' frame) gives a function of a partition's
    batches that yields Best.batch(). Returns query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    schema = f"query_id long, nth long, vec_id long, score {score_type}"
    found, blocks = [], query_blocks(queries, block)
    for frame in blocks:
        held = spark.sparkContext.broadcast(frame)
        each = rows.mapInArrow(_bound(task, held), schema)
        order = Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id")
        ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(ranked.select("query_id", "rank", "vec_id", "score"))
        if len(frame) > block // 2:  # more may follow
            found[-1] = materialize(found[-1], "found")
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _bound(task: Callable, held) -> Callable:
    return lambda batches: task(held.value, batches)
