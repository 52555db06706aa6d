"""Exact top-k inner products by Fagin's threshold algorithm.

Components become integers, floor(256 * x). Each task sorts its rows once for each dimension.
A query walks all of these lists from their best end, in steps: rows met for the first time
are scored in full, and the components where the lists stand bound the score of every
row not met yet. When that bound is below the kth best score, no further row can count.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; vectors of different lengths don't meet; ties go to the smaller vec_id; repeated
rows each count, those of the query's own vec_id never do; a query with fewer than k
candidates gets all; an empty table gives an empty result. Scores must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .search import EVERY, SHARD, Best, finite, is_query, matrices, search, tables

#: FIRST is how deep the first step goes; each step goes twice as far as the last.
SCALE, K, FIRST = 256, 5, 32


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer vector of each row that takes part."""
    component = lambda x: F.floor(x.cast("double") * SCALE)
    return vectors.filter(F.col("vec_id").isNotNull() & finite()).select(
        F.col("vec_id").cast("long"), F.transform("embedding", component).alias("vector")
    )


class Lists:
    """Rows (integers, as doubles where these are exact) with a sorted list per dimension."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray):
        small = matrix.size == 0 or np.abs(matrix).max() < 2**20
        self.matrix = matrix.astype(np.float64) if small else matrix
        self.ids = ids
        self.down = np.argsort(-matrix, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(matrix, self.down, axis=0)

    def search(self, query: np.ndarray, own: int, best: Best, nth: int) -> int:
        """Adds the best rows to best; returns how many rows were scored."""
        n, dims = self.matrix.shape
        used = np.flatnonzero(query)
        rising = query[used] < 0
        met = np.zeros(n, bool)
        weights = query.astype(self.matrix.dtype)
        scored = at = 0
        step = FIRST
        while at < n:
            to = min(at + step, n)
            if len(used):
                for d, up in zip(used, rising):
                    met[self.down[n - to : n - at, d] if up else self.down[at:to, d]] = True
            if not len(used) or 2 * np.count_nonzero(met) > n:
                met[:] = True  # the rest is scored at once when most is met
            rows = np.flatnonzero(met & ~self._done(n, at == 0))
            self.seen[rows] = True
            scored += len(rows)
            rows = rows[self.ids[rows] != own]
            if len(rows):
                best.add(nth, np.rint(self.matrix[rows] @ weights).astype(np.int64), self.ids[rows])
            if met.all():
                break
            stand = np.where(rising, self.values[n - to, used], self.values[to - 1, used])
            bound = best.bound(nth)
            if bound is not None and int(stand @ query[used]) < bound:
                break
            at, step = to, 2 * step
        return scored

    def _done(self, n: int, begin: bool) -> np.ndarray:
        if begin:
            self.seen = np.zeros(n, bool)
        return self.seen


def answer(queries: pd.DataFrame, batches: Iterator[pa.RecordBatch], k: int = K) -> Iterator[pa.RecordBatch]:
    """The best rows of a partition for each query."""
    ids = queries["vec_id"].to_numpy(np.int64)
    vectors = [np.asarray(v, np.int64) for v in queries["vector"]]
    sizes = np.array([len(v) for v in vectors], np.int64)
    best = Best(len(ids), k, np.int64)
    for table in tables(batches, SHARD):
        row_ids = table["vec_id"].to_numpy()
        for rows, matrix in matrices(table, "vector"):
            lists = Lists(matrix, row_ids[rows])
            for q in np.flatnonzero(sizes == matrix.shape[1]):
                lists.search(vectors[q], ids[q], best, q)
    yield best.batch(ids)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query row."""
    rows = materialize(integers(vectors), "integers")
    return search(rows, rows.filter(is_query(every)), lambda q, b: answer(q, b, k), "long", k)


SQL = f"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % {EVERY} = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
