"""Hard negatives from a norm-bucketed search.

An anchor's positives are its best rows of the same label. Each positive opens a window of scores,
from half of its own to 95 hundredths of it, and the anchor's best rows of other labels whose scores
lie in the window are the positive's hard negatives: near, but not so near that they may be
positives without the label.

Rows are sorted by norm, the largest first, and searched in buckets of ``BUCKET``. By Cauchy-Schwarz
no row of a bucket scores more than the anchor's norm times the bucket's largest, so a bucket is left
out for each anchor whose every window asks for more: the window's lower limit, or the running kth
score where it has found that many. Anchors come in blocks of bounded size, each row belongs to one
task, and a task's best of each window meet in one shuffle, k rows of each.

Defined results: rows with a null id or label, with a null or empty vector, or with a null or
non-finite component take no part; vectors of different lengths don't meet; ties go to the
smaller vec_id; repeated rows each count, as anchors, positives and negatives, but never for an
anchor of their own vec_id; a window with fewer than k rows gives all it has, one of a positive below
zero has none; an empty table gives an empty result. Scores must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .search import EVERY, SHARD, Best, finite, is_query, matrices, query_blocks, tables

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Every so many ids have a label that isn't theirs.
NOISY, LABELS = 7, 10
BUCKET = 1 << 10
FOUND = "anchor long, slot int, vec_id long, score long"


def participants(vectors: DataFrame) -> DataFrame:
    """vec_id, label, the vector in whole numbers and its norm, for the rows that take part."""
    noisy = F.when(F.col("vec_id") % NOISY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite())
    rows = rows.select(F.col("vec_id").cast("long"), noisy.cast("long").alias("label"), whole.alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.withColumn("norm", F.sqrt(square))


def window_of(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest whole score with 50 p <= 100 n <= 95 p, without overflow."""
    return -(-score // 2), score + (-score) // 20


class Buckets:
    """The anchors of a block against the buckets of a task. same: rows of the anchor's label
    are searched, else those of other labels. An anchor has windows [low, high], slots of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.low, self.high, self.same = ids, labels, vectors, low, high, same
        # a little more than exact, so that no rounding makes a bound too small
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.slots = low.shape[1]
        self.best = Best(low.size, k, np.int64)
        self.least = low.astype(np.float64)  # what a row must reach to count, by window
        self.scored = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, norm: float) -> None:
        bound = self.norms * norm * (1 + 1e-9)
        live = np.flatnonzero((bound[:, None] >= self.least).any(axis=1))
        if not len(live):
            return
        self.scored += len(live) * len(ids)
        scores = self._scores(live, matrix)
        may = (labels == self.labels[live, None]) == self.same
        may &= ids != self.ids[live, None]
        for slot in range(self.slots):
            low, high = (x[live, slot] for x in (self.low, self.high))
            inside = may & (scores >= low[:, None]) & (scores <= high[:, None])
            best = np.where(inside, scores, np.iinfo(np.int64).min).max(axis=1)
            for a in np.flatnonzero(inside.any(axis=1) & (best >= self.least[live, slot])):
                window, some = live[a] * self.slots + slot, inside[a]
                self.best.add(window, scores[a][some], ids[some])
                reached = self.best.bound(window)
                if reached is not None:
                    self.least[live[a], slot] = max(self.least[live[a], slot], reached)

    def _scores(self, live: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Inner products: of doubles where these are exact."""
        anchors = self.vectors[live]
        most = float(np.abs(anchors).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * matrix.shape[1]
        if most < 2**53:
            return np.rint(anchors.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64)
        return anchors @ matrix.T


def answer(block: pd.DataFrame, batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of a partition for each window of each anchor of a block."""
    sizes = np.array([len(v) for v in block["vector"]], np.int64)
    groups = {}
    for size in np.unique(sizes):
        own = block[sizes == size]
        vectors = np.array(own["vector"].tolist(), np.int64).reshape(len(own), size)
        if same:
            low = np.full((len(own), 1), np.iinfo(np.int64).min)
            high = np.full((len(own), 1), np.iinfo(np.int64).max)
        else:  # windows that an anchor hasn't hold nothing
            low, high = (np.full((len(own), POSITIVES), x, np.int64) for x in (1, 0))
            for i, scores in enumerate(own["positives"]):
                low[i, : len(scores)], high[i, : len(scores)] = window_of(np.array(scores, np.int64))
            low[low > high] = np.iinfo(np.int64).max  # an empty window keeps no bucket
        ids, labels = own["vec_id"].to_numpy(np.int64), own["label"].to_numpy(np.int64)
        groups[int(size)] = (own["anchor"].to_numpy(np.int64), Buckets(ids, labels, vectors, low, high, k, same))
    for table in tables(batches, SHARD):
        ids, labels, norms = (table[c].to_numpy() for c in ("vec_id", "label", "norm"))
        for rows, matrix in matrices(table, "vector"):
            if matrix.shape[1] not in groups:
                continue
            order = np.argsort(-norms[rows], kind="stable")
            for at in range(0, len(order), BUCKET):
                some = order[at : at + BUCKET]
                groups[matrix.shape[1]][1].add(ids[rows[some]], labels[rows[some]], matrix[some], float(norms[rows[some[0]]]))
    for anchors, buckets in groups.values():
        best = buckets.best
        q, at = np.nonzero(np.arange(k) < best.found[:, None])
        columns = [anchors[q // buckets.slots], (q % buckets.slots).astype(np.int32), best.id[q, at], best.score[q, at]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "slot", "vec_id", "score"])


def _searched(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, slot, rank, vec_id and score of each window's k best rows; a stored table."""
    spark, found = rows.sparkSession, []
    for block in query_blocks(anchors):
        held = spark.sparkContext.broadcast(block)
        each = rows.mapInArrow(_task(held, k, same), FOUND)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
        ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(materialize(ranked, "found", True))
    out = found[0] if found else spark.createDataFrame([], FOUND + ", rank int")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _task(held, k: int, same: bool):
    return lambda batches: answer(held.value, batches, k, same)


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialize(participants(vectors).sortWithinPartitions(F.desc("norm")), "by-norm")
    anchors = materialize(rows.filter(is_query(every)).drop("norm").withColumn("anchor", F.monotonically_increasing_id()), "anchors", True)
    first = _searched(rows, anchors, positives, True)
    pairs = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    asked = materialize(anchors.join(pairs, "anchor"), "asked", True)
    found = _searched(rows, asked.withColumn("positives", F.col("positives.score")), negatives, False)
    slots = asked.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("slot", "p"))
    named = slots.select("anchor", "slot", "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return named.join(found, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % {NOISY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % {EVERY} = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM pairs WHERE same) WHERE n <= {POSITIVES}),
negatives AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}
"""
