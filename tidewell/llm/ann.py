"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to unit length and turned by pseudo-rotations (three rounds of seeded sign
flips and a fast Hadamard transform). A hash is the signed axis nearest to the turned vector,
and a bucket of a table is the sequence of several hashes, whose bits grow with the logarithm
of the rows, so that a bucket's load does not grow with the table; the last hash looks at
fewer axes to meet the number of bits. A query probes, in each of ``TABLES`` tables, the
buckets that its turned vectors miss by least, and what lies there is ranked by exact cosine.

How many buckets are probed is measured: the exact neighbours of ``SAMPLE`` queries are
searched, and the fewest probes are taken that reach ``RECALL`` of them. Where ``PROBES``
buckets don't suffice, hashes are shortened until they do.

Equal vectors are one class, which is indexed once, with its smallest ids. Every class is
indexed, and buckets have no cap: classes and probes are shuffled by table and leading bits of
their buckets, and what is crowded there is dealt over parts, classes and probes alike.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components
take no part; vectors of different lengths don't meet; ties go to the smaller vec_id;
repeated rows each count, those of the query's own vec_id never do; a query whose probes
find fewer than k rows is answered from all rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW_KEYS, join_hot, materialize
from .search import EVERY, SHARD, Best, finite, is_query, matrices, search, tables

K, TABLES, PROBES, SEED = 5, 8, 256, 17
#: Classes that a bucket holds on average.
LOAD = 16
#: Queries that are answered exactly to find the number of probes, and the share of their
#: neighbours that the probes must reach.
SAMPLE, RECALL = 128, 0.95
#: Queries that one task compares with a part of the classes.
ASKED = 1 << 12
#: Far more than a matrix product of unit vectors errs; rows this near the kth are compared exactly.
SLACK = 1e-9


@dataclass(frozen=True)
class Hashing:
    """Tables, bits of a bucket, leading bits that a shuffle goes by, buckets probed."""

    bits: int
    leading: int = 0
    probes: int = 1
    tables: int = TABLES
    seed: int = SEED


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pair = x.reshape(-1, n // (2 * half), 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(-1, n)
        half *= 2
    return x / np.sqrt(n)


def turn(units: np.ndarray, *number: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotation of this number; widths are padded to a power of two."""
    width = 1 << max(units.shape[1] - 1, 0).bit_length()
    x = np.zeros((len(units), width))
    x[:, : units.shape[1]] = units
    signs = np.random.default_rng([seed, *number]).choice([-1.0, 1.0], (3, width))
    for flip in signs:
        x = hadamard(x * flip)
    return x


def scaled(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two, which loses nothing, so that no square overflows; their
    lengths."""
    power = np.frexp(np.abs(matrix).max(axis=1))[1]
    rows = np.ldexp(matrix, -power[:, None])
    return rows, np.sqrt((rows * rows).sum(axis=1))


def unit(matrix: np.ndarray) -> np.ndarray:
    rows, lengths = scaled(matrix)
    return rows / lengths[:, None]


def cosines(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Summed row by row in one order, so that equal rows have equal cosines wherever they lie
    (a matrix product doesn't promise that)."""
    return (rows * query).sum(axis=1) / (lengths * length)


def axes(units: np.ndarray, table: int, how: Hashing) -> Iterator[np.ndarray]:
    """What each hash of a table looks at: components along the signed axes, 2 * axis and one
    more for its negative; as many as the hash has bits for."""
    left, number = how.bits, 0
    while left > 0:
        x = turn(units, table, number, seed=how.seed)
        bits = min(left, x.shape[1].bit_length())
        x = x[:, : 1 << (bits - 1)]
        yield np.stack([x, -x], axis=2).reshape(len(x), -1)
        left, number = left - bits, number + 1


def buckets(units: np.ndarray, table: int, how: Hashing) -> np.ndarray:
    """The bucket of each vector in a table."""
    code = np.zeros(len(units), np.int64)
    for x in axes(units, table, how):
        code = code * x.shape[1] + x.argmax(axis=1)
    return code


def probed(units: np.ndarray, table: int, how: Hashing) -> np.ndarray:
    """The buckets that each query probes in a table, nearest first. A bucket's distance is the
    sum, over its hashes, of the squares that its axis is short of the nearest; the best
    sequences begin with the best of one hash less."""
    step = max(1, (1 << 22) // (how.probes * 2 * units.shape[1]))
    found = []
    for at in range(0, len(units), step):
        part = units[at : at + step]
        code, short = np.zeros((len(part), 1), np.int64), np.zeros((len(part), 1))
        for x in axes(part, table, how):
            miss = (x.max(axis=1, keepdims=True) - x) ** 2
            short = (short[:, :, None] + miss[:, None, :]).reshape(len(part), -1)
            code = (code[:, :, None] * x.shape[1] + np.arange(x.shape[1])).reshape(len(part), -1)
            near = np.argsort(short, axis=1, kind="stable")[:, : how.probes]
            short, code = np.take_along_axis(short, near, 1), np.take_along_axis(code, near, 1)
        found.append(code)
    return np.concatenate(found)


def classes_of(rows: DataFrame, k: int = K) -> DataFrame:
    """cls, rid, vector, ids: one row for each distinct vector, with enough of its smallest ids to
    answer any query. rid is in the order of the smallest id, so ties by rid are ties by id."""
    each = rows.groupBy("cls", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"), F.first("vector").alias("vector"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))
    some = each.withColumn("place", place).filter(F.col("place") <= k + 1)
    ids = F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(vec_id, n)"))))
    whole = some.groupBy("cls").agg(F.first("vector").alias("vector"), ids.alias("ids"))
    ordered = whole.orderBy(F.col("ids")[0]).withColumn("rid", F.monotonically_increasing_id())
    return materialize(ordered.select("cls", "rid", "vector", "ids"), "classes")


def fitted(classes: DataFrame, asking: DataFrame, k: int = K) -> Hashing:
    """The hashing for so many classes, with the probes measured on a sample of the queries."""
    count = classes.count()
    bits = max(1, round(math.log2(max(count / LOAD, 2))))
    named = classes.select(F.col("rid").alias("vec_id"), "vector")
    sample = asking.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select(F.col("rid").alias("vec_id"), "vector")
    sample = materialize(sample, "sample")
    best = materialize(search(named, sample, lambda q, b: answer(q, b, k), "double", k), "exact")
    near = best.select("vec_id").distinct().join(named, "vec_id").toPandas()  # k * SAMPLE vectors at most
    near = dict(zip(near["vec_id"], near["vector"]))
    pairs = best.join(sample.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "vec_id", "vector").toPandas()
    while True:
        how = Hashing(bits, max(0, min(bits, math.ceil(math.log2(max(count / SHARD, 1))))), PROBES)
        ranks = _ranks(pairs, near, how)
        if not len(ranks):
            return Hashing(bits, how.leading, 1)
        ranks.sort()
        needed = int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1
        if needed <= PROBES:
            return Hashing(bits, how.leading, needed)
        bits = max(1, bits - 1)


def _ranks(pairs: pd.DataFrame, near: dict, how: Hashing) -> np.ndarray:
    """At which probe each neighbour is met first in any table; PROBES if in none."""
    found = []
    sizes = pairs["vector"].map(len).to_numpy()
    for size in np.unique(sizes):
        own = pairs[sizes == size]
        asked = unit(np.stack(own["vector"]).astype(np.float64))
        met = unit(np.stack([near[i] for i in own["vec_id"]]).astype(np.float64))
        best = np.full(len(own), PROBES)
        for t in range(how.tables):
            same = probed(asked, t, how) == buckets(met, t, how)[:, None]
            best = np.minimum(best, np.where(same.any(axis=1), same.argmax(axis=1), PROBES))
        found.append(best)
    return np.concatenate(found) if found else np.zeros(0, int)


def build_index(classes: DataFrame, how: Hashing) -> DataFrame:
    """rid, vector, codes: every class with its bucket in each table."""
    element = classes.schema["vector"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches, SHARD):
            codes = np.empty((len(table), how.tables), np.int64)
            for at, matrix in matrices(table, "vector"):
                units = unit(matrix.astype(np.float64))
                for t in range(how.tables):
                    codes[at, t] = buckets(units, t, how)
            offsets = pa.array(np.arange(len(table) + 1, dtype=np.int32) * how.tables)
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))
            columns = [table["rid"].combine_chunks(), table["vector"].combine_chunks(), lists]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "vector", "codes"])

    return classes.select("rid", "vector").mapInArrow(hashed, f"rid long, vector {element}, codes array<long>")


def build_probes(asking: DataFrame, how: Hashing) -> DataFrame:
    """size, t, lead, asked, vector, codes: for each query, the buckets that it probes, by table and
    leading bits."""
    element, low = asking.schema["vector"].dataType.simpleString(), how.bits - how.leading

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches, 1 << 10):
            for at, matrix in matrices(table, "vector"):
                units, part = unit(matrix.astype(np.float64)), table.take(pa.array(at)).combine_chunks()
                for t in range(how.tables):
                    code = np.sort(probed(units, t, how), axis=1)
                    lead = (code >> low).ravel()
                    owner = np.repeat(np.arange(len(at)), code.shape[1])
                    first = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1])])
                    taken = part.take(pa.array(owner[first])).combine_chunks()
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(lead)].astype(np.int32)), pa.array(code.ravel()))
                    kind = [pa.array(np.full(len(first), x, np.int32)) for x in (matrix.shape[1], t)]
                    columns = [*kind, pa.array(lead[first]), taken["rid"].combine_chunks(), taken["vector"].combine_chunks(), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["size", "t", "lead", "asked", "vector", "codes"])

    schema = f"size int, t int, lead long, asked long, vector {element}, codes array<long>"
    return asking.select("rid", "vector").mapInArrow(reach, schema)


def meet(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best k classes of a part for each query there, among those in the buckets it probes."""
    names = asked["asked"].to_numpy()
    best = Best(len(names), k, np.float64)
    if len(rows) and len(names):
        code = rows["code"].to_numpy()
        order = np.argsort(code, kind="stable")
        code, rid = code[order], rows["rid"].to_numpy()[order]
        ((at, matrix),) = matrices(rows, "vector")
        plain, norms = scaled(matrix.astype(np.float64)[order])
        units = plain / norms[:, None]
        ((_, wanted),) = matrices(asked, "vector")
        exact, lengths = scaled(wanted.astype(np.float64))
        lists = asked["codes"].combine_chunks()
        edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for q in range(len(names)):
            near = values[edges[q] : edges[q + 1]]
            lo, hi = np.searchsorted(code, near, "left"), np.searchsorted(code, near, "right")
            size = hi - lo
            found = np.arange(size.sum()) + np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size)
            if len(found) > k:
                alike = units[found] @ (exact[q] / lengths[q])
                found = found[alike >= np.partition(alike, -k)[-k] - SLACK]
            if len(found):
                best.add(q, cosines(plain[found], norms[found], exact[q], lengths[q]), rid[found])
    return pa.Table.from_batches([best.batch(names)]).drop_columns(["nth"]).rename_columns(["asked", "rid", "score"])


def candidates(index: DataFrame, probes: DataFrame, how: Hashing, k: int) -> DataFrame:
    """asked, rid, score: the best k classes that each query meets in each part of each table."""
    place = ["size", "t", "lead"]
    index = index.select("rid", "vector", F.size("vector").alias("size"), F.posexplode("codes").alias("t", "code"))
    index = index.withColumn("lead", F.shiftright("code", how.bits - how.leading))
    held = index.groupBy(*place).agg(F.count("*").alias("rows"))
    asking = probes.groupBy(*place).agg(F.count("*").alias("queries"))
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    crowded = held.join(asking, place).select(*place, parts("rows", 2 * SHARD).alias("many"), parts("queries", ASKED).alias("lots"))
    crowded = materialize(crowded.filter("many > 1 OR lots > 1"), "crowded", True)
    crowded = F.broadcast(crowded) if crowded.count() <= FEW_KEYS else crowded

    def dealt(df: DataFrame, own: str, all_of: str, by: str, names: tuple[str, str]) -> DataFrame:
        df = df.join(crowded, place, "left").fillna(1, ["many", "lots"])
        df = df.withColumn(names[0], F.pmod(F.xxhash64(by), F.col(own)).cast("int"))
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(all_of) - 1))).drop("many", "lots")

    keys = [*place, "part", "share"]
    rows = dealt(index, "many", "lots", "rid", ("part", "share")).groupBy(*keys)
    asked = dealt(probes, "lots", "many", "asked", ("share", "part")).groupBy(*keys)
    return rows.cogroup(asked).applyInArrow(lambda r, a: meet(r, a, k), "asked long, rid long, score double")


def answer(queries: pd.DataFrame, batches: Iterator[pa.RecordBatch], k: int = K) -> Iterator[pa.RecordBatch]:
    """The best rows of a partition for each query, from all of its rows."""
    ids = queries["vec_id"].to_numpy(np.int64)
    vectors = [np.asarray(v, np.float64) for v in queries["vector"]]
    sizes = np.array([len(v) for v in vectors], np.int64)
    best = Best(len(ids), k, np.float64)
    kinds = {}
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        kinds[size] = (own, *scaled(np.stack([vectors[q] for q in own])))
    for table in tables(batches, SHARD):
        row_ids = table["vec_id"].to_numpy()
        for rows, matrix in matrices(table, "vector"):
            if matrix.shape[1] not in kinds:
                continue
            own, exact, lengths = kinds[matrix.shape[1]]
            plain, norms = scaled(matrix.astype(np.float64))
            units, names = plain / norms[:, None], row_ids[rows]
            for i, q in enumerate(own):
                found = np.flatnonzero(names != ids[q])
                if len(found) > k:
                    near_by = (units @ (exact[i] / lengths[i]))[found]
                    found = found[near_by >= np.partition(near_by, -k)[-k] - SLACK]
                if len(found):
                    best.add(q, cosines(plain[found], norms[found], exact[i], lengths[i]), names[found])
    yield best.batch(ids)


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, cls of the rows that take part; cls tells vectors apart by 128 bits."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    some = vectors.filter(F.col("vec_id").isNotNull() & finite()).filter(F.exists("embedding", lambda x: x != 0))
    rows = some.select(F.col("vec_id").cast("long"), vector.alias("vector"))
    cls = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit("b"), "vector").alias("b"))
    return rows.withColumn("cls", cls)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each query row."""
    rows = materialize(taking_part(vectors), "vectors")
    asked = rows.filter(is_query(every)).withColumn("nth", F.monotonically_increasing_id())
    asked = materialize(asked.withColumnRenamed("vec_id", "query_id"), "asked")
    classes = classes_of(rows, k)
    counts = asked.groupBy("cls").agg(F.count("*").alias("queries"))
    asking = materialize(classes.join(counts, "cls").select("cls", "rid", "vector", "queries"), "asking")
    how = fitted(classes, asking, k)
    index, probes = materialize(build_index(classes, how), "index"), materialize(build_probes(asking, how), "probes")

    met = candidates(index, probes, how, k + 1).groupBy("asked", "rid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "rid")
    best = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    best = best.join(classes.select("rid", "ids"), "rid")
    best = best.groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    answers = asking.join(best, asking["rid"] == best["asked"]).select("cls", "queries", "found")

    total = asked.count()
    each = join_hot(asked.select("query_id", "nth", "cls"), materialize(answers, "answers"), "cls", "queries", total)
    members = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("low"), i.alias("id"), c["score"].alias("score")))))
    others = F.slice(F.array_sort(F.filter(members, lambda m: m["id"] != F.col("query_id"))), 1, k)
    each = materialize(each.select("query_id", "nth", others.alias("others")), "nearest")
    full = each.filter(F.size("others") == k).select("query_id", F.posexplode("others").alias("at", "o"))
    full = full.select("query_id", (F.col("at") + 1).alias("rank"), F.col("o.id").alias("vec_id"), F.col("o.score").alias("score"))

    few = each.filter(F.size("others") == k).select("nth")
    short = asked.join(few, "nth", "left_anti").select(F.col("query_id").alias("vec_id"), "vector")
    short = materialize(short, "short", True)
    if short.isEmpty():
        return full
    return full.unionByName(search(rows.drop("cls"), short, lambda q, b: answer(q, b, k), "double", k))
