"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more, and what they connect.

Candidates come from SimHash, whose trie links fingerprints within 3 bits (see simhash), and, as such
copies often differ in more bits, from MinHash: ``BANDS`` bands of ``ROWS`` minima; two sets meet where a band
agrees, so a pair at the limit is missed with a probability of (1 - 0.8 ** ROWS) ** BANDS, 5e-5,
and closer ones with less. (A wider SimHash budget can't do this: such pairs differ in up to 12 of 64
bits or more, and then no block of bits is long enough to part the rest.) Each candidate
pair's similarity is then computed from the whole sets; it decides.

Sets that are equal are one from the start. In each bucket all are first compared with its
least; what that connects needs no comparison with each other, so only pairs of a bucket that
are of different groups may be compared then. Exact bounds spare most of these: a set can have
no more in common with one of another group than those of its shingles that several groups
have; and of a set that both were compared with (the bucket's central one, which has the largest
part of such shingles), they have in common what neither lacks at most, and beside it what both
have of shared shingles. A pair within the bounds is compared in the first bucket that it shares, and only
if so many of the minima agree (in a byte of each) that the two may be alike: ``AGREE`` of 125,
which an alike pair misses with a probability of 2e-6. Buckets of more than ``BLOCK`` sets are compared block by
block, so that no task has more than two blocks' pairs.

The bounds leave no alike pair out. How many pairs they leave depends on the data: copies whose changes
are their own leave few, but copies that share nearly all changes with some others, in ever new
combinations, and are unlike all the same, leave as many as the square of their number.

Words are runs of anything but ASCII white space, A-Z as a-z. A text of one to four words has
all of them as its only shingle; one without words has none and equals its like.

Defined results: a null text is one without words, as an empty one is, and all such rows are one
group. Repeated rows and rows of equal texts, whatever their doc_ids, are one set and one group. Very
long texts are read whole, piece by piece. Rows with a null doc_id take part and come after
all others where a group's least is chosen; among rows of one doc_id any one stays. Other columns are carried
along whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, join_hot, join_keys, materialize, turned
from .text import pieces, rows

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS, BLOCK = 25, 5, 2000
#: Minima that an alike pair has in common; 100 are expected at the limit, with a deviation of 4.5.
AGREE = 78
#: Pairs that one copy of a set is joined with.
PAIRS = 1000

_DRAW = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS = _DRAW[0] * np.uint64(2) + np.uint64(1), _DRAW[1]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    found, tail = [], []
    for piece in pieces(text):
        words = tail + piece.lower().split()
        if len(words) >= size:
            grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
            found.append(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", len(words) - size + 1))
            words = words[-(size - 1) :] if size > 1 else []
        tail = words
    if not found and tail:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], "<u8"))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, "<u8")


def least(hashes: np.ndarray) -> np.ndarray:
    """The minima of a set; none of an empty one."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    found = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(found, (hashes[at : at + (1 << 12), None] * _TIMES + _PLUS).min(axis=0), out=found)
    return found


def bands(minima: np.ndarray) -> np.ndarray:
    """The keys of a set's buckets: one for each band of its minima."""
    rows = minima.reshape(-1, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64)


def _lists(found: list) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
    values = np.concatenate(found or [np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(f"i{values.itemsize}")))


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("least", T.ArrayType(T.ByteType())), T.StructField("bands", T.ArrayType(T.LongType()))]))
def sketch(texts: pa.Array) -> pa.Array:
    """A set's own hash, its size, a byte of each of its minima and the keys of its buckets."""
    turned("nearcopies")
    prints, sizes, minima, keys = [], [], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)]
    for text in rows(texts):
        found = shingles(text)
        prints.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0)
        sizes.append(len(found))
        own = least(found)
        minima.append((own >> np.uint64(32)).astype(np.uint8))
        keys.append(bands(own))
    fp = pa.array(np.array(prints, np.uint64).view(np.int64))
    return pa.StructArray.from_arrays([fp, pa.array(sizes, pa.int64()), _lists(minima).slice(1), _lists(keys).slice(1)], ["fp", "n", "least", "bands"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(texts: pa.Array) -> pa.Array:
    return _lists([shingles(text) for text in rows(texts)])


def _alike(a: Column, b: Column, both: Column | None = None) -> Column:
    """Whether sets of these sizes, with so many in both, reach the limit; or can reach it."""
    both = F.least(a, b) if both is None else both
    return UNDER * both >= OVER * (a + b - both)


def _weights(made: DataFrame, weight: str) -> tuple[int, int]:
    """The sum and the largest of a stored table's column, for join_hot()."""
    return tuple(made.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first())


def _dealt(pairs: DataFrame, key: str, sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """pairs with a column that deals out those of one set, and the sets of the column key with it, as
    name. A set with many pairs is copied for each PAIRS."""
    part = f"{key}_part"
    counts = pairs.groupBy(key).agg(F.count("*").alias("w")).withColumn("parts", F.ceil(F.col("w") / PAIRS))
    counts = materialize(counts, "counts", True)
    dealt = join_hot(pairs, counts, key, "w", *_weights(counts, "w"))
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64("a", "b"), F.col("parts"))).drop("parts")
    copies = sets.withColumnRenamed("fp", key).join(counts, key)
    return dealt, copies.select(key, F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(part))


def _full(ids: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """ids, which has a row for each fp, with the sets' shingles, stored. sets: fp, __row; texts: __row, text."""
    ids = materialize(ids.join(sets.select("fp", "__row"), "fp"), "compared", True)
    found = join_keys(texts, ids, "__row", "inner").withColumn("shingles", _sets("text"))
    return materialize(found.drop("__row", "text"), "shingles")


def _met(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The stored pairs (a, b), with how many shingles are common and whether they are as alike as asked
    for. full: fp, shingles, stored."""
    full = full.select("fp", "shingles")
    # dealt for both sets before either joins, so that no pair meets a set more than once
    dealt, xs = _dealt(pairs, "a", full, "x")
    dealt, ys = _dealt(dealt, "b", full, "y")
    both = dealt.join(xs, ["a", "a_part"]).join(ys, ["b", "b_part"])
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.select(*pairs.columns, "common", _alike(F.size("x"), F.size("y"), F.col("common")).alias("alike"))


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) that are as similar as asked for."""
    found = materialize(_met(pairs, full).filter("alike").select("a", "b"), "alike", True)
    freed(pairs.sparkSession)  # the plans of a turn are as large as the driver's other objects
    return found


def _mixed(rest: DataFrame) -> DataFrame:
    """The rows of a stored table whose bucket (key) has several groups (root)."""
    mixed = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("w"))
    mixed = materialize(mixed.filter("low <> high").select("key", "w"), "mixed", True)
    return join_hot(rest, mixed, "key", "w", *_weights(mixed, "w"))


def _own(full: DataFrame) -> DataFrame:
    """For each fp of a stored table of fp, root and shingles that has any, how many of its shingles no
    other group (root) has: own; and how many of these no other set has: alone."""
    each = full.select("fp", "root", F.explode("shingles").alias("s"))
    own = each.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("w"))
    own = materialize(own.filter("low = high").select("s", "w", (F.col("w") == 1).alias("one")), "own")
    met = join_hot(each.select("fp", "s"), own, "s", "w", *_weights(own, "w"))
    return met.groupBy("fp").agg(F.count("*").alias("own"), F.count_if("one").alias("alone"))


def _possible(rest: DataFrame) -> DataFrame:
    """The rows of a stored table that may be alike with any of their bucket, and the bucket has several
    groups then. A set's shared shingles are the most that one of another group can have of it, so
    that one has (OVER + UNDER) / OVER times as many less its size at most: room, in parts of OVER."""
    room = (OVER + UNDER) * F.col("shared") - OVER * F.col("n")
    ends = rest.groupBy("key").agg(F.min("n").alias("least_n"), F.max(room).alias("most_room"), F.count("*").alias("w"))
    ends = materialize(ends, "ends", True)
    rest = join_hot(rest, ends, "key", "w", *_weights(ends, "w"))
    rest = rest.filter((room >= OVER * F.col("least_n")) & (OVER * F.col("n") <= F.col("most_room")))
    return _mixed(materialize(rest.drop("least_n", "most_room"), "ended"))


def _rooted(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """rest with the root of each fp, itself where it is linked with none."""
    tied = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    return rest.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _central(rest: DataFrame) -> DataFrame:
    """The rows of a stored table with the set of their bucket that shares the largest part of itself: c, a struct."""
    most = F.max(F.struct((F.col("shared") / F.col("n")).alias("part"), "fp", "n", "own", "root")).alias("c")
    best = materialize(rest.groupBy("key").agg(most, F.count("*").alias("w")), "central", True)
    return join_hot(rest, best, "key", "w", *_weights(best, "w"))


def _against(rest: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of _central(), stored, with how many of c's shingles they lack and how many they have
    beside c that other groups may have, too (beyond). met: fp, other, common for all but c itself."""
    met = rest.withColumn("other", F.col("c.fp")).join(met, ["fp", "other"], "left").drop("other")
    met = met.withColumn("common", F.coalesce("common", "n"))
    # none of a set's own is c's, unless they are of one group; those of a set alone never are
    own = F.when(F.col("root") != F.col("c.root"), F.col("own")).otherwise(F.greatest(F.col("alone"), F.col("own") - F.col("c.own")))
    beyond = F.when(F.col("fp") == F.col("c.fp"), 0).otherwise(F.col("n") - F.col("common") - own)
    return met.select("key", "band", "size", "fp", "n", "shared", F.col("c.n").alias("c_n"), (F.col("c.n") - F.col("common")).alias("lacks"), beyond.alias("beyond"))


def links(sets: DataFrame, texts: DataFrame, groups, more: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all pairs of alike sets connect. sets: fp, n, least,
    bands, __row, one row for each set, and texts: __row, text, stored tables; groups gives (fp, root)
    of links; more: candidates (a, b) found otherwise, which are compared first."""
    filled = sets.filter("n > 0")
    every = filled.select(F.posexplode("bands").alias("band", "key"), "fp", "n")
    buckets = every.groupBy("key").agg(F.count("*").alias("size"), F.min("fp").alias("first"), F.min_by("n", "fp").alias("first_n"))
    buckets = materialize(buckets.filter("size > 1"), "buckets", True)
    members = buckets.select("key", "size", "first", "first_n").withColumn("w", F.col("size"))
    members = materialize(join_hot(every, members, "key", "w", *_weights(buckets, "size")), "members")
    near = members.filter(F.col("fp") != F.col("first")).filter(_alike(F.col("n"), F.col("first_n")))
    near = near.select(F.col("first").alias("a"), F.col("fp").alias("b")).unionByName(more.select("a", "b"))
    near = materialize(near.distinct(), "candidates", True)
    ends = near.select(F.col("a").alias("fp")).unionByName(near.select(F.col("b").alias("fp"))).distinct()
    found = _verified(near, _full(ends, sets, texts))

    roots = groups(found)
    rest = members.filter((F.col("size") > 2) & (F.col("fp") != F.col("first"))).select("key", "band", "size", "fp", "n")
    rest = materialize(_mixed(materialize(_rooted(rest, roots), "rest")), "met")
    full = _full(rest.select("fp", "root").distinct(), sets, texts)
    rest = rest.join(_own(full), "fp", "left").fillna(0, ["own", "alone"]).withColumn("shared", F.col("n") - F.col("own"))
    rest = materialize(_possible(materialize(rest, "shared")), "possible")
    rest = materialize(_central(rest), "against")
    near = rest.filter("fp <> c.fp").select(F.col("c.fp").alias("a"), F.col("fp").alias("b"), (F.col("root") != F.col("c.root")).alias("new"))
    met = materialize(_met(materialize(near.distinct(), "candidates", True), full), "met", True)
    rest = _against(rest, met.select(F.col("b").alias("fp"), F.col("a").alias("other"), "common"))
    freed(sets.sparkSession)
    found = met.filter("alike AND new").select("a", "b")
    roots = groups(roots.select(F.col("root").alias("a"), F.col("fp").alias("b")).unionByName(found))
    rest = _mixed(materialize(_rooted(rest, roots), "rest"))
    rest = rest.join(filled.select("fp", "least", F.transform("bands", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("bands")), "fp")
    # each pair of blocks once; a block meets itself, too
    blocks = F.ceil(F.col("size") / BLOCK)
    rest = rest.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = rest.select("key", "band", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "fp", "n", "shared", "c_n", "lacks", "beyond", "root", "least", "bands")
    a, b = rest.alias("a"), rest.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "low", "high")]
    once = ((F.col("a.low") == F.col("a.high")) & (F.col("a.fp") < F.col("b.fp"))) | (F.col("a.mine") < F.col("b.mine"))
    equal = lambda c: F.zip_with(f"a.{c}", f"b.{c}", lambda x, y: x == y)
    may = F.size(F.filter(equal("least"), lambda x: x)) >= AGREE
    first = F.array_position(equal("bands"), True) - 1
    # what two sets of different groups have in common at most
    through = F.col("a.c_n") - F.greatest("a.lacks", "b.lacks") + F.least("a.beyond", "b.beyond")
    alike = _alike(F.col("a.n"), F.col("b.n"), F.least("a.shared", "b.shared", through))
    pairs = a.join(b, [*same, once, F.col("a.root") != F.col("b.root"), alike, may, F.col("a.band") == first])
    pairs = pairs.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()
    found = _verified(materialize(pairs, "candidates", True), full)
    return roots.select(F.col("root").alias("a"), F.col("fp").alias("b")).unionByName(found)
