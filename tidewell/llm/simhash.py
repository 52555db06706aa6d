"""SimHash near-duplicates: fingerprints, a trie self-join over them, and their groups.

A text's fingerprint has bit b set where more than half of its shingles' hashes have it.
Two fingerprints link when they differ in at most ``BITS`` bits, and the connected groups are
the near-duplicates.

The self-join walks a binary trie of the distinct fingerprints in pairs of nodes that start
as (root, root): a pair's children are the pairs of its nodes' children, each with the
differing bits so far, and a pair beyond the budget of ``BITS`` errors is dropped with all
below it. So that the work can be dealt out, the bits are cut into blocks: two fingerprints
within the budget agree in all but BITS blocks at least, so for each choice of those blocks
there is one trie, with these blocks on top and no error allowed there. What hangs below one
value of them is a node pair that one task walks. The more distinct fingerprints there are,
the more blocks are cut, so that more bits agree; links are the same. Node pairs with
more than ``GROUP`` rows go down further levels as Spark joins first, however many they
hold. A task returns links that span each connected group instead of all of a group's pairs.

Defined results: a null, empty or wordless text has fingerprint zero, and all of these
link; repeated rows get the same group; a null doc_id takes no part in the least id of a
group; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nearcopies
from .common import freed, join_hot, join_keys, materialize, wrapped
from .text import pieces, rows

SHINGLE, SEED = 3, 42
BITS, GROUP = 3, 4096
#: Rows of a node pair on average, when the number of blocks is chosen.
SPARSE = 256
#: Bits of a level where Spark walks down a large node pair.
STRIDE = 8
#: Rows of small node pairs that are walked at once.
TOGETHER = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, as an unsigned integer."""
    ones, total, tail, words_all = np.zeros(64, np.int64), 0, [], 0
    for piece in pieces(text):
        words = tail + piece.lower().split()
        words_all += len(words) - len(tail)
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            n = len(words) - shingle + 1
            h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", n)
            for at in range(0, n, 1 << 16):
                bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int32)
            total += n
            words = words[-(shingle - 1) :] if shingle > 1 else []
        tail = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if words_all else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.fromiter(map(fingerprint, rows(texts)), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("__fp", _fingerprints(F.col(text)))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def enough_blocks(count: int, bits: int = BITS) -> int:
    """The fewest blocks of which those that agree tell so many fingerprints apart."""
    blocks = bits + 1
    while blocks < 64 and count > SPARSE << ((blocks - bits) * (64 // blocks)):
        blocks += 1
    return blocks


def _orders(blocks: int, bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each trie: the number of bits that must agree, and the blocks in its order, each as
    (lowest bit, width)."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in itertools.pairwise(edges)]
    found = []
    for top in itertools.combinations(range(blocks), blocks - bits):
        order = [spans[i] for i in top] + [spans[i] for i in range(blocks) if i not in top]
        found.append((sum(spans[i][1] for i in top), order))
    return found


def _gather(fp: Column, spans: list[tuple[int, int]]) -> Column:
    """The bits of these blocks, one block after the other, as a number."""
    out = F.lit(0).cast("long")
    for low, width in spans:
        part = F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)
        out = F.shiftleft(out, width).bitwiseOR(part)
    return out


def _roots(distinct: DataFrame, bits: int, blocks: int) -> DataFrame:
    """One row for each fingerprint and trie: the node below the agreeing bits."""
    tries = []
    for k, (agree, order) in enumerate(_orders(blocks, bits)):
        top = blocks - bits
        node = F.concat(F.lit(f"{k:x}:"), F.hex(_gather(F.col("__fp"), order[:top])))
        rest = _gather(F.col("__fp"), order[top:])
        depth = 64 - agree
        tries.append(F.struct(node.alias("node"), rest.alias("rest"), F.lit(depth).alias("left")))
    return distinct.select(F.explode(F.array(*tries)).alias("t"), "__fp").select(
        "t.node", F.lit(0).alias("side"), F.lit(True).alias("own"), F.lit(0).alias("diff"), "t.rest", "t.left", "__fp"
    )


def _descend(pairs: DataFrame, bits: int) -> DataFrame:
    """The children of large node pairs, STRIDE levels down. A pair of a node with itself
    (own) has one side; of others, side 0 meets side 1."""
    under = F.greatest(F.col("left") - STRIDE, F.lit(0))
    split = pairs.withColumn("left", under).withColumn("value", F.expr("shiftrightunsigned(rest, `left`)"))
    split = split.withColumn("rest", F.expr("rest & (shiftleft(1L, `left`) - 1)"))
    there = split.groupBy("node", F.col("side").alias("met")).agg(F.collect_set("value").alias("values"))
    met = split.withColumn("met", F.when(F.col("own"), F.lit(0)).otherwise(1 - F.col("side"))).join(there, ["node", "met"])
    errors = lambda v: F.bit_count(F.col("value").bitwiseXOR(v))
    close = F.filter("values", lambda v: F.col("diff") + errors(v) <= bits)
    each = met.withColumn("other", F.explode(close))
    mine_first = F.when(F.col("own"), F.col("value") <= F.col("other")).otherwise(F.col("side") == 0)
    first = F.when(mine_first, F.col("value")).otherwise(F.col("other"))
    second = F.when(mine_first, F.col("other")).otherwise(F.col("value"))
    return each.select(
        F.concat_ws("/", "node", F.concat(F.hex(first), F.lit("-"), F.hex(second))).alias("node"),
        F.when(mine_first, 0).otherwise(1).alias("side"),
        (F.col("own") & (F.col("value") == F.col("other"))).alias("own"),
        (F.col("diff") + errors(F.col("other"))).cast("int").alias("diff"),
        "rest",
        "left",
        "__fp",
    )


def links(distinct: DataFrame, bits: int = BITS, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column __fp) that connect exactly those
    groups which all pairs within the budget connect. blocks None: as many as their number needs."""
    blocks = blocks or enough_blocks(distinct.count(), bits)
    pairs, done = _roots(distinct, bits, blocks), []
    while True:
        sizes = pairs.groupBy("node").agg(F.count("*").alias("rows")).filter(F.col("rows") > group)
        if sizes.isEmpty():
            done.append(pairs)
            break
        large = materialize(sizes.select("node"), "large", True)
        done.append(pairs.join(large, "node", "left_anti"))
        pairs = materialize(_descend(pairs.join(large, "node", "left_semi"), bits), "pairs")
    found = None
    for part in done:
        dealt = part.repartition("node").sortWithinPartitions("node")
        linked = dealt.mapInArrow(lambda batches: _walk(batches, bits), "a long, b long")
        found = linked if found is None else found.unionByName(linked)
    return found


def _walk(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Walks the node pairs of a partition, which come one after the other."""
    held: list[pa.Table] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) < TOGETHER:
                continue
        if not held:
            continue
        table = pa.concat_tables(held).combine_chunks()
        node = table["node"].combine_chunks()
        whole = len(table)
        if batch is not None:  # the last node may go on in the next batch
            last = node[-1].as_py()
            whole = int(np.argmax(pc.equal(node, last).to_numpy(zero_copy_only=False)))
        held = [table.slice(whole)] if whole < len(table) else []
        at = 0
        codes = node.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        while at < whole:
            i = np.searchsorted(starts, at + TOGETHER, "right") - 1
            end = whole if at + TOGETHER >= whole else int(starts[i]) if starts[i] > at else int(np.r_[starts, whole][np.searchsorted(starts, at, "right")])
            part = {c: table[c].slice(at, end - at).to_numpy() for c in ("side", "own", "diff", "rest", "left", "__fp")}
            a, b = trie_join(codes[at:end], **{k.strip("_"): v for k, v in part.items()}, bits=bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            at = end


def trie_join(codes, side, own, diff, rest, left, fp, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks the binary tries of several node pairs (codes) at once, a bit a step. Nodes are
    ranges of the sorted rows. Returns links that span the groups."""
    order = np.lexsort((rest, side, codes))
    codes, side, own, diff, rest, left, fp = (x[order] for x in (codes, side, own, diff, rest, left, fp))
    n = len(codes)
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (side[1:] != side[:-1])])
    last = np.r_[first[1:], n]
    alone, lone = own[first], side[first] == 0
    paired = np.flatnonzero(~alone & lone & (np.r_[codes[first][1:], -1] == codes[first]))
    # (range of a, range of b, errors so far); a node paired with itself has equal ranges
    lo = np.r_[first[alone], first[paired]]
    hi = np.r_[last[alone], last[paired]]
    lo2 = np.r_[first[alone], first[paired + 1] if len(paired) else paired]
    hi2 = np.r_[last[alone], last[paired + 1] if len(paired) else paired]
    err = np.r_[diff[first[alone]], diff[first[paired]]].astype(np.int64)
    level = int(left.max(initial=0))
    label = np.arange(n)
    while len(lo):
        same = lo == lo2
        size = (hi - lo) * (hi2 - lo2)
        small = (size <= 16) | (level == 0)
        _compare(lo[small], hi[small], lo2[small], hi2[small], err[small], same[small], rest, level, bits, label)
        keep = ~small
        lo, hi, lo2, hi2, err, same = (x[keep] for x in (lo, hi, lo2, hi2, err, same))
        if not len(lo):
            break
        level -= 1
        ones = np.r_[0, np.cumsum((rest >> level) & 1)]
        mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
        other = ~same
        new = [
            (lo, mid, lo2, mid2, err),
            (mid, hi, mid2, hi2, err),
            (lo, mid, mid2, hi2, err + 1),
            (mid[other], hi[other], lo2[other], mid2[other], err[other] + 1),
        ]
        lo, hi, lo2, hi2, err = (np.concatenate(x) for x in zip(*new))
        keep = (err <= bits) & (hi > lo) & (hi2 > lo2) & ((lo != lo2) | (hi - lo > 1))
        lo, hi, lo2, hi2, err = (x[keep] for x in (lo, hi, lo2, hi2, err))
    tied = np.flatnonzero(label != np.arange(n))
    a, b = fp[tied], fp[label[tied]]
    return a, b


def _compare(lo, hi, lo2, hi2, err, same, rest, level, bits, label) -> None:
    """All pairs below small node pairs; those within the budget share a label from then on."""
    for at in range(0, len(lo), 1 << 16):
        s = slice(at, at + (1 << 16))
        size = (hi[s] - lo[s]) * (hi2[s] - lo2[s])
        pair = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        wide = (hi2[s] - lo2[s])[pair]
        i, j = lo[s][pair] + place // wide, lo2[s][pair] + place % wide
        mask = (1 << level) - 1
        far = np.bitwise_count((rest[i] ^ rest[j]) & mask)
        ok = (err[s][pair] + far <= bits) & (~same[s][pair] | (i < j))
        _union(label, i[ok], j[ok])


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j; labels are the least index of a group."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def groups(edges: DataFrame) -> DataFrame:
    """Connected groups of links (a, b), as (fp, root) for all linked ones, the least being
    its root. Every link hangs from its least neighbour, by turns over all neighbours and over
    the lesser ones, until nothing changes; each turn is written to the shared folder."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    state = materialize(edges.select(a.alias("u"), b.alias("v")).filter("u <> v").distinct(), "links", True)
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mark_of = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        each = both.groupBy("u").agg(F.count("*").alias("n"), mark_of.alias("mark"))
        now = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("mark"), F.lit(0)), F.max("n")).first()
        if now == mark or not now[0]:
            return state.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        mark = now
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        wide = join_hot(both.filter("v > u"), least, "u", "n", now[0], now[2])
        state = materialize(wide.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links", True)
        least = state.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # none has more lesser neighbours now than it had neighbours
        near = join_hot(state, least, "u", "n", now[0] // 2, now[2]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        top = least.select("u", F.col("m").alias("v"))
        state = materialize(near.unionByName(top).filter("u <> v").distinct(), "links", True)


def components(prints: DataFrame, bits: int = BITS, blocks: int | None = None, group: int = GROUP, edges: DataFrame | None = None) -> DataFrame:
    """prints: a stored table with __fp and __key, what a group is named by (null comes
    last). Adds __group, the least key of each row's group. edges: checked links of what __fp names,
    instead of all links within the budget of bits."""
    distinct = materialize(prints.groupBy("__fp").agg(F.min("__key").alias("least"), F.count("*").alias("n")), "prints", True)
    total, most = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    roots = groups(links(distinct.select("__fp"), bits, blocks, group) if edges is None else edges)
    own = roots.select(F.col("root").alias("fp"), "root").distinct()
    tied = materialize(
        roots.unionByName(own).join(distinct, F.col("fp") == F.col("__fp")).select("__fp", "root", "least"), "tied", True
    )
    least = tied.groupBy("root").agg(F.min("least").alias("__group"), F.count("*").alias("n"))
    named = join_hot(tied.select("__fp", "root"), least, "root", "n", total).select("__fp", "__group")
    every = distinct.join(named, "__fp", "left").select(
        "__fp", F.coalesce("__group", "least").alias("__group"), "n"
    )
    return join_hot(prints, every, "__fp", "n", total, most)


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id."""
    prints = with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "__fp", F.col("doc_id").alias("__key"))
    found = components(materialize(prints, "fingerprints"), bits)
    return found.select("doc_id", hex_fingerprint(F.col("__fp")).alias("fingerprint"), F.col("__group").alias("component_id"))


def candidates(prints: DataFrame) -> DataFrame:
    """prints: a stored table of the distinct pairs of __fp, a set, and __print, a fingerprint of a text
    that has it. Returns pairs (a, b) of sets whose fingerprints are equal or linked by the trie."""
    met = materialize(prints.groupBy("__print").agg(F.min("__fp").alias("set")), "met", True)
    alike = links(met.select(F.col("__print").alias("__fp")))
    ends = alike.join(met.select(F.col("__print").alias("a"), F.col("set").alias("x")), "a")
    ends = ends.join(met.select(F.col("__print").alias("b"), F.col("set").alias("y")), "b").select("x", "y")
    equal = prints.join(met, "__print").select(F.col("__fp").alias("x"), F.col("set").alias("y"))
    both = ends.unionByName(equal).filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that of the least doc_id (of equal ones, any one).
    The fingerprints' trie gives candidates; an exact check of their five-word shingles follows, with a
    similarity of 0.8 or more, and nearcopies, which states the results for odd rows, finds those
    that differ in more bits."""
    row = F.monotonically_increasing_id()
    marked = wrapped(docs, "doc_id", "text").withColumn("__sketch", nearcopies.sketch("text"))
    marked = marked.withColumn("__print", _fingerprints(F.col("text"))).withColumn("__row", row)
    parts = [F.col(f"__sketch.{c}").alias(f"__{c}") for c in ("fp", "n", "least", "bands")]
    stored = materialize(marked.select("row", "doc_id", "__row", "__print", *parts), "documents")
    # one row for each set
    one = materialize(stored.groupBy("__fp").agg(F.min("__row").alias("__row")).select("__row"), "one", True)
    sets = join_keys(stored, one, "__row", "left_semi").select(F.col("__fp").alias("fp"), F.col("__n").alias("n"), F.col("__least").alias("least"), F.col("__bands").alias("bands"), "__row")
    prints = materialize(stored.filter("__n > 0").select("__fp", "__print").distinct(), "prints", True)
    texts = stored.select("__row", F.col("row.text").alias("text"))
    edges = nearcopies.links(materialize(sets, "sets"), texts, groups, candidates(prints))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    freed(docs.sparkSession)
    grouped = components(stored.select("__fp", "__row", key.alias("__key")), edges=edges)
    dropped = materialize(grouped.filter(F.col("__row") != F.col("__group.row")).select("__row"), "dropped", True)
    return join_keys(stored, dropped, "__row", "left_anti").select("row.*")
