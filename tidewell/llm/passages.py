"""Substring deduplication: passages that a document of a smaller id has, too, are cut out.

A window is ``WORDS`` consecutive words. A word goes when a window that covers it also starts in a
document with a smaller doc_id. Nearly all windows are in one document only, so a count-min sketch
goes first: each task counts its windows' cells in ``ROWS`` rows, counts up to two being
all that matters (a bit for once, a bit for twice), and the tasks' sketches are added cell by cell. A
window's count is at least overestimated, so a window with a cell below two is alone, for certain,
and isn't looked at again. A second pass groups exactly the others: an aggregation by the window's hash
finds its first document, map-side first, so that a passage of a third of all documents moves as
one row a task; a third pass joins the windows of the texts with those that have a first
document before their own. Then each text is cut once, where its windows say.

A window is told by 96 bits: two polynomials over its words' 64-bit hashes. Words are hashed
in numpy from the text's bytes, without a Python object for each. The sketch grows with the
texts' bytes, up to ``MOST`` cells a row, which bounds what is broadcast (MOST * ROWS / 8 bytes); with more
windows than that more of them are estimated repeated, and are then found to be alone exactly.

Defined results: a null text has no words; a text of fewer words than a window loses none; a
null doc_id counts as larger than any; windows that only one doc_id has stay, however often it has
them, so rows of one doc_id never cut each other; equal rows get equal results; an empty table
gives an empty result; columns with other names are ignored. Texts of any length are read whole, in
blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, materialize
from .text import pieces, rows

WORDS = 13
ROWS = 2
#: Cells of a row of the sketch: the power of two with so many bytes of text to a cell, and the bounds.
BYTES_PER_CELL, LEAST, MOST = 3, 1 << 16, 1 << 28
#: Cells of a part of the sketch that tasks exchange.
PART = 1 << 15
#: Bytes of texts that are hashed at once, and windows that are worked on at once.
BLOCK, CHUNK = 1 << 19, 1 << 18
LAST_ID = 2**63 - 1

_SEED = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int) -> np.uint64:
    """The nth multiplier."""
    return mixed(np.array([n * _SEED & (2**64 - 1)], np.uint64))[0] | _ONE


with np.errstate(over="ignore"):
    _BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))
    _POWER, _WINDOW = _odd(3), (_odd(5), _odd(7))
    _POWERS = np.multiply.accumulate(np.r_[_ONE, np.full(63, _POWER, np.uint64)])


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin, and their hashes: polynomials over their bytes."""
    b = np.frombuffer(data, np.uint8)
    word = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
    edges = np.flatnonzero(np.diff(np.r_[False, word, False].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    inside = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[0, starts[1:], len(b)]))
    power = _POWERS[inside & 63] if sizes.max() <= 64 else _long_powers(inside)
    values = np.where(word, _BYTE[b] * power, np.uint64(0))
    return starts, mixed(np.add.reduceat(values, starts) + sizes.astype(np.uint64))


def _long_powers(inside: np.ndarray) -> np.ndarray:
    blocks = np.multiply.accumulate(np.r_[_ONE, np.full(inside.max() // 64 + 1, _POWERS[63:] * _POWER)])
    return _POWERS[inside & 63] * blocks[np.maximum(inside, 0) >> 6]


def long_codes(data: bytes) -> np.ndarray:
    """The words' hashes of a long text, in pieces; of a word beyond a piece as well."""
    found = []
    for piece in pieces(data, BLOCK):
        if len(piece) <= 4 * BLOCK:
            found.append(word_codes(piece)[1])
            continue
        for word in piece.split():
            total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for at in range(0, len(word), BLOCK):
                b = np.frombuffer(word, np.uint8, min(BLOCK, len(word) - at), at)
                power = _long_powers(np.arange(len(b) + 1))
                total += (_BYTE[b] * power[:-1]).sum() * factor
                factor = factor * power[-1:]
            found.append(mixed(total + np.uint64(len(word))))
    return np.concatenate(found)


def texts_codes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, words of each row, all their hashes), a block of texts at a
    time; a longer text makes a block of its own, which is hashed in pieces."""
    held, size, first, at = [], 0, 0, -1
    for at, data in enumerate(rows(texts)):
        if len(data) > BLOCK:
            if held:
                yield (first, at, *_block(held))
            codes = long_codes(data)
            yield at, at + 1, np.array([len(codes)]), codes
            held, size, first = [], 0, at + 1
            continue
        held.append(data)
        size += len(data) + 1
        if size > BLOCK:
            yield (first, at + 1, *_block(held))
            held, size, first = [], 0, at + 1
    if held:
        yield (first, at + 1, *_block(held))


def _block(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts, codes = word_codes(b"\n".join(held))
    ends = np.cumsum([len(x) + 1 for x in held])
    return np.diff(np.searchsorted(starts, np.r_[0, ends])), codes


def windows(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, places (from 0) and two hashes of the windows of size words, some at a time."""
    for first, last, counts, codes in texts_codes(texts):
        row = np.repeat(np.arange(first, last), counts)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        for at in range(0, len(codes) - size + 1, CHUNK):
            n = min(CHUNK, len(codes) - size + 1 - at)
            whole = row[at : at + n] == row[at + size - 1 : at + size - 1 + n]
            hashes = []
            for factor in _WINDOW:
                h = codes[at : at + n].copy()
                for j in range(1, size):
                    h *= factor
                    h += codes[at + j : at + j + n]
                hashes.append(mixed(h[whole]))
            yield row[at : at + n][whole], place[at : at + n][whole], *hashes


def cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    """A window's cell in each row of the sketch; width is a power of two."""
    return [(h >> np.uint64(32 * r)) & np.uint64(width - 1) for r in range(ROWS)]


def _bits(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells as distinct bytes and the bits set in them."""
    if not len(cells):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at = cells >> np.uint64(3)
    bit = _ONE.astype(np.uint8) << (cells & np.uint64(7)).astype(np.uint8)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[new].astype(np.int64), np.bitwise_or.reduceat(bit, new)


class Sketch:
    """Counts up to two, in two bits: once for a count of at least one, twice for more."""

    def __init__(self, width: int):
        self.width = width
        self.once, self.twice = (np.zeros((ROWS, width // 8), np.uint8) for _ in range(2))

    def add(self, h: np.ndarray) -> None:
        for r, cell in enumerate(cells(h, self.width)):
            cell = np.sort(cell)
            at, bits = _bits(cell)
            self.twice[r, at] |= self.once[r, at] & bits
            self.once[r, at] |= bits
            at, bits = _bits(cell[1:][cell[1:] == cell[:-1]])
            self.twice[r, at] |= bits

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(number, once, twice) of the parts in which anything was counted."""
        size = min(PART, self.width) // 8
        for i, (once, twice) in enumerate(zip(self.once.reshape(-1, size), self.twice.reshape(-1, size))):
            if once.any():
                yield i, packed(once), packed(twice)


def packed(bits: np.ndarray) -> bytes:
    return pa.compress(bits, codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), np.uint8)


def repeated(h: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which windows have an estimate of two or more in the merged sketch."""
    may = np.ones(len(h), bool)
    for row, cell in zip(twice, cells(h, twice.shape[1] * 8)):
        may &= (row[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return may


def _counted(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width)
        for batch in batches:
            for _, _, h, _ in windows(batch["text"]):
                sketch.add(h)
        some = []
        for part in sketch.parts():
            some.append(part)
            if len(some) == 1024:
                yield _parts(some)
                some = []
        yield _parts(some)

    return task


def _parts(some: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], k) for i, k in enumerate(kinds)], ["part", "once", "twice"])


def _merged(size: int):
    """Adds the sketches of all tasks, part by part; the rows of a part follow each other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for batch in batches:
            done = []
            for part, a, b in zip(*(batch[c].to_pylist() for c in ("part", "once", "twice"))):
                a, b = unpacked(a, size), unpacked(b, size)
                if part != now:
                    if now is not None and twice.any():
                        done.append((now, b"", packed(twice)))
                    now, once, twice = part, a, b
                else:
                    once, twice = once | a, twice | b | (once & a)
            yield _parts(done)
        if now is not None and twice.any():
            yield _parts([(now, b"", packed(twice))])

    return task


def count_min(docs: DataFrame, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """The merged sketch's bits for a count of two or more, a row of bytes for each of its rows.
    Tasks read several splits each, so that there are few sketches to add."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = least
    while width < most and width * BYTES_PER_CELL < total:
        width *= 2
    size = min(PART, width) // 8
    schema = "part int, once binary, twice binary"
    each = docs.select("text").coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(_counted(width), schema)
    dealt = each.repartition("part").sortWithinPartitions("part")
    merged = materialize(dealt.mapInArrow(_merged(size), schema).select("part", "twice"), "sketch", True)
    twice = np.zeros((ROWS * width // 8 // size, size), np.uint8)
    table = merged.toArrow()  # bounded: MOST * ROWS / 8 bytes
    for part, bits in zip(table["part"].to_pylist(), table["twice"].to_pylist()):
        twice[part] = unpacked(bits, size)
    return twice.reshape(ROWS, width // 8)


def _emitted(held, columns: list[str]):
    """The windows estimated repeated: two hashes, these columns of their row, and maybe the place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = held.value
        for batch in batches:
            own = {c: batch[c].to_numpy(zero_copy_only=False) for c in columns if c != "place"}
            for row, place, h1, h2 in windows(batch["text"]):
                may = repeated(h1, twice)
                row = row[may]
                found = {"h1": h1[may].view(np.int64), "h2": (h2[may] >> np.uint64(32)).astype(np.uint32).view(np.int32)}
                found |= {c: place[may].astype(np.int32) if c == "place" else own[c][row] for c in columns}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

    return task


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, id (a null doc_id as the last), the hash that tells rows of one doc_id apart, and text."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.select("doc_id", own.alias("id"), F.xxhash64("text").alias("hash"), "text")


def first_documents(docs: DataFrame, held) -> DataFrame:
    """h1, h2 and first, the least id, of the windows that several ids have; a stored table."""
    found = docs.mapInArrow(_emitted(held, ["id"]), "h1 long, h2 int, id long")
    by = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return materialize(by.filter("first < last").drop("last"), "repeated")


def to_remove(docs: DataFrame, held, firsts: DataFrame) -> DataFrame:
    """id, hash and the places of the windows that a document before has; a stored table."""
    found = docs.mapInArrow(_emitted(held, ["id", "hash", "place"]), "h1 long, h2 int, id long, hash long, place int")
    late = found.join(firsts, ["h1", "h2"]).filter("first < id").select("id", "hash", "place")
    return materialize(late, "late")


def cut(data: bytes, places: np.ndarray | None, size: int = WORDS) -> tuple[int, int, str]:
    """Words of a text, how many of them windows at these places cover, and the hash of the rest."""
    sha, n, removed, empty = hashlib.sha256(), 0, 0, True
    starts = None if places is None else np.unique(places)
    for piece in pieces(data):
        words = piece.split()
        if starts is not None and len(words):
            # a word goes if a window begins at it or at one of the size - 1 words before
            at = np.arange(n, n + len(words))
            gone = np.searchsorted(starts, at, "right") > np.searchsorted(starts, at - size, "right")
            removed += int(gone.sum())
            kept = [words[i] for i in np.flatnonzero(~gone)]
        else:
            kept = words
        n += len(words)
        if kept:
            sha.update(b"" if empty else b" ")
            sha.update(b" ".join(kept))
            empty = False
    return n, removed, sha.hexdigest()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = batch["places"]
        found = [cut(data, p.values.to_numpy() if p.is_valid else None) for data, p in zip(rows(batch["text"]), places)]
        columns = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    spark, docs = docs.sparkSession, identified(docs)
    held = spark.sparkContext.broadcast(count_min(docs))
    freed(spark)
    firsts = first_documents(docs, held)
    freed(spark)
    late = to_remove(docs, held, firsts)
    held.unpersist()
    freed(spark)
    by = late.groupBy("id", "hash").agg(F.collect_list("place").alias("places"))
    met = docs.join(by, ["id", "hash"], "left").select("doc_id", "text", "places")
    return met.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS BIGINT), {LAST_ID}) AS id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, id, i, array_to_string(words[i : i + {WORDS - 1}], ' ') AS s
  FROM (SELECT r, id, words, unnest(range(1, len(words) - {WORDS - 2})) AS i FROM docs)),
firsts AS (SELECT s, min(id) AS first FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {WORDS})) AS p FROM windows JOIN firsts USING (s) WHERE first < id),
places AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM places ANTI JOIN gone USING (r, p) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs LEFT JOIN removed g USING (r) LEFT JOIN kept k USING (r)
"""
