"""Packing documents into training sequences of at most ``LENGTH`` tokens.

A document's tokens (its ids and an end id) are cut into pieces of LENGTH tokens and a rest.
The histogram of piece lengths has at most LENGTH entries however large the corpus is; it is
packed on the driver, the longest length first, each into the packs that are shortest so far,
as counts of equal packs (patterns). A piece then finds its place by its rank among the pieces
of its length: the slots of a length are numbered, pattern after pattern, and the piece of
rank r takes slot r. Ranks are made in ``SALTS`` parts for each length, so a length that a
third of all pieces have is ranked by many tasks.

Defined results: a null, empty or wordless text has the end id only; repeated rows and
repeated doc_ids are packed each; a null doc_id is packed as any other; an empty table gives
an empty result; other columns are left alone. Texts are encoded whole, in blocks.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, turned
from .text import pieces, rows

LENGTH, END, SALTS = 4096, 2, 64
VOCABULARY = "word_bpe_49k.json"
#: Encoded words that a Python worker keeps, and the longest of them in bytes.
KEEP, WORD = 1 << 19, 64
#: Between a letter and punctuation after it the vocabulary always starts a new token.
_JOINT = re.compile(rb"(?<=[a-z])(?=[.,!%&*$#])")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _known(path: str) -> dict[bytes, bytes]:
    return {}


def vocabulary(name: str = VOCABULARY) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(text: bytes, name: str = VOCABULARY) -> Iterator[bytes]:
    """The ids of a text as little-endian 32-bit numbers, block by block. The vocabulary
    drops white space and never joins across it, so a text's ids are those of its words one
    after the other; each distinct word is encoded once and kept."""
    path = vocabulary(name)
    known = _known(path)
    for piece in pieces(text):
        # fewer distinct words: the vocabulary is in lower case but for its special tokens
        words = (piece if b"<|" in piece else _JOINT.sub(b" ", piece.lower())).split()
        new = list(set(words).difference(known))
        if new:
            if len(known) > KEEP:
                known.clear()
                new = list(set(words))
            found = _tokenizer(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            coded = {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(new, found)}
            known.update((w, c) for w, c in coded.items() if len(w) <= WORD)
            if any(len(w) > WORD for w in new):
                yield b"".join([known[w] if w in known else coded[w] for w in words])
                continue
        yield b"".join(map(known.__getitem__, words))


_PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )
)


def cut(text: bytes, name: str, length: int, end: int) -> list[tuple[int, int, int, int]]:
    """(start, length, CRC-32 of the ids, tokens of the document) of each piece."""
    found, crc, at, start, step = [], 0, 0, 0, 4 * length
    for block in (*encode(text, name), np.asarray([end], "<u4").tobytes()):
        left = 0
        while left < len(block):
            part = block[left : left + step - (at - start)]
            crc = zlib.crc32(part, crc)
            at += len(part)
            left += len(part)
            if at - start == step:
                found.append((start // 4, length, crc))
                start, crc = at, 0
    if at > start:
        found.append((start // 4, (at - start) // 4, crc))
    return [(*piece, at // 4) for piece in found]


def cut_documents(docs: DataFrame, length: int = LENGTH, end: int = END, name: str = VOCABULARY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""

    @F.arrow_udf(_PIECE)
    def cuts(texts: pa.Array) -> pa.Array:
        turned("packing")
        offsets, columns = [0], []
        for text in rows(texts):
            found = cut(text, name, length, end)
            columns += found
            offsets.append(len(columns))
        each = np.asarray(columns, np.int64).reshape(-1, 4)
        names = ["start", "length", "ids_crc32", "doc_tokens"]
        inner = pa.StructArray.from_arrays([pa.array(each[:, i]) for i in range(4)], names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)

    return docs.select("doc_id", F.explode(cuts("text")).alias("p")).select("doc_id", "p.*")


def pack(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (the lengths in a sequence, how many such sequences) that hold just the
    histogram's pieces. A length goes into the shortest packs with room for it, as often as
    it fits, and new packs are begun when there are none."""
    room: dict[int, list] = {}  # free tokens: packs as (pattern so far, count)
    frees: list[int] = []  # heap of the keys, largest first
    done: list[tuple[tuple, int]] = []

    def put(free: int, pattern: tuple, count: int) -> None:
        if not free:
            done.append((pattern, count))
        elif free in room:
            room[free].append((pattern, count))
        else:
            room[free] = [(pattern, count)]
            heapq.heappush(frees, -free)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if frees and -frees[0] >= size:
                free = -frees[0]
                pattern, count = room[free].pop()
                if not room[free]:
                    del room[free]
                    heapq.heappop(frees)
            else:
                free, pattern, count = length, (), left
            fits = free // size
            times = min(fits, left)
            used = min(count, left // times)
            put(free - times * size, (pattern, size, times), used)
            left -= times * used
            if pattern and count > used:
                put(free, pattern, count - used)
    done += [entry for packs in room.values() for entry in packs]
    return [(_flat(pattern), count) for pattern, count in done]


def _flat(pattern: tuple) -> tuple[int, ...]:
    runs = []
    while pattern:
        pattern, size, times = pattern
        runs.append([size] * times)
    return tuple(size for run in reversed(runs) for size in run)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """A row for each place in each pattern: its length, the rank of the first piece that takes
    it, the sequence of that piece, and the offset there. Ordered by length and rank."""
    found, base = [], 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            found.append((size, count, base, offset))
            offset += size
        base += count
    table = pd.DataFrame(found, columns=["length", "count", "sequence", "offset"], dtype="int64")
    table = table.sort_values("length", kind="stable", ignore_index=True)
    table["rank"] = table.groupby("length")["count"].cumsum() - table["count"]
    return table


def pack_pieces(cuts: DataFrame, length: int = LENGTH, salts: int = SALTS) -> DataFrame:
    """cuts: a stored table with doc_id, start, length. Adds sequence_id and offset."""
    salted = cuts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).toPandas()  # length x salts rows at most
    counts = counts.sort_values(["length", "__salt"], ignore_index=True)
    places = slots(pack(counts.groupby("length")["n"].sum().to_dict(), length))
    before = counts.groupby("length")["n"].cumsum() - counts["n"]
    parts = (counts["length"] * salts + counts["__salt"]).to_numpy(np.int64)
    before = before.to_numpy(np.int64)
    span = 1 << 44  # ranks of a length stay below
    keys = (places["length"] * span + places["rank"]).to_numpy(np.int64)
    rank0, sequence, offset = (places[c].to_numpy(np.int64) for c in ("rank", "sequence", "offset"))
    held = cuts.sparkSession.sparkContext.broadcast((parts, before, keys, rank0, sequence, offset))

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(lengths: pa.Array, salt: pa.Array, nth: pa.Array) -> pa.Array:
        parts, before, keys, rank0, sequence, offset = held.value
        size, salt, nth = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, salt, nth))
        rank = before[np.searchsorted(parts, size * salts + salt)] + nth - 1
        slot = np.searchsorted(keys, size * span + rank, "right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(sequence[slot] + rank - rank0[slot]), pa.array(offset[slot])], ["sequence_id", "offset"]
        )

    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("__nth", F.row_number().over(order))
    placed = ranked.withColumn("__at", place("length", "__salt", "__nth"))
    return placed.select(*cuts.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, length: int = LENGTH, end: int = END, name: str = VOCABULARY) -> DataFrame:
    """Cuts and packs docs (doc_id, text): one row for each piece."""
    return pack_pieces(materialize(cut_documents(docs, length, end, name), "pieces"), length)
