"""Token counts of sections or fields, from one encoding of the whole text.

A document is encoded once, as it is trained on; encoding its sections alone would give other
tokens at their edges. The vocabulary is a byte-level one, so a token's span in the text follows
from the lengths of the tokens before it. Token spans are then joined with the sections'
spans (both are in order: a binary search). A token within one section counts there. One that
crosses a boundary counts whole where most of its bytes lie, and among equals in the first;
so a document's sections always add up to its tokens.

Defined results: a null or empty text has one empty section without tokens; a null field is
an empty one; repeated rows are counted each; an empty table gives an empty result; other
columns are left alone. Whole texts are encoded, in blocks that end where tokens do.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import pieces, rows

VOCABULARY = "byte_bpe_50k.json"
#: Words whose tokens a Python worker keeps, and the longest of them in bytes.
KEEP, WORD = 1_000_000, 64
# A single space before a word starts a new token. Where white space comes in runs, only
# the last space before a word does.
_RUN = re.compile(rb"\s[ ]| \s")
_SPLIT = re.compile(rb"(?<=\S)(?= \S)")
# White space beyond ASCII; pieces with any are encoded without splitting them into words.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


@cache
def _sizes(path: str) -> np.ndarray:
    """The number of bytes of each token: a byte-level vocabulary spells a byte as one character.
    A longer token than a byte can count would shift all spans after it, so it is an error."""
    words = _tokenizer(path).get_vocab()
    longest = max(words, key=len)
    if len(longest) > 255:
        raise ValueError(f"a token of {len(longest)} bytes: spans are counted in one byte")
    sizes = np.zeros(max(words.values()) + 1, np.uint8)
    for word, i in words.items():
        sizes[i] = len(word)
    return sizes


@cache
def _known(path: str) -> dict[bytes, bytes]:
    return {}


def token_bytes(text: bytes, name: str = VOCABULARY) -> np.ndarray:
    """The length in bytes of each token of a text. Distinct words are encoded once and kept."""
    path = vocabulary(name)
    known, sizes, found = _known(path), _sizes(path), []
    for piece in pieces(text):
        if not piece.isascii() and _WIDE.search(piece):
            words = [piece]
        elif _RUN.search(piece):
            words = _SPLIT.split(piece)
        else:
            first, *rest = piece.split(b" ")
            words = [first, *[b" " + w for w in rest]]
        new = list(set(words).difference(known))
        if new:
            if len(known) > KEEP:
                known.clear()
                new = list(set(words))
            codes = _tokenizer(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            coded = {w: sizes[e.ids].tobytes() if e.ids else b"" for w, e in zip(new, codes)}
            known.update((w, c) for w, c in coded.items() if len(w) <= WORD)
            found.append(b"".join([known[w] if w in known else coded[w] for w in words]))
        else:
            found.append(b"".join(map(known.__getitem__, words)))
    return np.frombuffer(b"".join(found), np.uint8)


def attribute(ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and those of them that cross a boundary. ends: where the sections
    end, in bytes; sizes: the tokens' lengths."""
    to = np.cumsum(sizes, dtype=np.int64)
    at = to - sizes
    first = np.searchsorted(ends, at, "right")
    last = np.searchsorted(ends, to - 1, "right")
    crossing = np.flatnonzero(first != last)
    for i in crossing:  # few: a token at a boundary
        inner = np.r_[at[i], ends[first[i] : last[i]], to[i]]
        first[i] += int(np.argmax(np.diff(inner)))
    n = len(ends)
    return np.bincount(first, minlength=n)[:n], np.bincount(first[crossing], minlength=n)[:n]


def line_ends(text: bytes) -> np.ndarray:
    """Where the lines of a text end; a line keeps its line feed."""
    found = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return found if len(found) and found[-1] == len(text) else np.r_[found, len(text)]


_SECTION = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType()) for c in ("section", "start", "bytes", "tokens", "crossing")])
)


def _sections(text: Column, lengths: Column, name: str) -> Column:
    """lengths: the bytes of each section, or null for lines."""

    @F.arrow_udf(_SECTION)
    def count(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        offsets, columns = [0], [[] for _ in range(5)]
        own = iter(lengths.to_pylist())
        for value in rows(texts):
            given = next(own)
            ends = line_ends(value) if given is None else np.cumsum(np.asarray(given, np.int64))
            tokens, crossing = attribute(ends, token_bytes(value, name))
            start = np.r_[0, ends[:-1]]
            for column, part in zip(columns, (np.arange(len(ends)), start, ends - start, tokens, crossing)):
                column.append(part.astype(np.int64))
            offsets.append(offsets[-1] + len(ends))
        names = [f.name for f in _SECTION.elementType]
        arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names))

    return count(text, lengths)


def count_lines(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, section (a line, from 0), start, bytes, tokens, crossing."""
    each = _sections(F.col("text"), F.lit(None).cast("array<long>"), name)
    return docs.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")


def count_fields(table: DataFrame, key: str, fields: list[str], between: str = "\n", name: str = VOCABULARY) -> DataFrame:
    """The same of the fields of a record that is encoded as one text, each field but the last
    followed by a separator that counts as its own. section is the field's name."""
    parts = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(between if i < len(fields) - 1 else "")) for i, c in enumerate(fields)]
    each = _sections(F.concat(*parts), F.array(*[F.octet_length(p).cast("long") for p in parts]), name)
    names = F.array(*[F.lit(c) for c in fields])
    found = table.select(F.col(key), F.explode(each).alias("s"))
    return found.select(key, F.element_at(names, (F.col("s.section") + 1).cast("int")).alias("section"), "s.start", "s.bytes", "s.tokens", "s.crossing")
