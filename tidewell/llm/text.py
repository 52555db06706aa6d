"""Words of texts as bytes, in blocks of bounded size, for the operators that hash them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split into words at once.
BLOCK = 1 << 21
# where white space begins; the last bytes of white space beyond ASCII can't be before it
_SPACE = re.compile(rb"(?<=[^\x20\x09-\x0D\x80-\x8a\x9f\xa0\xa8\xa9\xaf])[\x20\x09-\x0D]")


def rows(array: pa.Array, some: int = 256) -> Iterator[bytes]:
    """The values of a string array as bytes, a few at a time; null as empty."""
    for i in range(0, len(array), some):
        for value in array.slice(i, some).cast(pa.binary()).to_pylist():
            yield value or b""


def pieces(data: bytes, limit: int = BLOCK) -> Iterator[bytes]:
    """data cut where white space begins into pieces of about limit bytes; a longer word
    stays whole."""
    at = 0
    while len(data) - at > limit:
        found = _SPACE.search(data, at + limit)
        if found is None:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:] if at else data
