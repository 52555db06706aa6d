import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import passages


def brute(rows):
    """rows: (doc_id, text), by the words themselves."""
    firsts, out = {}, []
    key = lambda i: 2**63 - 1 if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for at in range(len(words) - 12):
            w = tuple(words[at : at + 13])
            firsts[w] = min(firsts.get(w, key(i)), key(i))
    for i, words in split:
        gone = set()
        for at in range(len(words) - 12):
            if firsts[tuple(words[at : at + 13])] < key(i):
                gone.update(range(at, at + 13))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(n, seed, kinds=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def corpus():
    shared = [" ".join(words(60, s)) for s in range(3)]
    rows = []
    for i in range(120):
        own = words(40 + i, 100 + i)
        text = " ".join(own[:20]) + "  " + (shared[i % 3] if i % 4 else "") + "\n\t" + " ".join(own[20:])
        rows.append((i * 3 % 121, text))
    return rows + [(500 + i, rows[5][1]) for i in range(30)]


def test_against_brute_force(spark):
    rows = corpus()
    got = found(passages.deduplicated(table(spark, rows)))
    assert got == brute(rows) and sum(r[2] for r in got) > 3000


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With far too few cells every window is estimated repeated; the result is the same."""
    rows = corpus()
    monkeypatch.setattr(passages.count_min, "__defaults__", (1 << 8, 1 << 8))
    assert found(passages.deduplicated(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    line = " ".join(words(13, 1))
    long = " ".join(words(40_000, 2, 10**6))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, line), (None, line), (4, line), (4, line.replace(" ", "\n\n")), (5, line[:-1]),
        (6, line + " " + line), (7, "x " + line + " y"), (8, "same " * 40), (9, "same " * 14), (8, "same " * 40), (10, long), (11, long[:-5] + line), (-1, "é" * 30 + " " + line),
    ]
    df = table(spark, rows)
    want = brute(rows)
    assert found(passages.deduplicated(df)) == want
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("id", "hash", "places", "place", "h1", "first", "part")])
    assert found(passages.deduplicated(clash)) == want
    assert found(passages.deduplicated(df.limit(0))) == []


def test_windows_of_texts_in_blocks(monkeypatch):
    """Blocks and pieces of any size give the same windows, which no two texts share."""
    texts = [t for _, t in corpus()] + ["", None, "a", "b " * 3000, "é" * 5000 + " " + "z " * 20]
    array = pa.array(texts)

    def every():
        got = [np.stack([r, p, a.view(np.int64), b.view(np.int64)]) for r, p, a, b in passages.windows(array)]
        return np.concatenate(got, axis=1)

    whole = every()
    for block, chunk in ((700, 50), (20, 7)):
        monkeypatch.setattr(passages, "BLOCK", block)
        monkeypatch.setattr(passages, "CHUNK", chunk)
        assert (every() == whole).all()
    by = {}
    for r, p, a, b in whole.T:
        w = tuple((texts[r] or "").encode().split()[p : p + 13])
        assert len(w) == 13 and by.setdefault((a, b), w) == w
    assert len(whole.T) == sum(max(0, len((t or "").split()) - 12) for t in texts) and len(set(by.values())) == len(by)


def test_the_sketch_counts_up_to_two():
    rng = np.random.default_rng(0)
    h = passages.mixed(rng.integers(0, 500, 2000).astype(np.uint64))
    sketches = [passages.Sketch(1 << 12) for _ in range(4)]
    for s, part in zip(sketches, np.array_split(h, 4)):
        for some in np.array_split(part, 3):
            s.add(some)
    once, twice = sketches[0].once, sketches[0].twice
    for s in sketches[1:]:
        once, twice = once | s.once, twice | s.twice | (once & s.once)
    values, n = np.unique(h, return_counts=True)
    for r, cell in enumerate(passages.cells(values, 1 << 12)):
        want = np.bincount(cell.astype(int), n, 1 << 12)
        assert (np.unpackbits(once[r], bitorder="little") == (want >= 1)).all()
        assert (np.unpackbits(twice[r], bitorder="little") == (want >= 2)).all()
    assert passages.repeated(values, twice)[n > 1].all()
    assert not passages.repeated(passages.mixed(rng.integers(10**6, 10**7, 1000).astype(np.uint64)), twice).all()


@pytest.mark.parametrize("size", [0, 12, 13, 40])
def test_cut(size):
    data = b" ".join(b"%d" % i for i in range(size))
    assert passages.cut(data, None) == (size, 0, hashlib.sha256(data).hexdigest())
    if size >= 13:
        n, gone, sha = passages.cut(data, np.array([0, size - 13]))
        assert gone == min(26, size) and sha == hashlib.sha256(b" ".join(b"%d" % i for i in range(13, size - 13))).hexdigest()
