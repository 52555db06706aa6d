import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import simhash as op


def plain_fingerprint(text):
    """By the definition, word by word and bit by bit."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lower:
        if c in " \t\n\x0b\x0c\r":
            words, now = words + ([now] if now else []), ""
        else:
            now += c
    words += [now] if now else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """(id, fingerprint) pairs to the least id of each one's group, by comparing all pairs."""
    n = len(prints)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(n):
        least[root(i)].append(prints[i][0])
    return {prints[i][0]: min(x for x in least[root(i)]) for i in range(n)}


def test_fingerprints():
    rng = random.Random(5)
    texts = ["", "  \n", "One", "one TWO", "One two three", "É É É x", "a\x1cb c\x85d e f"]
    texts += [" ".join(rng.choice("abcdefÀ") * rng.randint(1, 3) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for text in texts:
        assert op.fingerprint(text.encode()) == plain_fingerprint(text)


def test_blocks_change_nothing(monkeypatch):
    from tidewell.llm import text as module

    text = " ".join(str(i * 7919 % 1000) for i in range(3000))
    whole = op.fingerprint(text.encode())
    monkeypatch.setattr(module.pieces, "__defaults__", (50,))
    assert op.fingerprint(text.encode()) == whole


def flipped(rng, value, most):
    for _ in range(rng.randint(0, most)):
        value ^= 1 << rng.randrange(64)
    return value


@pytest.mark.parametrize("group, blocks", [(4096, None), (5, 4), (40, 5), (5, 6)])
def test_groups_by_brute_force(spark, group, blocks):
    """Random fingerprints, chains, and a dense cluster that large node pairs must walk."""
    rng = random.Random(group)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:40]:
        values += [flipped(rng, v, 4) for _ in range(3)]
    chain = values[50]
    for _ in range(12):
        chain = flipped(rng, chain, 3)
        values.append(chain)
    values += [flipped(rng, values[60], 8) for _ in range(150)] + [values[3]] * 50 + [0, 0, 1, (1 << 64) - 1]
    prints = list(enumerate(values))
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints]
    table = op.materialize(spark.createDataFrame(signed, "__fp long, __key long"), "prints")
    found = {r["__key"]: r["__group"] for r in op.components(table, 3, blocks, group).collect()}
    assert found == plain_groups(prints)


def test_more_fingerprints_more_blocks():
    assert [op.enough_blocks(n) for n in (0, 1, 1 << 24, (1 << 24) + 1, 1 << 32, 1 << 38)] == [4, 4, 4, 5, 5, 6]
    for blocks in (4, 5, 6):
        for agree, order in op._orders(blocks, 3):
            bits = sorted(b for low, width in order for b in range(low, low + width))
            assert bits == list(range(64)) and agree >= (blocks - 3) * (64 // blocks)


def test_documents(spark, documents):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base, "en", "s"), (4, base.upper(), "en", "s"), (7, base + " more", "en", "s"), (2, "other text here", "en", "s")]
    rows += [(5, None, None, None), (6, "", "en", "s"), (3, " \n", "en", "s"), (2, "other text here", "en", "s"), (None, "other text here", "en", "s")]
    found = op.near_duplicates(documents(*rows)).collect()
    assert len(found) == len(rows)
    got = sorted(((r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in found)
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows if r[0] is not None]
    want = plain_groups(prints)
    for i, fp, group in got:
        if i:
            assert fp == f"{dict(prints)[i]:016x}" and group == want[i]
    assert [g for i, _, g in got if not i] == [2]


def test_one_row_of_each_group_stays(spark, documents):
    rows = [(3, "same words in here", "en", "a"), (1, "SAME words in here", "en", "b"), (1, "same words in here", "en", "c"), (None, "same words in here", "en", "d")]
    rows += [(None, "alone but twice", "en", "e"), (None, "alone but twice", "en", "f"), (8, "quite another thing", "en", "g")]
    docs = documents(*rows).selectExpr("*", "1 AS __fp", "2 AS __row", "3 AS __group", "4 AS `row`")
    kept = op.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept.collect()) == [
        (0, "alone but twice"), (1, "same words in here"), (8, "quite another thing"),
    ]
    assert op.deduplicate(docs.limit(0)).count() == 0
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_hot_copies(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same old story").otherwise(F.concat(F.lit("story number "), "id")).alias("text"))
    found = op.near_duplicates(docs)
    assert found.filter("component_id = 0 AND doc_id % 3 = 0").count() == 1334


def test_union_finds_all():
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    label = np.arange(500)
    op._union(label, i, j)
    assert (label[i] == label[j]).all() and len(np.unique(label)) > 1


def test_walk_of_many_rows_where_nothing_else_loads_pyarrow_compute(monkeypatch):
    import pyarrow as pa

    n = op.TOGETHER
    columns = {"side": [0] * n, "own": [True] * n, "diff": [0] * n, "rest": list(range(0, 16 * n, 16)), "left": [62] * n, "__fp": list(range(n))}
    batches = [pa.RecordBatch.from_pydict({"node": [node] * n} | columns) for node in ("a", "b")]
    monkeypatch.delattr(pa, "compute", raising=False)  # as in a worker that has run nothing else
    found = [r for b in op._walk(iter(batches), 1) for r in b.to_pylist()]
    assert {r["a"] for r in found} == set(range(1, n)) and {r["b"] for r in found} == {0}
