import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.llm import nearcopies, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_kept(rows):
    """The least id of each connected group, by comparing all pairs' five-word shingles."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return sorted(min(x) for x in least.values())


def corpus():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [[word() for _ in range(rng.randint(30, 300))] for _ in range(60)]
    for base in texts[:40]:  # near copies on both sides of the limit
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, max(len(base) // 30, 1))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(25):  # neighbours are alike, the ends are not
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(chain)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(2000, None), (2001, ""), (2002, "few words"), (2003, "FEW  words"), (2004, "few other words")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, pairs", [(2000, 1000), (2, 2)])
def test_by_brute_force(spark, documents, monkeypatch, block, pairs):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "PAIRS", pairs)
    rows = corpus()
    docs = documents(*[(k, t, "en", "s") for k, t in rows])
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).select("doc_id").collect()) == plain_kept(rows)


def test_fingerprints_find_copies_by_themselves(spark, documents, monkeypatch):
    """Copies within 3 bits are found by the trie where MinHash has no bands; unlike ones of them stay."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(2000)]
    few = "a few words of it"
    rows = [(4, " ".join(base)), (2, " ".join(base[:-1])), (9, " ".join(base).upper()), (5, few), (7, f"{few} {few} {few} {few}"), (6, None), (3, "")]
    bits = lambda i, j: (simhash.fingerprint((rows[i][1] or "").encode()) ^ simhash.fingerprint((rows[j][1] or "").encode())).bit_count()
    assert bits(0, 1) <= simhash.BITS
    real, seen = nearcopies.links, []

    def without_bands(sets, texts, groups, more):
        seen.append(sorted(more.collect()))
        return real(sets.withColumn("bands", F.array().cast("array<bigint>")), texts, groups, more)

    monkeypatch.setattr(nearcopies, "links", without_bands)
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(documents(*[(k, t, "en", "s") for k, t in rows])).collect())
    assert kept == plain_kept(rows) == [2, 3, 5, 7] and len(seen[0]) >= 1


def test_unlike_copies_of_one_text_make_few_pairs(spark, documents, monkeypatch):
    """Copies with too many changes of their own, or too many together, are told apart without comparing all of them."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(600)]

    def changed(text, places):
        copy = list(text)
        for i in places:
            copy[i] = f"x{rng.randrange(10**9)}"
        return copy

    few = [changed(base, rng.sample(range(600), k)) for k in [1, 2, 2, 3, 3, 4, 5, 6] * 3]
    many = [changed(base, rng.sample(range(4, 596, 6), 14)) for _ in range(40)]
    later = [changed(text, rng.sample(range(600), 3)) for text in many[:8] for _ in range(2)]
    shorter = [base[: 600 - k] for k in (10, 60, 100, 140)]
    texts = few + many + later + shorter
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    real, seen = nearcopies._verified, []

    def counted(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(documents(*[(k, t, "en", "s") for k, t in rows])).select("doc_id").collect())
    assert kept == plain_kept(rows)
    assert seen[-1] <= 100, seen
