import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import negatives, search

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")


def brute(rows):
    """rows: (vec_id, vector, label)."""
    part = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        part.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256.0 * x)) for x in v]))
    out = []
    for i, label, v in part:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in part if j != i and len(w) == len(v)]
        scored.sort()
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            near = [(n, j) for n, j, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, positive, k + 1, j, -p, -n) for k, (n, j) in enumerate(near[:3])]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def some(n=700, dims=12, seed=3, spread=0.5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    kind = rng.integers(0, 6, n)
    v = centers[kind] + rng.normal(size=(n, dims)) * 0.8
    v *= np.exp(rng.normal(size=(n, 1)) * spread)
    v[100:140] = v[100]  # ties
    return [(i, list(map(float, x)), int(k if rng.random() < 0.7 else rng.integers(0, 10))) for i, (x, k) in enumerate(zip(v, kind))]


def test_against_brute_force(spark, monkeypatch):
    rows = some()
    want = brute(rows)
    assert len(want) > 30 and found(negatives.mine(table(spark, rows))) == want
    monkeypatch.setattr(negatives, "query_blocks", lambda q: search.query_blocks(q, 4))
    monkeypatch.setattr(negatives, "BUCKET", 16)
    assert found(negatives.mine(table(spark, rows))) == want


def test_odd_rows(spark):
    rows = [
        (0, [1, 0], 1), (1, [1, 0], 2), (2, [1, 0], 2), (3, [0.75, 0], 5), (4, [0.75, 1], 6), (5, [0.5, 0], 6), (8, [0.94921875, 0], 6), (9, [0.499, 0], 6),
        (50, None, 1), (100, [], 1), (150, [NAN, 1], 1), (200, [INF, 1], 1), (250, [None, 1], 1), (300, [1, 2], None), (None, [1, 0], 1),
        (350, [1, 2, 3], 4), (351, [1, 2, 3], 5), (400, [-1, 0], 5), (450, [0, 0], 3), (451, [0, 0], 3), (452, [0, 0], 4),
    ]
    want = brute(rows)
    df = table(spark, rows)
    assert found(negatives.mine(df)) == want
    # half of the positive's score and 95 hundredths of it are inside
    assert {r[3] for r in want if r[0] == 0 and r[1] == 1} == {8, 3, 4} and any(r[0] == 450 for r in want)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("anchor", "slot", "norm", "vector", "rank", "positives")])
    assert found(negatives.mine(clash)) == want
    assert found(negatives.mine(df.limit(0))) == [] and found(negatives.mine(df.filter("vec_id = 0"))) == []


def test_repeated_anchors(spark):
    """Rows of one id don't meet, and each is an anchor of its own."""
    rows = [(50, [1, 0], 1), (50, [0, 1], 1), (1, [1, 1], 1), (2, [0.7, 0.9], 2), (2, [0.7, 0.9], 2)]
    got = found(negatives.mine(table(spark, rows)))
    assert [r[:4] for r in got] == [(50, 1, 1, 2), (50, 1, 1, 2), (50, 1, 2, 2), (50, 1, 2, 2)]


@pytest.mark.parametrize("p", [0, 1, 19, 20, 21, 99, 2**61 + 7, -1, -20, -(2**61)])
def test_windows(p):
    low, high = (int(x[0]) for x in negatives.window_of(np.array([p], np.int64)))
    assert 50 * p <= 100 * low < 50 * p + 100 and 95 * p - 100 < 100 * high <= 95 * p


def test_buckets_are_pruned_and_exact_for_large_numbers():
    rng = np.random.default_rng(5)
    m = rng.integers(-1000, 1000, (4000, 8)) * np.exp2(rng.integers(0, 12, (4000, 1))).astype(np.int64)
    ids, labels, norms = np.arange(4000), np.arange(4000) % 3, np.sqrt((m.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms)
    low, high = (np.full((1, 1), x) for x in (np.iinfo(np.int64).min, np.iinfo(np.int64).max))
    for scale in (1, 2**20):  # products beyond what a double holds
        b = negatives.Buckets(np.array([0]), labels[:1], m[:1] * scale, low, high, 5, True)
        for at in range(0, 4000, 100):
            part = order[at : at + 100]
            b.add(ids[part], labels[part], m[part], float(norms[part[0]]))
        may = (labels == labels[0]) & (ids != 0)
        scores = m @ (m[0] * scale)
        want = sorted(zip(-scores[may], ids[may]))[:5]
        assert [(int(-s), int(i)) for s, i in zip(b.best.score[0], b.best.id[0])] == [(int(s), int(i)) for s, i in want]
        assert b.scored < 2000
