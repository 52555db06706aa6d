import numpy as np
import pytest

from tidewell.llm import ann, search, topk

NAN, INF = float("nan"), float("inf")


def table(spark, vectors, ids=None, kind="float"):
    rows = [(None if i is None else int(i), v) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def some(n=900, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dims))
    v = centers[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * 0.6
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n // 2 : n // 2 + n // 5] = v[3]  # a crowded place
    return v.astype(np.float32)


def plain(vectors, ids, score):
    out = {}
    for q, i in enumerate(ids):
        if i % search.EVERY == 0:
            every = [(-score(vectors[q], vectors[r]), j) for r, j in enumerate(ids) if j != i]
            out[i] = [(j, -s) for s, j in sorted(every)[: search.K]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_top_k_by_brute_force(spark, monkeypatch):
    v = some()
    whole = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = plain(whole, list(range(len(v))), lambda a, b: int(a @ b))
    assert answers(topk.top_k(table(spark, v.tolist()))) == want
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search.search, "__defaults__", (search.K, 4))
    assert answers(topk.top_k(table(spark, v.tolist()))) == want


def test_the_walk_stops_early():
    """With one dominant dimension the bound falls quickly."""
    rng = np.random.default_rng(1)
    m = rng.integers(-5, 5, (5000, 6))
    m[:, 0] = rng.permutation(5000)
    lists, best = topk.Lists(m, np.arange(5000)), search.Best(1, 5, np.int64)
    query = np.array([100, 1, -1, 0, 2, 0])
    scored = lists.search(query, -1, best, 0)
    assert scored < 1000
    assert sorted(best.id[0]) == sorted(np.argsort(-(m @ query), kind="stable")[:5])


@pytest.mark.parametrize("scale", [1, 2**30])
def test_ties_and_large_numbers(scale):
    m = np.array([[1, 0], [1, 0], [0, 1], [1, 0], [1, 0], [1, 0], [1, 0]]) * scale
    lists, best = topk.Lists(m, np.array([9, 3, 1, 7, 5, 2, 8])), search.Best(1, 5, np.int64)
    lists.search(np.array([1, 0]) * scale, 3, best, 0)
    assert list(best.id[0]) == [2, 5, 7, 8, 9] and set(best.score[0]) == {scale * scale}


def odd_rows(spark):
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], None, [], [NAN, 1.0], [INF, 1.0], [None, 1.0], [1.0, 2.0, 3.0], [0.0, 0.0], [-1.0, 0.0]]
    ids = [0, 1, 1, 2, 3, 4, 5, 6, 50, 8, None]
    return table(spark, vectors, ids)


def test_odd_rows(spark):
    exact = answers(topk.top_k(odd_rows(spark)))
    assert exact == {0: [(1, 65536), (1, 32768), (8, 0)]}  # ties by id; 50 has other dimensions
    near = answers(ann.nearest(odd_rows(spark)))
    assert [i for i, _ in near[0]] == [1, 1] and near[0][0][1] == 1.0 and near[0][1][1] == pytest.approx(0.5**0.5)
    for op in (topk.top_k, ann.nearest):
        assert op(odd_rows(spark).limit(0)).count() == 0
        assert op(odd_rows(spark).selectExpr("*", "1 AS score", "2 AS `rank`", "3 AS vector", "4 AS buckets")).columns == ["query_id", "rank", "vec_id", "score"]


def cosine(a, b):
    a, b = a.astype(np.float64), b.astype(np.float64)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_nearest_recall_and_scores(spark):
    v = some(3000, 32, 2)
    want, found = plain(v, list(range(len(v))), cosine), answers(ann.nearest(table(spark, v.tolist())))
    assert set(found) == set(want) and all(len(x) == 5 for x in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, rows in found.items():
        for i, s in rows:
            assert s == pytest.approx(cosine(v[q], v[i]), abs=1e-12)


def test_rotations_keep_lengths():
    x = np.random.default_rng(3).normal(size=(50, 24))
    for t in range(3):
        y = ann.turn(x, t)
        assert y.shape == (50, 32) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))
    for bits in (1, 4, 6, 9, 13):
        how = ann.Hashing(bits, probes=min(32, 1 << bits))
        code, near = ann.buckets(ann.unit(x), 2, how), ann.probed(ann.unit(x), 2, how)
        assert (near[:, 0] == code).all() and code.min() >= 0 and code.max() < 1 << bits
        assert all(len(set(r)) == how.probes for r in near.tolist())


def test_probes_by_brute_force():
    """The nearest buckets are those of all sequences of axes that miss the query by least."""
    u = ann.unit(np.random.default_rng(4).normal(size=(20, 8)))
    how = ann.Hashing(7, probes=40)
    parts = list(ann.axes(u, 1, how))
    assert [p.shape[1] for p in parts] == [16, 8]
    for q, near in enumerate(ann.probed(u, 1, how)):
        miss = [sum((p[q].max() - p[q, a]) ** 2 for p, a in zip(parts, divmod(c, 8))) for c in range(128)]
        assert len(set(near.tolist())) == 40
        assert np.allclose([miss[c] for c in near], sorted(miss)[:40], rtol=0, atol=1e-15)  # equal ones in any order


def test_hashes_grow_with_the_rows_and_probes_are_measured(spark):
    few, many = some(200, 16, 5), some(6000, 16, 5)
    found = []
    for v in (few, many):
        rows = ann.taking_part(table(spark, v.tolist()))
        classes = ann.classes_of(rows)
        found.append(ann.fitted(classes, classes.filter("ids[0] % 50 = 0")))
    assert found[0].bits < found[1].bits and all(1 <= h.probes <= ann.PROBES for h in found)


def test_crowded_parts_are_dealt_out(spark, monkeypatch):
    v = some(1500, 16, 6)
    want = answers(ann.nearest(table(spark, v.tolist())))
    monkeypatch.setattr(ann, "ASKED", 3)
    monkeypatch.setattr(ann, "SHARD", 40)
    assert answers(ann.nearest(table(spark, v.tolist()))) == want


def test_equal_vectors_and_repeated_ids(spark):
    """A third of the rows are equal; an id that is repeated is never its own neighbour."""
    v = [[1.0, 2.0]] * 300 + [[2.0, 4.0]] * 9 + [[3.0, -1.0]] * 20
    ids = [50] * 9 + list(range(51, 342)) + list(range(400, 409)) + list(range(500, 520))
    found = answers(ann.nearest(table(spark, v, ids)).filter("query_id <> 50"))
    assert len(found[150]) == 5 and [i for i, _ in found[150]] == [50] * 5
    assert [i for i, _ in found[500]] == [501, 502, 503, 504, 505]
    rows = ann.nearest(table(spark, v, ids)).filter("query_id = 50").groupBy("rank", "vec_id").count().collect()
    assert {(r["rank"], r["vec_id"], r["count"]) for r in rows} == {(n, 50 + n, 9) for n in range(1, 6)}


def test_too_few_in_the_probed_buckets(spark):
    """Opposite vectors share no bucket with the query; all candidates are still returned."""
    v = [[1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0], [-1.0, 0.1, 0.0, 0.0]]
    found = answers(ann.nearest(table(spark, v)))
    assert [i for i, _ in found[0]] == [2, 1]


def test_tiny_and_huge_vectors(spark):
    v = [[1e-300, 2e-300], [1e300, 2e300], [2e-300, -1e-300]]
    found = answers(ann.nearest(table(spark, v, kind="double")))
    assert found[0][0] == (1, pytest.approx(1.0)) and found[0][1] == (2, pytest.approx(0.0, abs=1e-12))
