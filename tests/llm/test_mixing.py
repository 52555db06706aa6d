import hashlib
import math
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import mixing as op


def plain_targets(sizes):
    """Reshares what is over the cap, round after round, in exact fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left = {}, Fraction(sum(sizes.values()))
    free = set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        for s in over:
            full[s] = Fraction(3 * sizes[s])
            left -= full[s]
        free -= over
    return full


def some(documents):
    rows = []
    for i in range(900):
        source = ["z", "a", "é", None, "Z", "b"][min(i % 17, 5)]
        rows.append((i, " ".join(["w"] * (i * 7 % 40)), "en", source))
    rows += [(900, None, None, "tiny"), (901, "one", "en", "tiny"), (902, "", "en", "nothing"), (None, "two words", "en", "a"), (5, "w w", "en", "a"), (5, "w w", "en", "a")]
    return documents(*rows), rows


def test_by_brute_force(documents):
    docs, rows = some(documents)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    by_id = {}
    for i, text, _, source in rows:
        by_id.setdefault(i, []).append((len((text or "").split()), sizes[source], source))
    found = op.digest(docs).collect()
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        source = next(s for n, size, s in by_id[r["doc_id"]] if n == r["size"] and size == r["source_size"])
        assert math.isclose(r["target"], float(want[source]), rel_tol=1e-12, abs_tol=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        u = int(hashlib.md5(f"{op.SEED}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["taken"] == r["size"] * (math.floor(rate) + (u < rate - math.floor(rate))) <= 3 * r["size"]
        taken[source] += r["taken"]
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s, t in want.items():
        if t > 1000:
            assert abs(taken[s] - t) < 0.15 * t


def test_equals_its_sql(documents):
    docs, _ = some(documents)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(op.SQL).fetchall()
    found = [tuple(r) for r in op.digest(docs).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_the_documents_themselves(documents):
    docs, _ = some(documents)
    docs = docs.selectExpr("*", "1 AS target", "2 AS copies", "3 AS source_size", "4 AS `row`")
    mixed = op.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect() if r["doc_id"] not in (5, None))
    want = {r["doc_id"]: r["copies"] for r in op.mix(docs).collect()}
    assert all(times[i] == n for i, n in want.items() if i not in (5, None))


def test_native(documents):
    docs, _ = some(documents)
    for df in (op.mixed_documents(docs), op.digest(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_odd_tables(documents):
    docs, _ = some(documents)
    assert op.digest(docs.limit(0)).count() == 0 and op.mixed_documents(docs.limit(0)).count() == 0
    nothing = documents((1, None, None, None), (2, "", "en", "a"))
    assert [tuple(r)[1:] for r in op.digest(nothing).collect()] == [(0, 0, 0.0, 0)] * 2
    one = documents((1, "a b c", "en", "only"))
    assert [tuple(r) for r in op.digest(one).collect()] == [(1, 3, 3, 3.0, 3)]


def test_a_very_long_text(documents):
    """All words of a text of 600,000 count, between white space of every kind."""
    docs = documents((1, "ab \t\n\v\f\r" * 600_000, "en", "long"), (2, "x" * 1_000_000, "en", "long"), (3, "a b", "en", "other"))
    found = {r["doc_id"]: r for r in op.digest(docs).collect()}
    assert [found[i]["size"] for i in (1, 2, 3)] == [600_000, 1, 2] and found[1]["source_size"] == 600_001
    assert all(r["taken"] <= 3 * r["size"] for r in found.values())
    assert {len(r["text"]) for r in op.mixed_documents(docs).collect()} <= {4_800_000, 1_000_000, 3}


def test_reruns_agree(documents):
    docs, _ = some(documents)
    one, two = (sorted(map(repr, op.digest(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == two


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=3), st.integers(0, 1000), min_size=1, max_size=12))
def test_shares_add_up(sizes):
    want = plain_targets(sizes)
    assert sum(want.values()) == sum(sizes.values()) and all(want[s] <= 3 * sizes[s] for s in sizes)


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 0}, {"a": 10, "b": 10, "c": 10, "d": 1, "e": 500}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in op.targets(df).collect()}
    want = plain_targets(sizes)
    assert all(math.isclose(found[s], float(want[s]), rel_tol=1e-12, abs_tol=1e-12) for s in sizes)
