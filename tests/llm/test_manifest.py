import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof_of(levels, at):
    """The sides of a node on every level below the top."""
    sides = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        sides.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return sides


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = levels_of([leaf_of(r) for r in groups[name]])
    crown = levels_of([trees[n][-1][0] for n in names])
    for i, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            sides = proof_of(trees[name], at) + proof_of(crown, i)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc = leaf_of((*row[:4], text))
            for left, right in sides:
                acc = h(left, acc, right)
            root = crown[-1][0]
            out.append((row[0], leaf_of(row), trees[name][-1][0], root, h("".join(a + b for a, b in sides)), acc, acc == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def found(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=repr)


def many(n, sources=4):
    return [(i * 7 - 40, f"s{i * i % sources}", "en", i, f"line {i}\nand {i % 5}\n" if i % 3 else f"line {i}") for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 200])
def test_against_brute_force(spark, n):
    rows = many(n)
    assert found(manifest.manifest(table(spark, rows))) == brute(rows)


def test_several_rounds(spark, monkeypatch):
    """Chunks of 9, cells told apart by more digits, one hot source; the same tree."""
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "SPAN", 9)
    rows = many(230, 2) + [(10_000 + i, "hot", None, None, "x\ny") for i in range(300)]
    assert found(manifest.manifest(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, "a\nb"), (None, "", "en", 0, ""), (5, "", None, None, "\n\n"), (5, "", None, None, "\n\n"),
        (5, "", None, None, "other\n"), (-3, "é", "de", 1, "ü\n"), (2**62, "z", "en", 3, "x" * 100_000 + "\n" + "y" * 10), (0, "Z", "-", 1, "-"), (1, "1", "", 1, "\n"),
    ]
    df = table(spark, rows)
    assert found(manifest.manifest(df)) == brute(rows)
    more = df.select("*", F.lit(1).alias("group"), F.lit(2).alias("rank"), F.lit("x").alias("key"), F.lit("y").alias("leaf"), F.lit(0).alias("cell"))
    assert found(manifest.manifest(more)) == brute(rows)
    assert found(manifest.manifest(df.limit(0))) == []


def test_fields_cannot_run_into_each_other(spark):
    a, b = (manifest.manifest(table(spark, [r])).first()["leaf"] for r in ((1, "a", "b", None, "c"), (1, "a1:b", None, None, "c")))
    assert a != b


def test_many_rows_of_one_id(spark):
    """Ties are told apart by the leaf, then by the row, in cells of bounded size."""
    rows = [(7, "s", "en", i % 300, f"t{i % 300}") for i in range(900)] + [(None, "s", None, None, "same")] * 100
    df = manifest.materialize(manifest.leaves(table(spark, rows)), "leaves")
    placed = manifest.ranked(df, most=64)
    want = sorted(r["key"] for r in df.collect())
    got = placed.orderBy("rank").collect()
    assert [r["key"] for r in got] == want and [r["rank"] for r in got] == list(range(1000)) and got[0]["total"] == 1000
    assert found(manifest.manifest(table(spark, rows))) == brute(rows)


def test_ranks_of_several_levels(spark):
    """Sparse ids: cells are placed by the digits before theirs, in three levels."""
    ids = [(i * 2_654_435_761) % 2**40 for i in range(3000)]
    rows = spark.createDataFrame([("a" if i % 3 else "b", f"{x:010x}") for i, x in enumerate(ids)], "`group` string, key string")
    got = manifest.ranked(manifest.materialize(rows, "rows"), 6, 8)
    for name in ("a", "b"):
        part = sorted(r["key"] for r in got.collect() if r["group"] == name)
        assert {r["key"]: r["rank"] for r in got.filter(F.col("group") == name).collect()} == {k: i for i, k in enumerate(part)}
