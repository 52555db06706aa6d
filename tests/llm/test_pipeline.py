import numpy as np
import pytest

import corpus_pipeline as pipeline
from tidewell.llm import packing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with toxic documents, copies and personal data."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijk"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(words[j] for j in rng.integers(0, 300, 40))
        toxic = int(i % 6 == 0)
        text += " you scoundrel" if toxic else ""
        text += f" write to user{i}@mail.example.org" if i % 7 == 1 else ""
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, toxic))
    for i in range(0, 60):
        rows.append((1000 + i, *rows[i][1:]))
    rows += [(2000, None, None, None, None), (2001, "", None, "s1", 0), (None, "an odd one here", "en", None, 15)]
    place = str(tmp_path_factory.mktemp("tables"))
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, docs).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place, rows, {i: t for i, _, t in labels}


def test_stages(spark, tables):
    place, rows, toxic = tables
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, place), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert np.mean([i in kept for i, t in toxic.items() if not t]) > 0.97
    assert np.mean([i in kept for i, t in toxic.items() if t]) < 0.1
    single = seen["simhash_near_dedup"]
    # one of each text stays, that of the least id; the empty ones are one group
    texts = {}
    for r in seen["toxicity"]:
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    assert {r["text"] or "" for r in single} == set(texts)
    assert all(r["doc_id"] == min((i for i in texts[r["text"] or ""] if i is not None), default=None) for r in single)
    old = {r["doc_id"]: r["text"] for r in single}
    for r in seen["pii"]:
        assert f"user{r['doc_id']}@" not in (r["text"] or "")
        assert ("@" in (old[r["doc_id"]] or "")) == ("@" in (r["text"] or "")) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    pieces = seen["packing"]
    assert len([p for p in pieces if p["start"] == 0]) == len(seen["mixing"])
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_run(spark, tables):
    found = pipeline.run(spark, tables[0])
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ends = {}
    for r in found.collect():
        ends[r["sequence_id"]] = max(ends.get(r["sequence_id"], 0), r["offset"] + r["length"])
    assert max(ends.values()) <= packing.LENGTH and sorted(ends) == list(range(len(ends)))


def test_long_texts_and_clashing_columns(spark, tables, tmp_path):
    """Very long texts stay whole, and extra columns named as the stages name theirs are carried along."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    rng = np.random.default_rng(7)
    long = " ".join(f"word{j}" for j in rng.integers(0, 10**9, 120_000)) + " write to someone@mail.example.org"
    more = spark.createDataFrame([(5000, long, "en", "s1", len(long)), (5001, "x" * 500_000, "en", "s2", 500_000)], docs.schema)
    docs = docs.filter("doc_id < 60 OR doc_id IS NULL").unionByName(more)
    extra = ["score", "row", "__row", "__fp", "entities", "copies", "size", "target", "kind", "held_out", "toxic", "new"]
    docs = docs.selectExpr("*", *[f"doc_id + {i} AS `{c}`" for i, c in enumerate(extra)])
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, tables[0]), name)
        if name == "packing":
            break
        assert docs.columns == columns
        kept = docs.collect()
        assert all(r[c] == (None if r["doc_id"] is None else r["doc_id"] + i) for r in kept for i, c in enumerate(extra))
        if name != "mixing":
            texts = {r["doc_id"]: r["text"] for r in kept}
            assert texts[5000][:100_000] == long[:100_000] and len(texts[5000]) == len(long) and len(texts[5001]) == 500_000
    assert "someone@" not in texts[5000]
    pieces = docs.collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_no_documents(spark, tables):
    none = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, tables[0]).count() == 0
