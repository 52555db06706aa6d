import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing as op


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(op.vocabulary())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


TEXTS = [
    "", " \n", "Hello, World! It's 'quoted's.", "a\x0bb\x0cc\x1cd\x85e\xa0f", "ÉÀ ΑΣ ΣΑΣ. ß İ ﬁ", "<|endoftext|> and <|STARTOFTEXT|> x.<|startoftext|>",
    "don't we'll I'M they'd...!!! a.,b,.c #$%&*", "x" * 3000, "中文字 テスト กขค 🙂🙂", "é ́x á.", "word,word.word!word's",
]


def test_equals_the_tokenizer(tokenizer):
    for text in TEXTS:
        assert np.frombuffer(b"".join(op.encode(text.encode())), "<u4").tolist() == ids_of(tokenizer, text)[:-1].tolist(), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abAB.,'!#1 \n\té´ñΣ<|>中́\xa0s")), max_size=40))
def test_any_text(text):
    expected = op._tokenizer(op.vocabulary()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(op.encode(text.encode())), "<u4").tolist() == expected


def check(rows, texts, tokenizer, length):
    """Every id in one piece with the right checksum; sequences without gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for i, text in texts.items():
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))


def test_pieces_and_sequences(spark, documents, tokenizer):
    texts = dict(enumerate(TEXTS + ["several words here " * n for n in range(60)] + [None]))
    docs = documents(*[(i, t, "en", "s") for i, t in texts.items()]).selectExpr("*", "1 AS start", "2 AS __salt")
    for length in (16, 64, 4096):
        check(op.pack_documents(docs, length).collect(), texts, tokenizer, length)


def test_repeated_rows_and_no_rows(spark, documents):
    docs = documents((1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "a b", "en", "s"), (None, None, None, None))
    found = op.pack_documents(docs).collect()
    assert len(found) == 4 and len({(r["sequence_id"], r["offset"]) for r in found}) == 4
    assert op.pack_documents(docs.limit(0)).count() == 0


def test_blocks_change_nothing(monkeypatch):
    from tidewell.llm import text as module

    text = " ".join(TEXTS * 5).encode()
    whole = op.cut(text, op.VOCABULARY, 50, 2)
    monkeypatch.setattr(module.pieces, "__defaults__", (64,))
    assert op.cut(text, op.VOCABULARY, 50, 2) == whole


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 300), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    patterns = op.pack(histogram, 32)
    held = defaultdict(int)
    for pattern, count in patterns:
        assert count > 0 and 0 < sum(pattern) <= 32
        for size in pattern:
            held[size] += count
    assert held == histogram
    table = op.slots(patterns)
    assert table.groupby("length")["count"].sum().to_dict() == histogram


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 4096)
    sizes, counts = np.unique(lengths, return_counts=True)
    patterns = op.pack(dict(zip(sizes.tolist(), counts.tolist())))
    assert sum(c for _, c in patterns) * 4096 < lengths.sum() * 1.01


def test_the_work_follows_the_histogram():
    """Billions of documents pack as fast as thousands."""
    patterns = op.pack({n: 10**9 + n for n in range(1, 4097)})
    assert sum(c for _, c in patterns) >= 4096 * 10**9 // 2
