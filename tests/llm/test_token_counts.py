import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewell.llm import tokencounts as op


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(op.vocabulary())
    found.encode_special_tokens = True
    return found


def some_texts():
    rng = random.Random(3)
    parts = ["a", "word", " ", "  ", "\n", "\t", "é", "ß", "'s", "12", "!", " ", "中", " ", "🙂", "́", "<|endoftext|>", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]


def test_equals_the_tokenizer(tokenizer, monkeypatch):
    for text in some_texts():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        found = op.token_bytes(text.encode())
        assert list(found) == [int(x) for x in op._sizes(op.vocabulary())[ids]] if ids else not len(found)


def test_blocks_change_nothing(monkeypatch):
    text = " ".join(some_texts()).encode()
    whole = op.token_bytes(text)
    from tidewell.llm import text as module

    monkeypatch.setattr(module.pieces, "__defaults__", (100,))
    assert np.array_equal(op.token_bytes(text), whole)
    assert whole.sum() == len(text)


def test_crossing_tokens_go_where_most_of_them_lies():
    ends = np.array([3, 6, 10])
    tokens, crossing = op.attribute(ends, np.array([2, 2, 1, 4, 1]))
    # [0,2) in 0; [2,4) half in 0 and half in 1: the first; [4,5) in 1; [5,9) mostly in 2; [9,10) in 2
    assert list(tokens) == [2, 1, 2] and list(crossing) == [1, 0, 1]
    tokens, crossing = op.attribute(np.array([1, 4, 5]), np.array([5]))
    assert list(tokens) == [0, 1, 0] and list(crossing) == [0, 1, 0]


def by_line(text, tokenizer):
    """(tokens, crossing) of each line: every token is followed byte by byte through the lines."""
    sizes = op._sizes(op.vocabulary())
    line_of, line = [], 0
    for b in text.encode():
        line_of.append(line)
        line += b == 10
    n = max(line_of, default=0) + 1
    found, at = [[0, 0] for _ in range(n)], 0
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        own = line_of[at : at + int(sizes[i])]
        at += int(sizes[i])
        if not own:
            continue
        most = max(set(own), key=lambda x: (own.count(x), -x))
        found[most][0] += 1
        found[most][1] += len(set(own)) > 1
    return [tuple(x) for x in found]


def test_every_line_by_brute_force(spark, documents, tokenizer):
    """The attribution itself: each line's tokens and those of them that cross its boundaries."""
    rng = random.Random(11)
    parts = ["\n", "\n\n", "\n \n", "\r\n", "    ", "\n\n\n\n", "\n\t\t", "a", "word ", " b", "é", "中", "\n-----\n", "=" * 9, "x\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)] + some_texts()[:200]
    found = {}
    for r in op.count_lines(documents(*texts)).collect():
        found.setdefault(r["doc_id"], {})[r["section"]] = (r["tokens"], r["crossing"])
    crossing = 0
    for i, text in enumerate(texts):
        own = [found[i][j] for j in range(len(found[i]))]
        assert own == by_line(text, tokenizer), text
        crossing += sum(c for _, c in own)
    assert crossing > 100


def test_a_vocabulary_with_too_long_tokens(monkeypatch):
    class Long:
        def get_vocab(self):
            return {"a": 0, "b" * 256: 1}

    monkeypatch.setattr(op, "_tokenizer", lambda path: Long())
    with pytest.raises(ValueError, match="a token of 256 bytes"):
        op._sizes.__wrapped__("some path")


def test_brute_force(spark, documents, tokenizer):
    texts = some_texts()[:200] + ["", "one\ntwo\n\nthree", "\n", "x" * 5000 + "\n" + "y " * 5000]
    found = op.count_lines(documents(*texts)).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["section"])
        lines = text.encode().split(b"\n")
        lengths = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] or len(lines) == 1 else [])
        assert [r["bytes"] for r in own] == lengths
        assert sum(r["tokens"] for r in own) == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert [r["start"] for r in own] == [sum(lengths[:j]) for j in range(len(lengths))]


def test_odd_rows(spark, documents):
    docs = documents((1, None, None, None), (1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", "en", "s"))
    found = sorted((r["doc_id"] or 0, r["tokens"]) for r in op.count_lines(docs).collect())
    assert found == [(0, 1), (1, 0), (1, 2), (1, 2)]
    assert op.count_lines(docs.limit(0)).count() == 0
    assert op.count_lines(docs.withColumnRenamed("lang", "section")).columns == ["doc_id", "section", "start", "bytes", "tokens", "crossing"]


def test_fields(spark):
    df = spark.createDataFrame([(1, "A title", None, "some body text")], "id int, title string, lead string, body string")
    found = {r["section"]: r["tokens"] for r in op.count_fields(df, "id", ["title", "lead", "body"]).collect()}
    whole = len(op.token_bytes(b"A title\n\nsome body text"))
    assert set(found) == {"title", "lead", "body"} and sum(found.values()) == whole
