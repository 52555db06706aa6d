import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import toxicity as op


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijk"), 5)) for _ in range(200)]
    rows = []
    for i in range(n):
        text = [words[j] for j in rng.integers(0, 200, rng.integers(3, 60))]
        lang = "de" if i % 3 == 0 else "en"
        toxic = i % 5 == 0
        if toxic:
            # a word in one language, a beginning of words in the other
            bad = "scoundrel" if lang == "en" else "zwuck" + words[rng.integers(0, 200)]
            text.insert(rng.integers(0, len(text)), bad.capitalize() + ",")
        rows.append((i, " ".join(text), lang, "s", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[4] for r in rows}


def test_held_out_documents(tables):
    docs, labels, truth = tables
    found = op.score_documents(docs, labels).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_the_filter_keeps_clean_documents(tables):
    docs, labels, truth = tables
    extra = docs.selectExpr("*", "1 AS score", "2 AS flagged", "3 AS threshold", "4 AS `row`")
    kept = op.keep_clean(extra, labels)
    assert kept.columns == extra.columns
    rows = kept.collect()
    assert all((r["score"], r["flagged"], r["threshold"], r["row"]) == (1, 2, 3, 4) for r in rows)
    ids = {r["doc_id"] for r in rows}
    clean, toxic = [i for i in truth if not truth[i]], [i for i in truth if truth[i]]
    assert np.mean([i in ids for i in clean]) > 0.97 and np.mean([i in ids for i in toxic]) < 0.1


def test_other_columns_are_no_inputs(tables):
    docs, labels, _ = tables
    model = op.fit_sample(docs, labels)
    one = op.with_scores(docs, model).select("doc_id", "score").collect()
    two = op.with_scores(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS source"), model).select("doc_id", "score").collect()
    assert sorted(one) == sorted(two)


def test_odd_rows(spark, tables):
    docs, labels, _ = tables
    odd = spark.createDataFrame([(None, None, None, None), (-1, "", "en", "s"), (-1, "", "en", "s"), (-2, "?! ...", "en", "s"), (-3, "word " * 200_000, "en", "s")], docs.schema)
    found = op.score_documents(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 7)], labels.schema)))
    rows = [r for r in found.collect() if r["doc_id"] is None or r["doc_id"] < 0]
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (None, -1, -2)}
    assert len(empty) == 1
    assert op.score_documents(docs.limit(0), labels).count() == 0


def test_without_labels_nothing_is_flagged(tables):
    docs, labels, truth = tables
    found = op.score_documents(docs, labels.limit(0))
    assert {r["score"] for r in found.collect()} == {0.0}
    assert op.keep_clean(docs, labels.limit(0)).count() == len(truth)


def test_blocks_change_nothing(monkeypatch):
    rows = corpus(200)
    texts, labels = [r[1] for r in rows], np.array([float(r[4]) for r in rows])
    words = [np.concatenate(w) for w in op._words(pa.array(texts, pa.large_string()))]
    model = op.fit(words, labels, [r[2] for r in rows], labels.mean())
    array = pa.array([*texts, " ".join(texts), ""], pa.large_string())
    whole = model.score(array)
    monkeypatch.setattr(op, "BLOCK", 200)
    monkeypatch.setattr(op, "WORDS", 64)
    assert np.allclose(model.score(array), whole, atol=1e-5)
    assert np.allclose(model.score(array.slice(7, 20)), whole[7:27], atol=1e-5)


def test_hashes_see_case_and_place_alike():
    one = [b for _, b, _ in op.documents_buckets(pa.array(["The WORD éCOLE.", "x"], pa.large_string()))]
    two = [b for _, b, _ in op.documents_buckets(pa.array(["so it is: the word École", "y"], pa.large_string()))]
    assert np.array_equal(one[0], two[0][-3:])


def plain_score(model, text):
    """The network by its definition: a window at a time, in plain Python."""
    words = [b for _, part, _ in op.documents_buckets(pa.array([text], pa.large_string())) for b in part]
    vectors = [sum(model.embedding[i].astype(float) for i in word) for word in words]
    logit, filter_number, at = float(model.bias), 0, 0
    for width in op.WIDTHS:
        for f in range(op.FILTERS):
            best = max(0.0, float(model.conv_bias[filter_number]))  # of the padding, if of no window
            for start in range(len(vectors)):
                total = float(model.conv_bias[filter_number])
                for k in range(width):
                    if start + k < len(vectors):
                        total += float(vectors[start + k] @ model.conv[:, at + k * op.FILTERS + f])
                best = max(best, total)
            logit += best * float(model.out[filter_number])
            filter_number += 1
        at += width * op.FILTERS
    return 1 / (1 + np.exp(-logit))


def test_scores_by_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    taps, filters = sum(op.WIDTHS) * op.FILTERS, op.FILTERS * len(op.WIDTHS)
    model = op.Model(*(rng.normal(0, s, n).astype(np.float32) for s, n in ((0.3, (op.BUCKETS, op.SIZE)), (0.3, (op.SIZE, taps)), (0.1, filters), (0.1, filters))), 0.2)
    texts = [r[1] for r in corpus(40, 4)] + ["one", "two words", "", "a b c d e f g"]
    want = [plain_score(model, t) for t in texts]
    for words in (op.WORDS, 16):
        monkeypatch.setattr(op, "WORDS", words)
        assert np.allclose(model.score(pa.array(texts, pa.large_string())), want, atol=1e-5)


def test_gradients_by_brute_force(monkeypatch):
    """A step of training moves every weight against its numeric derivative."""
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 50, (n, 1 + len(op.STARTS))).astype(np.uint32) for n in (1, 2, 7, 30)]
    labels = np.array([1.0, 0.0, 0.0, 1.0])
    monkeypatch.setattr(op, "BUCKETS", 64)
    monkeypatch.setattr(op, "RATE", 0.0)
    start = op.train(parts, labels, 1, 1)
    monkeypatch.setattr(op, "RATE", 1e-3)

    class Keep:  # no filter is dropped
        def __init__(self, seed):
            self.rng = np.random.default_rng(seed)

        def __getattr__(self, name):
            return getattr(self.rng, name)

        def random(self, shape):
            self.rng.random(shape)
            return np.ones(shape)

    class Numpy:
        def __getattr__(self, name):
            return type("R", (), {"default_rng": staticmethod(Keep)}) if name == "random" else getattr(np, name)

    monkeypatch.setattr(op, "np", Numpy())
    moved = op.train(parts, labels, 1, 1)
    monkeypatch.undo()
    monkeypatch.setattr(op, "BUCKETS", 64)

    def loss():
        z = np.array([start.logits(iter([(0, p, True)]), 1)[0] for p in parts], np.float64)
        return np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z))))

    for name in ("embedding", "conv", "conv_bias", "out"):
        array, step = getattr(start, name), getattr(moved, name) - getattr(start, name)
        for i in np.argsort(-np.abs(step).ravel())[:12]:
            at, was = np.unravel_index(i, array.shape), array.flat[i]
            array[at] = was + 1e-2
            up = loss()
            array[at] = was - 1e-2
            down = loss()
            array[at] = was
            assert abs(up - down) < 1e-6 or np.sign(step[at]) == -np.sign(up - down), (name, at)


def test_a_repeated_document_is_learned_from_once(spark, tables):
    docs, labels, truth = tables
    many = docs.unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(2000)).select(docs.columns))
    one, two = op.fit_sample(docs, labels), op.fit_sample(many, labels)
    assert np.array_equal(one.embedding, two.embedding) and one.bias == two.bias


def test_the_sample_is_bounded(spark, tables, monkeypatch):
    docs, labels, truth = tables
    sizes = []
    monkeypatch.setattr(op, "fit", lambda words, toxic, langs, rate: sizes.append((len(words), int(toxic.sum()), rate)))
    op.fit_sample(docs, labels, per_class=40)
    learned = [t for i, t in truth.items() if zlib.crc32(str(i).encode()) % 5]
    assert sizes == [(80, 40, sum(learned) / len(learned))]


def test_every_labelled_document_is_learned_from(spark, tables, monkeypatch):
    """No limit by class or by length; over several shards, too; a repeated document counts once."""
    docs, labels, truth = tables
    learned = [t for i, t in truth.items() if zlib.crc32(str(i).encode()) % 5]
    rows, shards = op.labelled(docs, labels)
    assert shards == 1 and sorted(r["toxic"] for r in rows.collect()) == sorted(learned)
    monkeypatch.setattr(op, "SHARD", 200)
    many = docs.unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(50)).select(docs.columns))
    found, shards = op.labelled(many, labels)
    assert shards == 3 and found.count() == len(learned)
    one, two = op.fit_all(docs, labels), op.fit_all(many, labels)
    assert np.array_equal(one.embedding, two.embedding) and one.bias == two.bias and one.thresholds == two.thresholds
    scores = {r["doc_id"]: r["score"] for r in op.with_scores(docs, one).select("doc_id", "score").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in held]) > 0.9


def test_long_documents_are_learned_from(spark):
    """Texts of over 30,000 characters are among those that labels are learned from, and whole."""
    docs = spark.createDataFrame([(i, "word " * (7000 + i), "en", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    found = op.labelled(docs, labels)[0].selectExpr("length(text) AS n").collect()
    assert sorted(r["n"] for r in found) == [5 * (7000 + i) for i in range(20) if zlib.crc32(str(i).encode()) % 5]


def test_a_long_text_trains_as_a_whole_one(monkeypatch):
    """A step on a text in overlapping parts is the step on all of it."""
    rng = np.random.default_rng(8)
    parts = [rng.integers(0, 50, (n, 1 + len(op.STARTS))).astype(np.uint32) for n in (1, 40, 7, 100)]
    labels, trained = np.array([1.0, 0.0, 0.0, 1.0]), []
    for words in (op.WORDS, 16):
        monkeypatch.setattr(op, "WORDS", words)
        trained.append(op.train(parts, labels, 1, 1))
    assert np.allclose(trained[0].embedding, trained[1].embedding, atol=1e-5) and np.allclose(trained[0].conv, trained[1].conv, atol=1e-5)


def test_a_text_without_known_words_has_the_usual_label():
    """Whatever its unknown words are, it is scored as a text without words is, and below 0.5 where most are clean."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijk"), 5)) for _ in range(300)]
    labels = np.array([float(i % 6 == 0) for i in range(40)])
    texts = [" ".join(words[j] for j in rng.integers(0, 300, 40)) + " you scoundrel" * int(y) for y in labels]
    parts = [b.copy() for _, b, _ in op.documents_buckets(pa.array(texts, pa.large_string()))]
    model = op.fit(parts, labels, [None] * 40, labels.mean())
    scores = model.score(pa.array(["", None, *(f"{c}{c}{c}{c}{c}" * 9 for c in "mnopqrstuvwxy")], pa.large_string()))
    assert len(set(scores)) == 1 and scores[0] < 0.5
    assert model.score(pa.array(["you scoundrel"], pa.large_string()))[0] > scores[0]


@pytest.mark.parametrize("usual, cut", [(0, 0.9), (1, -0.6)])
def test_what_tells_nothing_decides_between_cuts_that_part_alike(usual, cut):
    none = op.Model(np.zeros((op.BUCKETS, op.SIZE), np.float32), np.zeros((op.SIZE, sum(op.WIDTHS) * op.FILTERS), np.float32), *np.zeros((2, len(op.WIDTHS) * op.FILTERS), np.float32), 0.3)
    found = op._with_wordless(none, np.array([-1.5, 1.5]), np.array([0, 1]), np.ones(2), usual)
    assert op.best_cut(*found) == pytest.approx(cut)
    # it doesn't outweigh a labelled text
    more = op._with_wordless(none, np.array([-1.5, 0.31, 1.5]), np.array([0, 0, 1]), np.ones(3), 1)
    assert 0.31 < op.best_cut(*more) < 1.5


def test_first_weights_leave_the_driver_for_no_task(spark, monkeypatch):
    """The tasks of the first round draw them, block by block as by one draw; what a round returns comes by one job."""
    rng = np.random.default_rng(op.SEED)
    values, squares = op.first_weights(np.random.default_rng(op.SEED))
    assert np.array_equal(values[: op.BUCKETS], rng.normal(0, 0.1, (op.BUCKETS, op.SIZE)).astype(np.float32))
    rows = spark.createDataFrame([(i % 3, int(i % 2), "a scoundrel" if i % 2 else "a friend") for i in range(60)], "shard int, toxic int, text string")
    rows = rows.repartitionById(3, "shard").sortWithinPartitions("shard")
    sent, context = [], type(spark.sparkContext)
    drawn = op.train_round(rows, 0.5, (values, squares), 1, [op.SEED, 0])
    monkeypatch.setattr(context, "broadcast", lambda *a, f=context.broadcast: sent.append(a) or f(*a))
    spark.sparkContext.setJobGroup("round", "")
    found = op.train_round(rows, 0.5, None, 1, [op.SEED, 0])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("round")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not sent and len(jobs) <= 3
    assert all(np.array_equal(a, b) for a, b in zip(found, drawn)) and not np.array_equal(found[0], values)
