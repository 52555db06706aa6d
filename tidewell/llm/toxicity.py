"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of hashed embeddings of the lower-case word and of its first
few bytes, so that unseen forms of a word share its beginning. Filters of several widths run
over the words, the maximum of each over the text goes to a logistic layer. It is trained by
Adagrad; gradients only reach the windows that were the maximum.

Labels are learned from every labelled document outside of the held-out fold, in its whole
length. They are dealt by their ids' hash to shards of about ``SHARD`` documents or ``CHARS``
characters; a task trains on a shard, beginning with the last round's weights, and each row of
weights then changes by the mean over the shards that changed it. With one shard all passes are
made at once. A quarter of the documents is kept back to calibrate, on counts of logits in
bins of 1 / ``BINS``: the score is shifted so that 0.5 separates best on it (the others count the
less, the more positives it has; of cuts that do so alike one that gives a text without known words the
usual label), and each language with enough of both classes in it gets a
threshold of its own. Scores use the text only; a language's threshold serves ``flagged`` and
the filter.

Defined results: a null or empty text is scored like a text without words; labels that are
null or other than 0 and 1 are not learned from; without labels of both classes every score
is 0; repeated rows are scored each; an empty table gives an empty result; other columns are
left alone. Whole texts are scored, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, draw_limits, drawn, freed, join_keys, materialize, release, wrapped

#: Documents and characters of a shard; passes over them at least; bins of a logit.
SHARD, CHARS, PASSES, BINS = 8192, 1 << 25, 2, 256
#: Rows of weights that are added up at once.
ROWS = 4096
#: Of fit_sample, for a caller that asks for a sample; no query does.
PER_CLASS, LONGEST = 2000, 30_000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 17, 16, 8, (1, 2, 3)
#: Beginnings of a word, in bytes, that have embeddings besides the word itself.
STARTS = (4, 5, 6, 7)
#: The documents are gone through until there were so many steps, but 40 times at most.
STEPS, BATCH, RATE, SEED = 400, 64, 0.08, 7
#: What sums of squared gradients begin with.
START = np.float32(1e-4)
#: A language has its own threshold from so many documents of either class on.
ENOUGH = 12
#: A language's threshold is at most so many logits from 0.5, as few documents set it.
MOST = 2.0
#: Bytes of text that are hashed at once; words that are scored at once.
BLOCK, WORDS = 1 << 20, 1 << 15

_PAD = max(WIDTHS) - 1
_RANDOM = np.random.default_rng(12345)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASE, _MIX, _FORM = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_FORMS = np.arange(1 + len(STARTS), dtype=np.uint64) * _FORM
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64)) * np.uint64(pow(int(base), -1, 1 << 64))


_UP = _DOWN = np.zeros(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        n = max(n, BLOCK + 4096)
        _UP, _DOWN = _powers(_BASE, n), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), n)
    return _UP, _DOWN


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: bytes of lower-case text. Returns where each word (letters, digits and bytes
    beyond ASCII) starts, and its buckets, a column for the word and one for each beginning."""
    stop = _BREAK[data]
    edge = np.diff(np.r_[True, stop, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    found = np.empty((len(start), 1 + len(STARTS)), np.uint32)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for i, most in enumerate((None, *STARTS)):
        stop_at = end if most is None else np.minimum(end, start + most)
        h = (sums[stop_at] - sums[start]) * down[start] + _FORMS[i]
        h ^= h >> np.uint64(32)
        found[:, i] = (h * _MIX) >> shift
    return start, found


def documents_buckets(texts: pa.Array):
    """Yields (row, buckets of its words, whether the row ends with them) for each row, a block
    of text at a time; a text longer than a block comes in several parts."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    buffer = lower.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(lower):
        last = max(int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1, row + 1)
        low, high = int(offsets[row]), int(offsets[last])
        if high - low <= BLOCK:
            joined, begins = data[low:high], offsets[row:last] - low
            # a text that ends in a word must not run into the next
            parts = np.insert(joined, begins[1:], 32) if len(begins) > 1 else joined
            begins = begins + np.arange(len(begins))
            start, buckets = hash_words(parts)
            cuts = np.searchsorted(start, np.r_[begins, len(parts) + 1])
            for i in range(last - row):
                yield row + i, buckets[cuts[i] : cuts[i + 1]], True
        else:
            at = low
            while at < high:
                to = min(at + BLOCK, high)
                while to < high and not _BREAK[data[to]]:
                    to += 1
                yield row, hash_words(data[at:to])[1], to == high
                at = to
        row = last


@dataclass
class Model:
    embedding: np.ndarray
    conv: np.ndarray  # SIZE x (taps of all filters, width by width)
    conv_bias: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    fitted: bool = True
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, buckets: np.ndarray) -> np.ndarray:
        """Of all filters at each word of a text, and at the padding after it."""
        words = np.zeros((len(buckets) + 2 * _PAD, SIZE), np.float32)
        words[: len(buckets)] = self.embed(buckets)
        return self.convolve(words)

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        total = self.embedding[buckets[:, 0]]
        for i in range(1, buckets.shape[1]):
            total += self.embedding[buckets[:, i]]
        return total

    def convolve(self, words: np.ndarray) -> np.ndarray:
        taps, n, at, found = words @ self.conv, len(words) - _PAD, 0, []
        for width in WIDTHS:
            total = taps[:n, at : at + FILTERS].copy()
            for k in range(1, width):
                total += taps[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            found.append(total)
            at += width * FILTERS
        return np.concatenate(found, axis=1) + self.conv_bias

    def logits(self, parts: Iterator[tuple[int, np.ndarray, bool]], n: int) -> np.ndarray:
        """One number for each of n texts, from documents_buckets(). Texts are laid end to end
        with padding between them, so that many short ones are scored at once; a long one is
        scored in overlapping parts."""
        best = np.full((n, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for held in _segments(parts):
            found, begins, _ = self.pool(held)
            np.maximum.at(best, [r for r, _, _ in held], np.maximum.reduceat(found, begins, axis=0))
        best[np.isneginf(best)] = 0
        return np.maximum(best, 0) @ self.out + self.bias

    def pool(self, held: list[tuple[int, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses of all filters over some parts of texts, where each part begins in them, and its length."""
        lengths = np.array([len(b) for _, b, _ in held])
        begins = np.cumsum(lengths + _PAD) - lengths - _PAD
        words = np.zeros((int(lengths.sum()) + _PAD * (len(held) + 1), SIZE), np.float32)
        every = np.concatenate([b for _, b, _ in held])
        words[np.arange(len(every)) + np.repeat(_PAD * np.arange(len(held)), lengths)] = self.embed(every)
        found = self.convolve(words)
        for k in range(_PAD):  # windows that begin in the padding would see the next part
            found[begins + lengths + k] = self.conv_bias
        for begin, (_, part, last) in zip(begins, held):
            if not last:  # windows that go beyond the part belong to the next one
                found[max(begin + len(part) - _PAD, begin) : begin + len(part) + _PAD] = -np.inf
        return found, begins, lengths

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(documents_buckets(texts), len(texts)).astype(np.float64), -60, 60)))


def _segments(parts: Iterator[tuple[int, np.ndarray, bool]]) -> Iterator[list[tuple[int, np.ndarray, bool]]]:
    """documents_buckets() as lists of about WORDS words; long texts come in overlapping parts."""
    held: list[tuple[int, np.ndarray, bool]] = []
    size, tail = 0, (-1, None)
    for row, buckets, last in parts:
        if row == tail[0]:
            buckets = np.concatenate([tail[1], buckets])
        for at in range(0, max(len(buckets), 1), WORDS):
            part = buckets[max(at - _PAD, 0) : at + WORDS]
            held.append((row, part, last and at + WORDS >= len(buckets)))
            size += len(part) + _PAD
            if size >= WORDS:
                yield held
                held, size = [], 0
        tail = (row, buckets[-_PAD:])
    if held:
        yield held


def _views(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Embedding, conv, conv_bias, out and bias as views of rows of SIZE numbers."""
    taps, filters = sum(WIDTHS) * FILTERS, FILTERS * len(WIDTHS)
    some = -(-filters // SIZE)
    at = np.cumsum([BUCKETS, taps, some, some])
    conv_bias, out = (rows[i : i + some].reshape(-1)[:filters] for i in at[1:3])
    return rows[:BUCKETS], rows[BUCKETS : at[1]].T, conv_bias, out, rows[at[3], :1]


def first_weights(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights before training, and of the sums of their squared gradients."""
    taps, filters = sum(WIDTHS) * FILTERS, FILTERS * len(WIDTHS)
    values = np.zeros((BUCKETS + taps + 2 * -(-filters // SIZE) + 1, SIZE), np.float32)
    embedding, conv, _, out, _ = _views(values)
    for at in range(0, BUCKETS, ROWS):  # the same numbers as by one draw, which would take 17 MB more
        embedding[at : at + ROWS] = rng.normal(0, 0.1, embedding[at : at + ROWS].shape)
    conv[:] = rng.normal(0, 0.3, conv.shape)
    out[:] = rng.normal(0, 0.3, out.shape)
    return values, np.full_like(values, START)


class Trainer:
    """A model whose weights are views of rows, and Adagrad on them."""

    def __init__(self, values: np.ndarray, squares: np.ndarray):
        self.weights, self.sums = _views(values), _views(squares)
        self.model = Model(*self.weights[:4], float(self.weights[4][0]))

    def learned(self) -> Model:
        """The model, to which words and beginnings that no step changed tell nothing."""
        self.weights[0][(self.sums[0] == START).all(axis=1)] = 0
        return self.model

    def _step(self, i: int, gradient: np.ndarray, at=slice(None)) -> None:
        self.sums[i][at] += gradient**2
        self.weights[i][at] -= RATE * gradient / np.sqrt(self.sums[i][at])

    def _peaks(self, parts: Iterator[tuple[int, np.ndarray, bool]], n: int):
        """Of each of n texts and each filter: its maximum, the buckets of that window's words and which
        of them are in the text; and whether the text has words."""
        filters, most = FILTERS * len(WIDTHS), max(WIDTHS)
        best = np.full((n, filters), -np.inf, np.float32)
        window = np.zeros((n, filters, most, 1 + len(STARTS)), np.int64)
        inside, some = np.zeros((n, filters, most), bool), np.zeros(n, bool)
        for held in _segments(parts):
            found, begins, lengths = self.model.pool(held)
            for (row, part, _), begin, size in zip(held, begins, lengths):
                if not size:
                    continue
                some[row] = True
                own = found[begin : begin + size + _PAD]
                place = own.argmax(axis=0)
                value = own[place, np.arange(filters)]
                better = value > best[row]
                best[row, better] = value[better]
                at = place[better][:, None] + np.arange(most)
                inside[row, better] = at < size
                window[row, better] = part[np.minimum(at, size - 1)]
        return best, window, inside, some

    def learn(self, parts: Iterator[tuple[int, np.ndarray, bool]], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One step on a batch of texts, of documents_buckets()."""
        model, share = self.model, weight / len(labels)
        value, window, inside, some = self._peaks(parts, len(labels))
        if not some.any():
            return
        value, window, inside = value[some], window[some], inside[some]
        tap_of = np.concatenate([np.arange(FILTERS) + sum(WIDTHS[:i]) * FILTERS for i in range(len(WIDTHS))])
        width_of = np.repeat(WIDTHS, FILTERS)
        # dropping filters at random keeps several of them in use for each cue
        keep = (value > 0) & (rng.random(value.shape) > 0.25)
        value = value * keep
        logit = np.clip(value @ model.out + model.bias, -60, 60)
        error = ((1 / (1 + np.exp(-logit)) - labels[some]) * share[some]).astype(np.float32)
        flow = error[:, None] * model.out * keep
        vectors = model.embed(window.reshape(-1, window.shape[-1])).reshape(*window.shape[:3], SIZE)
        grad_conv, where, grads = np.zeros_like(model.conv), [], []
        for k in range(max(WIDTHS)):
            used = np.flatnonzero(width_of > k)
            on = inside[:, used, k] & keep[:, used]  # not the padding behind a document
            tap, pull = tap_of[used] + k * FILTERS, flow[:, used] * on
            grad_conv[:, tap] = np.einsum("df,dfs->sf", pull, vectors[:, used, k])
            where.append(window[:, used, k][on])
            grads.append((pull[:, :, None] * model.conv[:, tap].T)[on])
        every, each = np.concatenate(where), np.concatenate(grads)
        ids, back = np.unique(every.ravel(), return_inverse=True)
        self._step(0, _sums(back, np.repeat(each, every.shape[1], axis=0), len(ids)), ids)
        self._step(1, grad_conv)
        self._step(2, flow.sum(axis=0))
        self._step(3, (error[:, None] * value).sum(axis=0))
        self._step(4, error.sum(keepdims=True))
        model.bias = float(self.weights[4][0])


def class_weights(labels: np.ndarray, rate: float) -> np.ndarray:
    """The same weight in all for each class; rate: the share of label 1."""
    return np.where(labels == 1, 0.5 / max(rate, 1e-9), 0.5 / max(1 - rate, 1e-9))


def passes(n: int, steps: int = STEPS, least: int = 1) -> int:
    """Times that n documents are gone through."""
    return max(min(-(-steps * BATCH // max(n, 1)), 40), least)


def train(parts: list[np.ndarray], labels: np.ndarray, seed: int = SEED, steps: int = STEPS) -> Model:
    """parts: the words' buckets of each document. Each class has the same weight in all."""
    rng = np.random.default_rng(seed)
    trainer = Trainer(*first_weights(rng))
    weight = class_weights(labels, labels.mean())
    for _ in range(passes(len(parts), steps)):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            trainer.learn(((i, parts[d], True) for i, d in enumerate(chosen)), labels[chosen], weight[chosen], rng)
    return trainer.learned()


def _sums(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of n groups, none of them empty."""
    if not n:
        return np.zeros((0, rows.shape[1]), np.float32)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(n))
    return np.add.reduceat(rows[order], starts, axis=0)


def _with_wordless(model: Model, logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, usual: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For best_cut(), with one text more: one that tells nothing, of the usual label. It weighs so little that it
    only decides between cuts that part the others alike."""
    none = model.logits(iter([(0, np.zeros((0, 1 + len(STARTS)), np.uint32), True)]), 1)
    return np.r_[logits, none], np.r_[labels, usual], np.r_[weight, weight.min() / 2]


def best_cut(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, prefer: float | None = None) -> float:
    """The cut of the least weighted errors: prefer, if that is one, or else in the middle of
    the widest such gap."""
    order = np.argsort(logits, kind="stable")
    x, y, w = logits[order], labels[order], weight[order]
    errors = np.r_[0, np.cumsum(np.where(y == 1, w, -w))] + w[y == 0].sum()
    edges = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1]
    gaps = np.r_[1.0, x[1:] - x[:-1], 1.0]
    errors[gaps <= 0] = np.inf
    least = np.flatnonzero(errors <= errors.min() + 1e-9)
    if prefer is not None and errors[np.searchsorted(x, prefer)] <= errors.min() + 1e-9:
        return prefer
    return float(edges[least[np.argmax(gaps[least])]])


def _words(texts: pa.Array) -> list[list[np.ndarray]]:
    parts: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for row, buckets, _ in documents_buckets(texts):
        parts[row].append(buckets.copy())
    return parts


def fit(words: list[np.ndarray], labels: np.ndarray, langs: list[str | None], positive_rate: float) -> Model:
    """Trains on three quarters and calibrates on the last, in the order given (a hash's).
    words: the buckets of each document's words. positive_rate: the share of label 1 among all labelled documents, for the calibration."""
    if not len(labels) or not 0 < labels.mean() < 1:
        none = np.zeros(0, np.float32)
        return Model(none, none, none, none, fitted=False)
    held = np.arange(len(words)) % 4 == 3
    model = train([w for w, h in zip(words, held) if not h], labels[~held])
    logits = model.logits(((i, w, True) for i, w in enumerate(words)), len(words))
    share = labels.mean()
    weight = np.where(labels == 1, positive_rate / share, (1 - positive_rate) / (1 - share))
    # where few positives were kept back one of them would decide the cut: the documents trained
    # on count, too, the less the more were kept back
    weight = np.where(held, weight, weight * ENOUGH / (ENOUGH + labels[held].sum() ** 2))
    cut = best_cut(*_with_wordless(model, logits, labels, weight, int(positive_rate > 0.5)))
    model.bias -= cut
    names = np.array([x or "" for x in langs])
    for name in sorted(set(names)):
        own = names == name
        if min(labels[own & held].sum(), (1 - labels[own & held]).sum()) >= ENOUGH:
            at = best_cut(logits[own] - cut, labels[own], weight[own], 0.0)
            model.thresholds[str(name)] = float(1 / (1 + np.exp(-np.clip(at, -MOST, MOST))))
    return model


def learned(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents that labels are learned from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != 0


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Every labelled document outside of the held-out fold, once for each id, as a stored table
    with shard, held (kept back to calibrate), toxic, lang and text; and the number of shards."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learned(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    docs = docs.filter(learned(F.col("doc_id"))).select("doc_id", "text", "lang")
    there = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars"))
    known = materialize(known.join(there, "doc_id"), "known", True)
    size = known.agg(F.count("*"), F.sum("chars")).first()
    shards = max(-(-size[0] // SHARD), -(-(size[1] or 0) // CHARS), 1)
    rows = join_keys(docs, known.drop("chars"), "doc_id", "inner")
    # one row of each id, whatever has been repeated
    some = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("d")
    many = rows.filter("n > 1").groupBy("doc_id", "toxic").agg(some).select("doc_id", "toxic", "d.text", "d.lang")
    rows = rows.filter("n = 1").select("doc_id", "toxic", "text", "lang").unionByName(many)
    part = lambda name, n: F.pmod(F.xxhash64(F.lit(name), F.col("doc_id")), F.lit(n)).cast("int")
    rows = rows.withColumn("shard", part("shard", shards)).withColumn("held", part("held", 4) == 3)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id")
    return materialize(dealt.select("shard", "held", "toxic", "lang", "text"), "labelled"), shards


def train_shard(texts: pa.ChunkedArray, labels: np.ndarray, rate: float, values: np.ndarray, squares: np.ndarray, times: int, rng: np.random.Generator) -> None:
    """Goes through a shard's texts so many times, in random order; changes values and squares."""
    trainer, weight = Trainer(values, squares), class_weights(labels, rate)
    for _ in range(times):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            some = pa.concat_arrays(texts.take(pa.array(chosen)).chunks)
            trainer.learn(documents_buckets(some), labels[chosen], weight[chosen], rng)


def _first() -> tuple[np.ndarray, np.ndarray]:
    return first_weights(np.random.default_rng(SEED))


def train_round(rows: DataFrame, rate: float, weights: tuple[np.ndarray, np.ndarray] | None, times: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """rows: shard, toxic, text, with a shard's rows together; weights: none for the first ones, which the tasks
    draw for themselves. Returns the weights after all shards were trained on. Changes are added as
    whole parts of 2 ** -30, so their order doesn't matter."""
    held = None if weights is None else rows.sparkSession.sparkContext.broadcast(weights)
    shape = SIZE

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _first() if held is None else held.value
        for table in _by_shard(batches):
            own = [x.copy() for x in start]
            labels = table["toxic"].to_numpy().astype(np.float64)
            train_shard(table["text"].cast(pa.large_string()), labels, rate, *own, times, np.random.default_rng(seed))
            del table
            delta = [x - y for x, y in zip(own, start)]
            changed = (delta[0] != 0).any(axis=1) | (delta[1] != 0).any(axis=1)
            del own
            for block, at in enumerate(range(0, len(changed), ROWS)):
                ids = np.flatnonzero(changed[at : at + ROWS]).astype(np.int32)
                if len(ids):
                    data = [ids.tobytes(), *(d[at + ids].tobytes() for d in delta)]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["block", "ids", "values", "squares"])
            del delta
            release()

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                total, n = sums.setdefault(r["block"], (np.zeros((2, ROWS, shape), np.int64), np.zeros(ROWS, np.int64)))
                ids = np.frombuffer(r["ids"], np.int32)
                for i, c in enumerate(("values", "squares")):
                    total[i, ids] += np.rint(np.frombuffer(r[c], np.float32).reshape(-1, shape) * 2.0**30).astype(np.int64)
                n[ids] += 1
        for block, (total, n) in sums.items():
            ids = np.flatnonzero(n).astype(np.int32)
            mean = (total[:, ids] / n[ids][:, None] / 2.0**30).astype(np.float32)
            data = [ids.tobytes(), mean[0].tobytes(), mean[1].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["block", "ids", "values", "squares"])

    kind = "block int, ids binary, values binary, squares binary"
    found = rows.mapInArrow(changes, kind).repartition("block").mapInArrow(means, kind)
    # as many rows as blocks, 17 MB at most, by one job: an iterator would start one for each partition
    batches = found.toArrow().to_batches()
    if held is not None:
        held.destroy()  # the driver's copy, too
    values, squares = _first() if weights is None else (x.copy() for x in weights)
    for batch in batches:
        for block, *data in zip(*(batch[c] for c in ("block", "ids", "values", "squares"))):
            ids, *change = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(data, (np.int32, np.float32, np.float32)))
            for x, y in zip((values, squares), change):
                x[ids + block.as_py() * ROWS] += y.reshape(-1, shape)
    return values, squares


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, which come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch["shard"].to_numpy()
        edges = np.flatnonzero(np.diff(shard)) + 1
        for low, high in zip([0, *edges], [*edges, len(shard)]):
            part = batch.slice(low, high - low)
            if held and len(part) and held[-1]["shard"][0] != part["shard"][0]:
                yield pa.Table.from_batches(held)
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def fit_all(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from every labelled document outside of the held-out fold."""
    rows, shards = labelled(docs, labels)
    counts = {(r["held"], r["toxic"]): r["n"] for r in rows.groupBy("held", "toxic").agg(F.count("*").alias("n")).collect()}
    positive, total = counts.get((False, 1), 0), counts.get((False, 0), 0) + counts.get((False, 1), 0)
    if not total or len({toxic for _, toxic in counts}) < 2:
        none = np.zeros(0, np.float32)
        return Model(none, none, none, none, fitted=False)
    weights = None
    times, used = passes(total, least=PASSES), rows.filter(~F.col("held")).select("shard", "toxic", "text")
    for i in range(times if shards > 1 else 1):
        weights = train_round(used, positive / total, weights, times if shards == 1 else 1, [SEED, i])
        freed(docs.sparkSession)
    model = Trainer(*weights).learned()
    del weights
    calibrate(model, rows, counts.get((True, 1), 0), int(2 * positive > total))
    discard(rows)
    release()
    return model


def calibrate(model: Model, rows: DataFrame, positives: int, usual: int) -> None:
    """Shifts the model's bias and sets its thresholds. rows: of labelled(); positives: those kept back;
    usual: the label of most documents."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.LongType())
    def bins(texts: pa.Array) -> pa.Array:
        found = held.value.logits(documents_buckets(texts.cast(pa.large_string())), len(texts))
        return pa.array(np.rint(np.clip(found.astype(np.float64), -60, 60) * BINS).astype(np.int64))

    each = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "held", "toxic", bins("text").alias("bin"))
    tally = materialize(each.groupBy("lang", "held", "toxic", "bin").agg(F.count("*").alias("n")), "tally", True)
    rest = ENOUGH / (ENOUGH + positives**2)

    def parts(found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, toxic, kept, n = (found[c].to_numpy(zero_copy_only=False) for c in ("bin", "toxic", "held", "n"))
        # where few positives were kept back one of them would decide the cut: the documents trained
        # on count, too, the less the more were kept back
        return x / BINS, toxic, np.where(kept, 1.0, rest) * n

    whole = tally.groupBy("held", "toxic", "bin").agg(F.sum("n").alias("n")).orderBy("bin", "toxic", "held").toArrow()  # 480 x BINS rows at most
    cut = best_cut(*_with_wordless(model, *parts(whole), usual))
    model.bias -= cut

    def thresholds(own: pa.Table) -> pa.Table:
        own = own.sort_by([("bin", "ascending"), ("toxic", "ascending"), ("held", "ascending")])
        x, toxic, weight = parts(own)
        at = best_cut(x - cut, toxic, weight, 0.0)
        return pa.table({"lang": own["lang"].slice(0, 1), "at": pa.array([float(1 / (1 + np.exp(-np.clip(at, -MOST, MOST))))])})

    enough = lambda toxic: F.sum(F.when(F.col("held") & (F.col("toxic") == toxic), F.col("n")).otherwise(0)) >= ENOUGH
    able = tally.groupBy("lang").agg((enough(0) & enough(1)).alias("able")).filter("able").select("lang")
    found = tally.join(able, "lang", "left_semi").groupBy("lang").applyInArrow(thresholds, "lang string, at double")
    model.thresholds = {r["lang"]: r["at"] for r in found.collect()}  # a row for each language


def fit_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    """Fits on a bounded sample of the labelled documents outside of the held-out fold: about
    per_class of each class reach the driver, and as many at most are learned from. For a quick look;
    scores and the filter are fit_all()'s."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learned(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = known.join(F.broadcast(draw_limits(known, "toxic", counts, per_class)), "toxic")
    ids = F.broadcast(ids.filter(drawn("doc_id")).select("doc_id", "toxic"))  # about 2 x per_class rows
    short = docs.filter(F.length(F.coalesce("text", F.lit(""))) <= longest).select("doc_id", "text", "lang")
    # one row of each id, whatever has been repeated
    some = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("d")
    rows = short.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(some)
    place = [F.xxhash64("doc_id"), F.col("doc_id")]
    found = rows.orderBy(*place).select(F.col("toxic").cast("double"), "d.lang", "d.text").toArrow().combine_chunks()
    toxic = found["toxic"].to_numpy()
    first = np.sort(np.r_[np.flatnonzero(toxic == 0)[:per_class], np.flatnonzero(toxic == 1)[:per_class]])
    found = found.take(first)
    rate = counts.get(1, 0) / max(sum(counts.values()), 1)
    texts = pa.concat_arrays(found["text"].cast(pa.large_string()).chunks or [pa.array([], pa.large_string())])
    toxic, langs = found["toxic"].to_numpy(), found["lang"].to_pylist()
    words = [np.concatenate(w) for w in _words(texts)]
    del found, texts
    model = fit(words, toxic, langs, rate)
    del words
    release()
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, threshold (that of the row's language) and flagged to docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts.cast(pa.large_string())))

    own = [x for lang, cut in model.thresholds.items() for x in (F.lit(lang), F.lit(cut))]
    threshold = F.lit(0.5)
    if own:
        threshold = F.coalesce(F.element_at(F.create_map(*own), F.coalesce("lang", F.lit(""))), threshold)
    return docs.withColumn("score", score("text")).withColumn("threshold", threshold).withColumn(
        "flagged", (F.col("score") >= F.col("threshold")) & F.lit(model.fitted)
    )


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; threshold and flagged by language."""
    scored = with_scores(docs.select("doc_id", "text", "lang"), fit_all(docs, labels))
    held_out = ~F.coalesce(learned(F.col("doc_id")), F.lit(True))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "threshold", "flagged")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that reach their language's threshold."""
    scored = with_scores(wrapped(docs, "text", "lang"), fit_all(docs, labels))
    return scored.filter(~F.col("flagged")).select("row.*")
