"""URL filter: rules first, then a ratio of two character language models.

A rule is a host suffix with a path prefix; it fits its host and all subdomains, and of those
that fit the longest decides. What no rule fits is judged by two smoothed variable-order
Markov models of URLs, one of accepted and one of rejected: a character's probability after
the ``ORDER`` - 1 before it is mixed with that after fewer of them, by the Witten-Bell weight of
how much the longer context is known. A URL is blocked when the difference of its
log-likelihoods per character is over a threshold.

What the models learn from is weak evidence, page by page: a page is rejected if the rule that
decides on it blocks it, and accepted if that allows it; of the others those are rejected that
have a host part of ``SEEDS`` or a page full of symbols (see ``junk``). So the models carry the
rules over to URLs like those they block, and the seeds to hosts like theirs. Every row counts,
in the models and in the calibration: URLs of one form (host and path, digits alike) are scored
once and weigh as many as they are. The table of counts has at most FOLDS x 2 x SYMBOLS ** ORDER
rows however many URLs there are. The threshold is calibrated on scores by models that didn't
see the URL's fold of hosts; ``held_out`` tells how well these agree with the evidence.

Defined results: a null URL or one without "://" has an empty host and path, fits no rule and
is allowed; without both accepted and rejected forms all that no rule blocks is allowed; a null
page is no evidence; repeated rows are judged each; an empty table gives an empty result; other
columns are left alone. Whole URLs are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: (verdict, host suffix, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Host parts of pages that nobody wants, one kind of evidence.
SEEDS = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
ORDER, FOLDS, BINS = 4, 5, 4000
#: Symbols: a to z, a digit, - . / and two for any other byte and for what is before a URL.
SYMBOLS, OTHER, BEFORE = 32, 30, 31

_CODE = np.full(256, OTHER, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[65:91] = np.arange(26)
_CODE[48:58] = 26
_CODE[[45, 46, 47]] = 27, 28, 29


def host(url: Column) -> Column:
    """From after the first :// to the next / ? # or the end, with A-Z as a-z."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(found, F.lit("")), upper, upper.lower())


def path(url: Column) -> Column:
    """From the end of the host to the next ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def deciding_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    every = F.array(
        *[
            F.struct(
                F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"),
                F.lit(h).alias("host"), F.lit(p).alias("path"),
            )
            for v, h, p in rules
        ]
    )
    fits = lambda r: ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path)
    return F.array_max(F.filter(every, fits))


def junk(html: Column) -> Column:
    """Whether a page has a run of symbols for each 50 of its characters; null is no junk."""
    runs = F.regexp_count(html, F.lit(r"[!*#$%]{2,}"))
    return F.coalesce((runs > 0) & (runs * 50 >= F.length(html)), F.lit(False))


def evidence(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """pages: host, path, junk. Returns form, fold (of its host), rejected (0 or 1), pages."""
    parts = F.split("host", "[.-]")
    seeded = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in seeds]).cast("array<string>"))
    ruled = deciding_rule(F.col("host"), F.col("path"), rules).verdict == "block"
    rejected = F.coalesce(ruled, seeded | F.col("junk")).cast("long")
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS))
    form = F.regexp_replace(F.concat("host", "path"), "[0-9]", "0")
    forms = pages.filter("host <> ''").groupBy(form.alias("form"), rejected.alias("rejected"), fold.alias("fold"))
    return forms.agg(F.count("*").alias("pages"))


def symbols(texts: pa.Array, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into the table of ORDER-grams of each character, first character of each
    text), for blocks of texts."""
    for at in range(0, len(texts), block):
        values = [(x or "").encode() for x in texts.slice(at, block).to_pylist()]
        sizes = np.array([len(v) for v in values])
        codes = np.full(int(sizes.sum()) + (ORDER - 1) * len(values), BEFORE, np.int64)
        starts = np.cumsum(sizes) - sizes
        spots = np.arange(int(sizes.sum())) + np.repeat((ORDER - 1) * np.arange(1, len(values) + 1), sizes)
        codes[spots] = _CODE[np.frombuffer(b"".join(values), np.uint8)]
        index = np.zeros(len(spots), np.int64)
        for k in range(ORDER):
            index = index * SYMBOLS + codes[spots - (ORDER - 1) + k]
        yield index, starts


def count_grams(forms: DataFrame) -> DataFrame:
    """forms: form, rejected, fold, pages. Returns fold, rejected, gram, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["fold"].to_numpy() * 2 + batch["rejected"].to_numpy()
            pages = batch["pages"].to_numpy()
            grams, weights, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for index, starts in symbols(batch["form"]):
                sizes = np.diff(np.r_[starts, len(index)])
                grams.append(np.repeat(keys[at : at + len(starts)], sizes) * SYMBOLS**ORDER + index)
                weights.append(np.repeat(pages[at : at + len(starts)], sizes))
                at += len(starts)
            unique, place = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.zeros(len(unique), np.int64)
            np.add.at(n, place, np.concatenate(weights))
            key, gram = np.divmod(unique, SYMBOLS**ORDER)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key // 2, key % 2, gram, n)], ["fold", "rejected", "gram", "n"])

    each = forms.mapInArrow(count, "fold long, rejected long, gram long, n long")
    return each.groupBy("fold", "rejected", "gram").agg(F.sum("n").alias("n"))


def model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last symbol of each ORDER-gram: counts has an axis a symbol."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = counts.sum(axis=tuple(range(ORDER - order))) if order < ORDER else counts
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        total = c.sum(axis=-1, keepdims=True) + kinds
        mixed = (c + kinds * p) / np.maximum(total, 1)
        p = np.where(total > 0, mixed, np.broadcast_to(p, c.shape))
    return np.log(p).ravel().astype(np.float32)


def ratios(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean of the table over the characters of each text; 0 for an empty one."""
    found = []
    for index, starts in symbols(texts):
        sums = np.r_[0.0, np.cumsum(table[index], dtype=np.float64)]
        ends = np.r_[starts[1:], len(index)]
        found.append((sums[ends] - sums[starts]) / np.maximum(ends - starts, 1))
    return np.concatenate(found) if found else np.zeros(0)


def calibrate(scores: np.ndarray, rejected: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """The threshold of the least sum of both classes' error rates, in the middle of the
    widest range that has it; the shares of rejected and of accepted ones that are beyond it."""
    order = np.argsort(scores, kind="stable")
    x, bad, good = scores[order], (rejected * n)[order], ((1 - rejected) * n)[order]
    caught = 1 - np.r_[0, np.cumsum(bad)] / max(bad.sum(), 1)
    lost = 1 - np.r_[0, np.cumsum(good)] / max(good.sum(), 1)
    error = 1 - caught + lost
    edges = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1]
    gaps = np.r_[0, x[1:] - x[:-1], 0]
    error[1:-1][gaps[1:-1] <= 0] = np.inf
    least = np.flatnonzero(error <= error.min() + 1e-12)
    best = least[np.argmax(gaps[least])]
    return float(edges[best]), float(caught[best]), float(lost[best])


@dataclass(frozen=True)
class Filter:
    """ratios: log-probability ratio of each gram. held_out: the shares of rejected and of
    accepted pages that models which never saw their hosts' fold would block."""

    ratios: np.ndarray
    threshold: float
    held_out: tuple[float, float]


def fit(forms: DataFrame) -> Filter:
    """forms: of evidence()."""
    found = count_grams(forms).toArrow()  # FOLDS x 2 x SYMBOLS ** ORDER rows at most
    fold, bad, gram, n = (found[c].to_numpy() for c in ("fold", "rejected", "gram", "n"))
    counts = np.zeros((FOLDS, 2, SYMBOLS**ORDER))
    counts[fold, bad, gram] = n

    def table(without: int | None) -> np.ndarray:
        both = [counts[[f for f in range(FOLDS) if f != without], c].sum(axis=0) for c in (0, 1)]
        if not both[0].any() or not both[1].any():
            return np.zeros(SYMBOLS**ORDER, np.float32)
        shape = (SYMBOLS,) * ORDER
        return model(both[1].reshape(shape)) - model(both[0].reshape(shape))

    last = table(None)
    if not last.any():
        return Filter(last, np.inf, (0.0, 0.0))
    held = forms.sparkSession.sparkContext.broadcast([table(f) for f in range(FOLDS)])

    @F.arrow_udf(T.LongType())
    def bins(forms: pa.Array, folds: pa.Array) -> pa.Array:
        fold = folds.to_numpy(zero_copy_only=False)
        out = np.zeros(len(forms))
        for f in range(FOLDS):
            mine = np.flatnonzero(fold == f)
            out[mine] = ratios(forms.take(pa.array(mine)), held.value[f])
        return pa.array(np.clip(np.rint(out * BINS / 8), -BINS, BINS).astype(np.int64))

    scored = forms.withColumn("bin", bins("form", "fold")).groupBy("bin", "rejected").agg(F.sum("pages").alias("n"))
    tally = scored.toArrow()  # 4 x BINS rows at most
    at, caught, lost = calibrate(tally["bin"].to_numpy() * 8.0 / BINS, tally["rejected"].to_numpy(), tally["n"].to_numpy())
    return Filter(last, at, (caught, lost))


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and whether the page is junk."""
    return pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), junk(F.col("html")).alias("junk"))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict; ratio is what the models say."""
    forms = materialize(evidence(parts(pages), rules, seeds), "forms")
    fitted = fit(forms)
    held = pages.sparkSession.sparkContext.broadcast(fitted.ratios)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(ratios(texts, held.value))

    ruled = parts(pages).drop("junk").withColumn("__rule", deciding_rule(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("ratio", score(F.concat("host", "path")))
    own = F.when((F.col("ratio") > fitted.threshold) & (F.col("host") != ""), "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", own).alias("verdict"), "ratio",
    )
