"""Language identification of pages and documents by Bayesian fusion of evidence.

A page's log-posterior of each language is the sum of
  - the text's log-likelihood by a naive Bayes model of its words and their ends, per
    language, tempered, since words that follow each other are no independent evidence;
  - that of the declared markup language (<html lang>), and of the language that the address
    names (a path part such as /fr/, or a country suffix), each by a table of how often
    pages of a language declare it;
  - the prior of its host, smoothed towards that of the host's domain, that towards the
    suffix's, and that towards all pages' (Dirichlet smoothing, level by level).

The word model is fitted on a bounded sample of documents of known language, about
``PER_LANGUAGE`` of each, of at most ``LONGEST`` characters, drawn by the hash of their id. The tables and
priors are grouped aggregations over all pages, weighted by the text's own posteriors,
so they need no labels; the priors reach their pages by a join on the host. A document
has no markup and no address; its source stands for the host. What is kept for each language is
an array, so no plan grows with their number; the driver and the executors hold the word model
(BUCKETS numbers of 4 bytes for each language) and two tables of the languages' number squared.

Defined results: a null or empty page has no text evidence and gets what its address and
priors say; a null URL has an empty host; without documents of any language the language
is null; ties go to the first language by code; repeated rows are judged each; an empty table
gives an empty result; other columns are left alone. Whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LIGHT, draw_limits, drawn, join_hot, materialize
from .text import pieces, rows
from .urlfilter import host

PER_LANGUAGE, LONGEST, BUCKETS = 2000, 20_000, 1 << 15
#: Of the text's log-likelihood; strength of each level of the host prior, in pages.
TEMPER, STRENGTH, ALPHA = 0.25, 8.0, 0.5
#: Parts of a page that posteriors are summed in.
GRAINS = 1 << 24
#: A text's evidence counts up to so many words' worth; all of its words are averaged.
WORDS = 200

# Country suffixes that stand for a language.
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "ru": "ru"}

MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> np.ndarray:
    """Buckets of the words of a text, of their last three characters and of their first."""
    found, known = [], {}
    for word in _WORD.findall(text.lower()):
        ids = known.get(word)
        if ids is None:
            parts = (word, "$" + word[-3:], "^" + word[:3])
            ids = known[word] = [zlib.crc32(p.encode()) % BUCKETS for p in parts]
        found += ids
    return np.array(found, np.int64)


def count_features(sample: DataFrame) -> DataFrame:
    """sample: lang, text. Returns lang, bucket, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, by = batch.slice(at, 256), {}
                for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                    by.setdefault(lang, []).append(features(text))
                for lang, found in by.items():
                    bucket, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(bucket), pa.array(n)], ["lang", "bucket", "n"])

    each = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    return each.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """All languages with documents and their word model, log-probabilities of the buckets in
    a row for each language. Only counts reach the driver, BUCKETS for each language at most."""
    sizes = {r["lang"]: r["n"] for r in docs.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, BUCKETS), np.float32)
    short = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(F.length("text") <= LONGEST)
    # a row for each language, all of which are classes of the model that the driver holds
    limits = F.broadcast(draw_limits(docs, "lang", sizes, per_language))
    chosen = short.select("doc_id", "lang", "text").join(limits, "lang").filter(drawn("doc_id"))
    sample = chosen.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    tally = count_features(sample).toArrow()
    counts = np.full((len(names), BUCKETS), ALPHA / 8)
    row = pa.compute.index_in(tally["lang"], pa.array(names, pa.string())).to_numpy()
    counts[row, tally["bucket"].to_numpy()] += tally["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def declared(html: Column) -> Column:
    """The primary code of <html lang>, in lower case, or an empty string."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def addressed(url: Column, names: list[str]) -> Column:
    """The language that a part of the path names, or else the country suffix, or ''."""
    part = F.lower(F.regexp_extract(url, r"://[^/?#]*/(?:[^?#]*/)?([A-Za-z]{2})(?:/|$|[?#])", 1))
    suffix = F.regexp_extract(host(url), r"\.([a-z]{2})$", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    own = F.when(part.isin(names), part) if names else F.lit(None)
    return F.coalesce(own, F.element_at(table, suffix), F.lit(""))


def likelihoods(text: Column, model: np.ndarray, spark: SparkSession) -> Column:
    """An array of the text's tempered log-likelihoods less the largest, one per language."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def likelihood(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), len(held.value)))
        step = max(1, (1 << 20) // max(len(held.value), 1))  # words taken at once, whatever the languages
        for i, text in enumerate(rows(texts, 64)):
            total, n = np.zeros(len(held.value)), 0
            for piece in pieces(text):
                ids = features(piece.decode(errors="replace"))
                for at in range(0, len(ids), step):
                    total += held.value[:, ids[at : at + step]].sum(axis=1, dtype=np.float64)
                n += len(ids)
            if n:
                out[i] = TEMPER * total / n * min(n / 3, WORDS)
        out -= out.max(axis=1, keepdims=True) if out.shape[1] else 0
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return likelihood(text)


def page_evidence(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """doc_id (null), page_id, host, domain, suffix, markup, address, likelihood."""
    name = host(F.col("url"))
    domain = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    text = F.regexp_replace("html", MARKUP, " ")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        "page_id",
        name.alias("host"),
        F.when(domain == "", name).otherwise(domain).alias("domain"),
        F.regexp_extract(name, r"([^.]*)$", 1).alias("suffix"),
        declared(F.col("html")).alias("markup"),
        addressed(F.col("url"), names).alias("address"),
        likelihoods(text, model, pages.sparkSession).alias("likelihood"),
    )


def document_evidence(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """The same of documents: their source is the host; nothing is declared (null)."""
    source = F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"),
        source.alias("host"), F.lit("source:").alias("domain"), F.lit("source:").alias("suffix"),
        none.alias("markup"), none.alias("address"),
        likelihoods(F.col("text"), model, docs.sparkSession).alias("likelihood"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row; named in a lambda it would be for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _softmax(logs: Column) -> Column:
    def divided(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        return _let(total, lambda t: F.transform(powers, lambda x: x / t))

    powers = _let(logs, lambda own: _let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top))))
    return _let(powers, divided)


def _shares(posterior: str) -> list[Column]:
    """n and sums of one page: its text's posterior in whole parts of GRAINS, whose sums don't depend on an order,
    so that reruns agree and ties stay ties."""
    return [F.lit(1).cast("long").alias("n"), F.transform(posterior, lambda p: F.round(p * GRAINS).cast("long")).alias("sums")]


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n, w, sums: for each group the sum of n, the number of its rows and the sums of the array
    column sums, place by place. The plan is the same for any length of the array, and places are
    summed before they move."""
    each = df.select(*keys, "n", F.posexplode("sums").alias("at", "c")).groupBy(*keys, "at")
    each = each.agg(F.sum("n").alias("n"), F.count("*").alias("w"), F.sum("c").alias("c"))
    placed = F.array_sort(F.collect_list(F.struct("at", "c")))
    whole = each.groupBy(*keys).agg(F.max("n").alias("n"), F.max("w").alias("w"), placed.alias("placed"))
    return whole.select(*keys, "n", "w", F.transform("placed", lambda x: x["c"]).alias("sums"))


def _value(column: str, names: list[str]) -> Column:
    """What is declared in column; what isn't a known language counts as "?"."""
    return F.when(F.col(column).isin([*names, ""]), F.col(column)).otherwise("?")


def declarations(found: DataFrame, column: str, names: list[str]) -> DataFrame:
    """v, given: log P(v is declared | language) for each value v, smoothed by ALPHA pages for each; an
    array over the languages. A row for each language and two more, made on the driver."""
    declared = found.filter(F.col(column).isNotNull())
    tally = _summed(declared.select(_value(column, names).alias("v"), *_shares("text")), "v").toArrow()
    kinds = [*names, "", "?"]
    counts = np.full((len(kinds), len(names)), ALPHA)
    for v, sums in zip(tally["v"].to_pylist(), tally["sums"]):
        counts[kinds.index(v)] += sums.values.to_numpy() / GRAINS
    logs = np.log(counts / counts.sum(axis=0))
    offsets = pa.array(np.arange(len(kinds) + 1, dtype=np.int32) * len(names))
    table = pa.table([pa.array(kinds), pa.ListArray.from_arrays(offsets, pa.array(logs.ravel()))], ["v", "given"])
    return found.sparkSession.createDataFrame(table)


def _joined(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """join_hot() with a stored table, whose largest weight is asked for where a key may be heavy, so that
    many rows without a heavy key are joined as few are."""
    if total <= LIGHT:
        return join_hot(left, right, key, weight, total)
    return join_hot(left, right, key, weight, total, right.agg(F.coalesce(F.max(weight), F.lit(0))).first()[0])


def host_priors(found: DataFrame, languages: int) -> tuple[DataFrame, int]:
    """host, n, prior (an array over the languages), and how many pages and documents there are. Each level
    is smoothed by the one above: (sums + STRENGTH * prior above) / (n + STRENGTH)."""
    each = found.select("host", "domain", "suffix", *_shares("text"))
    hosts = materialize(_summed(each, "host", "domain", "suffix").drop("w"), "hosts", True)
    domains = materialize(_summed(hosts, "domain", "suffix"), "domains", True)
    suffixes = materialize(_summed(domains.drop("w"), "suffix"), "suffixes", True)
    whole = _summed(suffixes.drop("w", "suffix")).first()
    every = whole["n"] or 0
    base = [(c / GRAINS + 1.0) / (every + languages) for c in whole["sums"] or [0] * languages]

    def smoothed(up: Column) -> Column:
        return F.zip_with("sums", up, lambda c, above: (c / GRAINS + STRENGTH * above) / (F.col("n") + STRENGTH))

    # a suffix such as com, or the domain of a hoster, may have most of the rows below it
    tops = suffixes.select("suffix", "w", smoothed(F.lit(base)).alias("up"))
    below = _joined(domains.withColumnRenamed("w", "hosts"), tops, "suffix", "w", domains.count())
    middle = materialize(below.select("domain", "hosts", smoothed(F.col("up")).alias("up")), "middle", True)
    priors = _joined(hosts, middle, "domain", "hosts", hosts.count()).select("host", "n", smoothed(F.col("up")).alias("prior"))
    return materialize(priors, "priors", True), every


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id or page_id, host, declared, language, confidence for each page and document."""
    names, model = fit_sample(docs)
    found = page_evidence(pages, names, model).unionByName(document_evidence(docs, model))
    if not names:
        none = F.lit(None).cast("string").alias("language")
        return found.select("doc_id", "page_id", "host", F.col("markup").alias("declared"), none, F.lit(0.0).alias("confidence"))
    found = materialize(found.withColumn("text", _softmax(F.col("likelihood"))), "evidence")
    told = found
    for column in ("markup", "address"):
        given = F.broadcast(declarations(found, column, names).withColumnsRenamed({"v": f"{column}_v", "given": f"{column}_given"}))
        told = told.join(given, _value(column, names) == F.col(f"{column}_v"), "left").drop(f"{column}_v")
    logs = F.col("likelihood")
    for column in ("markup", "address"):
        logs = F.when(F.col(column).isNull(), logs).otherwise(F.zip_with(logs, f"{column}_given", lambda a, b: a + b))
    told = told.select("doc_id", "page_id", "host", "markup", logs.alias("logs"))

    priors, every = host_priors(found, len(names))
    joined = _joined(told, priors, "host", "n", every)
    posterior = _softmax(F.zip_with("logs", "prior", lambda a, p: a + F.log(p)))
    scored = joined.withColumn("posterior", posterior)
    top = F.array_max("posterior")
    language = F.element_at(F.lit(names), F.array_position("posterior", top).cast("int"))
    return scored.select(
        "doc_id", "page_id", "host", F.col("markup").alias("declared"), language.alias("language"), top.alias("confidence")
    )
