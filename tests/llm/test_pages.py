import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid, urlfilter

URLS = [
    "https://blog.thing.example.com/en/78?x=1", "http://EXAMPLE.com/en/7", "https://a.example.com/en/712#top", "https://x.example.net/de/8/1",
    "https://x.example.net/de/9", "https://other.org/es/", "https://other.org/es", "ftp://notcom/en/1", "https://xcom/en/1", "https://com/en/", None, "no scheme/en/",
    "https://host.example.com?en/", "https://host.example.com#/en/", "a://b://c/en/", "https://É.com/en/1", "https://a.com/EN/1", "https://a.com\n/en/x\ny", "://",
    "https://m.casino-win.example.org/fr/3", "https://www.plain.example.org/fr/3",
]


def plain_rule(url):
    """Host, path, rule and verdict by the definition."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, None)


def pages(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    hosts = ["www.thing", "m.alpha-beta", "blog.reading", "the.news", "good.books"]
    bad = ["casino-top", "free-bets", "cheap-pills", "spam-farm"]
    for i in range(300):
        rows.append((1000 + i, f"https://{hosts[i % 5]}{i % 7}.example.org/fr/{i}", None))
        rows.append((2000 + i, f"https://m.{bad[i % 4]}{'-x' if i % 3 else ''}.example.org/fr/{i}", None))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    found = {r["page_id"]: r for r in urlfilter.judge(pages(spark)).collect()}
    assert len(found) == len(URLS) + 600
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain_rule(url)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
        assert host or r["verdict"] == "allow"


def test_rules_are_the_contracts(spark):
    """Each rule's word as the contract lists it, also on the page that it decides on."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for v, h, p in urlfilter.RULES} == contract and len(urlfilter.RULES) == 5
    urls = ["https://a.com/en/1", "https://a.example.com/en/71", "https://a.net/de/1", "https://a.example.net/de/9", "https://a.example.net/de/81", "https://a.org/es/1"]
    more = spark.createDataFrame([(9000 + i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages(spark).unionByName(more)).collect()}
    want = ["com/en/", "example.com/en/7", "net/de/", "net/de/", "example.net/de/8", "org/es/"]
    assert [found[9000 + i] for i in range(len(urls))] == [(r, contract[r]) for r in want]


def test_models_part_the_hosts(spark):
    found = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages(spark)).collect()}
    assert np.mean([found[1000 + i] == "allow" for i in range(300)]) > 0.98
    assert np.mean([found[2000 + i] == "block" for i in range(300)]) > 0.98


def test_odd_pages(spark):
    df = pages(spark)
    assert urlfilter.judge(df.limit(0)).count() == 0
    twice = urlfilter.judge(df.unionByName(df).selectExpr("*", "1 AS host", "2 AS verdict", "3 AS path", "4 AS rule"))
    assert twice.count() == 2 * df.count() and twice.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    clean = df.filter("page_id >= 1000 AND page_id < 1500")
    assert {r["verdict"] for r in urlfilter.judge(clean).collect()} == {"allow"}


def test_every_page_counts(spark):
    """Grams and threshold are those of all rows, not of distinct forms."""
    df = urlfilter.parts(pages(spark))
    forms = spark.createDataFrame([("ab", 0, 1, 1000), ("ab", 0, 1, 5), ("b", 0, 1, 2)], "form string, rejected long, fold long, pages long")
    found = {r["gram"] % urlfilter.SYMBOLS: r["n"] for r in urlfilter.count_grams(forms.coalesce(1)).filter(f"gram >= {urlfilter.BEFORE * (32**3 + 32**2 + 32)}").collect()}
    assert found == {0: 1005, 1: 2}
    hot = df.filter("host LIKE '%casino%'")
    for _ in range(5):
        hot = hot.unionByName(hot)
    plain, more = (urlfilter.fit(urlfilter.evidence(x)).ratios for x in (df, df.unionByName(hot)))
    assert np.abs(plain - more).max() > 0.1


def symbol(c):
    """a to z, any digit, - . / and the rest."""
    c = c.lower() if c.isascii() else "?"
    return c if c in "abcdefghijklmnopqrstuvwxyz-./" else "0" if c.isdigit() else "?"


def plain_counts(rows):
    """How often each symbol follows each context of 0 to 3 symbols; ^ is before a URL."""
    counts = defaultdict(Counter)
    for text, n in rows:
        chain = "^^^" + "".join(symbol(chr(b)) if b < 128 else "?" for b in text.encode())
        for i in range(3, len(chain)):
            for k in range(4):
                counts[chain[i - k : i]][chain[i]] += n
    return counts


def plain_log(counts, context, c):
    """Witten-Bell from the empty context up."""
    p = 1 / urlfilter.SYMBOLS
    for k in range(4):
        seen = counts.get(context[3 - k :], {})
        if seen:
            p = (seen.get(c, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
    return math.log(p)


def test_models_by_brute_force(spark):
    """Evidence, counts, smoothing and the held-out threshold against plain Python."""
    df = pages(spark).unionByName(spark.createDataFrame([(9000 + i, f"https://junk{i % 3}.example.org/fr/x", "<p>!!! ### ***") for i in range(40)], "page_id long, url string, html string"))
    rows = defaultdict(int)
    for r in df.collect():
        host, path, rule, verdict = plain_rule(r["url"])
        if host:
            seeded = set(re.split("[.-]", host)) & set(urlfilter.SEEDS)
            runs = len(re.findall(r"[!*#$%]{2,}", r["html"] or ""))
            junk = runs > 0 and runs * 50 >= len(r["html"])
            rows[re.sub("[0-9]", "0", host + path), int(verdict == "block" if verdict else bool(seeded) or junk)] += 1
    forms = urlfilter.evidence(urlfilter.parts(df))
    assert {(r["form"], r["rejected"]): r["n"] for r in forms.groupBy("form", "rejected").agg(F.sum("pages").alias("n")).collect()} == dict(rows)
    fitted = urlfilter.fit(forms)
    models = [plain_counts([(t, n) for (t, bad), n in rows.items() if bad == b]) for b in (0, 1)]

    def plain_ratio(models, text):
        chain = "^^^" + "".join(symbol(chr(b)) if b < 128 else "?" for b in text.encode())
        each = [plain_log(models[1], chain[i - 3 : i], chain[i]) - plain_log(models[0], chain[i - 3 : i], chain[i]) for i in range(3, len(chain))]
        return sum(each) / len(each)

    some = sorted({t for t, _ in rows})[::7] + ["never.seen/ça"]
    assert np.allclose(urlfilter.ratios(pa.array(some), fitted.ratios), [plain_ratio(models, t) for t in some], atol=1e-4)
    # what models without a form's fold say, and the cut of the least sum of error rates
    scored = []
    for fold in range(urlfilter.FOLDS):
        mine = forms.filter(F.col("fold") == fold).collect()
        rest = forms.filter(F.col("fold") != fold).collect()
        own = [plain_counts([(r["form"], r["pages"]) for r in rest if r["rejected"] == b]) for b in (0, 1)]
        scored += [(plain_ratio(own, r["form"]), r["rejected"], r["pages"]) for r in mine]
    x, bad, n = (np.array(v) for v in zip(*scored))
    rate = lambda cut: (n[(x <= cut) & (bad == 1)].sum() / n[bad == 1].sum(), n[(x > cut) & (bad == 0)].sum() / n[bad == 0].sum())
    best = min(sum(rate(cut)) for cut in [x.min() - 1, *x])
    missed, lost = rate(fitted.threshold)
    assert missed + lost == pytest.approx(best, abs=0.02)  # scores are binned
    assert fitted.held_out == pytest.approx((1 - missed, lost), abs=0.02)


def test_model_is_a_distribution():
    """Probabilities after any context sum to one, known or not."""
    counts = np.zeros((urlfilter.SYMBOLS,) * urlfilter.ORDER)
    rng = np.random.default_rng(0)
    counts[tuple(rng.integers(0, urlfilter.SYMBOLS, (urlfilter.ORDER, 500)))] += rng.integers(1, 9, 500)
    p = np.exp(urlfilter.model(counts).astype(np.float64)).reshape(-1, urlfilter.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and (p > 0).all()


def test_ratio_by_hand():
    import pyarrow as pa

    table = np.random.default_rng(1).normal(size=urlfilter.SYMBOLS**urlfilter.ORDER).astype(np.float32)
    texts = ["ab.c/9", "", "é", "x" * 9000]
    found = urlfilter.ratios(pa.array(texts), table)
    for text, got in zip(texts, found):
        codes = [urlfilter.BEFORE] * 3 + [int(urlfilter._CODE[b]) for b in text.encode()]
        total = sum(float(table[((codes[i - 3] * 32 + codes[i - 2]) * 32 + codes[i - 1]) * 32 + codes[i]]) for i in range(3, len(codes)))
        assert got == pytest.approx(total / max(len(codes) - 3, 1), abs=1e-4)


WORDS = {"en": "the and of that house river green walk".split(), "de": "der und die nicht haus fluss wald grün".split(), "fr": "le et les dans maison rivière vert bois".split()}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang], n))


def corpora(spark):
    rng = np.random.default_rng(4)
    docs = [(i, text(lang, 40, rng), lang, f"s{lang}") for i, lang in enumerate(["en", "de", "fr"] * 40)]
    docs += [(500, None, None, None), (501, "", "en", "sen"), (502, text("de", 200_000, rng), "de", "sde"), (503, text("fr", 5, rng), None, "sfr"), (None, text("fr", 9, rng), "fr", None)]
    page = lambda lang, body, mark: f"<!DOCTYPE html><html lang='{mark}'><script>the and of</script><p>{body}</p>" if mark else f"<p>{body}</p>"
    rows = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, f"https://{lang}{i % 2}.site.example/{lang}/{i}", page(lang, text(lang, 30, rng), lang)))
    rows += [
        (500, "https://de0.site.example/x", None), (501, None, page("fr", text("fr", 30, rng), "")), (502, None, None),
        (503, "https://fr1.site.example/", page("fr", "zzz qqq", "")), (503, "https://fr1.site.example/", page("fr", "zzz qqq", "")),
        (504, "https://new.host.de/", "<p>zzz</p>"), (505, "https://en0.site.example/en/1", page("de", text("de", 60, rng), "en")),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")


def test_languages(spark):
    pages_, docs = corpora(spark)
    found = langid.identify(pages_, docs).collect()
    assert len(found) == pages_.count() + docs.count()
    by_page = {r["page_id"]: r for r in found if r["page_id"] is not None}
    by_doc = {r["doc_id"]: r for r in found if r["page_id"] is None}
    for i in range(120):
        assert by_page[i]["language"] == by_doc[i]["language"] == ["en", "de", "fr"][i % 3]
        assert 1 / 3 <= by_page[i]["confidence"] <= 1
    # no text of its own: the host's prior, the address and the text decide as far as they can
    assert by_page[500]["language"] == "de" and by_page[501]["language"] == "fr" and by_page[503]["language"] == "fr"
    assert by_page[505]["language"] == "de"  # much text against a wrong declaration
    assert by_doc[502]["language"] == "de" and by_doc[503]["language"] == "fr" and by_doc[None]["language"] == "fr"
    assert by_doc[500]["language"] in WORDS


def test_odd_tables(spark):
    pages_, docs = corpora(spark)
    assert langid.identify(pages_.limit(0), docs.limit(0)).count() == 0
    assert {r["language"] for r in langid.identify(pages_, docs.limit(0)).collect()} == {None}
    assert langid.identify(pages_.limit(0), docs).count() == docs.count()
    more = langid.identify(pages_.selectExpr("*", "1 AS host", "2 AS logs"), docs.selectExpr("*", "1 AS likelihood"))
    assert more.columns == ["doc_id", "page_id", "host", "declared", "language", "confidence"] and more.count() > 0


def test_posteriors_by_brute_force(spark):
    """The whole fusion in plain Python: word model, tables of declarations, host priors."""
    pages_, docs = corpora(spark)
    pages_, docs = pages_.filter("page_id <> 503"), docs.filter("doc_id IS NULL OR doc_id <> 502")
    names, model = langid.fit_sample(docs)
    assert names == ["de", "en", "fr"]
    counts = np.full((3, langid.BUCKETS), langid.ALPHA / 8)
    for r in docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) <= 20000").collect():
        np.add.at(counts[names.index(r["lang"])], langid.features(r["text"]), 1.0)
    assert np.allclose(model, np.log(counts / counts.sum(axis=1, keepdims=True)), atol=1e-5)

    rows = []
    for r in pages_.collect():
        url, html = r["url"] or "", r["html"] or ""
        host = url.split("://", 1)[1].split("/")[0].lower() if "://" in url else ""
        mark = re.search(r"<html lang='(..)'", html)
        part = re.search(r"://[^/]*/(?:.*/)?([a-z]{2})(?:/|$)", url)
        address = part[1] if part and part[1] in names else langid.SUFFIXES.get(host.rpartition(".")[2], "")
        text = re.sub("<script>.*?<|<[^>]*>", " ", html.replace("</script>", "<"))
        rows.append((r["page_id"], host, ".".join(host.split(".")[-2:]), host.rpartition(".")[2], mark[1] if mark else "", address, text))
    for r in docs.collect():
        rows.append((-999 if r["doc_id"] is None else -1000 - r["doc_id"], "source:" + (r["source"] or ""), "source:", "source:", None, None, r["text"] or ""))
    logs = []
    for row in rows:
        ids = langid.features(row[6])
        l = model[:, ids].astype(float).mean(axis=1) * langid.TEMPER * min(len(ids) / 3, langid.WORDS) if len(ids) else np.zeros(3)  # noqa: E741
        logs.append(l - l.max())
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    own = [soft(v) for v in logs]
    for column in (4, 5):
        value = lambda r: r[column] if r[column] in (*names, "") else "?"  # noqa: B023, E731
        table = {v: np.full(3, langid.ALPHA) for v in (*names, "", "?")}
        for r, p in zip(rows, own):
            if r[column] is not None:
                table[value(r)] = table[value(r)] + p
        total = sum(table.values())
        logs = [v if r[column] is None else v + np.log(table[value(r)] / total) for r, v in zip(rows, logs)]
    prior = (sum(own) + 1) / (len(rows) + 3)
    priors = {}
    for level in (3, 2, 1):  # suffix, domain, host
        sums = defaultdict(lambda: np.zeros(4))
        for r, p in zip(rows, own):
            sums[r[level]] += np.r_[p, 1]
        up = {r[level]: prior if level == 3 else priors[level + 1, r[level + 1]] for r in rows}
        priors |= {(level, k): (v[:3] + langid.STRENGTH * up[k]) / (v[3] + langid.STRENGTH) for k, v in sums.items()}
    want = {r[0]: soft(v + np.log(priors[1, r[1]])) for r, v in zip(rows, logs)}
    found = langid.identify(pages_, docs).collect()
    assert len(found) == len(rows)
    for r in found:
        p = want[r["page_id"] if r["page_id"] is not None else -999 if r["doc_id"] is None else -1000 - r["doc_id"]]
        assert r["confidence"] == pytest.approx(p.max(), abs=1e-6) and p[names.index(r["language"])] == pytest.approx(p.max(), abs=1e-9)


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "zz", "fr", "s"), (2, "zz", "de", "s")], "doc_id long, text string, lang string, source string")
    page = spark.createDataFrame([(1, "https://a.example/", "<p>zz")], "page_id long, url string, html string")
    assert {r["language"] for r in langid.identify(page, docs).collect()} == {"de"}


def test_more_languages_than_64(spark):
    """The rarest of 70 languages is a class and its pages and documents get it."""
    langs = [f"{a}{b}" for a in "abcdefg" for b in "qrstuvwxyz"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda i: " ".join(letters[(i * 7 + k) % 26] * 2 + letters[i % 26] + letters[i // 26] * 3 + letters[k] for k in range(12))
    docs = [(100 * i + k, words(i), lang, "s") for i, lang in enumerate(langs) for k in range(1 if i == 69 else 3)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    page = spark.createDataFrame([(1, f"https://a.example/{langs[69]}/1", f"<html lang='{langs[69]}'><p>{words(69)}</p>")], "page_id long, url string, html string")
    found = {r["page_id"] or -r["doc_id"]: r["language"] for r in langid.identify(page, docs).collect()}
    assert found[1] == found[-6900] == langs[69] and len(set(found.values())) == 70


def test_a_thousand_languages(spark):
    """The plan is that of three languages, and each language's documents and pages get it."""
    langs = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    words = lambda i: " ".join(f"{x}{langs[i]}{x}" for x in "abcdefgh")
    docs = spark.createDataFrame([(i, words(i), lang, f"s{i % 7}") for i, lang in enumerate(langs)], "doc_id long, text string, lang string, source string")
    page = spark.createDataFrame([(i, f"https://h{i % 9}.site.com/x", f"<html lang='{langs[i]}'><p>{words(i)}</p>") for i in range(0, 1000, 50)], "page_id long, url string, html string")
    found = langid.identify(page, docs)
    rows = found.collect()
    assert {r["doc_id"]: r["language"] for r in rows if r["page_id"] is None} == dict(enumerate(langs))
    assert {r["page_id"]: r["language"] for r in rows if r["page_id"] is not None} == {i: langs[i] for i in range(0, 1000, 50)}
    few = langid.identify(page, docs.filter("doc_id < 3"))
    depth = lambda df: df._jdf.queryExecution().optimizedPlan().treeString().count("\n")
    assert depth(found) == depth(few)


def test_many_rows_without_a_heavy_key_are_joined_plainly(spark):
    right = spark.createDataFrame([(k, 143) for k in range(7)], "k long, n long")
    left = spark.range(1001).selectExpr("id % 7 AS k", "id AS v")
    heavy = right.withColumn("n", F.when(F.col("k") == 0, 1001).otherwise(F.col("n")))
    for table, parts in ((right, False), (right.filter("k < 0"), False), (heavy, True)):
        found = langid._joined(left, table, "k", "n", 1001)
        assert ("Union" in found._jdf.queryExecution().optimizedPlan().toString()) == parts
        assert found.count() == (1001 if table.count() else 0)


def test_sums_by_place(spark):
    """Sums of arrays for each key, a null key, and no rows; whatever the partitions, the same."""
    rows = [(k, 2, [k or 0, 10 * i, i]) for i, k in enumerate([1, 1, None, 2, 1, None])]
    df = spark.createDataFrame(rows, "k long, n long, sums array<long>")
    for parts in (1, 6):
        found = {r["k"]: (r["n"], r["w"], r["sums"]) for r in langid._summed(df.repartition(parts), "k").collect()}
        assert found == {1: (6, 3, [3, 50, 5]), 2: (2, 1, [2, 30, 3]), None: (4, 2, [0, 70, 7])}
    assert langid._summed(df.limit(0), "k").count() == 0
    assert langid._summed(df.limit(0).drop("k")).first()["n"] is None


def test_a_suffix_of_most_hosts(spark, monkeypatch):
    """Priors don't depend on how the hot suffix and domain are joined."""
    from tidewell.llm import common

    docs = spark.createDataFrame([(i, text(lang, 20, np.random.default_rng(i)), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 5)], "doc_id long, text string, lang string, source string")
    page = spark.createDataFrame([(i, f"https://h{i % 40}.{'big' if i % 3 else f'd{i % 11}'}.com/", f"<p>{text('de', 4, np.random.default_rng(i))}") for i in range(200)], "page_id long, url string, html string")
    plain = sorted(map(tuple, langid.identify(page, docs).collect()), key=str)
    joined = []

    def halved(left, right, key, weight, total):  # the two heaviest keys are broadcast
        joined.append(key)
        heavy = [r[key] for r in right.orderBy(F.desc(weight), key).limit(2).collect()]
        hot = right.filter(F.col(key).isin(heavy)).drop(weight)
        rest = right.filter(~F.col(key).isin(heavy)).drop(weight)
        return left.join(F.broadcast(hot), key).unionByName(left.join(rest, key))

    monkeypatch.setattr(langid, "join_hot", halved)
    assert sorted(map(tuple, langid.identify(page, docs).collect()), key=str) == plain
    assert joined == ["suffix", "domain", "host"] and common.join_hot is not halved
