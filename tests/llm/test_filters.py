"""Quality, toxicity and URL filters against plain versions and held-out labels."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skepsis.llm import quality, toxic, urls

from .conftest import ODD, prose


def plain_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def junk(i):
    return [prose(i, 90).upper().replace(" ", "!! "), prose(i, 90).replace(" ", "### "), " ".join(f"zq{j * 7919 % 10007}x{i} |" for j in range(120))][i % 3]


@pytest.fixture(scope="module")
def mixed(spark, docs):
    extra = [(1000 + i, junk(i), "xx") for i in range(6)] + [(1100 + i, f"{prose(i, 60)}\n{prose(50 + i, 40)}\n{prose(i + 1, 9)}\n{prose(i + 1, 9)}", "yy") for i in range(8)]
    return docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))


def test_base_counts(mixed):
    got = quality.judge(mixed, quality.references(mixed)).collect()
    assert len(got) == mixed.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_base(r["text"])
        assert not (r["kept"] and r["base_failed"])


def test_junk_goes_and_prose_stays(mixed):
    got = {r["doc_id"]: r for r in quality.judge(mixed, quality.references(mixed)).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(6))
    assert all(got[i]["kept"] for i in range(30) if not got[i]["base_failed"])


def test_references_count_all(mixed):
    limits = (2.0, 0, 2.0, 0, 0, 0)               # nothing is too far: the base rules alone choose
    refs = {r.language: r for r in quality.references(mixed, least=1, limits=limits)}
    for lang in ("xx", "yy"):
        texts = [r["text"] for r in mixed.filter(F.col("lang") == lang).collect() if not plain_base(r["text"])[-1]]
        words = Counter(w for t in texts for w in quality.plain_words(t.encode()))
        n = sum(words.values())
        for w, at in refs[lang].words.items():
            assert refs[lang].shares[at] == pytest.approx(words[w] / n)
        chars = quality.class_counts(texts).sum(0)
        assert refs[lang].classes == pytest.approx(chars / chars.sum()) and refs[lang].shares.sum() == pytest.approx(1)


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([0.25, 0.25, 0.5])
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    m = (p + q) / 2
    assert quality.js_distance(p[None], q)[0] == pytest.approx(math.sqrt((kl(p, m) + kl(q, m)) / 2))
    assert quality.js_distance(p[None], p)[0] == 0 and quality.js_distance(np.array([[1.0, 0]]), np.array([0, 1.0]))[0] == 1


def test_quality_of_an_empty_table(empty):
    assert quality.references(empty) == [] and quality.judge(empty, []).count() == 0


BAD = ["grobnik", "slomper", "vurtig", "quaxer"]


def toxic_text(i, n=80):
    w = prose(i, n).split()
    rng = np.random.default_rng(i)
    for k in rng.choice(len(w), 4, replace=False):
        w[k] = BAD[int(rng.integers(4))]
    return " ".join(w)


def test_toxicity_held_out():
    model = toxic.fit([toxic_text(i) for i in range(200)], [prose(1000 + i, 80) for i in range(400)])
    bad, good = model.scores([toxic_text(5000 + i) for i in range(100)]), model.scores([prose(6000 + i, 80) for i in range(200)])
    assert (bad >= 0.7).mean() > 0.9 and (good >= 0.7).mean() < 0.02
    odd = model.scores(ODD)
    assert ((0 <= odd) & (odd <= 1)).all() and (odd[:3] < 0.7).all()
    assert model.scores([]).shape == (0,)


def test_toxicity_query(spark, docs, empty):
    rows = [(i, toxic_text(i) if i % 3 == 0 else prose(i, 80), i % 3 == 0) for i in range(300)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    bad, good = toxic.labelled(table, labels)
    held = {r["doc_id"] for r in table.filter(toxic.held_out()).collect()}
    assert held == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sorted(bad + good) == sorted(t for i, t, _ in rows if i not in held)
    model = toxic.fit(bad, good)
    got = {r["doc_id"]: r for r in toxic.score(table, model, ["doc_id"]).collect()}
    assert sum(got[i]["predicted"] == int(b) for i, _, b in rows) > 285
    clash = toxic.score(docs, model)
    assert clash.count() == docs.count() and clash.columns.count("score") == 1
    assert toxic.score(empty, model).count() == 0 and toxic.labelled(empty, labels) == ([], [])
    assert not toxic.fit([], good).scores(["a b"]).any()


def test_toxicity_sample_is_of_texts(spark):
    hot, other = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(hot, f"text {i}") for i in range(400)] * 2 + [(i, f"other {i}") for i in range(300, 400)] + [(None, "x"), (other, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(hot, 1), (hot, 0), (other, 1)] + [(i, 0) for i in range(300, 400)], "doc_id long, toxic int")
    bad, good = toxic.labelled(table, labels, 30, 50)
    assert len(set(bad)) == len(bad) == 30 and all(t.startswith("text") for t in bad)       # one id of most rows stays within the bound
    assert len(set(good)) == len(good) == 50


def test_host_path(spark):
    cases = {"http://WWW.Ex.org/A/b?x#y": ("www.ex.org", "/A/b"), "https://a.com?q=/x": ("a.com", ""), "https://a.com#/x": ("a.com", ""), "a.com/x": ("", ""), None: ("", ""),
             "": ("", ""), "x://": ("", ""), "http://ÀB.de/é://z": ("Àb.de", "/é://z"), "http:///p": ("", "/p")}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    h, p = urls.host_path("url")
    assert {r["url"]: (r["h"], r["p"]) for r in df.select("url", h.alias("h"), p.alias("p")).collect()} == cases


def test_rules_and_model(spark):
    rng = np.random.default_rng(0)
    good, bad = ["news", "garden", "school"], ["casino", "spam", "pills"]
    rows = []
    for i in range(600):
        word = bad[i % 3] if i % 4 == 0 else good[i % 3]
        rows.append((i, f"http://{word}-{'abc'[i % 3]}.example.{['org', 'com', 'net'][int(rng.integers(3))]}/{['en', 'fr', 'de', 'es'][int(rng.integers(4))]}/{int(rng.integers(30))}"))
    rows += [(1000, None), (1001, "no url"), (1002, "http://x.example.org"), (1003, rows[0][1]), (None, rows[1][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = urls.judge(pages, urls.fit(*urls.labelled(pages))).collect()
    assert len(got) == len(rows)
    for r in got:
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits)[1:]
        else:
            assert r["rule"] is None
    free = [r for r in got if r["rule"] is None and r["host"]]
    assert sum((r["verdict"] == "block") == any(b in r["host"] for b in bad) for r in free) > 0.95 * len(free)
    assert {r["verdict"] for r in got if not r["host"]} == {"allow"}


def test_both_kinds_of_rejected_urls(spark):
    rows = [(i, f"http://shop.com/de/{i}") for i in range(5)] + [(9, "http://news.org/x")]
    draw = lambda more: [sorted(x) for x in urls.labelled(spark.createDataFrame(rows + more, "page_id long, url string"))]
    good, bad, weights = draw([])
    assert (good, len(bad), weights) == (["news/x"], 5, [1] * 5)
    assert draw([(10, "http://casino-a.net/q")]) == [good, sorted([*bad, "casino-a/q"]), [*weights, urls.LISTED_WEIGHT]]
    w = urls._counts(["ab", "ac"], 1, [3, 1])
    assert dict(w["a"]) == {"b": 3, "c": 1}


def test_character_model():
    m = urls.fit(["/good/page%d" % i for i in range(60)], ["/evil/page%d" % i for i in range(60)])
    assert m.score("/good/page7") > 0 > m.score("/evil/page7") and m.score("") == 0
    seen = urls._counts(["abab"], 2)
    total = sum(urls._probability(seen, "ab", c, {}, 3) for c in "ab?")
    assert total == pytest.approx(1)
    assert urls.fit([], ["x"]).score("abc") == 0


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, urls.fit(*urls.labelled(pages))).count() == 0


def test_models_count_every_labelled_url(spark):
    import math
    from pyspark.sql import functions as F
    pages = spark.range(20_500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), "id").alias("url"))
    assert urls.label_texts(pages).count() == 20_500 and len(urls.labelled(pages)[0]) == 20_500
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 3000)], "page_id long, url string")
    assert urls.label_texts(long).count() == 1

    rows = [(i, f"http://{'spam-' if i % 3 == 0 else ''}news{i % 7}.example.{'com' if i % 5 else 'org'}/{'de' if i % 2 else 'fr'}/{i * i}") for i in range(200)]
    texts = urls.label_texts(spark.createDataFrame(rows, "page_id long, url string")).withColumn("train", F.pmod(F.xxhash64("t"), F.lit(5)) != 0).collect()
    model = urls.fit_table(urls.label_texts(spark.createDataFrame(rows, "page_id long, url string")))
    train = [r for r in texts if r["train"]]
    a = urls._counts([r["t"] for r in train if r["v"] == "allow"], urls.ORDER)
    r = urls._counts([x["t"] for x in train if x["v"] != "allow"], urls.ORDER, [urls.LISTED_WEIGHT if x["v"] == "reject" else 1 for x in train if x["v"] != "allow"])
    alphabet, known, want = len({c for x in texts for c in x["t"]}) + 1, ({}, {}), {}
    for context in set(a) | set(r):
        both = a.get(context, {}), r.get(context, {})
        if not context or sum(sum(x.values()) for x in both) >= urls.LEAST:
            for c in set(both[0]) | set(both[1]):
                want[context + c] = math.log(urls._probability(a, context, c, known[0], alphabet)) - math.log(urls._probability(r, context, c, known[1], alphabet))
    assert model.ratios == pytest.approx(want, abs=1e-9)
    good = sorted(model.score(x["t"]) for x in texts if x["v"] == "allow" and not x["train"])
    assert model.threshold == min(0.0, good[int((1 - urls.KEEP_ACCEPTED) * len(good))])
    assert urls.fit_table(urls.label_texts(spark.createDataFrame([], "page_id long, url string"))).ratios == {}
    few = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://spam.net/y")], "page_id long, url string")
    assert urls.judge(few, urls.fit_table(urls.label_texts(few))).count() == 2
