"""Main-text extraction on pages with known text; nearest neighbours against brute force."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skepsis.llm import ann, html

from .conftest import prose


@pytest.fixture(scope="module")
def model():
    texts = [prose(i, 120) for i in range(40)]
    pages = [f"<html><head><title>x</title></head><body><nav><ul><li><a href=1>{t[:9]}</a></ul></nav><article><h1>{t[:30]}</h1><p>{t}</p></article><footer>{t[:40]}</footer></body></html>" for t in texts]
    return html.fit(pages, layouts=700)


def main_text(model, page):
    b = html.blocks(page)
    return "\n".join(x.text for x, k in zip(b, model.decode(html.features(b))) if k)


def test_blocks():
    page = ("<!DOCTYPE html><head><title>no</title><style>p{}</style></head><body>a &amp;&nbsp;b<br>c<!-- <p>no</p> --><p>one <b>two\n\t three</b> &lt;x&gt;<p>four"
            "<script>var t='</p>';</script><ul><li>five<li>six</ul><td>seven</td><div>5 < 6 & 7</div><p>un<i>clos")
    assert [b.text for b in html.blocks(page)] == ["a & b c", "one two three <x>", "four", "five", "six", "seven", "5 < 6 & 7", "unclos"]
    assert html.blocks(None) == [] == html.blocks("") and html.blocks("<script>x") == [] and html.blocks("<!-- x") == []


def test_article_without_the_rest(model):
    long = [prose(500 + i, 60) for i in range(6)]
    title = long[0][:40].strip()
    page = (f"<html><head><title>T</title></head><body><div class='cookie-banner'><p>{long[5]}</p></div><header><div class=logo>Site</div><nav><a href=x>Home</a></nav></header>"
            f"<main><article><h1>{title}</h1><p>{long[1]} &eacute;</p><div class='advert'><p>{long[4]}</p></div><h2>Part</h2><p>{long[2]}</p><ul><li>{long[3]}</li></ul></article></main>"
            f"<aside class=sidebar><p>{long[4]}</p></aside><section id=comments><h3>Replies</h3><div class=comment><p>{long[5]}</p></div></section>"
            f"<form><p>{long[4]}</p><input></form><footer><p>&copy; {long[0]}</p></footer></body></html>")
    assert main_text(model, page) == "\n".join([title, long[1] + " é", "Part", long[2], long[3]])


def test_held_out_layouts(model):
    rng, texts = np.random.default_rng(77), [prose(900 + i, 90) for i in range(50)]
    wrong = total = 0
    for _ in range(200):
        page, labels = html.layout(rng, texts)
        b = html.blocks(page)
        if len(b) == len(labels):
            wrong += sum(k != int(y) for k, y in zip(model.decode(html.features(b)), labels))
            total += len(b)
    assert total > 2000 and wrong < 0.03 * total


def test_viterbi_and_gradient():
    m, rng = html.Model(), np.random.default_rng(1)
    m.w[:, :40] = rng.normal(size=(2, 40))
    m.pair, m.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    fs = [rng.integers(0, 40, 5).tolist() for _ in range(7)]
    s = m.scores(fs)
    import itertools
    value = lambda y: m.first[y[0]] + sum(s[i, k] for i, k in enumerate(y)) + sum(m.pair[a, b] for a, b in zip(y, y[1:]))
    every = list(itertools.product((0, 1), repeat=7))
    assert tuple(m.decode(fs)) == max(every, key=value)
    p = np.exp([value(y) for y in every])
    p /= p.sum()
    share, pairs = m.gradient(fs, np.zeros(7, int))
    assert share[:, 1] == pytest.approx([sum(x for x, y in zip(p, every) if y[i]) for i in range(7)])
    assert pairs[1, 0] == pytest.approx(sum(x * sum(a == 1 and b == 0 for a, b in zip(y, y[1:])) for x, y in zip(p, every)))


def texts_of(page):
    return [b.text for b in html.blocks(page)]


def test_unclosed_heads_and_embedded_text():
    assert texts_of("<html><head><title>T</title><section>Body text here</section></html>") == ["Body text here"]
    assert texts_of("<head><meta charset=x><style>p{}</style><table><tr><td>cell</table>after") == ["cell", "after"]
    assert texts_of("<head><script>a</script></head>plain words") == ["plain words"]
    assert texts_of("<p>Let <math><mi>x</mi></math> be</p><object>fallback words</object>") == ["Let x be", "fallback words"]
    assert texts_of("<p>a<noscript> b </noscript>c<svg><title>t</title><text>d</text></svg><select><option>no</select></p>") == ["a b cd"]
    assert texts_of("<p title='a>b' data-x=\"c>d\">kept</p><a href=it's>own</a>") == ["kept", "own"]
    assert texts_of("<p title=\"x\"y\">odd quote</p><p>next") == ["odd quote", "next"]


def test_hostile_pages_take_time_in_proportion():
    start = time.time()
    assert texts_of("ab" + "<b " * 350_000 + '"') == ["ab"]
    assert texts_of("<b>" * 200_000 + "<p>x</p>" * 20_000)[:2] == ["x", "x"]
    assert len(texts_of("<div>a" * 50_000)) == 50_000
    assert texts_of("<a =' <b =\" " * 50_000 + ">c") == ["c"]
    assert time.time() - start < 10


def test_extract(spark, model):
    page = f"<article><h1>Title words</h1><p>{prose(1, 50)}</p></article>"
    rows = [(1, "u", page, "clash"), (1, "u", page, "clash"), (2, None, None, None), (3, "v", "", ""), (None, "w", "<p", ""), (4, "x", "<nav>a</nav>" + page * 50, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages, model)
    assert got.columns == ["page_id", "url", "html", "text"]
    out = [(r["page_id"], r["text"]) for r in got.collect()]
    assert len(out) == 6 and out.count((1, "Title words\n" + prose(1, 50))) == 2 and (2, "") in out and (3, "") in out
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none, html.fit(html.sample(none), layouts=3)).count() == 0


def brute(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters", "copies"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    if kind == "clusters":
        x = rng.normal(size=(20, 24))[rng.integers(0, 20, 1500)] * 3 + 0.3 * x
    if kind == "copies":
        x[rng.random(1500) < 0.35] = x[0]
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(vectors, F.col("vec_id") % 100 == 0, chunk_rows=400, block_queries=7).collect()
    want = brute(rows, range(0, 1500, 100), 10)
    hits = 0
    for q, near in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {i for i, _ in near})
        for _, v, s in mine:
            assert s == pytest.approx(np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum()), abs=1e-12)
    assert hits >= 0.9 * 10 * len(want)


def test_pigeonhole_finds_every_code_in_the_radius():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 32))
    codes = ann.fit(x, substrings=5)
    index = ann.Index(codes, np.arange(800), x)
    for radius in (0, 3, 7, 11, 32):
        for q in range(0, 800, 160):
            found = index.within(index.bits[q], codes.values(index.bits[q:q + 1])[0], radius, codes.probes(radius))
            assert set(found) == set(np.flatnonzero((index.bits != index.bits[q]).sum(1) <= radius))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (None, [1.0, 1.0]), (8, [1.0, 2.5]), (8, [1.0, 2.5]), (9, [3.0, 3.0, 3.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5), (0, 2, 8, 0.5)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).count() == 0
