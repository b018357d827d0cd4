"""The additive model against plain additions, brute-force cuts and held-out labels."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from skepsis.llm import gam

from .conftest import ODD, prose


def bad(i, n=90):
    t = prose(i, n)
    return [t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join(w + "%%%" for w in t.split()), " ".join(w for w in t.split()[:8] for _ in range(12))][i % 4]


@pytest.fixture(scope="module")
def model():
    texts = [prose(i, 40 + i) for i in range(300)] + [bad(i) for i in range(200)]
    return gam.fit(gam.features(texts), np.r_[np.ones(300), np.zeros(200)], rounds=30, pair_rounds=10)


def test_held_out_texts(model):
    good, poor = model.scores(gam.features([prose(5000 + i, 70) for i in range(200)])), model.scores(gam.features([bad(7000 + i) for i in range(200)]))
    assert (good >= 0.3).mean() > 0.97 and (poor < 0.3).mean() > 0.97


def test_scores_are_bin_additions(model):
    x = gam.features([prose(i, 60) for i in range(20)] + ODD)
    for row, got in zip(x, model.scores(x)):
        z = model.intercept + sum(t[sum(v >= c for c in cuts)] for t, cuts, v in zip(model.tables, model.cuts, row))
        z += sum(t[sum(row[i] >= c for c in model.coarse[i]), sum(row[j] >= c for c in model.coarse[j])] for (i, j), t in model.pairs.items())
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_best_cut_and_tree():
    rng = np.random.default_rng(0)
    for _ in range(20):
        g, h, n = rng.normal(size=9), rng.random(9) + 0.1, rng.integers(0, 20, 9)
        part = lambda a, z: g[a:z].sum() ** 2 / (h[a:z].sum() + gam.SHRINK)
        want = max([(part(0, k) + part(k, 9) - part(0, 9), k) for k in range(1, 9) if n[:k].sum() >= 10 and n[k:].sum() >= 10], default=(0.0, 0))
        gain, k = gam.best_cut(g, h, n, 10)
        if want[0] > 0:
            assert gain == pytest.approx(want[0]) and k == want[1]
        assert len(set(gam.shallow_tree(g, h, n, 3, 10))) <= 3
    assert gam.best_cut(np.ones(1), np.ones(1), np.ones(1), 1) == (0.0, 0)


def test_an_interaction_needs_a_pair():
    x = np.random.default_rng(2).random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, both = gam.fit(x, y, rounds=20, pairs=0), gam.fit(x, y, rounds=20, pairs=1)
    assert list(both.pairs) == [(0, 1)]
    assert ((both.scores(x) > 0.5) == y).mean() > 0.9 > 0.7 > ((alone.scores(x) > 0.5) == y).mean()


def test_sample_and_score(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    hot = docs.unionByName(spark.createDataFrame([(3, f"text {i}") for i in range(300)], "doc_id long, text string"), allowMissingColumns=True)
    x, y, w = gam.labelled(hot, labels, most=6)
    assert x.shape == (len(y), len(gam.FEATURES)) and (y == 0).sum() <= 6 and (y == 1).sum() <= 6 and len(w) == len(y)
    out = set(r[0] for r in docs.filter(gam.held_out()).select("doc_id").collect())
    assert out & set(range(30))
    m = gam.fit(x, y, w)
    got = gam.score(docs, m)
    assert got.count() == docs.count() and got.columns == [*[c for c in docs.columns if c != "score"], "score", "predicted"]
    assert got.filter(~F.col("score").between(0, 1) | (F.col("predicted") != (F.col("score") >= 0.3).cast("int"))).count() == 0


def test_without_labels(spark, docs, empty):
    x, y, w = gam.labelled(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    m = gam.fit(x, y, w)
    assert set(r["score"] for r in gam.score(docs, m, ["doc_id"]).collect()) == {1.0} and gam.score(empty, m).count() == 0
    assert gam.features(ODD).shape == (len(ODD), len(gam.FEATURES)) and np.isfinite(gam.features(ODD)).all() and gam.features([]).shape == (0, len(gam.FEATURES))
