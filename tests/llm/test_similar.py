"""The pipeline's near-duplicates against the exact similarity of all pairs."""
import numpy as np
import pytest

from corpus_pipeline import CHECK, RADIUS, SIMILARITY, WORDS, drop_near_duplicates
from skepsis.llm import similar

from .conftest import prose


def shingles(text):
    w = (text or "").split()
    return {tuple(x.lower() for x in w[i:i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))} if w else set()


def plain_roots(rows):
    """Position -> smallest doc_id over links of exact similarity."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [min(groups[find(i)]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def edited():
    """Pairs by number of edits (similarity 0.95 to 0.45), a dense group, a chain of templates at about 0.7."""
    rng, rows = np.random.default_rng(5), []

    def edit(w, n):
        v = list(w)
        for at in rng.choice(len(v), n, replace=False):
            v[at] = f"edit{int(rng.integers(10 ** 9))}"
        return v
    for i in range(120):
        w = prose(i, 200).split()
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(edit(w, 1 + i % 15)))]
    w = prose(900, 150).split()
    rows += [(5000 + i, " ".join(edit(w, 2 + i % 3))) for i in range(60)]
    for i in range(12):
        w = edit(w, 6)
        rows.append((6000 + i, " ".join(w)))
    rows += [(7000, ""), (7001, None), (7002, "one word"), (7003, "One word")]
    return rows


def test_links_are_the_similar_pairs(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in similar.components(docs, SIMILARITY, WORDS, RADIUS, CHECK).collect()}
    want = dict(zip([i for i, _ in edited], plain_roots(edited)))
    assert got == want


def test_pipeline_stage_keeps_one_of_each_group(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in drop_near_duplicates(spark, docs, "").collect()} == set(plain_roots(edited))


def test_buckets_hold_nearly_all_similar_pairs():
    """Recall of the bands alone by similarity, on sets of a known one."""
    rng = np.random.default_rng(3)
    for share, least in ((0.8, 0.99), (0.85, 0.995), (0.9, 0.999)):
        hit = 0
        for _ in range(600):
            n = int(rng.integers(100, 400))
            both = round(2 * n * share / (1 + share))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n - both, dtype=np.uint64)
            k = similar.band_keys(np.stack([similar.minima(x[:n]), similar.minima(x[n - both:])]))
            hit += (k[0] == k[1]).any()
        assert hit >= least * 600


def test_repeated_and_null_ids(spark, docs):
    kept = similar.distinct_documents(docs, SIMILARITY, WORDS, RADIUS, CHECK)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(got)) and sum(i == 5 for i, _ in got) == 1 and not any(i is not None and 200 <= i < 240 for i, _ in got)


def test_empty_table(empty):
    assert similar.distinct_documents(empty, SIMILARITY, WORDS, RADIUS, CHECK).count() == 0


@pytest.mark.parametrize("size", [similar.BLOCK_HASHES, 2000])
def test_a_bucket_sends_links_and_not_its_pairs(spark, size):
    """60 sets that resemble each other below the limit, and a few above it: pairs leave no task, links do, in one block or in many."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200)
    sets = [np.unique(np.r_[base[:150], rng.integers(0, 1 << 62, 50)]) for _ in range(60)]
    for i in range(0, 30, 3):
        sets[i + 1] = np.unique(np.r_[sets[i][:-10], rng.integers(0, 1 << 62, 10)])
    want = {(i, j) for j in range(60) for i in range(j) if 10 * len(set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j]))}
    s = spark.createDataFrame([(i, 100 + i, [int(h) for h in x]) for i, x in enumerate(sets)], "node long, first long, s array<long>")
    rows = spark.createDataFrame([(k, i, len(x), i, 0, 0) for k in (7, 8) for i, x in enumerate(sets)] + [(9, 1, 200, 1, 0, 0)], "k long, node long, n int, c long, fp long, fp2 long")
    got = similar._rest(rows, s, 0.8, size).collect()
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got} == want and len(want) == 10
    assert len(got) == 2 * len(want) and all(r["link"] and (r["fa"], r["fb"]) == (100 + r["a"], 100 + r["b"]) for r in got)
