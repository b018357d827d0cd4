"""SimHash near-duplicates against all pairs."""
import numpy as np
import pytest
import xxhash

from skepsis.llm import simhash

from .conftest import prose


def plain_fingerprint(text, words=3):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps: dict, radius: int) -> dict:
    """fp -> smallest id over reachable fingerprints; ids by fingerprint."""
    nodes, done = sorted(fps), {}
    for f in nodes:
        if f in done:
            continue
        todo, group = [f], {f}
        while todo:
            x = todo.pop()
            new = [y for y in nodes if y not in group and (x ^ y).bit_count() <= radius]
            group.update(new)
            todo += new
        ids = [i for x in group for i in fps[x] if i is not None]
        done.update(dict.fromkeys(group, min(ids, default=None)))
    return done


def test_fingerprint(docs):
    for r in docs.collect():
        assert simhash.fingerprint(r["text"], 3) == (plain_fingerprint(r["text"]), 0)


@pytest.mark.parametrize("radius", [2, 6])
def test_components(docs, radius):
    rows = docs.collect()
    fps = {}
    for r in rows:
        fps.setdefault(plain_fingerprint(r["text"]), []).append(r["doc_id"])
    want = plain_components(fps, radius)
    got = simhash.components(docs, radius).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in got) == sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, f, want[f]) for r in rows for f in [plain_fingerprint(r["text"])])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_links_connect_all_near_nodes(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 9), replace=False)) for b in base for _ in range(8)]
    dense = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(14) for j in range(i)]
    fps = sorted({*map(int, base), *near, *dense})
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), 0) for f in fps], "fp long, fp2 long").repartition(4)
    parts = simhash.plan(nodes, radius)
    root = {r["node"]: r["root"] for r in simhash.connected(simhash.links(nodes, radius, parts)).collect()}
    got = {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        got.setdefault(root.get(s, s), set()).add(f)
    want = {}
    for f, name in plain_components({f: [f] for f in fps}, radius).items():
        want.setdefault(name, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_links_in_two_steps(spark, monkeypatch):
    """Later links contract only the components they join; a graph of stars is written once and not contracted at all."""
    made, rng = [], np.random.default_rng(11)
    write = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: made.append(1) or write(df))
    frame = lambda rows: spark.createDataFrame([tuple(map(int, r)) for r in rows], "a long, b long")
    named = lambda df: {r["node"]: r["root"] for r in df.collect()}
    stars = [(i, i % 7) for i in range(7, 90)]
    assert named(simhash.connected(frame(stars))) == dict(stars) and len(made) == 1
    first, second = [(i, i + 1) for i in range(40)] + list(rng.integers(100, 200, (60, 2))), [(40, 150), (300, 301), (150, 150), *rng.integers(100, 320, (25, 2))]
    up = list(range(321))
    for a, b in [*first, *second]:
        low, high = sorted((up[a], up[b]))
        up = [low if x == high else x for x in up]
    want = {i: x for i, x in enumerate(up) if x != i}
    root = write(simhash.connected(frame(first)))
    assert named(simhash.merged(root, frame(second))) == want == named(simhash.connected(frame([*first, *second])))
    assert named(simhash.connected(frame([]))) == {}


def test_second_fingerprint_parts_chance_neighbours(spark):
    near = [(0b0, 0), (0b1, 0b11), (0b11, 2**63 - 1), (0b111, 2**63 - 2)]
    nodes = spark.createDataFrame(near, "fp long, fp2 long")
    parts = simhash.plan(nodes, 4)
    got = {frozenset(((r["a"], r["a2"]), (r["b"], r["b2"]))) for r in simhash.links(nodes, 4, parts, check=4).collect()}
    assert got == {frozenset(near[:2]), frozenset(near[2:])}


def test_near_copies_of_the_pipeline(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(60):
        w = prose(i, 300).split()
        rows.append((10 * i, " ".join(w)))
        for k in range(3):
            v = list(w)
            for at in rng.choice(300, 2, replace=False):
                v[at] = f"edit{int(rng.integers(10**6))}"
            rows.append((10 * i + k + 1, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    from corpus_pipeline import CHECK, RADIUS, WORDS
    kept = {r["doc_id"] for r in simhash.distinct_documents(docs, RADIUS, WORDS, CHECK).collect()}
    assert {10 * i for i in range(60)} <= kept and len(kept) <= 60 + 0.1 * 180


def test_thresholds_sum(monkeypatch):
    costs = [np.array([0, 1.0, 5.0, 50.0]), np.array([0, 2.0, 3.0, 4.0]), np.array([0, 9.0, 99.0, 999.0])]
    for total in range(-2, 4):
        ts = simhash.allocate(costs, total)
        best = min((sum(c[t + 1] for c, t in zip(costs, x)), x) for x in __import__("itertools").product(range(-1, 3), repeat=3) if sum(x) == total)
        assert sum(ts) == total and sum(c[t + 1] for c, t in zip(costs, ts)) == best[0]


def test_distinct_documents(docs):
    rows = docs.collect()
    fps = {}
    for r in rows:
        fps.setdefault(plain_fingerprint(r["text"]), []).append(r["doc_id"])
    want = plain_components(fps, 2)
    kept = simhash.distinct_documents(docs, 2, 3)
    assert kept.columns == docs.columns
    expect = {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] == want[plain_fingerprint(r["text"])]}
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == expect


def test_empty_table(empty):
    assert simhash.components(empty).count() == 0 and simhash.distinct_documents(empty).count() == 0
