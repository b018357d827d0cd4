"""Collocations against plain counting, and the promise of the summaries."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skepsis.llm import collocation as c


def plain(rows, least, covered=80, top=2000):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        gone = {p[i:i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= covered * f[p[i:i + m]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed, docs=60, n=70):
    rng = np.random.default_rng(seed)
    vocab = ["a", "B", "été", "日本", "x-y", "\x1c", "d'", "The", "Q" * 50]
    rows = []
    for i in range(docs):
        words = [vocab[k] for k in np.minimum(rng.zipf(1.6, n) - 1, len(vocab) - 1)]
        rows.append((["en", "de", None, "und", ""][i % 5], "".join(w + str(rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " | ", " "], p=[.6, .1, .05, .05, .05, .05, .05, .05])) for w in words)))
    return rows + [("en", None), ("en", ""), ("de", " \t\n"), ("en", "New  York City . " * 40), ("en", "la la " * 50)]


@pytest.mark.parametrize("least,flush", [(3, 40), (9, 1 << 20)])
def test_like_plain_counting(spark, least, flush):
    rows = corpus(least)
    df = spark.createDataFrame([(lang, text, "clash", 7) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = c.collocations(df, least=least, entries=200, flush=flush)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, least)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20
    assert sorted(tuple(r) for r in c.collocations(df, least=least, top=3).collect()) == plain(rows, least, top=3)


def test_empty_tables(spark, empty):
    assert c.collocations(empty).count() == 0
    assert c.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0


def test_runs_meet_across_cuts():
    """A text cut in many runs gives the n-grams of the whole text."""
    text = b" ".join(rb"w%d" % (i * i % 13) + (b"." if i % 9 == 0 else b"") for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([b"en"]), pa.array([text])], names=["lang", "text"])

    def hashes(size):
        return sorted((n, int(h)) for lang, ids, old, words in c.token_runs(iter([batch]), size) for n, hs, new in c.grams(lang, ids, old, words) for h in hs[new])
    assert hashes(37) == hashes(1 << 20) and b"".join(c.portions(text, 11)) == text and list(c.portions(b"x" * 50, 11)) == [b"x" * 50]


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(1)
    for trial in range(20):
        keys = np.minimum(rng.zipf(1.2, 4000), 1 << 20).astype(np.uint32)
        capacity = len(keys) // 30 + 1
        parts, merged = [c.Summary(capacity) for _ in range(4)], c.Summary(capacity)
        for p, chunk in zip(parts, np.array_split(keys, 4)):
            for some in np.array_split(chunk, 7):
                p.merge(*[v.astype(t) for v, t in zip(np.unique(some, return_counts=True), (np.uint32, np.int64))])
        for p in parts:
            merged.merge(p.keys, p.counts, p.lost)
        every, n = np.unique(keys, return_counts=True)
        assert len(merged.keys) <= capacity and merged.lost <= len(keys) / (capacity + 1) < 30
        assert set(every[n >= 30]) <= set(merged.at_least(30))
        held = dict(zip(merged.keys.tolist(), merged.counts.tolist()))
        assert all(held.get(int(k), 0) <= m <= held.get(int(k), 0) + merged.lost for k, m in zip(every, n))


def test_counting_tasks_grow_with_the_text_not_with_the_files(spark):
    """A task sends its frequent phrases once, so many small tasks would send each of them many times."""
    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([("en", "to be or not to be")] * 600, "lang string, text string").repartition(5 * cores)
    size = c.text_bytes(df)
    assert size == 600 * 19 and c.gathered(df, size).rdd.getNumPartitions() == 2 * cores
    assert c.gathered(df, size, 1000).rdd.getNumPartitions() == max(2 * cores, min(5 * cores, 12))
    rows = {(r["lang"], r["phrase"]): r["n"] for r in c.frequent(df).collect()}
    assert rows["en", "to be"] == 1200 and rows["en", ""] == 3600
