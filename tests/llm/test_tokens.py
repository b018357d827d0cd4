"""Id files, byte-level BPE and packing against the tokenizers they stand for."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skepsis.llm import bpe, packing, tokenbin, wordtok


LIBRARY = None


def ids_of(text):
    """By a tokenizer that nothing here has touched."""
    global LIBRARY
    if LIBRARY is None:
        from tokenizers import Tokenizer
        LIBRARY = Tokenizer.from_file(wordtok.default_vocabulary())
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


@pytest.mark.parametrize("n", [0, 1, 59, 60, 1023, 1024, 1025, 9000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for v in (rng.integers(0, 1 << 62, n).astype(np.uint64) >> rng.integers(0, 62, n).astype(np.uint64), np.zeros(n, np.uint64),
              np.full(n, 2**64 - 1, np.uint64), rng.integers(0, 50_000, n).astype(np.uint64), np.where(np.arange(n) % 9, 7, 1 << 61).astype(np.uint64)):
        words, offsets = tokenbin.encode(v)
        assert (tokenbin.decode(words, offsets, n) == v).all()
    assert n < 1000 or len(tokenbin.encode(np.ones(n, np.uint64))[0]) <= n // 60 + n // 1024 + 2


def test_id_files(spark, docs, tmp_path):
    tokenbin.write(docs, str(tmp_path / "ids"), files=3, segment_ids=500)
    got = tokenbin.read(spark, str(tmp_path / "ids")).collect()
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got.sort(key=lambda r: r["start"])
    start = 0
    for (doc, text), r in zip(want, got, strict=True):
        ids = packed(ids_of(text))
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (doc, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_id_files_of_an_empty_table(spark, empty, tmp_path):
    tokenbin.write(empty, str(tmp_path / "ids"))
    assert tokenbin.read(spark, str(tmp_path / "ids")).count() == 0


def test_names_of_added_tokens():
    texts = ["<|endoftext|> hi", "a<|startoftext|>b. c", "<|EndOfText|> Hi <| endoftext |>", "x <|endoftext|>, Y <|ENDOFTEXT|>", "<|endoftext|>" * 3, "<|", "<|endoftext|"]
    w = wordtok.WordTokenizer(wordtok.default_vocabulary())
    assert [x + packed([2]) for x in w.encode(texts)] == [packed(ids_of(t)) for t in texts]
    assert ids_of(texts[0]) == [49407, 1883, 2]


def test_full_cache_changes_nothing():
    texts = ["some words, more Words. and more", "other words! some"]
    w = wordtok.WordTokenizer(wordtok.default_vocabulary(), most=2)
    assert [w.encode([t])[0] + packed([2]) for t in texts * 2] == [packed(ids_of(t)) for t in texts * 2]


def test_bpe_against_the_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(bpe.default_ranks()).ranks, special_tokens={})
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    encoded = bpe.encode(docs)
    for r in bpe.decode(encoded).collect():
        assert bytes(r["decoded"]).decode() in texts[r["doc_id"]]
        assert list(r["ids"]) == own.encode_ordinary(bytes(r["decoded"]).decode())
    assert encoded.count() == docs.count()


def test_bpe_boundaries_on_random_text():
    tiktoken = pytest.importorskip("tiktoken")
    import random

    import public_tokenizers as P
    coder = bpe.load(bpe.default_ranks())
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng, parts = random.Random(4), list("ab'sStTrRevVlLmd  \n\t .,!12٣éß日本́😀 \x85\x1c-_") + ["'s", "'ll", "'re", "  ", "\n\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(2000)] + ["a" * 5000, "'" * 777, " " * 999 + "x"]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == own.encode_ordinary(t), t


def test_bpe_of_an_empty_table(empty):
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_binary_lengths():
    assert packing.binary_lengths(2 * 4096 + 13, 4096) == [4096, 4096, 8, 4, 1]
    assert packing.binary_lengths(0, 4096) == [] and packing.binary_lengths(4096, 4096) == [4096]


def test_packing(docs, tmp_path):
    got = packing.pack(docs, most=64)
    rows = got.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] == r["bucket"] for r in rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        key = r["doc_id"]
        if r["start"] == 0:
            whole.setdefault(key, []).append(b"")
        assert len(whole[key][-1]) == 4 * r["start"]
        whole[key][-1] += bytes(r["ids"])
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(packed(ids_of(r["text"])))
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    packing.write_buckets(got, str(tmp_path / "packed"))
    back = got.sparkSession.read.parquet(str(tmp_path / "packed"))
    assert back.groupBy("bucket").agg(F.countDistinct("length").alias("k")).filter("k <> 1").count() == 0 and back.count() == len(rows)


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty).count() == 0


