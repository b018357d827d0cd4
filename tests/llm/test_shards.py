"""The two-pass shuffle keeps every row and shards it evenly."""
from collections import Counter

from pyspark.sql import functions as F

from skepsis.llm import shards


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["n_chars"], r["score"])


def test_rows_are_kept_and_even(docs):
    got = shards.shuffled_shards(docs, 7, bucket_bytes=2000, least_buckets=3).collect()
    assert Counter(map(key, got)) == Counter(map(key, docs.collect()))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) <= set(range(7)) and max(sizes.values()) - min(sizes.get(k, 0) for k in range(7)) <= 1
    for k, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))


def test_order_is_shuffled(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = [r["doc_id"] for r in shards.shuffled_shards(docs, 2).orderBy("shard", "slot").collect()]
    assert sorted(got) == list(range(4000))
    steps = [b - a for a, b in zip(got, got[1:])]
    assert sum(s == 1 for s in steps) < 40                              # neighbours rarely stay together
    assert abs(sum(got[:2000]) / 2000 - 1999.5) < 100                   # every shard is a sample of all rows


def test_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    got = shards.shuffled_shards(docs, 16).collect()
    assert len(got) == 3 and all(r["slot"] == 0 for r in got) and len({r["shard"] for r in got}) == 3


def test_empty_table(empty):
    assert shards.shuffled_shards(empty, 4).count() == 0


def test_byte_size(spark):
    rows = spark.createDataFrame([(None,), ("",), ("é",)], "text string").select(shards.byte_size().alias("n")).collect()
    assert [r["n"] for r in rows] == [1, 1, 3]
