"""Two-pass external shuffle: a uniform scatter into memory-sized buckets, then Fisher-Yates inside each.

Pass one deals every record to a bucket by a seeded hash of its position, so equal records spread like any
others and every bucket has about `bucket_bytes`.  Pass two permutes each bucket (Spark's `shuffle` is the
Fisher-Yates algorithm) and writes it once.  Buckets in order form one random permutation of the input;
shard k is the k-th of `n_shards` runs of it whose lengths differ by one at most (law `rows`).  The runs are
found from the written buckets' row counts, so what was written is never moved again.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import join_small, scratch_path

SHARD_SEED = 20_011
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64


def byte_size(text: str = "text"):
    """UTF-8 bytes plus one for the end of the record; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def write_shuffled(docs: DataFrame, path: str, text: str = "text", seed: int = SHARD_SEED,
                   bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS) -> int:
    """Write `docs` (all columns, as struct `row`) to `path` as shuffled buckets (bucket, at, row).

    Returns the number of buckets.  Any column may be null, texts may be empty or long; equal rows are kept
    apart by their position, so a repeated row can't fill a bucket.  An empty table writes no row.
    """
    total = docs.agg(F.sum(byte_size(text)).alias("b")).first()["b"] or 0
    n = max(least_buckets, math.ceil(total / bucket_bytes))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("h"))
    scattered = (rows.withColumn("bucket", F.pmod("h", F.lit(n)).cast("int")).repartition(n, "bucket")
                 .sortWithinPartitions("bucket", "h"))
    (scattered.groupBy("bucket").agg(F.shuffle(F.collect_list("row"), seed).alias("rows"))
     .select("bucket", F.posexplode("rows").alias("at", "row")).write.parquet(path))
    return n


def read_shards(spark, path: str, n_buckets: int, n_shards: int) -> DataFrame:
    """(row, shard, slot) of a written shuffle: slots are gapless from 0 in every shard."""
    written = spark.read.parquet(path)
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    by = W.orderBy("bucket")
    starts = counts.select("bucket", (F.sum("n").over(by) - F.col("n")).alias("start"),
                           F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    at = F.col("start") + F.col("at")
    placed = (join_small(written, starts, "bucket", n_buckets)
              .withColumn("place", at).withColumn("shard", F.expr(f"(place * {n_shards}) div total").cast("int")))
    first = F.expr(f"(shard * total + {n_shards} - 1) div {n_shards}")
    return placed.select("row", "shard", (F.col("place") - first).cast("bigint").alias("slot"))


def shuffled_shards(docs: DataFrame, n_shards: int = 16, **options) -> DataFrame:
    """Shuffle `docs` into `n_shards` and read it back: its own columns, then `shard` and `slot`
    (columns of `docs` with these two names give way)."""
    path = scratch_path(docs.sparkSession, "shards")
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    n = write_shuffled(docs.select(*[docs[c] for c in keep]), path, **options)
    return read_shards(docs.sparkSession, path, n, n_shards).select("row.*", "shard", "slot")
