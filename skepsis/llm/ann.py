"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, turned onto their principal axes, and rotated so that signs lose least (iterative
quantisation, learnt on a bounded sample).  A code is cut into substrings and the rows of a chunk are indexed by the
value of each.  If two codes differ in at most r bits, some substring differs in at most its share of them (pigeonhole:
with r = m q + a, the first a + 1 of m substrings are probed up to q bits, the others up to q - 1), so probing those
values finds every code within r.  The radius is calibrated on the sample for the recall asked for, and grows where a chunk
has found too few; candidates are ranked by exact distances of the original vectors.

Rows are dealt to chunks, query rows to blocks of the stated set; each chunk answers each block, and the chunks' best are
merged.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import hash_sample

K = 10
SAMPLE_VECTORS = 4_096
CHUNK_ROWS = 2_048
BLOCK_QUERIES = 2_048
SUBSTRINGS = 16
TARGET_RECALL = 0.97
ROUNDS = 40


class Codes:
    """Centre and rotation, the substrings' bits, and the calibrated radius."""

    def __init__(self, center: np.ndarray, turn: np.ndarray, substrings: int):
        self.center, self.turn = center, turn
        self.parts = [p for p in np.array_split(np.arange(turn.shape[1]), min(substrings, turn.shape[1])) if len(p)]
        self.radius = 0

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) @ self.turn > 0

    def values(self, bits: np.ndarray) -> np.ndarray:
        """Substring values, one column each."""
        return np.stack([bits[:, p] @ (1 << np.arange(len(p), dtype=np.int64)) for p in self.parts], 1)

    def probes(self, radius: int) -> list[np.ndarray]:
        """For every substring the changes to probe so that each code within `radius` is met."""
        q, a = divmod(radius, len(self.parts))
        out = []
        for i, p in enumerate(self.parts):
            most = min(q if i <= a else q - 1, len(p))
            out.append(np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(len(p)), k)], np.int64))
        return out


def fit(sample: np.ndarray, substrings: int = SUBSTRINGS, recall: float = TARGET_RECALL, k: int = K, rounds: int = ROUNDS, seed: int = 3) -> Codes:
    """Rotation and radius from a sample of vectors.

    The radius is the smallest at which codes keep `recall` of the true neighbours of sample vectors within the sample;
    in a larger table neighbours lie nearer, so it keeps more.
    """
    d = sample.shape[1]
    center = sample.mean(0)
    x = sample - center
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    p = x @ axes
    rot = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(p @ rot).T @ p)
        rot = (u @ v).T
    codes = Codes(center, axes @ rot, substrings)
    q = sample[:: max(1, len(sample) // 256)][:256]
    dist = (q ** 2).sum(1)[:, None] + (sample ** 2).sum(1) - 2 * q @ sample.T
    near = np.argsort(dist, 1)[:, 1:k + 1]
    bq, bs = codes.bits(q), codes.bits(sample)
    apart = (bq[:, None, :] != bs[near]).sum(2).ravel()
    codes.radius = int(np.sort(apart)[min(len(apart) - 1, math.ceil(recall * len(apart)) - 1)]) if len(apart) else d
    return codes


class Index:
    """Substring tables over the rows of one chunk."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.codes, self.ids, self.x = codes, ids[order], x[order]
        self.bits = codes.bits(self.x)
        values = codes.values(self.bits)
        self.tables = []
        for i in range(len(codes.parts)):
            rows = np.argsort(values[:, i], kind="stable")
            self.tables.append((rows, values[rows, i]))

    def within(self, bits: np.ndarray, values: np.ndarray, radius: int, probes: list[np.ndarray]) -> np.ndarray:
        """Rows whose code lies within `radius` of a query's: probed by substring, verified on the whole code."""
        hit = np.zeros(len(self.ids), bool)
        for (rows, held), value, change in zip(self.tables, values.tolist(), probes):
            for a, b in zip(np.searchsorted(held, value ^ change), np.searchsorted(held, value ^ change, "right")):
                hit[rows[a:b]] = True
        found = np.flatnonzero(hit)
        return found[(self.bits[found] != bits).sum(1) <= radius]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        """(query_id, vec_id, distance) of at most k rows per query, nearest first, ties to the smaller id."""
        bits = self.codes.bits(q)
        values, size, known = self.codes.values(bits), bits.shape[1], {}
        for i, (qid, x) in enumerate(zip(query_ids.tolist(), q)):
            others = self.ids != qid
            want = min(k, len(np.unique(self.ids[others])))
            radius = self.codes.radius
            while True:
                if radius not in known:
                    known[radius] = self.codes.probes(radius)
                rows = self.within(bits[i], values[i], radius, known[radius])
                rows = rows[others[rows]]
                if len(rows) >= want and len(np.unique(self.ids[rows])) >= want or radius >= size:
                    break
                radius = min(size, radius + 2)
            d = np.sqrt(((self.x[rows] - x) ** 2).sum(1))
            best = np.lexsort((self.ids[rows], d))
            best = best[np.sort(np.unique(self.ids[rows[best]], return_index=True)[1])[:k]]     # an id counts once
            yield from zip([qid] * len(best), self.ids[rows[best]].tolist(), d[best].tolist())


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors with an id that are neither null nor zero and hold finite numbers only, as doubles."""
    x = F.col(vector_col).cast("array<double>")
    ok = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", substrings: int = SUBSTRINGS,
           recall: float = TARGET_RECALL, sample: int = SAMPLE_VECTORS, chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's nearest found by Euclidean distance, rank from 1.

    Queries are the rows for which the column `is_query` (over vec_id) holds; candidates are all rows but those with the query's own id.
    Vectors null, empty, zero or holding null or non-finite numbers take no part, nor do vectors whose length is not that of most
    sample vectors.  Equal vectors tie to the smaller id; rows repeated under one id count once; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    drawn = [r["x"] for r in hash_sample(rows, sample, "vec_id").collect()]
    ddl = "query_id long, vec_id long, score double"
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(x) for x in drawn]
    d = max(set(sizes), key=lambda n: (sizes.count(n), n))
    codes = fit(np.array([x for x in drawn if len(x) == d]), substrings, recall, k)
    rows = rows.filter(F.size("x") == d)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    chunks, blocks = max(1, math.ceil(n["n"] / chunk_rows)), max(1, math.ceil(n["q"] / block_queries))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id"), F.monotonically_increasing_id()), F.lit(m)).cast("int")
    base = rows.select(dealt(chunks, 1).alias("chunk"), "vec_id", "x").withColumn("block", every(blocks))
    asked = rows.filter(is_query).dropDuplicates(["vec_id"]).select(dealt(blocks, 2).alias("block"), F.col("vec_id").alias("query_id"), F.col("x").alias("q")).withColumn("chunk", every(chunks))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            index = Index(codes, left["vec_id"].to_numpy(), _matrix(left["x"].combine_chunks()))
            found = list(index.search(right["query_id"].to_numpy(), _matrix(right["q"].combine_chunks()), k))
        cols = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = base.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(answer, ddl)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
