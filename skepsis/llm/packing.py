"""Packing by powers of two: a document's ids are cut into pieces whose lengths are its binary digits.

Every piece is a sequence of its own, so no sequence crosses documents and none is padded; pieces of equal
length share a bucket, from which batches of one shape are drawn.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import record, slices
from .wordtok import default_vocabulary, load

MOST_TOKENS = 4096
END_ID = 2
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def binary_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n ids, longest first: full sequences, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, most: int = MOST_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset) of all documents.

    `ids` are little-endian unsigned 32-bit integers.  A null or empty text is the end id alone; repeated rows
    are packed as often as they occur; a null doc_id stays null; other columns are not read.  `bucket` is the
    length, `sequence_id` the piece's place (task, then row), unique over the result; a recomputed task
    gives the same.
    """
    if most & (most - 1):
        raise ValueError("a sequence must hold a power of two")
    path, end = vocabulary or default_vocabulary(), np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        coder = load(path)
        for b in slices(batches, 1024):
            d, s, n, t, x = [], [], [], [], []
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1).cast(pa.binary()).to_pylist())):
                ids += end
                at, total = 0, len(ids) // 4
                for k in binary_lengths(total, most):
                    d.append(doc), s.append(at), n.append(k), t.append(total), x.append(ids[4 * at:4 * (at + k)])
                    at += k
            yield record(_SCHEMA, doc_id=d, start=s, length=n, doc_tokens=t, ids=x)

    pieces = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return (pieces.withColumn("bucket", F.col("length")).withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("bigint")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, ready to be read as batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)
