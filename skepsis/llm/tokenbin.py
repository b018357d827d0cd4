"""Token-id files in Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of payload: as many ids as fit at the width that the
selector names.  Ids are coded in blocks of `BLOCK_IDS`; a block's words come first, then its escapes (raw
64-bit values too wide for any selector, each announced by a word with selector 0).  The start of every block
and of its escapes is stored, so blocks decode side by side.

A file is a Parquet file of segments; a segment is the words of whole documents, at least `SEGMENT_IDS` ids
but for the last of a task, with the documents' ids, lengths and block offsets.  Files follow each other in
ascending doc_id order (`part` numbers them), and so do segments (`no`).
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import join_small, record, slices
from .wordtok import default_vocabulary, load

BLOCK_IDS = 1024
SEGMENT_IDS = 1 << 20
END_ID = 2
# Fixed values of the format: (ids in a word, bits of each) of selectors 1 to 14; selector 0 is an escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([1] + [n for n, _ in SELECTORS] + [0], np.int64)
_AT = {n: i for i, (n, _) in enumerate(SELECTORS, 1)}
_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
_U = np.uint64


def encode(values: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets) of unsigned integers; offsets has two rows per block: its first word, its first escape.

    All blocks advance together, one word each per step; in a step every block takes the selector that holds
    the most of its next ids.
    """
    v = np.asarray(values, _U)
    n = len(v)
    blocks = -(-n // block)
    if not blocks:
        return np.zeros(0, _U), np.zeros((2, 0), np.int64)
    ends = np.minimum((np.arange(blocks) + 1) * block, n)
    padded = np.r_[v, np.zeros(60, _U)]
    small = v.max() < len(_BITS)
    bits = _BITS[padded] if small else np.frexp(padded.astype(np.float64))[1].astype(np.uint8)      # that each id needs; beyond the end, none
    who, pos, steps = np.arange(blocks), np.arange(blocks) * block, []
    while len(who):
        stop = ends[who]
        ending = bool((pos + 60 > stop).any())
        s, most = np.zeros(len(pos), np.uint8), np.zeros(len(pos), np.uint8)
        for k in range(6):
            b = bits[pos + k]
            if ending:
                b[pos + k >= stop] = 0                      # a block's last word may be part filled
            np.maximum(most, b, out=most)
            s[most <= SELECTORS[_AT[k + 1] - 1][1]] = _AT[k + 1]
        low = np.flatnonzero(most <= SELECTORS[_AT[7] - 1][1])      # few blocks have so small ids next: look further for these only
        if len(low):
            at = pos[low, None] + np.arange(60)
            far = bits[at]
            far[at >= stop[low, None]] = 0
            far = np.maximum.accumulate(far, 1)
            for k in range(_AT[7], 0, -1):
                count, width = SELECTORS[k - 1]
                s[low[far[:, count - 1] <= width]] = k
        steps.append((who, pos, s))
        pos = pos + _COUNT[s]
        on = pos < stop
        who, pos = who[on], pos[on]
    rank = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])     # a block's k-th word was found in step k
    who, pos, sel = (np.concatenate([x[i] for x in steps]) for i in range(3))
    words = sel.astype(_U) << _U(60)
    for s, (count, width) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            at = pos[rows, None] + np.arange(count)
            ids = padded[at]
            part = np.flatnonzero(at[:, -1] >= ends[who[rows]])
            ids[part] *= at[part] < ends[who[rows[part]], None]
            words[rows] |= np.bitwise_or.reduce(ids << (np.arange(count, dtype=_U) * _U(width)), 1)
    packed, escaped = np.bincount(who, minlength=blocks), np.bincount(who[sel == 0], minlength=blocks)
    size = packed + escaped
    first = np.cumsum(size) - size
    out = np.empty(size.sum(), _U)
    out[first[who] + rank] = words
    e = np.flatnonzero(sel == 0)
    if len(e):
        e = e[np.lexsort((rank[e], who[e]))]
        out[first[who[e]] + packed[who[e]] + np.arange(len(e)) - np.repeat(np.cumsum(escaped) - escaped, escaped)] = v[pos[e]]
    return out, np.stack([first, first + packed])


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The n integers of `encode`."""
    if not n:
        return np.zeros(0, _U)
    first, escapes = offsets
    packed = escapes - first
    blocks = len(first)
    who = np.repeat(np.arange(blocks), packed)
    at = np.repeat(first - (np.cumsum(packed) - packed), packed) + np.arange(len(who))
    w = words[at]
    sel = (w >> _U(60)).astype(np.int64)
    count = _COUNT[sel]
    held = np.minimum((np.arange(blocks) + 1) * block, n) - np.arange(blocks) * block
    over = np.bincount(who, count, minlength=blocks).astype(np.int64) - held
    count[np.cumsum(packed) - 1] -= over        # a block's last word may be part filled
    pos = np.cumsum(count) - count
    out = np.empty(n, _U)
    for s, (most, width) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(sel == s)
        mask = (_U(1) << _U(width)) - _U(1)
        for k in range(most if len(rows) else 0):
            rows = rows[count[rows] > k]
            if not len(rows):
                break
            out[pos[rows] + k] = (w[rows] >> _U(k * width)) & mask
    e = np.flatnonzero(sel == 0)
    if len(e):
        began = np.searchsorted(who[e], np.arange(blocks))
        out[pos[e]] = words[escapes[who[e]] + np.arange(len(e)) - began[who[e]]]
    return out


_SEGMENT = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                      ("lengths", pa.list_(pa.int64())), ("offsets", pa.binary()), ("words", pa.binary())])
_SEGMENT_DDL = "part int, no int, n_ids long, doc_ids array<long>, lengths array<long>, offsets binary, words binary"


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None,
          segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text and write the id files in ascending doc_id order.

    A null or empty text is the end id alone.  A null doc_id comes first; rows of one doc_id follow each other in the
    order of their texts; repeated rows are all written; other columns are not read; an empty table writes no segment.
    """
    file, end = vocabulary or default_vocabulary(), np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        coder, part, no = load(file), TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0

        def segment():
            words, offsets = encode(np.frombuffer(b"".join(held), "<u4"))
            return record(_SEGMENT, part=[part], no=[no], n_ids=[size], doc_ids=[docs], lengths=[lengths],
                          offsets=[offsets.astype("<i8").tobytes()], words=[words.astype("<u8").tobytes()])
        for b in slices(batches, 1024):
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1).cast(pa.binary()).to_pylist())):
                ids += end
                docs.append(doc), lengths.append(len(ids) // 4), held.append(ids)
                size += len(ids) // 4
                if size >= segment_ids:
                    yield segment()
                    no += 1
                    docs, lengths, held, size = [], [], [], 0
        if docs:
            yield segment()

    rows = docs.select("doc_id", "text")
    by = ["doc_id", "text"]
    ordered = (rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")).sortWithinPartitions(*by)
    ordered.mapInArrow(run, _SEGMENT_DDL).write.parquet(path)


_IDS = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids", pa.binary()), ("ids_crc32", pa.int64())])


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents in id files; `start` counts the ids of all
    documents before.  `ids` are little-endian unsigned 32-bit integers, null if not asked for."""
    segments = spark.read.parquet(path)

    def run(batches):
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            offsets = np.frombuffer(row["offsets"], "<i8").reshape(2, -1)
            data = decode(np.frombuffer(row["words"], "<u8"), offsets, row["n_ids"]).astype("<u4").tobytes()
            n = np.asarray(row["lengths"], np.int64)
            ends = np.cumsum(n)
            ids = [data[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())]
            many = len(ids)
            yield record(_IDS, part=[row["part"]] * many, no=[row["no"]] * many, doc_id=row["doc_ids"], first=ends - n,
                         n_tokens=n, ids=ids if with_ids else [None] * many, ids_crc32=[zlib.crc32(x) for x in ids])

    docs = segments.mapInArrow(run, "part int, no int, doc_id long, first long, n_tokens long, ids binary, ids_crc32 long")
    sizes = segments.select("part", "no", "n_ids")
    # Segments before this one in the file, then files before it: neither window holds more than one number per segment or file.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("k"))
    ahead = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    within = sizes.select("part", "no", (F.sum("n_ids").over(W.partitionBy("part").orderBy("no")) - F.col("n_ids")).alias("within"))
    many = segments.select(F.count(F.lit(1)).alias("k")).first()["k"]
    base = within.join(ahead, "part").select("part", "no", (F.col("ahead") + F.col("within")).alias("base"))
    out = join_small(docs, base, ["part", "no"], many)
    return out.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")
