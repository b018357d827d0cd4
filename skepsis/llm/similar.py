"""Near-duplicates by exact similarity: the Jaccard similarity of the sets of shingles.

A node is a set of shingles; texts with equal sets are one node.  Candidates come from two searches: SimHash links (`simhash.links`),
and buckets of nodes that agree in all `ROWS` minima of one of `BANDS` bands of MinHash.  A pair at a similarity of 0.8 shares no bucket with a
probability of (1 - 0.8 ** ROWS) ** BANDS = 0.0007, one at 0.85 of 0.000005.  A candidate is a link only if the similarity of the two
whole sets, counted on Spark, reaches the limit.

A bucket's nodes are checked against one of them, never all against all: `ROUNDS` times over, those still in different components meet
another one of the bucket.  What is still apart then is checked pair by pair, as far as sizes and both fingerprints allow
the similarity: no pair of a bucket is left out that could join two components.  The sets come to the bucket for that, in blocks of
bounded size, and only links leave it, as many as the components they join; so what a bucket sends grows with its nodes, not its pairs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .collocation import holds, power
from .common import extend, materialize, slices, turn_to
from .simhash import BITS, NO_ID, _majority, _remixed, connected, links, merged, plan, shingle_hashes

ROWS, BANDS = 6, 24
ROUNDS = 3
#: Differing bits of both fingerprints (128); at a similarity of 0.8 they differ in 19 on average, with a deviation of 4.
MOST_APART = 36
BLOCK_HASHES = 2 << 20      # hashes (8 bytes each) of a bucket's sets that make a block: a task holds two blocks
FEW_PAIRS = 50_000          # pairs (16 bytes each) up to which their nodes are broadcast
MOST_BITS = 1 << 28         # the filter of documents that tasks receive: 32 MB at most
ODD = np.random.default_rng(8).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the sorted set of them."""
    h = shingle_hashes(text, words)
    return h, np.unique(h)


def set_key(s: np.ndarray) -> int:
    """64 bits of a set of hashes; 0 for the empty set."""
    return int(_remixed(_remixed(s) + np.uint64(len(s))).sum(dtype=np.uint64)) if len(s) else 0


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest of the set's hashes under each of ROWS x BANDS further hashes."""
    out = np.full(len(ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        np.minimum(out, (ODD[:, None] * s[None, i:i + 256]).min(1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One key a band for rows of minima; keys of different bands differ."""
    x = _remixed(m).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for r in range(ROWS):
        key = _remixed(key ^ x[:, :, r])
    return key


def described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, fp2, sig, n, bands): both fingerprints, key, size and band keys of each text's set; no bands without a word."""
    def add(texts):
        turn_to("similar")
        f, sig, n, low = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), np.zeros((len(texts), len(ODD)), np.uint64)
        for i, t in enumerate(texts):
            h, s = shingle_set(t, words)
            if len(s):
                f[i], sig[i], n[i], low[i] = (_majority(h), _majority(_remixed(h))), set_key(s), len(s), minima(s)
        keys = band_keys(low).view(np.int64)
        f = f.view(np.int64)
        return [f[:, 0], f[:, 1], sig.view(np.int64), n, [k if c else k[:0] for k, c in zip(keys, n)]]
    return extend(docs, ["doc_id"], "text", add, StructType([StructField(c, LongType()) for c in ("fp", "fp2", "sig", "n")] + [StructField("bands", ArrayType(LongType()))]))


def _some(ids: DataFrame, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """(bitmap, its bits as a power of two) of the hashes `h` of ids: a filter of bounded size that holds them all, and others by chance.

    Each task fills the slice of its hashes; the slices, `most_bits` bits in all at most, meet on the driver.
    """
    bits = min(power(8 * max(1, ids.count())), power(most_bits))
    bits = max(bits, 16)

    def fill(batches):
        part, held = None, None
        for b in batches:
            parts, at = (b.column(c).to_numpy() for c in (0, 1))
            for p in np.unique(parts).tolist():
                if p != part:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "bits"])
                    part, held = p, np.zeros(1 << (bits - 8), np.uint8)
                held[at[parts == p]] = 1
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "bits"])
    rows = ids.select(F.shiftrightunsigned("h", 56).alias("part"), F.shiftrightunsigned("h", 64 - bits).bitwiseAND((1 << (bits - 8)) - 1).alias("at"))
    out = np.zeros((256, (1 << (bits - 8)) // 8), np.uint8)
    for r in rows.repartition("part").sortWithinPartitions("part").mapInArrow(fill, "part long, bits binary").collect():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1), bits


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, first, s): the whole sets of the given (node, first, sig), each from a text of the document that names it.

    Texts aren't shuffled: every task knows by the filter of `_some` which of its documents may be meant.
    """
    first = F.coalesce("doc_id", F.lit(NO_ID))
    bitmap, bits = _some(nodes.select(F.xxhash64("first").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches):
        for b in slices(batches, 64):
            some = b.filter(pa.array(holds(shared.value, bits, b.column(1).to_numpy().view(np.uint64))))
            s = [shingle_set(t, words)[1] for t in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([np.uint64(set_key(x)).astype(np.int64) for x in s], pa.int64()), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))],
                                             names=["first", "sig", "s"])
    made = docs.select(first.alias("first"), F.xxhash64(first).alias("h"), "text").mapInArrow(make, "first long, sig long, s array<long>")
    return nodes.join(made, ["first", "sig"]).select("node", "first", "s").dropDuplicates(["node"])


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, fa, fb, link) of distinct pairs (a, b): whether the exact similarity of their sets reaches `similarity`; fa and fb name the nodes.

    The set of a member goes to its pivot, which may have very many: that join is one that Spark splits.
    """
    if pairs.count() <= FEW_PAIRS:          # little is left: most sets stay where they are
        few = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets.join(F.broadcast(few), "node", "left_semi")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("first").alias("f" + x), F.col("s").alias("s" + x))
    both = F.size(F.array_intersect("sa", "sb"))
    return materialize(pairs.join(side("b"), "b").join(side("a"), "a").select(
        "a", "b", "fa", "fb", (both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).alias("link")))


def _pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b), a < b, of rows (node, n, other, m) whose sizes allow the similarity."""
    return (met.filter((F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9) & (F.col("node") != F.col("other")))
            .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())


RUNS = "k long, node long, n int, c long, other long, m int, oc long, edge boolean"


def stars(rows: DataFrame, order=None) -> DataFrame:
    """(k, node, n, c, other, m, oc) of rows (k, node, n, c): every node of a key that others share, beside the key's first node in `order`.

    Rows are dealt by ranges of (key, order), so that a key of very many rows lies in many tasks; a task's first and last
    key, which may go on next door, are joined with the two rows a task has of them at most.
    """
    fields = RUNS.split(", ")
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in fields])

    def batch(x, first, edge):
        return pa.RecordBatch.from_arrays([*[pa.array(v, f.type) for v, f in zip([*x, *first, np.full(len(x[0]), edge)], schema)]], schema=schema)

    def run(batches):
        held, head, pivot = None, True, None      # rows of the last key, is it the task's first key, its first row if some rows are out

        def close(rows, key_ends):
            """Rows of whole or, at the end of what was read, growing keys."""
            nonlocal head, pivot
            cut = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            length = np.diff(np.r_[cut, len(rows[0])])
            first = [np.repeat(v[cut], length) for v in rows[1:]]
            edge = np.zeros(len(rows[0]), bool)
            if head:
                edge[:length[0]] = True
            if not key_ends:
                edge[cut[-1]:] = True
            share = np.repeat(length > 1, length) | edge
            for e in (False, True):
                at = share & (edge == e)
                if at.any():
                    yield batch([v[at] for v in rows], [f[at] for f in first], e)
            head = False

        for b in batches:
            rows = [b.column(c).to_numpy() for c in range(4)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            stop = int(np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])[-1])
            if stop:
                yield from close([r[:stop] for r in rows], True)
            held = [r[stop:] for r in rows]
        if held is not None:
            yield from close(held, False)

    o = F.col("node") if order is None else order
    dealt = rows.select("k", "node", "n", "c", o.alias("o")).repartitionByRange("k", "o", "node").sortWithinPartitions("k", "o", "node").select("k", "node", "n", "c")
    found = materialize(dealt.mapInArrow(run, RUNS).withColumn("task", F.spark_partition_id()))
    inner = found.filter("not edge").drop("edge", "task")
    edges = found.filter("edge")
    by = F.struct(F.col("task"), F.col("other"), F.col("m"), F.col("oc"))
    runs = edges.groupBy("k").agg(F.min(by).alias("p"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")        # two keys a task at most
    edges = edges.select("k", "node", "n", "c").join(F.broadcast(runs), "k").select("k", "node", "n", "c", F.col("p.other").alias("other"), F.col("p.m").alias("m"), F.col("p.oc").alias("oc"))
    return inner.unionByName(edges)


def _by_key(batches, fields: int, whole):
    """What `whole` yields for the rows of each key (the first column) of sorted batches, as lists of Arrow arrays."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(c) for c in range(fields)]
        if held is not None:
            rows = [pa.concat_arrays([h, r]) for h, r in zip(held, rows)]
        k = rows[0].to_numpy()
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        for x, z in zip(cut, cut[1:]):
            yield from whole([r.slice(x, z - x) for r in rows])
        held = [r.slice(cut[-1]) for r in rows]
    if held is not None:
        yield from whole(held)


def _allowed(i: int, at: np.ndarray, n, f, g, similarity: float) -> np.ndarray:
    """Those of the rows `at` that may be similar to row i by size and both fingerprints."""
    return at[(np.minimum(n[at], n[i]) >= similarity * np.maximum(n[at], n[i]) - 1e-9) & (np.bitwise_count(f[at] ^ f[i]).astype(int) + np.bitwise_count(g[at] ^ g[i]) <= MOST_APART)]


def _met(open_: DataFrame, similarity: float) -> DataFrame:
    """Rows (k, node, n, c, fp, fp2) of nodes that may be similar to a node of another component that shares their key."""
    names = ["k", "node", "n", "c", "fp", "fp2"]

    def whole(rows):
        n, c, f, g = (r.to_numpy() for r in rows[2:])
        some = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            at = np.arange(i + 1, len(n))
            at = _allowed(i, at[c[at] != c[i]], n, f, g, similarity)
            some[at] = True
            some[i] |= len(at) > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([r.filter(pa.array(some)) for r in rows], names=names)

    rows = open_.select(*names).repartition("k").sortWithinPartitions("k", "node")
    return rows.mapInArrow(lambda batches: _by_key(batches, len(names), whole), rows.schema)


def _rest(open_: DataFrame, sets: DataFrame, similarity: float, size: int = BLOCK_HASHES) -> DataFrame:
    """(a, b, fa, fb, link): links between nodes of rows (k, node, n, c, fp, fp2) that share a key and lie in different components.

    All pairs that sizes and fingerprints allow are checked by their whole sets, unless links already found join them.
    A key's nodes are dealt over blocks of about `size` hashes, and each two blocks meet in a task.
    """
    rows = materialize(_met(open_, similarity))
    blocks = rows.groupBy("k").agg(F.ceil(F.sum("n") / F.lit(size)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (rows.join(blocks, "k").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("at", F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")))
             .select("at", "k", "node", "n", "c", "fp", "fp2", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    names = ["a", "b", "fa", "fb"]

    def whole(group):
        k, low, high = (group[x].to_numpy() for x in (1, 8, 9))
        for key in sorted(set(zip(k.tolist(), low.tolist(), high.tolist()))):          # one, unless hashes collide
            some = pa.array((k == key[0]) & (low == key[1]) & (high == key[2]))
            node, n, c, f, g, own, first = (group[x].filter(some).to_numpy() for x in (2, 3, 4, 5, 6, 7, 10))
            held = group[11].filter(some)
            ends, hashes = held.offsets.to_numpy(), held.values.to_numpy()
            each = [hashes[x:z].view(np.uint64) for x, z in zip(ends, ends[1:])]
            c, links = c.copy(), []
            for i in range(len(node) - 1):
                at = np.arange(i + 1, len(node))
                at = _allowed(i, at[(c[at] != c[i]) & ((own[at] != own[i]) | (key[1] == key[2]))], n, f, g, similarity)
                for x in range(0, len(at), 1024):
                    some_at = at[x:x + 1024]
                    lengths = np.array([len(each[j]) for j in some_at])
                    flat = np.concatenate([each[j] for j in some_at])
                    hit = each[i][np.minimum(np.searchsorted(each[i], flat), len(each[i]) - 1)] == flat
                    both = np.add.reduceat(hit, np.r_[0, np.cumsum(lengths)[:-1]], dtype=np.int64)
                    for j in some_at[both >= similarity * (len(each[i]) + lengths - both) - 1e-9].tolist():
                        if c[j] != c[i]:
                            links.append((node[i], node[j], first[i], first[j]))
                            c[c == c[j]] = c[i]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x), pa.int64()) for x in zip(*links)], names=names)

    brought = dealt.join(sets.select("node", "first", "s"), "node").select("at", "k", "node", "n", "c", "fp", "fp2", "own", "low", "high", "first", "s")
    found = brought.repartition("at").sortWithinPartitions("at", "k", "node").mapInArrow(lambda batches: _by_key(batches, 12, whole), "a long, b long, fa long, fb long")
    return materialize(found.withColumn("link", F.lit(True)))


def components(docs: DataFrame, similarity: float, words: int, radius: int, check: int) -> DataFrame:
    """(doc_id, component_id) of all documents: the smallest doc_id of those reachable over pairs of the given similarity.

    Null, empty and blank texts are one node; repeated rows are all returned; a null doc_id is a component's id only if it has no other.
    """
    rows = materialize(described(docs, words))
    key = ["fp", "fp2", "sig"]
    nodes = materialize(rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
                        .select(*key, F.coalesce("first", F.lit(NO_ID)).alias("first"), F.col("n").cast("int").alias("n"), "bands", F.monotonically_increasing_id().alias("node")))
    buckets = nodes.select(F.explode("bands").alias("k"), "node", "n", F.col("node").alias("c"))
    met = materialize(stars(buckets))

    # SimHash links are between fingerprints: the smallest node of each stands for it, buckets join the others.
    fps = materialize(nodes.filter("n > 0").groupBy("fp", "fp2").agg(F.min(F.struct("node", "n")).alias("x")).select("fp", "fp2", F.col("x.node").alias("node"), F.col("x.n").alias("n")))
    side = lambda x, node, n: fps.select(F.col("fp").alias(x), F.col("fp2").alias(x + "2"), F.col("node").alias(node), F.col("n").alias(n))
    near = materialize(links(fps, radius, plan(fps, radius), check).join(side("a", "node", "n"), ["a", "a2"]).join(side("b", "other", "m"), ["b", "b2"]).select("node", "n", "other", "m"))
    needed = met.select("node").unionByName(near.select("node")).unionByName(near.select(F.col("other").alias("node"))).distinct()
    sets = materialize(_sets(docs, nodes.select("node", "first", "sig").join(needed, "node"), words))

    def linked(done):
        """(a, b) of the links, nodes named by the smallest document."""
        a, b = (F.struct(F.col("f" + x).alias("first"), F.col(x).alias("no")) for x in "ab")
        return done.filter("link").select(a.alias("a"), b.alias("b"))

    done = _checked(_pairs(near.unionByName(met.select("node", "n", "other", "m")), similarity), sets, similarity)
    open_, root = met.select("k", "node", "n"), connected(linked(done))
    for turn in range(1, ROUNDS + 2):
        at = open_.join(root.select(F.col("node.no").alias("node"), F.col("root.no").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
        apart = at.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("k")
        open_ = materialize(at.join(apart, "k", "left_semi").select("k", "node", "n", "c"))
        if turn <= ROUNDS:
            new = stars(open_, F.xxhash64("node", F.lit(turn))).filter("c <> oc").select("node", "n", "other", "m")
            new = materialize(_pairs(new, similarity).join(done.select("a", "b"), ["a", "b"], "left_anti"))
            new = new if new.isEmpty() else _checked(new, sets, similarity)
        else:
            new = _rest(open_.join(nodes.select("node", "fp", "fp2"), "node"), sets, similarity)
        if not new.isEmpty():
            done = done.unionByName(new)
            if not linked(new).isEmpty():
                root = merged(root, linked(new))
        open_ = open_.select("k", "node", "n")
    named = nodes.select(*key, F.struct("first", F.col("node").alias("no")).alias("node")).join(root, "node", "left")
    named = named.select(*key, F.nullif(F.coalesce("root", "node")["first"], F.lit(NO_ID)).alias("component_id"))
    return rows.select("doc_id", *key).join(named, key).select("doc_id", "component_id")


def distinct_documents(docs: DataFrame, similarity: float, words: int, radius: int, check: int = BITS) -> DataFrame:
    """Rows of `docs` (all columns) whose doc_id names its component; rows repeated with the same text are kept once."""
    keep = components(docs, similarity, words, radius, check).filter("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
