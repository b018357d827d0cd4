"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts with equal fingerprints are one node.  Two nodes are linked when their 64 bits differ in at most `radius`
places.  The bits are grouped, correlated ones together, into m partitions with thresholds t_1..t_m (t = -1: the
partition isn't used) whose sum is radius - m + 1: then every linked pair differs by at most t_i within some
partition i.  A dynamic program over the partitions picks the thresholds with the lowest estimated cost, and the
cheapest m is taken.  The estimates come from counts over all nodes.

To find pairs that differ by up to t within a partition, both sides emit the partition's value with every change
of up to ceil(t / 2) bits: such a pair meets at a value half way.  Nodes that meet are verified on all 64 bits.
Each task joins what it has verified into a forest at once and gives out stars, so a dense group leaves few links for each
member, not all its pairs.

With a radius of more than a few bits, unrelated texts meet by chance once there are very many.  A second fingerprint, of the
same shingles under another hash, then has to agree as well (`check` bits): for texts of similarity 0.8 and more it nearly
always does, for others hardly ever.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import extend, materialize

BITS = 64
SHINGLE_SEED = 42
#: Runs of nodes with one key are compared shift by shift up to this length, beyond it by a search that shrinks.
LONG_RUN = 256
#: Most partitions tried.
MOST_PARTITIONS = 5
#: What one emitted row costs beside one compared pair.
ROW_COST = 30.0
ONE = np.uint64(1)
NO_ID = (1 << 63) - 1
#: Nodes that a task's forest holds before it gives them out.
MOST_TREES = 1 << 20


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _remixed(h: np.ndarray) -> np.ndarray:
    """Another hash of the same shingles: multiply and fold twice."""
    for by, odd in ((31, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
        h = (h ^ (h >> np.uint64(by))) * np.uint64(odd)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of all shingles of `words` words (repeats included), A-Z lower-cased; a text of fewer words is one shingle."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(words, len(w)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SHINGLE_SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str | None, words: int, second: bool = False) -> tuple[int, int]:
    """Majority of the bits of XXH64 over all shingles of `words` words (repeats included), A-Z lower-cased; then that of the
    second hash, 0 if not asked for.

    A text of fewer words is one shingle; without a word, fingerprints are zero.
    """
    h = shingle_hashes(text, words)
    if not len(h):
        return 0, 0
    return _majority(h), _majority(_remixed(h)) if second else 0


def fingerprints(docs: DataFrame, words: int = 3, second: bool = False) -> DataFrame:
    """(doc_id, fp, fp2): fingerprints of whole texts as signed 64-bit integers; null and empty texts have 0."""
    def add(texts):
        f = np.array([fingerprint(t, words, second) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
        return [f[:, 0], f[:, 1]]
    return extend(docs, ["doc_id"], "text", add, StructType([StructField("fp", LongType()), StructField("fp2", LongType())]))


# -- partitions and thresholds ----------------------------------------------------------------------------------------------

def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and how many of them have both of any two bits: sums over all nodes, 64 x 64 numbers a task."""
    def run(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(BITS * BITS)], pa.int32()), pa.array(np.r_[n, both.ravel()], pa.int64())], names=["at", "n"])
    rows = nodes.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BITS * BITS, np.int64)
    total = 0
    for r in rows:
        if r["at"] < 0:
            total = r["n"]
        else:
            found[r["at"]] = r["n"]
    return total, found.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size: each takes, bit by bit, the one that correlates most with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        seed = max(free, key=lambda b: (corr[b, sorted(free)].max(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            b = max(free, key=lambda x: (corr[x, group].sum(), -x))
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def differing(n: int, both: np.ndarray, group: list[int]) -> np.ndarray:
    """Estimated share of node pairs by the number of bits of the group in which they differ, bits taken as independent."""
    p = np.diag(both)[group] / max(n, 1)
    out = np.array([1.0])
    for d in 2 * p * (1 - p):
        out = np.convolve(out, [1 - d, d])
    return out


def emit_keys(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(p, k, fp, fp2): for every partition p, each value k that a node's bits take with up to parts[p][1] of them changed."""
    masks = [np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(len(g)), n)], np.uint64) for g, most in parts]

    def emit(batches):
        for b in batches:
            fp, fp2 = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for p, ((g, _), mask) in enumerate(zip(parts, masks)):
                v = np.zeros(len(fp), np.uint64)
                for i, bit in enumerate(g):
                    v |= ((fp >> np.uint64(bit)) & ONE) << np.uint64(i)
                step = max(1, (1 << 18) // len(mask))
                for i in range(0, len(fp), step):
                    key = (v[i:i + step, None] ^ mask[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int8)), pa.array(key.view(np.int64)),
                                                      pa.array(np.repeat(fp[i:i + step], len(mask)).view(np.int64)), pa.array(np.repeat(fp2[i:i + step], len(mask)))],
                                                     names=["p", "k", "fp", "fp2"])

    return nodes.select("fp", "fp2").mapInArrow(emit, "p byte, k long, fp long, fp2 long")


def allocate(costs: list[np.ndarray], total: int) -> list[int]:
    """Thresholds of least cost with the given sum; costs[i][t + 1] is partition i's cost at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, len(c) - 1):
                x = (cost + c[t + 1], ts + [t])
                if s + t not in step or x[0] < step[s + t][0]:
                    step[s + t] = x
        best = step
    return best[total][1] if total in best else []


def plan(nodes: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use."""
    n, both = bit_statistics(nodes)
    tried = {m: group_bits(n, both, m) for m in range(1, min(radius + 1, MOST_PARTITIONS) + 1)}
    # Pairs of nodes with equal values in a partition, counted over all nodes.
    every = [(m, i, g) for m, gs in tried.items() if m > 1 for i, g in enumerate(gs)]
    same = {}
    if every:
        each = emit_keys(nodes, [(g, 0) for _, _, g in every]).groupBy("p", "k").agg(F.count(F.lit(1)).cast("double").alias("n"))
        same = {every[r["p"]][:2]: r["pairs"] for r in each.groupBy("p").agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("pairs")).collect()}
    best = None
    for m, groups in tried.items():
        costs = []
        for i, g in enumerate(groups):
            near = np.cumsum(differing(n, both, g)) * n * n / 2
            met = max(same.get((m, i), 0.0), near[0]) / max(near[0], 1e-300) if m > 1 else 1.0
            c = [0.0]
            for t in range(min(radius, 6) + 1):
                half = (t + 1) // 2
                rows = sum(math.comb(len(g), k) for k in range(half + 1))
                reach = near[min(2 * half, len(g))] * met      # what meets half way, whether or not t is odd
                c.append(ROW_COST * n * rows + reach * rows ** 0.5)
            costs.append(np.array(c))
        ts = allocate(costs, radius - m + 1)
        if ts:
            cost = sum(c[t + 1] for c, t in zip(costs, ts))
            if best is None or cost < best[0]:
                best = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


# -- candidates, verification, links -----------------------------------------------------------------------------------------

class _Forest:
    """Trees of nodes that verified pairs have joined; the smallest node is the root."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, pairs):
        for x, y in pairs:
            p, q = self.find(x), self.find(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)

    def stars(self) -> np.ndarray:
        """(node, its root) of all nodes but the roots; forgets them."""
        out = [(*x, *self.find(x)) for x in list(self.up)]
        self.up = {}
        return np.array(out, np.uint64).reshape(-1, 4)


def _near(a: np.ndarray, b: np.ndarray, radius: int, check: int) -> np.ndarray:
    """Whether rows (fp, fp2) are linked."""
    return (np.bitwise_count(a[..., 0] ^ b[..., 0]) <= radius) & (np.bitwise_count(a[..., 1] ^ b[..., 1]) <= check)


def _tuples(x: np.ndarray) -> list[tuple]:
    return list(map(tuple, x.tolist()))


def _search(run: np.ndarray, radius: int, check: int):
    """Links that connect a long run: breadth-first, each step against those not reached yet."""
    left = run
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(left, x, radius, check)
            if hit.any():
                new = left[hit]
                yield from ((tuple(x.tolist()), y) for y in _tuples(new))
                queue.extend(new)
                left = left[~hit]


def _link(keys: np.ndarray, fps: np.ndarray, radius: int, check: int, forest: _Forest) -> None:
    """Join all linked nodes (fp, fp2) whose rows, sorted by key, share one."""
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[cut, len(keys)])
    for c, n in zip(cut[length > LONG_RUN].tolist(), length[length > LONG_RUN].tolist()):
        forest.join(_search(fps[c:c + n], radius, check))
    short = np.repeat(length <= LONG_RUN, length)
    keys, fps = keys[short], fps[short]
    for d in range(1, min(LONG_RUN, len(keys))):
        at = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(at):
            break
        at = at[_near(fps[at], fps[at + d], radius, check)]
        if len(at):
            forest.join(zip(_tuples(fps[at]), _tuples(fps[at + d])))


def links(nodes: DataFrame, radius: int, parts: list[tuple[list[int], int]], check: int = BITS) -> DataFrame:
    """(a, a2, b, b2): distinct pairs that connect all nodes within `radius` bits of fp and `check` of fp2.

    Each task gives every node it has joined to others once, with the smallest node of its tree.
    """
    def verify(batches):
        forest, held = _Forest(), None
        for b in batches:
            key = np.stack([b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()])
            fp = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], 1).view(np.uint64)
            if held is not None:
                key, fp = np.concatenate([held[0], key], 1), np.concatenate([held[1], fp])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            stop = new[-1] if len(new) else 0                       # the last run may go on in the next batch
            held = key[:, stop:], fp[stop:]
            if stop:
                link(key[:, :stop], fp[:stop], forest)
            if len(forest.up) > MOST_TREES:             # forgetting only gives a node again
                yield from out(forest)
        if held is not None:
            link(*held, forest)
        yield from out(forest)

    def link(key, fp, forest):
        _link(np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(0)]), fp, radius, check, forest)

    def out(forest):
        x = forest.stars().view(np.int64)
        for i in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16), c]) for c in range(4)], names=["a", "a2", "b", "b2"])

    rows = emit_keys(nodes, [(g, (t + 1) // 2) for g, t in parts])
    return rows.repartition("p", "k").sortWithinPartitions("p", "k").mapInArrow(verify, "a long, a2 long, b long, b2 long").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether edges (u, v), u above v, are stars already: no node has two smaller ones, and none a smaller and a larger one."""
    ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    return ends.groupBy("u").agg(F.sum("up").alias("n"), F.min("up").alias("low")).filter("n > 1 or n > low").agg(F.count(F.lit(1))).first()[0] == 0


def connected(links: DataFrame) -> DataFrame:
    """(node, root): components of an undirected graph of links (a, b), root the smallest node; by alternating star contractions, each
    written to the shared folder, until stars are left.  A node without links is not listed, nor is a root."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
        # No more rows than edges; what repeats goes with the small star.
        large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("w").alias("v")))
        # Small star: every node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        edges = materialize(large.join(least, "u").select(F.explode(F.array(F.struct("u", "w"), F.struct(F.col("v").alias("u"), F.col("w")))).alias("e"))
                            .select(F.col("e.u").alias("u"), F.col("e.w").alias("v")).filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of `connected` for the links that gave `root` and further `links` (a, b): only components that these join are contracted."""
    name = lambda x: F.coalesce("root", x).alias(x)
    between = links.join(root, F.col("a") == F.col("node"), "left").select(name("a"), "b").join(root, F.col("b") == F.col("node"), "left").select("a", name("b"))
    more = connected(between)
    moved = root.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return materialize(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(more))


def components(docs: DataFrame, radius: int = 2, words: int = 3, check: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of all documents: component_id is the smallest doc_id of those reachable over links.

    Linked are texts whose fingerprints differ in at most `radius` bits and, if `check` is given, whose second fingerprints
    differ in at most so many.  Null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows are all
    returned; a null doc_id is a component's id only if it has no other; other columns are not read; an empty table has no rows.
    """
    rows = materialize(fingerprints(docs, words, check is not None))
    # A node is labelled by its smallest doc_id, then by a number of its own: the smallest label of a component names it.
    nodes = materialize(rows.groupBy("fp", "fp2").agg(F.min("doc_id").alias("first")).select(
        "fp", "fp2", F.struct(F.coalesce("first", F.lit(NO_ID)).alias("first"), F.monotonically_increasing_id().alias("no")).alias("node")))
    found = links(nodes, radius, plan(nodes, radius), BITS if check is None else check)
    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("fp2").alias(x + "2"), F.col("node").alias("n" + x))
    pairs = found.join(side("a"), ["a", "a2"]).join(side("b"), ["b", "b2"]).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    named = nodes.join(connected(pairs), "node", "left").select("fp", "fp2", F.nullif(F.coalesce("root", "node")["first"], F.lit(NO_ID)).alias("component_id"))
    return rows.join(named, ["fp", "fp2"]).select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distinct_documents(docs: DataFrame, radius: int = 2, words: int = 3, check: int | None = None) -> DataFrame:
    """Rows of `docs` (all columns) whose doc_id names its component: one document of each group of near-duplicates.

    Rows repeated under the surviving doc_id with the same text are kept once.
    """
    keep = components(docs, radius, words, check).filter("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
