"""Phrases of two to four words that stand together more often than their parts do.

First pass: every n-gram occurrence (1 to `LONGEST` words, a language apart) is hashed to a partition.  A task sends its
distinct hashes with counts; each partition folds them into one Misra-Gries summary whose capacity exceeds the partition's
mass divided by the threshold, so that every n-gram of `least` occurrences survives.  Survivors become a bitmap of bounded
size.  Second pass: n-grams that the bitmap holds, and whose shorter parts it holds, are counted exactly by their words,
so that neither hashes nor the summaries' errors reach the result.

Null texts are empty, a null language is `und`.  Repeated rows all count.  Extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

LEAST = 30                  # occurrences of a candidate
LONGEST = 4                 # words of a candidate
COVERED = 80                # a candidate goes if a longer one that holds it has this share (in percent) of its occurrences
TOP = 2_000
SCALE = 2_000_000
TASK_BYTES = 64 << 20       # text that a task of the second pass reads, where there are tasks enough
CHUNK_BYTES = 2 << 20       # text that is split at once
FLUSH_HASHES = 4 << 20      # n-gram occurrences that a task holds before it folds them
FLUSH_PHRASES = 700_000
CACHE_WORDS = 250_000
SUMMARY_ENTRIES = 1 << 17   # counters for a hash partition, on average
MOST_BITS = 1 << 29         # the bitmap that tasks receive: 64 MB at most
SALTS = 16

# The contract's separators: words end at blanks, pieces at marks and line ends.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BREAK = 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """Ids and hashes of words, in the order they were met; 0 is the empty word, 1 the end of a piece."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []
        self.hashes = np.zeros(1 << 12, np.uint64)
        self[b""], self[b"\n"]

    def __missing__(self, w: bytes) -> int:
        k = len(self.names)
        self.names.append(w)
        if k == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
        self.hashes[k] = xxhash.xxh64_intdigest(w)
        self[w] = k
        return k


def portions(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text, cut behind a blank."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b" ", at, at + size) + 1 or text.find(b" ", at + size) + 1
        if not cut:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_runs(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, np.ndarray, int, Words]]:
    """(language, word ids, how many ids at the front were in the run before, words) of columns lang, text (binary)."""
    words = Words()

    def run(lang: bytes, texts: list[bytes]):
        nonlocal words
        carry: list[bytes] = []
        for part in portions(b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ") + b" \n", size):
            if len(words) > CACHE_WORDS:
                words = Words()
            raw = carry + [w for w in part.split(b" ") if w]
            yield lang, np.fromiter(map(words.__getitem__, raw), np.int64, len(raw)), len(carry), words
            carry = raw[-(LONGEST - 1):]

    for b in batches:
        held: dict[bytes, list[bytes]] = {}
        sizes: dict[bytes, int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            held.setdefault(lang, []).append(text.as_py() or b"")
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
            if sizes[lang] > size:
                yield from run(lang, held.pop(lang))
                sizes[lang] = 0
        for lang, texts in held.items():
            yield from run(lang, texts)


def grams(lang: bytes, ids: np.ndarray, old: int, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hash of the n words from each position on, is that an n-gram of one piece that ends in this run)."""
    single = mixed(words.hashes[ids] ^ np.uint64(xxhash.xxh64_intdigest(lang, 1)))
    whole = inside = ids != _BREAK
    h = single
    for n in range(1, min(LONGEST, len(ids)) + 1):
        if n > 1:
            h = mixed(h[:-1] * _A + single[n - 1:])
            whole = whole[:-1] & inside[n - 1:]
        new = whole
        if old > n - 1:
            new = whole.copy()
            new[:old - n + 1] = False
        yield n, h, new


class Summary:
    """A Misra-Gries summary of 32-bit keys: counts are too low by at most `lost`, which is at most mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Add counts (or another summary with its `lost`), then take the largest uncounted value off every counter."""
        every, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate([self.counts, counts]))
        self.lost += lost
        if len(every) > self.capacity:
            off = np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1]
            self.lost += int(off)
            total -= off
        self.keys, self.counts = every[total > 0], total[total > 0]

    def at_least(self, least: int) -> np.ndarray:
        """Keys that may have `least` occurrences; all that have them are among these."""
        return self.keys[self.counts + self.lost >= least]


PARTIAL = "part int, kind int, mass bigint, hashes binary, counts binary"


def partial_counts(bits: int, flush: int = FLUSH_HASHES):
    """For mapInArrow: per task and hash partition one row (kind 0) with the mass it sends, and the distinct hashes with counts (kind 1)."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)

    def rows(hashes: list[np.ndarray]):
        """Empties `hashes`: a task holds them once, sorted in place."""
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        hashes.clear()
        h.sort()
        h >>= np.uint64(32 - bits)                      # the partition's bits and the 32 bits behind them
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(h)]).astype("<u4")
        h = h[first]
        ends = [0, *np.searchsorted(h, bounds >> np.uint64(32 - bits)).tolist(), len(h)]
        for part, (a, z) in enumerate(zip(ends, ends[1:])):
            if a < z:
                mass = int(counts[a:z].sum(dtype=np.int64))
                cols = [[part, part], [0, 1], [mass, mass], [None, h[a:z].astype("<u4").tobytes()], [None, counts[a:z].tobytes()]]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "kind", "mass", "hashes", "counts"])

    def run(batches):
        held, n = [], 0
        for lang, ids, old, words in token_runs(batches):
            for _, h, new in grams(lang, ids, old, words):
                held.append(h[new])
                n += len(held[-1])
            if n >= flush:
                yield from rows(held)
                n = 0
        yield from rows(held)
    return run


def summaries(least: int, slice_bits: int):
    """For mapInArrow over rows sorted by (part, kind): each partition's survivors as a slice of the bitmap of 2**slice_bits bits."""
    def slice_of(part: int, s: Summary):
        bits = np.zeros(1 << slice_bits, np.uint8)
        keys = s.at_least(least)
        bits[keys >> np.uint32(32 - slice_bits)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                                          names=["part", "survivors", "bits"])

    def run(batches):
        part, mass, s, held, n = None, 0, None, [], 0

        def fold():
            nonlocal held, n
            if held:
                s.merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held, n = [], 0

        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    if s is not None:
                        fold()
                        yield slice_of(part, s)
                    part, mass, s = r["part"], 0, None
                if r["kind"] == 0:
                    mass += r["mass"]
                    continue
                if s is None:
                    s = Summary(mass // least + 1)
                held.append((np.frombuffer(r["hashes"], "<u4"), np.frombuffer(r["counts"], "<u4").astype(np.int64)))
                n += len(held[-1][0])
                if n > s.capacity:
                    fold()
        if s is not None:
            fold()
            yield slice_of(part, s)
    return run


def power(n: float) -> int:
    """The smallest k with 2**k >= n."""
    return max(0, int(np.ceil(np.log2(max(1, n)))))


def text_bytes(texts: DataFrame) -> int:
    """Bytes of all texts, one more for each."""
    return texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).cast("bigint")).first()[0]


def gathered(texts: DataFrame, size: int, most: int = TASK_BYTES) -> DataFrame:
    """`texts` (`size` bytes in all) in fewer tasks: each reads up to about `most` bytes, unless less than two tasks a core would be left.

    A task sends a row for each frequent phrase that it meets, however often: the more text it reads, the fewer rows leave all tasks.
    """
    return texts.coalesce(max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-size // most)))


def survivors(texts: DataFrame, least: int = LEAST, entries: int = SUMMARY_ENTRIES, flush: int = FLUSH_HASHES, size: int | None = None) -> tuple[np.ndarray, int]:
    """(bitmap, its bits as a power of two): a set of hash prefixes that holds every n-gram of `least` occurrences.

    Two bytes make a word at least, so `LONGEST` n-grams for two bytes bound the mass; the partitions' number follows from
    it.  A partition's slice is 2**slice_bits bits, and all slices together at most `MOST_BITS`.
    """
    size = text_bytes(texts) if size is None else size
    mass = LONGEST * (size // 2 + 1)
    bits = min(16, power(mass / least / entries))
    slice_bits = max(3, min(power(4 * mass / least), power(MOST_BITS)) - bits)
    partial = texts.mapInArrow(partial_counts(bits, flush), PARTIAL)
    dealt = partial.repartition(1 << bits, "part").sortWithinPartitions("part", "kind")
    rows = dealt.mapInArrow(summaries(least, slice_bits), "part int, survivors bigint, bits binary").collect()      # MOST_BITS bits in all
    bitmap = np.zeros((1 << bits, max(1, (1 << slice_bits) // 8)), np.uint8)
    for r in rows:
        bitmap[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return bitmap.reshape(-1), bits + slice_bits


def holds(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def exact_counts(shared, bits: int, flush: int = FLUSH_PHRASES):
    """For mapInArrow: (lang, phrase, n) of the n-grams that the bitmap `shared.value` holds; the empty phrase: all words of the language.

    A task holds what it counts until `flush` phrases are met, which should be more than its share of the text has: a phrase
    that goes out and comes again is a row each time.
    """
    def rows(held: dict[bytes, dict[bytes, int]]):
        for lang, counts in held.items():
            phrases, n = list(counts), list(counts.values())
            for i in range(0, len(phrases), 20_000):
                part = pa.array(phrases[i:i + 20_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(part), pa.string()), part, pa.array(n[i:i + 20_000], pa.int64())], names=["lang", "phrase", "n"])

    def run(batches):
        held: dict[bytes, dict[bytes, int]] = {}
        for lang, ids, old, words in token_runs(batches):
            counts = held.setdefault(lang, {})
            known = seen = None
            for n, h, new in grams(lang, ids, old, words):
                if n == 1:
                    counts[b""] = counts.get(b"", 0) + int(new.sum())
                    hot, known = (ids != _BREAK) & holds(shared.value, bits, h), ids
                else:           # a frequent n-gram's first and last n - 1 words are frequent
                    at = np.flatnonzero(seen[:-1] & seen[1:])
                    hot = np.zeros(len(h), bool)
                    hot[at] = holds(shared.value, bits, h[at])
                    pair = np.zeros(len(h), np.int64)
                    pair[hot] = known[:-1][hot] << 32 | ids[n - 1:][hot]
                    known = np.zeros(len(h), np.int64)
                    known[hot] = np.unique(pair[hot], return_inverse=True)[1]       # names the words from here on exactly
                at = np.flatnonzero(hot & new)
                _, first, count = np.unique(known[at], return_index=True, return_counts=True)
                for i, c in zip(at[first].tolist(), count.tolist()):
                    key = b" ".join([words.names[w] for w in ids[i:i + n]])
                    counts[key] = counts.get(key, 0) + c
                seen = hot
            if sum(map(len, held.values())) > flush:
                yield from rows(held)
                held = {}
        yield from rows(held)
    return run


def frequent(docs: DataFrame, least: int = LEAST, entries: int = SUMMARY_ENTRIES, flush: int = FLUSH_HASHES) -> DataFrame:
    """(lang, phrase, words, n): the exact number of occurrences of every n-gram of `least` of them; words 0: of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    size = text_bytes(texts)
    bitmap, bits = survivors(texts, least, entries, flush, size)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    n = gathered(texts, size).mapInArrow(exact_counts(shared, bits), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return n.select("lang", "phrase", words.alias("words"), "n").filter((F.col("n") >= least) | (F.col("words") == 0))


def _inside(words, length: int):
    """All contiguous phrases of `length` words inside a longer one; of a shorter one none."""
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    return F.when(F.size(words) > length, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(length)), " "))).otherwise(F.array().cast("array<string>"))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, entries: int = SUMMARY_ENTRIES, flush: int = FLUSH_HASHES) -> DataFrame:
    """Each language's first `top` phrases: (lang, rank, phrase, a, l, r, n, score), by the rules of the module's contract.

    A part that many candidates share has one word, so such counts are salted before candidates look them up; counts of
    longer candidates reach the phrases inside them as one maximum, combined before the shuffle.
    """
    counts = materialize(frequent(docs, least, entries, flush))
    w = F.split("phrase", " ")
    longer = counts.filter(F.col("words") > 2).select("lang", "n", F.explode(F.array_distinct(F.concat(*[_inside(w, m) for m in range(2, LONGEST)]))).alias("phrase"))
    own = counts.filter(F.col("words") > 1)
    kept = (own.select("lang", "phrase", F.col("n").alias("a"), F.lit(None).cast("bigint").alias("over")).unionByName(longer.select("lang", "phrase", F.lit(None).cast("bigint").alias("a"), F.col("n").alias("over")))
            .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("over").alias("over"))
            .filter(F.col("over").isNull() | (F.lit(100).cast("decimal(5,0)") * F.col("over").cast("decimal(20,0)") < F.lit(covered).cast("decimal(5,0)") * F.col("a").cast("decimal(20,0)"))))

    size = F.size(w)
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("part"), (k == 1).alias("single")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), F.array_join(F.slice(w, k + 1, size - k), " ").alias("part"), (k == size - 1).alias("single"))))
    asks = (kept.select("lang", "phrase", "a", F.explode(F.flatten(cuts)).alias("c")).select("lang", "phrase", "a", "c.k", "c.side", "c.part", "c.single")
            .withColumn("salt", F.when(F.col("single"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("single"))
    parts = counts.filter(F.col("words").between(1, LONGEST - 1)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(
        F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    found = asks.join(parts, ["lang", "part", "salt"]).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), *[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{'lr'[s]}{k}") for k in range(1, LONGEST) for s in (0, 1)])

    def cut(k: int):
        score = F.expr(f"cast({SCALE} as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = found.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*[cut(k) for k in range(1, LONGEST)]))).alias("b"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = counts.filter("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang,
         list_filter(string_split_regex(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
g AS (SELECT lang, m, list_aggregate(ws[i : i + m - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
inner_ AS (SELECT lang, list_aggregate(ws[i : i + k - 1], 'string_agg', ' ') AS phrase, max(a) AS over
  FROM (SELECT lang, ws, k, a, unnest(range(1, m - k + 2)) AS i FROM s, (VALUES (2), (3)) AS v(k) WHERE m > k) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inner_ USING (lang, phrase) WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a),
cuts AS (SELECT lang, phrase, a, k, list_aggregate(ws[1 : k], 'string_agg', ' ') AS lp, list_aggregate(ws[k + 1 : m], 'string_agg', ' ') AS rp
  FROM kept, (VALUES (1), (2), (3)) AS v(k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
