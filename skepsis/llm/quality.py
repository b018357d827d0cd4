"""Quality rules by distribution divergence.

Every language of the corpus has a reference: the shares of character classes over all its characters, and of
its `TOP_WORDS` most frequent words (all others in one share) over all its words.  A document's own shares
are compared with each reference by Jensen-Shannon distance (base 2, 0 to 1); the nearest reference counts.  A document
too far from every reference is rejected; one too short for a histogram is not judged by it.
"""
from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import extend, materialize, slices, turn_to

TOP_WORDS = 50
MOST_LANGUAGES = 64
LEAST_LANGUAGE_WORDS = 2_000
LEAST_CHARS = 120
LEAST_WORDS = 60
# A histogram of n counts strays from its source by about 1 / sqrt(n): the limits are base + slack / sqrt(n).
CLASS_LIMIT, CLASS_SLACK = 0.06, 4.2
WORD_LIMIT, WORD_SLACK = 0.2, 3.0
FLUSH_WORDS = 200_000
LIMITS = (CLASS_LIMIT, CLASS_SLACK, WORD_LIMIT, WORD_SLACK, LEAST_CHARS, LEAST_WORDS)

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"        # fixed value of the contract
CLASSES = ["lower", "upper", "letter", "digit", "point", "comma", "mark", "quote", "bracket", "dash", "symbol", "blank", "break", "control"]
_STRIP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\"()[]{}" + SYMBOLS, b"abcdefghijklmnopqrstuvwxyz" + b" " * (13 + len(SYMBOLS)))


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every codepoint."""
    by = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "L": "letter", "M": "letter", "N": "digit", "Pd": "dash", "Ps": "bracket", "Pe": "bracket", "Pi": "quote",
          "Pf": "quote", "P": "mark", "S": "symbol", "Z": "blank", "C": "control"}
    single = {".": "point", ",": "comma", "'": "quote", '"': "quote", "\n": "break", "\r": "break", "\t": "blank", **{chr(c): "symbol" for c in SYMBOLS}}
    at = {c: i for i, c in enumerate(CLASSES)}

    def of(c: str) -> int:
        kind = unicodedata.category(c)
        return at[single.get(c) or by.get(kind) or by[kind[0]]]
    return np.fromiter((of(chr(c)) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def class_counts(texts: list[str]) -> np.ndarray:
    """Characters of each class, one row per text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    who = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(who * len(CLASSES) + char_classes()[points], minlength=len(texts) * len(CLASSES)).reshape(len(texts), -1)


def plain_words(data: bytes) -> list[bytes]:
    """Words for the histogram: A-Z lower-cased, without punctuation."""
    return data.translate(_STRIP).split()


class Reference:
    """Shares of one language; `words` maps a word to its place, the last place is that of all other words."""

    def __init__(self, language: str, classes: np.ndarray, words: dict[bytes, int], shares: np.ndarray):
        self.language, self.classes, self.words, self.shares = language, classes, words, shares


class References(list):
    """References on the driver; `rest` holds those of all other languages as a table (lang, classes, words, shares, known), None if there are none."""

    rest: DataFrame | None = None


OWN = ["classes", "words", "shares", "known"]


def _split(docs: DataFrame, refs: list["Reference"]) -> tuple[DataFrame, DataFrame]:
    """Documents of the languages of `refs`, and all others beside their own language's reference (nulls if it has none)."""
    named = F.coalesce(F.col("lang").isin([r.language for r in refs if r.language is not None]), F.lit(any(r.language is None for r in refs)))
    rest = refs.rest.select(F.col("lang").alias("__lang"), *[F.col(c).alias(f"__{c}") for c in OWN])
    return docs.filter(named), docs.filter(~named).join(rest, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")


def _by_language(refs: list["Reference"], langs: list, own: list[list]):
    """(rows, references, known words) for each language of some rows: `refs` and its own, or none if it has none."""
    at = defaultdict(list)
    for i, lang in enumerate(langs):
        at[lang].append(i)
    for lang, rows in at.items():
        classes, words, shares, known = (c[rows[0]] for c in own)
        if classes is None:
            yield rows, [], frozenset()
        else:
            yield rows, [*refs, Reference(lang, np.array(classes), {w: i for i, w in enumerate(words)}, np.array(shares))], frozenset(known)


def _partial(refs: list["Reference"], limits: tuple, share: float, known: frozenset | None):
    """Counts of the texts that pass the rules: per language, characters by class, words, and the total.

    Words are those of `known`, or, without it, those that hold `share` of a language's words in the part of the task
    counted so far: what is frequent in all is so in some part.
    """
    refs = list(refs)               # without the table, which stays with the driver

    def run(batches):
        turn_to("quality")
        counts, classes, total = defaultdict(Counter), {}, Counter()

        def flush():
            if known is None:
                for lang, c in counts.items():
                    counts[lang] = Counter({w: n for w, n in c.items() if n >= share * total[lang]})
            rows = [(lang, None, i, int(n)) for lang, c in classes.items() for i, n in enumerate(c) if n]
            rows += [(lang, w, None, n) for lang, c in counts.items() for w, n in c.items()] + [(lang, None, -1, n) for lang, n in total.items()]
            cols = list(zip(*rows)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                                              names=["lang", "word", "class", "n"])
        for b in slices(batches):
            texts, langs = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            groups = [(range(len(texts)), refs, known)]
            if b.num_columns > 2:
                groups = _by_language(refs, langs, [c.to_pylist() for c in b.columns[2:]])
            for rows, near, names in groups:
                m = measure([texts[i] for i in rows], near, *limits)
                for i, ok, w, c in zip(rows, m["kept"], m["plain"], m["chars"]):
                    if ok:
                        lang = langs[i]
                        total[lang] += len(w)
                        counts[lang].update(w if names is None else filter(names.__contains__, w))
                        classes[lang] = classes.get(lang, 0) + c
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield flush()
                counts, classes, total = defaultdict(Counter), {}, Counter()
        yield flush()
    return run


def references(docs: DataFrame, top: int = TOP_WORDS, most: int = MOST_LANGUAGES, least: int = LEAST_LANGUAGE_WORDS, limits: tuple = ()) -> list[Reference]:
    """References from counts over the documents of each `lang` (null is a language of its own).

    A first pass over all documents that pass the base rules finds the words that are frequent in some part of a task, which
    holds every word that is frequent in all.  A second pass counts those words over all documents that lie near the first
    pass' references as well, so that what the rules reject doesn't shape them.  Every language of `least` words has one (all, if none
    has so many): the `most` with the most words on the driver, the others in a table.  Of the words, the `top` with a share of at least 1 in 4 `top` of
    their language, equal counts in byte order.  What reaches the driver is bounded by these numbers.
    """
    limits, share = limits or LIMITS, 1 / (4 * top)
    first, known = _collect(docs, [], limits, top, most, least, share / 8, None)
    return _collect(docs, first, limits, top, most, least, share / 8, known)[0] or first


def _common(words: list[tuple[int, bytes]], top: int, size: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent of some (-count, word), and their shares of `size` words with that of all others."""
    common = [(w, -n) for n, w in sorted(words)[:top] if -n * 4 * top >= size]
    n = np.array([k for _, k in common], float)
    return [w for w, _ in common], np.r_[n, size - n.sum()] / size


def _table(counts: DataFrame, top: int) -> DataFrame:
    """References of rows (lang, word, class, n, total), one row a language: at most its classes and the words of the smaller share."""
    def build(batches):
        for b in batches:
            out = []
            for lang, size, found in zip(*(c.to_pylist() for c in b.columns)):
                chars = np.zeros(len(CLASSES))
                for x in found:
                    if x["word"] is None:
                        chars[x["class"]] = x["n"]
                words = [(-x["n"], x["word"]) for x in found if x["word"] is not None]
                common, shares = _common(words, top, size)
                out.append((lang, (chars / chars.sum()).tolist(), common, shares.tolist(), [w for _, w in words]))
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.list_(pa.float64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["lang", *OWN])
    grouped = counts.groupBy("lang", "total").agg(F.collect_list(F.struct("word", "class", "n")).alias("found"))
    return materialize(grouped.mapInArrow(build, "lang string, classes array<double>, words array<binary>, shares array<double>, known array<binary>"))


def _collect(docs, refs, limits, top, most, least, share, known) -> tuple[list[Reference], frozenset]:
    form, texts = "lang string, word binary, class int, n long", docs.select("lang", "text")
    if known is None or getattr(refs, "rest", None) is None:
        counted = texts.mapInArrow(_partial(refs, limits, share, known), form)
    else:
        main, others = _split(texts, refs)
        counted = main.mapInArrow(_partial(refs, limits, share, known), form).unionByName(others.mapInArrow(_partial(refs, limits, share, None), form))
    sums = materialize(counted.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")))
    every = sums.filter("class = -1").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    totals = every.orderBy(F.desc("total"), "of").limit(most)
    # At most `most` languages, and of each its classes and the words of the smaller share: both sides are small.
    rows = sums.join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("of"))).filter(F.coalesce(F.col("class") >= 0, F.col("n") >= share * F.col("total"))).collect()
    size = {r["lang"]: r["total"] for r in rows}
    chosen = {k for k, n in size.items() if n >= least} or {k for k, n in size.items() if n}
    out, names = References(), set()
    for lang in sorted(chosen, key=lambda k: (-size[k], k is not None, k)):
        chars, words = np.zeros(len(CLASSES)), []
        for r in rows:
            if r["lang"] == lang and r["word"] is None:
                chars[r["class"]] = r["n"]
            elif r["lang"] == lang:
                words.append((-r["n"], bytes(r["word"])))
        names.update(w for _, w in words)
        common, shares = _common(words, top, size[lang])
        out.append(Reference(lang, chars / chars.sum(), {w: i for i, w in enumerate(common)}, shares))
    if chosen and every.count() > len(chosen):
        least = least if max(size.values()) >= least else 1
        others = every.filter((F.col("total") >= least) & ~F.coalesce(F.col("of").isin([k for k in chosen if k is not None]), F.lit(None in chosen)))
        out.rest = _table(sums.join(others, F.col("lang").eqNullSafe(F.col("of"))).filter(
            F.coalesce(F.col("class") >= 0, F.col("n") >= share * F.col("total"))).drop("of"), top)
    return out, frozenset(names)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeat_words(words: list[list[bytes]], window: int = 8) -> np.ndarray:
    """Words of each text inside windows of `window` (a power of two) words that the text holds twice or more."""
    n = np.array([len(w) for w in words])
    out = np.zeros(len(words), np.int64)
    who = np.repeat(np.arange(len(words)), n)
    if len(who) < window:
        return out
    code = pd.factorize(np.array([x for w in words for x in w], object))[0].astype(np.int64)
    step = 1
    while step < window:                                   # codes of 2, 4, ... words
        code = pd.factorize(code[:-step] * (code.max() + 1) + code[step:])[0].astype(np.int64)
        step *= 2
    first = who[:len(code)]
    inside = first == who[window - 1:]
    code = pd.factorize((first * (code.max() + 1) + code)[inside])[0]
    again = np.bincount(code)[code] > 1
    at = np.flatnonzero(inside)[again]
    edge = np.zeros(len(who) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.bincount(who, np.cumsum(edge[:-1]) > 0, minlength=len(words)).astype(np.int64)


def duplicate_lines(data: bytes) -> int:
    seen, n = set(), 0
    for line in data.split(b"\n") if b"\n" in data else ():
        if line in seen:
            n += bool(line.strip(WHITE))
        seen.add(line)
    return n


def measure(texts: list[str], refs: list[Reference], class_limit: float, class_slack: float, word_limit: float, word_slack: float, least_chars: int, least_words: int) -> dict:
    """Base rules, distances from the nearest reference and verdict of each text."""
    data = [t.encode() for t in texts]
    words = [d.split() for d in data]
    n = np.array([len(w) for w in words], np.int64)
    repeats = repeat_words(words)
    failed = (n < 20) | (100 * repeats > 30 * n)
    del words
    chars = class_counts(texts)
    size = chars.sum(1)
    plain = [plain_words(d) for d in data]
    many = np.array([len(w) for w in plain])
    near_c, near_w, nearest = np.full(len(texts), np.inf), np.full(len(texts), np.inf), np.full(len(texts), None, object)
    every = {w: i for i, w in enumerate(dict.fromkeys(w for r in refs for w in r.words))}
    counts = np.zeros((len(texts), len(every)))
    if every:                                               # counts of all references' words at once
        get = every.get
        at = [[i for i in map(get, p) if i is not None] for p in plain]
        counts = np.bincount(np.repeat(np.arange(len(texts)), [len(a) for a in at]) * len(every) + np.array([i for a in at for i in a], np.int64),
                             minlength=len(texts) * len(every)).reshape(len(texts), -1)
    for r in refs:
        near_c = np.minimum(near_c, js_distance(chars / np.maximum(size, 1)[:, None], r.classes))
        own = counts[:, [every[w] for w in r.words]]
        d = js_distance(np.c_[own, many - own.sum(1)] / np.maximum(many, 1)[:, None], r.shares)
        nearest[d < near_w] = r.language
        near_w = np.minimum(near_w, d)
    by_class, by_word = (size >= least_chars) & np.isfinite(near_c), (many >= least_words) & np.isfinite(near_w)
    far = (by_class & (near_c > class_limit + class_slack / np.sqrt(np.maximum(size, 1)))) | (by_word & (near_w > word_limit + word_slack / np.sqrt(np.maximum(many, 1))))
    return {"n_words": n, "repeats": repeats, "failed": failed, "kept": ~(failed | far), "nearest": nearest, "plain": plain, "chars": chars,
            "class_distance": [x if ok else None for x, ok in zip(near_c.tolist(), by_class)], "word_distance": [x if ok else None for x, ok in zip(near_w.tolist(), by_word)]}


ADDED = StructType([StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("nearest", StringType()),
    StructField("class_distance", DoubleType()), StructField("word_distance", DoubleType())])


def judge(docs: DataFrame, refs: list[Reference], carry: list[str] | None = None, limits: tuple = LIMITS) -> DataFrame:
    """Counts and verdict of every whole text, beside the columns `carry` (all, if not given).

    `kept` is false if the base rules fail, or if the text has `LEAST_CHARS` characters and its character classes lie
    further from every reference than the class limit for its length, or has `LEAST_WORDS` words and its words lie further
    from every reference than the word limit; distances are null below those lengths, and for a language without a reference, whose
    texts the base rules alone judge.  A text of a language that is not among `refs` is held against its own in `refs.rest` as well.  A null or empty
    text has no words and fails the base rules; repeated rows are all judged; columns named like an added one give way.
    """
    def found(texts, near):
        texts = [t or "" for t in texts]
        data = [t.encode() for t in texts]
        m = measure(texts, near, *limits)
        gone = [len(d) - len(d.translate(None, WHITE)) for d in data]
        return [m["n_words"], [len(t) - g for t, g in zip(texts, gone)], [len(d) - len(d.translate(None, SYMBOLS)) for d in data], [duplicate_lines(d) for d in data],
                m["repeats"], m["failed"], m["kept"], m["nearest"], m["class_distance"], m["word_distance"]]

    carry, held = docs.columns if carry is None else carry, list(refs)
    if getattr(refs, "rest", None) is None:
        return extend(docs, carry, "text", lambda texts: found(texts, held), ADDED)
    main, others = _split(docs, refs)
    others = others.withColumn("__own", F.struct(F.col("lang").alias("lang"), *[F.col(f"__{c}").alias(c) for c in OWN], F.col("text").alias("text")))

    def apart(rows):
        out = [[None] * len(rows) for _ in ADDED]
        for at, near, _ in _by_language(held, [r["lang"] for r in rows], [[r[c] for r in rows] for c in OWN]):
            for column, values in zip(out, found([rows[i]["text"] for i in at], near)):
                for i, v in zip(at, values):
                    column[i] = v
        return out

    return extend(main, carry, "text", lambda texts: found(texts, held), ADDED).unionByName(extend(others, carry, "__own", apart, ADDED))
