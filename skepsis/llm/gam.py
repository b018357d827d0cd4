"""Quality as a generalised additive model with pairwise interactions.

Features of a text are cut into bins at quantiles.  Cyclic boosting visits the features in turn; each visit fits a tree of at
most `LEAVES` leaves on the bins of one feature to the gradient of the log loss and adds it, shrunk, to that feature's lookup table.
The pairs whose four quadrants explain most of what is left are boosted the same way with trees of two cuts on a coarse grid.
A score is the logistic of an intercept and one table entry for each feature and pair.

Null, empty and wordless texts have features of their own (all zero) and are scored; repeated rows all count; extra columns are carried or ignored.
"""
from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import extend, hash_sample
from .quality import CLASSES, class_counts

SAMPLE = 4_000                  # labelled texts of each kind
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 40, 0.15
LEAVES = 3
PAIRS = 8
LEAST_ROWS = 20                 # rows in a leaf
SHRINK = 1.0
THRESHOLD = 0.3

FEATURES = ["log_words", "word_length", "upper", "digits", "symbols", "marks", "points", "other_classes", "class_entropy", "distinct", "log_top", "repeats",
            "pairs_distinct", "bare_words", "marked_words", "line_words", "equal_lines"]
_AT = {c: i for i, c in enumerate(CLASSES)}
_MARKS = set("!?#*$%&|<>~^=+@_/\\")


def word_features(text: str) -> list[float]:
    """Counts of a text's words and lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 10
    counts = Counter(words)
    top = max(counts.values())
    same = sum(map(str.__eq__, words, words[1:]))
    two = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    bare = marked = 0
    for w, k in counts.items():
        if w[-1] in _MARKS:
            marked += k
            bare += k * (not any(map(str.isalnum, w)))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [np.log1p(n), sum(map(len, words)) / n, len(counts) / n ** 0.85, np.log1p(top) - 0.5 * np.log1p(n), same / n, two, bare / n, marked / n,
            np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines)]


def features(texts: list[str | None]) -> np.ndarray:
    """A row of `FEATURES` per whole text."""
    held = [t or "" for t in texts]
    w = np.array([word_features(t) for t in held]).reshape(len(held), 10)
    c = class_counts(held).astype(float) if held else np.zeros((0, len(CLASSES)))
    share = c / np.maximum(c.sum(1, keepdims=True), 1)
    letters = share[:, [_AT["lower"], _AT["upper"], _AT["letter"]]].sum(1)
    p = np.where(share > 0, share, 1)
    named = [share[:, _AT["upper"]] / np.maximum(letters, 1e-9), share[:, _AT["digit"]], share[:, _AT["symbol"]], share[:, _AT["mark"]], share[:, _AT["point"]] + share[:, _AT["comma"]],
             share[:, [_AT[k] for k in ("quote", "bracket", "dash", "control")]].sum(1), -(p * np.log2(p)).sum(1)]
    return np.column_stack([w[:, :2], *named, w[:, 2:]])


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Ascending inner bounds of at most `bins` bins of about equally many rows; equal values share a bin."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, int]:
    """(gain, position) of the best cut of bins with summed gradients, curvatures and rows; gain 0 where none helps."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl ** 2 / (hl + SHRINK) + (g.sum() - gl) ** 2 / (h.sum() - hl + SHRINK) - g.sum() ** 2 / (h.sum() + SHRINK)
    gain = np.where((nl >= least) & (n.sum() - nl >= least), gain, 0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES, least: int = LEAST_ROWS) -> np.ndarray:
    """Newton step of each bin by a tree of at most `leaves` leaves over ordered bins, grown at its best cut."""
    ends = [(0, len(g))]
    while len(ends) < leaves:
        gain, k, i = max((*best_cut(g[a:z], h[a:z], n[a:z], least), i) for i, (a, z) in enumerate(ends))
        if gain <= 1e-9:
            break
        a, z = ends.pop(i)
        ends += [(a, a + k), (a + k, z)]
    out = np.zeros(len(g))
    for a, z in ends:
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + SHRINK)
    return out


def shallow_grid(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int = LEAST_ROWS) -> tuple[float, np.ndarray]:
    """(gain, Newton steps) of the best tree on a grid of bins: a cut on one axis, then one on the other in each half."""
    best = (0.0, np.zeros(g.shape))
    for turn in (False, True):
        gg, hh, nn = (x.T if turn else x for x in (g, h, n))
        for k in range(1, len(gg)):
            step, gain = np.zeros(gg.shape), -g.sum() ** 2 / (h.sum() + SHRINK)
            for a, z in ((0, k), (k, len(gg))):
                sg, sh, sn = gg[a:z].sum(0), hh[a:z].sum(0), nn[a:z].sum(0)
                if sn.sum() < least:
                    gain = -np.inf
                    break
                step[a:z] = shallow_tree(sg, sh, sn, 2, least)
                gain += best_cut(sg, sh, sn, least)[0] + sg.sum() ** 2 / (sh.sum() + SHRINK)
            if gain > best[0]:
                best = (gain, step.T if turn else step)
    return best


class Model:
    """Bounds of the bins, one table per feature, one grid per pair, and the intercept.  Unfitted, every score is 1."""

    def __init__(self):
        self.cuts: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.intercept = 0.0

    def bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], 1) for cuts in (self.cuts, self.coarse))

    def logits(self, fine: np.ndarray, rough: np.ndarray) -> np.ndarray:
        """Bin additions."""
        out = np.full(len(fine), self.intercept)
        for f, t in enumerate(self.tables):
            out += t[fine[:, f]]
        for (i, j), t in self.pairs.items():
            out += t[rough[:, i], rough[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.ones(len(x))
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    """A model of labels y (0 or 1) by features x; `weights` restore the kinds' true shares in a stratified sample."""
    m = Model()
    if not len(y) or y.min() == y.max():
        return m
    w = np.ones(len(y)) if weights is None else weights * len(y) / weights.sum()
    m.cuts = [cuts_of(x[:, f], BINS) for f in range(x.shape[1])]
    m.coarse = [cuts_of(x[:, f], COARSE) for f in range(x.shape[1])]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    share = float((w * y).sum() / w.sum())
    m.intercept = float(np.log(share / (1 - share)))
    fine, rough = m.bins(x)
    logit = np.full(len(y), m.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(m.tables):
            g, h = gradient()
            step = rate * shallow_tree(*(np.bincount(fine[:, f], v, len(table)) for v in (g, h)), np.bincount(fine[:, f], minlength=len(table)))
            table += step
            logit += step[fine[:, f]]

    def grid(i, j, g, h):
        shape = (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)
        at = rough[:, i] * shape[1] + rough[:, j]
        return at, [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, None)]

    g, h = gradient()
    gains = {ij: shallow_grid(*grid(*ij, g, h)[1])[0] for ij in combinations(range(x.shape[1]), 2)}
    chosen = [ij for ij in sorted(gains, key=lambda k: (-gains[k], k))[:pairs] if gains[ij] > 0]
    m.pairs = {(i, j): np.zeros((len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)) for i, j in chosen}
    for _ in range(pair_rounds):
        for (i, j), table in m.pairs.items():
            at, sums = grid(i, j, *gradient())
            step = rate * shallow_grid(*sums)[1]
            table += step
            logit += step.reshape(-1)[at]
    for table, f in zip(m.tables, range(x.shape[1])):       # every table has mean 0 over the sample, the intercept the rest
        mean = float((w * table[fine[:, f]]).sum() / w.sum())
        table -= mean
        m.intercept += mean
    return m


def held_out():
    """The rows that no label is learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, weights) of at most `most` different texts of each label, drawn by hash outside the held-out rows.

    Ids are drawn first, then the rows they meet, so that an id with many rows fills no more than its share.  An id with both labels
    counts under both.  Weights give the labels the shares they have among all usable labels.
    """
    usable = labels.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    rows, shares = [], []
    for v in (0, 1):
        of = usable.filter(F.col("quality") == v)
        shares.append(of.count())
        drawn = hash_sample(of, most, "doc_id")
        texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("mark", F.xxhash64("text"))
        one = extend(hash_sample(texts.dropDuplicates(["doc_id", "mark"]), most, "doc_id", "mark"), ["doc_id", "mark", "quality"], "text", lambda ts: [list(features(ts))],
                     StructType([StructField("x", ArrayType(DoubleType()))]))
        rows.append(sorted((r["doc_id"], r["mark"], r["x"]) for r in one.collect()))
    y = np.r_[np.zeros(len(rows[0])), np.ones(len(rows[1]))]
    x = np.array([r[2] for part in rows for r in part]).reshape(len(y), len(FEATURES))
    return x, y, np.r_[tuple(np.full(len(part), n / max(1, len(part))) for n, part in zip(shares, rows))]


ADDED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`score` (0 to 1, higher: label 1 likelier) and `predicted` (1 from `threshold` on) of every whole text, beside the columns `carry` (all, if not given)."""
    def add(texts):
        s = model.scores(features(texts))
        return [s, (s >= threshold).astype(np.int32)]
    return extend(docs, docs.columns if carry is None else carry, "text", add, ADDED)
