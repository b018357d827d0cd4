"""URL filter: host rules first, then a character language-model ratio.

Two variable-order Markov models of characters, one of accepted and one of rejected URLs, are smoothed by
Witten-Bell interpolation from order 0 up to `ORDER`; a context seen fewer than `LEAST` times by both models
gives way to the next shorter one, so the order varies along a URL.  The score is the mean log-likelihood
difference per character.  A URL is blocked if its score lies below a threshold calibrated on labelled URLs
the models were not fitted on.

`fit_table` counts and calibrates on Spark over all labelled URLs of a table; `fit` does the same for lists.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import rank_quantiles
from .common import materialize, record, slices

ORDER = 5
LEAST = 3
FLUSH_GRAMS = 400_000       # distinct n-grams that a task holds before it sends their counts
KEEP_ACCEPTED = 0.995
LISTED_WEIGHT = 8

# Fixed values of the contract: (host, path prefix, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# Hosts' words that URL blocklists publish; they stand for rejected URLs which no rule of the table names.
REJECTED_WORDS = ["adult", "bets", "casino", "pills", "porn", "poker", "spam", "xxx", "ads", "track", "win", "cheap", "free", "farm", "slots", "viagra", "loan", "dating", "warez", "crack", "torrent", "malware", "phish", "click"]


def host_path(url) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null or a url without `://`."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.when(after.startswith("/"), F.regexp_extract(after, r"^[^?#]*", 0)).otherwise(F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; rules of one length keep their order."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


class Model:
    """Log-likelihood differences (accepted minus rejected) by (context, character)."""

    def __init__(self, ratios: dict[str, float], order: int, threshold: float):
        self.ratios, self.order, self.threshold = ratios, order, threshold

    def score(self, text: str) -> float:
        """Mean difference per character; 0 for an empty text."""
        if not text:
            return 0.0
        s, get, order, total = "\x02" * self.order + text, self.ratios.get, self.order, 0.0
        for i in range(order, len(s)):
            for k in range(order, -1, -1):
                r = get(s[i - k:i + 1])
                if r is not None:
                    total += r
                    break
        return total / len(text)


def _counts(texts: list[str], order: int, weights: list[int] | None = None) -> dict[str, Counter]:
    """Characters by context of up to `order` characters; a text counts as often as its weight says (once, if not given)."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for t, w in zip(texts, weights or [1] * len(texts)):
        s = "\x02" * order + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[s[i - k:i]][s[i]] += w
    return seen


def _probability(seen: dict[str, Counter], context: str, c: str, known: dict, alphabet: int) -> float:
    """Witten-Bell: a context's own estimate, mixed with the next shorter context's by its number of kinds."""
    key = (context, c)
    if key in known:
        return known[key]
    shorter = _probability(seen, context[1:], c, known, alphabet) if context else 1 / alphabet
    own = seen.get(context)
    if own:
        n, kinds = own.total(), len(own)
        shorter = (own[c] + kinds * shorter) / (n + kinds)
    known[key] = shorter
    return shorter


def fit(accepted: list[str], rejected: list[str], weights: list[int] | None = None, order: int = ORDER, least: int = LEAST, keep: float = KEEP_ACCEPTED) -> Model:
    """Fit on four of five texts of each kind, calibrate on the fifth; `weights` are those of the rejected texts.

    The threshold is the score below which at most 1 - `keep` of the accepted calibration texts lie, and never above 0.
    Without texts of one kind nothing can be told apart: the model scores 0 and blocks nothing.
    """
    if not accepted or not rejected:
        return Model({}, order, -math.inf)
    train = lambda rows: [x for i, x in enumerate(rows) if i % 5] or rows
    a, r = _counts(train(accepted), order), _counts(train(rejected), order, train(weights or [1] * len(rejected)))
    alphabet = len({c for ts in (accepted, rejected) for t in ts for c in t}) + 1
    known: tuple[dict, dict] = ({}, {})
    ratios = {}
    for context in set(a) | set(r):
        both = Counter(a.get(context, ())) + Counter(r.get(context, ()))
        if context and both.total() < least:
            continue
        for c in both:
            ratios[context + c] = math.log(_probability(a, context, c, known[0], alphabet)) - math.log(_probability(r, context, c, known[1], alphabet))
    model = Model(ratios, order, 0.0)
    good = sorted(model.score(t) for t in accepted[::5])
    model.threshold = min(0.0, good[int((1 - keep) * len(good))])
    return model


def label_texts(pages: DataFrame, words=REJECTED_WORDS, rules=RULES) -> DataFrame:
    """(t, v): the distinct texts of each kind `allow`, `reject` and `block`; no empty ones.

    Accepted are urls that a rule allows.  Rejected are those whose host holds one of `words` as a part between dots and
    dashes, whatever a rule says, and, as `block`, others that a rule blocks: a rule blocks a path of a host that may be good elsewhere.
    """
    host, path = host_path(pages["url"])
    bad = F.arrays_overlap(F.split(host, r"[.-]"), F.array(*[F.lit(w) for w in words]))
    said = F.when(bad, F.lit("reject")).otherwise(best_rule(host, path, rules)[1])
    return pages.select(model_text(host, path, rules).alias("t"), said.alias("v")).filter(F.col("v").isNotNull() & (F.col("t") != "")).distinct()


def labelled(pages: DataFrame, words=REJECTED_WORDS, rules=RULES, listed: int = LISTED_WEIGHT) -> tuple[list[str], list[str], list[int]]:
    """Accepted texts, rejected ones, and the weights of the rejected ones (`listed` for hosts with one of `words`, else 1): for tables that the driver can hold."""
    rows = label_texts(pages, words, rules).orderBy(F.xxhash64("t"), "t").collect()
    good, named, blocked = ([r["t"] for r in rows if r["v"] == v] for v in ("allow", "reject", "block"))
    return good, named + blocked, [listed] * len(named) + [1] * len(blocked)


def _gram_counts(order: int, flush: int = FLUSH_GRAMS):
    """For mapInArrow over (t, a, r): (gram, a, r), how often a task's texts hold each run of `order` + 1 characters, by their weights a and r."""
    def rows(held: dict[str, list[int]]):
        grams, counts = list(held), np.array(list(held.values()), np.int64).reshape(-1, 2)
        for i in range(0, len(grams), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[i:i + 20_000], pa.string()), *[pa.array(counts[i:i + 20_000, c]) for c in (0, 1)]], names=["gram", "a", "r"])

    def run(batches):
        held: dict[str, list[int]] = {}
        for b in slices(batches):
            for t, a, r in zip(*[c.to_pylist() for c in b.columns]):
                s = "\x02" * order + t
                for i in range(len(t)):
                    n = held.setdefault(s[i:i + order + 1], [0, 0])
                    n[0] += a
                    n[1] += r
                    if len(held) >= flush:
                        yield from rows(held)
                        held = {}
        yield from rows(held)
    return run


def fit_table(texts: DataFrame, listed: int = LISTED_WEIGHT, order: int = ORDER, least: int = LEAST, keep: float = KEEP_ACCEPTED) -> Model:
    """`fit` over all rows (t, v) of `label_texts`: the texts whose hash is no multiple of five are counted, accepted others calibrate.

    Counts of shorter runs of characters are sums of those of the longest, so each text is cut once.  Only what the model
    consists of comes to the driver: one number for each run of characters behind a context of `least` occurrences.
    """
    good = F.col("v") == "allow"
    texts = materialize(texts.select("t", "v", (F.pmod(F.xxhash64("t"), F.lit(5)) != 0).alias("train")))
    n = {(r["good"], r["train"]): r["n"] for r in texts.groupBy(good.alias("good"), "train").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(any((g, x) in n for x in (True, False)) for g in (True, False)):
        return Model({}, order, -math.inf)
    # A kind that has texts on one side of the split only is counted, or calibrates, as a whole.
    used = F.when(good, F.col("train") | F.lit((True, True) not in n)).otherwise(F.col("train") | F.lit((False, True) not in n))
    weighed = texts.select("t", F.when(used & good, 1).otherwise(0).cast("long").alias("a"),
                           F.when(used & (F.col("v") == "reject"), listed).when(used & (F.col("v") == "block"), 1).otherwise(0).cast("long").alias("r"))
    total = lambda df: df.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    longest = materialize(total(weighed.mapInArrow(_gram_counts(order), "gram string, a long, r long")))
    alphabet = longest.select(F.substring("gram", order + 1, 1)).distinct().count() + 1

    ratios, shorter = [], None
    for k in range(order + 1):
        grams = total(longest.select(F.substring("gram", order + 1 - k, k + 1).alias("gram"), "a", "r")).withColumn("context", F.substring("gram", 1, k))
        kinds = lambda c: F.count(F.when(F.col(c) > 0, 1))
        found = grams.join(grams.groupBy("context").agg(F.sum("a").alias("na"), kinds("a").alias("ka"), F.sum("r").alias("nr"), kinds("r").alias("kr")), "context")
        if k:
            found = found.withColumn("rest", F.substring("gram", 2, k)).join(shorter.select(F.col("gram").alias("rest"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "rest")
        else:
            found = found.withColumns({"qa": F.lit(1 / alphabet), "qr": F.lit(1 / alphabet)})
        p = lambda c: F.when(F.col("n" + c) > 0, (F.col(c) + F.col("k" + c) * F.col("q" + c)) / (F.col("n" + c) + F.col("k" + c))).otherwise(F.col("q" + c)).alias("p" + c)
        shorter = materialize(found.select("gram", p("a"), p("r"), ((F.col("a") + F.col("r") > 0) & ((F.col("na") + F.col("nr") >= least) | F.lit(k == 0))).alias("kept")))
        ratios.append(shorter.filter("kept").select("gram", (F.ln("pa") - F.ln("pr")).alias("ratio")))
    ratios = [x.toArrow() for x in ratios]
    model = Model({g: r for x in ratios for g, r in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}, order, 0.0)

    held_out = texts.filter(good & ~F.col("train") if (True, False) in n else good)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for b in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.score(t) for t in b.column(0).to_pylist()], pa.float64())], names=["score"])
    scores = materialize(held_out.select("t").mapInArrow(scored, "score double").withColumn("all", F.lit(0)))
    model.threshold = min(0.0, rank_quantiles(scores, "all", "score", {"low": lambda m: F.floor(F.lit(1 - keep) * m)}).first()["low"])
    return model


def model_text(host: Column, path: Column, rules=RULES) -> Column:
    """What the models read: host and path without what rules go by (the top-level domain, a first path segment that a rule
    names), so that a rule for one host doesn't speak for all others."""
    named = sorted({s for _, p, _ in rules for s in p.split("/")[1:2] if s})
    if named:
        path = F.regexp_replace(path, "^/(?:" + "|".join(map(re.escape, named)) + ")(?=/|$)", "")
    return F.concat(F.regexp_replace(host, r"\.[^.]*$", ""), path)


_SCORED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()),
                     ("score", pa.float64())])


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    The verdict is the longest fitting rule's, else `block` if the model's score lies below its threshold, else `allow`.  A
    null url, or one without `://`, has empty host and path, score 0 and so `allow`.  Repeated rows are all judged.
    """
    host, path = host_path(pages["url"])
    rule, verdict = best_rule(host, path, rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"), model_text(host, path, rules).alias("t"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, 4096):
            # Copies of a url in a batch are scored once.
            texts = b.column(5).to_pylist()
            score = {t: shared.value.score(t) for t in set(texts)}
            yield record(_SCORED, page_id=b.column(0).cast(pa.int64()), host=b.column(1), path=b.column(2), rule=b.column(3), ruled=b.column(4),
                         score=np.array([score[t] for t in texts], float))

    out = rows.mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    said = F.when(F.col("score") < F.lit(float(model.threshold)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "score")
