"""Toxicity by compression distance.

Text is cut into windows of `WINDOW_WORDS` words, each word written as an 8-byte code (its hash), so that a match
costs the same for a short word as for a long one and a compressor sees words, not letters that all words share.  One
zstandard dictionary is trained on windows of ordinary text, another on the words that set toxic text apart.  A window's
gain is the number of bytes by which it compresses better once the toxic dictionary stands beside the ordinary one;
ordinary text gains nothing.  A text's gains (mean, largest, sum) are turned into a probability by weights calibrated on
labelled texts the dictionaries have not seen.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import extend, hash_sample, keeps, materialize, turn_to

SAMPLE_TOXIC = 3_000
SAMPLE_ORDINARY = 6_000
SAMPLE_BYTES = 16 << 10
WINDOW_WORDS = 64
DICTIONARY_BYTES = 16 << 10
LEVEL = 9
THRESHOLD = 0.7
LEAST_PLACES = 5
CONTRAST = 8.0
CACHE_WORDS = 150_000

_WORD = re.compile(r"[^\W\d_]+")
_CODES: dict[str, bytes] = {}
keeps("toxic", _CODES.clear)


def codes(text: str) -> list[bytes]:
    """8-byte codes of a text's words (runs of letters, lower-cased)."""
    words = _WORD.findall(text.lower())
    for w in set(words).difference(_CODES):
        _CODES[w] = xxhash.xxh64_digest(w.encode())
    out = [_CODES[w] for w in words]
    if len(_CODES) > CACHE_WORDS:
        _CODES.clear()
    return out


def windows(c: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    """Windows that cover all of a text; a text without words is one empty window."""
    return [b"".join(c[i:i + size]) for i in range(0, max(1, len(c)), size)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on samples, or their bytes if there are too few to train on."""
    try:
        return zs.train_dictionary(size, samples, k=16, d=8).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:].ljust(8, b"\0")


class Model:
    """Two dictionaries and the calibrated weights."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int = LEVEL):
        self.ordinary, self.toxic, self.level = ordinary, toxic, level
        self.weights: np.ndarray | None = None
        self.center, self.scale = np.zeros(5), np.ones(5)
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}       # contexts are made anew in each worker

    def _compress(self, which: int, held: list[bytes]) -> np.ndarray:
        if self._compressors is None:
            p = zs.ZstdCompressionParameters.from_level(self.level, write_checksum=False, write_content_size=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
            self._compressors = [zs.ZstdCompressor(compression_params=p, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT))
                                 for d in (self.ordinary, self.toxic + self.ordinary)]
        out = self._compressors[which].multi_compress_to_buffer(held, threads=1)
        return np.array([len(x) for x in out], np.int64)

    def features(self, texts: list[str | None]) -> np.ndarray:
        held = [windows(codes(t or "")) for t in texts]
        flat = [w or b"\0" for ws in held for w in ws]
        gain = (self._compress(0, flat) - self._compress(1, flat)).astype(float)
        n = np.array([len(ws) for ws in held])
        first = np.cumsum(n) - n
        plus = np.maximum(gain, 0)
        total = np.add.reduceat(gain, first)
        return np.stack([total / n, np.log1p(np.maximum.reduceat(plus, first)), np.log1p(np.add.reduceat(plus, first)),
                         np.log1p(np.add.reduceat((gain >= 3).astype(float), first)), np.log1p(np.add.reduceat((gain >= 3).astype(float), first) / n)], 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that a text is toxic; 0 without calibration or words."""
        if self.weights is None or not len(texts):
            return np.zeros(len(texts))
        x = (self.features(texts) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))

    def calibrate(self, texts: list[str], toxic: np.ndarray, steps: int = 50) -> None:
        """Logistic regression by Newton steps, lightly shrunk."""
        x = self.features(texts)
        self.center, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        x = np.c_[(x - self.center) / self.scale, np.ones(len(x))]
        w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.1), 1e-6]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
            step = np.linalg.solve(h, x.T @ (toxic - p) - keep * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from three of four texts, calibration on the fourth.  Copies count once.

    The toxic dictionary is trained on the words that follow at least `LEAST_PLACES` different words in toxic texts (near copies
    of one text show a word in one place only), `CONTRAST` times as many for each text as ordinary texts have it.  Without texts of one kind every score is 0.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"\0" * 8, b"\0" * 8)
    held = [[t for i, t in enumerate(ts) if i % 4 == 3] for ts in (toxic, ordinary)]
    train = [[t for i, t in enumerate(ts) if i % 4 < 3] for ts in (toxic, ordinary)]
    after, usual, plain = set(), Counter(), []
    for t in train[0]:
        c = codes(t)
        after.update(zip([b"", *c], c))
    for t in train[1]:
        c = codes(t)
        usual.update(set(c))
        plain += windows(c)
    n, m = len(train[0]), len(train[1])
    least = min(LEAST_PLACES, max(2, n // 50))
    apart = {c: k for c, k in Counter(c for _, c in after).items() if k >= least and k / n >= CONTRAST * (usual[c] + 0.5) / m}
    samples = [c * 2 for c, k in sorted(apart.items(), key=lambda x: (-x[1], x[0])) for _ in range(min(k, 20))]
    model = Model(trained(plain, DICTIONARY_BYTES), trained(samples, DICTIONARY_BYTES))
    model.calibrate(held[0] + held[1], np.r_[np.ones(len(held[0])), np.zeros(len(held[1]))])
    _CODES.clear()          # on the driver, which goes on to other stages
    return model


def held_out():
    """The rows that no label is learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, most_toxic: int = SAMPLE_TOXIC, most_ordinary: int = SAMPLE_ORDINARY, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """At most `most_toxic` toxic and `most_ordinary` ordinary labelled texts of up to `most_bytes`, drawn by hash outside the held-out rows.

    Rows of one id with different texts are texts of their own; the bounds are of texts, whatever one id holds.  An id with both labels counts for both.
    """
    usable = labels.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    drawn = None
    for v, n in ((1, most_toxic), (0, most_ordinary)):
        part = hash_sample(usable.filter(F.col("toxic") == v).distinct(), n, "doc_id")
        drawn = part if drawn is None else drawn.unionByName(part)
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes)
    texts = materialize(short.join(F.broadcast(drawn), "doc_id").distinct())       # at most most_toxic + most_ordinary ids, but any number of texts of one
    toxic, ordinary = ([(r["doc_id"], r["text"]) for r in hash_sample(texts.filter(F.col("toxic") == v), n, "doc_id", "text").collect()]
                       for v, n in ((1, most_toxic), (0, most_ordinary)))
    return [t for _, t in sorted(toxic)], [t for _, t in sorted(ordinary)]


ADDED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`score` (0 to 1) and `predicted` (1 from `threshold` on) of every whole text, beside the columns `carry` (all, if not given).

    Null, empty and wordless texts have one empty window and so no gain; repeated rows are all scored; columns named like an added one give way.
    """
    def add(texts):
        turn_to("toxic")
        s = model.scores(texts)
        return [s, (s >= threshold).astype(np.int32)]
    return extend(docs, docs.columns if carry is None else carry, "text", add, ADDED)
