import hashlib

import numpy as np
import pytest

VOWELS, CONSONANTS = "aeiou", "bcdfglmnprst"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """n words of a made-up language whose frequent words are short."""
    rng = np.random.default_rng(seed)
    ranks = np.minimum(rng.zipf(1.3, n), vocabulary)
    words = []
    for r in ranks:
        h = hashlib.md5(str(r).encode()).digest()
        words.append("".join(CONSONANTS[h[2 * i] % 12] + VOWELS[h[2 * i + 1] % 5] for i in range(1 + int(r) % 4)))
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words)).capitalize()


ODD = [None, "", "   \n\t ", "word", "É́   日本語、テスト", "x" * 3000, "a b " * 2000, "Don't 'quote' it's\r\n<|endoftext|> 12.5 !!!"]


@pytest.fixture(scope="session")
def docs(spark):
    """Prose, copies, near copies, odd texts, a null id, repeated rows and clashing extra columns."""
    texts = [prose(i, 60 + 7 * i) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200 + i, texts[3]) for i in range(40)] + [(300 + i, texts[4].replace("a", "e", i)) for i in range(4)]
    rows += [(5, texts[5]), (5, texts[5]), (None, texts[6]), (None, None)]
    return spark.createDataFrame([(i, t, "xx", "s", None if t is None else len(t), "clash", 1.5) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, shard string, score double").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
