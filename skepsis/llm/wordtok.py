"""Whole-text ids of a lower-casing word-end BPE vocabulary, through a cache of words.

The vocabulary's own rules (NFC, white space to one blank, lower case, a pattern whose matches never hold
white space) treat every run between ASCII white space on its own, so a text's ids are its runs' ids in
order.  A-Z is lower-cased at once.  Each distinct run goes through the tokenizers library once per worker; punctuation
that follows a letter or digit is a match of its own there, so such a run is put together from its two
parts.  Runs of lower-case letters, whose normal form is themselves, share one call.
"""
from __future__ import annotations

import os
import unicodedata

import numpy as np

from .common import keeps, turn_to

CACHE_WORDS = 500_000
_TAIL = b".,!?;:"
_BEFORE_TAIL = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_LOADED: dict[str, "WordTokenizer"] = {}
keeps("wordtok", _LOADED.clear)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str) -> "WordTokenizer":
    """One tokenizer per worker process and file."""
    turn_to("wordtok")
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


class WordTokenizer:
    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers as pre
        self.full = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.full.get_added_tokens_decoder().values()]
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(self.full.model)
        self.ascii.pre_tokenizer = pre.Split(" ", "removed")
        self.suffix = getattr(self.full.model, "end_of_word_suffix", None)
        vocab = self.full.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if self.suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(self.suffix)]] = True
        self.most, self.cache = most, {}

    def _letters(self, words: list[bytes], coder) -> dict[bytes, bytes]:
        """Ids of runs of letters; each ends with the only word-end id it has."""
        joined = [b" ".join(words[i:i + 500]).decode() for i in range(0, len(words), 500)]
        ids = np.concatenate([np.asarray(e.ids, "<u4") for e in coder.encode_batch_fast(joined, add_special_tokens=False)])
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):
            raise ValueError("the vocabulary has no word ends")
        data, cuts = ids.tobytes(), cuts.tolist()
        return {w: data[a:b] for w, a, b in zip(words, [0, *cuts], cuts)}

    def _learn(self, missing: set[bytes], here: dict[bytes, bytes]) -> dict[bytes, bytes]:
        """Ids of the missing runs; `here` are the known ones of the same texts."""
        cache, ascii_, other, parted = self.cache, [], [], []
        for w in missing:
            if w.isalpha():
                ascii_.append(w)
            elif len(core := w.rstrip(_TAIL)) < len(w) and core and core[-1] in _BEFORE_TAIL:
                parted.append((w, core, w[len(core):]))
            else:
                other.append(w)
        # Full caches take no more runs: then a part may be known from these texts only.
        parts = {x for _, *ab in parted for x in ab if x not in here and x not in missing and x not in cache}
        ascii_ += [x for x in parts if x.isalpha()]
        other += [x for x in parts if not x.isalpha()]
        letters, hard = [], []
        for w in other:
            s = w.decode()
            (letters if s.isalpha() and s == s.lower() and unicodedata.is_normalized("NFC", s) else hard).append(w)
        if not self.suffix:
            ascii_, letters, hard = [], [], ascii_ + letters + hard
        found = self._letters(ascii_, self.ascii) if ascii_ else {}
        if letters:
            found |= self._letters(letters, self.plain)
        if hard:
            for w, e in zip(hard, self.full.encode_batch_fast([w.decode() for w in hard], add_special_tokens=False)):
                found[w] = np.asarray(e.ids, "<u4").tobytes()
        for w, core, tail in parted:
            a, b = found.get(core) or here.get(core) or cache.get(core), found.get(tail) or here.get(tail) or cache.get(tail)
            found[w] = a + b
        return found

    def _whole(self, text: bytes) -> bytes:
        return np.asarray(self.full.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | bytes | None]) -> list[bytes]:
        """Ids of each text (a string, or its UTF-8 bytes) as little-endian unsigned 32-bit integers; a null or empty one has none.

        A text that holds an added token's name goes through the library whole.
        """
        raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        low = [t.lower() for t in raw]
        named = [i for i, t in enumerate(low) if b"<|" in t and any(x in t for x in self.special)]
        for i in named:
            low[i] = b""
        runs = [t.split() for t in low]
        here, missing, known = {}, set(), self.cache.get
        for w in set().union(*runs):
            ids = known(w)
            if ids is None:
                missing.add(w)
            else:
                here[w] = ids
        if missing:
            found = self._learn(missing, here)
            here |= found
            if len(self.cache) + len(found) <= self.most:
                self.cache.update(found)
        here = here.__getitem__
        out = [b"".join(map(here, r)) for r in runs]
        for i in named:
            out[i] = self._whole(raw[i])
        return out
