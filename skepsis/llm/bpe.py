"""Byte-level BPE without a regular expression.

Pre-tokenisation is a finite automaton over codepoint classes.  A character is a function on the automaton's
eight states; functions compose associatively, so a text is cut into lanes, every lane's function is found for
all start states at once, the lane functions are scanned, and a last pass from the then known states marks
where slices begin.  Slices go through a cache; a slice not seen before is merged pair by pair by rank.
Every id keeps the byte offset at which it begins, and decoding copies each id's bytes to that place.
"""
from __future__ import annotations

import base64
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record, slices

CACHE_SLICES = 400_000
LANE = 256
LONG_SLICE = 200
NONE = 1 << 40

# Symbols: letter, number, other, white space before white space or the end, a blank before something else, other white
# space before something else, apostrophe of a contraction with one or two letters, and the border between texts.
LETTER, NUMBER, OTHER, SPACES, BLANK, SPACE, SHORT, LONG, BORDER = range(9)
# States: inside a run of letters, numbers, others or white space, closed, after a blank, and one or two letters from a contraction's end.
IN_L, IN_N, IN_O, IN_S, CLOSED, LED, ONE, TWO = range(8)
# Fixed value: code points of the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins a slice) by [symbol, state]."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for sym, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        to[sym] = run
        begins[sym, [run, LED]] = False
    for sym, pending in ((SHORT, ONE), (LONG, TWO)):
        to[sym] = pending
        for s in (IN_O, LED):               # within a run of others the apostrophe is one of them
            to[sym, s], begins[sym, s] = IN_O, False
    to[SPACES], begins[SPACES, IN_S] = IN_S, False
    to[BLANK], to[SPACE], to[BORDER] = LED, CLOSED, CLOSED
    for sym in range(BORDER):               # the letters of a contraction are taken whatever they are
        to[sym, TWO], to[sym, ONE] = ONE, CLOSED
        begins[sym, [ONE, TWO]] = False
    return to, begins


TO, BEGINS = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES of every codepoint."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE] = SPACES
    return table


def symbols(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Symbol of every codepoint; what depends on the next two characters is settled here."""
    sym = classes()[points]
    sym[borders] = BORDER
    follows = np.r_[sym[1:], BORDER]
    white = (sym == SPACES) & (follows != SPACES) & (follows != BORDER)
    sym[white] = np.where(points[white] == 0x20, BLANK, SPACE)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        ahead = np.r_[points, 0, 0]
        a, b = ahead[quote + 1], ahead[quote + 2]
        sym[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        for x, y in ("re", "ve", "ll"):
            sym[quote[(a == ord(x)) & (b == ord(y))]] = LONG
    return sym


def scan(sym: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Whether a slice begins at each symbol."""
    n = len(sym)
    rows = -(-n // lane)
    grid = np.full(rows * lane, BORDER, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, lane).T)
    states = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))       # each lane's function: start state to end state
    flat = TO.ravel()
    for k in range(lane):
        states = flat[grid[k][:, None] * np.uint8(8) + states]
    step = 1
    while step < rows:                                              # inclusive scan of the lane functions by composition
        states[step:] = np.take_along_axis(states[step:], states[:-step].astype(np.intp), axis=1)
        step *= 2
    now = np.r_[np.uint8(CLOSED), states[:-1, CLOSED]]
    begins, marks = BEGINS.ravel(), np.empty((lane, rows), bool)
    for k in range(lane):
        at = grid[k] * np.uint8(8) + now
        marks[k], now = begins[at], flat[at]
    return marks.T.ravel()[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, byte starts of the slices and of borders, index of each text's first slice)."""
    joined = "\0".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    borders = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    starts = np.flatnonzero(scan(symbols(points, borders)))
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    return joined.encode(), at[starts], np.searchsorted(starts, borders)


class Coder:
    """Ranks, merges and the cache of one worker process."""

    def __init__(self, path: str, most: int = CACHE_SLICES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.most = most
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        held = [b""] * size
        for token, rank in self.ranks.items():
            held[rank] = token
        self.length = np.array([len(t) for t in held], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(held), np.uint8)

        self._pair_table([t for t in held if len(t) > 1])

    def _pair_table(self, tokens: list[bytes]) -> None:
        """Hash table from two adjacent ids to the id of their bytes together, with linear probing."""
        ranks = self.ranks
        rows = [(ranks[t[:i]], ranks[t[i:]], ranks[t]) for t in tokens for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a = np.array(rows, np.uint64).reshape(-1, 3)
        keys = a[:, 0] << np.uint64(32) | a[:, 1]
        self.slot_bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.slot_keys = np.full(1 << self.slot_bits, np.iinfo(np.uint64).max, np.uint64)
        self.slot_ids = np.full(1 << self.slot_bits, NONE, np.int64)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.slot_ids[at] == NONE
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[free[one]]
            self.slot_keys[at[one]], self.slot_ids[at[one]] = keys[left[one]], a[left[one], 2].astype(np.int64)
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.slot_bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of each two adjacent ids together, NONE where there is none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at, out = self._slots(keys), np.full(len(keys), NONE, np.int64)
        left = np.arange(len(keys))
        while len(left):
            found = self.slot_ids[at]
            hit = self.slot_keys[at] == keys[left]
            out[left[hit]] = found[hit]
            on = ~hit & (found != NONE)
            left, at = left[on], (at[on] + 1) & ((1 << self.slot_bits) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of slices: in every slice the adjacent pair of lowest rank, leftmost first, is joined until none has a rank.

        All slices take their next step together; a step costs what the slices still at work hold.
        """
        done, work = {}, []
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                done[p] = np.int32(whole).tobytes()
            elif len(p) > LONG_SLICE:
                done[p] = np.asarray(self._merge_long(p), "<i4").tobytes()
            else:
                work.append(p)
        if not work:
            return done
        single = np.array([self.ranks[bytes([c])] for c in range(256)], np.int64)
        ids = single[np.frombuffer(b"".join(work), np.uint8)]
        who = np.repeat(np.arange(len(work)), [len(p) for p in work])
        pair = np.full(len(ids), NONE, np.int64)
        pair[:-1] = np.where(who[1:] == who[:-1], self.joined(ids[:-1], ids[1:]), NONE)
        while True:
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            size = np.diff(np.r_[first, len(who)])
            low = np.minimum.reduceat(pair, first)
            for i in np.flatnonzero(low == NONE).tolist():
                done[work[who[first[i]]]] = ids[first[i]:first[i] + size[i]].astype("<i4").tobytes()
            on = np.repeat(low != NONE, size)
            if not on.any():
                return done
            ids, who, pair, low = ids[on], who[on], pair[on], np.repeat(low, size)[on]
            at = np.flatnonzero(pair == low)
            at = at[np.r_[True, who[at[1:]] != who[at[:-1]]]]       # leftmost of each slice
            ids[at] = pair[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))                            # one id before each has gone
            ids, who, pair = ids[stay], who[stay], pair[stay]
            for i in (at, at[(at > 0) & (who[at - 1] == who[at])] - 1):
                nxt = np.minimum(i + 1, len(ids) - 1)
                pair[i] = np.where((i + 1 < len(ids)) & (who[nxt] == who[i]), self.joined(ids[i], ids[nxt]), NONE)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one slice of any length, in n log n steps: a heap of pairs over a linked list."""
        from heapq import heapify, heappop, heappush
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))             # part i is piece[i:end[i]], 0 once joined to the left
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        data, at, first = boundaries(texts)
        cut = at.tolist()
        pieces = [data[a:b] for a, b in zip(cut, cut[1:])]
        distinct, cache = set(pieces), self.cache
        found = self.merge([p for p in distinct if p not in cache])
        here = {p: found.get(p) or cache[p] for p in distinct}.__getitem__
        if len(cache) + len(found) <= self.most:
            cache.update(found)
        return [b"".join(map(here, pieces[a + 1:b])) for a, b in zip(first.tolist(), first[1:].tolist())]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each id begins."""
        n = self.length[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of ids placed at their offsets."""
        if not len(ids):
            return b""
        n = self.length[ids]
        total = int(offsets[-1] + n[-1])
        source = np.repeat(self.start[ids] - offsets, n) + np.arange(total)
        return self.bytes[source].tobytes()


_LOADED: dict[str, Coder] = {}


def load(path: str) -> Coder:
    if path not in _LOADED:
        _LOADED[path] = Coder(path)
    return _LOADED[path]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32()))])
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _lists(flat: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets) of every whole text; offsets are the byte positions at which the ids begin.

    A null or empty text has no ids; repeated rows are all encoded; a null doc_id stays null; other columns are not
    read.  Special tokens are ordinary text.
    """
    path = ranks or default_ranks()

    def run(batches):
        coder = load(path)
        for b in slices(batches, 128):
            held = coder.encode([t or "" for t in b.column(1).to_pylist()])
            flat = np.frombuffer(b"".join(held), "<i4")
            sizes = [len(x) // 4 for x in held]
            at = coder.offsets(flat)
            ends = np.cumsum(sizes)
            base = np.r_[at, 0][ends - sizes] if len(flat) else np.zeros(len(sizes), np.int64)
            yield record(_ENCODED, doc_id=b.column(0).cast(pa.int64()), ids=_lists(flat, sizes), offsets=_lists(at - np.repeat(base, sizes), sizes))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that `encode`'s ids stand for."""
    path = ranks or default_ranks()

    def run(batches):
        coder = load(path)
        for b in slices(batches, 128):
            ids, at = b.column(1), b.column(2)
            flat, place = ids.flatten().to_numpy(), at.flatten().to_numpy()
            cut = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))].tolist()
            yield record(_DECODED, doc_id=b.column(0), ids=ids, decoded=[coder.decode(flat[i:j], place[i:j]) for i, j in zip(cut, cut[1:])])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
