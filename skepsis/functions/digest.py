"""md5 of very many short texts at once, for draws that `hashing` defines: a numpy helper for use inside tasks."""
from __future__ import annotations

import math
from hashlib import md5

import numpy as np


def digester(longest: int = 55, tile: int = 1 << 15):
    """The function `digests(heads, tails)`.  It goes to the workers by value, so it needs nothing of this package there.

    Texts of up to `longest` bytes, those of one block, are worked on together, about `tile` at once.
    """
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    shift = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    sine = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
    order = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)

    def rounds(words: list, shape) -> list[np.ndarray]:
        """The four words of the digests of one-block texts; `words` are its 16 words, arrays or plain numbers."""
        a, b, c, d = (np.full(shape, x, np.uint32) for x in start)
        f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f); f &= b; f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f); f &= d; f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f); f ^= d
            else:
                np.bitwise_not(d, out=f); f |= b; f ^= c
            w, s = words[order[i // 16](i)], shift[i // 16][i % 4]
            if isinstance(w, int):
                f += np.uint32((w + sine[i]) % 2 ** 32)
            else:
                f += w
                f += np.uint32(sine[i])
            f += a
            np.left_shift(f, np.uint32(s), out=t)
            f >>= np.uint32(32 - s)
            f |= t
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        for x, first in zip((a, b, c, d), start):
            x += np.uint32(first)
        return [a, b, c, d]

    def digests(heads: list[bytes], tails: list[bytes]):
        """Yields (i, j, words): the digests of heads[i] + tails[j] for index arrays i and j, as four little-endian words of shape (len(i), len(j)).

        Every pair comes once, in tiles of about `tile`.  Heads and tails of equal length share a block layout, so a tile only puts
        their bytes together; texts over `longest` bytes take the library's way.
        """
        by_length = lambda xs: [(n, np.flatnonzero(lengths == n)) for lengths in [np.array([len(x) for x in xs], np.int64)] for n in np.unique(lengths).tolist()]

        def layout(texts, at, n, end):
            block = np.zeros((len(texts), 64), np.uint8)
            if n:
                block[:, at:at + n] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
            if end is not None:
                block[:, end] = 0x80
                block[:, 56:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
            return block.view("<u4")

        heads_of, tails_of = by_length(heads), by_length(tails)
        for n, js in tails_of:
            for js in np.split(js, range(tile, len(js), tile)):
                for m, every in heads_of:
                    for is_ in np.split(every, range(max(1, tile // len(js)), len(every), max(1, tile // len(js)))):
                        hs, ts = [heads[i] for i in is_], [tails[j] for j in js]
                        if m + n > longest:
                            raw = b"".join(md5(h + t).digest() for h in hs for t in ts)
                            yield is_, js, list(np.moveaxis(np.frombuffer(raw, "<u4").reshape(len(hs), len(ts), 4), -1, 0))
                            continue
                        h, t = layout(hs, 0, m, None), layout(ts, m, n, m + n)
                        word = lambda k: int(t[0, k]) if 4 * k > m + n else (h[:, None, k] | t[None, :, k]) if 4 * k < m else t[None, :, k]
                        yield is_, js, rounds([word(k) for k in range(16)], (len(hs), len(ts)))

    return digests
