"""Vectorised hashing of words in whole texts (numpy, no Spark)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: White space that separates words: blank and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each of the 64 bits over all the others."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def powers(n: int) -> np.ndarray:
    """Powers 0 .. n-1 of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 64) - 1, _BASE, U64)]), dtype=U64)
    return _powers[:n]


class Words:
    """The words of some texts in one buffer.

    ``start``, ``end``: byte offsets of each word in its own text; ``doc``: the text's index;
    ``hash``: 64 bits of each word's bytes; ``first``: index of each text's first word, one more at the end.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = ~_SPACE[data]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        start = np.flatnonzero(edge == 1)
        end = np.flatnonzero(edge == -1)  # the buffer ends with a blank
        self.doc = np.searchsorted(at, start, side="right") - 1
        self.first = np.searchsorted(start, at)
        if len(start):
            size = end - start
            inner = np.flatnonzero(inside)
            begins = np.cumsum(size) - size
            place = np.arange(len(inner)) - np.repeat(begins, size)
            value = (data[inner].astype(U64) + U64(1)) * powers(int(size.max()))[place]
            self.hash = mix(np.add.reduceat(value, begins) + size.astype(U64))
        else:
            self.hash = np.zeros(0, U64)
        self.start, self.end = start - at[self.doc], end - at[self.doc]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within one text, and the index of each run's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = np.zeros(n, U64)
        for j, p in enumerate(powers(k)):
            h += self.hash[j : j + n] * p
        ok = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(h[ok]), ok
