"""Vectorised word scanning of UTF-8 text: every word as a mixed 64-bit hash.

Words are maximal runs of word bytes after lower-casing A-Z.  Both word rules
in use are decided byte by byte, since bytes from 0x80 up only occur inside
multi-byte characters, which belong to words under either rule.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class WordScanner:
    """``rule``: 'space' (runs without ASCII white space) or 'alnum' (runs of
    0-9, a-z and everything beyond ASCII)."""

    def __init__(self, rule: str):
        byte = np.arange(256)
        if rule == "space":
            self.is_word = ~((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)))
        else:
            low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
            self.is_word = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (byte >= 0x80)
        value = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        value[65:91] = value[97:123]
        self.value = value
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        base = 0x5851F42D4C957F2D
        self.pw = np.cumprod(np.full(n, base, U64))
        self.ipw = np.cumprod(np.full(n, pow(base, -1, 1 << 64), U64))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Word hashes in order, and the first word of each row (n + 1)."""
        n = len(data)
        rows = len(offsets) - 1
        if n == 0:
            return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
        if n > len(self.pw):
            self._grow(max(n, 2 * len(self.pw)))
        word = self.is_word[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begin[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(last)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(self.value[data] * self.pw[:n], out=total[1:])
        h = mix64((total[e + 1] - total[s]) * self.ipw[s])
        return h, np.searchsorted(s, offsets).astype(np.int64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (order matters)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * U64(0x9FB21C651E98DF25) + h[j:j + n]
    return mix64(acc + U64(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles of one text; the whole sequence if
    it is shorter; empty without words."""
    if len(h) == 0:
        return h
    return np.unique(gram_hashes(h, min(k, len(h))))
