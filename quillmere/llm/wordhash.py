"""Vectorised 64-bit hashes of the words of a batch of texts, and of their shingles."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Odd multipliers (all equal 3 modulo 4), and the seed of the weights that bytes get.
BASE = 0x9E3779B97F4A7C17
MULTIPLIERS = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
PIECE = 1 << 21


class WordHasher:
    """Hashes words `[^\\x20\\x09-\\x0D]+` by polynomials over byte weights, all words of a piece at once."""

    def __init__(self, lower: bool = True):
        weights = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            weights[65:91] = weights[97:123]
        self.weights = weights
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.size = 0

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, PIECE)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(self.size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the offsets of each text's words among them."""
        data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
        self._grow(len(data) + 1)
        word = ~self.space[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.weights[data] * self.up[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * MULTIPLIERS[0]
        bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
        return mix64(hashes), np.searchsorted(starts, bounds)


def pieces(texts: list[bytes], limit: int = PIECE):
    """Cuts a batch into runs of texts of about limit bytes, so that the work arrays stay small."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words; of all words as one if there are fewer; none of none."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        total = mix64(total * MULTIPLIERS[1] + words[i : n - k + 1 + i] * MULTIPLIERS[2])
    return total
