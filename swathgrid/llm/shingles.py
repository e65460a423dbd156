"""Sets of word shingles as sorted 64-bit hashes, and their parity sketches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from swathgrid.llm.common import words

U = np.uint64
SKETCH = 8  # words of 64 bits


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, n: int, most: int = 200_000):
        self.n, self.most, self.known, self.hashes = n, most, {}, []

    def sets(self, texts: Iterable[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
            self.hashes.clear()
        known, hashes, out = self.known, self.hashes, []
        for text in texts:
            ws = words(text)
            for w in set(ws).difference(known):
                known[w] = len(hashes)
                hashes.append(xxhash.xxh64_intdigest(w))
            out.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
        table = np.array(hashes, U)
        return [self._set(table[ids]) for ids in out]

    def _set(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, U)
        for i in range(n):
            h = mix(h + w[i : len(w) - n + 1 + i])
        return np.unique(h)


def parities(s: np.ndarray) -> np.ndarray:
    """The set's parity sketch as SKETCH signed words."""
    odd = np.bincount((s % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)
