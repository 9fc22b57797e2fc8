"""64-bit hashes of words and of word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of ODD and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 2 * n)
        inverse = np.uint64(pow(int(ODD), -1, 2**64))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, x, np.uint64)))) for x in (ODD, inverse)]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all sequences of `width` words; position of the sequence plays no part."""
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: len(hashes) - width + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
