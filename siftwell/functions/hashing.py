"""64-bit hashes for Python workers, alike on every machine."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_CACHE_LIMIT = 2_000_000


class WordHasher:
    """Words to 64-bit hashes, remembered up to a bound."""

    def __init__(self, salt: bytes = b"word"):
        self.salt = salt
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_LIMIT:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            value = known.get(word)
            if value is None:
                digest = blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8, key=self.salt).digest()
                value = known[word] = int.from_bytes(digest, "little")
            out[i] = value
        return out


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(31))
        values = values * np.uint64(0x9E3779B97F4A7C15)
        values = values ^ (values >> np.uint64(29))
        values = values * np.uint64(0xD6E8FEB86659FD93)
        return values ^ (values >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; a shorter text is one run."""
    base = np.uint64(0x100000001B3F)
    n = len(hashes)
    with np.errstate(over="ignore"):
        width = min(size, n)
        rolled = np.full(max(1, n - size + 1), np.uint64(width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * base + hashes[k : k + len(rolled)]
    return np.unique(mix(rolled))
