"""Word shingle sets and MinHash signatures of texts, for one worker."""

from __future__ import annotations

import hashlib

import numpy as np

CACHED = 200_000
ROWS = 4096

# Odd constants of a 64-bit mixer.
MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, other letters as they are."""
    return text.encode().lower().split()


def exact_set(text: str, size: int) -> set:
    """The set of shingles itself; fewer words than ``size`` make one shingle of them all."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


class Signer:
    """Hashed shingle sets and their signatures with ``coordinates`` minima."""

    def __init__(self, size: int, coordinates: int):
        self.size = size
        self.factors = np.random.default_rng(20240229).integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        """Distinct 64-bit shingle hashes, sorted."""
        import xxhash

        words = words_of(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        width = min(self.size, len(h))
        with np.errstate(over="ignore"):
            mixed = np.full(len(h) - width + 1, width, dtype=np.uint64)
            for k in range(width):
                mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * MIX[0]
                mixed ^= mixed >> np.uint64(29)
            mixed *= MIX[1]
            mixed ^= mixed >> np.uint64(32)
            mixed *= MIX[2]
            mixed ^= mixed >> np.uint64(31)
        return np.unique(mixed)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of each coordinate, as signed 32-bit numbers."""
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), ROWS):
                least = np.minimum(least, (hashes[at : at + ROWS, None] * self.factors).min(axis=0))
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)

    @staticmethod
    def digest(hashes: np.ndarray) -> bytes:
        return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
