"""FTRL-proximal logistic regression over hashed binary features, for one worker."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")

# Odd multipliers that keep kinds of feature apart.
MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
CACHED = 100_000
STEMS = (4, 5, 6)


class Features:
    """Coordinates of a text: words, their stems, neighbouring words and words one apart."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, tuple] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        for word in set(words):
            if word not in known:
                known[word] = (xxhash.xxh64_intdigest(word), *(xxhash.xxh64_intdigest(f"{word[:k]}-") for k in STEMS if len(word) > k))
        return np.array([known[w][0] for w in words], dtype=np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.empty(0, dtype=np.uint32)
        h = self._hashes(words)
        stems = np.fromiter({s for w in set(words) for s in self.known[w][1:]}, dtype=np.uint64)
        with np.errstate(over="ignore"):
            pairs = h[:-1] * MIX[1] + h[1:] * MIX[2]
            skips = h[:-2] * MIX[2] + h[2:] * MIX[3]
            kinds = [np.unique(h) * MIX[0], stems * MIX[3], pairs * MIX[0], skips * MIX[1]]
            return np.unique(np.concatenate(kinds) >> self.shift).astype(np.uint32)


class Ftrl:
    """Per-coordinate learning rates and L1 sparsity; the last coordinate is an unpenalised bias."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)
        self.bias = 1 << bits

    def start_from(self, share: float) -> None:
        """Let the bias alone give ``share`` before the first row, so that rows do not spend their gradient on it."""
        self.n[self.bias] = 100.0
        self.z[self.bias] = -np.log(share / (1 - share)) * ((self.beta + 10.0) / self.alpha + self.l2)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((np.abs(self.z) > self.l1) | (np.arange(len(self.z)) == self.bias))
        return at, self.weights(at)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))
