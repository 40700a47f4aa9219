"""Gradient-boosted trees for a few classes, in numpy: histogram splits, softmax loss, vectorised scoring.

Made for models fitted on a bounded sample and shipped in a closure: some hundred shallow trees.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, columns: float = 0.6, seed: int = 3) -> None:
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge = classes, rounds, depth, rate, bins, ridge
        self.columns, self.seed = columns, seed  # each tree sees this share of the columns, so that it does not lean on one of several signs
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []  # per round and class: feature, bin, leaf values

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "BoostedTrees":
        self.edges, w = [], np.ones(len(x)) if weight is None else weight
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            self.edges.append((v[:-1] + v[1:]) / 2 if len(v) <= self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])))
        b = self._binned(x)
        score = np.zeros((len(x), self.classes))
        hot = np.eye(self.classes)[y]
        rng, d = np.random.default_rng(self.seed), x.shape[1]
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            trees = []
            for c in range(self.classes):
                seen = np.sort(rng.choice(d, max(1, round(self.columns * d)), replace=False))
                tree, at = self._tree(b, seen, w * (p[:, c] - hot[:, c]), w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6))
                score[:, c] += tree[2][at]
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _tree(self, b: np.ndarray, seen: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree of ``depth`` levels in heap order; a node without a useful split sends all to the left."""
        inner = 2**self.depth - 1
        feature, limit = np.zeros(inner, np.int64), np.full(inner, 255, np.uint8)
        at = np.zeros(len(b), np.int64)
        d, bins = len(seen), self.bins + 1
        cell = b[:, seen] + np.arange(d) * bins
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            here = at - first
            key = (here[:, None] * (d * bins) + cell).ravel()
            gh = np.stack([np.bincount(key, np.repeat(v, d), width * d * bins).reshape(width, d, bins) for v in (g, h)])
            left = gh.cumsum(3)
            total = left[..., -1:]
            gain = left[0] ** 2 / (left[1] + self.ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + self.ridge) - total[0] ** 2 / (total[1] + self.ridge)
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            for n in range(width):
                if flat[n, best[n]] > 1e-6:
                    j, limit[first + n] = divmod(int(best[n]), bins)
                    feature[first + n] = seen[j]
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > limit[at])
        at -= inner
        leaves = 2**self.depth
        value = -self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + self.ridge)
        return (feature, limit, value), at

    def scores(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.zeros((len(x), self.classes))
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        for trees in self.trees:
            for c, (feature, limit, value) in enumerate(trees):
                at = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (b[rows, feature[at]] > limit[at])
                out[:, c] += value[at - inner]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
