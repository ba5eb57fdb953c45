"""Gradient-boosted regression trees over binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, rounds: int = 160, depth: int = 4, rate: float = 0.08, least: int = 12, share: float = 0.7, bins: int = 48, seed: int = 9):
        self.rounds, self.depth, self.rate, self.least, self.share, self.bins, self.seed = rounds, depth, rate, least, share, bins, seed

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Squared error; each tree sees a share of the rows and half of the features."""
        rng = np.random.default_rng(self.seed)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, n, m = self._bin(x), len(y), x.shape[1]
        self.least = max(1, min(self.least, n // 16))
        self.base, self.trees = float(y.mean()), []
        pred = np.full(n, self.base)
        for _ in range(self.rounds):
            rows = rng.random(n) < self.share
            feats = np.sort(rng.choice(m, max(1, m // 2), replace=False))
            tree = self._tree(b, y - pred, np.flatnonzero(rows), feats)
            self.trees.append(tree)
            pred += self._apply(tree, b)
        return self

    def _tree(self, b: np.ndarray, r: np.ndarray, rows: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1)
        feat, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        parts = {1: rows}
        for node in range(1, size):
            own = parts.pop(node, None)
            if own is None or not len(own):
                continue
            value[node] = self.rate * r[own].sum() / (len(own) + 1.0)
            if node >= size // 2 or len(own) < 2 * self.least:
                continue
            width = self.bins + 1
            flat = (b[np.ix_(own, feats)] + np.arange(len(feats)) * width).ravel()
            cnt = np.bincount(flat, minlength=width * len(feats)).reshape(len(feats), width).cumsum(1)
            tot = np.bincount(flat, weights=np.repeat(r[own], len(feats)), minlength=width * len(feats)).reshape(len(feats), width).cumsum(1)
            left, right, all_ = cnt, len(own) - cnt, tot[:, -1:]
            gain = np.where((left >= self.least) & (right >= self.least), tot**2 / (left + 1) + (all_ - tot) ** 2 / (right + 1), -np.inf)
            f, c = np.unravel_index(int(gain.argmax()), gain.shape)
            if not np.isfinite(gain[f, c]) or gain[f, c] <= all_[0, 0] ** 2 / (len(own) + 1) + 1e-9:
                continue
            feat[node], cut[node] = feats[f], c
            goes = b[own, feats[f]] <= c
            parts[2 * node], parts[2 * node + 1] = own[goes], own[~goes]
        return feat, cut, value

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feat, cut, value = tree
        node = np.ones(len(b), np.int64)
        for _ in range(self.depth):
            f = feat[node]
            inner = f >= 0
            step = 2 * node + (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node])
            node = np.where(inner, step, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self._apply(t, b)
        return out
