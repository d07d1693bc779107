"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth under the logistic loss; a missing cut sends every row to the left."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.cut = np.zeros((0, 2**depth - 1), np.float32)
        self.leaf = np.zeros((0, 2**depth), np.float32)
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows, width = x.shape
        varied = [f for f in range(width) if x[:, f].min() < x[:, f].max()]
        flags = [f for f in varied if np.isin(x[:, f], (0, 1)).all()]
        set_row, set_flag = np.nonzero(x[:, flags])  # few flags are set in a row
        numbers = [f for f in varied if f not in set(flags)]
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = {f: np.unique(np.quantile(x[:, f], shares, method="lower")) for f in numbers}
        binned = {f: np.searchsorted(edges[f], x[:, f], side="left") for f in numbers}
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(rows, self.start)
        trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int32), np.full(2**self.depth - 1, np.inf, np.float32)
            place = np.zeros(rows, np.int64)  # within the level
            for level in range(self.depth):
                n, first = 2**level, 2**level - 1
                best = np.full(n, 1e-6)
                g_all, h_all = np.bincount(place, grad, n), np.bincount(place, hess, n)

                def worth(g: np.ndarray, h: np.ndarray, g_all=g_all, h_all=h_all) -> np.ndarray:
                    """Gain of sending ``g`` and ``h`` to the left, for each node and cut."""
                    rest = h_all[:, None] - h
                    gain = g**2 / (h + 1) + (g_all[:, None] - g) ** 2 / (rest + 1) - (g_all**2 / (h_all + 1))[:, None]
                    return np.where((h < self.least) | (rest < self.least), 0, gain)

                def take(gain: np.ndarray, features: list[int], cuts: np.ndarray, best=best, first=first, n=n) -> None:
                    at = gain.argmax(1)
                    for node in np.flatnonzero(gain[np.arange(n), at] > best):
                        best[node] = gain[node, at[node]]
                        feature[first + node], cut[first + node] = features[at[node]], cuts[at[node]]

                if flags:
                    cell = place[set_row] * len(flags) + set_flag
                    g = g_all[:, None] - np.bincount(cell, grad[set_row], n * len(flags)).reshape(n, -1)
                    h = h_all[:, None] - np.bincount(cell, hess[set_row], n * len(flags)).reshape(n, -1)
                    take(worth(g, h), flags, np.full(len(flags), 0.5))
                for f in numbers:
                    cell = place * self.bins + binned[f]
                    cuts = len(edges[f])
                    g = np.bincount(cell, grad, n * self.bins).reshape(n, -1).cumsum(1)[:, :cuts]
                    h = np.bincount(cell, hess, n * self.bins).reshape(n, -1).cumsum(1)[:, :cuts]
                    take(worth(g, h), [f] * cuts, edges[f])
                at = first + place
                place = 2 * place + (x[np.arange(rows), feature[at]] > cut[at])
            g = np.bincount(place, grad, 2**self.depth)
            h = np.bincount(place, hess, 2**self.depth)
            leaf = self.rate * g / (h + 1)
            score += leaf[place]
            trees.append((feature, cut, leaf))
        if trees:
            self.feature, self.cut = np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees])
            self.leaf = np.stack([t[2] for t in trees]).astype(np.float32)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            place = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + place
                place = 2 * place + (x[rows, feature[at]] > cut[at])
            score += leaf[place]
        return score
