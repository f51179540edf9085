"""Gradient-boosted trees on binned features, small enough to travel with a task."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    feature: np.ndarray  # of each inner node of a full binary tree, -1 where nothing was split
    cut: np.ndarray  # bins up to the cut go left
    value: np.ndarray  # of each leaf


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner edges for each column, at quantiles of its values."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at, method="lower")) if len(c) else np.zeros(0) for c in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.int32)
    for k, e in enumerate(edges):
        out[:, k] = np.searchsorted(e, x[:, k], side="left")
    return out


def best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, features: list[int], ridge: float, least: float) -> tuple[float, int, int]:
    """Gain, feature and cut of the best split of these rows."""
    best = (1e-9, -1, 0)
    total_g, total_h = g.sum(), h.sum()
    for f in features:
        gl = np.cumsum(np.bincount(binned[:, f], g, bins))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, bins))[:-1]
        gr, hr = total_g - gl, total_h - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
        gain[(hl < least) | (hr < least)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    return best


def grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int, features: list[int], rate: float, ridge: float = 1.0, least: float = 1.0) -> Tree:
    """A tree for gradients g and second derivatives h."""
    inner = (1 << depth) - 1
    feature, cut = np.full(inner, -1), np.zeros(inner, int)
    node = np.zeros(len(g), int)
    for k in range(inner):
        rows = np.flatnonzero(node == k)
        right = np.zeros(len(rows), bool)
        if len(rows):
            _, f, c = best_split(binned[rows], g[rows], h[rows], bins, features, ridge, least)
            feature[k], cut[k] = f, c
            if f >= 0:
                right = binned[rows, f] > c
        node[rows] = 2 * k + 1 + right
    leaf = node - inner
    n = 1 << depth
    value = -rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + ridge)
    return Tree(feature, cut, value)


def leaves(tree: Tree, binned: np.ndarray) -> np.ndarray:
    node = np.zeros(len(binned), int)
    inner = len(tree.feature)
    rows = np.arange(len(binned))
    for _ in range((inner + 1).bit_length() - 1):
        f = tree.feature[node]
        node = 2 * node + 1 + ((f >= 0) & (binned[rows, f] > tree.cut[node]))
    return node - inner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Boosted(NamedTuple):
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = to_bins(np.asarray(x, float).reshape(-1, len(self.edges)), self.edges)
        return sigmoid(self.start + sum((t.value[leaves(t, binned)] for t in self.trees), np.zeros(len(binned))))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.2) -> Boosted:
    """Log-loss boosting; both classes must occur."""
    edges = bin_edges(x, bins)
    binned = to_bins(x, edges)
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    at, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = sigmoid(at)
        tree = grow(binned, p - y, p * (1 - p), depth, bins, list(range(x.shape[1])), rate, least=0.5)
        at += tree.value[leaves(tree, binned)]
        trees.append(tree)
    return Boosted(edges, start, trees)
