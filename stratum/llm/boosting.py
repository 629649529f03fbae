"""Gradient-boosted trees for two classes over binned features, in numpy; grown on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> dict:
    """Logistic loss, Newton steps, splits by histograms of quantile bins. A model is arrays of nodes, one row a tree."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(k, c, "left") for k, c in zip(cuts, x.T)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), int)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[t, node] = rate * total_g / (total_h + l2)
            if 2 * node + 2 >= nodes or len(rows) < 8:
                continue
            best = (1e-6, -1, 0)
            for f, k in enumerate(cuts):
                if len(k):
                    b = binned[rows, f]
                    left_g = np.cumsum(np.bincount(b, g[rows], len(k) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[rows], len(k) + 1))[:-1]
                    gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                    j = int(gain.argmax())
                    best = max(best, (float(gain[j]), f, j))
            if best[1] >= 0:
                _, f, j = best
                feature[t, node], cut[t, node] = f, cuts[f][j]
                at[rows] = np.where(binned[rows, f] <= j, 2 * node + 1, 2 * node + 2)
        score += value[t, at]
    return {"base": base, "feature": feature, "cut": cut, "value": value}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of class 1."""
    score = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"]):
        at = np.zeros(len(x), int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + np.where(x[rows, np.maximum(f, 0)] <= cut[at], 1, 2), at)
        score += value[at]
    return 1 / (1 + np.exp(-score))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score, 0.5 at least, from which on held-out rows reach the precision (with one more false one); 1.1 if none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    rate = right / (np.arange(len(y)) + 2)
    last = np.flatnonzero((rate >= precision) & (np.append(p[order][1:], -1) < p[order]))
    return max(0.5, float(p[order][last[-1]])) if len(last) else 1.1
