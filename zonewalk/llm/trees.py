"""Gradient-boosted trees on numeric columns with monotonic constraints, scored through flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Nodes of all trees end to end; a leaf has feature -1. A node's children are left[i] and right[i]."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values, for all rows and trees at once, one level of the trees at a time."""
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            below = x[row, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(below, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray, signs: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 10, l2: float = 1.0) -> Forest:
    """Fit log-odds of y in {0, 1}. signs[j] = 1 or -1: the score never falls or never rises with column j."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(n, base)

    def leaf(v: float) -> int:
        for a, b in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, v * rate)):
            a.append(b)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, levels: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        at = leaf(float(np.clip(-total_g / (total_h + l2), low, high)))
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(d if levels and len(rows) >= 2 * least else 0):
            k = len(cuts[j])
            if not k:
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=k + 1))[:k] for w in (g[rows], h[rows], np.ones(len(rows))))
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = -(gl * vl + (hl + l2) * vl**2 / 2) - (gr * vr + (hr + l2) * vr**2 / 2) + total_g * value[at] / rate + (total_h + l2) * (value[at] / rate) ** 2 / 2
            gain[(nl < least) | (len(rows) - nl < least) | (signs.get(j, 0) * (vr - vl) < 0)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i, float(vl[i]), float(vr[i]))
        _, j, i, vl, vr = best
        if j >= 0:
            mid, sign = (vl + vr) / 2, signs.get(j, 0)
            go = binned[rows, j] <= i
            lo, hi = ((low, mid), (mid, high)) if sign > 0 else ((mid, high), (low, mid)) if sign < 0 else ((low, high), (low, high))
            feature[at], threshold[at] = j, float(cuts[j][i])
            left[at] = grow(rows[go], g, h, levels - 1, *lo)
            right[at] = grow(rows[~go], g, h, levels - 1, *hi)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), depth, -4.0, 4.0))
        own = Forest(np.array(roots[-1:]), *(np.array(a) for a in (feature, threshold, left, right, value)), 0.0, depth)
        score += own.predict(x)
    return Forest(np.array(roots), *(np.array(a) for a in (feature, threshold, left, right, value)), base, depth)
