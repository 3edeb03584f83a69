"""Histogram gradient boosting for binary targets, in numpy.

Features are cut into at most 255 quantile bins; each tree grows level by level
from histograms of gradients and hessians.  A fitted model is a handful of flat
arrays (feature, threshold, left child, value; the right child follows the left one), which are small, bounded by
`trees * 2 ** (depth + 1)` nodes, and traversed for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # int32 per node, -1 at leaves
    threshold: np.ndarray  # float64 per node: go left if x <= threshold (missing values are 0)
    left: np.ndarray  # int32 per node
    value: np.ndarray  # float64 per node
    roots: np.ndarray  # int32 per tree
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches; all trees and rows advance one level at a time."""
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                f = self.feature[node]
                right = part[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + right)
            out[lo : lo + 4096] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 5.0, bins: int = 64) -> Forest:
    """Fit on a sample held in memory; rows of either class may be missing, then the model is a constant."""
    n, m = x.shape
    p = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p / (1 - p)))
    edges, binned = [], np.zeros((n, m), np.int64)
    for j in range(m):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0)
        edges.append(e)
        binned[:, j] = np.searchsorted(e, x[:, j], side="left")
    width = bins + 1
    feature, threshold, left, value, roots = [], [], [], [], []
    margin = np.full(n, base)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        q = 1.0 / (1.0 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        roots.append(len(feature))
        open_, node = [len(feature)], np.zeros(n, np.int64)  # position in open_ or -1
        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
        place = np.zeros(n, np.int64) + roots[-1]
        for level in range(depth + 1):
            k = len(open_)
            live = node >= 0
            gs = np.bincount(node[live], g[live], k)
            hs = np.bincount(node[live], h[live], k)
            for i, at in enumerate(open_):
                value[at] = -rate * gs[i] / (hs[i] + l2)
            if level == depth:
                break
            slot = (node[live, None] * m + np.arange(m)) * width + binned[live]
            hg = np.bincount(slot.ravel(), np.repeat(g[live], m), k * m * width).reshape(k, m, width).cumsum(axis=2)
            hh = np.bincount(slot.ravel(), np.repeat(h[live], m), k * m * width).reshape(k, m, width).cumsum(axis=2)
            gain = hg**2 / (hh + l2) + (gs[:, None, None] - hg) ** 2 / (hs[:, None, None] - hh + l2) - (gs**2 / (hs + l2))[:, None, None]
            gain[(hh < least * 0.05) | (hs[:, None, None] - hh < least * 0.05)] = -1
            for j in range(m):
                gain[:, j, len(edges[j]) :] = -1
            best = gain.reshape(k, -1).argmax(axis=1)
            nxt, child = [], np.full(k, -1)
            cut_f, cut_b = best // width, best % width
            for i, at in enumerate(open_):
                if gain[i, cut_f[i], cut_b[i]] > 1e-6:
                    feature[at], threshold[at] = int(cut_f[i]), float(edges[cut_f[i]][cut_b[i]])
                    left[at] = len(feature)
                    child[i] = len(nxt)
                    for _side in range(2):
                        nxt.append(len(feature))
                        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
            rows = np.flatnonzero(live)
            at = node[rows]
            right = binned[rows, cut_f[at]] > cut_b[at]
            node[rows] = np.where(child[at] < 0, -1, child[at] + right)
            moved = rows[node[rows] >= 0]
            if not nxt:
                break
            place[moved] = np.array(nxt)[node[moved]]
            open_ = nxt
        margin += np.array(value)[place]
    if not roots:
        roots, feature, threshold, left, value = [0], [-1], [0.0], [-1], [0.0]
    return Forest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(value), np.array(roots, np.int32), base, depth)
