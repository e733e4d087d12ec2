"""Small gradient-boosted trees and isotonic calibration, for a bounded sample of training rows in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS = 80, 3, 0.2, 64
LEAST = 4  # rows of a leaf


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, Newton leaves, exact histograms over `BINS` quantile bins. Deterministic: no row or column sampling."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    made = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(np.unique(y)) < 2:
        return made
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, found = np.full(len(y), made.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            for f, edge in enumerate(edges):
                key = (node - first) * (BINS + 1) + bins[:, f]
                size = width * (BINS + 1)
                gs, hs, ns = (np.bincount(key, w, size).reshape(width, -1).cumsum(axis=1) for w in (g, h, np.ones_like(g)))
                left, right = (gs, hs, ns), (gs[:, -1:] - gs, hs[:, -1:] - hs, ns[:, -1:] - ns)
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(left[2] < LEAST) | (right[2] < LEAST)] = -1
                gain = gain[:, : len(edge)]
                if gain.shape[1] == 0:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for j in np.flatnonzero(top > best):
                    best[j], feature[first + j], threshold[first + j] = top[j], f, edge[k[j]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        margin += value[leaf]
        found.append((feature, threshold, value))
    made.features, made.thresholds, made.values = (np.stack(c) for c in zip(*found, strict=True))
    return made


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, rate), increasing; between knots the rate is interpolated."""
    order = np.argsort(x, kind="stable")
    values, where = np.unique(x[order], return_inverse=True)
    n, s = np.bincount(where).astype(float), np.bincount(where, y[order])
    blocks: list[list[float]] = []  # rows, sum, first and last margin
    for v, rows, total in zip(values, n, s, strict=True):
        blocks.append([rows, total, v, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            rows2, total2, _, last = blocks.pop()
            blocks[-1][0] += rows2
            blocks[-1][1] += total2
            blocks[-1][3] = last
    knots = [(m, b[1] / b[0]) for b in blocks for m in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def calibrated(margin: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(margin, *knots), 0.0, 1.0) if len(knots[0]) else np.full(len(margin), 0.5)
