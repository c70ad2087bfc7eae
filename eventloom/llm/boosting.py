"""Gradient-boosted trees on dense features with a logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: each inner node sends x[feature] > cut to the right."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def place(self, x: np.ndarray, features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
        return node - (2**self.depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            out += v[self.place(x, f, c)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    mean = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], 1)
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best, split = 1e-9, None
            if len(mine):
                gs, hs = g[mine].sum(), h[mine].sum()
                for f, e in enumerate(edges):
                    if len(e):
                        left_g = np.cumsum(np.bincount(binned[mine, f], g[mine], len(e) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[mine, f], h[mine], len(e) + 1))[:-1]
                        gain = left_g**2 / (left_h + l2) + (gs - left_g) ** 2 / (hs - left_h + l2) - gs**2 / (hs + l2)
                        gain[(left_h < 1.0) | (hs - left_h < 1.0)] = 0  # a leaf needs some evidence
                        if gain.max() > best:
                            best, split = gain.max(), (f, int(gain.argmax()))
            if split:
                features[k], cuts[k] = split[0], edges[split[0]][split[1]]
            node[mine] = 2 * k + 1 + (x[mine, features[k]] > cuts[k])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        margin += value[leaf]
        model.features.append(features)
        model.cuts.append(cuts)
        model.leaves.append(value)
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y by least squares: places and their values, to be joined by straight lines."""
    blocks: list[list[float]] = []  # sum of y, weight, lowest and highest score
    for s, v, w in sorted(zip(score.tolist(), y.tolist(), weight.tolist(), strict=True)):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v * w
            blocks[-1][1] += w
        else:
            blocks.append([v * w, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    at = np.array([e for b in blocks for e in (b[2], b[3])])
    return at, np.array([b[0] / b[1] for b in blocks for _ in range(2)])
