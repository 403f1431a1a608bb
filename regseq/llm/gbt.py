"""Gradient-boosted trees on histograms, with monotonic constraints, kept as flat numpy arrays.

Fitting runs on the driver over a bounded sample; scoring is a vectorised walk through
the node arrays inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees' nodes end to end.  A leaf is its own child; `roots` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -40, 40)))


def constant(p: float) -> Trees:
    """A model of no trees, for samples of one class."""
    z = np.zeros(0, np.int64)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(z, np.zeros(0), z, z, np.zeros(0), z, 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Trees:
    """monotone: +1, -1 or 0 for each column: how the score may move as the column grows."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    p = float(y.mean())
    base = float(np.log(p / (1 - p)))
    logit = np.full(len(y), base)

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-logit))
        grad, hess = prob - y, prob * (1 - prob) + 1e-9
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, level = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            weight = float(np.clip(-g / (h + l2), low, high))
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = code[rows, j]
                    gs, hs, ns = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (grad[rows], hess[rows], None))
                    wl = np.clip(-gs / (hs + l2), low, high)
                    wr = np.clip(-(g - gs) / (h - hs + l2), low, high)
                    # The drop of the second-order loss with these, maybe clipped, weights.
                    gain = -(gs * wl + 0.5 * (hs + l2) * wl**2 + (g - gs) * wr + 0.5 * (h - hs + l2) * wr**2) + (g * weight + 0.5 * (h + l2) * weight**2)
                    ok = (ns >= least) & (len(rows) - ns >= least) & ((wr - wl) * monotone[j] >= 0)
                    if ok.any():
                        k = int(np.argmax(np.where(ok, gain, -np.inf)))
                        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k, wl[k], wr[k])
            if best is None:
                value[at] = rate * weight
                logit[rows] += rate * weight
                continue
            _, j, k, wl, wr = best
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at], right[at] = node(), node()
            mid = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            go = code[rows, j] <= k
            open_nodes += [(left[at], rows[go], *bounds[0], level + 1), (right[at], rows[~go], *bounds[1], level + 1)]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)
