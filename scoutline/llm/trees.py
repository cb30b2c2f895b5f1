"""Gradient-boosted trees on small labelled samples, in numpy.

Used inside the driver on a sample of bounded size; the fitted trees are flat
node arrays, so scoring a batch is a few array operations per tree level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Flat node arrays of all trees; a leaf has feature -1."""
    feature: np.ndarray
    threshold: np.ndarray      # left if value <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float               # log odds before the first tree
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Every path from a root to a node as conditions (feature, is <=, threshold)."""
        out = []

        def walk(node, conditions):
            if conditions:
                out.append(tuple(conditions))
            f = int(self.feature[node])
            if f >= 0:
                t = float(self.threshold[node])
                walk(self.left[node], [*conditions, (f, True, t)])
                walk(self.right[node], [*conditions, (f, False, t)])

        for root in self.roots:
            walk(root, [])
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64,
              l2: float = 1.0, least_weight: float = 1.0, monotone: dict[int, int] | None = None,
              rows: float = 1.0, seed: int = 0) -> Trees:
    """Boosted trees for 0/1 labels on quantile histograms.

    ``monotone``: feature -> +1 (score may only rise with it) or -1.  A split
    that breaks the order is refused, and the two sides are bounded by the middle
    of their values, so deeper nodes keep the order too.  ``rows``: share of the
    sample drawn for each tree.  An empty sample gives no trees and log odds 0."""
    rng, monotone = np.random.default_rng(seed), monotone or {}
    nodes: list[list] = []
    if not len(y):
        return _flat(nodes, [], 0.0, depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, roots = np.full(len(y), start), []

    def grow(idx, g, h, left_depth, lo, hi, update):
        gs, hs = g[idx].sum(), h[idx].sum()
        weight = lambda a, b: np.clip(-a / (b + l2), lo, hi)
        loss = lambda a, b, w: a * w + 0.5 * (b + l2) * w * w
        own = weight(gs, hs)
        node = len(nodes)
        nodes.append([-1, 0.0, node, node, float(own) * rate])
        best = (1e-6, None)
        for f in range(x.shape[1]) if left_depth else ():
            if not len(edges[f]):
                continue
            gl = np.cumsum(np.bincount(binned[idx, f], g[idx], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[idx, f], h[idx], len(edges[f]) + 1))[:-1]
            wl, wr = weight(gl, hl), weight(gs - gl, hs - hl)
            gain = loss(gs, hs, own) - loss(gl, hl, wl) - loss(gs - gl, hs - hl, wr)
            gain[(hl < least_weight) | (hs - hl < least_weight) | (monotone.get(f, 0) * (wr - wl) < 0)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (f, at, wl[at], wr[at]))
        if best[1] is None:
            update[idx] += own * rate
            return node
        f, at, wl, wr = best[1]
        middle, order = (wl + wr) / 2, monotone.get(f, 0)
        go = binned[idx, f] <= at
        bounds = {1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}.get(order, ((lo, hi), (lo, hi)))
        left = grow(idx[go], g, h, left_depth - 1, *bounds[0], update)
        right = grow(idx[~go], g, h, left_depth - 1, *bounds[1], update)
        nodes[node] = [f, float(edges[f][at]), left, right, 0.0]
        return node

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        idx = np.arange(len(y)) if rows >= 1 else np.flatnonzero(rng.random(len(y)) < rows)
        root = len(nodes)
        grow(idx, p - y, p * (1 - p), depth, -np.inf, np.inf, np.zeros(len(y)))
        roots.append(root)
        margin = _flat(nodes, [root], 0.0, depth).margin(x) + margin
    return _flat(nodes, roots, start, depth)


def _flat(nodes, roots, start, depth) -> Trees:
    columns = list(zip(*nodes)) if nodes else [()] * 5
    f, t, left, right, value = (np.array(c, k) for c, k in zip(columns, (int, float, int, int, float)))
    return Trees(f, t, left, right, value, np.array(roots, int), start, depth)
