"""Bounds of a group's products, for the kernel of :mod:`knn`.

The rows of a block are turned into the directions along which the block's vectors are longest, split at medians
into boxes of about ``BOX_ROWS`` rows, and each box keeps its least and greatest coordinate in the first directions and the
greatest length of what remains.  No row of a box has a larger product with a query than ``sum max(q_i * greatest_i,
q_i * least_i) + |q'| * length``.  A box whose bound does not reach a query's k-th distance so far is skipped for it;
all rows of the others are compared.  Directions and splits decide how much is skipped, never what is found.
"""

from __future__ import annotations

import numpy as np

BOX_ROWS = 32
KEPT = 12                   # directions with coordinates of their own
QUERIES = 8192              # searched at a time
SLICE = 512                 # of them bounded at a time for their first limit
AT_ONCE = 64                # boxes bounded at a time
LEAST_ROWS = 8192           # smaller blocks are searched without boxes
LEAST_QUERIES = 1024
WORTH = 0.5                 # share of (query, box) that may remain
HITS = 0.03                 # share of a block's pairs that may reach single precision's limit
JUDGED = 8192               # rows of a block from which that share is judged
CHECKED = 32_768            # pairs taken in double precision at a time
WAITING = 262_144           # pairs that wait for that


class Boxes:
    """Boxes of the rows ``D``; ``chunks(rows)`` yields (start, vectors in double precision) of a side."""

    def __init__(self, D, Q, chunks, seed: int = 42):
        n, dim = D.shape
        square = np.zeros((dim, dim))
        for side in (D, Q):
            some = side[::max(1, len(side) // QUERIES)].astype(np.float64, copy=False)
            some = some[np.isfinite(some).all(axis=1)]
            own = some.T @ some
            square += own / max(np.trace(own), 1e-300)
        self.kept, weight = min(KEPT, dim), np.zeros(dim)
        lengths, self.directions = np.linalg.eigh(square)
        self.directions = np.ascontiguousarray(self.directions[:, ::-1])
        boxes = 1 << max(0, int(np.ceil(np.log2(n / BOX_ROWS))))
        self.size = -(-n // boxes)
        first, length = np.empty((n, self.kept), np.float32), np.empty(n, np.float32)
        for at, m in chunks(D):
            turned = self.turned(m)
            turned[~np.isfinite(turned).all(axis=1)] = 0.0          # near nothing
            first[at:at + len(m)] = turned[:, :self.kept]
            length[at:at + len(m)] = np.linalg.norm(turned[:, self.kept:], axis=1)
        for _, m in chunks(Q[:QUERIES]):
            weight += np.nan_to_num(self.turned(m) ** 2, posinf=0.0).sum(axis=0)
        # Places beyond the rows hold rows again, so that all boxes are of one size; ``row`` is -1 there.
        order = np.arange(boxes * self.size).reshape(1, -1)
        while len(order) < boxes:
            held = first[order % n]
            axis = (held.var(axis=1) * weight[:self.kept]).argmax(axis=1)
            key = np.take_along_axis(held, axis[:, None, None], axis=2)[:, :, 0]
            halves = np.argpartition(key, order.shape[1] // 2, axis=1)
            order = np.take_along_axis(order, halves, axis=1).reshape(2 * len(order), -1)
        # Boxes in no order: each part of them is like the whole.
        order = order[np.random.default_rng(seed).permutation(boxes)]
        held = first[order % n]
        self.sides = np.concatenate([held.max(axis=1), held.min(axis=1), length[order % n].max(axis=1)[:, None]], axis=1)
        self.row, self.place = np.where(order < n, order, -1), order % n
        corner = np.maximum(np.abs(self.sides[:, :self.kept]), np.abs(self.sides[:, self.kept:-1]))
        self.longest = float(np.sqrt((corner.astype(np.float64) ** 2).sum(axis=1) + self.sides[:, -1].astype(np.float64) ** 2).max())

    def __len__(self) -> int:
        return len(self.row)

    def turned(self, units: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            return units @ self.directions

    def queries(self, units: np.ndarray) -> np.ndarray:
        """Queries as vectors whose product with ``sides`` is the bound."""
        turned = self.turned(units)
        first = turned[:, :self.kept]
        return np.concatenate([np.maximum(first, 0), np.minimum(first, 0), np.linalg.norm(turned[:, self.kept:], axis=1)[:, None]],
                              axis=1).astype(np.float32)

    def nearest(self, bounds: np.ndarray, need: int) -> np.ndarray:
        """Boxes of the greatest bounds per query that hold about ``need`` rows."""
        n = min(len(self), -(-need // self.size))
        return bounds.argmax(axis=1)[:, None] if n == 1 else np.argpartition(-bounds, n - 1, axis=1)[:, :n]


def search(boxes: Boxes, rows32: np.ndarray, q: np.ndarray, k: int, best, exact, offset: float, slack: float, longest: float,
           true_places, limits: np.ndarray | None = None) -> bool:
    """Fill ``best`` with the k nearest rows of the queries ``q``.  ``rows32``: the rows box by box, in single precision.
    ``exact(r, c)``: distances of pairs, infinite for those that do not count.  ``limits``: greatest distances that are
    wanted.  False, and nothing is found, where
    too little can be skipped."""
    n, size, q32, sides = len(q), boxes.size, q.astype(np.float32), boxes.queries(q)
    # Roundings of a bound's sum, of its factors and of the directions, as of a product.
    slack_of_bound = slack + (2 * boxes.kept + 16) * 2.0 ** -24 * max(1.0, abs(offset), longest * boxes.longest)
    limit, last = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
    for at in range(0, n, SLICE):
        with np.errstate(invalid="ignore"):
            bounds = sides[at:at + SLICE] @ boxes.sides.T
        near = boxes.row[boxes.nearest(bounds, 2 * k)].reshape(len(bounds), -1)
        r, c = np.repeat(np.arange(at, at + len(near)), near.shape[1]), near.ravel()
        dist = np.where(c >= 0, np.concatenate([exact(r[i:i + CHECKED], np.maximum(c[i:i + CHECKED], 0))
                                                for i in range(0, len(r), CHECKED)]), np.inf).reshape(near.shape)
        if k <= near.shape[1]:
            limit[at:at + len(near)] = np.partition(dist, k - 1, axis=1)[:, k - 1]
        if limits is not None:
            limit[at:at + len(near)] = np.minimum(limit[at:at + len(near)], limits[at:at + len(near)])
        if at == 0 and (bounds >= (offset - limit[:len(bounds)] - slack_of_bound)[:, None]).mean() > WORTH:
            return False
    first_limit, found, waiting, held, seen, due = limit, [], [], 0, 0, 0
    buffer, mask = np.empty(n * size, np.float32), np.empty(n * size + 8, bool)

    def settle():
        nonlocal limit, waiting, held
        if waiting:
            r, c = (np.concatenate(x) for x in zip(*waiting))
            for i in range(0, len(r), CHECKED):
                rr, cc = r[i:i + CHECKED], c[i:i + CHECKED]
                v = exact(rr, cc)
                good = ((v < limit[rr]) | ((v == limit[rr]) & (best.codes[cc] < last[rr]))) & np.isfinite(v)
                found.append((rr[good], cc[good], v[good]))
        waiting, held = [], 0

    def keep():
        nonlocal limit, last
        some = [f for f in found if len(f[0])]
        if some:
            best.add(*(np.concatenate(x) for x in zip(*some)))
        found.clear()
        limit = np.minimum(first_limit, best.values[:, -1])
        last = np.where(best.values[:, -1] <= limit, best.codes[best.at[:, -1]], np.iinfo(np.int64).max)

    total = 0
    for s in range(0, len(boxes), AT_ONCE):
        least = (offset - limit - slack).astype(np.float32)
        bound = (offset - limit - slack_of_bound).astype(np.float32)
        with np.errstate(invalid="ignore"):
            reached = boxes.sides[s:s + AT_ONCE] @ sides.T >= bound
        for box in range(s, s + len(reached)):
            rows = np.flatnonzero(reached[box - s])
            if not len(rows):
                continue
            shape = (size, len(rows))
            pairs = size * len(rows)
            products = np.matmul(rows32[box * size:(box + 1) * size], q32[rows].T, out=buffer[:pairs].reshape(shape))
            np.greater_equal(products, least[rows], out=mask[:pairs].reshape(shape))
            c, r = np.divmod(true_places(mask, pairs), len(rows))
            c = boxes.row[box][c]
            waiting.append((rows[r][c >= 0], c[c >= 0]))
            held, total = held + len(r), total + len(r)
            if held > WAITING:
                settle()
                keep()
                least = (offset - limit - slack).astype(np.float32)
        seen += len(reached) * size
        if total > HITS * n * max(seen, JUDGED):
            best.clear()
            return False
        settle()
        if seen >= due or s + AT_ONCE >= len(boxes) or sum(len(f[0]) for f in found) > 64 * n:
            keep()
            due = 2 * seen
    return True
