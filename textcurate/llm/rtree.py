"""Count vectors of hashed shingle sets, and an R-tree over them.

A set's shingles are hashed into GROUPS groups; the counts of the groups are a point. Two
sets share at most the sum of their coordinates' minima, and a query shares with any point
below a node at most the summed minima with the node's upper corner: with the sets' sizes
that bounds the Jaccard similarity from above.
"""

from __future__ import annotations

import numpy as np

GROUP_BITS = 9
GROUPS = 1 << GROUP_BITS  # two large unrelated sets still look apart: their groups' counts differ by chance
FANOUT = 16


def count_vector(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


def may_link(shared: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes a and b with at most `shared` common members can reach num/den: den * s >= num * (a + b - s)."""
    return (den + num) * shared.astype(np.int64) >= num * (a.astype(np.int64) + b)


class CountRTree:
    """Bulk-loaded by size, then by the widest coordinates within a run of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        run = FANOUT * FANOUT
        parts = []
        for a in range(0, len(order), run):
            own = order[a : a + run]
            wide = np.argsort(-points[own].var(0))[:2] if len(own) > 1 else [0, 0]
            parts.append(own[np.lexsort((points[own, wide[1]], points[own, wide[0]]))])
        self.order = np.concatenate(parts) if parts else order
        self.points, self.sizes = points, sizes
        upper, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = []
        while len(upper) > 1 or not self.levels:
            cuts = np.arange(0, max(len(upper), 1), FANOUT)
            if not len(upper):
                break
            upper, low, high = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((upper, low, high))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Rows whose bound with (point, size) reaches num/den."""
        if not self.levels:
            return np.empty(0, np.int64)
        nodes = np.arange(len(self.levels[-1][0]))
        for upper, low, high in reversed(self.levels):
            nodes = nodes[nodes < len(upper)]
            shared = np.minimum(upper[nodes], point).sum(1)
            ok = may_link(shared, np.maximum(low[nodes], 0), np.int64(size), num, den)
            ok &= (den * high[nodes].astype(np.int64) >= num * size) & (num * low[nodes].astype(np.int64) <= den * size)
            nodes = (nodes[ok][:, None] * FANOUT + np.arange(FANOUT)).ravel()
        nodes = nodes[nodes < len(self.order)]
        rows = self.order[nodes]
        shared = np.minimum(self.points[rows], point).sum(1)
        return rows[may_link(shared, self.sizes[rows], np.int64(size), num, den)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
