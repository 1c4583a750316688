"""An R-tree over count vectors, for joins on overlap."""

from __future__ import annotations

import numpy as np

#: Entries of a node.
FANOUT = 16


def count_vectors(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """For each set of 64-bit hashes, how many fall into each of ``groups`` (a power of two) groups."""
    last = np.uint64(groups - 1)
    return np.stack([np.bincount((s & last).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)


def group_number(largest: int) -> int:
    """So many groups that a large set has about four elements in each: fewer groups make unlike sets look alike."""
    return 1 << max(4, min(10, (max(1, largest) // 4).bit_length()))


class CountRTree:
    """Points are count vectors. |A & B| is at most the sum over groups of min(a, b); for a node, min(a, largest b in it)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = self._packed(points, sizes)
        self.items, self.points, self.sizes = order, points[order], sizes[order]
        # levels from leaves to the root: bounds of the nodes, each covering FANOUT entries of the level below
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > FANOUT:
            cuts = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    @staticmethod
    def _packed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive packing: by size, and within runs of like size by the group that varies most."""
        order = np.argsort(sizes, kind="stable")
        if len(order) <= FANOUT:
            return order
        run = FANOUT * max(1, int(np.sqrt(len(order) / FANOUT)))
        spread = int(np.argmax(points.var(axis=0)))
        return np.concatenate([part[np.argsort(points[part, spread], kind="stable")] for part in np.split(order, range(run, len(order), run))])

    @staticmethod
    def _possible(point: np.ndarray, size: int, top: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int) -> np.ndarray:
        """Where some set of a size in low..high, bounded by ``top``, can reach the similarity num / den."""
        overlap = np.minimum(point, top).sum(axis=1)
        # J >= t with |B| >= low asks for |A & B| >= t (|A| + low) / (1 + t), and for sizes within the ratio t
        return (overlap * (num + den) >= num * (size + low)) & (den * high >= num * size) & (den * size >= num * low)

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Items whose bound on the overlap reaches the similarity num / den."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for k in reversed(range(len(self.levels))):
            top, low, high = self.levels[k]
            at = at[self._possible(point, size, top[at], low[at], high[at], num, den)]
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.points))]
        return self.items[at[self._possible(point, size, self.points[at], self.sizes[at], self.sizes[at], num, den)]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
