"""A vantage-point tree that deals 64-bit fingerprints out to shards, and exact search inside a shard.

A node has a vantage point and a radius. Points within the radius go inside, the others outside.
Two points at distance at most r that a node separates have the inner one at more than radius - r
from the vantage point (triangle bound), so a copy of each such inner point also goes outside.
By induction every pair at distance r or less meets in some shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SMALL = 512
COLUMNS = 8192  # compared with SMALL rows at a time
TRIES = 12


def distance(a: np.ndarray, b: np.uint64 | np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    leaf: int = -1
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None


@dataclass
class Tree:
    reach: int
    root: Node
    leaves: int = 0
    weights: list[int] = field(default_factory=list)

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of points and the leaves they go to; a point near a boundary goes to several."""
        at, leaf = [], []
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node.leaf >= 0:
                at.append(rows)
                leaf.append(np.full(len(rows), node.leaf))
                continue
            d = distance(points[rows], node.point)
            stack.append((node.inside, rows[d <= node.radius]))
            stack.append((node.outside, rows[d > node.radius - self.reach]))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(leaf)


def split(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave the least work, or None if no cut lessens it.

    Vantage points tried are spread evenly over the points and their complements' midpoints; the
    work of a cut is the sum of squares of both sides, copies included.
    """
    n = len(points)
    best, cut = 0.9 * n * n, None
    for p in points[np.linspace(0, n - 1, min(n, TRIES)).astype(int)]:
        upto = np.cumsum(np.bincount(distance(points, p), minlength=65)).astype(float)
        inner = upto
        outer = n - np.concatenate([np.zeros(reach), upto])[:65]  # beyond radius - reach
        work = inner**2 + outer**2
        work[inner >= n] = np.inf
        k = int(work.argmin())
        if work[k] < best:
            best, cut = work[k], (p, k)
    return cut


def build(sample: np.ndarray, total: int, leaf_points: int, reach: int) -> Tree:
    """A tree from a sample of distinct points whose leaves are expected to hold ``leaf_points`` of ``total``."""
    scale = total / max(1, len(sample))
    tree = Tree(reach, Node())
    stack = [(tree.root, np.sort(sample))]
    while stack:
        node, points = stack.pop()
        cut = split(points, reach) if len(points) * scale > leaf_points and len(points) >= 16 else None
        if cut is None:
            node.leaf = tree.leaves
            tree.leaves += 1
            continue
        node.point, node.radius = cut
        d = distance(points, node.point)
        node.inside, node.outside = Node(), Node()
        stack.append((node.inside, points[d <= node.radius]))
        stack.append((node.outside, points[d > node.radius - reach]))
    return tree


def near_links(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that join all points within ``reach`` of one another, directly or by a chain.

    Every pair in reach ends in the same component; dense clusters give one link per point and
    block, not one per pair.
    """
    links_a, links_b = [], []
    stack = [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        x = points[rows]
        cut = split(x[np.linspace(0, len(x) - 1, 256).astype(int)], reach) if len(x) > SMALL else None
        if cut is not None:
            d = distance(x, cut[0])
            inner, outer = rows[d <= cut[1]], rows[d > cut[1] - reach]
            if len(inner) < 0.95 * len(rows) and len(outer) < 0.95 * len(rows):
                stack += [inner, outer]
                continue
        for lo in range(0, len(x), SMALL):
            i, j = _joined(x[lo : lo + SMALL], x[lo:], reach)
            links_a.append(rows[lo + i])
            links_b.append(rows[lo + j])
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(links_a), np.concatenate(links_b)


def _joined(part: np.ndarray, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the components of ``part``, the first of ``x``, against all of ``x``.

    Each column links to the first row that sees it, and rows that share a column are linked through
    it: one link per pair of a row and a first-seer. Columns are read ``COLUMNS`` at a time, so that a
    dense shard takes no more memory than a sparse one.
    """
    a, b = [], []
    low = np.zeros((len(part), len(part)), bool)
    for at in range(0, len(x), COLUMNS):
        near = distance(part[:, None], x[None, at : at + COLUMNS]) <= reach
        if at == 0:
            np.fill_diagonal(near[:, : len(near)], False)
        busy = np.flatnonzero(near.any(axis=1))
        if not len(busy):
            continue
        near = near[busy]
        seen = np.flatnonzero(near.any(axis=0))
        near = near[:, seen]
        first = near.argmax(axis=0)
        a.append(busy[first])
        b.append(at + seen)
        order = np.argsort(first, kind="stable")
        heads, begin = np.unique(first[order], return_index=True)
        low[np.ix_(busy, busy[heads])] |= np.logical_or.reduceat(near[:, order], begin, axis=1)
    i, j = np.nonzero(low)
    keep = i != j
    return np.concatenate([*a, i[keep]]), np.concatenate([*b, j[keep]])
