"""Boxes that part space so that all pairs of near vectors are met, each in one box; balls of vectors that need no comparison.

A tree of planes across single dimensions, fitted on a sample, cuts space into boxes. A
vector is seated in every box that comes within half of reach of it. The middle of two
vectors within reach of each other lies in one box, in which both are seated; that box
counts the pair, so every pair is counted once.
"""

from __future__ import annotations

from collections import deque

import numpy as np

MEAN_ROWS = 4  # rows of the sample that a box holds at least
CANDIDATES = 12  # dimensions of the largest spread, of which a plane takes one
LEAST, PIVOTS, MOST_BALLS = 32, 2_048, 2_048  # a ball's rows of the sample at least; rows that balls are looked for from; balls at most
CHUNK = 1 << 17  # distances that are held at once


class Boxes:
    """``axis`` and ``cut`` of each node, -1 for a box; ``low`` < coords <= ``high`` in a box."""

    def __init__(self, sample: np.ndarray, reach: float, rows: float):
        """Planes are put where the fewest rows of the sample are near; a node is a box when it
        has at most ``rows`` rows or when every plane would have most of its rows near."""
        self.margin = reach / 2 * (1 + 1e-9) + 1e-9
        dims, rows = sample.shape[1], max(rows, MEAN_ROWS)
        axis, cut, left, right, box, low, high = [], [], [], [], [], [], []
        waiting = deque([(np.arange(len(sample)), np.full(dims, -np.inf), np.full(dims, np.inf), None)])
        while waiting:
            held, lo, hi, parent = waiting.popleft()
            node = len(axis)
            if parent is not None:
                (left if parent[1] == 0 else right)[parent[0]] = node
            plane = self._plane(sample[held]) if len(held) > rows else None
            for column, value in ((axis, -1), (cut, 0.0), (left, -1), (right, -1), (box, -1)):
                column.append(value)
            if plane is None:
                box[node] = len(low)
                low.append(lo)
                high.append(hi)
                continue
            axis[node], cut[node] = plane
            below = sample[held, plane[0]] <= plane[1]
            under, over = hi.copy(), lo.copy()
            under[plane[0]] = over[plane[0]] = plane[1]
            waiting += [(held[below], lo, under, (node, 0)), (held[~below], over, hi, (node, 1))]
        self.axis, self.left, self.right, self.box = (np.array(c, np.int64) for c in (axis, left, right, box))
        self.cut, self.low, self.high = np.array(cut), np.array(low), np.array(high)

    def _plane(self, x: np.ndarray) -> tuple[int, float] | None:
        n, best = len(x), None
        ordered = np.sort(x, axis=0)
        spread = ordered[(n * 9) // 10] - ordered[n // 10]
        for a in np.argsort(-spread, kind="stable")[:CANDIDATES]:
            v = ordered[:, a]
            at = np.unique(np.linspace(0.3, 0.7, 9) * (n - 1)).astype(np.int64)
            cuts = (v[at] + v[np.minimum(at + 1, n - 1)]) / 2
            near = np.searchsorted(v, cuts + self.margin, "right") - np.searchsorted(v, cuts - self.margin, "left")
            k = int(np.argmin(near + np.abs(at - n / 2) / 4))
            if v[0] <= cuts[k] < v[-1] and (best is None or near[k] < best[0]):
                best = int(near[k]), int(a), float(cuts[k])
        return best[1:] if best and best[0] < 0.7 * n else None

    def seats(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, box): the boxes within half of reach of each row."""
        rows, boxes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin in range(0, len(x), 1024):
            row, node = np.arange(begin, min(begin + 1024, len(x))), np.zeros(min(1024, len(x) - begin), np.int64)
            while len(row):
                inner = self.axis[node] >= 0
                at, there = row[~inner], self.box[node[~inner]]
                apart = np.maximum(np.maximum(self.low[there] - x[at], x[at] - self.high[there]), 0)
                near = np.einsum("ij,ij->i", apart, apart) <= self.margin**2
                rows.append(at[near])
                boxes.append(there[near])
                row, node = row[inner], node[inner]
                gap = x[row, self.axis[node]] - self.cut[node]
                below, above = gap <= self.margin, gap >= -self.margin
                row, node = np.concatenate((row[below], row[above])), np.concatenate((self.left[node[below]], self.right[node[above]]))
        return np.concatenate(rows), np.concatenate(boxes)

    def linked_rows(self, x: np.ndarray, box: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(degree, first): of each row its number of pairs within reach whose middle lies in the box, and the first row they connect it with."""
        low, high, count = self.low[box], self.high[box], len(x)
        sided = np.flatnonzero(np.isfinite(low) | np.isfinite(high))
        widest = int(np.argmax(x.var(0)))
        order = np.argsort(x[:, widest], kind="stable")
        v, x = x[order, widest], x[order]
        inside = ((x - self.margin > low) & (x + self.margin <= high)).all(1)
        until = np.searchsorted(v, v + 2 * self.margin, "right")
        left, right, half, slack = screened(x)
        degree, first, begin = np.zeros(count, np.int64), order.copy(), 0
        while begin < count:
            end = min(begin + 256, count)
            end = min(end, begin + max(1, CHUNK // int(until[end - 1] - begin)))
            stop = int(until[end - 1])
            i, j = near_pairs(left[begin:end], right[begin:stop], half[begin:end], x[begin:end], x[begin:stop], reach, slack)
            later = j > i
            i, j = i[later] + begin, j[later] + begin
            unsure = np.flatnonzero(~(inside[i] | inside[j]))
            own = np.ones(len(i), bool)
            for axis in sided:
                middle = (x[i[unsure], axis] + x[j[unsure], axis]) / 2
                own[unsure[(middle <= low[axis]) | (middle > high[axis])]] = False
            i, j = i[own], j[own]
            degree += np.bincount(i, minlength=count) + np.bincount(j, minlength=count)
            one, two = first[i], first[j]
            other = one != two
            if other.any():
                first = merged(first, one[other], two[other])
            begin = end
        back = np.argsort(order)
        return degree[back], first[back]


def screened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(left, right, half, slack): half - left @ right.T is half the squared distance, in single precision and at most slack wrong."""
    x = x - x.mean(0)
    most = float(np.einsum("ij,ij->i", x, x).max())
    kind = np.float32 if most < 1e30 else np.float64
    x = x.astype(kind)
    half = np.einsum("ij,ij->i", x, x) / 2
    return np.column_stack((x, np.ones(len(x), kind))), np.column_stack((x, -half)), half, 1e-6 + 4e-7 * (x.shape[1] + 8) * most


def near_pairs(left: np.ndarray, right: np.ndarray, half: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of x and y within reach of each other; what single precision leaves open is computed exactly."""
    g = left @ right.T
    i, j = np.nonzero(g >= (half - (reach * reach + slack) / 2)[:, None])
    unsure = np.flatnonzero(g[i, j] <= half[i] - (reach * reach - slack) / 2)
    within = np.ones(len(i), bool)
    for part in range(0, len(unsure), CHUNK):
        some = unsure[part : part + CHUNK]
        within[some] = np.sqrt(((x[i[some]] - y[j[some]]) ** 2).sum(1)) <= reach
    return i[within], j[within]


def merged(first: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``first`` after the sets named ``one`` and ``two`` are joined, pair by pair, under the smaller name."""
    while len(one):
        root = np.arange(len(first))
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
        first, one, two = root[first], root[one], root[two]
        one, two = one[one != two], two[one != two]
    return first


class Balls:
    """Balls of less than half of reach around the centers of large tight groups: any two vectors of a ball are within reach."""

    def __init__(self, sample: np.ndarray, reach: float, least: float, seed: int):
        """Centers are means of ``least`` or more rows of the sample, found from at most ``PIVOTS`` of its rows."""
        self.half = reach / 2 - 1e-6
        least, free, centers = max(least, LEAST), np.ones(len(sample), bool), []
        if len(sample) < least:
            pivots = np.zeros(0, np.int64)
        else:
            pivots = np.random.default_rng(seed).permutation(len(sample))[:PIVOTS]
        held = []
        if len(pivots):
            left, right, half, _ = screened(sample)
        for begin in range(0, len(pivots), 64):
            part = pivots[begin : begin + 64]
            held.append((left[part] @ right.T >= (half[part] - reach * reach / 2)[:, None]).sum(1))
        held = np.concatenate([np.zeros(0, np.int64), *held])
        for p in pivots[np.argsort(-held, kind="stable")][: int((held >= least).sum())]:
            if len(centers) == MOST_BALLS:
                break
            if free[p]:
                center = sample[p]
                for within in (reach, 0.75 * reach, self.half):
                    gap = np.sqrt(((sample - center) ** 2).sum(1))
                    rows = free & (gap <= within)
                    if rows.sum() < least:
                        break
                    center = sample[rows].mean(0)
                else:
                    if all(np.linalg.norm(center - c) > reach for c in centers):  # so a row is in one ball at most
                        centers.append(center)
                    free &= np.sqrt(((sample - center) ** 2).sum(1)) > reach
                free[p] = False
        self.centers = np.array(centers).reshape(len(centers), sample.shape[1])
        self.square = np.einsum("ij,ij->i", self.centers, self.centers)
        #: rows, greatest distance and smallest label of each ball, once they are counted
        self.size, self.radius, self.name = np.ones(len(centers), np.int64), np.full(len(centers), self.half), [""] * len(centers)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ball, gap): the ball of each row, -1 if it is in none, and the distance from the nearest center."""
        ball, gap = np.full(len(x), -1), np.full(len(x), np.inf)
        for begin in range(0, len(x) if len(self.centers) else 0, 1024):
            part = x[begin : begin + 1024]
            nearest = np.argmin(self.square - 2 * (part @ self.centers.T), 1)
            gap[begin : begin + 1024] = np.sqrt(((part - self.centers[nearest]) ** 2).sum(1))
            ball[begin : begin + 1024] = np.where((gap[begin : begin + 1024] <= self.half) & (self.size[nearest] > 0), nearest, -1)
        return ball, gap

    def around(self, x: np.ndarray, ball: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, other): balls that a row may have vectors within reach in; two balls meet by the rows of the later one."""
        rows, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bound = (reach + self.radius) * (1 + 1e-9) + 1e-6
        for begin in range(0, len(x) if len(self.centers) else 0, 1024):
            part = x[begin : begin + 1024]
            d2 = np.einsum("ij,ij->i", part, part)[:, None] + self.square - 2 * (part @ self.centers.T)
            slack = 1e-6 + 1e-9 * float(d2.max() + self.square.max())
            row, other = np.nonzero((d2 <= bound**2 + slack) & (self.size > 0))
            own = ball[begin + row]
            asked = (own < 0) | (own > other)
            rows.append(begin + row[asked])
            others.append(other[asked])
        return np.concatenate(rows), np.concatenate(others)
