"""Euclidean distances from points to weighted points, summed without a look at each pair where the points lie on a line or plane."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Distances that one pass over two blocks holds.
PASS = 1 << 20
#: Pairs of points from which cells are worth their trouble; pairs of two cells that are compared one by one.
MANY, FEW = 1 << 22, 1 << 15
#: Nodes of a cell along an axis: what they leave out is some 1e-12 of a sum.
NODES = 14
#: Halvings of the square around all points, at most.
DEPTH = 24


def direct_sums(x: np.ndarray, y: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` the distances to all rows of ``y``, summed by each column of ``shares``."""
    totals = np.zeros((len(x), shares.shape[1]))
    step = max(1, PASS // max(1, len(y)))
    for at in range(0, len(x), step):
        away = np.zeros((len(x[at : at + step]), len(y)))
        for j in range(x.shape[1]):
            away += (x[at : at + step, j][:, None] - y[:, j]) ** 2
        totals[at : at + step] = np.sqrt(away) @ shares
    return totals


def distance_sums(x: np.ndarray, y: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """``direct_sums``; of many points on a line or plane by cells, in time that grows with the points instead of their pairs."""
    if not len(x) or not len(y) or x.shape[1] > 2 or len(x) * len(y) <= MANY:
        return direct_sums(x, y, shares)
    return cell_sums(x, y, shares)


def _basis(t: np.ndarray) -> np.ndarray:
    """The Lagrange polynomials of the Chebyshev nodes of [-1, 1] at places ``t``: a row a place."""
    k = np.arange(NODES)
    nodes = _nodes()
    sums = np.cos(np.arccos(np.clip(t, -1, 1))[:, None] * k) * np.where(k == 0, 1, 2)
    return sums @ np.cos(np.outer(k, np.arccos(nodes))) / NODES


def _nodes() -> np.ndarray:
    return np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def _products(parts: list[np.ndarray]) -> np.ndarray:
    """Of rows along each axis the rows of all their products."""
    return parts[0] if len(parts) == 1 else (parts[0][:, :, None] * parts[1][:, None, :]).reshape(len(parts[0]), -1)


@cache
def _halves(dims: int) -> list[np.ndarray]:
    """For each half of each axis: the polynomials of a cell at the nodes of that part of it."""
    one = [_basis((_nodes() + side) / 2) for side in (-1, 1)]
    return one if dims == 1 else [np.kron(a, b) for a in one for b in one]


@cache
def _between(offset: tuple[int, ...]) -> np.ndarray:
    """Distances from the nodes of a cell to those of one so many cells away, in halves of a cell."""
    grids = np.meshgrid(*[_nodes()] * len(offset), indexing="ij")
    at = np.stack([g.ravel() for g in grids], axis=1)
    return np.sqrt((((at + 2 * np.array(offset))[None] - at[:, None]) ** 2).sum(2))


class _Cells:
    """Points in the order of their cells, and the cells of each level that some pair came to."""

    def __init__(self, points: np.ndarray, low: np.ndarray, side: float):
        whole = np.minimum(((points - low) / side * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1)
        code = np.zeros(len(points), np.int64)
        for bit in range(DEPTH):
            for j in range(points.shape[1]):
                code |= ((whole[:, j] >> bit) & 1) << (bit * points.shape[1] + points.shape[1] - 1 - j)
        self.order = np.argsort(code, kind="stable")
        self.points, self.whole, self.code, self.low, self.side = points[self.order], whole[self.order], code[self.order], low, side
        self.dims = points.shape[1]
        self.start, self.end, self.split, self.first, self.parts = [np.array([0])], [np.array([len(points)])], [], [], []

    def at(self, level: int) -> np.ndarray:
        """Where the cells of a level are, in cells."""
        return self.whole[self.start[level]] >> (DEPTH - level)

    def descend(self, level: int, split: np.ndarray) -> None:
        """The cells marked go on as their parts on the next level."""
        bounds = np.flatnonzero(np.diff(self.code >> (self.dims * (DEPTH - level - 1)), prepend=-1))
        bounds = np.append(bounds, len(self.code))
        start, end = np.searchsorted(bounds, self.start[level]), np.searchsorted(bounds, self.end[level])
        parts = np.where(split, end - start, 0)
        first = np.cumsum(parts) - parts
        place = np.repeat(start - first, parts) + np.arange(parts.sum())
        self.start.append(bounds[place])
        self.end.append(bounds[place + 1])
        for known, new in ((self.split, split), (self.first, first), (self.parts, parts)):
            known.append(new)

    def halves(self, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of part of a cell: the cells of a level that are such parts, and the cells above them."""
        kind = (self.at(level) & 1) @ (1 << np.arange(self.dims)[::-1])
        above = np.repeat(np.arange(len(self.parts[level - 1])), self.parts[level - 1])
        return [(mine := np.flatnonzero(kind == k), above[mine]) for k in range(1 << self.dims)]

    def places(self, level: int, cell: int) -> np.ndarray:
        """The polynomials of a cell at its points."""
        width = self.side / (1 << level)
        inside = slice(self.start[level][cell], self.end[level][cell])
        at = self.whole[self.start[level][cell]] >> (DEPTH - level)
        t = (self.points[inside] - self.low - (at + 0.5) * width) / (width / 2)
        return _products([_basis(t[:, j]) for j in range(self.dims)])


def _met(a: _Cells, b: _Cells) -> tuple[list, list]:
    """Pairs of cells of a level that lie apart, and pairs whose points are to be compared, for each level.

    A pair of cells that touch each other goes on as the pairs of their parts, unless few points are in it.
    """
    apart, close = [], []
    i = j = np.array([0])
    for level in range(DEPTH + 1):
        far = np.abs(b.at(level)[j] - a.at(level)[i]).max(axis=1) > 1
        n = (a.end[level] - a.start[level])[i] * (b.end[level] - b.start[level])[j]
        few = ~far & ((n <= FEW) | (level == DEPTH))
        apart.append((i[far], j[far]))
        close.append((i[few], j[few]))
        on = ~far & ~few
        for side, cells in ((a, i), (b, j)):
            split = np.zeros(len(side.start[level]), bool)
            split[cells[on]] = True
            if not on.any():
                side.split.append(split)
                continue
            side.descend(level, split)
        if not on.any():
            return apart, close
        i, j = i[on], j[on]
        wide, high = a.parts[level][i], b.parts[level][j]
        pair = np.repeat(np.arange(len(i)), wide * high)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
        i, j = a.first[level][i][pair] + k // high[pair], b.first[level][j][pair] + k % high[pair]
    return apart, close


def cell_sums(x: np.ndarray, y: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Sums of distances by a fast multipole method, on squares that are halved where the points lie dense.

    Between cells that don't touch, a distance is a polynomial of both places up to some 1e-12 (the distance is smooth there): the points of a cell stand at its Chebyshev nodes,
    with the weights that give the same sum, and the sums at the nodes of the other give those at its points. Points of cells that touch are compared one by one.
    """
    low = np.minimum(x.min(axis=0), y.min(axis=0))
    side = float((np.maximum(x.max(axis=0), y.max(axis=0)) - low).max())
    if not side > 0:
        return np.zeros((len(x), shares.shape[1]))
    a, b = _Cells(x, low, side), _Cells(y, low, side)
    shares = shares[b.order]
    apart, close = _met(a, b)
    dims, width, size = x.shape[1], shares.shape[1], NODES ** x.shape[1]
    halves = _halves(dims)

    weights: list[np.ndarray] = [None] * len(apart)
    for level in reversed(range(len(apart))):
        here = np.zeros((len(b.start[level]), width, size))
        for cell in np.flatnonzero(~b.split[level]):
            here[cell] = shares[b.start[level][cell] : b.end[level][cell]].T @ b.places(level, cell)
        if level + 1 < len(apart):
            for move, (part, above) in zip(halves, b.halves(level + 1), strict=True):
                here[above] += (weights[level + 1][part].reshape(-1, size) @ move).reshape(-1, width, size)
        weights[level] = here

    totals = np.zeros((len(x), width))
    field = np.zeros((1, width, size))
    for level, (i, j) in enumerate(apart):
        if level:
            there, field = field, np.zeros((len(a.start[level]), width, size))
            for move, (part, above) in zip(halves, a.halves(level), strict=True):
                field[part] = (there[above].reshape(-1, size) @ move.T).reshape(-1, width, size)
        offset = b.at(level)[j] - a.at(level)[i]
        kind = (offset + 3) @ (7 ** np.arange(dims)[::-1])
        for k in np.unique(kind):
            mine = kind == k
            between = _between(tuple(offset[mine][0].tolist())).T * (side / (2 << level))
            field[i[mine]] += (weights[level][j[mine]].reshape(-1, size) @ between).reshape(-1, width, size)
        for cell in np.flatnonzero(~a.split[level]):
            totals[a.start[level][cell] : a.end[level][cell]] += a.places(level, cell) @ field[cell].T

    for level, (i, j) in enumerate(close):
        if not len(i):
            continue
        by_left = np.argsort(i, kind="stable")
        i, j = i[by_left], j[by_left]
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for at, to in zip(cuts, np.append(cuts[1:], len(i)), strict=True):
            mine = slice(a.start[level][i[at]], a.end[level][i[at]])
            there = np.concatenate([np.arange(b.start[level][cell], b.end[level][cell]) for cell in j[at:to]])
            totals[mine] += direct_sums(a.points[mine], b.points[there], shares[there])
    out = np.empty_like(totals)
    out[a.order] = totals
    return out
