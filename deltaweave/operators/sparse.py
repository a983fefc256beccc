"""Assignments of least total cost without the matrix of all costs.

A pair costs weights[0] * (1 - similarity) + weights[1] * distance. The distance
and a bound of the similarity are cheap: a common subsequence is no longer than the
shorter text. So a pair's cost is computed only where its bound does not settle the
matter, and then for all open pairs of an element at once.

The assignment is solved over a few cheap pairs for each element, by shortest
augmenting paths with potentials u and v. Its potentials are a certificate: if no
pair of the whole matrix costs less than u + v, the assignment is one of least cost
among all. Pairs that do cost less are added, and it is solved again. Of the smaller
side every element has, besides its pairs, a way out that is dearer than any pair;
since the larger side has room for all, it is never taken in the end.

Memory: the pairs looked at, and rows of bounds, ROWS elements at a time.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Pairs of each element to begin with and added at a time; pairs tried at first; elements whose bounds are made at a time.
FIRST, MORE, TRIED, ROWS = 2, 8, 128, 64
#: A text of so many characters fits one word of bits.
WORD = 64
SLACK = 1e-12


class Texts:
    """Texts of one side with their characters as numbers, 0 beyond their end."""

    def __init__(self, texts: list[str], numbers: dict[str, int]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.codes = np.zeros((len(texts), int(self.lengths.max(initial=0))), np.int32)
        flat = np.fromiter((numbers.setdefault(ch, len(numbers) + 1) for t in texts for ch in t), np.int32, int(self.lengths.sum()))
        self.codes[np.arange(self.codes.shape[1]) < self.lengths[:, None]] = flat


def common(x: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """Longest common subsequence of x (at most WORD numbers) with every row of y (0 beyond its end): a bit for each place of x, all rows at once."""
    where = np.zeros(kinds + 1, np.uint64)
    for i, ch in enumerate(x.tolist()):
        where[ch] |= np.uint64(1 << i)
    s = np.full(len(y), ~np.uint64(0))
    for column in y.T:
        hit = s & where[column]
        s = (s + hit) | (s - hit)
    return len(x) - np.bitwise_count(s & np.uint64((1 << len(x)) - 1)).astype(np.int64)


class Costs:
    """Costs of two lists of (ord, content, x, y) on demand."""

    def __init__(self, a: list, b: list, similarity, weights: tuple[float, float]):
        self.similarity, self.weights = similarity, weights
        self.numbers: dict[str, int] = {}
        self.sides = tuple(Texts([x[1] for x in side], self.numbers) for side in (a, b))
        self.places = tuple(np.array([x[2:] for x in side], float).reshape(-1, 2) for side in (a, b))

    def __len__(self) -> int:
        return len(self.places[0])

    @property
    def columns(self) -> int:
        return len(self.places[1])

    def flipped(self) -> Costs:
        out = object.__new__(Costs)
        out.__dict__ = self.__dict__ | {"sides": self.sides[::-1], "places": self.places[::-1]}
        return out

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """What pairs of these rows cost at least, from places and lengths."""
        la, lb = self.sides[0].lengths[rows][:, None], self.sides[1].lengths
        like = np.where(la + lb == 0, 1.0, 2 * np.minimum(la, lb) / np.maximum(la + lb, 1))
        (pa, pb) = self.places
        return self.weights[0] * (1 - like) + self.weights[1] * np.hypot(pa[rows, 0][:, None] - pb[:, 0], pa[rows, 1][:, None] - pb[:, 1])

    def of(self, row: int, columns: np.ndarray) -> np.ndarray:
        """Costs of one row's pairs."""
        a, b = self.sides
        n, lengths = int(a.lengths[row]), b.lengths[columns]
        if n <= WORD:
            found = common(a.codes[row, :n], b.codes[columns, : lengths.max(initial=0)], len(self.numbers))
            like = np.where(n + lengths == 0, 1.0, 2 * found / np.maximum(n + lengths, 1))
        else:
            like = np.array([self.similarity(a.texts[row], b.texts[j]) for j in columns.tolist()], float)
        (pa, pb) = self.places
        return self.weights[0] * (1 - like) + self.weights[1] * np.hypot(pa[row, 0] - pb[columns, 0], pa[row, 1] - pb[columns, 1])

    def dearest(self) -> float:
        """More than any pair can cost."""
        every = np.concatenate(self.places)
        return 1 + self.weights[0] + self.weights[1] * float(np.hypot(*np.ptp(every, axis=0)))


def cheapest(costs: Costs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and costs of the k cheapest pairs of every row over the whole matrix, cheapest first."""
    n, m = len(costs), costs.columns
    k = min(k, m)
    columns, least = np.zeros((n, k), np.int64), np.zeros((n, k))
    for begin in range(0, n, ROWS):
        for i, bound in enumerate(costs.bounds(np.arange(begin, min(n, begin + ROWS))), begin):
            some = np.argpartition(bound, TRIED - 1)[:TRIED] if m > TRIED else np.arange(m)
            found = costs.of(i, some)
            if m > TRIED:
                rest = bound <= np.partition(found, k - 1)[k - 1]
                rest[some] = False
                rest = np.flatnonzero(rest)
                some, found = np.concatenate([some, rest]), np.concatenate([found, costs.of(i, rest)])
            best = np.lexsort((some, found))[:k]
            columns[i], least[i] = some[best], found[best]
    return columns, least


def solve(pairs: list[dict[int, float]], columns: int, way_out: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each row (columns and on: its way out), u and v: least total cost over the given pairs."""
    n = len(pairs)
    u, v = np.zeros(n), np.zeros(columns + n)
    owner, mate = np.full(columns + n, -1), np.full(n, -1)
    edges = [[*row.items(), (columns + i, way_out)] for i, row in enumerate(pairs)]
    for i, row in enumerate(edges):
        j, c = min(row, key=lambda e: e[1])
        u[i] = c
        if owner[j] < 0:
            owner[j], mate[i] = i, j
    for start in np.flatnonzero(mate < 0).tolist():
        best, via, heap, done = {}, {}, [], {}
        row, far = start, 0.0
        while True:
            base = far - u[row]
            for j, c in edges[row]:
                d = base + c - v[j]
                if j not in done and d < best.get(j, np.inf):
                    best[j], via[j] = d, row
                    heapq.heappush(heap, (d, j))
            far, j = heapq.heappop(heap)
            while j in done:
                far, j = heapq.heappop(heap)
            if owner[j] < 0:
                break
            done[j] = far
            row = int(owner[j])
        u[start] += far
        for k, d in done.items():
            u[owner[k]] += far - d
            v[k] -= far - d
        while True:
            row = via[j]
            owner[j], j, mate[row] = row, mate[row], j
            if row == start:
                break
    return mate, u, v


def assignment(costs: Costs, rows_best: tuple, columns_best: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least total cost, the smaller side whole, given ``cheapest`` of the rows and of the columns."""
    n, m = len(costs), costs.columns
    if not n or not m:
        return np.zeros(0, int), np.zeros(0, int)
    if n > m:
        columns, rows = assignment(costs.flipped(), columns_best, rows_best)
        order = np.argsort(rows)
        return rows[order], columns[order]
    pairs = [dict(zip(j, c, strict=True)) for j, c in zip(*(x.tolist() for x in rows_best), strict=True)]
    for j, (some, least) in enumerate(zip(*(x.tolist() for x in columns_best), strict=True)):
        for i, c in zip(some, least, strict=True):
            pairs[i][j] = c
    way_out = costs.dearest()
    while True:
        mate, u, v = solve(pairs, m, way_out)
        added = 0
        for begin in range(0, n, ROWS):
            rows = np.arange(begin, min(n, begin + ROWS))
            open_ = costs.bounds(rows) < u[rows][:, None] + v[:m] - SLACK
            for i, may in zip(rows.tolist(), open_, strict=True):
                may[list(pairs[i])] = False
                columns = np.flatnonzero(may)
                if not len(columns):
                    continue
                found = costs.of(i, columns)
                less = u[i] + v[columns] - found
                for at in np.argsort(-less, kind="stable")[:MORE].tolist():
                    if less[at] > SLACK:
                        pairs[i][int(columns[at])] = float(found[at])
                        added += 1
        if not added:
            return np.arange(n), mate
