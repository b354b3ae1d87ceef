"""Distances of two sequences of states, and clusterings of a matrix of distances, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np

MISSING = "*"
METRICS = ("hamming", "lv", "osa", "lcs")


def trimmed(a: list[str]) -> list[str]:
    """Up to the last state that isn't missing."""
    n = len(a)
    while n and a[n - 1] == MISSING:
        n -= 1
    return a[:n]


#: Cells of a table of distances that are worked on at once.
CELLS = 1 << 22


def _padded(rows: list, number: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, trimmed, as rows of numbers, and their lengths."""
    rows = [trimmed(list(r)) for r in rows]
    out = np.full((len(rows), max(map(len, rows), default=0)), -1, np.int32)
    for i, row in enumerate(rows):
        out[i, : len(row)] = [number.setdefault(s, len(number)) for s in row]
    return out, np.array([len(r) for r in rows], np.int64)


def edit_distances(metric: str, left: list, right: list) -> np.ndarray:
    """Distances of each of the left sequences from each of the right ones, by one table over all pairs at once.

    lv is Levenshtein with the costs of substitution as the field's software has them: 1 for equal states, 0 for others;
    osa has swaps of neighbours at the cost of a substitution as well; lcs is the longer length less that of the longest
    common subsequence. A step of the table is one operation on the arrays of all pairs.
    """
    if metric not in ("lv", "osa", "lcs"):
        raise ValueError(f"unknown metric {metric!r}")
    number: dict = {}
    (x, nx), (y, ny) = _padded(left, number), _padded(right, number)
    out = np.zeros((len(x), len(y)))
    step = max(1, CELLS // max(1, len(y) * (y.shape[1] + 1)))
    for k in range(0, len(x), step):
        out[k : k + step] = _table(metric, x[k : k + step], nx[k : k + step], y, ny)
    return out


def _table(metric: str, x, nx, y, ny) -> np.ndarray:
    shape, width = (len(x), len(y)), y.shape[1]
    row = [np.full(shape, 0 if metric == "lcs" else j, np.int32) for j in range(width + 1)]
    before, out = row, np.zeros(shape, np.int32)
    columns = np.arange(len(y))

    def ended(i):
        done = np.flatnonzero(nx == i)
        if len(done):
            out[done] = np.stack([row[n][done, c] for c, n in zip(columns, ny)], 1)

    ended(0)
    for i in range(1, x.shape[1] + 1):
        now = [np.full(shape, 0 if metric == "lcs" else i, np.int32)]
        for j in range(1, width + 1):
            same = x[:, i - 1, None] == y[None, :, j - 1]
            if metric == "lcs":
                cell = np.maximum(np.maximum(row[j], now[j - 1]), row[j - 1] + same)
            else:
                cell = np.minimum(np.minimum(row[j], now[j - 1]) + 1, row[j - 1] + same)
                if metric == "osa" and i > 1 and j > 1:
                    swapped = (x[:, i - 1, None] == y[None, :, j - 2]) & (x[:, i - 2, None] == y[None, :, j - 1])
                    cell = np.where(swapped, np.minimum(cell, before[j - 2] + same), cell)
            now.append(cell.astype(np.int32))
        before, row = row, now
        ended(i)
    return np.maximum(nx[:, None], ny[None, :]) - out if metric == "lcs" else out


def lv(a: list[str], b: list[str]) -> float:
    return float(edit_distances("lv", [a], [b])[0, 0])


def osa(a: list[str], b: list[str]) -> float:
    return float(edit_distances("osa", [a], [b])[0, 0])


def lcs(a: list[str], b: list[str]) -> float:
    return float(edit_distances("lcs", [a], [b])[0, 0])


def silhouette(d: np.ndarray, member: np.ndarray) -> float:
    names = np.unique(member)
    if len(names) < 2:
        return 0.0
    means = np.stack([d[:, member == c].sum(1) for c in names], 1)
    sizes = np.array([(member == c).sum() for c in names])
    own = np.searchsorted(names, member)
    rows = np.arange(len(d))
    a = means[rows, own] / np.maximum(sizes[own] - 1, 1)
    other = means / sizes
    other[rows, own] = np.inf
    b = other.min(1)
    top = np.maximum(a, b)
    s = np.divide(b - a, top, out=np.zeros(len(d)), where=top > 0)
    return float(np.where(sizes[own] == 1, 0.0, s).mean())


def pam(d: np.ndarray, k: int) -> np.ndarray:
    """Partitioning around medoids: BUILD, in which the last of tied candidates wins, then SWAP by medoid while one gains."""
    n = len(d)
    total = d.sum(0)
    medoids = [n - 1 - int(total[::-1].argmin())]
    while len(medoids) < k:
        near = d[:, medoids].min(1)
        gains = np.maximum(near[:, None] - d, 0).sum(0)
        gains[medoids] = -np.inf
        medoids.append(n - 1 - int(gains[::-1].argmax()))
    for _ in range(100):
        changed = False
        for slot in range(k):
            rest = [m for j, m in enumerate(medoids) if j != slot]
            near = d[:, rest].min(1) if rest else np.full(n, np.inf)
            costs = np.minimum(near[:, None], d).sum(0)
            costs[rest] = np.inf
            best = int(costs.argmin())
            if costs[best] < costs[medoids[slot]]:
                medoids[slot], changed = best, True
        if not changed:
            break
    return d[:, medoids].argmin(1)


LINKAGES = ("single", "complete", "average", "mcquitty", "ward.D", "ward.D2", "median", "centroid")


def merging(d: np.ndarray, sizes: np.ndarray, linkage: str) -> Iterator[tuple[int, int, float]]:
    """The merges (i, j into it, their distance) of a matrix by Lance and Williams, the first of tied pairs first.

    d holds what the formulas work on: squared distances for ward.D2. Every cluster keeps its nearest among those behind
    it, so that a merge looks at the clusters once and again only for those whose nearest it changed.
    """
    n = len(d)
    d, sizes, alive = d.astype(float), sizes.astype(float), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    nearest, least = np.zeros(n, np.int64), np.full(n, np.inf)

    def look(i: int) -> None:
        behind = d[i, i + 1 :]
        nearest[i], least[i] = (i, np.inf) if not len(behind) else (i + 1 + behind.argmin(), behind.min())

    for i in range(n):
        look(i)
    for _ in range(n - 1):
        i = int(least.argmin())
        j = int(nearest[i])
        if not np.isfinite(least[i]):
            i, j = np.flatnonzero(alive)[:2].tolist()
        alive[[i, j]] = False
        rest = np.flatnonzero(alive)
        ni, nj, nm, a, b, dij = sizes[i], sizes[j], sizes[rest], d[rest, i], d[rest, j], d[i, j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "average":
            new = (ni * a + nj * b) / (ni + nj)
        elif linkage == "mcquitty":
            new = (a + b) / 2
        elif linkage == "median":
            new = (a + b) / 2 - dij / 4
        elif linkage == "centroid":
            new = (ni * a + nj * b) / (ni + nj) - ni * nj * dij / (ni + nj) ** 2
        else:
            new = ((ni + nm) * a + (nj + nm) * b - nm * dij) / (ni + nj + nm)
        alive[i] = True
        d[i, rest] = d[rest, i] = new
        d[j] = d[:, j] = least[j] = np.inf
        look(i)
        lost = (nearest[rest] == i) | (nearest[rest] == j)
        closer = (rest < i) & ((new < least[rest]) | ((new == least[rest]) & (i < nearest[rest]))) & ~lost
        nearest[rest[closer]], least[rest[closer]] = i, new[closer]
        for m in rest[lost].tolist():
            look(m)
        sizes[i] += nj
        yield i, j, float(dij)


def hierarchical(d: np.ndarray, k: int, linkage: str, weights: np.ndarray | None = None) -> np.ndarray:
    """Agglomeration into k clusters.

    Clusters are numbered untouched points first, by index, then merged ones as they came to be. A weight is the number of
    points at distance 0 that a row stands for; they count as merged, in the order of the rows, before anything else.
    """
    n = len(d)
    d = d.astype(float) ** (2 if linkage == "ward.D2" else 1)
    sizes, made = np.ones(n), {}
    if weights is not None:
        sizes = weights.astype(float)
        made = {int(i): i - n for i in np.flatnonzero(weights > 1)}
        if linkage.startswith("ward"):
            d = d * (2 * sizes[:, None] * sizes / (sizes[:, None] + sizes))
    members = {i: [i] for i in range(n)}
    for step, (i, j, _) in enumerate(islice(merging(d, sizes, linkage), max(0, n - k))):
        members[i] += members.pop(j)
        made[i] = step
    order = sorted(members, key=lambda c: (c in made, made.get(c, c)))
    out = np.empty(n, int)
    for number, c in enumerate(order):
        out[members[c]] = number
    return out
