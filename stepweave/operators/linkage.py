"""Hierarchical clusters without a matrix in one place: rounds that merge all pairs of nearest neighbours at once.

A row of the matrix of distances is one record: the distances of a cluster from all clusters, in their order. In a
round, clusters that are each other's nearest merge, all of them; by Lance and Williams' formulas the columns change in
every row by itself, and only rows that merge meet in a shuffle. This gives the merges of one pair after the other where a
merge never brings clusters closer (single, complete, average, mcquitty, ward). Once SMALL clusters are left, one task
merges them.

The driver has a number or two for each point and no distances but those of merges: POINTS of them at most, whose
distances would be 8 TB.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import editing
from .shared import written

#: Clusters that one task takes: 2 million distances. Points whose numbers the driver takes.
SMALL, POINTS = 1024, 1_000_000
#: Linkages by which merges never bring clusters closer.
REDUCIBLE = ("single", "complete", "average", "mcquitty", "ward.D", "ward.D2")
ROW = "c long, d binary, nearest long, least double"


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of each pair, whichever comes first, by which ties are broken: 64 bits mixed, so that no cluster is
    everybody's first choice."""
    lo, hi = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    with np.errstate(over="ignore"):
        # fixed values: multipliers of the SplitMix64 generator
        h = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi + np.uint64(0x632BE59BD9B4E019))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _nearest(d: np.ndarray, own: int, names: np.ndarray) -> tuple[int, float]:
    """The place of the least of the distances of the cluster at place own, its own aside; names order ties."""
    rest = d.copy()
    rest[own] = np.inf
    least = rest.min()
    tied = np.flatnonzero(rest == least)
    if len(tied) > 1:
        mine = np.full(len(tied), names[own])
        tied = tied[np.lexsort((np.maximum(names[tied], mine), np.minimum(names[tied], mine), _order(names[tied], mine)))]
    return int(tied[0]), float(least)


def combined(linkage: str, a: np.ndarray, b: np.ndarray, ni, nj, nm, dij) -> np.ndarray:
    """Distances of the union of i and j from clusters of sizes nm, a and b being those of i and j."""
    if linkage == "single":
        return np.minimum(a, b)
    if linkage == "complete":
        return np.maximum(a, b)
    if linkage == "average":
        return (ni * a + nj * b) / (ni + nj)
    if linkage == "mcquitty":
        return (a + b) / 2
    return ((ni + nm) * a + (nj + nm) * b - nm * dij) / (ni + nj + nm)


class _Round:
    """What a round does: of m clusters, which merge (i with j at distance dij), and the places of those that come out."""

    def __init__(self, nearest: np.ndarray, least: np.ndarray, names: np.ndarray, sizes: np.ndarray, linkage: str):
        m = len(nearest)
        self.linkage, self.names, self.sizes = linkage, names, sizes
        own = np.arange(m)
        i = own[(nearest[nearest] == own) & (own < nearest)]
        self.i, self.j, self.dij = i, nearest[i], least[i]
        self.into = own.copy()
        self.into[self.j] = i
        kept = np.flatnonzero(self.into == own)
        self.kept, self.place = kept, np.searchsorted(kept, self.into)  # a cluster's new place
        self.new_sizes = np.bincount(self.place, sizes, len(kept))
        self.touched = np.bincount(self.place, minlength=len(kept)) > 1

    def columns(self, d: np.ndarray, own: int) -> np.ndarray:
        """A row's distances from the clusters that come out, its own cluster still being what it was."""
        d = d.copy()
        i, j = self.i, self.j
        d[i] = combined(self.linkage, d[i], d[j], self.sizes[i], self.sizes[j], self.sizes[own], self.dij)
        return d[self.kept]

    def rows(self, parts: dict[int, np.ndarray]) -> np.ndarray:
        """The row of the union of two clusters, out of their rows by old place, whose columns have changed already."""
        i, j = sorted(parts)
        return combined(self.linkage, parts[i], parts[j], self.sizes[i], self.sizes[j], self.new_sizes, self.dij[np.searchsorted(self.i, i)])


def _found(c: int, d: np.ndarray, names: np.ndarray) -> tuple:
    near, least = _nearest(d, c, names) if len(d) > 1 else (c, np.inf)
    return c, d.tobytes(), near, least


def _batch(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.float64()))], ["c", "d", "nearest", "least"])


def started(rows: DataFrame, names: np.ndarray, sizes: np.ndarray, linkage: str) -> DataFrame:
    """Rows (idx, d: doubles by idx) as the first round takes them."""
    root = rows.sparkSession.sparkContext.broadcast((names, sizes))

    def run(batches):
        names, sizes = root.value
        for batch in batches:
            out = []
            for c, d in zip(batch.column("idx").to_pylist(), batch.column("d").to_pylist()):
                d = scaled(np.frombuffer(d), linkage, sizes[c], sizes)
                out.append(_found(c, d, names))
            yield from _batch(out).to_batches()

    return written(rows.mapInArrow(run, ROW), "linkage")


def scaled(d: np.ndarray, linkage: str, own: float, sizes: np.ndarray) -> np.ndarray:
    """Distances as a linkage works on them: squared by ward.D2, and those of points that stand for several by ward."""
    d = d.astype(float) ** (2 if linkage == "ward.D2" else 1)
    return d * (2 * own * sizes / (own + sizes)) if linkage.startswith("ward") else d


def _next(rows: DataFrame, step: _Round, names: np.ndarray) -> DataFrame:
    """The rows of the clusters that come out of a round."""
    known = rows.sparkSession.sparkContext.broadcast((step, names))

    def run(batches):
        step, names = known.value
        for batch in batches:
            out = []
            for c, d in zip(batch.column("c").to_pylist(), batch.column("d").to_pylist()):
                new, d = int(step.place[c]), step.columns(np.frombuffer(d), c)
                # a row that merges waits for its likes: least tells its old place
                out.append((new, d.tobytes(), -1, float(c)) if step.touched[new] else _found(new, d, names))
            yield from _batch(out).to_batches()

    def merge(part: pa.Table) -> pa.Table:
        step, names = known.value
        rows = {int(c): np.frombuffer(d) for c, d in zip(part.column("least").to_pylist(), part.column("d").to_pylist())}
        return _batch([_found(part.column("c")[0].as_py(), step.rows(rows), names)])

    changed = written(rows.select("c", "d").mapInArrow(run, ROW), "linkage")
    met = changed.where("nearest < 0").groupBy("c").applyInArrow(merge, ROW)
    return written(changed.where("nearest >= 0").unionByName(met), "linkage")


def merges(rows: DataFrame, sizes: np.ndarray, linkage: str, small: int | None = None) -> list[tuple[int, int, float]]:
    """All merges (absorbed point, remaining point, height) of the points of rows (idx, d), those of a round together."""
    if linkage not in REDUCIBLE:
        raise ValueError(f"by {linkage} merges can bring clusters closer: no rounds")
    if len(sizes) > POINTS:
        raise ValueError(f"more than {POINTS} different sequences: cluster a part of them")
    small = SMALL if small is None else small
    names, sizes, out = np.arange(len(sizes)), sizes.astype(float), []
    now = started(rows, names, sizes, linkage)
    while len(names) > small:
        told = now.select("c", "nearest", "least").toPandas().sort_values("c")
        step = _Round(told.nearest.to_numpy(), told.least.to_numpy(), names, sizes, linkage)
        out += [(int(names[j]), int(names[i]), float(d)) for i, j, d in zip(step.i, step.j, step.dij)]
        names, sizes = names[step.kept], step.new_sizes
        now = _next(now, step, names)

    def finish(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("c").to_numpy())
        d = np.stack([np.frombuffer(x) for x in part.column("d").to_pylist()])[order]
        found = list(editing.merging(d, sizes, linkage))
        return pa.table([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))] + [pa.array(range(len(found)), pa.int64())], ["i", "j", "height", "step"])

    last = now.select(F.lit(0).alias("all"), "c", "d").groupBy("all").applyInArrow(finish, "i long, j long, height double, step long")  # SMALL rows at most
    return out + [(int(names[r.j]), int(names[r.i]), r.height) for r in last.orderBy("step").toLocalIterator()]


def cut(found: list[tuple[int, int, float]], sizes: np.ndarray, k: int) -> np.ndarray:
    """The clusters (from 0) of the points once all but k are merged, lowest merges first.

    Untouched points come first, in their order, then those that stand for several, then clusters as they came to be.
    """
    n = len(sizes)
    order = sorted(range(len(found)), key=lambda m: (found[m][2], m))[: n - k]
    up, made = np.arange(n), {int(i): i - n for i in np.flatnonzero(sizes > 1)}
    for a, b in ((found[m][0], found[m][1]) for m in order):
        up[a] = b
    while (up[up] != up).any():
        up = up[up]
    for step, m in enumerate(order):
        made[int(up[found[m][1]])] = step
    roots = sorted(np.unique(up).tolist(), key=lambda c: (c in made, made.get(c, c)))
    number = np.empty(n, int)
    number[roots] = np.arange(len(roots))
    return number[up]


def clusters(rows: DataFrame, sizes: np.ndarray, k: int, linkage: str, limit: int) -> pd.DataFrame:
    """idx and cluster (from 1) of points given as rows of distances (idx, d)."""
    if len(sizes) <= SMALL or linkage not in REDUCIBLE:
        if len(sizes) > limit:
            raise ValueError(f"more than {limit} different sequences: cluster a part of them")

        def alone(part: pa.Table) -> pa.Table:
            order = np.argsort(part.column("idx").to_numpy())
            d = np.stack([np.frombuffer(x) for x in part.column("d").to_pylist()])[order]
            return pa.table({"idx": np.arange(len(d)), "cluster": editing.hierarchical(d, k, linkage, sizes).astype(np.int64)})

        found = rows.select(F.lit(0).alias("all"), "idx", "d").groupBy("all").applyInArrow(alone, "idx long, cluster long").toPandas()
    else:
        found = pd.DataFrame({"idx": np.arange(len(sizes)), "cluster": cut(merges(rows, sizes, linkage), sizes, k)})
    return found.assign(cluster=found.cluster + 1)
