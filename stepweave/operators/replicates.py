"""Replicates of a resampling without a row for each sequence and replicate.

Sequences are numbered from 0 and lie in blocks of BLOCK numbers, so that every block's size is known from their count
alone. What a replicate does with a block then comes from a counter-based generator, in whatever task the block is:

* a bootstrap's draws are split down a tree of blocks, each node's by a binomial of its own generator, so that each
  replicate takes exactly as many sequences as there are;
* a permutation is a keyed Feistel network over the numbers, and who is among the first k of it is on one side, or stays:
  k is met exactly, and those kept at one share are among those kept at a larger one.

A block's replicates by sequences times its sequences by counts are one matrix product; sums are added up over all blocks
of a task before they leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .shared import numbered

#: Sequences in a block, replicates worked on at once, and sums that a task holds before it hands them on.
BLOCK, AT_ONCE, HELD = 4096, 128, 8_000_000
#: Rounds of a permutation's network. With these, over 8 bits at least, places of numbers and pairs of them are even: chi-squared
#: statistics of 20,000 permutations of 2 to 15 numbers are those of chance, which they are not with 6 rounds over 4 bits.
ROUNDS = 8
#: Different counts of a block up to which its table of sequences by counts is laid out in full.
FULL = 256

#: label, first replicate, and a matrix of replicates by sequences of the block, for every part of a result.
Parts = Iterator[tuple[int, int, np.ndarray]]


def key(seed: int, *of: int) -> int:
    """32 bits of the MD5 of the numbers as text, with blanks between: any engine's."""
    return int(hashlib.md5(" ".join(map(str, (seed, *of))).encode()).hexdigest()[:8], 16)


def mixed(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """32 bits that depend on all bits of x and of the key."""
    # fixed values: the two multipliers of the 32-bit finaliser of MurmurHash3
    h = (x ^ keys) * np.uint32(2246822507)
    h = (h ^ h >> np.uint32(13)) * np.uint32(3266489909)
    return h ^ h >> np.uint32(16)


def permuted(at: np.ndarray, n: int, reps: range, seed: int = 0) -> np.ndarray:
    """Replicates by numbers: where each of the numbers `at` stands in each replicate's permutation of range(n).

    The halves of a number of 2 w bits, 8 at least, go through ROUNDS rounds, and again while they give n or more.
    """
    w = max(4, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint32((1 << w) - 1)
    keys = np.array([[key(seed, rep, t) for t in range(ROUNDS)] for rep in reps], np.uint32).reshape(len(reps), ROUNDS)
    at = at.astype(np.int64)
    left, right = (np.tile(x.astype(np.uint32), len(reps)) for x in (at >> w, at & int(mask)))
    rep, todo, out = np.repeat(np.arange(len(reps)), len(at)), np.arange(len(reps) * len(at)), np.empty(len(reps) * len(at), np.int64)
    while len(todo):
        for t in range(ROUNDS):
            left, right = right, left ^ (mixed(right, keys[rep, t]) & mask)
        y = left.astype(np.int64) << w | right
        out[todo[y < n]] = y[y < n]
        more = y >= n
        todo, left, right, rep = todo[more], left[more], right[more], rep[more]
    return out.reshape(len(reps), len(at))


def multiplicities(first: int, n: int, reps: range, seed: int = 0, stream: int = 0, block: int = BLOCK) -> np.ndarray:
    """Replicates by sequences of the block from `first` on: how often each of n draws with replacement takes each of n.

    From the root of the tree of blocks down to this one, the draws of a node go to its left side by a binomial with the
    share of sequences there. Every block that a node lies above draws the same numbers there.
    """
    low, high = 0, -(-n // block)
    draws = np.full(len(reps), n, np.int64)
    span = lambda a, b: min(b * block, n) - a * block

    def generator(a: int, b: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, stream], counter=[0, reps.start, a, b]))

    while high - low > 1:
        middle = (low + high) // 2
        left = generator(low, high).binomial(draws, span(low, middle) / span(low, high))
        if first < middle * block:
            draws, high = left, middle
        else:
            draws, low = draws - left, middle
    size = span(low, high)
    taken = generator(low, high).integers(0, size, int(draws.sum()))
    return np.bincount(np.repeat(np.arange(len(reps)), draws) * size + taken, minlength=len(reps) * size).reshape(len(reps), size)


def chunks(iterations: int) -> list[range]:
    return [range(first, min(first + AT_ONCE, iterations)) for first in range(0, iterations, AT_ONCE)]


def placed(own: DataFrame, each: DataFrame, keys: tuple[str, ...], within: tuple[str, ...] = (), by: tuple[str, ...] | None = None) -> DataFrame:
    """Counts (keys and more) with the number of their sequence: idx, of total, within its group, which begins at start.

    each: a row of keys for every sequence, those without counts too. by: the columns to number by, if not all the keys:
    sequences that agree in them share a number.
    """
    by = by or keys
    return own.join(numbered(each.select(*by).distinct(), by, within), list(by))


def summed(own: DataFrame, carry: tuple[str, ...], what: tuple[str, ...], parts: Callable[[int, int, int, int], Parts], sided: str | None = None) -> DataFrame:
    """carry, label, rep, what and n: for every label and replicate the sums of n over sequences, times what `parts` gives them.

    own: carry, what, n, idx, total, start; parts(start, total, first, size) is asked for each block of a group, from its
    number `first` on. If the column `sided` is y, a sequence counts 1 less its part.
    """
    fields = own.select(*carry, *what).schema.fields
    schema = StructType([*fields, StructField("label", IntegerType()), StructField("rep", IntegerType()), StructField("n", DoubleType())])
    arrow = to_arrow_schema(schema)
    size, limit = BLOCK, HELD
    part = (F.col("start") + F.floor(F.col("idx") / size) * size).alias("__part")
    rows = own.select(part, "start", "total", "idx", *carry, *what, F.col("n").cast("double").alias("n"), (F.col(sided) == "y" if sided else F.lit(False)).alias("__y"))
    ready = rows.repartition("__part").sortWithinPartitions("__part")

    def run(batches):
        held = _Held(carry, what)
        for block in _blocks(batches):
            start, total, first = int(block["start"].iloc[0]), int(block["total"].iloc[0]), int(block["idx"].iloc[0]) // size * size
            if held.start != start:
                yield from held.out(arrow)
                held.start, held.head = start, [block[c].iloc[0] for c in carry]
            columns, place, n, turned = held.columns(block), (block["idx"] - first).to_numpy(), block["n"].to_numpy(), block["__y"].to_numpy(bool)
            for label, rep, matrix in parts(start, total, first, min(size, total - first)):
                for m, at in ((matrix, ~turned), (1 - matrix if turned.any() else None, turned)):
                    if at.any():
                        held.add(label, rep, _product(m, place[at], columns[at], n[at]), columns[at])
            if held.size() > limit:
                yield from held.out(arrow)
        yield from held.out(arrow)

    return ready.mapInArrow(run, schema).groupBy(*carry, "label", "rep", *what).agg(F.sum("n").alias("n"))


def _blocks(batches) -> Iterator[pd.DataFrame]:
    """Rows of one part after the other, from rows sorted by part."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        at = rows["__part"].to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if waiting and waiting[0]["__part"].iloc[0] != at[a]:
                yield pd.concat(waiting, ignore_index=True)
                waiting = []
            waiting.append(rows.iloc[a:b])
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def _product(matrix: np.ndarray, place: np.ndarray, columns: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Replicates by the different columns, in their order: matrix times the table of sequences by columns."""
    kinds, at = np.unique(columns, return_inverse=True)
    if len(kinds) <= FULL:
        table = np.zeros((matrix.shape[1], len(kinds)))
        np.add.at(table, (place, at), n)
        return matrix.astype(np.float64) @ table
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    return np.add.reduceat(matrix[:, place[order]] * n[order], starts, axis=1)


class _Held:
    """Sums of the blocks of one group so far, by label: replicates by what is counted."""

    def __init__(self, carry: tuple[str, ...], what: tuple[str, ...]):
        self.carry, self.what, self.start, self.head = carry, what, None, []
        self.names: dict[tuple, int] = {}
        self.sums: dict[int, np.ndarray] = {}

    def columns(self, block: pd.DataFrame) -> np.ndarray:
        codes, kinds = self._kinds(block)
        return np.array([self.names.setdefault(k, len(self.names)) for k in kinds], np.int64)[codes]

    def _kinds(self, block: pd.DataFrame):
        if len(self.what) > 1:
            return pd.MultiIndex.from_frame(block[list(self.what)]).factorize()
        codes, kinds = pd.factorize(block[self.what[0]])  # without a tuple a row
        return codes, [(k,) for k in kinds.tolist()]

    def add(self, label: int, rep: int, sums: np.ndarray, columns: np.ndarray) -> None:
        if not sums.size:
            return
        own = self.sums.get(label, np.zeros((0, 0)))
        rows, wide = max(own.shape[0], rep + len(sums)), max(own.shape[1], len(self.names))
        if (rows, wide) != own.shape:
            grown = np.zeros((rows, max(wide, min(2 * own.shape[1], wide + 1024))))
            grown[: own.shape[0], : own.shape[1]] = own
            own = self.sums[label] = grown
        own[rep : rep + len(sums), np.unique(columns)] += sums

    def size(self) -> int:
        return sum(x.size for x in self.sums.values())

    def out(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        names = [pa.array([k[j] for k in self.names], schema.field(c).type) for j, c in enumerate(self.what)]
        for label, sums in self.sums.items():
            rep, at = np.nonzero(sums)
            for a in range(0, len(rep), 100_000):
                r, k = rep[a : a + 100_000], at[a : a + 100_000]
                columns = [pa.array([h] * len(r), schema.field(c).type) for c, h in zip(self.carry, (None if pd.isna(h) else h for h in self.head))]
                columns += [x.take(pa.array(k)) for x in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(r), label, np.int32)), pa.array(r.astype(np.int32)), pa.array(sums[r, k])], schema=schema)
        self.names, self.sums = {}, {}
