"""Runs of words: maximal stretches with a period, by Crochemore's partition refinement of positions by equal factors."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Levels at which all documents of a slice are refined at once, and words in a slice, about. They change no result.
TOGETHER, SLICE = 4, 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _equal_pairs(classes: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """Of positions `at`, ordered by class and place, those whose next class member is `level` places on: squares."""
    same = (classes[at[1:]] == classes[at[:-1]]) & (at[1:] - at[:-1] == level)
    return at[:-1][same]


def _regrouped(first: np.ndarray, then: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions `at` in order of (first, then, place), the number of each one's group, and the groups' sizes and starts."""
    order = np.lexsort((at, then, first))
    a, b, at = first[order], then[order], at[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(at) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(at)])
    return at, np.repeat(np.arange(len(starts)), sizes), sizes, starts


def squares(words: np.ndarray, ends: np.ndarray, times: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """(period, starts in ascending order) of all primitively rooted squares of documents that lie one behind another, with
    periods of up to a `times`-th of their document's words.

    words: a number for each word, equal ones alike; ends: where each document ends. A class holds the positions of a
    document where equal factors of `level` words start. Level by level a class splits by what follows. Two neighbouring
    members as far apart as the level is long are a square, and members in between would give its root a shorter period.
    At the first TOGETHER levels the positions of all documents that aren't alone in their class are regrouped at once.
    Then each document that has any left is refined by itself, with the smaller half of what every class split into.
    """
    n = len(words)
    document = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    at, group, sizes, _ = _regrouped(document, words, np.arange(n))
    classes = np.empty(n + 1, np.int64)
    for level in range(1, TOGETHER + 1):
        classes[:] = -1 - np.arange(n + 1)  # alone
        many = sizes[group] > 1
        at = at[many]
        classes[at] = group[many]
        yield level, np.sort(_equal_pairs(classes, at, level))
        if not len(at):
            return
        inside = at + level < ends[document[at]]
        follows = np.where(inside, classes[np.minimum(at + 1, n)], -1 - at - 1)
        parents = classes[at]
        at, group, sizes, starts = _regrouped(parents, follows, at)
    if not len(at):
        return
    # every part but the largest of what a class split into is a splitter of the next level
    of = classes[at[starts]]
    by = np.lexsort((-sizes, of))
    largest = np.zeros(len(starts), bool)
    largest[by[np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]])]] = True
    bounds, docs, found = np.r_[starts, len(at)], document[at[starts]], defaultdict(list)
    for s, e in pairwise(np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True]).tolist()):
        k = int(docs[s])
        last = int(ends[k] - (ends[k - 1] if k else 0)) // times
        if last > TOGETHER and (sizes[s:e] > 1).any():
            parts = [at[bounds[j] : bounds[j + 1]].tolist() for j in range(s, e)]
            _refined(parts, largest[s:e].tolist(), TOGETHER + 1, last, found)
    for period, starts in sorted(found.items()):
        yield period, np.sort(np.array(starts))


def _refined(parts: list[list[int]], largest: list[bool], level: int, last: int, found: dict[int, list[int]]) -> None:
    """The squares of one document of periods from `level` to `last`, given its classes at that level, each in order of place.

    before and after link the members of a class, gaps holds places by their distance from the next member. A class is
    split by the small parts of the level before alone: what goes before the largest one stays together. So a position
    moves only when the class of its follower has halved, n log n moves in all.
    """
    own, size, head, before, after, gaps = {}, [], [], {}, {}, defaultdict(set)
    for number, part in enumerate(parts):
        size.append(len(part))
        head.append(part[0])
        own |= dict.fromkeys(part, number)
        before[part[0]] = after[part[-1]] = None
        for a, b in pairwise(part):
            after[a], before[b] = b, a
            gaps[b - a].add(a)
    small = [p for p, big in zip(parts, largest) if not big]
    while True:
        if gaps.get(level):
            found[level].extend(gaps[level])
        if level == last or not small:
            return
        split: dict[int, list[list[int]]] = defaultdict(list)
        for part in small:
            moved = defaultdict(list)
            for j in part:
                c = own.get(j - 1)
                if c is not None and size[c] > 1:
                    moved[c].append(j - 1)
            for c, out in moved.items():
                split[c].append(out)
        small = []
        for c, outs in split.items():
            if sum(map(len, outs)) == size[c]:
                outs.pop()  # one part keeps the class's number
            for out in outs:
                number, behind = len(size), None
                size.append(len(out))
                head.append(out[0])
                size[c] -= len(out)
                for i in out:
                    b, a = before[i], after[i]
                    if a is not None:
                        gaps[a - i].discard(i)
                        before[a] = b
                    if b is None:
                        head[c] = a
                    else:
                        gaps[i - b].discard(b)
                        after[b] = a
                        if a is not None:
                            gaps[a - b].add(b)
                    own[i], before[i], after[i] = number, behind, None
                    if behind is not None:
                        after[behind] = i
                        gaps[i - behind].add(behind)
                    behind = i
            if not outs:
                continue
            most = max(outs, key=len)
            if len(most) > size[c]:
                rest, i = [], head[c]
                while i is not None:
                    rest.append(i)
                    i = after[i]
                small += [out for out in outs if out is not most] + [rest]
            else:
                small += outs
        level += 1


def runs_of(words: np.ndarray, ends: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows of start, length, period of the runs of documents that lie one behind another, by start, then period.

    Squares of one period that start side by side make one run; runs are kept from max(least, times * period) words on.
    times must be 2 at least.
    """
    out = [np.zeros((0, 3), np.int64)]
    for q, at in squares(words, ends, times):
        if len(at):
            cut = np.flatnonzero(np.diff(at) != 1)
            start, stop = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
            length = stop - start + 2 * q
            good = length >= max(least, times * q)
            out.append(np.stack([start[good], length[good], np.full(good.sum(), q)], 1))
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(docs: DataFrame, least: int = 24, times: int = 3, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, runs (array of start, length, period, by start, then period) and collapsed (the text without repeats), one row a row.

    Words are what stands between blanks, tabs and line ends; a run is a longest stretch of them with a smallest period,
    of at least `least` words and `times` periods. Words of a run behind its first period are repeats, and what is left is
    joined by one blank. `edit` may put other words in place of a document's before they are looked at, given its id.
    A null text is an empty one: no runs and an empty text. Null and repeated ids, and repeated rows, keep a row each.
    Whole texts are read, whatever their length: documents are refined in slices of about SLICE words, a longer one alone.
    Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def slices(batch: pa.RecordBatch):
        ids, texts, held, count = [], [], [], 0
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary())):
            words = (t.as_py() or b"").split()
            if edit:
                words = edit(i, words)
            ids.append(i)
            held.append(words)
            count += len(words)
            if count >= SLICE:
                yield ids, held
                ids, held, count = [], [], 0
        if ids:
            yield ids, held

    def run(batches):
        for batch in batches:
            for ids, held in slices(batch):
                number: dict = defaultdict()
                number.default_factory = number.__len__
                ends = np.cumsum([len(w) for w in held])
                coded = np.fromiter((number[w] for words in held for w in words), np.int64, int(ends[-1]))
                found = runs_of(coded, ends, least, times)
                of = np.searchsorted(ends, found[:, 0], side="right")
                bounds = np.searchsorted(of, np.arange(len(ids) + 1))
                runs, texts = [], []
                for k, words in enumerate(held):
                    own = found[bounds[k] : bounds[k + 1]].copy()
                    if len(own):
                        own[:, 0] -= ends[k] - len(words)
                        keep = np.ones(len(words), bool)
                        for s, length, q in own.tolist():
                            keep[s + q : s + length] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    runs.append([{"start": s, "length": length, "period": q} for s, length, q in own.tolist()])
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    out = rows.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by the crc32 of its id, with a period from some place on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_crochemore_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, those of every tenth given a period first, as counts, the one repeated most, and digests."""
    found = collapsed(table(spark, sf_dir, "documents"), edit=planted)
    # by cross products, so exactly; ties stay in order of start, then period
    before = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1).otherwise(0)
    best = F.array_sort("runs", before)[0]
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
