"""SimHash near-dedup: pivot distance tables over 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, table, written
from .components import connected_components

BITS = 64
#: With at most 3 differing bits, 3 of 6 blocks at least are untouched.
MAX_DIFFERENCE = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
REFERENCES = 16
#: Keys of rows to drop that are broadcast, at most (16 bytes each); more of them are joined by a shuffle.
GONE = 1_000_000
#: A bucket with more fingerprints than this is compared in tiles of this side, each a task's group of its own.
TILE = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a whole text, as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[k:] for k in range(width)))]
    digest = xxhash.xxh64_intdigest
    if len(shingles) < 1 << 16:
        ones = _ones([digest(x, 42) for x in shingles])
    else:  # very long texts: in pieces
        ones = sum(_ones([digest(x, 42) for x in shingles[k : k + (1 << 16)]]) for k in range(0, len(shingles), 1 << 16))
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes set each bit."""
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                fp = np.array([fingerprint(x.as_py(), width) for x in part.column("__text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], [*part.schema.names[:-1], "fp"])

    rows = docs.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(run, rows.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema)


class PivotTable:
    """Hamming distances of fingerprints to reference fingerprints, kept by block of bits; their sums over the blocks are the whole distances."""

    def __init__(self, seed: int = 6, references: int = REFERENCES):
        rng = np.random.default_rng(seed)
        self.pivots = rng.integers(0, 1 << 64, references, np.uint64)
        ends = np.cumsum((0, *BLOCKS))
        self.masks = [np.uint64(((1 << int(e)) - (1 << int(b))) & ((1 << 64) - 1)) for b, e in zip(ends, ends[1:])]
        self.mix = rng.integers(0, 1 << 64, references, np.uint64) | np.uint64(1)
        self.choices = list(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_DIFFERENCE))
        self.salts = rng.integers(0, 1 << 64, (len(self.choices), len(BLOCKS)), np.uint64) | np.uint64(1)

    def distances(self, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ self.pivots)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """For each choice of 3 blocks, a hash of the distances within them: equal wherever the three blocks are."""
        own = np.stack([(np.bitwise_count((fps[:, None] ^ self.pivots) & m).astype(np.uint64) * self.mix).sum(1, dtype=np.uint64) for m in self.masks], 1)
        own ^= own >> np.uint64(29)
        out = np.empty((len(fps), len(self.choices)), np.uint64)
        for k, choice in enumerate(self.choices):
            out[:, k] = np.uint64(k) + sum((own[:, b] * self.salts[k, b] for b in choice), np.zeros(len(fps), np.uint64))
        out ^= out >> np.uint64(31)
        return out

    def near(self, fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) of rows differ in at most 3 bits: pairs fall by the table's coordinates first."""
        at = np.arange(len(i))
        for k in range(0, table.shape[1], 4):
            if not len(at):
                break
            gap = np.abs(table[i[at], k : k + 4].astype(np.int8) - table[j[at], k : k + 4].astype(np.int8)).max(1)
            at = at[gap <= MAX_DIFFERENCE]
        out = np.zeros(len(i), bool)
        out[at] = np.bitwise_count(fps[i[at]] ^ fps[j[at]]) <= MAX_DIFFERENCE
        return out


class Forest:
    """Union-find over the rows of one batch, to emit a spanning forest of links instead of all of them."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        return up


def links(distinct: DataFrame, seed: int = 6, tile: int = TILE) -> DataFrame:
    """(a, b): fingerprints at 3 or fewer differing bits that connect all that such links connect; fewer than the links themselves.

    distinct: a column fp without repeats. Every fingerprint gets its row of the pivot distance table and goes to a
    bucket for each choice of 3 of 6 blocks, named by its distances within them, so no link is lost. A bucket of more
    than `tile` fingerprints is dealt to one group for each pair of its tiles.
    """
    pivots = PivotTable(seed)

    def keyed(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 1 << 14):
                part = fps[k : k + (1 << 14)].view(np.uint64)
                keys = pivots.keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], ["bucket", "fp"])

    rows = written(distinct.select("fp").mapInArrow(keyed, "bucket long, fp long"), "buckets")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    rows = rows.join(sizes.select("bucket", "tiles"), "bucket")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("right"), "fp")
    group = F.xxhash64("bucket", "x", "y")
    rows = rows.withColumn("g", group).repartition("g").sortWithinPartitions("g", "bucket", "x", "y")

    def compared(batches):
        for fps, run, across, right in _runs(batches):
            yield from _links_within(pivots, fps, run, across, right)

    return rows.select("bucket", "x", "y", "right", "fp").mapInArrow(compared, "a long, b long").distinct()


def _runs(batches):
    """Batches of whole groups: fingerprints, the number of each one's group, whether its two tiles differ, and its side."""
    held: list[pa.RecordBatch] = []

    def cut(parts):
        whole = pa.Table.from_batches(parts)
        key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("bucket", "x", "y")], 1)
        starts = np.r_[True, (key[1:] != key[:-1]).any(1)]
        return whole, key, starts

    def out(whole, key, starts):
        return whole.column("fp").to_numpy().view(np.uint64), np.cumsum(starts), key[:, 1] != key[:, 2], np.asarray(whole.column("right").to_numpy(zero_copy_only=False), bool)

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < 1 << 15:
            continue
        whole, key, starts = cut(held)
        last = int(np.flatnonzero(starts)[-1])
        if last:
            yield out(whole.slice(0, last), key[:last], starts[:last])
        held = whole.slice(last).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield out(*cut(held))


def _links_within(pivots: PivotTable, fps, run, across, right):
    """A spanning forest of the links within each group; groups of two tiles are compared across them only."""
    table = pivots.distances(fps)
    forest = Forest(len(fps))
    ends, step, at = [], 1, np.arange(len(fps) - 1)
    while len(at):
        at = at[at + step < len(fps)]
        at = at[run[at] == run[at + step]]
        j = at + step
        want = ~across[at] | (right[at] != right[j])
        i, j = at[want], j[want]
        ok = pivots.near(fps, table, i, j)
        if ok.sum() > 64:  # most links of a dense group join nothing new
            roots = forest.roots()
            ok &= roots[i] != roots[j]
        for x, y in zip(i[ok].tolist(), j[ok].tolist()):
            if forest.join(x, y):
                ends.append((x, y))
        step += 1
    if ends:
        pairs = np.array(ends)
        yield pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"])


def _labelled(classes: DataFrame, seed: int, tile: int) -> DataFrame:
    """classes, one row a fingerprint, and the component of each."""
    found = connected_components(links(classes, seed, tile))
    return classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, width: int = 3, seed: int = 6, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links of at most 3 bits) of every row.

    A null or empty text, or one without words, has fingerprint zero and links like any other. Equal fingerprints are
    one class, so copies are never expanded into pairs. A row with a null doc_id is grouped and gets its group's id,
    which ignores nulls. Repeated rows are returned as often as they come. Other columns are not read.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labelled = _labelled(classes, seed, tile)
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = labelled.select("fp", "component").join(least, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, width: int = 3, seed: int = 6) -> DataFrame:
    """One row of docs of each group, all its columns, whatever their names: that of the smallest doc_id, nulls last, and of
    the rows of that id one. Null, empty and wordless texts are one group. An empty table gives an empty result.

    Rows are told apart by a key of their own, written once with them, as ids may be repeated or null.
    """
    key = fresh(docs.columns, "row_key")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    fps = written(fingerprints(rows.select("doc_id", F.col(key).alias("row_key"), "text"), width, keep=("doc_id", "row_key")), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key")).alias("first"))
    kept = _labelled(classes, seed, TILE).groupBy("component").agg(F.min("first").alias("first"))
    gone = fps.select(F.col("row_key").alias(key)).join(kept.select(F.col("first.row_key").alias(key)), key, "left_anti")
    gone = written(gone, "gone")
    if gone.count() <= GONE:  # keys alone are shuffled, texts stay where they are read
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*map(column, docs.columns))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all documents: nulls, empty texts and repeats as simhash_groups() says."""
    return simhash_groups(table(spark, sf_dir, "documents"))
