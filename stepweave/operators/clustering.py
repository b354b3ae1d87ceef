"""Distances between sequences, and clusters by them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import editing
from . import linkage
from .sequences import Sequences
from .shared import numbered, written

#: Sequences in a block of the distance matrix; different sequences whose matrix one task takes for the linkages that have
#: no rounds: 25 million distances, 0.2 GB.
BLOCK, DRIVER_ROWS = 512, 5_000
#: Different sequences whose distances from each other go beside every sequence: a million distances, 8 MB. Blocks that
#: sequences are dealt into at least, where there are that many times BLOCK of them, and sequences in a block or the strips
#: that it meets in a task.
KINDS, DEALT, MEMBERS = 1_024, 32, 8_192
#: Sequences in a strip, half as many as Parquet packs without a break (63 times 8), and sequences of a kind that meet it in a row.
STRIP, ROUND = 252, 8
#: Tasks that write pairs.
TASKS = 4_096
#: Metrics by which equal sequences are at distance 0: by lv and osa they are not.
COLLAPSING = ("hamming", "lcs")


def arrays(seqs: Sequences, na_syms: tuple[str, ...] = ("*", "%")) -> DataFrame:
    """id and states: one array of all raw places a sequence, `*` for missing states and the symbols that stand for them."""
    (id,) = seqs.ids
    state = F.when(F.col("state").isNull() | F.col("state").isin(*na_syms), editing.MISSING).otherwise(F.col("state"))
    # by place, with as many missing states before each as there are places without a row
    rows = seqs.frame.groupBy(F.col(id).alias("id")).agg(F.array_sort(F.collect_list(F.struct("raw_pos", state.alias("s")))).alias("places"))
    gap = lambda x, k: F.when(k == 0, x["raw_pos"]).otherwise(x["raw_pos"] - F.element_at("places", k)["raw_pos"] - 1)
    filled = F.transform("places", lambda x, k: F.concat(F.array_repeat(F.lit(editing.MISSING), gap(x, k).cast("int")), F.array(x["s"])))
    return rows.select("id", F.flatten(filled).alias("states"))


def _codes(column) -> np.ndarray:
    """Sequences as rows of numbers, padded by that of missing states."""
    lists = column.to_pylist()
    number = {editing.MISSING: 0}
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int32)
    for i, row in enumerate(lists):
        out[i, : len(row)] = [number.setdefault(s, len(number)) for s in row]
    return out


def _matrix(left: pa.ChunkedArray, right: pa.ChunkedArray, metric: str, weighted: bool, lambda_: float) -> np.ndarray:
    """Distances of the sequences of one list from those of another."""
    if metric == "hamming":
        codes = _codes(pa.chunked_array([*left.chunks, *right.chunks], left.type))
        weights = np.exp(-lambda_ * np.arange(codes.shape[1])) if weighted else np.ones(codes.shape[1])
        x, y = codes[: len(left)], codes[len(left) :]
        d = np.zeros((len(x), len(y)))
        for k, w in enumerate(weights):
            d += w * (x[:, k, None] != y[None, :, k])
        return d
    sides = []  # equal sequences have equal distances
    for side in (left, right):
        number: dict = {}
        at = np.array([number.setdefault(tuple(s), len(number)) for s in side.to_pylist()], np.int64)
        sides.append((list(number), at))
    (kinds, row), (others, column) = sides
    return editing.edit_distances(metric, kinds, others)[row][:, column]


def _block(metric: str, weighted: bool, lambda_: float):
    def run(part: pa.Table) -> pa.Table:
        """All pairs of one pair of blocks."""
        part = part.take(pa.array(np.lexsort((part.column("id").to_numpy(),))))
        same = part.column("x")[0].as_py() == part.column("y")[0].as_py()
        left, right = (part, part) if same else (part.filter(pc.equal(part.column("side"), k)) for k in (0, 1))
        d = _matrix(left.column("states"), right.column("states"), metric, weighted, lambda_)
        i, j = np.nonzero(np.triu(np.ones(d.shape, bool), 1) if same else np.ones(d.shape, bool))
        a, b = left.column("id").to_numpy()[i], right.column("id").to_numpy()[j]
        return pa.table({"i": np.minimum(a, b), "j": np.maximum(a, b), "d": d[i, j]})

    return run


def _in_blocks(rows: DataFrame, own, blocks: int) -> DataFrame:
    """Rows beside x, y and side: each in every pair of blocks that its own block, an expression, is part of."""
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), *[c for c in rows.columns if c not in ("own", "other")])


def _distance_rows(points: DataFrame, count: int, metric: str, weighted: bool, lambda_: float) -> DataFrame:
    """idx and d of points (idx from 0, states): one row a point, its distances from all of them as doubles in order of idx."""
    blocks = max(1, math.ceil(count / BLOCK))

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(part.column("idx").to_numpy())))
        x, y = part.column("x")[0].as_py(), part.column("y")[0].as_py()
        left, right = (part, part) if x == y else (part.filter(pc.equal(part.column("side"), k)) for k in (0, 1))
        d = _matrix(left.column("states"), right.column("states"), metric, weighted, lambda_)
        sides = [(left, y, d)] if x == y else [(left, y, d), (right, x, d.T)]
        return pa.table({
            "idx": np.concatenate([p.column("idx").to_numpy() for p, _, _ in sides]), "part": pa.array([k for p, k, _ in sides for _ in range(p.num_rows)], pa.int32()),
            "d": pa.array([np.ascontiguousarray(row).tobytes() for _, _, m in sides for row in m], pa.binary()),
        })

    def joined(batches):
        for batch in batches:
            rows = [b"".join(p["d"] for p in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(rows, pa.binary())], ["idx", "d"])

    pieces = _in_blocks(points.select("idx", "states"), F.floor(F.col("idx") / BLOCK), blocks).groupBy("x", "y").applyInArrow(run, "idx long, part int, d binary")
    return pieces.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("part", "d"))).alias("parts")).mapInArrow(joined, "idx long, d binary")


def distances(seqs: Sequences, metric: str = "hamming", weighted: bool = False, lambda_: float = 1.0, na_syms: tuple[str, ...] = ("*", "%"), blocks: int | None = None, digits: int | None = None) -> DataFrame:
    """i, j and d for all i < j, which is the result: it grows as the square of the sequences. d is rounded to `digits`, if given.

    Equal sequences are compared once: of KINDS different ones at most, the table of distances goes beside every sequence and
    joins of blocks with strips make the pairs, in an order that files hold in little; of more, each pair of blocks of about
    BLOCK sequences is a group that computes its own. Either way sequences are dealt into `blocks`, or a number that follows
    from theirs, and no task holds more than two blocks at once. Ids must be numbers; a null one is in no pair.
    """
    if metric not in editing.METRICS:
        raise ValueError(f"unknown metric {metric!r}; known are {', '.join(editing.METRICS)}")
    rows = written(_trimmed(seqs, na_syms).where("id is not null"), "rows")
    return _all_pairs(rows, written(classes(rows), "kinds"), metric, weighted, lambda_, blocks, digits)


def _all_pairs(rows: DataFrame, kinds: DataFrame, metric: str, weighted: bool, lambda_: float, blocks: int | None, digits: int | None = None) -> DataFrame:
    """distances() of rows with id and states, trimmed, and their classes()."""
    count, n = kinds.count(), rows.count()
    if count > KINDS:
        found = _pairs(rows, metric, weighted, lambda_, blocks)
        return found if digits is None else found.withColumn("d", F.round("d", digits))
    if blocks is None:
        blocks = max(1, math.ceil(n / MEMBERS), min(DEALT, math.ceil(n / BLOCK)))
    points = kinds.select("states", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).cast("long").alias("idx"))  # KINDS at most
    points = written(points, "points")
    table = _table(points, count, metric, weighted, lambda_, digits).select(F.col("idx").cast("int").alias("kind"), "ds")
    return _expanded(rows.join(F.broadcast(points), "states").select("id", F.col("idx").cast("int").alias("kind")), n, table, blocks)


def _table(points: DataFrame, count: int, metric: str, weighted: bool, lambda_: float, digits: int | None) -> DataFrame:
    """idx and ds of points (idx from 0, states): distances from all of them, its own copies among them, in order of idx."""

    def opened(batches):
        for batch in batches:
            rows = [np.frombuffer(x) for x in batch.column("d").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(rows, pa.list_(pa.float64()))], ["idx", "ds"])

    table = _distance_rows(points, count, metric, weighted, lambda_).mapInArrow(opened, "idx long, ds array<double>")
    return written(table if digits is None else table.withColumn("ds", F.transform("ds", lambda d: F.round(d, digits))), "kind_distances")


def _expanded(members: DataFrame, n: int, table: DataFrame, blocks: int) -> DataFrame:
    """i, j and d for all i < j of n members (id, kind), from the table of distances by kind.

    Members are dealt into blocks by hash, where those of a kind are taken up to ROUND together, and into strips of STRIP by
    order of id. A strip meets all rounds of a block whose members come before its own. So i stays the same for a strip, j
    repeats it for each member of the block and d goes by kinds: in this order a file takes a fraction of a byte a pair.
    Tasks are asked for by number, or few would be made of rows this few that are squared afterwards.
    """
    placed = numbered(members, ("id",)).select("id", "kind", F.floor(F.col("idx") / STRIP).cast("int").alias("strip"))
    each = MEMBERS // STRIP  # strips of a task
    groups = max(1, math.ceil(n / STRIP / each))
    tasks = min(4 * blocks * groups, TASKS)
    rounds = placed.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("own"), "kind").agg(F.array_sort(F.collect_list(F.struct("id", "strip"))).alias("all"))
    rounds = rounds.select("own", "kind", "all", F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(ROUND))).alias("first"))
    rounds = rounds.select("own", "kind", F.slice("all", F.col("first"), F.lit(ROUND)).alias("round"))
    rounds = rounds.withColumn("group", F.explode(F.sequence(F.floor(F.col("round")[0]["strip"] / each).cast("int"), F.lit(groups - 1))))
    strips = placed.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("kind", "id"))).alias("all"))
    strips = strips.select(F.col("strip").alias("at"), F.col("all.id").alias("ids"), F.col("all.kind").alias("kinds"), F.floor(F.col("strip") / each).cast("int").alias("group"))
    strips = strips.withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = strips.repartition(tasks, "own", "group").join(rounds.repartition(tasks, "own", "group").hint("shuffle_hash"), ["own", "group"])
    met = met.where(F.col("round")[0]["strip"] <= F.col("at")).join(F.broadcast(table), "kind")
    # a lambda isn't compiled into one loop with what follows, which would hold all of a strip's pairs: a round's are held
    met = met.select("round", "at", "ids", F.transform("kinds", lambda k: F.get("ds", k)).alias("d"))
    met = met.select("at", "ids", "d", F.inline("round")).where("strip <= at")
    met = met.select(F.col("id").alias("i"), "strip", "at", "d", F.posexplode("ids").alias("place", "j")).where("strip < at or i < j")
    return met.select("i", "j", F.get("d", F.col("place")).alias("d"))


def _pairs(rows: DataFrame, metric: str, weighted: bool, lambda_: float, blocks: int | None = None) -> DataFrame:
    """distances() of rows with id and states, each pair of blocks a group that computes its own place by place."""
    if blocks is None:
        blocks = max(1, math.ceil(rows.count() / BLOCK))
    dealt = _in_blocks(rows.select("id", "states"), F.pmod(F.xxhash64("id"), F.lit(blocks)), blocks)
    return dealt.groupBy("x", "y").applyInArrow(_block(metric, weighted, lambda_), "i long, j long, d double")


def classes(rows: DataFrame) -> DataFrame:
    """Rows with id and states, equal ones as one: id and last (its smallest and largest id), states and n (its rows)."""
    return rows.groupBy("states").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count("*").alias("n"))


def _trimmed(seqs: Sequences, na_syms: tuple[str, ...]) -> DataFrame:
    """arrays() up to the last state that isn't missing, which no distance looks behind."""
    there = F.transform("states", lambda s, k: F.when(s != editing.MISSING, k + 1).otherwise(0))
    return arrays(seqs, na_syms).select(F.col("id").cast("long").alias("id"), F.slice("states", F.lit(1), F.array_max(there)).alias("states"))


def sequence_silhouette(seqs: Sequences, member: DataFrame, metric: str = "hamming", weighted: bool = False, lambda_: float = 1.0, na_syms: tuple[str, ...] = ("*", "%")) -> DataFrame:
    """silhouette() of a membership (id, cluster) from distances of different sequences, times how often they come.

    Equal sequences must be at distance 0, which lv and osa do not give them: these are not collapsed.
    """
    rows = _trimmed(seqs, na_syms)
    if metric == "hamming":
        return _hamming_silhouette(written(classes(rows)), rows, member, weighted, lambda_)
    kinds = classes(rows) if metric in COLLAPSING else rows.withColumns({"last": F.col("id"), "n": F.lit(1).cast("long")})
    dist = _pairs(kinds, metric, weighted, lambda_)
    if metric not in COLLAPSING:
        return silhouette(dist, member)
    return _silhouette_of_classes(dist, _class_of(rows, kinds), member)


def hamming_sums(kinds: DataFrame, counts: DataFrame, weighted: bool = False, lambda_: float = 1.0) -> DataFrame:
    """i, cluster and sum: the Hamming distances of each of the kinds (id, states) from all sequences of each cluster, summed.

    counts: class (the id of a kind), cluster and n. A sequence is at no distance from those that have its state at a
    place, so its sum is the clusters' size times all places less what a histogram of states by cluster and place holds
    of it: no pair is made. Behind its end a sequence has missing states, which those as short or missing there share.
    """
    weight = F.exp(F.lit(-lambda_) * F.col("p")) if weighted else F.lit(1.0)
    width = kinds.agg(F.coalesce(F.max(F.size("states")), F.lit(0)).alias("width"))
    ps = F.posexplode("states").alias("p", "s")
    sized = counts.groupBy("cluster").agg(F.sum("n").alias("size"))
    held = kinds.select(F.col("id").alias("class"), ps).join(counts, "class").groupBy("cluster", "p", "s").agg(F.sum("n").alias("c"))
    # one row a cluster and place: what is there in all, what is missing or ended, and the latter from there on
    grid = sized.crossJoin(F.broadcast(width)).select("cluster", "size", F.explode(F.sequence(F.lit(0), F.col("width"))).alias("p"))
    there = held.groupBy("cluster", "p").agg(F.sum(F.when(F.col("s") != editing.MISSING, F.col("c")).otherwise(0)).alias("there"))
    gone = grid.join(there, ["cluster", "p"], "left").withColumn("missing", F.col("size") - F.coalesce("there", F.lit(0)))
    onward = Window.partitionBy("cluster").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.when(F.col("p") < F.col("width"), weight).otherwise(F.lit(0.0))
    gone = gone.crossJoin(F.broadcast(width)).select("cluster", "p", "size", F.col("missing").cast("double").alias("missing"), F.sum(F.col("missing") * inside).over(onward).alias("tail"), F.sum(inside).over(onward).alias("places"))
    own = kinds.select(F.col("id").alias("i"), ps)
    missing = gone.select("cluster", "p", F.lit(editing.MISSING).alias("s"), F.col("missing").alias("c"))
    same = held.where(F.col("s") != editing.MISSING).select("cluster", "p", "s", F.col("c").cast("double").alias("c")).unionByName(missing)
    shared = own.join(same, ["p", "s"]).groupBy("i", "cluster").agg(F.sum(weight * F.col("c")).alias("shared"))
    ends = kinds.select(F.col("id").alias("i"), F.size("states").alias("p")).join(gone.select("cluster", "p", "tail"), "p")
    whole = gone.where("p = 0").select("cluster", "size", "places")
    met = ends.join(F.broadcast(whole), "cluster").join(shared, ["i", "cluster"], "left")
    return met.select("i", "cluster", (F.col("size") * F.col("places") - F.coalesce("shared", F.lit(0.0)) - F.col("tail")).alias("sum"), "size")


def _hamming_silhouette(kinds: DataFrame, rows: DataFrame, member: DataFrame, weighted: bool, lambda_: float) -> DataFrame:
    counts = written(_class_of(rows, kinds).join(member, "id").groupBy("class", "cluster").agg(F.count("*").alias("n")))
    return _silhouette_of_sums(hamming_sums(kinds, counts, weighted, lambda_), counts)


def _class_of(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """id and the class of each row."""
    return rows.join(kinds.select(F.col("id").alias("class"), "states"), "states").select("id", "class")


def _silhouette_of_classes(dist: DataFrame, class_of: DataFrame, member: DataFrame) -> DataFrame:
    counts = class_of.join(member, "id").groupBy("class", "cluster").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("cluster").agg(F.sum("n").alias("size"))
    both = dist.select("i", "j", "d").unionByName(dist.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    both = both.unionByName(counts.select(F.col("class").alias("i"), F.col("class").alias("j"), F.lit(0.0).alias("d")).distinct())
    sums = both.join(counts.withColumnRenamed("class", "j"), "j").groupBy("i", "cluster").agg(F.sum(F.col("n") * F.col("d")).alias("sum")).join(F.broadcast(sizes), "cluster")
    return _silhouette_of_sums(sums, counts)


def _silhouette_of_sums(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """One row, the mean silhouette of classes with n sequences in a cluster (counts), from sums of distances (i, cluster, sum, size)."""
    own = counts.select(F.col("class").alias("i"), F.col("cluster").alias("own"), "n")
    inner = F.col("cluster") == F.col("own")
    sides = own.join(sums, "i").groupBy("i", "own", "n").agg(
        F.max(F.when(inner, F.col("size"))).alias("size"), F.max(F.when(inner & (F.col("size") > 1), F.col("sum") / (F.col("size") - 1))).alias("a"), F.min(F.when(~inner, F.col("sum") / F.col("size"))).alias("b")
    )
    top = F.greatest("a", "b")
    s = F.when((F.col("size") == 1) | F.col("b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return sides.agg((F.sum(s * F.col("n")) / F.sum("n")).alias("silhouette"))


def silhouette(dist: DataFrame, member: DataFrame) -> DataFrame:
    """One row, the mean silhouette of a membership (id, cluster)."""
    both = dist.select("i", "j", "d").unionByName(dist.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    sizes = member.groupBy("cluster").agg(F.count("*").alias("size"))
    own = member.join(sizes, "cluster").select(F.col("id").alias("i"), F.col("cluster").alias("own"), "size")
    means = both.join(member.select(F.col("id").alias("j"), "cluster"), "j").groupBy("i", "cluster").agg(F.avg("d").alias("mean"))
    sides = own.join(means, "i", "left").groupBy("i", "own", "size").agg(F.max(F.when(F.col("cluster") == F.col("own"), F.col("mean"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("own"), F.col("mean"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when((F.col("size") == 1) | F.col("b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return sides.agg(F.avg(s).alias("silhouette"))


@dataclass(frozen=True)
class Clusters:
    assignments: DataFrame
    distances: DataFrame
    k: int
    method: str
    silhouette: float
    sizes: list[int]


def _pam(dist: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """id of each of the kinds (id, last, n) and its cluster: editing.pam with its choices among ties, every cost a sum by Spark.

    The driver gets one candidate a slot. A medoid of BUILD takes one pass over the written distances, and so does every
    swap that is made, with one more at the end: slots that gain nothing share the pass of those before.
    """
    turned = dist.select("i", "j", "d").unionByName(dist.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    turned = turned.unionByName(kinds.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d")))
    both = written(turned.join(kinds.select(F.col("id").alias("j"), "n"), "j").join(kinds.select(F.col("id").alias("i"), "last"), "i"))

    def to_nearest(medoids):
        return both.join(both.where(F.col("i").isin(medoids)).groupBy("j").agg(F.min("d").alias("near")), "j")

    def chosen(costs, to_beat=None):
        """Of the least cost: in BUILD the last, in SWAP the first; and the cost of the present medoid."""
        tie = -F.col("last") if to_beat is None else F.col("i")
        return costs.agg(F.min(F.struct("cost", tie.alias("tie"), "i")).alias("best"), F.max(F.when(F.col("i") == F.lit(to_beat), F.col("cost"))).alias("now")).first()

    medoids = [chosen(both.groupBy("i", "last").agg(F.sum(F.col("n") * F.col("d")).alias("cost"))).best.i]
    while len(medoids) < k:
        gains = to_nearest(medoids).groupBy("i", "last").agg(-F.sum(F.col("n") * F.greatest(F.col("near") - F.col("d"), F.lit(0.0))).alias("gain"))
        gains = gains.toDF("i", "last", "cost").where(~F.col("i").isin(medoids))
        best = chosen(gains).best
        if best is None:  # fewer different sequences than clusters: the others stay empty
            break
        medoids.append(best.i)
    slot, sweeps, quiet = 0, 0, 0
    found = _swaps(both, medoids) if len(medoids) == k else {}
    while found and sweeps < 100 and quiet < k:  # until no slot gains
        best, now, i = found[slot]
        if best < now:
            medoids[slot], quiet = i, 0
            found = _swaps(both, medoids)
        else:
            quiet += 1
        slot, sweeps = (slot + 1) % k, sweeps + (slot + 1 == k)
    number = F.create_map(*[F.lit(x).cast(t) for slot, m in enumerate(medoids) for x, t in ((m, "long"), (slot + 1, "int"))])
    return both.where(F.col("i").isin(medoids)).groupBy(F.col("j").alias("id")).agg(F.min(F.struct("d", F.element_at(number, F.col("i")).alias("cluster"))).cluster.alias("cluster"))


def _swaps(both: DataFrame, medoids: list) -> dict[int, tuple[float, float, int]]:
    """For each slot of a medoid: the least cost with another point in its place, the present cost, and that point, the first of tied ones.

    One pass for all slots: beside its distance a point brings that of its nearest and second-nearest medoid. With i in
    the place of the nearest one, it costs the least of d and the second, with i in another's, the least of d and the nearest.
    """
    slots = F.create_map(*[F.lit(x).cast(t) for slot, m in enumerate(medoids) for x, t in ((m, "long"), (slot, "int"))])
    far = F.lit(float("inf"))
    near = F.array_sort(F.collect_list(F.struct("d", F.element_at(slots, F.col("i")).alias("slot"))))
    held = both.where(F.col("i").isin(medoids)).groupBy("j").agg(near.alias("near"))
    held = held.select("j", F.col("near")[0]["slot"].alias("slot"), F.col("near")[0]["d"].alias("first"), (F.col("near")[1]["d"] if len(medoids) > 1 else far).alias("second"))
    sums = both.join(held, "j").groupBy("i", "slot").agg(F.sum(F.col("n") * F.least("first", "d")).alias("kept"), F.sum(F.col("n") * F.least("second", "d")).alias("lost"))
    each = sums.groupBy("i").agg(F.sum("kept").alias("all"), F.collect_list(F.struct("slot", "kept", "lost")).alias("of"))
    costs = each.select("i", "all", F.inline("of")).select("i", "slot", (F.col("all") - F.col("kept") + F.col("lost")).alias("cost"))
    own = F.element_at(F.lit([int(m) for m in medoids]).cast("array<long>"), F.col("slot") + 1)
    costs = costs.where((F.col("i") == own) | ~F.col("i").isin(medoids))
    best = costs.groupBy("slot").agg(F.min(F.struct("cost", "i")).alias("best"), F.max(F.when(F.col("i") == own, F.col("cost"))).alias("now"))
    return {r.slot: (r.best.cost, r.now, r.best.i) for r in best.collect()}


def _hierarchical(kinds: DataFrame, k: int, method: str, metric: str, weighted: bool, lambda_: float) -> DataFrame:
    """id of each of the kinds (id, states, n) and its cluster."""
    points = written(numbered(kinds.select("id", "states", "n"), ("id",)))
    sizes = points.select("idx", "n").orderBy("idx").limit(linkage.POINTS + 1).toPandas().n.to_numpy()  # a number a point
    found = linkage.clusters(_distance_rows(points, len(sizes), metric, weighted, lambda_), sizes, k, method, DRIVER_ROWS)
    number = points.sparkSession.createDataFrame(found, "idx long, cluster int")
    return points.select("id", "idx").join(number, "idx").select("id", "cluster")


def cluster_sequences(seqs: Sequences, k: int, dissimilarity: str = "hamming", method: str = "pam", na_syms: tuple[str, ...] = ("*", "%"), weighted: bool = False, lambda_: float = 1.0, blocks: int | None = None) -> Clusters:
    """Clusters (from 1) by PAM or a linkage of hierarchical clustering.

    Equal sequences are one point of their number, except by lv and osa, which do not give them distance 0. PAM runs as
    Spark jobs, and so do linkages, as rounds of merges: see linkage. Median and centroid, by which merges can bring
    clusters closer, have no rounds: one task takes their matrix, and more than DRIVER_ROWS points raise an error.
    Up to linkage.SMALL points the first of tied pairs merges first; in rounds ties are broken by a hash of the pair.
    """
    if method != "pam" and method not in editing.LINKAGES:
        raise ValueError(f"unknown method {method!r}; known are pam, {', '.join(editing.LINKAGES)}")
    if dissimilarity not in editing.METRICS:
        raise ValueError(f"unknown metric {dissimilarity!r}; known are {', '.join(editing.METRICS)}")
    rows = written(_trimmed(seqs, na_syms))
    single = rows.withColumns({"last": F.col("id"), "n": F.lit(1).cast("long")})
    if k < 2 or k > rows.count():
        raise ValueError("k must be 2 at least and no more than the sequences")
    kinds = single
    if dissimilarity in COLLAPSING:
        kinds = written(classes(rows))
        if method != "pam" and kinds.count() < k:  # equal sequences must part
            kinds = single
    dist = _pairs(kinds, dissimilarity, weighted, lambda_, blocks)
    found = _pam(dist, kinds, k) if method == "pam" else _hierarchical(kinds, k, method, dissimilarity, weighted, lambda_)
    if kinds is single:
        member = written(found)
    else:
        member = written(_class_of(rows, kinds).join(found.withColumnRenamed("id", "class"), "class").select("id", "cluster"))
    sizes = {r.cluster: r["count"] for r in member.groupBy("cluster").count().collect()}
    if dissimilarity == "hamming":
        score = _hamming_silhouette(kinds, rows, member, weighted, lambda_) if kinds is not single else sequence_silhouette(seqs, member, "hamming", weighted, lambda_, na_syms)
    else:
        score = silhouette(dist, member) if kinds is single else _silhouette_of_classes(dist, _class_of(rows, kinds), member)
    return Clusters(member, distances(seqs, dissimilarity, weighted, lambda_, na_syms, blocks), k, method, score.first()[0] or 0.0, [sizes.get(c + 1, 0) for c in range(k)])
