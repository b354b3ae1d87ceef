"""Embedding near-dedup: PCA-ordered tiles compared by leading dimensions, with the rest bounded by suffix norms."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .components import connected_components
from .simhash import Forest
from .vectors import matrix, moments, usable

#: Vectors in a tile, about: what a task holds is two of them.
TILE = 8192
#: Rows of a tile that are compared at once with as many of another.
SIDE = 1024
#: Quantiles of the first and second axis at which a label is cut, at most.
BINS = 256
#: Leading axes on which two tiles' boxes are held apart.
BOX = 6
#: Leading dimensions after which the bound is tried again.
STEPS = (8, 24)
#: Above this share of the pairs compared at once the survivors are compared as a whole product.
DENSE = 0.05
SLACK = 1e-4


def reach_of(threshold: float) -> float:
    """Two unit vectors of cosine >= threshold are as far apart as this at most, on any axis and on all of them."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-5


def compare(x: np.ndarray, y: np.ndarray | None, threshold: float, rotation: np.ndarray):
    """Pairs (i, j) of rows of x and y with cosine >= threshold in double precision, in pieces; without y, pairs of rows
    of x, each once.

    Both sides are turned to principal axes and ordered by the first, so that sides of SIDE rows meet only where they
    come near enough on it. After the leading dimensions, the rest of an inner product is at most the product of the two
    suffix norms: a pair goes on only while that can reach the threshold. What is left is decided on the vectors as they were.
    """
    one, two = _turned(x, rotation), None
    two = one if y is None else _turned(y, rotation)
    reach, first = reach_of(threshold), two[2][:, 0]
    for s in range(0, len(x), SIDE):
        a = tuple(m[s : s + SIDE] for m in one)
        low = np.searchsorted(first, a[2][0, 0] - reach)
        high = np.searchsorted(first, a[2][-1, 0] + reach, "right")
        for k in range(max(low, s) if y is None else low, high, SIDE):
            b = tuple(m[k : min(k + SIDE, high)] for m in two)
            for i, j in _near(a[1], b[1], a[2], b[2], threshold):
                if y is None:
                    once = i + s < j + k
                    i, j = i[once], j[once]
                if len(i):
                    yield a[0][i], b[0][j]


def _turned(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by their first principal axis: their places in x, unit vectors, and those on the principal axes."""
    unit = x.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    turned = (unit @ rotation).astype(np.float32)
    order = np.argsort(turned[:, 0], kind="stable")
    return order, unit[order], turned[order]


def _near(ux, uy, px, py, threshold: float):
    steps = [d for d in STEPS if d < px.shape[1]] or [px.shape[1]]
    rest = {d: [np.sqrt(np.maximum(0, 1 - (p[:, :d].astype(np.float64) ** 2).sum(1))).astype(np.float32) for p in (px, py)] for d in steps}
    first = steps[0]
    bound = np.c_[px[:, :first], rest[first][0]] @ np.c_[py[:, :first], rest[first][1]].T
    i, j = np.nonzero(bound >= threshold - SLACK)
    if len(i) > DENSE * bound.size:
        for k in range(0, len(ux), 256):
            a, b = np.nonzero(ux[k : k + 256] @ uy.T >= threshold - 1e-9)
            yield from _decided(ux, uy, a + k, b, threshold)
        return
    for d in steps[1:]:
        keep = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            keep[k : k + (1 << 16)] = np.einsum("ij,ij->i", px[a, :d], py[b, :d]) + rest[d][0][a] * rest[d][1][b] >= threshold - SLACK
        i, j = i[keep], j[keep]
    yield from _decided(ux, uy, i, j, threshold)


def _decided(ux, uy, i, j, threshold):
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        ok = np.einsum("ij,ij->i", ux[a], uy[b]) >= threshold
        if ok.any():
            yield a[ok], b[ok]


def _tile(threshold: float, rotations: dict[int, np.ndarray]):
    def run(part: pa.Table) -> pa.Table:
        """One pair of tiles, or one tile: how many rows each vector links to here, and a spanning forest of the links."""
        side = np.asarray(part.column("right").to_numpy(zero_copy_only=False), bool)
        node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
        vectors = matrix(part.column("v"))
        same = part.column("x")[0].as_py() == part.column("y")[0].as_py()
        left, right = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
        found, forest, edges = np.zeros(len(node), np.int64), Forest(len(node)), []
        if len(left) and len(right):
            for a, b in compare(vectors[left], None if same else vectors[right], threshold, rotations[vectors.shape[1]]):
                a, b = left[a], right[b]
                np.add.at(found, a, copies[b])
                np.add.at(found, b, copies[a])
                roots = forest.roots()
                new = roots[a] != roots[b]
                edges += [(p, q) for p, q in zip(a[new].tolist(), b[new].tolist()) if forest.join(p, q)]
        hit = np.flatnonzero(found)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        none = np.full(len(hit), -1)
        return pa.table({
            "a": np.r_[node[hit], node[ends[:, 0]]],
            "b": np.r_[none, node[ends[:, 1]]],
            "links": np.r_[found[hit], np.zeros(len(ends), np.int64)],
        })

    return run


def _leads(rotations: dict[int, np.ndarray]):
    """Adds the first BOX coordinates of the unit vectors on the principal axes, 0 past the last."""
    axes = {d: np.pad(r[:, :BOX], ((0, 0), (0, max(0, BOX - d)))) for d, r in rotations.items()}

    def run(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            out = np.zeros((len(size), BOX))
            for d in np.unique(size):
                at = size == d
                x = matrix(batch.column("v").filter(pa.array(at))).astype(np.float64)
                out[at] = (x @ axes[int(d)]) / np.sqrt((x * x).sum(1))[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out.T)], [*batch.schema.names, *(f"lead{k}" for k in range(BOX))])

    return run


def tiled(classes: DataFrame, rotations: dict[int, np.ndarray], tile: int = TILE) -> DataFrame:
    """classes (label, v, node, copies) with d, BOX leads and t, the number of a tile within label and d.

    A label of more than one tile is cut at quantiles of the first axis, then of the second, into about as many cells as
    it needs tiles. A cell of more vectors than a tile, because many are alike on both axes, is dealt to as many tiles as
    its own count takes, by the hash of the node, so a tile stays near its size whatever the ties.
    """
    sized = classes.withColumn("d", F.size("v"))
    schema = sized.select("*", *[F.lit(0.0).alias(f"lead{k}") for k in range(BOX)]).schema
    placed = written(sized.mapInArrow(_leads(rotations), schema), "leads")
    counts = placed.groupBy("label", "d").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    large = counts.where("tiles > 1")
    steps = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cuts = placed.join(large, ["label", "d"]).groupBy("label", "d").agg(F.max("tiles").alias("tiles"), *[F.percentile_approx(f"lead{k}", steps, 2000).alias(f"q{k}") for k in (0, 1)])
    cuts = cuts.withColumn("n0", F.least(F.ceil(F.sqrt("tiles")).cast("int"), F.lit(BINS))).withColumn("n1", F.least(F.ceil(F.col("tiles") / F.col("n0")).cast("int"), F.lit(BINS)))

    def chosen(k: int):
        at = lambda j: F.element_at(f"q{k}", F.greatest(F.lit(1), (j * BINS / F.col(f"n{k}")).cast("int")))
        return F.when(F.col(f"n{k}") > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col(f"n{k}") - 1), at))).otherwise(F.array().cast("array<double>"))

    # one row a label
    cuts = cuts.select("label", "d", F.col("n1").alias("width"), *[chosen(k).alias(f"cuts{k}") for k in (0, 1)])
    placed = placed.join(cuts, ["label", "d"], "left")
    bin_of = lambda k: F.coalesce(F.size(F.filter(f"cuts{k}", lambda c: c < F.col(f"lead{k}"))), F.lit(0))
    placed = placed.withColumn("cell", F.when(F.col("cuts0").isNull(), 0).otherwise(bin_of(0) * F.col("width") + bin_of(1))).drop("cuts0", "cuts1", "width")
    cells = placed.groupBy("label", "d", "cell").agg(F.count("*").alias("n"))
    deep = F.when(F.col("n") > tile, F.ceil(F.col("n") / (0.75 * tile))).otherwise(1).cast("int")
    before = Window.partitionBy("label", "d").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # of cells, one row a tile
    cells = cells.withColumn("deep", deep).withColumn("start", F.coalesce(F.sum("deep").over(before), F.lit(0)).cast("int")).drop("n")
    placed = placed.join(cells, ["label", "d", "cell"])
    return placed.withColumn("t", (F.col("start") + F.pmod(F.xxhash64("node"), F.col("deep"))).cast("int")).drop("cell", "start", "deep")


def tile_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """label, d, x and y (x <= y) of tiles whose boxes on the leading axes come near enough to hold a link.

    Boxes are one row a tile. Only those meet that share a step of the reach on the first axis; then the distance of the
    boxes over all BOX axes decides.
    """
    reach = reach_of(threshold)
    ends = [f(f"lead{k}").alias(f"{name}{k}") for k in range(BOX) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = written(placed.groupBy("label", "d", "t").agg(*ends), "boxes")
    step = lambda x: F.floor(x / max(reach, 0.05))
    left = boxes.withColumn("step", F.explode(F.sequence(step(F.col("lo0") - reach), step(F.col("hi0") + reach))))
    right = boxes.withColumn("step", step(F.col("lo0"))).select("label", "d", "step", F.col("t").alias("other"), *[F.col(f"{name}{k}").alias(f"{name}_{k}") for k in range(BOX) for name in ("lo", "hi")])
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"hi_{k}"), F.col(f"lo_{k}") - F.col(f"hi{k}"))
    near = reduce(lambda a, b: a + b, [gap(k) * gap(k) for k in range(BOX)]) <= reach * reach
    met = left.join(right, ["label", "d", "step"]).where(near)
    return met.select("label", "d", F.least("t", "other").alias("x"), F.greatest("t", "other").alias("y")).distinct()


def near_vectors(rows: DataFrame, threshold: float = 0.93, tile: int = TILE, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links by cosine >= threshold among rows of one label.

    Equal vectors of a label are one class with a count, so a large group of copies costs one comparison. A label's
    classes are dealt to tiles by the first two principal axes; two tiles meet only where their boxes come near enough,
    and each pair of tiles is a group of its own, so a label of most rows spreads over many tasks and no task holds more
    than two tiles. A vector is sent to as many groups as its tile has neighbours: where nothing can be pruned, work is
    the square of a label's different vectors and what is sent is that over the tile's size. A group returns counts and a spanning forest, never
    all pairs. Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing (n_links 0, their own component); vectors of different lengths don't meet. Each row of a repeated id counts
    as a vector, and all of its rows come back. A null id is a vector as well; a component's id ignores nulls. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    wide = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    good = usable("v") & F.col("label").isNotNull()
    classes = wide.where(good).groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rotations = {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, (_, _, g) in moments(classes, "v", unit=True).items()}
    placed = written(tiled(classes.select("label", "v", "node", "copies"), rotations, tile), "tiled")
    pairs = tile_pairs(placed, threshold)
    sent = pairs.select("label", "d", F.col("x").alias("t"), "x", "y", F.lit(False).alias("right"))
    sent = sent.unionByName(pairs.where("x < y").select("label", "d", F.col("y").alias("t"), "x", "y", F.lit(True).alias("right")))
    groups = placed.select("label", "d", "t", "node", "copies", "v").join(sent, ["label", "d", "t"]).drop("t")
    met = written(groups.groupBy("label", "d", "x", "y").applyInArrow(_tile(threshold, rotations), "a long, b long, links long"), "tiles")

    components = connected_components(met.where("b >= 0").select("a", "b"))
    counted = met.groupBy("a").agg(F.sum("links").alias("links"))
    nodes = classes.join(counted, classes.node == counted.a, "left").join(components.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    nodes = nodes.select("label", "v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(least, "component").select("label", "v", "n_links", "component_id")
    linked = wide.where(good).join(nodes, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = wide.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors of the whole table: odd vectors, ties and repeats as it says."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
