"""Exact top-k search by inner product over M-trees: paged metric nodes with covering radii and parent distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .vectors import matrix

#: Entries of a leaf page, child pages of an inner one, and vectors of a tree, about: the trees are what tasks build and search.
LEAF, FAN, TREE = 256, 32, 8192
#: Routing objects above the trees at most, and rows that each of them is chosen from: what the driver gets.
TOP, SAMPLE = 1024, 16
#: Queries that meet a tree in one group.
QUERIES = 4096
#: Doubles add and multiply whole numbers below this exactly.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

NODES = "tree long, page int, parent int, leaf boolean, pivot array<double>, lift double, radius double, parent_dist double, children array<int>, rows array<long>, ids array<long>, vectors array<double>, lifts array<double>, dists array<double>"
FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"


def whole(vectors: np.ndarray, factor: int = 256) -> np.ndarray:
    """Components as whole numbers: floor(factor * x), x as double."""
    return np.floor(factor * vectors.astype(np.float64))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Whole inner products: by doubles where these are exact, or else by Python's integers, held to the range of a long."""
    if not len(vectors) or not vectors.shape[1]:
        return np.zeros(len(vectors), np.int64)
    if np.abs(vectors).max() * np.abs(query).max() * vectors.shape[1] < EXACT:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, q)))) for row in vectors], np.int64)


class Space:
    """The metric that ranks by inner product: a vector x of squared norm at most `most` is lifted by sqrt(most - |x|^2)
    in one more coordinate, a query by 0. The squared distance of query and vector is then |q|^2 + most - 2 q.x."""

    def __init__(self, most: float):
        self.most = most

    def lifts(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - (vectors * vectors).sum(1)))

    def distances(self, vectors: np.ndarray, lifts: np.ndarray, x: np.ndarray, lift: float) -> np.ndarray:
        d = vectors - x
        return np.sqrt((d * d).sum(1) + (lifts - lift) ** 2)

    def reach(self, score: float, query: np.ndarray) -> float:
        """The distance at which a vector has this score, and what rounding may add to it."""
        own = float(query @ query)
        return np.sqrt(max(0.0, own + self.most - 2.0 * score)) + self.slack(own)

    def slack(self, own: float) -> float:
        return 1e-6 + 1e-7 * np.sqrt(own + self.most)


class Tree:
    """Pages of one tree, bulk loaded: page 0 is the root; an inner page routes to children by the nearest of their pivots."""

    def __init__(self, space: Space, nodes: list[dict]):
        self.space, self.nodes = space, nodes
        for n in nodes:
            if not n["leaf"]:
                kids = [nodes[c] for c in n["children"]]
                n["pivots"] = np.stack([k["pivot"] for k in kids])
                n["pivot_lifts"] = np.array([k["lift"] for k in kids])
                n["radii"] = np.array([k["radius"] for k in kids])
                n["kid_dists"] = np.array([k["parent_dist"] for k in kids])

    @classmethod
    def build(cls, space: Space, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        lifts, nodes = space.lifts(vectors), []

        def put(at: np.ndarray, pivot: int, parent: int, parent_dist: float) -> int:
            d = space.distances(vectors[at], lifts[at], vectors[pivot], lifts[pivot])
            me = len(nodes)
            node = {"page": me, "parent": parent, "leaf": len(at) <= LEAF, "pivot": vectors[pivot], "lift": float(lifts[pivot]), "radius": float(d.max()), "parent_dist": parent_dist, "children": []}
            nodes.append(node)
            if node["leaf"]:
                node |= {"rows": rows[at], "ids": ids[at], "vectors": vectors[at], "lifts": lifts[at], "dists": d}
                return me
            count = min(FAN, -(-len(at) // LEAF) * 2)
            chosen = at[np.linspace(0, len(at) - 1, count).astype(int)]
            apart = np.stack([space.distances(vectors[at], lifts[at], vectors[c], lifts[c]) for c in chosen])
            near = apart.argmin(0)
            if np.bincount(near, minlength=count).max() == len(at):  # copies of one vector: any parts are as good
                near = np.arange(len(at)) * count // len(at)
            for k in range(count):
                part = np.flatnonzero(near == k)
                if len(part):
                    place = int(np.searchsorted(at, chosen[k]))
                    node["children"].append(put(at[part], int(chosen[k]), me, float(d[place])))
            return me

        put(np.arange(len(rows)), 0, -1, 0.0)
        return cls(space, nodes)

    def search(self, query: np.ndarray, k: int, own: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows, ids and scores of the k best, own row aside, best first, of those with a score of `least` at least.

        Pages wait in a heap by the least distance they may hold, and the search ends at the first that can't hold one of
        the best. A page or entry is passed over without a distance computed if the query's distance from its parent's
        pivot and the stored one differ by too much.
        """
        best: tuple = (np.zeros(0, np.int64),) * 3
        space, root = self.space, self.nodes[0]
        reach = space.reach(least, query) if least > -np.inf else np.inf
        d = float(space.distances(root["pivot"][None], np.array([root["lift"]]), query, 0.0)[0])
        heap = [(max(0.0, d - root["radius"]), 0, d)]
        while heap and heap[0][0] <= reach:
            _, page, d = heapq.heappop(heap)
            node = self.nodes[page]
            if not node["leaf"]:
                kids = np.flatnonzero(np.abs(d - node["kid_dists"]) - node["radii"] <= reach)
                apart = space.distances(node["pivots"][kids], node["pivot_lifts"][kids], query, 0.0)
                low = np.maximum(0.0, apart - node["radii"][kids])
                for c, x, lo in zip(kids.tolist(), apart.tolist(), low.tolist()):
                    if lo <= reach:
                        heapq.heappush(heap, (lo, node["children"][c], x))
                continue
            near = np.abs(d - node["dists"]) <= reach
            near &= node["rows"] != own
            at = np.flatnonzero(near)
            score = products(node["vectors"][at], query)
            good = score >= least
            at, score = at[good], score[good]
            if len(at):
                rows, ids, scores = (np.concatenate(x) for x in zip(best, (node["rows"][at], node["ids"][at], score)))
                top = np.lexsort((rows, ids, -scores))[:k]
                best = (rows[top], ids[top], scores[top])
                if len(top) == k:
                    least = max(least, float(scores[top[-1]]))
                    reach = space.reach(least, query)
        return best

    def pages(self, tree: int) -> Iterator[dict]:
        for n in self.nodes:
            leaf = n["leaf"]
            yield {
                "tree": tree, "page": n["page"], "parent": n["parent"], "leaf": leaf, "pivot": n["pivot"], "lift": n["lift"], "radius": n["radius"], "parent_dist": n["parent_dist"], "children": n["children"],
                "rows": n["rows"] if leaf else [], "ids": n["ids"] if leaf else [], "vectors": n["vectors"].ravel() if leaf else [], "lifts": n["lifts"] if leaf else [], "dists": n["dists"] if leaf else [],
            }

    @classmethod
    def read(cls, space: Space, pages: list[dict]) -> Tree:
        nodes = []
        for p in sorted(pages, key=lambda p: p["page"]):
            n = {k: p[k] for k in ("page", "parent", "leaf", "lift", "radius", "parent_dist", "children")} | {"pivot": np.array(p["pivot"])}
            if p["leaf"]:
                n |= {"rows": np.array(p["rows"], np.int64), "ids": np.array(p["ids"], np.int64), "lifts": np.array(p["lifts"]), "dists": np.array(p["dists"])}
                n["vectors"] = np.array(p["vectors"], np.float64).reshape(len(n["rows"]), -1)
            nodes.append(n)
        return cls(space, nodes)


def _taking_part(rows: DataFrame, id: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col(f"`{id}`").isNotNull())
    return good.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("d"))


def _pivots(rows: DataFrame, factor: int, total: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length of vector its routing objects: some of a sample of at most SAMPLE rows for each of them."""
    out = {}
    for d, n in total.items():
        count = max(1, min(TOP, -(-n // TREE)))
        sample = rows.where(F.col("d") == d).select("row", "v").orderBy(F.xxhash64("row")).limit(SAMPLE * count if count > 1 else 1).collect()
        x = whole(np.array([r.v for r in sample]).reshape(len(sample), d), factor)
        chosen, apart = [0], np.full(len(x), np.inf)
        while len(chosen) < min(count, len(x)):  # each as far as can be from those before
            apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(apart.argmax()))
        out[d] = x[chosen]
    return out


def _routed(good: DataFrame, pivots: dict[int, np.ndarray], spaces: dict[int, Space], factor: int) -> DataFrame:
    """row, id, v (whole numbers), d, top (the nearest routing object's number)."""

    def run(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                x, space = whole(matrix(part.column("v")) if d else np.zeros((part.num_rows, 0)), factor), spaces[int(d)]
                p = pivots[int(d)]
                pl, xl = space.lifts(p), space.lifts(x)
                top = np.stack([space.distances(x, xl, a, b) for a, b in zip(p, pl)]).argmin(0).astype(np.int32)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * int(d)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), v, part.column("d"), pa.array(top)], ["row", "id", "v", "d", "top"])

    return good.mapInArrow(run, "row long, id long, v array<double>, d int, top int")


def _largest(good: DataFrame, factor: int) -> dict[int, tuple[int, float]]:
    """For each length of vector, its rows and the largest squared norm of the whole numbers."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * factor).cast("double"), F.lit(2.0)))
    return {r.d: (r.n, r.m * (1 + 1e-12)) for r in good.groupBy("d").agg(F.count("*").alias("n"), F.max(square).alias("m")).collect()}


def _as_table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


NODE_SCHEMA = pa.schema([
    ("tree", pa.int64()), ("page", pa.int32()), ("parent", pa.int32()), ("leaf", pa.bool_()), ("pivot", pa.list_(pa.float64())), ("lift", pa.float64()), ("radius", pa.float64()), ("parent_dist", pa.float64()),
    ("children", pa.list_(pa.int32())), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64())), ("lifts", pa.list_(pa.float64())), ("dists", pa.list_(pa.float64())),
])


def forest(rows: DataFrame, factor: int = 256, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, dict[int, tuple[int, Space, np.ndarray]]]:
    """The index: pages of all trees (NODES, and d), the routed rows, and what the driver knows of each length of vector.

    Rows go to the nearest of the routing objects, and the rows of one of them, hot or not, are dealt by hash into trees of
    about TREE vectors, each built by one task. The driver holds the routing objects alone, TOP of them at most.
    """
    good = _taking_part(rows, id, vector)
    known = _largest(good, factor)
    spaces = {d: Space(m) for d, (_, m) in known.items()}
    pivots = _pivots(good, factor, {d: n for d, (n, _) in known.items()})
    routed = written(_routed(good, pivots, spaces, factor), "routed")
    sizes = {(r.d, r.top): r.n for r in routed.groupBy("d", "top").agg(F.count("*").alias("n")).collect()}  # TOP rows a length at most
    first, trees = {}, 0
    for key in sorted(sizes):
        first[key] = (trees, -(-sizes[key] // TREE))
        trees += first[key][1]
    plan = rows.sparkSession.createDataFrame([(d, t, a, b) for (d, t), (a, b) in first.items()], "d int, top int, start long, parts long")
    dealt = routed.join(F.broadcast(plan), ["d", "top"]).withColumn("tree", F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("start", "parts")

    def build(part: pa.Table) -> pa.Table:
        d = part.column("d")[0].as_py()
        x = matrix(part.column("v")) if d else np.zeros((part.num_rows, 0))
        order = np.argsort(part.column("row").to_numpy())
        made = Tree.build(spaces[d], part.column("row").to_numpy()[order], part.column("id").to_numpy()[order], x[order])
        found = _as_table(list(made.pages(part.column("tree")[0].as_py())), NODE_SCHEMA)
        return found.append_column("d", pa.array([d] * found.num_rows, pa.int32()))

    pages = written(dealt.groupBy("tree").applyInArrow(build, f"{NODES}, d int"), "pages") if known else None
    return pages, dealt, {d: (known[d][0], spaces[d], pivots[d]) for d in known}


def _rows_found(asks: list, found: list) -> pa.Table:
    parts = [(np.full(len(rows), row), np.full(len(rows), ask), rows, ids, scores) for (row, ask), (rows, ids, scores) in zip(asks, found)]
    columns = [np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts) if parts else [[]] * 5)]
    return pa.table({c.split()[0]: pa.array(x.astype(np.int64)) for c, x in zip(FOUND.split(", "), columns)})


def topk(rows: DataFrame, every: int = 50, k: int = 5, factor: int = 256, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `every` divides, its k highest inner products of whole numbers.

    Exact. Each query first searches the tree it lies in itself; its k-th score there bounds what other trees must reach.
    It then visits those trees that may hold a better one, by the distance of the query from the tree's routing object,
    the stored one from there to the tree's root, and the root's covering radius. Where data have no metric structure
    (vectors at random in many dimensions) few trees are left out, and the work is queries times rows.

    Rows whose id is null, or whose vector is null or holds null or non-finite components, take no part; vectors of
    different lengths don't meet, and empty ones have products of 0. Each row with a fitting id is a query of its own,
    and where ids repeat, every other row is a candidate. Ties go to the smaller vec_id. Products beyond a long are held
    to its range. Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    pages, dealt, known = forest(rows, factor, id, vector)
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spaces = {d: s for d, (_, s, _) in known.items()}
    asked = dealt.where(F.col("id") % every == 0).select("row", "id", "v", "d", "top", F.col("tree").alias("own_tree"))

    def search(bounded: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _rows_found([], [])
            d = left.column("d")[0].as_py()
            made = Tree.read(spaces[d], left.to_pylist())
            x = matrix(right.column("v")) if d else np.zeros((right.num_rows, 0))
            least = right.column("least").to_pylist() if bounded else [None] * right.num_rows
            asks = list(zip(right.column("row").to_pylist(), right.column("id").to_pylist()))
            return _rows_found(asks, [made.search(q, k, row, -np.inf if low is None else low) for q, (row, _), low in zip(x, asks, least)])

        return run

    def met(queries: DataFrame, bounded: bool) -> DataFrame:
        """Queries (with `tree`) beside the pages of their trees: a tree of very many queries is met by blocks of them."""
        blocks = queries.groupBy("tree").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
        left = pages.join(blocks, "tree").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        right = queries.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
        return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(search(bounded), FOUND)

    seeds = written(met(asked.withColumnRenamed("own_tree", "tree"), False), "seeds")
    least = seeds.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("s")).alias("least"))
    roots = pages.where("page = 0").select("tree", "d", "pivot", "lift", "radius")
    far = _visits(asked.join(least, "row", "left"), roots, dealt.select("tree", "top", "d").distinct(), known)
    found = seeds.unionByName(met(far, True))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visits(asked: DataFrame, roots: DataFrame, tops: DataFrame, known: dict) -> DataFrame:
    """row, id, v, least and tree: trees that may hold a vector within a query's reach, its own aside.

    A query's distances from the routing objects are computed once; to each tree's root the stored distance bounds the rest.
    """
    spaces, pivots = {d: s for d, (_, s, _) in known.items()}, {d: p for d, (_, _, p) in known.items()}

    def to_tops(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                part, space, p = batch.filter(pa.array(size == d)), spaces[int(d)], pivots[int(d)]
                x, pl = matrix(part.column("v")) if d else np.zeros((part.num_rows, 0)), spaces[int(d)].lifts(p)
                apart = np.stack([space.distances(p, pl, q, 0.0) for q in x])
                reach = [float("inf") if low is None else float(space.reach(low, q)) for low, q in zip(part.column("least").to_pylist(), x)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(p)), pa.array(apart.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "id", "v", "d", "own_tree", "least")], lists, pa.array(reach)], ["row", "id", "v", "d", "own_tree", "least", "apart", "reach"])

    def root_dists(batches):
        for batch in batches:
            out = [float(spaces[d].distances(np.array([v]).reshape(1, d), np.array([lift]), pivots[d][t], float(spaces[d].lifts(pivots[d][t : t + 1])[0]))[0]) for v, lift, d, t in zip(*[batch.column(c).to_pylist() for c in ("pivot", "lift", "d", "top")])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("tree", "d", "top", "radius")], pa.array(out, pa.float64())], ["tree", "d", "top", "radius", "to_top"])

    asks = asked.select("row", "id", "v", "d", "own_tree", "least").mapInArrow(to_tops, "row long, id long, v array<double>, d int, own_tree long, least long, apart array<double>, reach double")
    trees = roots.join(tops, ["tree", "d"]).mapInArrow(root_dists, "tree long, d int, top int, radius double, to_top double")
    # one row a routing object that a query reaches at all: a ball about it of the trees' farthest points
    balls = trees.groupBy("d", "top").agg(F.max(F.col("to_top") + F.col("radius")).alias("ball"))
    asks = asks.select("row", "id", "v", "d", "own_tree", "least", "reach", F.posexplode("apart").alias("top", "to")).join(F.broadcast(balls), ["d", "top"]).where("to - ball <= reach")  # TOP rows a length at most
    near = asks.join(trees, ["d", "top"]).where("tree <> own_tree and abs(to - to_top) - radius <= reach")
    return near.select("row", "id", "v", "least", "tree")


def op11_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest products of every fiftieth vector, over the whole table: nulls, ties and repeats as topk() says."""
    return topk(table(spark, sf_dir, "embeddings"))
