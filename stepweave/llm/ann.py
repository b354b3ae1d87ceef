"""Approximate nearest neighbours: randomly rotated one-bit codes with correction scalars and error bounds (RaBitQ)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .vectors import matrix, means, usable

#: Candidates and queries in a group, about.
PART, QUERIES = 8192, 8192
#: Standard deviations of an estimate that its error bound covers.
SIGMAS = 2.5
#: Vectors that are ranked exactly for a query before the error bounds are asked, in multiples of k.
FIRST = 10
#: Bits of a query's coordinates: as many AND and popcount passes over the packed codes.
PLANES = 8


class Codes:
    """Packed sign bits of rotated, centred vectors, in 64-bit words, with what corrects the estimates."""

    def __init__(self, words: np.ndarray, norm: np.ndarray, fit: np.ndarray, d: int):
        self.words, self.norm, self.fit, self.d = words, norm, fit, d
        self.ones = np.bitwise_count(words).sum(1, dtype=np.int32)
        #: Standard deviation of the estimate for a unit query and unit residual.
        self.spread = np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(d - 1, 1))
        self.scale = norm / (fit * np.sqrt(d))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    width = -(-bits.shape[1] // 64) * 64
    return np.packbits(np.pad(bits, ((0, 0), (0, width - bits.shape[1]))), axis=1, bitorder="little").view("<u8")


def coded(vectors: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> Codes:
    r = (vectors.astype(np.float64) - centre) @ rotation
    d = r.shape[1]
    norm = np.sqrt((r * r).sum(1))
    # the inner product of the unit residual with its code's unit vector
    fit = np.where(norm > 0, np.abs(r).sum(1) / (np.where(norm > 0, norm, 1) * np.sqrt(d)), 1)
    return Codes(packed(r > 0), norm, fit, d)


def estimate(codes: Codes, queries: np.ndarray, centre: np.ndarray, rotation: np.ndarray, sigmas: float = SIGMAS):
    """Estimated inner products of queries (rows) with coded vectors (columns), and an error bound for each.

    A rotated query is rounded to PLANES bits a coordinate. Its inner product with a code is then a sum of popcounts of
    the packed words with each plane of bits; the codes are never opened. The bound is `sigmas` deviations of the
    estimate and the most that rounding can add.
    """
    turned = queries.astype(np.float64) @ rotation
    d, levels = turned.shape[1], (1 << PLANES) - 1
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-300) / levels
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    total = np.empty((len(queries), len(codes.words)), np.float32)
    spread, own = codes.norm * codes.spread * sigmas, np.sqrt((turned * turned).sum(1))
    bound = np.empty_like(total)
    base, count = queries.astype(np.float64) @ centre, np.empty(len(codes.words), np.int32)
    for k, row in enumerate(level):
        count[:] = 0
        for b, plane in enumerate(packed(np.stack([row >> b & 1 for b in range(PLANES)]).astype(bool))):
            hit = np.bitwise_count(codes.words & plane)
            count += (hit[:, 0] if hit.shape[1] == 1 else hit.sum(1, dtype=np.int32)).astype(np.int32) << b
        # over set bits twice, less over all: the inner product with the code's signs
        signs = 2 * (low[k] * codes.ones + step[k] * count) - turned[k].sum()
        total[k] = base[k] + codes.scale * signs
        bound[k] = own[k] * spread + codes.scale * (d * step[k] / 2)
    return total, bound


def search(rows, ids, vectors, codes: Codes, query_rows, queries, k: int, centre, rotation, sigmas: float = SIGMAS):
    """For each query its k nearest of the vectors, by inner product in double precision: (query's place, vector's place, score).

    The best FIRST * k by estimate are ranked exactly; every other vector whose estimate plus error bound reaches the
    k-th of them is ranked too. A query's own row is no candidate.
    """
    exact = vectors.astype(np.float64)
    first = min(FIRST * k, len(ids))
    out = []
    for s in range(0, len(queries), 64):
        block = queries[s : s + 64].astype(np.float64)
        total, bound = estimate(codes, block, centre, rotation, sigmas)
        total[query_rows[s : s + 64, None] == rows[None, :]] = -np.inf
        best = np.argpartition(-total, first - 1, axis=1)[:, :first]
        bound += total
        for row, (q, likely, reach) in enumerate(zip(block, best, bound)):
            own = np.where(total[row, likely] > -np.inf, exact[likely] @ q, -np.inf)
            least = np.partition(own, first - k)[first - k] if first >= k else -np.inf
            c = np.flatnonzero((reach >= np.float32(least - 1e-6)) & (reach > -np.inf))
            score = exact[c] @ q
            if len(c) > k:  # what can be among the k; equal vectors then get equal sums, wherever they stand
                c = c[score >= np.partition(score, len(c) - k)[len(c) - k] - 1e-9]
            score = np.einsum("ij,ij->i", exact[c], np.broadcast_to(q, (len(c), len(q))))
            top = np.lexsort((rows[c], ids[c], -score))[:k]
            out.append((np.full(len(top), row + s), c[top], score[top]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]


def code_table(good: DataFrame, turned: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """row, id, v and d with the packed code, norm and fit of every vector: each is coded once, however many groups it meets."""
    schema = good.select("*", F.lit(b"").alias("code"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("fit")).schema

    def run(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                codes = coded(matrix(part.column("v")), *turned[int(d)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([w.tobytes() for w in codes.words], pa.binary()), pa.array(codes.norm), pa.array(codes.fit)], schema.names)

    return good.mapInArrow(run, schema)


def nearest(rows: DataFrame, every: int = 20, k: int = 20, part: int = PART, queries: int = QUERIES, seed: int = 5, sigmas: float = SIGMAS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product of each row whose id `every` divides.

    All rows are coded, once, and searched. Candidates are dealt into groups of about `part`, queries of about
    `queries`; each pair of groups is searched alone, and the best k of each query over the groups are ranked. A
    candidate's vector goes with its code into a group: over thousands of queries nearly every vector is ranked exactly
    for one of them, so to fetch vectors apart would move more. The share of true neighbours found depends on `sigmas`
    only. Rows whose id is null, or whose vector is null, empty, zero or holds null or non-finite components, take no
    part, and vectors of different lengths don't meet. Each row with a fitting id is a query of its own and every other
    row a candidate: where ids repeat, each of their rows gets its own k neighbours, under one query_id. Ties go to the
    smaller vec_id. Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    good = rows.where(usable(vector) & F.col(id).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("d"))
    stats = means(good, "v")
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = sum(n for n, _ in stats.values())
    parts, blocks = max(1, -(-total // part)), max(1, -(-total // (every * queries)))
    turned = {d: (mean, np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))[0]) for d, (_, mean) in stats.items()}
    codes = written(code_table(good, turned), "codes")

    candidates = codes.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = codes.where(F.col("id") % every == 0).select("row", "id", "v", "d").withColumn("block", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    names = ["d", "part", "block"]
    schema = "query_row long, query_id long, vec_id long, vec_row long, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.float64() if x.endswith("double") else pa.int64()) for x in schema.split(", ")})
        d = left.column("d")[0].as_py()
        words = np.frombuffer(b"".join(left.column("code").to_pylist()), "<u8").reshape(left.num_rows, -1)
        own = Codes(words, left.column("norm").to_numpy(), left.column("fit").to_numpy(), d)
        ids, at, asks, places = left.column("id").to_numpy(), left.column("row").to_numpy(), right.column("id").to_numpy(), right.column("row").to_numpy()
        q, c, score = search(at, ids, matrix(left.column("v")), own, places, matrix(right.column("v")), k, *turned[d], sigmas)
        return pa.table({"query_row": places[q], "query_id": asks[q], "vec_id": ids[c], "vec_row": at[c], "score": score})

    met = candidates.groupBy(*names).cogroup(asked.groupBy(*names)).applyInArrow(run, schema)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, over the whole table: nulls, ties and repeats as nearest() says."""
    return nearest(table(spark, sf_dir, "embeddings"))
