"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str):
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column of vectors of one length as a matrix of its own type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def moments(rows: DataFrame, vector: str, unit: bool) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector: rows, their sum and the sum of their outer products, over all rows.

    Partitions are summed in Python, then the sums by Spark, so that the driver gets one row a length, however many rows there are.
    """

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                x = matrix(batch.column("v").filter(pa.array(size == d))).astype(np.float64)
                if unit:
                    x /= np.sqrt((x * x).sum(1))[:, None]
                n, s, g = found.get(int(d), (0, 0.0, 0.0))
                found[int(d)] = [n + len(x), s + x.sum(0), g + x.T @ x]
        for d, (n, s, g) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n]), pa.array([np.r_[s, g.ravel()].tolist()], pa.list_(pa.float64()))], ["d", "n", "sums"])

    parts = rows.select(F.size(vector).alias("d"), F.col(vector).alias("v")).mapInArrow(run, "d int, n long, sums array<double>")
    sums = parts.select("d", "n", F.posexplode("sums").alias("k", "x")).groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = sums.groupBy("d").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("sums"))
    out = {}
    for r in whole.collect():
        x = np.array(r.sums)
        out[r.d] = (r.n, x[: r.d], x[r.d :].reshape(r.d, r.d))
    return out


def means(rows: DataFrame, vector: str) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vector: rows and their mean. Spark adds up one sum a partition, length and place."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                x = matrix(batch.column("v").filter(pa.array(size == d))).astype(np.float64)
                n, s = found.get(int(d), (0, 0.0))
                found[int(d)] = [n + len(x), s + x.sum(0)]
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([n] * d), pa.array(range(d), pa.int32()), pa.array(s)], ["d", "n", "k", "x"])

    parts = rows.select(F.size(vector).alias("d"), F.col(vector).alias("v")).mapInArrow(run, "d int, n long, k int, x double")
    sums = parts.groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = sums.groupBy("d").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("sums"))
    return {r.d: (r.n, np.array(r.sums) / r.n) for r in whole.collect()}
