"""Scalings of edge tables (groups, from_state, to_state, weight), each over the whole matrix of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _whole(groups: tuple[str, ...]):
    """A matrix of states, which is small whatever the data: one window holds it."""
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def row_normalize(edges: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Rows that sum to 1; rows of zeros stay."""
    total = F.sum("weight").over(Window.partitionBy(*groups, "from_state"))
    return edges.withColumn("weight", F.when(total == 0, F.lit(0.0)).otherwise(F.col("weight") / total))


def minmax_scale(edges: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    w = _whole(groups)
    low, high = F.min("weight").over(w), F.max("weight").over(w)
    return edges.withColumn("weight", F.when(high == low, F.lit(0.0)).otherwise((F.col("weight") - low) / (high - low)))


def max_scale(edges: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    high = F.max("weight").over(_whole(groups))
    return edges.withColumn("weight", F.when(high == 0, F.col("weight")).otherwise(F.col("weight") / high))


def rank_scale(edges: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Ranks over all cells, ties at their mean; then zero weights are 0 again."""
    ties = F.count("*").over(Window.partitionBy(*groups, "weight"))
    rank = F.rank().over(_whole(groups).orderBy("weight")) + (ties - 1) / 2
    return edges.withColumn("weight", F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(rank.cast("double")))


SCALINGS = {"minmax": minmax_scale, "max": max_scale, "rank": rank_scale}


def apply_scaling(edges: DataFrame, scaling: str | list[str] | None, groups: tuple[str, ...] = ()) -> DataFrame:
    """Scalings by name, from left to right, whatever the case of the names."""
    names = [scaling] if isinstance(scaling, str) else list(scaling or [])
    for name in names:
        if name.lower() not in SCALINGS:
            raise ValueError(f"unknown scaling {name!r}; known are {', '.join(SCALINGS)}")
        edges = SCALINGS[name.lower()](edges, groups)
    return edges


def prune(edges: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Weights below the threshold become 0."""
    return edges.withColumn("weight", F.when(F.col("weight") < threshold, F.lit(0.0)).otherwise(F.col("weight")))


def distance_from_weights(edges: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """-ln(weight); a zero weight is infinitely far."""
    return edges.withColumn("distance", F.when(F.col("weight") <= 0, F.lit(float("inf"))).otherwise(-F.log(F.greatest("weight", F.lit(epsilon)))))
