"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches. Nodes without edges aren't returned.

    Edges lie in the shared folder between rounds. Each round takes minima by node, which Spark combines before the
    shuffle, and joins them back, which adaptive execution splits for a node of very many edges. Nothing but one truth
    value a round reaches the driver. Null ends and loops are ignored; repeated edges count once.
    """
    links = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo and lo is not null").distinct()
    links = written(links, "links")
    while not _is_star_forest(links):
        links = written(_small_star(_large_star(links)), "links")
    roots = links.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _is_star_forest(links: DataFrame) -> bool:
    """Every node hangs on one node at most, and what others hang on hangs on nothing."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return odd.isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Neighbours larger than a node move to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    moved = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.where("hi > lo").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Neighbours smaller than a node, and the node, move to the least of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
