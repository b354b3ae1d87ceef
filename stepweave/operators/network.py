"""Operators on the graphs of models: centralities, edge betweenness, cliques and communities, for every group at once."""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import graph
from .model import Model
from .shared import written

#: Measures that are sums over edges or products with them: these never leave the JVM.
NATIVE = ("OutStrength", "InStrength")
UNDIRECTED = ("co-occurrence", "attention")
#: States from which one task searches paths, about.
SOURCES = 64


def _matrix(edges: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    labels = sorted(set(edges.from_state) | set(edges.to_state))
    at = {s: k for k, s in enumerate(labels)}
    w = np.zeros((len(labels), len(labels)))
    w[edges.from_state.map(at), edges.to_state.map(at)] = edges.weight
    return labels, w


def _per_group(edges: DataFrame, groups: tuple[str, ...], kernel, schema: str) -> DataFrame:
    """kernel(labels, matrix) for each group; its frame gets the group's columns. A group is one small matrix."""
    fields = edges.select(*groups).schema.simpleString()[7:-1].replace(":", " ") if groups else ""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = kernel(*_matrix(part))
        for k, g in enumerate(groups):
            out.insert(k, g, part[g].iloc[0])
        return out

    keys = [F.col(g) for g in groups] or [F.lit("all")]
    return edges.groupBy(*keys).applyInPandas(run, f"{fields}, {schema}" if groups else schema)


def _by_source(edges: DataFrame, groups: tuple[str, ...], kernel, schema: str) -> DataFrame:
    """kernel(labels, matrix, sources, first) for each group and block of about SOURCES of its states, with the group's
    columns; the values of equal rows are still to be added up. Every block gets the group's edges and searches from its own
    states, which the hash of their label deals out; first marks one block of each group."""
    sizes = edges.groupBy(*groups).agg(F.ceil(F.greatest(F.count_distinct("from_state"), F.count_distinct("to_state")) / SOURCES).cast("int").alias("__blocks"))
    sizes = sizes.select(*[F.col(g).alias(f"__of_{g}") for g in groups], "__blocks", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))
    if groups:
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
        dealt = edges.join(sizes, same)
    else:
        dealt = edges.crossJoin(F.broadcast(sizes))  # a row for each block of SOURCES states
    fields = edges.select(*groups).schema.simpleString()[7:-1].replace(":", " ") if groups else ""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        block, blocks = int(part["__block"].iloc[0]), int(part["__blocks"].iloc[0])
        labels, w = _matrix(part)
        out = kernel(labels, w, np.array([k for k, s in enumerate(labels) if zlib.crc32(str(s).encode()) % blocks == block], int), block == 0)
        for k, g in enumerate(groups):
            out.insert(k, g, part[g].iloc[0])
        return out

    return dealt.groupBy(*groups, "__block").applyInPandas(run, f"{fields}, {schema}" if groups else schema)


def centralities(model: Model, measures: list[str] | None = None, loops: bool = False, normalize: bool = False) -> DataFrame:
    """groups, state, measure and value. Loops don't count unless asked for; undirected models have undirected betweenness.

    Strengths are aggregations, measures by paths are added up over blocks of their sources, and what needs products or
    inverses gets each group's matrix in a task of its own. Edges are written to a table first, which all parts read.
    """
    wanted = list(graph.MEASURES) if measures is None else list(measures)
    unknown = set(wanted) - set(graph.MEASURES)
    if unknown:
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    groups, directed = model.groups, model.type_ not in UNDIRECTED
    edges = written(model.weights, "edges")
    own = edges if loops else edges.withColumn("weight", F.when(F.col("from_state") == F.col("to_state"), F.lit(0.0)).otherwise(F.col("weight")))
    parts = []
    for name, side in (("OutStrength", "from_state"), ("InStrength", "to_state")):
        if name in wanted:
            parts.append(own.groupBy(*groups, F.col(side).alias("state")).agg(F.sum("weight").alias("value")).select(*groups, "state", F.lit(name).alias("measure"), "value"))
    schema = "state string, measure string, value double"
    paths = [m for m in graph.BY_SOURCE if m in wanted]
    if paths:

        def searched(labels, w, sources, first):
            own = set(sources.tolist())
            found = [(s, m, float(v)) for m in paths for k, (s, v) in enumerate(zip(labels, graph.measure(m, w, loops, directed, sources))) if k in own or v]
            return pd.DataFrame(found, columns=["state", "measure", "value"])

        parts.append(_by_source(edges, groups, searched, schema).groupBy(*groups, "state", "measure").agg(F.sum("value").alias("value")))
    rest = [m for m in graph.MEASURES if m in wanted and m not in NATIVE and m not in paths]
    if rest:

        def kernel(labels, w):
            return pd.DataFrame([(s, m, float(v)) for m in rest for s, v in zip(labels, graph.measure(m, w, loops, directed))], columns=["state", "measure", "value"])

        parts.append(_per_group(edges, groups, kernel, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if normalize:
        w = Window.partitionBy(*groups, "measure")
        low, high = F.min("value").over(w), F.max("value").over(w)
        out = out.withColumn("value", F.when(high == low, F.lit(0.0)).otherwise((F.col("value") - low) / (high - low)))
    return out


def wide(values: DataFrame, groups: tuple[str, ...] = (), measures: list[str] | None = None) -> DataFrame:
    """A row a state, a column a measure, in the fixed order of measures."""
    names = [m for m in graph.MEASURES if measures is None or m in measures]
    return values.groupBy(*groups, "state").pivot("measure", names).agg(F.first("value"))


def diffusion(model: Model, steps: int, loops: bool = False) -> DataFrame:
    """Diffusion centrality as joins: the vector of ones goes through the edges `steps` times, and all results add up."""
    groups = model.groups
    edges = model.weights if loops else model.weights.where("from_state <> to_state")
    v = model.weights.select(*groups, F.col("from_state").alias("state")).distinct().withColumn("x", F.lit(1.0))
    total = v.select(*groups, "state", F.lit(0.0).alias("value"))
    for _ in range(steps):
        v = edges.join(v.withColumnRenamed("state", "to_state"), [*groups, "to_state"]).groupBy(*groups, F.col("from_state").alias("state")).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        total = total.unionByName(v.withColumnRenamed("x", "value"))
    return total.groupBy(*groups, "state").agg(F.sum("value").alias("value"))


def betweenness_network(model: Model) -> Model:
    """A model whose weights are the numbers of shortest paths over each edge; loops are no part of any.

    Paths are searched by blocks of sources. Each gives the edges it has paths over, and one gives every edge a row.
    """
    directed, groups = model.type_ not in UNDIRECTED, model.groups

    def kernel(labels, w, sources, first):
        out = graph.edge_betweenness(w if directed else graph.undirected(w), directed, sources)
        at = np.nonzero(np.ones(out.shape) if first else out)
        names = np.array(labels, object)
        return pd.DataFrame({"from_state": names[at[0]], "to_state": names[at[1]], "weight": out[at]})

    parts = _by_source(written(model.weights, "edges"), groups, kernel, "from_state string, to_state string, weight double")
    weights = parts.groupBy(*groups, "from_state", "to_state").agg(F.sum("weight").alias("weight"))
    return replace(model, weights=weights, type_="betweenness", sequences=None)


def cliques(model: Model, size: int = 2, threshold: float = 0.0) -> DataFrame:
    """groups, state_1 .. state_n: sets of states each two of which pass the threshold in both directions.

    The table of mutual edges is joined to itself, one state more each time, in the order of labels.
    """
    if size < 2:
        raise ValueError("a clique has two states at least")
    groups = list(model.groups)
    strong = model.weights.where(F.col("weight") > threshold).select(*groups, "from_state", "to_state")
    back = strong.select(*groups, F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"))
    mutual = strong.join(back, [*groups, "from_state", "to_state"]).where("from_state < to_state")
    out = mutual.select(*groups, F.col("from_state").alias("state_1"), F.col("to_state").alias("state_2"))
    for k in range(3, size + 1):
        for j in range(1, k):
            step = mutual.select(*groups, F.col("from_state").alias(f"state_{j}"), F.col("to_state").alias(f"state_{k}"))
            out = out.join(step, [*groups, f"state_{j}", *([f"state_{k}"] if j > 1 else [])])
    return out.select(*groups, *[f"state_{k}" for k in range(1, size + 1)])


def communities(model: Model, methods: tuple[str, ...] = ("leading_eigen",)) -> DataFrame:
    """groups, method, state and community, from 0 by the smallest member."""
    unknown = set(methods) - set(graph.METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")

    def kernel(labels, w):
        return pd.DataFrame([(m, s, int(c)) for m in methods for s, c in zip(labels, graph.communities(w, m))], columns=["method", "state", "community"])

    return _per_group(model.weights, model.groups, kernel, "method string, state string, community int")
