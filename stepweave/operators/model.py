"""Transition models: dense weights and initial probabilities of each group, as lazy tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scaling as scalings
from .sequences import Sequences
from .transitions import NORMALISED, counts, initial_counts


@dataclass(frozen=True)
class Model:
    """weights: groups, from_state, to_state, weight for every pair of labels; inits: groups, state, prob; labels: label."""

    weights: DataFrame
    inits: DataFrame
    labels: DataFrame
    type_: str
    groups: tuple[str, ...] = ()
    scaling: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    sequences: Sequences | None = None

    def to_dataframe(self, labels: list[str] | None = None) -> DataFrame:
        """One row a state, a column for each next state; labels, if known, save a pass."""
        by = self.weights.groupBy(*self.groups, "from_state")
        return (by.pivot("to_state", labels) if labels else by.pivot("to_state")).agg(F.first("weight"))

    def summary(self) -> DataFrame:
        """By group: states, positive edges and their density, mean and largest weight, and whether a state follows itself."""
        positive = F.when(F.col("weight") > 0, F.col("weight"))
        loop = F.when((F.col("weight") > 0) & (F.col("from_state") == F.col("to_state")), 1).otherwise(0)
        by = self.weights.groupBy(*self.groups).agg(
            F.countDistinct("from_state").alias("n_states"), F.count(positive).alias("n_edges"), (F.count(positive) / F.count("*")).alias("density"),
            F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean_weight"), F.max("weight").alias("max_weight"), (F.max(loop) == 1).alias("has_self_loops"),
        )
        return by

    def scaled(self, scaling: str | list[str] | None) -> Model:
        names = [scaling] if isinstance(scaling, str) else list(scaling or [])
        return replace(self, weights=scalings.apply_scaling(self.weights, names, self.groups), scaling=(*self.scaling, *(n.lower() for n in names)))

    def pruned(self, threshold: float = 0.05) -> Model:
        return replace(self, weights=scalings.prune(self.weights, threshold))

    def names(self) -> DataFrame:
        """The groups, one row each."""
        return self.weights.select(*self.groups).distinct()

    def renamed(self, names: dict[str, str]) -> Model:
        """The same with other names of the groups of a model grouped by one column."""
        (group,) = self.groups
        if len(set(names.values())) != len(names):
            raise ValueError("new names repeat")
        new = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        swap = lambda df: df.withColumn(group, F.coalesce(new[F.col(group)], F.col(group)))
        seqs = self.sequences and replace(self.sequences, frame=swap(self.sequences.frame))
        return replace(self, weights=swap(self.weights), inits=swap(self.inits), sequences=seqs)

    def group(self, **values) -> Model:
        """One group's model, or those of some values of the group columns."""
        pick = lambda df: df.where(reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()]))
        seqs = self.sequences and replace(self.sequences, frame=pick(self.sequences.frame))
        return replace(self, weights=pick(self.weights), inits=pick(self.inits), sequences=seqs)

    def apply(self, kernel: Callable, schema: str) -> DataFrame:
        """kernel(pandas frame of a group's edges) for each group, in parallel."""
        keys = list(self.groups) or [F.lit("all")]
        return self.weights.groupBy(*keys).applyInPandas(kernel, schema)

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.inits.write.mode("overwrite").parquet(f"{path}/inits")

    def register(self, spark: SparkSession, name: str) -> None:
        """Weights and inits as temporary views, for SQL."""
        self.weights.createOrReplaceTempView(f"{name}_weights")
        self.inits.createOrReplaceTempView(f"{name}_inits")


def load(spark: SparkSession, path: str, type_: str, groups: tuple[str, ...] = ()) -> Model:
    weights = spark.read.parquet(f"{path}/weights")
    return Model(weights, spark.read.parquet(f"{path}/inits"), weights.select(F.col("from_state").alias("label")).distinct(), type_, groups)


def _grid(labels: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Every pair of labels for each group. Labels are states, few whatever the data: the product is of small tables."""
    pairs = labels.select(F.col("label").alias("from_state")).crossJoin(labels.select(F.col("label").alias("to_state")))
    return pairs if groups is None else groups.crossJoin(pairs)


def dense(counted: DataFrame, labels: DataFrame, groups: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """Counts as weights, with zeros for pairs that never come."""
    full = _grid(labels, groups).join(counted, [*keys, "from_state", "to_state"], "left")
    return full.select(*keys, "from_state", "to_state", F.coalesce("n", F.lit(0.0)).alias("weight"))


def build_model(seqs: Sequences, type_: str = "relative", scaling: str | list[str] | None = None, labels: list[str] | None = None, **params) -> Model:
    """A model of every group of the sequences, over labels they share.

    States outside given labels keep their places but are counted in no pair. Rows of relative, reverse, n-gram, gap and
    window models sum to 1, those of others are counts. Rows with a null group are dropped.
    """
    groups = seqs.groups
    if groups:
        seqs = replace(seqs, frame=seqs.frame.where(reduce(and_, [F.col(g).isNotNull() for g in groups])))
    spark = seqs.frame.sparkSession
    known = spark.createDataFrame([(x,) for x in labels], "label string") if labels is not None else seqs.labels()
    counted, first = counts(seqs, type_, **params), initial_counts(seqs, type_, **params)
    if labels is not None:
        counted = counted.where(F.col("from_state").isin(labels) & F.col("to_state").isin(labels))
        first = first.where(F.col("state").isin(labels))
    names = seqs.frame.select(*groups).distinct() if groups else None
    weights = dense(counted, known, names, groups)
    if type_ in NORMALISED:
        weights = scalings.row_normalize(weights, groups)
    states = known.select(F.col("label").alias("state"))
    every = states if names is None else names.crossJoin(states)
    inits = every.join(first, [*groups, "state"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    total = F.sum("n").over(Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0)))
    inits = inits.select(*groups, "state", F.when(total > 0, F.col("n") / total).alias("prob"))
    return Model(weights, inits, known, type_, groups, (), params, seqs).scaled(scaling)


def from_matrix(cells: DataFrame, type_: str = "relative", scaling: str | list[str] | None = None) -> Model:
    """A model of a ready matrix, given as from_state, to_state, weight: rows are normalised for a relative one only, and
    initial probabilities are equal."""
    labels = cells.select(F.col("from_state").alias("label")).union(cells.select("to_state")).distinct()
    weights = dense(cells.select("from_state", "to_state", F.col("weight").cast("double").alias("n")), labels, None, ())
    if type_ == "relative":
        weights = scalings.row_normalize(weights)
    count = labels.agg(F.count("*").alias("c"))
    inits = labels.crossJoin(F.broadcast(count)).select(F.col("label").alias("state"), (1.0 / F.col("c")).alias("prob"))  # one row
    return Model(weights, inits, labels, type_).scaled(scaling)


def tna(seqs: Sequences, **options) -> Model:
    return build_model(seqs, "relative", **options)


def ftna(seqs: Sequences, **options) -> Model:
    return build_model(seqs, "frequency", **options)


def ctna(seqs: Sequences, **options) -> Model:
    return build_model(seqs, "co-occurrence", **options)


def atna(seqs: Sequences, beta: float = 1.0, **options) -> Model:
    return build_model(seqs, "attention", beta=beta, **options)


def group_tna(seqs: Sequences, *groups: str, **options) -> Model:
    return tna(seqs.with_groups(*groups), **options)


def group_ftna(seqs: Sequences, *groups: str, **options) -> Model:
    return ftna(seqs.with_groups(*groups), **options)


def group_ctna(seqs: Sequences, *groups: str, **options) -> Model:
    return ctna(seqs.with_groups(*groups), **options)


def group_atna(seqs: Sequences, *groups: str, beta: float = 1.0, **options) -> Model:
    return atna(seqs.with_groups(*groups), beta=beta, **options)
