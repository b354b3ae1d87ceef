"""Bootstrap, permutation and stability of models, over replicates as one more key of a plan.

The calls that take a model, bootstrap_tna, permutation_test_models, permutation_test_edges and estimate_cs, draw exactly
(n of n, sides of their sizes, shares of their sizes) for any number of sequences, by blocks of sequences: see
replicates. What moves is replicates times edges for each task, however many sequences there are.

Where a replicate is given, it is a table of how often it takes each sequence, or of the side each sequence is on: drawn
on the driver by numpy, for as many sequences as a driver holds, or an expression of the sequence's key and the
replicate's number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import graph, stats
from ..functions.stats import p_adjust
from . import replicates
from . import scaling as scalings
from .model import Model, build_model
from .prepare import Prepared
from .replicates import chunks, key, mixed, multiplicities, permuted, placed, summed
from .sequences import Sequences, from_frame
from .shared import written
from .transitions import blocks_of

DRIVER_DRAWS = 50_000_000
COUNTED = ("relative", "frequency", "reverse", "co-occurrence")


def cells(seqs: Sequences, type_: str = "relative", params: dict | None = None) -> DataFrame:
    """keys, from_state, to_state and n: the counts of every sequence, by raw places: a hole breaks a pair.

    params are those of the model: of a windowed co-occurrence model pairs are counted within blocks of places.
    """
    if type_ not in COUNTED:
        raise ValueError(f"models of type {type_!r} can't be resampled; those of {', '.join(COUNTED)} can")
    w, windowed = seqs.window(), bool((params or {}).get("windowed"))
    if type_ == "co-occurrence":
        keys, rows = seqs.keys, seqs.present()
        if windowed:
            keys, rows = (*keys, "block"), blocks_of(seqs, params.get("window_size", 1), params.get("window_span", 1))
        counts = rows.groupBy(*keys, "state").agg(F.count("*").cast("double").alias("c"))
        left = counts.select(*keys, F.col("state").alias("from_state"), F.col("c").alias("a"))
        both = left.join(counts.select(*keys, F.col("state").alias("to_state"), F.col("c").alias("b")), list(keys))
        own = F.col("a") * F.col("a") if windowed else F.col("a") * (F.col("a") - 1) / 2
        n = F.when(F.col("from_state") == F.col("to_state"), own).otherwise(F.col("a") * F.col("b"))
        found = both.select(*seqs.keys, "from_state", "to_state", n.alias("n")).where("n > 0")
        return found.groupBy(*seqs.keys, "from_state", "to_state").agg(F.sum("n").alias("n")) if windowed else found
    to = F.when(F.lead("raw_pos").over(w) == F.col("raw_pos") + 1, F.lead("state").over(w))
    pairs = seqs.frame.select(*seqs.keys, F.col("state").alias("from_state"), to.alias("to_state")).where("from_state is not null and to_state is not null")
    if type_ == "reverse":
        pairs = pairs.withColumnsRenamed({"from_state": "to_state", "to_state": "from_state"})
    return pairs.groupBy(*seqs.keys, "from_state", "to_state").agg(F.count("*").cast("double").alias("n"))


def drawn(spark: SparkSession, ids: list, iterations: int, seed: int | None, id: str = "seq_id", kind: str = "long", share: float | None = None) -> DataFrame:
    """rep, id, m: numpy's draws with replacement, or of a share without, for a list of sequences that fits the driver."""
    if len(ids) * iterations > DRIVER_DRAWS:
        raise ValueError("too many draws for the driver: give multiplicities as an expression")
    rng, parts = np.random.default_rng(seed), []
    for rep in range(iterations):
        at = rng.choice(len(ids), len(ids), replace=True) if share is None else rng.choice(len(ids), int(len(ids) * share), replace=False)
        which, m = np.unique(at, return_counts=True)
        parts.append(pd.DataFrame({"rep": rep, id: [ids[k] for k in which], "m": m}))
    return spark.createDataFrame(pd.concat(parts), f"rep int, {id} {kind}, m long")


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) by MD5 of the columns as text, with blanks between them: without a period, and any engine's."""
    text = F.concat_ws(" ", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def poisson_multiplicity(*key: Column | str) -> Column:
    """How often a replicate takes a sequence, the key naming both: Poisson with mean 1."""
    return poisson_of(uniform(*key))


def poisson_of(u: Column) -> Column:
    """The Poisson variable of mean 1 that a uniform one in [0, 1) stands for."""
    # fixed values: the distribution function of a Poisson variable of mean 1, at 0 to 9
    ends = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)
    out = F.when(u < ends[0], 0)
    for k, end in enumerate(ends[1:], 1):
        out = out.when(u < end, k)
    return out.otherwise(len(ends))


def replicated(counted: DataFrame, keys: tuple[str, ...], labels: DataFrame, type_: str, scaling: tuple[str, ...] = (), grid: DataFrame | None = None) -> DataFrame:
    """Dense weights of every replicate from its counts (keys, from_state, to_state, n).

    grid: the replicates there are, one row each, those that took no pair too; without it, those with a count.
    """
    states = labels.select(F.col("label").alias("from_state")).crossJoin(labels.select(F.col("label").alias("to_state")))
    full = (counted.select(*keys).distinct() if grid is None else grid.select(*keys)).crossJoin(states)  # replicates and states: both few
    weights = full.join(counted, [*keys, "from_state", "to_state"], "left").select(*keys, "from_state", "to_state", F.coalesce("n", F.lit(0.0)).alias("weight"))
    if type_ in ("relative", "reverse"):
        weights = scalings.row_normalize(weights, keys)
    return scalings.apply_scaling(weights, list(scaling), keys)


def _reps(spark: SparkSession, iterations: int, *more: DataFrame | None) -> DataFrame:
    """rep from 0, for each row of some small tables."""
    out = spark.range(iterations).select(F.col("id").cast("int").alias("rep"))
    for rows in more:
        out = out if rows is None else out.crossJoin(F.broadcast(rows))
    return out


def bootstrap_weights(model: Model, iterations: int, multiplicity: Column | None = None, draws: DataFrame | None = None) -> DataFrame:
    """rep, from_state, to_state, weight for every replicate: by an expression over the ids and `rep`, or by a table of draws."""
    seqs = model.sequences
    own = cells(seqs, model.type_, model.params)
    if draws is not None:
        taken = own.join(draws, list(seqs.ids))
    else:
        taken = _each_by_replicate(own, seqs, iterations).withColumn("m", F.explode(F.array(multiplicity))).where("m > 0").select(*model.groups, "rep", "m", F.inline("cells"))
    counted = taken.groupBy(*model.groups, "rep", "from_state", "to_state").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return _weights_of(model, counted, iterations)


def _each_by_replicate(own: DataFrame, seqs: Sequences, iterations: int) -> DataFrame:
    """A row for each sequence and replicate, with the sequence's counts, states squared at most, in one array: what is
    drawn for it is worked out once, in a generator, and not for each count."""
    each = own.groupBy(*seqs.keys).agg(F.collect_list(F.struct("from_state", "to_state", "n")).alias("cells"))
    return each.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))


def _weights_of(model: Model, counted: DataFrame, iterations: int) -> DataFrame:
    names = model.sequences.frame.select(*model.groups).distinct() if model.groups else None
    return replicated(counted, (*model.groups, "rep"), model.labels, model.type_, model.scaling, _reps(counted.sparkSession, iterations, names))


def bootstrap_draws(model: Model, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """groups, rep, from_state, to_state, weight: every replicate draws as many sequences of each group as there are, with replacement."""
    seqs, parts, block = model.sequences, chunks(iterations), replicates.BLOCK

    def drawn_(start, total, first, size):
        for reps in parts:
            yield 0, reps.start, multiplicities(first, total, reps, seed, start, block)

    own = placed(cells(seqs, model.type_, model.params), seqs.frame, seqs.keys, seqs.groups)
    return _weights_of(model, summed(own, seqs.groups, ("from_state", "to_state"), drawn_).drop("label"), iterations)


def bootstrap(model: Model, again: DataFrame, level: float = 0.05, method: str = "stability", consistency: tuple[float, float] = (0.75, 1.25), threshold: float | None = None) -> DataFrame:
    """groups, from_state, to_state, weight, mean, sd, ci_lower, ci_upper, p_value, sig: edges over their replicates.

    Stability counts replicates at or beyond the consistency range of the weight, on either side; threshold counts those
    below a threshold, by default the 10 % quantile of all weights of the group.
    """
    keys = list(model.groups)
    real = model.weights.withColumnRenamed("weight", "w")
    if method == "threshold" and threshold is None:
        quantile = F.percentile("weight", F.lit(0.1)).alias("thr")
        cut = model.weights.groupBy(*keys).agg(quantile)
        real = real.join(cut, keys) if keys else real.crossJoin(F.broadcast(cut))  # one row
    else:
        real = real.withColumn("thr", F.lit(threshold))
    met = again.join(real, [*keys, "from_state", "to_state"])
    if method == "stability":
        worse = (F.col("weight") <= F.col("w") * consistency[0]).cast("int") + (F.col("weight") >= F.col("w") * consistency[1]).cast("int")
    elif method == "threshold":
        worse = (F.col("weight") < F.col("thr")).cast("int")
    else:
        raise ValueError(f"unknown method {method!r}; known are stability, threshold")
    out = met.groupBy(*keys, "from_state", "to_state").agg(
        F.first("w").alias("weight"), F.avg("weight").alias("mean"), F.stddev_samp("weight").alias("sd"), F.percentile("weight", F.lit(level / 2)).alias("ci_lower"),
        F.percentile("weight", F.lit(1 - level / 2)).alias("ci_upper"), ((F.sum(worse) + 1) / (F.count("*") + 1)).alias("p_value"),
    )
    return out.withColumn("sig", F.col("p_value") < level)


@dataclass(frozen=True)
class Bootstrap:
    """weights of every replicate, and edges and summary (those with a weight) as bootstrap() gives them."""

    weights: DataFrame
    edges: DataFrame
    summary: DataFrame


def _modelled(data: Model | Sequences | Prepared | DataFrame, type_: str, scaling: str | list[str] | None) -> Model:
    if isinstance(data, Model):
        return data
    if isinstance(data, Prepared):
        data = data.sequences
    elif isinstance(data, DataFrame):
        data = from_frame(data)
    return build_model(data, type_, scaling)


def bootstrap_tna(model: Model | Sequences | Prepared | DataFrame, iterations: int = 1000, level: float = 0.05, method: str = "stability", consistency: tuple[float, float] = (0.75, 1.25), threshold: float | None = None, seed: int = 0, type_: str = "relative", scaling: str | list[str] | None = None) -> Bootstrap:
    """A model's bootstrap in one call, for any number of sequences: a replicate draws as many of each group, with
    replacement, as the group has. Sequences, a prepared log or a wide frame (a sequence a row, a place a column) may be
    given in place of a model: they are modelled by type_ and scaling, which a model has of its own."""
    model = _modelled(model, type_, scaling)
    if model.sequences is None:
        raise ValueError("the model has no sequences to resample")
    again = written(bootstrap_draws(model, iterations, seed), "bootstrap")
    edges = bootstrap(model, again, level, method, consistency, threshold)
    return Bootstrap(again, edges, edges.where("weight > 0"))


def bca_edges(model: Model | Sequences | Prepared | DataFrame, iterations: int = 1000, level: float = 0.05, seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """groups, from_state, to_state, weight, bias, acceleration, ci_lower, ci_upper: bias-corrected and accelerated intervals
    of every edge, from its replicates (bootstrap_draws() if none are given).

    A weight without one sequence is that of the totals less the sequence's counts, so the acceleration takes three sums of
    how far these weights are off, over the sequences with a place in the edge's row; all others leave it as it is. Models
    of row shares or of counts have these; those that were scaled afterwards are refused. What isn't a model is modelled as
    bootstrap_tna() does.
    """
    model = _modelled(model, "relative", None)
    if model.scaling:
        raise ValueError("intervals are those of weights before scaling")
    keys, seqs = list(model.groups), model.sequences
    again = bootstrap_draws(model, iterations, seed) if draws is None else draws
    own = written(cells(seqs, model.type_, model.params), "cells")
    edge = [*keys, "from_state", "to_state"]
    totals = model.weights.select(*edge, "weight").join(own.groupBy(*edge).agg(F.sum("n").alias("c")), edge, "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    if model.type_ in ("relative", "reverse"):
        totals = totals.withColumn("r", F.sum("c").over(Window.partitionBy(*keys, "from_state")))
        rows = own.groupBy(*seqs.keys, "from_state").agg(F.sum("n").alias("row"))
        met = rows.join(totals, [*keys, "from_state"]).join(own, [*seqs.keys, "from_state", "to_state"], "left")
        left = F.when(F.col("r") > F.col("row"), (F.col("c") - F.coalesce("n", F.lit(0.0))) / F.nullif(F.col("r") - F.col("row"), F.lit(0.0))).otherwise(F.lit(0.0))
        off = left - F.when(F.col("r") > 0, F.col("c") / F.nullif("r", F.lit(0.0))).otherwise(F.lit(0.0))
    else:
        met, off = own, -F.col("n")
    sums = met.withColumn("off", off).groupBy(*edge).agg(*[F.sum(F.pow("off", F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3)])
    sizes = seqs.frame.select(*seqs.keys).distinct().groupBy(*keys).agg(F.count("*").alias("size"))
    whole = totals.select(*edge, "weight").join(sums, edge, "left").na.fill(0.0, ["s1", "s2", "s3"])
    whole = whole.join(sizes, keys) if keys else whole.crossJoin(F.broadcast(sizes))  # one row
    mean = F.col("s1") / F.col("size")
    second = F.col("s2") - F.col("size") * mean * mean
    third = F.col("size") * F.pow(mean, F.lit(3.0)) - 3 * mean * mean * F.col("s1") + 3 * mean * F.col("s2") - F.col("s3")
    spread = 6 * F.pow(F.greatest(second, F.lit(0.0)), F.lit(1.5))
    whole = whole.select(*edge, "weight", F.coalesce(third / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("acceleration"))
    values = again.withColumnRenamed("weight", "value").join(whole, edge).groupBy(*edge, "weight", "acceleration").agg(F.avg(F.when(F.col("value") < F.col("weight"), 1.0).otherwise(0.0)).alias("below"), F.array_sort(F.collect_list("value")).alias("values"))
    fields = [*values.select(*edge, "weight", "acceleration").schema.fields]
    schema = StructType([*fields, *[StructField(c, DoubleType()) for c in ("bias", "ci_lower", "ci_upper")]])

    def ends(parts):
        for part in parts:
            found = [stats.bca_ends(np.asarray(v), b, a, level) for v, b, a in zip(part["values"], part["below"], part["acceleration"])]
            yield part.drop(columns=["values", "below"]).assign(**{c: [f[k] for f in found] for k, c in enumerate(("bias", "ci_lower", "ci_upper"))})

    out = values.select(*edge, "weight", "acceleration", "below", "values").mapInPandas(ends, schema)
    return out.select(*edge, "weight", "bias", "acceleration", "ci_lower", "ci_upper")


def significant_edges(result: DataFrame) -> DataFrame:
    return result.where("sig and weight > 0")


def _replicate_measures(replicates: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...], loops: bool, directed: bool) -> DataFrame:
    """keys, state, measure, value: centralities of every replicate, many replicates to a task."""
    fields = replicates.select(*keys).schema.simpleString()[7:-1].replace(":", " ")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        labels = sorted(set(part.from_state) | set(part.to_state))
        at = {s: k for k, s in enumerate(labels)}
        w = np.zeros((len(labels),) * 2)
        w[part.from_state.map(at), part.to_state.map(at)] = part.weight
        head = [part[k].iloc[0] for k in keys]
        return pd.DataFrame([(*head, s, m, float(v)) for m in measures for s, v in zip(labels, graph.measure(m, w, loops, directed))], columns=[*keys, "state", "measure", "value"])

    return replicates.groupBy(*keys).applyInPandas(run, f"{fields}, state string, measure string, value double")


def bootstrap_centralities(model: Model, replicates: DataFrame, measures: tuple[str, ...] = ("OutStrength", "InStrength", "Betweenness"), level: float = 0.05, loops: bool = False) -> DataFrame:
    """groups, measure, state, mean, ci_lower, ci_upper, se over replicates."""
    directed = model.type_ not in ("co-occurrence", "attention")
    values = _replicate_measures(replicates, (*model.groups, "rep"), tuple(measures), loops, directed)
    return values.groupBy(*model.groups, "measure", "state").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(level / 2)).alias("ci_lower"), F.percentile("value", F.lit(1 - level / 2)).alias("ci_upper"), F.stddev_samp("value").alias("se"))


def shuffled(spark: SparkSession, ids: list, sides: list, iterations: int, seed: int | None, id: str = "seq_id", kind: str = "long", paired: bool | str = False) -> DataFrame:
    """rep, id, side: numpy's permutations of the sides of a list of sequences.

    Paired ones swap the sides of neighbours in the list, or, if paired is "halves", of the k-th sequences of its two halves.
    """
    if len(ids) * iterations > DRIVER_DRAWS:
        raise ValueError("too many draws for the driver: give sides as an expression")
    rng, parts = np.random.default_rng(seed), []
    sides = np.array(sides)
    for rep in range(iterations):
        if paired:
            pairs = np.arange(len(ids)).reshape(2, -1).T if paired == "halves" else np.arange(len(ids)).reshape(-1, 2)
            flip = rng.random(len(pairs)) < 0.5
            order = np.arange(len(ids))
            order[pairs[flip]] = pairs[flip, ::-1]
        else:
            order = rng.permutation(len(ids))
        parts.append(pd.DataFrame({"rep": rep, id: ids, "side": sides[order]}))
    return spark.createDataFrame(pd.concat(parts), f"rep int, {id} {kind}, side string")


def side_weights(seqs: Sequences, type_: str, sides: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("rep", "side"), scaling: tuple[str, ...] = (), grid: DataFrame | None = None, params: dict | None = None) -> DataFrame:
    """Weights of every side of every replicate: those of the grid, or else all that any sequence is dealt to."""
    own = cells(Sequences(seqs.frame, seqs.ids), type_, params)
    counted = own.join(sides, list(seqs.ids)).groupBy(*keys, "from_state", "to_state").agg(F.sum("n").alias("n"))
    return replicated(counted, keys, labels, type_, scaling, sides.select(*keys).distinct() if grid is None else grid)


def _difference(weights: DataFrame, keys: tuple[str, ...], x: str, y: str, what: tuple[str, ...], value: str = "weight") -> DataFrame:
    """x's value less y's, by keys and what is measured."""
    signed = F.when(F.col("side") == x, F.col(value)).when(F.col("side") == y, -F.col(value)).otherwise(F.lit(0.0))
    return weights.groupBy(*keys, *what).agg(F.sum(signed).alias("diff"))


def permutation_test(seqs: Sequences, type_: str, real: DataFrame, replicates: DataFrame, x: str, y: str, adjust: str = "none", level: float = 0.05, measures: tuple[str, ...] = (), scaling: tuple[str, ...] = (), labels: DataFrame | None = None, params: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Differences of two sides of sequences, and how they lie among those of replicates.

    real: ids and side; replicates: rep, ids and side. Returns from_state, to_state, diff, effect_size (null where all
    replicates agree), p_value and diff_sig, and the same of the measures by state, if asked for.
    """
    labels = seqs.labels() if labels is None else labels
    found = side_weights(seqs, type_, real, labels, ("side",), scaling, params=params)
    again = side_weights(seqs, type_, replicates, labels, ("rep", "side"), scaling, params=params)
    return _tested_sides(found, again, type_, x, y, adjust, level, measures)


def _tested_sides(found: DataFrame, again: DataFrame, type_: str, x: str, y: str, adjust: str, level: float, measures: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """permutation_test() from the weights of the sides and those of replicates."""

    def tested(a: DataFrame, b: DataFrame, what: tuple[str, ...], value: str) -> DataFrame:
        d, ds = _difference(a, (), x, y, what, value), _difference(b, ("rep",), x, y, what, value).withColumnRenamed("diff", "s")
        met = ds.join(d, list(what)).groupBy(*what).agg(
            F.first("diff").alias("diff"), F.stddev_samp("s").alias("sd"), ((F.sum(F.when(F.abs("s") >= F.abs("diff"), 1).otherwise(0)) + 1) / (F.count("*") + 1)).alias("p")
        )
        met = p_adjust(met, "p", adjust, into="p_value")
        effect = F.when(F.col("sd") > 0, F.col("diff") / F.col("sd"))
        return met.select(*what, "diff", effect.alias("effect_size"), "p_value", F.when(F.col("p_value") < level, F.col("diff")).otherwise(F.lit(0.0)).alias("diff_sig"))

    edges = tested(found, again, ("from_state", "to_state"), "weight")
    if not measures:
        return edges, None
    directed = type_ != "co-occurrence"
    a = _replicate_measures(found, ("side",), measures, False, directed)
    b = _replicate_measures(again, ("rep", "side"), measures, False, directed)
    return edges, tested(a, b, ("state", "measure"), "value")


def _pooled(x: Model, y: Model) -> tuple[Sequences, list[str]]:
    """The sequences of two models as one table: side, x or y, is part of their ids."""
    if x.sequences is None or y.sequences is None:
        raise ValueError("both models need their sequences")
    if x.type_ != y.type_ or x.params != y.params or x.sequences.ids != y.sequences.ids:
        raise ValueError("both models must be of one type and have the same parameters, and their sequences have ids of one name")
    ids = list(x.sequences.ids)
    parts = [m.sequences.frame.select(F.lit(side).alias("own_side"), *ids, "raw_pos", "state") for side, m in (("x", x), ("y", y))]
    return Sequences(parts[0].unionByName(parts[1]), ("own_side", *ids)), ids


def permutation_test_models(x: Model, y: Model, iterations: int = 1000, adjust: str = "none", paired: bool = False, level: float = 0.05, measures: tuple[str, ...] = (), seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """permutation_test() of two models in one call.

    A replicate deals as many sequences to x as x has, for any number of them. Paired, the two sequences of one id, one of
    each model, change sides together or stay. Models of different states, types or parameters, without sequences, or
    paired and of different ids are refused.
    """
    seqs, ids = _pooled(x, y)
    if not x.labels.exceptAll(y.labels).isEmpty() or not y.labels.exceptAll(x.labels).isEmpty():
        raise ValueError("both models must have the same states: build them with the labels of both")
    return _permuted(seqs, ids, x.type_, x.scaling, x.labels, iterations, adjust, paired, level, measures, seed, x.params)


def _permuted(seqs, ids, type_, scaling, labels, iterations, adjust, paired, level, measures, seed, params=None):
    each = seqs.frame.select(*seqs.ids).distinct()
    if paired and not each.groupBy(*ids).agg(F.countDistinct("own_side").alias("n")).where("n < 2").isEmpty():
        raise ValueError("paired models must have sequences of the same ids")
    count, chunked = each.where("own_side = 'x'").count(), chunks(iterations)

    def stay(start, total, first, size):  # pairs by replicate: 1 where the two keep their sides
        at = np.arange(first, first + size, dtype=np.uint32)
        for reps in chunked:
            keys = np.array([key(seed, rep) for rep in reps], np.uint32)[:, None]
            yield 0, reps.start, mixed(at[None, :], keys) >> np.uint32(31)

    def first_ones(start, total, first, size):
        for reps in chunked:
            yield 0, reps.start, permuted(np.arange(first, first + size), total, reps, seed) < count

    own, what = cells(seqs, type_, params), ("from_state", "to_state")
    own = written(placed(own, seqs.frame, seqs.ids, by=tuple(ids) if paired else None), "placed")
    on_x = summed(own, (), what, stay if paired else first_ones, "own_side" if paired else None).select("rep", *what, "n")
    sums = own.groupBy("own_side", *what).agg(F.sum("n").alias("n"))
    all_ = sums.groupBy(*what).agg(F.sum("n").alias("n"))
    rest = _reps(seqs.frame.sparkSession, iterations, all_.withColumnRenamed("n", "of_all")).join(on_x, ["rep", *what], "left").select("rep", *what, (F.col("of_all") - F.coalesce("n", F.lit(0.0))).alias("n"))
    both = on_x.withColumn("side", F.lit("x")).unionByName(rest.withColumn("side", F.lit("y")))
    sides = seqs.frame.sparkSession.createDataFrame([("x",), ("y",)], "side string")
    again = written(replicated(both, ("rep", "side"), labels, type_, scaling, _reps(seqs.frame.sparkSession, iterations, sides)), "permuted")
    found = replicated(sums.withColumnRenamed("own_side", "side"), ("side",), labels, type_, scaling, sides)
    return _tested_sides(found, again, type_, "x", "y", adjust, level, measures)


def permutation_test_edges(x: Sequences, y: Sequences, iterations: int = 1000, correction: str = "none", type_: str = "relative", seed: int = 0) -> DataFrame:
    """from_state, to_state, diff, p_value, p_adjusted (the same number, adjusted) and significant (below 0.05) of every
    edge between the states of two tables of sequences: models of both are built over the states of either."""
    a, b = Model(None, None, None, type_, sequences=x), Model(None, None, None, type_, sequences=y)
    seqs, ids = _pooled(a, b)
    edges, _ = _permuted(seqs, ids, type_, (), seqs.labels(), iterations, correction, False, 0.05, (), seed)
    return edges.select("from_state", "to_state", "diff", "p_value", F.col("p_value").alias("p_adjusted"), (F.col("p_value") < 0.05).alias("significant"))


def permutation_summary(edges: DataFrame) -> DataFrame:
    """One row: the root of the summed squared differences, and the least p value."""
    return edges.agg(F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("observed"), F.min("p_value").alias("p_value"))


def stability(model: Model, kept: DataFrame, measures: tuple[str, ...] = ("OutStrength", "InStrength", "Betweenness"), method: str = "pearson", loops: bool = False) -> DataFrame:
    """prop, rep, measure, corr: how centralities of models without a share of the sequences agree with the whole model's.

    kept: prop, rep and the ids that stay. A measure that doesn't vary has correlation 0.
    """
    seqs = model.sequences
    counted = cells(seqs, model.type_, model.params).join(kept, list(seqs.ids)).groupBy("prop", "rep", "from_state", "to_state").agg(F.sum("n").alias("n"))
    return _stability_of(model, replicated(counted, ("prop", "rep"), model.labels, model.type_, model.scaling, kept.select("prop", "rep").distinct()), measures, method, loops)


def _stability_of(model: Model, weights: DataFrame, measures: tuple[str, ...], method: str, loops: bool) -> DataFrame:
    """stability() from the weights of every share and replicate."""
    directed = model.type_ not in ("co-occurrence", "attention")
    again = _replicate_measures(weights, ("prop", "rep"), measures, loops, directed)
    whole = _replicate_measures(model.weights.withColumn("rep", F.lit(0)), ("rep",), measures, loops, directed).select("state", "measure", F.col("value").alias("real"))
    met = again.join(whole, ["state", "measure"])
    if method == "spearman":
        keys = Window.partitionBy("prop", "rep", "measure")
        for c in ("value", "real"):
            met = met.withColumn(c, F.rank().over(keys.orderBy(c)) + (F.count("*").over(Window.partitionBy("prop", "rep", "measure", c)) - 1) / 2)
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}; known are pearson, spearman")
    spread = F.stddev_pop("value") * F.stddev_pop("real")
    return met.groupBy("prop", "rep", "measure").agg(F.when(spread == 0, F.lit(0.0)).otherwise(F.covar_pop("value", "real") / spread).alias("corr"))


def cs_coefficients(correlations: DataFrame, threshold: float = 0.7, certainty: float = 0.95) -> DataFrame:
    """measure, cs: the largest dropped share at which enough replicates correlate well; 0 if none does."""
    share = F.avg(F.when(F.col("corr") >= threshold, 1.0).otherwise(0.0))
    good = correlations.where(~F.isnan("corr")).groupBy("measure", "prop").agg(share.alias("share"))
    return good.groupBy("measure").agg(F.coalesce(F.max(F.when(F.col("share") >= certainty, F.col("prop"))), F.lit(0.0)).alias("cs"))


@dataclass(frozen=True)
class CentralityStability:
    correlations: DataFrame
    coefficients: DataFrame


def estimate_cs(model: Model, iterations: int = 1000, props: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), seed: int = 0, threshold: float = 0.7, certainty: float = 0.95, **options) -> CentralityStability:
    """Case-dropping stability in one call, for any number of sequences: of n, a replicate drops floor(n * share), and those
    dropped at one share are among those dropped at a larger one. All shares come from one pass."""
    if model.sequences is None:
        raise ValueError("the model has no sequences to drop")
    if model.groups:
        raise ValueError("stability is that of one model: take one group")
    seqs, chunked = model.sequences, chunks(iterations)

    def kept(start, total, first, size):
        for reps in chunked:
            at = permuted(np.arange(first, first + size), total, reps, seed)
            for label, prop in enumerate(props):
                yield label, reps.start, at < total - int(np.floor(total * prop))

    own = placed(cells(seqs, model.type_, model.params), seqs.frame, seqs.keys)
    spark = seqs.frame.sparkSession
    shares = spark.createDataFrame(list(enumerate(map(float, props))), "label int, prop double")
    counted = summed(own, (), ("from_state", "to_state"), kept).join(F.broadcast(shares), "label")
    weights = replicated(counted, ("prop", "rep"), model.labels, model.type_, model.scaling, _reps(spark, iterations, shares))
    found = written(_stability_of(model, weights, **{"measures": ("OutStrength", "InStrength", "Betweenness"), "method": "pearson", "loops": False} | options), "stability")
    return CentralityStability(found, cs_coefficients(found, threshold, certainty))
