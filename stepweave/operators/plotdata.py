"""What plots of models show, as tables: a renderer draws them, none is needed here."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .model import Model
from .network import centralities
from .sequences import Sequences


def _rescaled(column: str, low: float, high: float, groups: tuple[str, ...] = ()):
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    least, most = F.min(column).over(w), F.max(column).over(w)
    return F.when(most == least, F.lit((low + high) / 2)).otherwise(low + (F.col(column) - least) / (most - least) * (high - low))


def network(model: Model, minimum: float = 0.0, loops: bool = True, cut: float | None = None, widths: tuple[float, float] = (0.5, 5.0), alphas: tuple[float, float] = (0.2, 1.0)) -> DataFrame:
    """Edges to draw: weight, width, alpha (lower below `cut`) and whether the edge back is drawn too."""
    edges = model.weights.where((F.col("weight") > 0) & (F.col("weight") >= minimum))
    if not loops:
        edges = edges.where("from_state <> to_state")
    g = list(model.groups)
    back = edges.select(*g, F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"), F.lit(True).alias("bidirectional"))
    out = edges.join(back, [*g, "from_state", "to_state"], "left").withColumn("bidirectional", F.coalesce("bidirectional", F.lit(False)) & (F.col("from_state") != F.col("to_state")))
    out = out.withColumn("width", _rescaled("weight", *widths, model.groups)).withColumn("alpha", _rescaled("weight", *alphas, model.groups))
    return out if cut is None else out.withColumn("alpha", F.when(F.col("weight") < cut, F.lit(alphas[0])).otherwise(F.col("alpha")))


def node_sizes(model: Model, by: str, sizes: tuple[float, float] = (800.0, 3000.0)) -> DataFrame:
    """groups, state, size: nodes as large as a centrality says, its least and largest values being the ends of `sizes`. A
    measure that doesn't vary gives all of them the middle."""
    values = centralities(model, [by])
    w = Window.partitionBy(*model.groups) if model.groups else Window.partitionBy(F.lit(0))  # states of a model: few
    low, high = F.min("value").over(w), F.max("value").over(w)
    share = F.when(high > low, (F.col("value") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.5))
    return values.select(*model.groups, "state", (sizes[0] + share * (sizes[1] - sizes[0])).alias("size"))


def circular(model: Model, radius: float = 1.0) -> DataFrame:
    """state, x, y: states in order around a circle, from the top."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1  # states of a model: few
    count = F.count("*").over(Window.partitionBy(F.lit(0)))
    angle = F.lit(math.pi / 2) - F.lit(2 * math.pi) * place / count
    return model.labels.select(F.col("label").alias("state"), (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def centrality_bars(values: DataFrame, normalize: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    """Long centralities with their rank in each measure; here a constant measure stays as it is when normalised."""
    w = Window.partitionBy(*groups, "measure")
    if normalize:
        low, high = F.min("value").over(w), F.max("value").over(w)
        values = values.withColumn("value", F.when(high == low, F.col("value")).otherwise((F.col("value") - low) / (high - low)))
    return values.withColumn("place", F.row_number().over(w.orderBy(F.col("value").desc(), "state")))


def heatmap(model: Model, labels: list[str] | None = None) -> DataFrame:
    return model.to_dataframe(labels)


def difference(a: Model, b: Model, least: float = 1e-12) -> DataFrame:
    """Edges that differ, their weights, the difference and its sign."""
    met = a.weights.select("from_state", "to_state", F.col("weight").alias("a")).join(b.weights.select("from_state", "to_state", F.col("weight").alias("b")), ["from_state", "to_state"], "full")
    met = met.select("from_state", "to_state", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).withColumn("diff", F.col("a") - F.col("b"))
    return met.where(F.abs("diff") > least).withColumn("sign", F.signum("diff").cast("int"))


def init_difference(a: Model, b: Model) -> DataFrame:
    met = a.inits.select("state", F.col("prob").alias("a")).join(b.inits.select("state", F.col("prob").alias("b")), "state", "full")
    return met.select("state", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("diff"))


def correlation(a: Model, b: Model) -> DataFrame:
    """One row: Pearson's r of the weights of two models over the same states."""
    met = a.weights.select("from_state", "to_state", F.col("weight").alias("a")).join(b.weights.select("from_state", "to_state", F.col("weight").alias("b")), ["from_state", "to_state"])
    return met.agg(F.corr("a", "b").alias("r"))


def sequence_index(seqs: Sequences, limit: int | None = None) -> DataFrame:
    """keys, raw_pos and the state's number from 0, by label; of the first `limit` sequences by key, if it is given."""
    code = seqs.labels().select(F.col("label").alias("state"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1).alias("code"))
    frame = seqs.frame
    if limit is not None:
        frame = frame.join(frame.select(*seqs.keys).distinct().orderBy(*seqs.keys).limit(limit), list(seqs.keys), "left_semi")
    return frame.join(code, "state", "left").select(*seqs.keys, "raw_pos", "code")


def sequence_distribution(seqs: Sequences) -> DataFrame:
    """raw_pos, state and its share of the states that are there at that place."""
    n = seqs.present().groupBy(*seqs.groups, "raw_pos", "state").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*seqs.groups, "raw_pos")))


def frequencies(model: Model) -> DataFrame:
    """Initial probabilities, the largest first."""
    return model.inits.orderBy(F.col("prob").desc(), "state")


def histogram(rows: DataFrame, column: str = "weight", bins: int = 20, positive: bool = True) -> DataFrame:
    """bin (from 0), low, high and n of equal bins from the least to the largest value, which the last bin holds too."""
    if positive:
        rows = rows.where(F.col(column) > 0)
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)))
    counted = rows.crossJoin(F.broadcast(ends)).withColumn("bin", at.cast("int")).groupBy("bin").agg(F.count("*").alias("n"))  # ends: one row
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    out = every.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def mosaic(cells: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """A table's tiles: width of its columns, height within them, and adjusted standardised residuals, 0 where undefined."""
    by = lambda *c: F.sum(n).over(Window.partitionBy(*c) if c else Window.partitionBy(F.lit(0)))
    met = cells.withColumn("r", by(row)).withColumn("c", by(column)).withColumn("t", by())
    expected = F.col("r") * F.col("c") / F.col("t")
    spread = F.sqrt(expected * (1 - F.col("r") / F.col("t")) * (1 - F.col("c") / F.col("t")))
    residual = F.when((F.col("t") == 0) | (spread == 0) | spread.isNull(), F.lit(0.0)).otherwise((F.col(n) - expected) / spread)
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    return met.select(row, column, F.col(n).alias("n"), share("c", "t").alias("width"), share(n, "c").alias("height"), residual.alias("residual"))


def community_nodes(found: DataFrame, inits: DataFrame) -> DataFrame:
    return found.join(inits, "state")


def bootstrap_grid(result: DataFrame) -> DataFrame:
    """Weights, widths of intervals, and significance: 1, 0, or a half where there is no edge."""
    mark = F.when(F.col("weight") == 0, F.lit(0.5)).otherwise(F.col("sig").cast("double"))
    return result.select("from_state", "to_state", "weight", (F.col("ci_upper") - F.col("ci_lower")).alias("ci_width"), mark.alias("significance"))


def network_ci(result: DataFrame, by: str = "significance") -> DataFrame:
    """Edges with alpha by significance, or lower the wider their interval is."""
    rows = result.where("weight > 0").withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))
    alpha = F.when(F.col("sig"), F.lit(1.0)).otherwise(F.lit(0.3)) if by == "significance" else 1.2 - _rescaled("ci_width", 0.2, 1.0)
    return rows.select("from_state", "to_state", "weight", "ci_width", alpha.alias("alpha"))


def permutation_histogram(edges: DataFrame, bins: int = 20, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    return histogram(edges, "p_value", bins, positive=False), edges.agg(F.avg(F.when(F.col("p_value") < level, 1.0).otherwise(0.0)).alias("share"))


def stability_lines(correlations: DataFrame) -> DataFrame:
    """Mean correlation by measure and dropped share, undefined ones aside."""
    return correlations.where(~F.isnan("corr")).groupBy("measure", "prop").agg(F.avg("corr").alias("mean_corr"))
