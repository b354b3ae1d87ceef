"""Transition counts: every model type as joins, windows and aggregations over sequences in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import Sequences

TYPES = ("relative", "frequency", "co-occurrence", "reverse", "n-gram", "gap", "window", "attention")
#: States that attention has a running sum each for in one window.
WIDE = 64
NORMALISED = ("relative", "reverse", "n-gram", "gap", "window")


def _summed(pairs: DataFrame, groups: tuple[str, ...], n) -> DataFrame:
    return pairs.groupBy(*groups, "from_state", "to_state").agg(n.cast("double").alias("n"))


def lagged(seqs: Sequences, distances: range | list[int], weight=lambda d: 1.0) -> DataFrame:
    """Pairs of states d places apart among the states that are there, each with a weight; one window serves all distances."""
    w = seqs.window()
    ahead = F.array(*[F.struct(F.lead("state", d).over(w).alias("to_state"), F.lit(float(weight(d))).alias("weight")) for d in distances])
    pairs = seqs.present().select(*seqs.groups, F.col("state").alias("from_state"), ahead.alias("ahead")).select(*seqs.groups, "from_state", F.inline("ahead"))
    return _summed(pairs.where("to_state is not null"), seqs.groups, F.sum("weight"))


def adjacent(seqs: Sequences) -> DataFrame:
    pairs = seqs.present().select(*seqs.groups, F.col("state").alias("from_state"), F.lead("state").over(seqs.window()).alias("to_state"))
    return _summed(pairs.where("to_state is not null"), seqs.groups, F.count("*"))


def reverse(seqs: Sequences) -> DataFrame:
    """Adjacent counts, the other way round."""
    return adjacent(seqs).select(*seqs.groups, F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"), "n")


def _same(counts: DataFrame, keys: tuple[str, ...], own) -> DataFrame:
    """All pairs of states of a sequence or block from its counts of states: as many rows as states squared, not places squared."""
    left = counts.select(*keys, F.col("state").alias("from_state"), F.col("c").alias("a"))
    right = counts.select(*keys, F.col("state").alias("to_state"), F.col("c").alias("b"))
    return left.join(right, list(keys)).withColumn("n", F.when(F.col("from_state") == F.col("to_state"), own).otherwise(F.col("a") * F.col("b")))


def co_occurrence(seqs: Sequences) -> DataFrame:
    """Pairs of places of a sequence, in both directions; of equal states once."""
    counts = seqs.present().groupBy(*seqs.keys, "state").agg(F.count("*").cast("double").alias("c"))
    return _summed(_same(counts, seqs.keys, F.col("a") * (F.col("a") - 1) / 2), seqs.groups, F.sum("n")).where("n > 0")


def blocks_of(seqs: Sequences, window_size: int = 1, window_span: int = 1) -> DataFrame:
    """The states that are there, each with its block of window_size * window_span raw places."""
    return seqs.present().withColumn("block", F.floor(F.col("raw_pos") / (window_size * window_span)))


def co_occurrence_windowed(seqs: Sequences, window_size: int = 1, window_span: int = 1) -> DataFrame:
    """Ordered pairs of places, each with itself too, within blocks of window_size * window_span raw places."""
    rows, keys = blocks_of(seqs, window_size, window_span), (*seqs.keys, "block")
    counts = rows.groupBy(*keys, "state").agg(F.count("*").cast("double").alias("c"))
    return _summed(_same(counts, keys, F.col("a") * F.col("a")), seqs.groups, F.sum("n"))


def windowed(seqs: Sequences, size: int = 3) -> DataFrame:
    """Pairs within sliding windows of `size` places, once for each window that holds both.

    Places p and p + d of a sequence of L states share min(p, L - size) - max(0, p + d - size + 1) + 1 windows.
    """
    w = seqs.window()
    ahead = F.array(*[F.struct(F.lit(d).alias("d"), F.lead("state", d).over(w).alias("to_state")) for d in range(1, size)])
    length = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = seqs.present().select(*seqs.groups, F.col("state").alias("from_state"), (F.row_number().over(w) - 1).alias("p"), length.alias("length"), ahead.alias("ahead"))
    pairs = rows.where(F.col("length") >= size).select(*seqs.groups, "from_state", "p", "length", F.inline("ahead")).where("to_state is not null")
    times = F.least("p", F.col("length") - size) - F.greatest(F.lit(0), F.col("p") + F.col("d") - size + 1) + 1
    return _summed(pairs.withColumn("times", times).where("times > 0"), seqs.groups, F.sum("times"))


def attention(seqs: Sequences, beta: float = 1.0) -> DataFrame:
    """All pairs of places p < q, each with weight exp(-beta (q - p)).

    What earlier places of a state still weigh at a place is a running sum of exp(beta p), faded by exp(-beta q). Sums start
    anew every `span` places, before they could overflow. A block begins with the places of the one before it, as far as
    the sequence goes on; those before that weigh less than exp(-600). Up to WIDE states have a sum each in one window,
    which takes the states to be read first; beyond, every place is set beside the states of its block, and one sum runs
    through the places of each, so that the plan is the same for any number of states.
    """
    states = sorted(r.label for r in seqs.labels().limit(WIDE + 1).collect())
    w = seqs.window()
    rows = seqs.present().select(*seqs.keys, "state", (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("length"))
    if beta > 0:
        span = max(1, int(600 / beta))
        block = F.floor(F.col("pos") / span).cast("long")
        at = (F.col("pos") - block * span).cast("long")
        own = F.struct(block.alias("block"), at.alias("at"), F.lit(True).alias("here"))
        again = F.struct((block + 1).alias("block"), (at - span).alias("at"), F.lit(False).alias("here"))
        rows = rows.select(*seqs.keys, "state", F.inline(F.when(F.col("length") > (block + 1) * span, F.array(own, again)).otherwise(F.array(own))))
    else:
        rows = rows.select(*seqs.keys, "state", F.lit(0).cast("long").alias("block"), F.col("pos").cast("long").alias("at"), F.lit(True).alias("here"))
    weight, fade = F.exp(F.lit(float(beta)) * F.col("at")), F.exp(F.lit(-float(beta)) * F.col("at"))
    if len(states) > WIDE:
        there = F.collect_set("state").over(Window.partitionBy(*seqs.keys, "block"))
        beside = rows.withColumn("there", there).select(*seqs.keys, "block", "at", "here", F.col("state").alias("to_state"), F.explode("there").alias("from_state"))
        before = Window.partitionBy(*seqs.keys, "block", "from_state").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        held = F.sum(F.when(F.col("to_state") == F.col("from_state"), weight)).over(before)
        pairs = beside.select(*seqs.groups, "from_state", "to_state", "here", fade.alias("fade"), held.alias("held")).where("here and held is not null")
        return _summed(pairs, seqs.groups, F.sum(F.col("held") * F.col("fade")))
    before = Window.partitionBy(*seqs.keys, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    held = F.array(*[F.struct(F.lit(s).alias("from_state"), F.sum(F.when(F.col("state") == s, weight)).over(before).alias("held")) for s in states])
    held = held if states else F.array().cast("array<struct<from_state: string, held: double>>")
    pairs = rows.select(*seqs.groups, F.col("state").alias("to_state"), fade.alias("fade"), "here", held.alias("all")).where("here")
    pairs = pairs.select(*seqs.groups, "to_state", "fade", F.inline("all")).where("held is not null")
    return _summed(pairs, seqs.groups, F.sum(F.col("held") * F.col("fade")))


def counts(seqs: Sequences, type_: str, **params) -> DataFrame:
    """groups, from_state, to_state and n of a model type; pairs that never come have no row."""
    if type_ == "co-occurrence" and params.get("windowed"):
        return co_occurrence_windowed(seqs, params.get("window_size", 1), params.get("window_span", 1))
    if type_ == "relative" or type_ == "frequency":
        return adjacent(seqs)
    if type_ == "reverse":
        return reverse(seqs)
    if type_ == "co-occurrence":
        return co_occurrence(seqs)
    if type_ == "n-gram":
        n = params.get("n", 2)
        return lagged(seqs, [n - 1]) if n > 1 else lagged(seqs, [0])
    if type_ == "gap":
        decay = params.get("decay", 0.5)
        return lagged(seqs, range(1, params.get("max_gap", 5) + 1), lambda d: decay ** (d - 1))
    if type_ == "window":
        return windowed(seqs, params.get("size", 3))
    if type_ == "attention":
        return attention(seqs, params.get("beta", 1.0))
    raise ValueError(f"unknown model type {type_!r}; known are {', '.join(TYPES)}")


def initial_counts(seqs: Sequences, type_: str, **params) -> DataFrame:
    """groups, state and n: how often each state comes first; last for a reverse model, at raw place 0 for a windowed one."""
    if type_ == "co-occurrence" and params.get("windowed"):
        ends = seqs.present().where("raw_pos = 0")
    else:
        pick = F.max_by if type_ == "reverse" else F.min_by
        ends = seqs.present().groupBy(*seqs.keys).agg(pick("state", "raw_pos").alias("state"))
    return ends.groupBy(*seqs.groups, "state").agg(F.count("*").cast("double").alias("n"))
