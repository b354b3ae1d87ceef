"""Patterns of consecutive states, compared between groups of sequences."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.stats import p_adjust
from .replicates import chunks, permuted, placed, summed
from .sequences import Sequences
from .shared import ranks, written


def occurrences(seqs: Sequences, sub: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """keys, length and pattern of every run of consecutive raw places without a hole; one window serves all lengths."""
    w = seqs.window()
    longest = max(sub)
    ahead = [F.col("state")] + [F.when(F.lead("raw_pos", d).over(w) == F.col("raw_pos") + d, F.lead("state", d).over(w)) for d in range(1, longest)]
    rows = seqs.frame.select(*seqs.keys, F.array(*ahead).alias("ahead"))
    runs = F.array(*[F.struct(F.lit(k).alias("length"), F.when(~F.exists(F.slice("ahead", 1, k), lambda x: x.isNull()), F.array_join(F.slice("ahead", 1, k), "->")).alias("pattern")) for k in sub])
    return rows.select(*seqs.keys, F.inline(runs)).where("pattern is not null")


def _counted(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy("length", "pattern", group).agg(F.sum("n").alias("n"))


def statistic(freqs: DataFrame, group: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per pattern the root of the summed squares of observed less expected frequencies, expected from the margins of the
    patterns of all lengths. Groups in which a pattern never comes count with an observed frequency of 0, row or no row."""
    rows = freqs.withColumn("of_pattern", F.sum("n").over(Window.partitionBy(*keys, "length", "pattern")))
    return _statistic(rows, freqs.groupBy(*keys, group).agg(F.sum("n").alias("of_group")), group, keys)


def _statistic(rows: DataFrame, of_group: DataFrame, group: str, keys: tuple[str, ...]) -> DataFrame:
    """statistic() of frequencies that have of_pattern beside them. Where a pattern has no row for a group, its square is
    that of what is expected: those come from the squared totals of all groups less those of the groups with a row."""
    square = F.col("of_group") * F.col("of_group")
    whole = of_group.groupBy(*keys).agg(F.sum("of_group").alias("of_all"), F.sum(square).alias("squares"))
    totals = of_group.join(whole, list(keys)) if keys else of_group.crossJoin(F.broadcast(whole))  # one row
    share = F.col("of_pattern") / F.col("of_all")
    met = rows.join(F.broadcast(totals), [*keys, group])  # replicates times groups
    off = F.sum(F.pow(F.col("n") - share * F.col("of_group"), F.lit(2.0))) + F.pow(F.first(share), F.lit(2.0)) * (F.first("squares") - F.sum(square))
    return met.groupBy(*keys, "length", "pattern").agg(F.sqrt(off).alias("statistic"))


def filled(freqs: DataFrame, names: DataFrame, group: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Frequencies with a row for every group, 0 where a pattern never comes. Groups are few: their table is the small side."""
    every = freqs.select(*keys, "length", "pattern").distinct().crossJoin(names)
    return every.join(freqs, [*keys, "length", "pattern", group], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _groups(seqs: Sequences, group: str) -> int:
    """How many groups there are."""
    count = seqs.frame.agg(F.count_distinct(group)).first()[0]
    if count < 2:
        raise ValueError("patterns are compared between two groups at least")
    return count


def _runs(seqs: Sequences, group: str, longest: int) -> DataFrame:
    """group, run and n: the states from a place on, `longest` of them or as many as come before a hole, and how often.

    One window finds them and one aggregation, combined before its shuffle, leaves each different run once, so what
    comes after grows with the different runs and not with the places.
    """
    return _runs_by(seqs, longest, group)


def _runs_by(seqs: Sequences, longest: int, *by: str) -> DataFrame:
    """_runs() by any columns of the sequences."""
    w = seqs.window()
    ahead = [F.col("state")] + [F.when(F.lead("raw_pos", d).over(w) == F.col("raw_pos") + d, F.lead("state", d).over(w)) for d in range(1, longest)]
    rows = seqs.frame.select(*by, F.array(*ahead).alias("ahead"))
    hole = F.array_position(F.transform("ahead", lambda x: x.isNull()), True)
    rows = rows.select(*by, F.when(hole == 0, F.col("ahead")).otherwise(F.slice("ahead", F.lit(1), F.greatest(hole, F.lit(1)).cast("int") - 1)).alias("run"))
    return rows.where(F.size("run") > 0).groupBy(*by, "run").agg(F.count("*").alias("n"))


def _levels(runs: DataFrame, group: str, names: int, longest: int, min_freq: int):
    """For each length the counts (pattern, group, n) of its candidates, and of them the patterns that pass in every group.

    A run of k is a candidate only if the two runs of k - 1 in it passed, as no run comes more often than a part of it.
    """
    passing = None
    for k in range(1, longest + 1):
        part = lambda first, size: F.array_join(F.slice("run", first, size), "->")
        now = runs.where(F.size("run") >= k).select(group, "n", part(1, k).alias("pattern"), part(1, k - 1).alias("head"), part(2, k - 1).alias("tail"))
        for side in ("head", "tail") if k > 1 else ():
            now = now.join(passing.select(F.col("pattern").alias(side)), side, "left_semi")
        counted = written(now.groupBy("pattern", group).agg(F.sum("n").alias("n")), "pattern_counts")  # or each level would do all before it anew
        passing = counted.where(F.col("n") >= min_freq).groupBy("pattern").agg(F.count("*").alias("groups")).where(F.col("groups") == names).select("pattern")
        yield k, counted, passing


def compare(seqs: Sequences, group: str, sub: tuple[int, ...] = (1, 2, 3, 4, 5), min_freq: int = 5) -> DataFrame:
    """pattern, length, group, freq and prop of patterns that every group has at least min_freq times, by length, pattern and group.

    Proportions are within length and group and count patterns that don't pass, too: every window of so many places
    without a hole. Patterns grow a place at a time out of those that passed. Sequences of a null group don't count.
    """
    if group not in seqs.groups:
        raise TypeError("sequences must have the column as a group")
    if not sub or min(sub) < 1:
        raise ValueError("lengths of patterns start at 1")
    count, seqs = _groups(seqs, group), _grouped(seqs, group)
    if min_freq < 1:  # what never comes in a group passes as well
        names = seqs.frame.select(group).distinct()
        runs = occurrences(seqs, tuple(sub)).groupBy("length", "pattern", group).agg(F.count("*").alias("n"))
        share = F.sum("n").over(Window.partitionBy("length", group))
        rows = filled(runs, names, group).withColumn("prop", F.when(share > 0, F.col("n") / share).otherwise(F.lit(0.0)))
        return rows.select("pattern", "length", group, F.col("n").alias("freq"), "prop").orderBy("length", "pattern", group)
    runs = written(_runs(seqs, group, max(sub)), "runs")
    lengths = F.array(*[F.lit(k) for k in sorted(set(sub))])
    windows = runs.select(group, "n", F.explode(F.filter(lengths, lambda k: k <= F.size("run"))).alias("length")).groupBy("length", group).agg(F.sum("n").alias("windows"))
    parts = None
    for k, counted, passing in _levels(runs, group, count, max(sub), min_freq):
        if k in sub:
            rows = counted.join(passing, "pattern", "left_semi").withColumn("length", F.lit(k))
            parts = rows if parts is None else parts.unionByName(rows)
    met = parts.join(windows, ["length", group])
    return met.select("pattern", "length", group, F.col("n").alias("freq"), (F.col("n") / F.col("windows")).alias("prop")).orderBy("length", "pattern", group)


def _grouped(seqs: Sequences, group: str) -> Sequences:
    """Without sequences of a null group."""
    return replace(seqs, frame=seqs.frame.where(F.col(group).isNotNull()))


def permutation_test(seqs: Sequences, group: str, assignment: DataFrame, sub: tuple[int, ...] = (1, 2, 3, 4, 5), min_freq: int = 5, adjust: str = "bonferroni") -> DataFrame:
    """pattern, length, statistic, effect size, p value and adjusted p value, given shuffled groups.

    assignment: rep, the sequences' ids, and `group` for every replicate of every sequence. Runs are counted by sequence
    once; a replicate adds those counts up by its groups. Adjustment is within a length, over all patterns. Sequences of a
    null group, in the data or in a replicate, don't count.
    """
    count, seqs = _groups(seqs, group), _grouped(seqs, group)
    runs, parts, freqs = _runs_by_sequence(seqs, group, sub)
    shuffled = runs.drop(group).join(assignment.where(F.col(group).isNotNull()), list(seqs.ids)).groupBy("rep", "run_id", group).agg(F.sum("n").alias("n"))
    return _tested(freqs, _of_patterns(shuffled, parts, "rep", group), count, group, min_freq, adjust)


def _runs_by_sequence(seqs: Sequences, group: str, sub: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by sequence of the runs that _runs() takes, by the number of the run; the patterns that each of these begins with
    (run_id, length, pattern, of_pattern); and counts of patterns by group. of_pattern is how often a pattern comes in all.

    A place is one row, however many lengths there are, and replicates add up numbers of runs: patterns are cut out of the
    different runs only, once those are counted.
    """
    own = written(_runs_by(seqs, max(sub), *seqs.keys), "runs")
    kinds = written(ranks(own, "run", "run_id"), "kinds")
    runs, lengths = own.join(kinds, "run").drop("run"), F.array(*[F.lit(k) for k in sorted(set(sub))])
    parts = kinds.select("run_id", "run", F.explode(F.filter(lengths, lambda k: k <= F.size("run"))).alias("length"))
    parts = written(parts.select("run_id", "length", F.array_join(F.slice("run", F.lit(1), F.col("length")), "->").alias("pattern")), "parts")
    freqs = written(_counted(runs.groupBy("run_id", group).agg(F.sum("n").alias("n")).join(parts, "run_id"), group), "freqs")
    whole = freqs.groupBy("length", "pattern").agg(F.sum("n").alias("of_pattern"))
    return runs, parts.join(whole, ["length", "pattern"]), freqs.join(whole, ["length", "pattern"])


def _of_patterns(counted: DataFrame, parts: DataFrame, *by: str) -> DataFrame:
    """Counts of runs (by, run_id, n) as those of the patterns that they begin with."""
    return counted.join(parts, "run_id").groupBy(*by, "length", "pattern", "of_pattern").agg(F.sum("n").alias("n"))


def _tested(freqs: DataFrame, shuffled: DataFrame, names: int, group: str, min_freq: int, adjust: str) -> DataFrame:
    of_group = lambda rows, *keys: rows.groupBy(*keys, group).agg(F.sum("n").alias("of_group"))
    real = _statistic(freqs, of_group(freqs), group, ())
    shuffled = written(shuffled, "shuffled")
    again = _statistic(shuffled, of_group(shuffled, "rep"), group, ("rep",)).withColumnRenamed("statistic", "s")
    met = again.join(real, ["length", "pattern"])
    sd = F.stddev_pop("s")
    tested = met.groupBy("length", "pattern", "statistic").agg(
        F.when(sd > 0, (F.first("statistic") - F.avg("s")) / sd).otherwise(F.lit(0.0)).alias("effect_size"),
        ((F.sum(F.when(F.col("s") >= F.col("statistic"), 1).otherwise(0)) + 1) / (F.count("*") + 1)).alias("p_value"),
    )
    tested = p_adjust(tested, "p_value", adjust, ("length",))
    if min_freq < 1:
        return tested
    passing = freqs.where(F.col("n") >= min_freq).groupBy("length", "pattern").agg(F.count("*").alias("groups"))
    return tested.join(passing.where(F.col("groups") == names), ["length", "pattern"], "left_semi")


def permuted_patterns(seqs: Sequences, group: str, iterations: int = 1000, sub: tuple[int, ...] = (1, 2, 3, 4, 5), min_freq: int = 5, adjust: str = "bonferroni", seed: int = 0) -> DataFrame:
    """permutation_test() in one call, by adjusted p value, length and pattern: a replicate deals the groups out anew, each to
    as many sequences as it has, for any number of sequences."""
    seqs = _grouped(seqs, group)
    each = written(seqs.frame.select(*seqs.keys).distinct(), "sequences")
    sizes = [(r[group], r.n) for r in each.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()]  # groups are few
    if len(sizes) < 2:
        raise ValueError("patterns are compared between two groups at least")
    ends, chunked = np.cumsum([n for _, n in sizes]), chunks(iterations)

    def dealt(start, total, first, size):
        for reps in chunked:
            side = np.searchsorted(ends, permuted(np.arange(first, first + size), total, reps, seed), side="right")
            for label in range(len(sizes)):
                yield label, reps.start, side == label

    runs, parts, freqs = _runs_by_sequence(seqs, group, sub)
    counted = written(summed(placed(runs, each, seqs.keys), (), ("run_id",), dealt), "counted")
    shuffled = _of_patterns(counted, parts, "label", "rep")
    kind = each.schema[group].dataType
    names = each.sparkSession.createDataFrame([(k, g) for k, (g, _) in enumerate(sizes)], StructType([StructField("label", IntegerType()), StructField(group, kind)]))
    shuffled = shuffled.join(F.broadcast(names), "label").select("rep", "length", "pattern", "of_pattern", group, "n")
    return _tested(freqs, shuffled, len(sizes), group, min_freq, adjust).orderBy("p_adjusted", "length", "pattern")
