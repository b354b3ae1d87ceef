"""Adjusted p-values and confidence intervals."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METHODS = ("none", "bonferroni", "holm", "fdr", "BH")


def p_adjust(rows: DataFrame, p: str = "p_value", method: str = "bonferroni", keys: tuple[str, ...] = (), into: str = "p_adjusted") -> DataFrame:
    """rows with adjusted p-values, over each of the keys. Null p-values stay null and don't count.

    Equal p-values are adjusted alike, so the ranks are over different ones: of a test of k replicates k + 1 at most,
    however many rows there are. No key may be null.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(METHODS)}")
    x = F.col(p)
    if method == "none":
        return rows.withColumn(into, x)
    known = rows.where(x.isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("__ties"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n, up = F.sum("__ties").over(whole), whole.orderBy(p)
    last = F.sum("__ties").over(up.rowsBetween(Window.unboundedPreceding, 0))
    if method == "bonferroni":
        adjusted = F.least(x * n, F.lit(1.0))
    elif method == "holm":
        known = known.withColumn("__step", x * (n - last + F.col("__ties")))
        adjusted = F.least(F.max("__step").over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    else:
        known = known.withColumn("__step", x * n / last)
        adjusted = F.least(F.min("__step").over(up.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))
    known = known.select(*keys, p, adjusted.alias(into))
    return rows.join(known, [*keys, p], "left").select(*rows.columns, into)


def confidence_interval(rows: DataFrame, value: str, keys: tuple[str, ...] = (), level: float = 0.05, method: str = "percentile") -> DataFrame:
    """keys, ci_lower, ci_upper from bootstrap values: percentiles, or those turned about the bootstrap mean."""
    low, high = F.percentile(value, F.lit(level / 2)), F.percentile(value, F.lit(1 - level / 2))
    if method == "percentile":
        ends = (low, high)
    elif method == "basic":
        ends = (2 * F.avg(value) - high, 2 * F.avg(value) - low)
    else:
        raise ValueError(f"unknown method {method!r}; known are percentile, basic")
    return rows.groupBy(*keys).agg(ends[0].alias("ci_lower"), ends[1].alias("ci_upper"))


def bca_ci(data: np.ndarray, statistic: Callable[[np.ndarray], float], n_boot: int = 1000, level: float = 0.05, seed: int | None = None) -> tuple[float, float]:
    """Bias-corrected and accelerated interval of a statistic of rows that fit the driver."""
    rng, n = np.random.default_rng(seed), len(data)
    observed = statistic(data)
    boot = np.array([statistic(data[rng.choice(n, n, replace=True)]) for _ in range(n_boot)])
    left_out = np.array([statistic(np.delete(data, k, 0)) for k in range(n)])
    off = left_out.mean() - left_out
    spread = 6 * (off**2).sum() ** 1.5
    return bca_ends(boot, float((boot < observed).mean()), float((off**3).sum() / spread) if spread else 0.0, level)[1:]


def bca_ends(boot: np.ndarray, below: float, acceleration: float, level: float = 0.05) -> tuple[float, float, float]:
    """The bias correction and the two ends, from replicates, the share of them below what was observed, and the acceleration."""
    normal, n = NormalDist(), len(boot)
    z0, ends = normal.inv_cdf(min(max(below, 1 / (n + 1)), n / (n + 1))), []
    for q in (level / 2, 1 - level / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(boot, normal.cdf(z0 + z / (1 - acceleration * z)))))
    return z0, ends[0], ends[1]
