"""Quality classifier: a sparse rule ensemble (RuleFit) over statistics of texts, as Spark column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold_of, fresh, hash_share, mapped, table

#: Labelled rows that the rules are fitted on, about: a documented bound; which ones depends on their ids alone.
SAMPLE = 12_000
TREES, DEPTH, CUTS = 24, 3, 32
#: Strength of the lasso, a share of the weight that would leave no rule.
LASSO = 0.01


STATISTICS = ("log_words", "word_length", "distinct_words", "upper", "lower", "digits", "stops", "calls", "pipes", "symbols", "brackets", "wide", "log_lines", "distinct_lines", "line_words", "line_ends")
#: The bytes whose shares are statistics, by name.
BYTES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "stops": b".,;:", "calls": b"!?", "pipes": b"|", "symbols": b"#$%&*+<=>@[]\\^_`{}~/", "brackets": b"()'\"-", "wide": bytes(range(128, 256))}
_KINDS = np.array([[b in chars for b in range(256)] for chars in BYTES.values()], np.float64).T


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; all are 0 for a null or empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    upper, lower, digits, stops, calls, pipes, symbols, brackets, wide = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS
    words, lines, n = text.split(), text.split("\n"), len(data)
    w = max(len(words), 1)
    ends = sum(x.endswith((".", "!", "?")) for x in lines)
    return [
        math.log1p(len(words)), sum(map(len, words)) / w, len(set(words)) / w, upper / n, lower / n, digits / n, stops / w, calls / w, pipes / w, symbols / w, brackets / w, wide / n,
        math.log1p(len(lines)), len(set(lines)) / len(lines), len(words) / len(lines), ends / len(lines),
    ]


def with_statistics(docs: DataFrame, *keep: str, prefix: str = "") -> DataFrame:
    """The columns to keep and the statistics of every row, each computed once, however many rules use it."""
    names = [f"{prefix}{k}" for k in STATISTICS]
    listed = [*map(column, keep)] + ([] if "text" in map(str.lower, keep) else [F.col("text")])
    rows, at, width = docs.select(*listed), [c.lower() for c in (*keep, "text")].index("text"), len(keep)
    schema = docs.select(*map(column, keep), *[F.lit(0.0).alias(k) for k in names]).schema
    columns = schema.names

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = np.array([statistics(t.as_py()) for t in part.columns[at]], np.float64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *map(pa.array, found.T)], columns)

    return mapped(rows, run, schema)


def features(docs: DataFrame) -> DataFrame:
    return with_statistics(docs, "doc_id")


def _tree(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """Grows a regression tree on the gradients, adds the paths to its nodes to out, and returns its values."""
    value = np.zeros(len(x))
    total_g, total_h = g[rows].sum(), h[rows].sum()
    value[rows] = total_g / (total_h + 1)
    if not depth or len(rows) < 20:
        return value
    best = (1e-6, None)
    for f, cuts in enumerate(bins):
        if not len(cuts):
            continue
        c = codes[rows, f]
        gs, hs = (np.bincount(c, w[rows], len(cuts) + 1).cumsum()[:-1] for w in (g, h))
        ns = np.bincount(c, minlength=len(cuts) + 1).cumsum()[:-1]
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(ns < 10) | (ns > len(rows) - 10)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (f, k))
    if best[1] is None:
        return value
    f, k = best[1]
    low = codes[rows, f] <= k
    for part, side in ((rows[low], True), (rows[~low], False)):
        longer = (*path, (f, float(bins[f][k]), side))
        out.append(longer)
        value[part] = _tree(x, bins, codes, g, h, part, depth - 1, longer, out)[part]
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 10) -> list[tuple]:
    """Conjunctions (feature, cut, at or below it?) on the paths of boosted trees, without repeats."""
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(bins)], 1)
    score, found = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows, paths = np.flatnonzero(rng.random(len(y)) < 0.5), []
        if len(rows):
            _tree(x, bins, codes, y - p, p * (1 - p), rows, depth, (), paths)
        for path in paths:
            found.setdefault(tuple(sorted(path)))
        # values are fitted on the rows drawn and applied to all through the leaves' rules
        leaves = [r for r in paths if not any(q[: len(r)] == r and len(q) > len(r) for q in paths)]
        for leaf in leaves:
            at = applies(leaf, x)
            own = at & np.isin(np.arange(len(y)), rows)
            score[at] += 0.3 * (y - p)[own].sum() / ((p * (1 - p))[own].sum() + 1)
    return list(found)


def applies(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, cut, low in rule:
        out &= (x[:, f] <= cut) == low
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, share: float = LASSO, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n = max(len(y), 1)
    mean = y.mean() if len(y) else 0.5
    strength = share * np.abs(z.T @ (y - mean)).max(initial=0) / n
    step = 4 * n / max(np.linalg.eigvalsh(z.T @ z)[-1] if z.size else 1, n) / 1.05
    w, b = np.zeros(z.shape[1]), float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    v, vb, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        w2 = v - step * (z.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * strength, 0)
        b2 = vb - r.sum() / n
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 10) -> dict:
    """The model: names of the statistics, rules, weights and intercept.

    Rows without a label don't count, nor do labels other than 0 and 1. Of more labelled rows than `sample`, a share is
    taken by the ids' hash; the driver gets their statistics alone. No text is shuffled. One
    label alone, or none, gives a constant score.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    count = known.count()
    taken = F.broadcast(known.where(hash_share(F.col("doc_id"), F.lit(seed)) < sample / max(count, 1)))  # of `sample` rows, about
    rows = features(docs.join(taken, "doc_id", "left_semi")).join(taken, "doc_id").toPandas().sort_values("doc_id", kind="stable")
    names = [c for c in rows.columns if c not in ("doc_id", "y")]
    x, y = rows[names].to_numpy(np.float64), rows["y"].to_numpy(np.float64)
    rules = tree_rules(x, y, seed=seed) if 0 < y.sum() < len(y) else []
    z = np.stack([applies(r, x) for r in rules], 1) if rules else np.zeros((len(y), 0), bool)
    _, first = np.unique(np.packbits(z, axis=0), axis=1, return_index=True)  # of rules that hold for the same rows, the first
    rules, z = [rules[k] for k in sorted(first)], z[:, sorted(first)].astype(np.float64)
    w, b = lasso_logistic(z, y)
    return {"names": names, "rules": [r for r, v in zip(rules, w) if v], "weights": [float(v) for v in w if v], "intercept": b}


def compiled(model: dict) -> Column:
    """The model as an expression over the statistics' columns."""
    terms = []
    for rule, weight in zip(model["rules"], model["weights"]):
        parts = [F.col(model["names"][f]) <= cut if low else F.col(model["names"][f]) > cut for f, cut, low in rule]
        terms.append(F.when(reduce(lambda a, b: a & b, parts), F.lit(weight)).otherwise(F.lit(0.0)))
    total = reduce(lambda a, b: a + b, terms, F.lit(model["intercept"]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row; a null text scores as an empty one, very long ones are read whole.

    Equal texts get equal scores; repeated rows and null ids come back as often as they are there. Other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    scored = features(docs).select("doc_id", compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def in_training(doc_id):
    return fold_of(doc_id, 3) != 1


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that the model doesn't reject, all their columns, whatever their names: statistics get a prefix
    that no column has. Nulls and empty texts are scored like others; of repeated rows all stay or none. An empty table
    gives an empty result.
    """
    prefix = fresh([c[: len(c) - len(k)] for c in docs.columns for k in STATISTICS if c.lower().endswith(k)], "__")
    renamed = model | {"names": [f"{prefix}{k}" for k in model["names"]]}
    return with_statistics(docs, *docs.columns, prefix=prefix).where(compiled(renamed) >= 0.5).select(*map(column, docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels of the other folds; a null doc_id is
    fold 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(in_training(F.col("doc_id"))))
    return score(docs, model).select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")
