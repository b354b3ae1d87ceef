"""Language ID by hyperdimensional profiles: letters bound into n-grams, bundled, and compared with prototypes by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold_of, hash_share, held, mapped, table, with_text

DIM, GRAM, SEED = 1024, 3, 9
#: Bits of a code point: n-grams are numbered by their letters' code points side by side, so no two share a number.
POINT = 21
#: Training documents of a language, about: a documented bound; which ones depends on their ids alone.
PER_LANGUAGE = 4000
#: Sharpness of the score: how fast it falls as another prototype comes as near.
SHARP = 40.0
#: Vectors of n-grams, and of letters, that a Python worker keeps.
KNOWN, LETTERS = 1 << 15, 1 << 13


class Space:
    """Random letter vectors of +1 and -1, each drawn from its code point; a letter's place in an n-gram turns its vector round."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        if gram * POINT > 63:
            raise ValueError("n-grams of more than 3 letters have no number")
        self.dim, self.gram, self.seed = dim, gram, seed
        self.code = np.zeros(0x110000, np.int64)
        found = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        self.code[found] = found
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.known = np.empty((KNOWN, dim), np.int8)

    def letter(self, point: int) -> np.ndarray:
        """The vector of a code point; that of the space between words is 0's."""
        found = self.letters.get(point)
        if found is None:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            found = self.letters[point] = np.random.default_rng((self.seed, point)).integers(0, 2, self.dim, np.int8) * np.int8(2) - np.int8(1)
        return found

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The distinct n-grams of letters and single spaces of a whole text, as numbers, and how often each comes; None without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        if not code.any():
            return None
        code = np.r_[0, code, 0]
        code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
        if len(code) < self.gram:
            return None
        joined = np.zeros(len(code) - self.gram + 1, np.int64)
        for k in range(self.gram):
            joined = (joined << POINT) | code[k : k + len(joined)]
        return np.unique(joined, return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Places, in `known`, of the vectors of n-grams: the product of its letters' turned vectors."""
        rows = self.rows
        if len(rows) + len(grams) > KNOWN:
            rows.clear()
        new = [g for g in grams.tolist() if g not in rows]
        if new:
            at = len(rows)
            g, product = np.array(new), np.ones((len(new), self.dim), np.int8)
            for k in reversed(range(self.gram)):
                points, which = np.unique(g & ((1 << POINT) - 1), return_inverse=True)
                product *= np.stack([np.roll(self.letter(p), self.gram - 1 - k) for p in points.tolist()])[which]
                g >>= POINT
            self.known[at : at + len(new)] = product
            rows.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(rows.__getitem__, grams.tolist()), np.int64, len(grams))

    def profile(self, text: str | None) -> np.ndarray | None:
        """The bundle: the sum of the vectors of all n-grams of a text."""
        found = self.grams(text) if text else None
        if found is None:
            return None
        out = np.zeros(self.dim, np.float32)
        for k in range(0, len(found[0]), 1 << 10):
            grams, counts = found[0][k : k + (1 << 10)], found[1][k : k + (1 << 10)]
            out += counts.astype(np.float32) @ self.known[self.vectors(grams)].astype(np.float32)
        return out


def _space(*key) -> Space:
    return held(("space", *key), lambda: Space(*key))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language: the sums of the unit profiles of its documents.

    Rows without lang or text don't count. Of a language of more than per_language documents a share is taken by the
    ids' hash, so a hot language costs no more than others, and no text is shuffled. Partitions are summed before Spark
    adds them up; the driver gets one count and one vector a language, which is the model.
    """
    good = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in good.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])[F.col("lang")]
    taken = good.where(hash_share(F.col("doc_id"), F.lit(seed)) < share).select("lang", "text")

    def run(batches):
        space, sums = _space(dim, gram, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                profile = space.profile(text.as_py())
                if profile is not None and (size := np.linalg.norm(profile)):
                    sums[lang] = sums.get(lang, 0) + np.round(profile / size * 1e6).astype(np.int64)
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([x.tolist()], pa.list_(pa.int64()))], ["lang", "x"])

    parts = taken.mapInArrow(run, "lang string, x array<long>").select("lang", F.posexplode("x").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    sums = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x")).collect()
    found = {r.lang: np.array([p.v for p in r.x], np.float64) for r in sums}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, gram: int = GRAM, seed: int = SEED, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score, its share among the prototypes by cosine (0 to 1); columns of these names are replaced.

    A null text, or one without a letter, is `und` with score 0, as is everything where nothing was learned. Whole
    texts count, long ones in pieces. Ties go to the language that sorts first. Other columns pass.
    """
    names, columns = list(prototypes), docs.drop(*into).columns
    rows, at = with_text(docs.drop(*into), docs["text"])
    width = len(columns)
    models = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, dim))
    schema = rows.select(*map(column, columns), F.lit("").alias(into[0]), F.lit(0.0).alias(into[1])).schema
    columns = schema.names

    def run(batches):
        space = _space(dim, gram, seed)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs, scores = [], []
                for x in part.columns[at]:
                    profile = space.profile(x.as_py())
                    size = 0 if profile is None else np.linalg.norm(profile)
                    if not size or not names:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    cosine = models @ (profile / size)
                    best = int(cosine.argmax())
                    langs.append(names[best])
                    scores.append(float(1 / np.exp(SHARP * (cosine - cosine[best])).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], columns)

    return mapped(rows, run, schema)


def in_training(doc_id):
    return fold_of(doc_id, 3) != 1


def op9_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the other folds: a null doc_id is fold 0;
    repeated rows and equal texts get equal predictions."""
    docs = table(spark, sf_dir, "documents")
    prototypes = train(docs.where(in_training(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text", (~in_training(F.col("doc_id"))).alias("held_out")), prototypes)
    return found.drop("text")
