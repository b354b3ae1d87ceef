"""Toxicity: Levenshtein automata run over a trie of a learned lexicon, with context windows that tell quotation from abuse."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, hash_share, held, table, written

#: Labelled rows that lexicon and weights are learned from, about: a documented bound; which ones depends on their ids alone.
SAMPLE = 24_000
#: Documents and log-odds of a term of the lexicon, at least. There is no bound on terms but the sample's own words.
LEAST, ODDS = 8, 3.0
STEMS = (4, 5, 6, 7, 8)
#: Characters on either side of a term that are looked at for quotation marks.
WINDOW = 80
WORD = re.compile(r"\w{3,}")
#: Quotation marks that may open, by the mark that closes them. A straight one closes the one before it.
CLOSES = {"”": "“„", "“": "„", "»": "«", "«": "»", "›": "‹", "‹": "›", "’": "‘", "‘": "‚", '"': '"'}
OPENS = frozenset("“„«»‹›‘‚\"")
MARK = re.compile(r"[\n\"“”„«»‹›‘’‚]")
#: Automaton states that a Python worker keeps.
STATES = 100_000
FEATURES = ("exact", "stem", "one_edit", "two_edits", "quoted", "density", "any")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """The Levenshtein automata of all words at once, run over the trie of the lexicon.

    A state is the set of trie nodes that what was read of a word may stand for, each with the fewest edits to it.
    States and their transitions are made when a word first needs them; most words reach the empty state within a few
    characters. A stem is met by every word that starts with it, without edits.
    """

    def __init__(self, terms: dict[str, str]):
        self.kids: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most = [0]
        for term, kind in sorted(terms.items()):
            at, allowed = 0, edits_allowed(term) if kind == "word" else 0
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                at = self.kids[at][c]
                self.most[at] = max(self.most[at], allowed)
            (self.word if kind == "word" else self.stem)[at] = term
        self.letters = {c for k in self.kids for c in k}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.nodes: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, -1 for the empty one; characters a word may lack are added first."""
        todo = list(nodes.items())
        while todo:
            at, e = todo.pop()
            for child in self.kids[at].values():
                if e < self.most[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.nodes)
            self.nodes.append(nodes)
            self.next.append({})
            ends = [(e, self.word[n]) for n, e in nodes.items() if self.word[n] and e <= edits_allowed(self.word[n])]
            self.ends.append(min(ends)[::-1] if ends else None)
            self.stems.append(min((self.stem[n] for n, e in nodes.items() if self.stem[n] and not e), default=None))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        put = lambda n, e: out.__setitem__(n, e) if e <= self.most[n] and out.get(n, 99) > e else None
        for at, e in self.nodes[state].items():
            kids = self.kids[at]
            if c in kids:
                put(kids[c], e)
            if e < self.most[at]:
                put(at, e + 1)
                for child in kids.values():
                    put(child, e + 1)
        return self._state(out)

    def look_up(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, stem?) that a word stands for, by the fewest edits; a whole term goes before a stem."""
        if len(self.nodes) > STATES:
            self._reset()
        state, stem = 0, None
        for c in word:
            if c not in self.letters:
                c = ""
            to = self.next[state].get(c)
            if to is None:
                to = self.next[state][c] = self._step(state, c)
            if to < 0:
                return (stem, 0, True) if stem else None
            state = to
            stem = stem or self.stems[state]
        end = self.ends[state]
        if end and (not end[1] or not stem):
            return (*end, False)
        return (stem, 0, True) if stem else None


def quotations(text: str) -> list[tuple[int, int]]:
    """The places of opening and closing marks of all quotations of a text, by where they close.

    Marks are paired by kind and within a line. An apostrophe, ’ or ‘ between letters or digits, is no mark, and ’
    closes nothing where no ‘ is open. A mark that may do both opens at the start of a word, behind a space. A mark that
    opens again while open starts anew.
    """
    out, at = [], {}
    for m in MARK.finditer(text):
        mark, k = m[0], m.start()
        if mark == "\n":
            at.clear()
            continue
        if mark in "’‘" and 0 < k < len(text) - 1 and text[k - 1].isalnum() and text[k + 1].isalnum():
            continue
        own = [at[x] for x in CLOSES.get(mark, "") if x in at]
        opens = mark in OPENS and mark != '"' and text[k + 1 : k + 2].isalnum() and (not k or text[k - 1].isspace())
        if own and not opens:
            start = max(own)
            out.append((start, k))
            at = {x: p for x, p in at.items() if p < start}
        elif mark in OPENS:
            at[mark] = k
    return out


def is_quoted(marks: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a quotation opens before and closes after the place, both within the window."""
    for k in range(bisect_left(marks, end, key=itemgetter(1)), len(marks)):
        opened, closed = marks[k]
        if closed >= end + WINDOW:
            return False
        if start - WINDOW <= opened < start:
            return True
    return False


def measure(automaton: Automaton, text: str | None) -> list[float]:
    """The FEATURES of a whole text."""
    text = (text or "").lower()
    words = WORD.findall(text)
    hits = {w: hit for w in set(words) if (hit := automaton.look_up(w))}
    if not hits:
        return [0.0] * len(FEATURES)
    counts, marks = dict.fromkeys(FEATURES, 0), quotations(text)
    for m in WORD.finditer(text):
        if hit := hits.get(m[0]):
            kind = "quoted" if is_quoted(marks, m.start(), m.end()) else "stem" if hit[2] else ("exact", "one_edit", "two_edits")[hit[1]]
            counts[kind] += 1
    own = sum(counts.values()) - counts["quoted"]
    return [*(float(np.log1p(counts[k])) for k in FEATURES[:5]), 10 * own / len(words), float(own > 0)]


def _terms_of(text: str) -> set[tuple[str, str]]:
    words = set(WORD.findall(text.lower()))
    return {(w, "word") for w in words if len(w) > 3} | {(w[:k], "stem") for w in words for k in STEMS if len(w) > k}


def learn_lexicon(rows: DataFrame) -> dict[str, str]:
    """Terms and their kinds, from rows of text and label y: words and stems that toxic rows have far oftener.

    Of rows that are copies or near copies, by two minima of their words' hashes, one counts. Partitions are counted
    before Spark adds them up, and only terms that pass reach the driver: words of LEAST toxic rows of the sample.
    """

    def signed(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = {w.encode() for w in WORD.findall((text.as_py() or "").lower())}
                out.append(" ".join(str(min((xxhash.xxh64_intdigest(w, k) for w in words), default=0)) for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["doc_id", "text", "y", "sign"])

    marked = rows.mapInArrow(signed, "doc_id long, text string, y int, sign string")
    single = marked.groupBy("sign", "y").agg(F.min_by("text", "doc_id").alias("text"))

    def counted(batches):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        total = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found[y].update(_terms_of(text or ""))
                total[y] += 1
        terms = [*(found[0].keys() | found[1].keys())]
        table = [("", "", total[1], total[0])] + [(*t, found[1][t], found[0][t]) for t in terms]
        for k in range(0, len(table), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table[k : k + (1 << 16)])], ["term", "kind", "pos", "neg"])

    counts = single.select("text", "y").mapInArrow(counted, "term string, kind string, pos long, neg long")
    counts = counts.groupBy("term", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= F.when(F.col("kind") == "", 0).otherwise(LEAST))
    counts = counts.persist()
    try:
        total = counts.where("kind = ''").first()
        if total is None or not total["pos"]:
            return {}
        odds = F.log((F.col("pos") + 0.5) / (total["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (total["neg"] + 1.0))
        best = counts.where("kind <> ''").where(odds >= ODDS).orderBy(F.col("pos").desc(), F.length("term").desc(), "term").collect()
    finally:
        counts.unpersist()
    taken: dict[str, str] = {}
    longer: dict[str, int] = {}  # by the start of taken terms, the most documents of one
    for r in best:
        term, kind, n = r["term"], r["kind"], r["pos"]
        covered = any(taken.get(term[:k]) == "stem" for k in STEMS if k <= len(term))
        spelled_out = kind == "stem" and longer.get(term, 0) >= 0.9 * n
        if not covered and not spelled_out and term not in taken:
            taken[term] = kind
            for k in STEMS:
                longer[term[:k]] = max(longer.get(term[:k], 0), n)
    return taken


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, the intercept last. Columns that never vary get none."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * max(len(x), 1))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, seed: int = 7) -> dict:
    """The model: lexicon and weights. Two thirds of the sampled rows give the lexicon, the others the weights.

    Rows without a label don't count, nor do labels other than 0 and 1. Without rows of both labels the score is
    constant.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, sample / max(known.count(), 1))
    at = hash_share(F.col("doc_id"), F.lit(seed))
    taken = F.broadcast(known.where(at < share))  # of `sample` rows, about
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(taken, "doc_id"), "labelled")
    terms = learn_lexicon(rows.where(at < share * 2 / 3))
    found = measured(rows.where(at >= share * 2 / 3).select("doc_id", "text", "y"), terms).toPandas()
    x, y = np.array(found["features"].tolist(), float).reshape(-1, len(FEATURES)), found["y"].to_numpy(float)
    if not len(y):
        return {"terms": terms, "weights": [0.0] * len(FEATURES) + [-2.0]}
    return {"terms": terms, "weights": logistic(x, y).tolist()}


def measured(rows: DataFrame, terms: dict[str, str]) -> DataFrame:
    """rows without their text, with the FEATURES as an array."""
    kept = rows.drop("text").withColumn("features", F.array(F.lit(0.0)))
    names, columns = rows.drop("text").columns, kept.columns

    def run(batches):
        automaton = held(("automaton", *sorted(terms.items())), lambda: Automaton(terms))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [measure(automaton, t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))], columns)

    return rows.mapInArrow(run, kept.schema)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row: whole texts are read; a null or empty one has no term.

    Equal texts get equal scores; repeated rows and null ids come back as often as they are there. Other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    found = measured(docs.select("doc_id", "text"), model["terms"])
    *weights, intercept = model["weights"]
    total = F.lit(intercept)
    for k, w in enumerate(weights):
        total = total + F.col("features")[k] * w
    scored = found.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def in_training(doc_id):
    return fold_of(doc_id, 5) != 0


def op7_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels of the other folds; a null doc_id is
    fold 0 and held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(in_training(F.col("doc_id"))))
    return score(docs, model).select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")
