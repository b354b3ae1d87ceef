"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Letters in a gram, words of one key that are indexed at once, and different words that a task counts before it hands them on.
GRAM, BLOCK, HELD = 3, 4096, 300_000
PAD = "\0"
RUN = "[A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame, edit: Callable[[int | None], Callable[[str], str]] | None = None, shortest: int = 5, least: int = 3, run: str = RUN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n (how often it comes in all whole texts) of words of `shortest` code points and `least` occurrences.

    Words are maximal runs of letters; A-Z alone are lower-cased. `edit` gives for a
    document's id what puts other words in place of its words. Counts are added up in each task, over HELD words at most, before they are shuffled.
    """
    if shortest < 2:
        raise ValueError("words have two letters at least: an edit leaves no gram of a shorter one")
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def counted(batches):
        runs, held = re.compile(run).findall, Counter()
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                own = runs(t.encode().lower().decode()) if t else []  # bytes know no other letters than A-Z
                if edit is None:
                    held.update(own)
                else:
                    put = edit(i)
                    for w, n in Counter(own).items():
                        held[put(w)] += n
                if len(held) > HELD:
                    yield _counts(held, shortest)
                    held = Counter()
        yield _counts(held, shortest)

    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counts(held: Counter, shortest: int) -> pa.RecordBatch:
    words = [w for w in held if len(w) >= shortest]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])


def grams(word: str, q: int = GRAM) -> list[str]:
    """The q-grams of a word by position, padded on both sides: one edit touches q of the longer word's at most."""
    padded = PAD * (q - 1) + word + PAD * (q - 1)
    return [padded[i : i + q] for i in range(len(word) + q - 1)]


def prefix(own: list[str], rank: dict[str, int], q: int = GRAM) -> list[int]:
    """Positions of the q + 1 rarest grams, and of further ones equal to the last of them.

    An edit leaves one of them as it is, so words one edit apart have one of their rarest grams in common, at positions
    that differ by no more than their lengths.
    """
    order = sorted(range(len(own)), key=lambda i: (rank[own[i]], own[i]))
    k = q + 1
    while k < len(order) and own[order[k]] == own[order[k - 1]]:
        k += 1
    return order[:k]


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point between them."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(a) + 1 == len(b) and a[k:] == b[k + 1 :] if len(a) != len(b) else k < len(a) and a[k + 1 :] == b[k + 1 :]


class Postings:
    """Words of one length by gram and position: lists of places among the words, ascending."""

    def __init__(self, words: list[tuple[str, int]], q: int = GRAM):
        self.words, self.q, self.lists = words, q, defaultdict(list)
        self.length = len(words[0][0]) if words else 0
        for k, (word, _) in enumerate(words):
            for p, g in enumerate(grams(word, q)):
                self.lists[g, p].append(k)

    def near(self, word: str, before: int | None = None) -> Iterator[tuple[str, int]]:
        """Indexed words one edit from a word as long or one longer; with `before`, those at earlier places alone.

        Of the lists of the word's grams, at their own or the position before, an answer must be in all but q. So it is in
        one of the q + 1 shortest, which a heap merges; in the others what comes out is looked up, until it misses too many.
        """
        longer, q, get = len(word) - self.length, self.q, self.lists.get
        found, missed = [], 0
        for p, g in enumerate(grams(word, q)):
            x = get((g, p))
            if longer and (y := get((g, p - 1))):
                x = sorted({*x, *y}) if x else y
            if before is not None and x:
                x = x[: bisect_left(x, before)]
            if x:
                found.append(x)
            else:
                missed += 1
                if missed > q:
                    return
        found.sort(key=len)
        short, long = found[: q - missed + 1], found[q - missed + 1 :]
        for k, same in groupby(merge(*short)):
            misses = missed + len(short) - sum(1 for _ in same)
            for x in long:
                i = bisect_left(x, k)
                if i == len(x) or x[i] != k:
                    misses += 1
                    if misses > q:
                        break
            if misses <= q and one_edit(word, self.words[k][0]):
                yield self.words[k]


def _keyed(words: DataFrame, rank, q: int) -> DataFrame:
    """gram, length, place, probe (0: indexed, and met by its like; 1: a word one longer), word, n: what a word is found by."""

    def run(batches):
        order = rank.value
        for batch in batches:
            out = [[], [], [], [], [], []]
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                own = grams(word, q)
                keys = {(own[p], len(word), p, 0) for p in prefix(own, order, q)}
                keys |= {(g, length - 1, p - s, 1) for g, length, p, _ in keys for s in (0, 1) if p >= s and length > 1}
                for key in keys:
                    for column, x in zip(out, (*key, word, n)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["gram", "length", "place", "probe", "word", "n"])

    return words.mapInArrow(run, "gram string, length int, place int, probe int, word string, n long")


def near_words(words: DataFrame, q: int = GRAM) -> DataFrame:
    """a, a_n, b, b_n: pairs of the words (word, n) that one edit parts, each once, a the shorter or the smaller.

    Words are dealt by their rarest grams with length and place, a few keys each. What indexes the rows of a key merges
    lists under that key's length and places alone, so all pairs of a key are never looked at. A key of more than BLOCK
    indexed words is dealt out over blocks of them, which its probes all visit. The table of gram counts that tasks are
    sent has a row a gram: q-th powers of the letters of an alphabet at most, however many words there are.
    """
    spark = words.sparkSession
    cut = F.transform(F.sequence(F.lit(1), F.length("word") + q - 1), lambda i: F.substr(F.concat(F.lit(PAD * (q - 1)), "word", F.lit(PAD * (q - 1))), i, F.lit(q)))
    counts = words.select(F.explode(F.array_distinct(cut)).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
    rank = spark.sparkContext.broadcast({r.gram: r.c for r in counts.collect()})
    keyed, keys = _keyed(words, rank, q), ["gram", "length", "place"]
    hot = written(keyed.where("probe = 0").groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "hot_keys")
    dealt = keyed.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    # an indexed word is a probe of its own length, too: in every block but its own it comes as such alone (probe 2)
    blocks = F.when((F.col("blocks") == 1), F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("probe").alias("probe")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.when((F.col("probe") == 0) & (b != own), F.lit(2)).otherwise(F.col("probe")).alias("probe")))
    )
    dealt = dealt.select(*keys, "word", "n", F.inline(blocks))
    keys = [*keys, "block"]
    ready = dealt.repartition(*keys).sortWithinPartitions(*keys, "probe", "word")

    def run(batches):
        rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in (*keys, "probe", "word", "n")]))
        for _, group in groupby(rows, key=lambda r: r[:4]):
            index, made, out = [], None, [[], [], [], []]
            for *_, probe, word, n in group:
                if probe == 0:
                    index.append((word, n))
                    continue
                if not index:
                    break  # sorted first: nothing to find
                if made is None:
                    made = Postings(index, q)
                for other, m in made.near(word):
                    _add(out, word, n, other, m, probe)
            if len(index) > 1:
                made = made or Postings(index, q)
                for k, (word, n) in enumerate(index):
                    for other, m in made.near(word, k):
                        _add(out, word, n, other, m, 0)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64()) * 2)], ["a", "a_n", "b", "b_n"])

    return ready.mapInArrow(run, "a string, a_n long, b string, b_n long").distinct()


def _add(out: list[list], word: str, n: int, other: str, m: int, probe: int) -> None:
    """A pair, told once: of words of one length by the larger of them, where the other is indexed."""
    if probe == 1 or other < word:
        for column, x in zip(out, (other, m, word, n)):
            column.append(x)


def forms(words: DataFrame, times: int = 2, q: int = GRAM) -> DataFrame:
    """word, n, n_near, form, form_n and root of each of the words (word, n), which must differ.

    A word's form is its most frequent near word, the smallest of tied ones, if it comes at least `times` as often. Forms
    lead from word to word; root is where they end, the word itself where there is none. A way is at most as long as
    counts can double, and its ends are found by jumps that double: each round a table of the shared folder.
    """
    words = written(words, "words")
    pairs = near_words(words, q)
    turned = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    both = pairs.select(F.inline(turned))
    # the least of (-n, word) is the most frequent, the smallest of tied ones
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    known = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.m") >= F.col("n") * times, F.col("best.other")).alias("form"), F.when(-F.col("best.m") >= F.col("n") * times, -F.col("best.m")).alias("form_n")), "forms")
    ways = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = written(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        if ways.where("moved").isEmpty():
            break
        ways = ways.select("word", "root")
    return known.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, edit: Callable[[int | None], Callable[[str], str]] | None = None, shortest: int = 5, least: int = 3, times: int = 2, run: str = RUN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """forms() of the words of documents.

    Whole texts are read. Null texts have no words; null and repeated ids and repeated rows count as any others. Texts
    and tables without words of the asked kind give no row. Other columns are not read, whatever their names.
    """
    return forms(word_counts(docs, edit, shortest, least, run, id, text), times)


def misspelt(doc_id: int | None) -> Callable[[str], str]:
    """For a document's words: the word, without one of its letters where the crc32 of id and word is a multiple of 97."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def put(word: str, crc32=zlib.crc32) -> str:
        h = crc32(word.encode(), head)
        if h % 97:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return put


def op13_spelling_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole texts, some misspelt first, with their near words, forms and roots."""
    return variants(table(spark, sf_dir, "documents"), edit=misspelt)
