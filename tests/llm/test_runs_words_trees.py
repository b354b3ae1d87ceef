"""Operators 11 to 13 on small tables against plain second versions, and on odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepweave.llm import mtree, runs, spelling

CLASHES = "id long, word string, n long, form string, runs string, collapsed string, row long, v string, tree long, `meta.url` string, `a``b` string"
CLASH = (1, "w", 2, "f", "r", "c", 3, "v", 4, "u", "b")


def plain_runs(words, least, times):
    """(start, length, period) by comparing all words q apart, for every q."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start >= q:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(least, times * q))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 9), st.integers(0, 40)), min_size=1, max_size=4), st.sampled_from([(1, 2), (6, 3), (24, 3)]))
def test_runs_of_documents_are_those_of_all_periods(parts, limits):
    docs = [head + [(k % p) + 3 for k in range(n)] for head, p, n in parts]
    ends = np.cumsum([len(d) for d in docs])
    want = [(s + int(end) - len(d), length, q) for d, end in zip(docs, ends) for s, length, q in plain_runs(d, *limits)]
    assert [tuple(r) for r in runs.runs_of(np.array([w for d in docs for w in d], np.int64), ends, *limits).tolist()] == want


def test_runs_of_a_long_text_of_one_word_and_of_a_long_period():
    n = 30_000
    assert runs.runs_of(np.zeros(n, np.int64), np.array([n])).tolist() == [[0, n, 1]]
    period = random.Random(1).choices(range(500), k=9_000)
    words = np.array((period * 4)[:n], np.int64)
    assert runs.runs_of(words, np.array([n])).tolist() == [[0, n, 9_000]]


def test_collapsed_takes_odd_rows(spark):
    again = "so say we all\n" * 9
    rows = [(1, None), (2, ""), (3, " \t"), (None, again), (4, again), (4, again), (5, "one two " * 30), (6, "x " * 40_000 + "end"), (7, "a b c")]
    docs = spark.createDataFrame([(k, t, *CLASH) for k, t in rows], f"doc_id long, text string, {CLASHES}")
    got = runs.collapsed(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "runs", "collapsed"}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(([tuple(x) for x in r.runs], r.collapsed))
    whole = ([(0, 36, 4)], "so say we all")
    assert by == {1: [([], "")], 2: [([], "")], 3: [([], "")], None: [whole], 4: [whole] * 2, 5: [([(0, 30, 1)], "one two")], 6: [([(0, 40_000, 1)], "x end")], 7: [([], "a b c")]}
    assert runs.collapsed(docs.limit(0)).count() == 0


def plain_forms(counts, times=2):
    near = {w: [v for v in counts if spelling.one_edit(w, v)] for w in counts}
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = (form, n, len(near[w]), counts[form] if form is not None else None)
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_one_edit_is_a_distance_of_one(a, b):
    assert spelling.one_edit(a, b) == (distance(a, b) == 1)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=2, max_size=7), min_size=1, max_size=40))
def test_postings_find_all_words_one_edit_away(words):
    by = defaultdict(list)
    for w in sorted(words):
        by[len(w)].append((w, 1))
    for w in words:
        for length in (len(w), len(w) - 1):
            if length in by:
                got = {v for v, _ in spelling.Postings(by[length]).near(w)}
                assert got == {v for v, _ in by[length] if distance(w, v) == 1}


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=2, max_size=8), st.integers(0, 7), st.sampled_from("abx"), st.randoms())
def test_rarest_grams_of_words_one_edit_apart_meet(word, at, letter, rng):
    at %= len(word)
    rank = defaultdict(lambda: rng.randint(1, 3))
    for other in (word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]):
        if other == word:
            continue
        a, b = spelling.grams(word), spelling.grams(other)
        mine, theirs = spelling.prefix(a, rank), spelling.prefix(b, rank)
        assert any(a[i] == b[j] and 0 <= j - i <= len(other) - len(word) for i in mine for j in theirs)


@pytest.mark.parametrize("block", [4096, 8])
def test_forms_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)  # hot keys: dealt out over blocks
    rng = random.Random(5)
    counts = {"".join(rng.choices("abcé", k=rng.randint(5, 7))): rng.choice([3, 4, 7, 20, 90, 300]) for _ in range(900)}
    got = spelling.forms(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == plain_forms(counts)


def test_variants_take_odd_rows(spark):
    text = "Straße straße straße; strasse STRASSE Straßen straßen " + "hello " * 40 + "hallo hallo hallo HELLÒ hellò hellÒ"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "ab " * 50_000)]
    docs = spark.createDataFrame([(k, t, *CLASH[1:]) for k, t in rows], f"doc_id long, text string, {CLASHES.removeprefix('id long, ')}")
    got = {r.word: r for r in spelling.variants(docs).collect()}
    counts = Counter({"straße": 9, "strasse": 6, "straßen": 6, "hello": 120, "hallo": 9, "hellò": 3, "hellÒ": 6})
    assert {w: (r.form, r.root, r.n, r.n_near, r.form_n) for w, r in got.items()} == plain_forms(counts)
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("doc_id = 4")).count() == 0
    with pytest.raises(ValueError, match="two letters"):
        spelling.variants(docs, shortest=1)


def plain_topk(rows, every, k):
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    out = []
    for at, (i, v) in enumerate(whole):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(whole) if other != at and len(w) == len(v))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("dims", "kind"), [(2, "clustered"), (16, "random"), (3, "copies")])
def test_topk_is_that_of_all_pairs(spark, monkeypatch, dims, kind):
    for name, small in (("TREE", 600), ("QUERIES", 16)):
        monkeypatch.setattr(mtree, name, small)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, dims)) * rng.choice([0.1, 1, 3], 1500)[:, None]
    if kind == "clustered":
        x = rng.standard_normal((12, dims))[rng.integers(0, 12, 1500)] * 5 + x / 20
    if kind == "copies":
        x[:600] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = mtree.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=25, k=7)
    assert sorted(tuple(r) for r in got.collect()) == plain_topk(rows, 25, 7)


def test_trees_pass_over_what_is_too_far():
    """The stored distances leave most of clustered vectors unseen."""
    rng = np.random.default_rng(3)
    x = mtree.whole(rng.standard_normal((40, 8))[rng.integers(0, 40, 8000)] * 4 + rng.standard_normal((8000, 8)) / 50)
    space = mtree.Space(float((x * x).sum(1).max()))
    tree = mtree.Tree.build(space, np.arange(8000), np.arange(8000), x)
    seen = []
    products = mtree.products
    try:
        mtree.products = lambda vectors, query: seen.append(len(vectors)) or products(vectors, query)
        rows, ids, scores = tree.search(x[5], 5, 5)
    finally:
        mtree.products = products
    want = np.lexsort((np.arange(8000), -np.where(np.arange(8000) == 5, -np.inf, x @ x[5])))[:5]
    assert rows.tolist() == want.tolist() and sum(seen) < 2000


def test_topk_takes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (50, [1.0]), (51, [2.0]), (100, []), (101, []),
        (150, [1e300, 1.0, 2.0]), (151, [1e300, 1.0, 2.0]),
    ]
    clashes = CLASHES.replace("id long, ", "")
    table = spark.createDataFrame([(*r, *CLASH[1:]) for r in rows], f"vec_id long, embedding array<double>, {clashes}")
    got = sorted(tuple(r) for r in mtree.topk(table).collect())
    same = [(0, 1, 0, 65536), (0, 2, 1, 65536), (0, 3, 2, 0)]
    assert got == sorted([*same, *same, (50, 1, 51, 131072), (100, 1, 101, 0), (150, 1, 151, mtree.LONG)])
    assert mtree.topk(table.limit(0)).count() == 0 and mtree.topk(table.where("vec_id in (3, 5)")).count() == 0
