"""The numbered queries as they are registered: columns and rows of their contracts, by SQL or plain second versions."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from stepweave.llm import language_id, quality
from stepweave.llm.common import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def rows(n: int):
        if n not in done:
            (name,) = [k for k in __spark_entry__.queries() if k.startswith(f"op{n}_")]
            found = __spark_entry__.queries()[name](spark, SF)
            done[n] = (name, found.dtypes, found.collect())
        return done[n]

    return rows


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("SELECT doc_id, text, source, lang FROM documents ORDER BY doc_id").fetchall()


def held(duck_id, n, fold):
    return zlib.crc32(str(duck_id).encode()) % n == fold


@pytest.mark.parametrize("n", [2, 3, 11, 12, 13])
def test_rows_are_those_of_the_sql(run, duck, n):
    name, kinds, rows = run(n)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == sorted(k for k, _ in kinds)
    order = [want.columns.index(k) for k, _ in kinds]
    plain = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(plain, rows)) == sorted(plain([r[k] for k in order]) for r in want.fetchall()) and rows


def test_op1_tells_every_document(run, texts):
    _, kinds, rows = run(1)
    assert [k for k, _ in kinds][0] == "doc_id" and sorted(r.doc_id for r in rows) == [t[0] for t in texts]
    assert all(r.round_trip and 1 <= r.n_found <= 4 for r in rows)


def test_op3_digests_are_those_of_the_pages(run, duck):
    _, _, rows = run(3)
    pages = {k: (html or "").encode() for k, html in duck.sql("SELECT page_id, html FROM pages").fetchall()}
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(pages[r.page_id]).digest()).decode() and r.payload_bytes == len(pages[r.page_id])


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values())
    target, left = {}, set(order)
    while left:
        spare = total - sum(target.values())
        got = {s: spare * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if got[s] > 2 * sizes[s]}
        if not full:
            return target | got
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= full
    return target


def test_op4_meets_its_targets(run, texts):
    _, _, rows = run(4)
    size = {k: len(WORD.findall(t or "")) for k, t, *_ in texts}
    source = {k: s for k, _, s, _ in texts}
    sums = {}
    for k, n in size.items():
        sums[source[k]] = sums.get(source[k], 0) + n
    target, taken = plain_targets(sums), dict.fromkeys(sums, 0)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9)
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 50 for s in sums)


def test_op5_finds_the_nearest(run, duck):
    _, kinds, rows = run(5)
    assert kinds == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    x = {k: np.array(v, float) for k, v in duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()}
    found = {}
    for r in rows:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(found) == {k for k in x if k % 20 == 0}
    hits = 0
    for k, got in found.items():
        got.sort()
        assert [r for r, *_ in got] == list(range(1, 21)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        every = sorted((-float(x[k] @ v), j) for j, v in x.items() if j != k)[:20]
        hits += len({j for _, j in every} & {j for *_, j in got})
    assert hits >= 0.98 * 20 * len(found)


def test_op6_groups_by_fingerprints(run, texts):
    _, _, rows = run(6)
    fps = {}
    for k, t, *_ in texts:
        words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        bits = np.array([[xxhash.xxh64_intdigest(s, 42) >> b & 1 for b in range(64)] for s in shingles]).reshape(-1, 64)
        fps[k] = sum(1 << b for b in range(64) if 2 * bits[:, b].sum() > len(shingles))
    ids = list(fps)
    a = np.array([fps[k] for k in ids], np.uint64)
    near, least = np.bitwise_count(a[:, None] ^ a) <= 3, np.array(ids)
    while True:
        after = np.where(near, least[None, :], 1 << 60).min(1)
        if (after == least).all():
            break
        least = after
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{fps[k]:016x}", int(c)) for k, c in zip(ids, least)}


def test_op8_finds_every_base_phrase(run, texts):
    _, _, rows = run(8)
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    by_id = {r.doc_id: r for r in rows}
    for k, t, *_ in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts, labels, r = [i for i, _ in at], {x for _, x in at}, by_id[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


@pytest.mark.parametrize(("n", "folds", "fold", "label"), [(7, 5, 0, "toxic"), (10, 3, 1, "quality")])
def test_learned_scores_and_folds(run, duck, texts, n, folds, fold, label):
    _, kinds, rows = run(n)
    assert kinds[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert sorted(r.doc_id for r in rows) == [t[0] for t in texts]
    for r in rows:
        assert r.held_out == held(r.doc_id, folds, fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    text, first = dict((k, t) for k, t, *_ in texts), {}
    for r in rows:  # equal texts, equal scores
        assert first.setdefault(text[r.doc_id], r.score) == pytest.approx(r.score, abs=1e-12)


def test_op9_knows_languages_of_held_out_documents(run, texts):
    _, kinds, rows = run(9)
    assert kinds[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    text, lang = {k: t for k, t, *_ in texts}, {k: x for k, _, _, x in texts}
    learned = {x for k, x in lang.items() if x is not None and not held(k, 3, 1)}
    right = []
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        assert r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in learned
            if r.held_out and lang[r.doc_id]:
                right.append(r.lang_pred == lang[r.doc_id])
    assert len(right) > 200 and np.mean(right) > 0.97


def test_op10_scores_are_those_of_its_rules(run, spark, texts):
    """Every score anew: the statistics of a whole text, and the weights of the rules that hold for them."""
    _, _, rows = run(10)
    labels = table(spark, SF, "labels").where(quality.in_training(F.col("doc_id")))
    model = quality.fit(table(spark, SF, "documents"), labels)
    text = {k: t for k, t, *_ in texts}
    assert model["rules"]
    for r in rows:
        x = quality.statistics(text[r.doc_id])
        total = model["intercept"] + sum(w for rule, w in zip(model["rules"], model["weights"]) if all((x[f] <= cut) == low for f, cut, low in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12) and r.predicted == int(r.score >= 0.5)


def test_op9_predictions_are_those_of_plain_profiles(run, texts):
    """Prototypes and cosines anew, from n-grams of strings and vectors of letters in double precision."""
    _, _, rows = run(9)
    dim, n, seed = language_id.DIM, language_id.GRAM, language_id.SEED
    letters, bound = {}, {}

    def vector(gram):
        if gram not in bound:
            out = np.ones(dim)
            for k, c in enumerate(gram):
                if c not in letters:
                    letters[c] = np.random.default_rng((seed, 0 if c == " " else ord(c))).integers(0, 2, dim, np.int8) * 2.0 - 1
                out *= np.roll(letters[c], n - 1 - k)
            bound[gram] = out
        return bound[gram]

    def profile(text):
        plain = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
        grams = Counter(plain[k : k + n] for k in range(len(plain) - n + 1)) if plain.strip() else {}
        out = sum((c * vector(g) for g, c in grams.items()), np.zeros(dim))
        return out / np.linalg.norm(out) if out.any() else None

    profiles, sums = {k: profile(t) for k, t, *_ in texts}, {}
    for k, _, _, lang in texts:
        if lang is not None and profiles[k] is not None and not held(k, 3, 1):
            sums[lang] = sums.get(lang, 0) + profiles[k]
    names = sorted(sums)
    models = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in names])
    for r in rows:
        p = profiles[r.doc_id]
        if p is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = models @ p
        assert r.lang_pred == names[int(cosine.argmax())]
        assert r.score == pytest.approx(1 / np.exp(language_id.SHARP * (cosine - cosine.max())).sum(), abs=1e-3)
