"""Operators on documents: brute force, round trips, held-out accuracy and odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stepweave.llm import language_id, licenses, mixing, quality, sentencepiece_nbest, simhash, toxicity
from stepweave.llm.common import table
from stepweave.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "lang_pred", "size", "nth", "copies", "row", "__text", "__size", "pieces", "fp", "label", "upper", "__upper", "component", "meta.url", "a`b")
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one two three four five six seven", "en", "a", 33),
    (5, "one two three four five six seven", "de", "b", 33),
    (5, "one two three four five six seven", "de", "b", 33),
    (None, "lost words here", "en", "b", 15),
    (7, "12 34 !?", "fr", "c", 8),
    (8, "word " * 20000, "en", "a", 100000),
    (9, "x" * 50000, "en", "a", 50000),
    (10, "The ünïcode 漢字 text▁with marks…", "de", "c", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# SentencePiece


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_nbest.Lattice(sentencepiece_nbest.load_pieces(), 4)


def all_paths(pieces, spelled, byte_ids, s):
    by_text = {p: (i, score) for i, (p, score, kind) in enumerate(pieces) if kind == "n"}
    out = []

    def walk(at, score, ids):
        if at == len(s):
            out.append((score, tuple(ids)))
            return
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in by_text:
                i, own = by_text[s[at:end]]
                walk(end, score + own, [*ids, i])
        if s[at] not in by_text:
            walk(at + 1, score + spelled, ids + [byte_ids[b] for b in s[at].encode()])

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_are_the_best_of_all_segmentations(lattice):
    pieces, rng = sentencepiece_nbest.load_pieces(), np.random.default_rng(1)
    for _ in range(150):
        text = "".join(rng.choice(list("abthe n\n.,ßé漢▁")) for _ in range(rng.integers(1, 9)))
        every = all_paths(pieces, lattice.spelled, lattice.bytes, "▁" + text.replace(" ", "▁"))
        scores, ids, others = lattice.encode(text, alternatives=True)
        assert scores == [x[0] for x in every[:4]]
        found, by_ids = [tuple(ids), *map(tuple, others)], {x[1]: x[0] for x in every}
        assert len(set(found)) == len(scores) and [by_ids[x] for x in found] == scores
        assert lattice.decode(ids) == text.replace("▁", " ")


def k_best(pieces, lattice, s, k):
    """Scores of the k best paths of the whole, uncut lattice."""
    by_text = {p: score for p, score, kind in pieces if kind == "n"}
    longest, at = max(map(len, by_text)), [[] for _ in range(len(s) + 1)]
    at[0] = [0.0]
    for end in range(1, len(s) + 1):
        found = [x + by_text[s[i:end]] for i in range(max(0, end - longest), end) if s[i:end] in by_text for x in at[i]]
        if s[end - 1] not in by_text:
            found += [x + lattice.spelled for x in at[end - 1]]
        at[end] = sorted(found, reverse=True)[:k]
    return at[-1]


#: Characters of every class that texts hold, those that pieces join in odd ways among them.
CLASSES = "aTheß éЖж漢字かقا한²½①٣7305_-.,;:!?()[]{}<>=+*/|&%$#@~^`'\"\\“”‘’«»…–—▁ \t\n\r\u00a0\u200b\u0301€£🙂\x07İ"


def test_whole_texts_of_all_characters_get_the_best_of_the_uncut_lattice(lattice):
    pieces, rng = sentencepiece_nbest.load_pieces(), np.random.default_rng(2)
    kinds = {i: (s, k) for i, (_, s, k) in enumerate(pieces)}
    joined = [p.replace("▁", " ") for p, _, k in pieces if k == "n" and len(p) > 1 and not p.isalpha()]
    texts = ["x².", "10 m². Then", "½-²_a.b"] + ["".join(rng.choice(list(CLASSES), rng.integers(1, 60))) for _ in range(250)]
    texts += ["".join(rng.choice(joined + list(CLASSES), rng.integers(1, 25))) for _ in range(250)]
    for text in texts:
        scores, ids, others = lattice.encode(text, alternatives=True)
        want = k_best(pieces, lattice, "▁" + text.replace(" ", "▁"), 4)
        assert len(scores) == len(want) and np.allclose(scores, want, rtol=0, atol=1e-6 * max(1, abs(want[-1]) * 1e-6)), text
        found = [tuple(ids), *map(tuple, others)]
        assert len(set(found)) == len(scores), text
        for one, score in zip(found, scores):
            assert lattice.decode(one) == text.replace("▁", " ")
            plain = sum(kinds[i][0] for i in one if kinds[i][1] == "n")
            spelled = score - plain
            assert abs(spelled - lattice.spelled * round(spelled / lattice.spelled)) < 1e-3, text


def test_no_piece_is_cut(lattice):
    names = [p for p, _, k in sentencepiece_nbest.load_pieces() if k == "n"]
    assert not sentencepiece_nbest.Cutter(names).whole
    for piece in names:
        for before, after in ("aa", "..", "▁▁", "²²", "\n\n", "77"):
            places, at = set(), 0
            for part in lattice.cut(before + piece + after):
                at += len(part)
                places.add(at)
            assert at == len(piece) + 2 and not places & set(range(2, len(piece) + 1)), piece
    crossing = sentencepiece_nbest.Cutter(["a", "▁", "a▁", "."])
    assert crossing.whole and crossing.find("▁a▁a.") == ["▁a▁a."]


def test_ids_decode_as_the_library_decodes_them(lattice):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_nbest.MODEL)
    for text in ("Hello  world\n\nThis is\ta test ẞ … ﬁ  ", " leading", "漢字 émigré 12.5%"):
        _, ids, _ = lattice.encode(text)
        assert library.decode(list(ids)) == text == lattice.decode(ids)


def test_long_ties_stay_linear(lattice):
    scores, ids, _ = lattice.encode("a" * 20000)
    assert len(scores) == 4 and lattice.decode(ids) == "a" * 20000


def test_encoding_of_odd_rows(odd, none):
    rows = sentencepiece_nbest.encoded(odd, alternatives=True).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    assert {r.doc_id: len(r.pieces) for r in rows if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    back = sentencepiece_nbest.decoded(sentencepiece_nbest.encoded(odd)).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    assert sentencepiece_nbest.encoded(none).count() == 0 and sentencepiece_nbest.digest(none).count() == 0


def test_what_a_worker_remembers_is_bounded_and_changes_no_result(lattice, odd):
    few = sentencepiece_nbest.Lattice(sentencepiece_nbest.load_pieces(), 4, remembered=50)
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(60))
        assert few.encode(text, True) == lattice.encode(text, True)
        assert len(few.young) <= 50 and len(few.old) <= 50
    assert len(lattice.young) + len(lattice.old) > 100
    rows = lambda **more: sorted(map(repr, sentencepiece_nbest.encoded(odd, **more).collect()))
    assert rows(remembered=2) == rows()
    assert corpus_pipeline.REMEMBERED < sentencepiece_nbest.REMEMBERED


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    out = dict(fps)
    ids = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(out[i] ^ out[j]).count("1") <= 3 and ids[i] > ids[j]:
                    ids[i], changed = ids[j], True
    return ids


@pytest.mark.parametrize("tile", [4096, 8])
def test_simhash_groups_are_those_of_all_pairs(spark, docs, tile):
    rows = docs.where("doc_id < 120").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    near = [(1000 + k, " ".join(texts[5].split()[: -k or None])) for k in range(12)]
    rows = rows.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    fps = {i: plain_fingerprint(t) for i, t in (texts | dict(near)).items()}
    want = plain_components(fps)
    got = simhash.simhash_groups(rows, tile=tile).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_pivot_tables_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 5), False)) for b in base for _ in range(6)]
    fps = {i: v for i, v in enumerate(dict.fromkeys(near))}
    frame = spark.createDataFrame([(v,) for v in fps.values()], "fp long")
    found = {r.node: r.component for r in connected_components(simhash.links(frame, tile=16)).collect()}
    want = plain_components(fps)
    least = {}
    for i, c in want.items():
        least[c] = min(least.get(c, 1 << 64), fps[i])
    assert all(found.get(fps[i], fps[i]) == least[want[i]] for i in fps)


def test_simhash_of_odd_rows(odd, none):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[5].component_id == 4
    assert simhash.simhash_groups(none).count() == 0
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 7, 8, 9, 10]


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 41)} | {100 + k: 100 for k in range(30)}


# Toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distances_find():
    terms = {"idiot": "word", "worthless": "word", "scum": "word", "pathetic": "word", "lostra": "stem"}
    automaton, rng = toxicity.Automaton(terms), np.random.default_rng(5)
    words = set()
    for term in terms:
        for _ in range(300):
            w = list(term)
            for _ in range(rng.integers(0, 4)):
                k, at = rng.integers(0, 3), rng.integers(0, len(w) + 1)
                if k == 0:
                    w.insert(at, rng.choice(list("abciotx9")))
                elif at < len(w):
                    w[at : at + 1] = [] if k == 1 else [rng.choice(list("abciotx9"))]
            words.add("".join(w))
    for w in words:
        near = [(edit_distance(w, t), t) for t, kind in terms.items() if kind == "word" and edit_distance(w, t) <= toxicity.edits_allowed(t)]
        stem = w.startswith("lostra")
        want = None if not near and not stem else ("lostra", 0, True) if stem and (not near or min(near)[0]) else (min(near)[1], min(near)[0], False)
        assert automaton.look_up(w) == want, w


def test_quotation_is_told_from_abuse():
    automaton = toxicity.Automaton({"idiot": "word"})
    abuse = dict(zip(toxicity.FEATURES, toxicity.measure(automaton, "You are an idiot and an idi0t.")))
    quoted = dict(zip(toxicity.FEATURES, toxicity.measure(automaton, 'He was called an "utter idiot" by them.')))
    assert abuse["exact"] > 0 and abuse["one_edit"] > 0 and not abuse["quoted"]
    assert quoted["quoted"] > 0 and not quoted["exact"] and not quoted["any"]


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("You don’t get it, you idiot, and it’s over", False),
        ("You don't get it, you idiot, and it's over", False),
        ("He doesn’t mind “utter idiot” as a name", True),
        ("the dogs’ idiot and the cats’ bowl", False),
        ("sie sagte „so ein idiot“ und ging", True),
        ("er rief »idiot« laut", True),
        ("« quel idiot », dit-il", True),
        ("‘what an idiot’, she said, and didn’t stay", True),
        ("“one” idiot “two”", False),
        ('"one" idiot "two"', False),
        ('a 5" idiot', False),
        ("“opened here\nidiot” closed there", False),
        ("„he said “you idiot” again“", True),
        ("“" + "x " * 60 + "idiot”", False),
    ],
)
def test_quotation_marks_are_paired_by_kind(text, quoted):
    found = dict(zip(toxicity.FEATURES, toxicity.measure(toxicity.Automaton({"idiot": "word"}), text)))
    assert (found["quoted"] > 0, found["exact"] > 0) == (quoted, not quoted)


def test_long_words_and_many_terms_are_learned(spark):
    rng = np.random.default_rng(7)
    names = ["".join(rng.choice(list("abcdefghijklmnop"), 45)) for _ in range(700)]
    rows = [(k, " ".join(rng.choice(names, 70, False)), 1) for k in range(400)] + [(100 + k, f"kind words only {k}abc", 0) for k in range(1000)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    automaton = toxicity.Automaton(terms)
    assert len(terms) > 500 and sum(automaton.look_up(n) is not None for n in names) > 650


def test_toxicity_on_held_out_rows_of_the_real_table(spark):
    """At sf0.1, where 352 labels are all there is to learn from: 85 % of 97 toxic documents, 0.1 % of 728 others."""
    d, lab = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    found = toxicity.op7_toxicity_automata(spark, "/root/testdata/sf0.1")
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and found.count() == d.count()
    held = found.join(lab.where("toxic is not null").select("doc_id", "toxic"), "doc_id").where("held_out and predicted = int(score >= 0.5)").collect()
    toxic = [r.predicted for r in held if r.toxic]
    clean = [r.predicted for r in held if not r.toxic]
    assert len(held) > 800 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


def test_toxicity_is_learned_and_held_out(spark, odd, none):
    rng = np.random.default_rng(2)
    common = ["".join(rng.choice(list("aeiourstln"), 6)) for _ in range(200)]
    rows, labels = [], []
    for k in range(900):
        words = list(rng.choice(common, 40))
        y = int(k % 5 == 0)
        if y:
            words[3], words[20] = rng.choice(["wretchling", "grubsnout", "mudbrain"]), "wretchlinq"
        rows.append((k, " ".join(words)))
        labels.append((k, y))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab.where(toxicity.in_training(F.col("doc_id"))))
    held = toxicity.score(d, model).join(lab, "doc_id").where(~toxicity.in_training(F.col("doc_id"))).collect()
    assert len(held) > 100 and np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(none, lab.where("1 = 0"))).where("predicted = 0").count() == len(ODD)


# Licences


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_license_phrases_are_all_found(docs, odd, none):
    texts = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    extra = [(-1, "Under the MIT License, under the mit license. CC-BY-NC cc by nc"), (-2, "MIT under the license; Apache License, Version 2.0")]
    texts = texts.unionByName(texts.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    want = sorted((str(r.doc_id), *plain_scan(r.text)) for r in texts.collect())
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(texts).collect())
    for (i, n, places), r in zip(want, got):
        at = [k for k, _ in places]
        assert r[:6] == (i, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r[5].split(","))) <= set(r[6].split(","))
    assert licenses.scan(none).count() == 0


def test_templates_need_position_and_key_phrases():
    index = licenses.Index(dict.fromkeys({w for _, t, *_ in (*licenses.PHRASES, *licenses.TEMPLATES, *licenses.NOTICES) for w in licenses.words_of(t)}, 1), 100)
    for label, text, keys in licenses.NOTICES:
        assert all(licenses._stands(licenses.words_of(text), licenses.words_of(k)) for k in keys), label
        own = licenses.words_of(text)
        assert label in index.scan([b"prelude"] * 7 + own + [b"end"])[1]
        put_in = own[:9] + [b"indeed", b"so"] + own[9:20] + own[21:]  # two words more, one less, outside the phrases or not
        labels, score = index.scan(put_in)[1:]
        assert score > 0.8, label
    gpl = "This work is licensed under the GNU General Public License, version 3."
    assert index.scan(licenses.words_of(gpl))[1] == {"gpl-3"}
    bsd = licenses.TEMPLATES[2][1]
    assert "bsd" in index.scan(licenses.words_of(bsd.replace("with or without", "with and without")))[1]
    assert "bsd" not in index.scan(licenses.words_of(bsd.replace("source and binary", "binary and source")))[1]
    assert index.scan(licenses.words_of(" ".join(reversed(bsd.split()))))[1] == set()


# Language ID


def test_languages_are_held_out(spark, odd, none):
    rows = []
    rng = np.random.default_rng(4)
    for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "aeioußéñ")):
        rows += [(len(rows) + k, " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30)), lang) for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = language_id.train(d.where(language_id.in_training(F.col("doc_id"))), per_language=50)
    held = language_id.predict(d, prototypes).where(~language_id.in_training(F.col("doc_id"))).collect()
    assert len(held) > 80 and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in held)
    got = {r.doc_id: r for r in language_id.predict(odd, prototypes).collect()}
    assert len(got) == len({r[0] for r in ODD}) and all(got[k].lang_pred == "und" for k in (1, 2, 3, 7))
    assert language_id.predict(none, prototypes).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(none)).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    space = language_id.Space(64, 3, 1)
    code = [0, *map(ord, "aыc"), 0]
    letters = {c: np.random.default_rng((1, c)).integers(0, 2, 64, np.int8).astype(int) * 2 - 1 for c in code}
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(code, code[1:], code[2:]))
    assert (space.profile("  AЫC!?") == want).all()
    plane = [chr(c) for c in (0x61, 0x61 + 4096, 0x61 + 8192, 0x10FF61, 0x20061) if chr(c).isalpha()]
    assert len({tuple(space.letter(ord(c))) for c in plane}) == len(plane) > 2  # no two letters share a vector
    with pytest.raises(ValueError, match="3 letters"):
        language_id.Space(64, 4)


# Quality


def test_quality_rules_on_held_out_rows(spark, sf_dir, docs, odd, none):
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(quality.in_training(F.col("doc_id"))))
    held = quality.score(docs, model).join(labels, "doc_id").where(~quality.in_training(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    scores = {str(r.doc_id): r.score for r in quality.score(docs, model).collect()}
    for r in quality.features(docs).limit(50).collect():
        x = np.array([[r[k] for k in model["names"]]])
        total = model["intercept"] + sum(w for rule, w in zip(model["rules"], model["weights"]) if quality.applies(rule, x)[0])
        assert abs(scores[str(r.doc_id)] - 1 / (1 + np.exp(-total))) < 1e-9
    assert quality.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.score(none, model).count() == 0
    assert quality.score(odd, quality.fit(none, labels.where("1 = 0"))).count() == len(ODD)


# Mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2 * sizes[s] for s in full}
        full |= over


def test_mix_keeps_targets_and_limits(docs, odd):
    for rows in (docs, odd):
        got = mixing.mix(rows).collect()
        assert len(got) == rows.count()
        sizes = {}
        for r in rows.select("source", "text").collect():
            sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = plain_targets(sizes)
        for s in sizes:
            own = [r for r in got if r.source == s]
            assert {r.source_size for r in own} == {sizes[s]} and all(abs(r.target - want[s]) < 1e-6 for r in own)
            assert abs(sum(r.taken for r in own) - want[s]) <= max(r["size"] for r in own)
        assert all(r.copies in (0, 1, 2) and r.taken == r.copies * r["size"] for r in got)
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))


def test_mix_gives_every_document_its_chance(spark):
    rows = spark.createDataFrame([(k, "w " * (1 + k % 7), "s" if k < 300 else "t") for k in range(600)], "doc_id long, text string, source string")
    items = mixing.sizes(rows).persist()
    targets = mixing.source_targets(items).persist()
    rate = {r.source: r.target / r.source_size for r in targets.collect()}
    taken = np.zeros(600)
    for seed in range(8):
        for r in mixing.copies(items, targets, fan=16, reserve=4, seed=1000 * seed).collect():
            taken[r.doc_id] += r.copies
    for s, part in (("s", taken[:300]), ("t", taken[300:])):
        assert abs(part.mean() / 8 - rate[s]) < 0.15


def test_mixed_rows_are_rows(odd, none):
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    copies = {}
    for r in mixing.mix(odd).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    found = {}
    for r in rows.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in copies.items() if v}
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


# Pipeline


def test_pipeline_stages_take_odd_rows(spark, sf_dir, odd, none):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (odd, none):
            out = stage(spark, rows, sf_dir)
            found, given = out.collect(), rows.collect()
            if k == len(corpus_pipeline.STAGES) - 1:
                assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in given) and all(r.round_trip for r in found)
                continue
            assert out.columns == rows.columns
            times, there = Counter(map(tuple, found)), Counter(map(tuple, given))
            most = 2 if k == 3 else 1  # the mix takes a document twice at most
            assert all(n <= most * there[r] for r, n in times.items())
            if k == 2:  # one of each text, odd ones too
                assert {r.text for r in found} - {None, "", " \n\t "} == {r.text for r in given} - {None, "", " \n\t "}
            if k == 3:
                assert all((r.text or "").split() for r in found)


def test_pipeline_runs_and_filters(spark, sf_dir, docs):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in out}
    assert kept < known and all(r.round_trip for r in out)
    assert not [k for k in kept if labels.get(k) == 0]
    good = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    left = corpus_pipeline.STAGES[1][1](spark, good, sf_dir)
    assert left.count() >= 0.99 * good.count()


def test_decoded_takes_any_ids_and_columns(spark):
    ids = sentencepiece_nbest.encoded(spark.createDataFrame([(1, "so it is")], "doc_id long, text string")).first().pieces
    rows = [(1, ids, "old"), (2, [*ids, 10**9, None, -1], "old"), (3, [], "old"), (4, None, "old")]
    table_ = spark.createDataFrame([(*r, "u", "b") for r in rows], "doc_id long, pieces array<long>, decoded string, `meta.url` string, `a``b` string")
    got = sentencepiece_nbest.decoded(table_)
    assert got.columns == ["doc_id", "pieces", "meta.url", "a`b", "decoded"]
    assert {r.doc_id: r.decoded for r in got.collect()} == {1: "so it is", 2: "so it is���", 3: "", 4: None}
    assert sentencepiece_nbest.decoded(table_.limit(0)).count() == 0


@pytest.mark.parametrize("most", (0, 1_000_000))
def test_mix_and_stages_handle_each_text_once(spark, monkeypatch, most):
    """No window shuffles the texts to pick rows, whether keys are broadcast or not, and no stage sends one to Python twice."""
    monkeypatch.setattr(mixing, "TAKEN", most)
    docs = spark.createDataFrame([(k // 2, f"s{k % 3}", "a b c " * (k % 7), k, "x") for k in range(60)], "doc_id long, source string, Text string, copies int, row_key string")
    found = mixing.mixed_rows(docs)
    want = {(r.doc_id, r.source, r.size): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = dict.fromkeys(want, 0)
    for r in found.collect():
        got[r.doc_id, r.source, len((r.Text or "").split())] += 1
    assert got == want and found.columns == docs.columns
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    for out in (language_id.predict(docs, {}), quality.with_statistics(docs, *docs.columns), sentencepiece_nbest.encoded(docs)):
        analyzed = out._jdf.queryExecution().analyzed().toString()
        assert "__text" not in analyzed and [r[3] for r in out.select(*docs.columns).collect()] == [r[3] for r in docs.collect()]
