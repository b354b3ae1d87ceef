"""Resampling by blocks of sequences: exact sizes, no replicate lost, and sums equal to those of plain loops."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from stepweave.operators import model, patterns, prepare, replicates, resample
from stepweave.operators.sequences import Sequences, from_frame


def seqs(spark, texts, groups=None):
    rows = [(k, p, None if s == "." else s, groups[k] if groups else None) for k, text in enumerate(texts) for p, s in enumerate(text)]
    frame = spark.createDataFrame(rows, "seq_id long, raw_pos int, state string, grp string")
    return Sequences(frame, groups=("grp",) if groups else ())


def texts(n, states="ABCD", longest=9, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(states), rng.integers(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutations_are_permutations(n):
    found = replicates.permuted(np.arange(n), n, range(7), 3)
    assert (np.sort(found, 1) == np.arange(n)).all()
    some = np.arange(0, n, 3)
    assert (replicates.permuted(some, n, range(2, 7), 3) == found[2:, some]).all()


def test_permutations_are_even_handed():
    n, reps = 6, 6000
    found = replicates.permuted(np.arange(n), n, range(reps), 1)
    for at in range(n):
        assert np.abs(np.bincount(found[:, at], minlength=n) / reps - 1 / n).max() < 0.02
    pairs = Counter(tuple(np.flatnonzero(row < 2)) for row in found)
    assert set(pairs) == set(combinations(range(n), 2)) and max(abs(c / reps - 1 / 15) for c in pairs.values()) < 0.02


def test_draws_are_as_many_as_sequences():
    n, reps = 100, range(400)
    blocks = [replicates.multiplicities(first, n, reps, 5, block=16) for first in range(0, n, 16)]
    m = np.concatenate(blocks, 1)
    assert m.shape == (400, n) and (m.sum(1) == n).all()
    assert np.abs(m.mean(0) - 1).max() < 0.25 and abs(m.var() - 0.99) < 0.03
    off = np.corrcoef(m.T)[~np.eye(n, dtype=bool)]
    assert abs(off.mean() + 1 / 99) < 0.004 and np.abs(off).max() < 0.25


def plain_counts(text, type_, size=None):
    out = Counter()
    if type_ == "relative":
        out.update((a, b) for a, b in zip(text, text[1:]) if a != "." and b != ".")
    else:
        blocks = [text[k : k + size] for k in range(0, len(text), size)]
        out.update((a, b) for block in blocks for a in block for b in block if a != "." and b != ".")
    return out


def normalised(counts, labels, type_):
    w = np.array([[counts.get((a, b), 0) for b in labels] for a in labels], float)
    sums = w.sum(1, keepdims=True)
    return np.divide(w, sums, out=np.zeros_like(w), where=sums > 0) if type_ == "relative" else w


@pytest.mark.parametrize("type_", ["relative", "co-occurrence"])
def test_bootstrap_weights_are_those_of_its_draws(spark, monkeypatch, type_):
    monkeypatch.setattr(replicates, "AT_ONCE", 4)
    monkeypatch.setattr(replicates, "HELD", 50)
    monkeypatch.setattr(replicates, "BLOCK", 16)
    data = [*texts(60), "", "A", "."]
    data = [t for t in data if t]
    params = {"windowed": True, "window_size": 2, "window_span": 2} if type_ == "co-occurrence" else {}
    m = model.build_model(seqs(spark, data), type_, **params)
    found = resample.bootstrap_draws(m, 10, 4).collect()
    labels, n = list("ABCD"), len(data)
    assert len(found) == 10 * 16
    got = np.zeros((10, 4, 4))
    for r in found:
        got[r.rep, labels.index(r.from_state), labels.index(r.to_state)] = r.weight
    own = [plain_counts(t, type_, 4) for t in data]
    for rep in range(10):
        first = rep // 4 * 4
        reps = range(first, min(first + 4, 10))
        m_ = np.concatenate([replicates.multiplicities(at, n, reps, 4, 0, 16) for at in range(0, n, 16)], 1)[rep - first]
        total = Counter()
        for c, times in zip(own, m_.tolist()):
            for k, v in c.items():
                total[k] += v * times
        assert got[rep] == pytest.approx(normalised(total, labels, type_))


def test_windowed_models_keep_their_windows(spark):
    data = ["ABAB"] * 10 + ["BABA"] * 10
    m = model.ctna(seqs(spark, data), windowed=True, window_size=2, window_span=1)
    once = spark.createDataFrame([(0, k, 1) for k in range(20)], "rep int, seq_id long, m long")
    again = {(r.from_state, r.to_state): r.weight for r in resample.bootstrap_weights(m, 1, draws=once).collect()}
    assert again == {(r.from_state, r.to_state): r.weight for r in m.weights.collect()}
    same = resample.permutation_test_models(m, m, 8)[0].collect()
    assert len(same) == 4 and all(r.diff == 0 for r in same)
    other = model.ctna(seqs(spark, data), windowed=True, window_size=4, window_span=1)
    with pytest.raises(ValueError, match="same parameters"):
        resample.permutation_test_models(m, other, 8)
    with pytest.raises(ValueError, match="can't be resampled"):
        resample.bootstrap_tna(model.atna(seqs(spark, data)), 4)


def test_no_replicate_is_lost(spark):
    m = model.tna(seqs(spark, ["AB", "C"]))
    found = resample.bootstrap_weights(m, 50, resample.poisson_multiplicity("seq_id", "rep"))
    assert found.select("rep").distinct().count() == 50 and found.count() == 450
    exact = resample.bootstrap_tna(m, 50)
    assert exact.weights.select("rep").distinct().count() == 50
    assert resample.bootstrap_tna(model.tna(seqs(spark, ["AB"])), 50).edges.where("from_state = 'A' and to_state = 'B'").first()["mean"] == 1.0


def test_groups_are_drawn_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(replicates, "BLOCK", 8)
    data, groups = texts(50, "AB"), ["g", "h", "g", "h", "h"] * 10
    m = model.ftna(seqs(spark, data, groups))
    found = resample.bootstrap_draws(model.build_model(seqs(spark, ["AA"] * 50, groups), "frequency"), 30).collect()
    sizes = Counter(groups)
    assert len(found) == 60 and all(r.weight == sizes[r.grp] for r in found)  # one pair each: as many as sequences
    assert resample.bootstrap_tna(m, 5).weights.groupBy("grp", "rep").count().count() == 10


def test_sequences_are_modelled_before_they_are_drawn(spark):
    found = resample.bootstrap_tna(seqs(spark, ["ABAB", "BA"] * 5), 20)
    assert found.edges.count() == 4


def test_permutations_keep_the_sides(spark, monkeypatch):
    monkeypatch.setattr(replicates, "BLOCK", 8)
    monkeypatch.setattr(replicates, "AT_ONCE", 16)
    x, y = model.ftna(seqs(spark, ["AA"] * 30)), model.ftna(seqs(spark, ["AA"] * 13))
    kept = []
    monkeypatch.setattr(resample, "_tested_sides", lambda found, again, *a: kept.append((found.collect(), again.collect())) or (found, None))
    resample.permutation_test_models(x, y, 40)
    found, again = kept[0]
    assert {r.side: r.weight for r in found} == {"x": 30, "y": 13}
    assert len(again) == 80 and {(r.side, r.weight) for r in again} == {("x", 30), ("y", 13)}


def test_pairs_change_sides_together(spark, monkeypatch):
    n = 40
    a, b = model.ftna(seqs(spark, ["AB"] * n)), model.ftna(seqs(spark, ["BA"] * n))
    kept = []
    monkeypatch.setattr(resample, "_tested_sides", lambda found, again, *o: kept.append(again.collect()) or (found, None))
    resample.permutation_test_models(a, b, 60, paired=True)
    ab = {r.rep: r.weight for r in kept[0] if r.side == "x" and r.from_state == "A" and r.to_state == "B"}
    ba = {r.rep: r.weight for r in kept[0] if r.side == "x" and r.from_state == "B" and r.to_state == "A"}
    assert all(ab[r] + ba[r] == n for r in range(60)) and abs(np.mean(list(ab.values())) - n / 2) < 2 and len(set(ab.values())) > 5


def test_shares_are_exact_and_nested(spark, monkeypatch):
    monkeypatch.setattr(replicates, "BLOCK", 8)
    n = 37
    data = [chr(65 + k % 3) + chr(65 + (k + 1) % 3) for k in range(n)]
    m = model.build_model(seqs(spark, data), "frequency")
    kept = []
    monkeypatch.setattr(resample, "_stability_of", lambda model_, weights, *a, **o: kept.append(weights.collect()) or weights.selectExpr("prop", "rep", "from_state as measure", "0d as corr"))
    resample.estimate_cs(m, 12)
    sums = Counter()
    for r in kept[0]:
        sums[r.prop, r.rep] += r.weight
    assert len(sums) == 108 and all(total == n - int(np.floor(n * prop)) for (prop, _), total in sums.items())
    cell = {(r.prop, r.rep, r.from_state, r.to_state): r.weight for r in kept[0]}
    assert all(cell[p, rep, a, b] >= cell[q, rep, a, b] for (p, rep, a, b) in cell for q in (0.9,))


def test_stability_in_one_call(spark):
    m = model.tna(seqs(spark, ["ABCA", "BCAB", "CABD", "AABC", "BBCD"] * 12))
    found = resample.estimate_cs(m, 20)
    assert found.correlations.count() == 9 * 20 * 3
    assert {r.measure for r in found.coefficients.collect()} == {"OutStrength", "InStrength", "Betweenness"}
    with pytest.raises(ValueError, match="one group"):
        resample.estimate_cs(model.tna(seqs(spark, ["AB"] * 4, ["g", "h"] * 2)), 2)


def test_null_groups_change_nothing(spark):
    data, groups = texts(60, "AB"), ["g", "h"] * 30
    plain = seqs(spark, data, groups)
    odd = seqs(spark, [*data, *texts(30, "AB", seed=2)], [*groups, *[None] * 30])
    ids = plain.frame.select("seq_id").distinct().collect()
    rng = np.random.default_rng(1)
    again = spark.createDataFrame([(rep, r.seq_id, str(rng.choice(["g", "h"]))) for rep in range(10) for r in ids], "rep int, seq_id long, grp string")
    both = [sorted(map(tuple, patterns.permutation_test(s, "grp", again, (1, 2), 0).collect())) for s in (plain, odd)]
    assert both[0] == both[1] and len(both[0]) == 6
    assert patterns.compare(odd, "grp", (1, 2)).collect() == patterns.compare(plain, "grp", (1, 2)).collect()


@pytest.mark.parametrize("least", [1, 3, 12])
def test_compared_patterns_grow_level_by_level(spark, least):
    data, groups = [t + "." + u for t, u in zip(texts(80, "ABCDE"), texts(80, "ABC", seed=4))], ["g", "h"] * 40
    runs, totals = Counter(), Counter()
    for t, g in zip(data, groups):
        for k in range(1, 6):
            for at in range(len(t) - k + 1):
                if "." not in t[at : at + k]:
                    runs[k, "->".join(t[at : at + k]), g] += 1
                    totals[k, g] += 1
    want = [(p, k, g, n, n / totals[k, g]) for (k, p, g), n in runs.items() if min(runs[k, p, "g"], runs[k, p, "h"]) >= least]
    got = [tuple(r) for r in patterns.compare(seqs(spark, data, groups), "grp", min_freq=least).collect()]
    assert [g[:4] for g in got] == sorted((w[:4] for w in want), key=lambda w: (w[1], w[0], w[2]))
    assert dict((g[:3], g[4]) for g in got) == pytest.approx(dict((w[:3], w[4]) for w in want))


def test_candidates_are_runs_whose_parts_passed(spark):
    s = seqs(spark, ["ABCABC" + x for x in "DEFGHI"] * 10, ["g", "h"] * 30)
    runs = patterns._runs(s, "grp", 3)
    assert {tuple(r.run): r.n for r in runs.where("grp = 'g'").collect()}["A", "B", "C"] == 60
    counted = {k: {r.pattern for r in rows.collect()} for k, rows, _ in patterns._levels(runs, "grp", 2, 3, 15)}
    assert counted[2] == {"A->B", "B->C", "C->A"} and counted[3] == {"A->B->C", "B->C->A", "C->A->B"}


def test_patterns_are_tested_in_one_call(spark, monkeypatch):
    monkeypatch.setattr(replicates, "BLOCK", 16)
    data, groups = ["ABAB"] * 40 + ["ACAC"] * 25 + texts(15), ["g"] * 40 + ["h"] * 25 + ["i"] * 15
    found = patterns.permuted_patterns(seqs(spark, data, groups), "grp", 60, (1, 2), 0)
    rows = found.collect()
    assert [r.p_adjusted for r in rows] == sorted(r.p_adjusted for r in rows)
    by = {r.pattern: r for r in rows}
    real = {r.pattern: r.statistic for r in patterns.statistic(patterns.occurrences(seqs(spark, data, groups), (1, 2)).groupBy("length", "pattern", "grp").count().withColumnRenamed("count", "n"), "grp").collect()}
    assert {p: r.statistic for p, r in by.items()} == pytest.approx(real)
    assert by["A->B"].p_value == pytest.approx(1 / 61) and by["A->B"].effect_size > 3


def test_bootstraps_take_models_logs_and_frames(spark):
    data = texts(60)
    wide = spark.createDataFrame([tuple(t.ljust(8, ".").replace(".", "\0")) for t in data], [f"a.{k}" for k in range(8)]).replace("\0", None)
    log = spark.createDataFrame([(k, p, s) for k, t in enumerate(data) for p, s in enumerate(t)], "who long, place int, what string")
    log = prepare.prepare(log, action="what", actor="who", order="place")
    edges = lambda rows: {(r.from_state, r.to_state): r.weight for r in rows.collect()}
    for type_, scaling in (("relative", None), ("frequency", "max")):
        want = edges(model.build_model(seqs(spark, data), type_, scaling).weights)
        for given in (seqs(spark, data), log, wide):
            found = resample.bootstrap_tna(given, 12, type_=type_, scaling=scaling)
            assert edges(found.edges) == pytest.approx(want)
            assert found.weights.select("rep").distinct().count() == 12
    assert edges(resample.bca_edges(wide, 12)) == pytest.approx(edges(model.tna(seqs(spark, data)).weights))
    assert from_frame(wide.limit(0)).labels().count() == 0
    with pytest.raises(ValueError):
        resample.bootstrap_tna(model.from_matrix(log.long.selectExpr("state as from_state", "state as to_state", "1 as weight").distinct()), 5)


def test_replicates_get_a_row_for_each_place_and_not_for_each_length(spark, monkeypatch):
    given = []

    def seen(own, *rest):
        given.append(own.count())
        return summed(own, *rest)

    summed = patterns.summed
    monkeypatch.setattr(patterns, "summed", seen)
    data, groups = ["ABCAB", "BCA", "A.BC", "CCB", "AB"] * 4, ["x", "y"] * 10
    found = {(r.length, r.pattern) for r in patterns.permuted_patterns(seqs(spark, data, groups), "grp", 6, (1, 2, 3), 0).collect()}
    states = [x for d in data for x in d.split(".")]
    assert found == {(k, "->".join(x[i : i + k])) for x in states for k in (1, 2, 3) for i in range(len(x) - k + 1)}
    assert given == [given[0]] and given[0] <= sum(map(len, states))
