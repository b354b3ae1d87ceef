"""Preparation, models, scalings, patterns, clusters and resampling on small tables with results worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.functions import editing, palette, stats
from stepweave.operators import clustering, model, patterns, plotdata, prepare, resample, scaling, sequences, transitions
from stepweave.streaming import sessions as streaming


def seqs(spark, rows, width=None, groups=None):
    """Sequences of strings of one-letter states; a dot is a missing one."""
    n = width or max(map(len, rows))
    frame = [(k, *((list(r) + ["."] * n)[:n]), *([groups[k]] if groups else [])) for k, r in enumerate(rows)]
    columns = [f"T{k + 1}" for k in range(n)]
    schema = "seq_id long, " + ", ".join(f"{c} string" for c in columns) + (", grp string" if groups else "")
    return sequences.from_wide(spark.createDataFrame(frame, schema), columns, "seq_id", ("grp",) if groups else (), missing=(".",))


def weights(m):
    return {(r.from_state, r.to_state): r.weight for r in m.weights.collect()}


def log(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(0), "a"), (1, at(900), "b"), (1, at(1801), "c"), (2, at(5), "a"), (2, at(6), "a"), (1, None, "x")]
    return spark.createDataFrame(rows, "user long, time timestamp, action string")


def test_a_gap_of_the_threshold_stays_in_the_session(spark):
    rows = log(spark).where("time is not null")
    found = prepare.prepare(rows, "action", "user", "time").long.orderBy("actor", "ts").select("session_id", "raw_pos", "state").collect()
    assert [tuple(r) for r in found] == [("1_1", 0, "a"), ("1_1", 1, "b"), ("1_2", 0, "c"), ("2_1", 0, "a"), ("2_1", 1, "a")]


def test_statistics_and_wide_form(spark):
    p = prepare.prepare(log(spark).where("time is not null"), "action", "user", "time")
    assert p.statistics().first().asDict() == {"n_sessions": 3, "n_actors": 2, "n_events": 5, "n_unique_actions": 3, "max_length": 2, "mean_length": 5 / 3}
    assert {tuple(r) for r in p.sequence_data(2).collect()} == {("1_1", "a", "b"), ("1_2", "c", None), ("2_1", "a", "a")}


def test_no_actor_no_time_and_empty_log(spark):
    rows = log(spark).where("time is not null")
    assert prepare.prepare(rows, "action").long.select("session_id").distinct().collect()[0][0] == 0
    ranked = prepare.prepare(spark.createDataFrame([(u, "a") for u in ("c", "b", "a", "b", None)], "user string, action string"), "action", "user").long
    assert sorted((r.actor or "", r.session_id) for r in ranked.where("actor is not null").collect()) == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]
    assert ranked.where("actor is null and session_id is null").count() == 1
    assert prepare.prepare(rows.where("false"), "action", "user", "time").long.count() == 0


def test_actors_of_several_columns_and_times_of_several_kinds(spark):
    rows = spark.createDataFrame([("u", None, 1000, "2024-02-01 10:00", "a")], "x string, y string, t long, s string, action string")
    assert prepare.prepare(rows, "action", ["x", "y"]).long.first()["actor"] == "u_None"
    got = rows.select(
        prepare.parsed_time(F.col("t"), is_unix_time=True).cast("double"), prepare.parsed_time(F.col("t"), is_unix_time=True, unix_time_unit="ms").cast("double"),
        prepare.parsed_time(F.col("t"), is_unix_time=True, unix_time_unit="moons").cast("double"), F.date_format(prepare.parsed_time(F.col("s"), "%Y-%m-%d %H:%M"), "yyyyMMddHH"),
    ).first()
    assert tuple(got) == (1000.0, 1.0, 1000.0, "2024020110")


def test_relative_and_initial_probabilities(spark):
    m = model.tna(seqs(spark, ["ABC", "ABA", "BCA", "CAB"]))
    w = weights(m)
    assert w["A", "B"] == 1.0 and w["B", "C"] == pytest.approx(2 / 3) and w["C", "A"] == 1.0 and w["C", "C"] == 0.0
    assert {r.state: r.prob for r in m.inits.collect()} == {"A": 0.5, "B": 0.25, "C": 0.25}
    assert m.summary().first()["n_states"] == 3


def test_holes_are_bridged_by_models(spark):
    assert weights(model.ftna(seqs(spark, ["A.B", ".AB"])))["A", "B"] == 2.0


def test_one_state_and_one_column(spark):
    m = model.tna(seqs(spark, ["AA"]))
    assert weights(m) == {("A", "A"): 1.0} and m.inits.first()["prob"] == 1.0
    assert set(weights(model.tna(seqs(spark, ["A", "B"]))).values()) == {0.0}


def brute(rows, type_, **o):
    """Counts by the definitions, place by place."""
    out = {}
    for r in rows:
        s = [c for c in r if c != "."]
        n = len(s)
        pairs = [(p, q) for p in range(n) for q in range(p + 1, n)]
        add = lambda a, b, v=1.0: out.__setitem__((a, b), out.get((a, b), 0) + v)  # noqa: B023, E731
        for p, q in pairs:
            d = q - p
            if type_ == "reverse" and d == 1:
                add(s[q], s[p])
            elif type_ == "n-gram" and d == o["n"] - 1:
                add(s[p], s[q])
            elif type_ == "gap" and d <= o["max_gap"]:
                add(s[p], s[q], o["decay"] ** (d - 1))
            elif type_ == "window":
                for _ in range(sum(k <= p and q < k + o["size"] for k in range(n - o["size"] + 1))):
                    add(s[p], s[q])
            elif type_ == "attention":
                add(s[p], s[q], math.exp(-o["beta"] * d))
            elif type_ == "co-occurrence":
                add(s[p], s[q])
                if s[p] != s[q]:
                    add(s[q], s[p])
    return out


@pytest.mark.parametrize(("type_", "options"), [("reverse", {}), ("n-gram", {"n": 3}), ("gap", {"max_gap": 3, "decay": 0.5}), ("window", {"size": 3}), ("attention", {"beta": 0.7}), ("co-occurrence", {})])
def test_counts_agree_with_the_definitions(spark, type_, options):
    rng = np.random.default_rng(1)
    rows = ["".join(rng.choice(list("ABC."), rng.integers(1, 9))) for _ in range(40)]
    found = {(r.from_state, r.to_state): r.n for r in transitions.counts(seqs(spark, rows), type_, **options).collect()}
    want = brute(rows, type_, **options)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v) for k, v in want.items())


def test_windowed_co_occurrence_counts_all_ordered_pairs_of_a_block(spark):
    found = {(r.from_state, r.to_state): r.n for r in transitions.counts(seqs(spark, ["AB.A"]), "co-occurrence", windowed=True, window_size=2, window_span=1).collect()}
    assert found == {("A", "A"): 2.0, ("A", "B"): 1.0, ("B", "A"): 1.0, ("B", "B"): 1.0}


def test_groups_share_labels_and_can_be_renamed(spark):
    m = model.group_tna(seqs(spark, ["AB", "CC"], groups=["x", "y"]), "grp")
    assert m.weights.count() == 2 * 9
    assert {r[0] for r in m.renamed({"x": "one", "y": "two"}).names().collect()} == {"one", "two"}
    with pytest.raises(ValueError):
        m.renamed({"x": "same", "y": "same"})


def test_scalings(spark):
    cells = spark.createDataFrame([("A", "A", 0.0), ("A", "B", 2.0), ("B", "A", 2.0), ("B", "B", 4.0)], "from_state string, to_state string, weight double")
    got = lambda df: [r.weight for r in df.orderBy("from_state", "to_state").collect()]
    assert got(scaling.minmax_scale(cells)) == [0, 0.5, 0.5, 1] and got(scaling.max_scale(cells)) == [0, 0.5, 0.5, 1]
    assert got(scaling.rank_scale(cells)) == [0, 2.5, 2.5, 4]
    assert got(scaling.apply_scaling(cells, ["RANK", "max"])) == [0, 0.625, 0.625, 1]
    assert got(scaling.prune(cells, 2.0)) == [0, 2, 2, 4]
    with pytest.raises(ValueError):
        scaling.apply_scaling(cells, "cubic")


def test_begin_end_and_glued(spark):
    both = sequences.bounded(seqs(spark, ["AB", "A"]), "in", "out")
    assert {tuple(r) for r in both.frame.where("seq_id = 1 and state is not null").select("raw_pos", "state").collect()} == {(-1, "in"), (0, "A"), (2, "out")}
    assert sequences.ordered_labels(["b", "a"], "in", "out") == ["in", "a", "b", "out"]
    glue = sequences.glued(seqs(spark, ["AB", "C"]), "seq_id", 2, 2)
    assert [tuple(r) for r in glue.present().orderBy("raw_pos").select("seq_id", "raw_pos", "state").collect()] == [(0, 0, "A"), (0, 1, "B"), (0, 2, "C")]


@pytest.mark.parametrize(("type_", "size", "aggregate", "want"), [
    ("tumbling", 2, False, [(0, 0, "A"), (0, 2, "A"), (0, 3, "B"), (1, 5, "B")]), ("tumbling", 2, True, [(0, 0, "A"), (0, 1, "B"), (1, 3, "B")]), ("sliding", 2, False, [(0, 0, "A"), (0, 1, "B"), (1, 2, "A"), (1, 3, "B")]),
])
def test_onehot_windows(spark, type_, size, aggregate, want):
    rows = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 1)], "n long, A int, B int")
    found, _ = prepare.onehot(rows, ["A", "B"], ["n"], window_size=size, window_type=type_, aggregate=aggregate)
    assert [tuple(r) for r in found.present().orderBy("raw_pos").select("w", "raw_pos", "state").collect()] == want


def test_onehot_checks(spark):
    rows = spark.createDataFrame([(0, 2)], "n long, A int")
    for columns in (["A"], ["B"]):
        with pytest.raises(ValueError):
            prepare.checked_onehot(rows, columns)
    with pytest.raises(ValueError):
        prepare.onehot(rows, ["A"], ["n"], window_type="jumping")


def test_patterns_stop_at_holes_and_need_every_group(spark):
    s = seqs(spark, ["ABAB", "A.B", "ABB", "BAB"], groups=["x", "x", "y", "y"])
    found = {(r.pattern, r.grp): r.freq for r in patterns.compare(s, "grp", (1, 2), 2).collect()}
    assert found == {("A", "x"): 3, ("A", "y"): 2, ("B", "x"): 3, ("B", "y"): 4, ("A->B", "x"): 2, ("A->B", "y"): 2}
    with pytest.raises(TypeError):
        patterns.compare(seqs(spark, ["AB"]), "grp")


def test_edit_distances():
    assert (editing.lv(list("ABC"), list("ABC")), editing.lv(list("AB"), list("AXB")), editing.lv(list("kitten"), list("sitting"))) == (2, 2, 2)
    assert editing.osa(list("AB"), list("BA")) == 0 and editing.lcs(list("ABCD"), list("ACBD")) == 1


def test_edit_distances_of_blocks_are_those_of_plain_tables(monkeypatch):
    rng = np.random.default_rng(3)
    rows = ["".join(rng.choice(list("ABC*"), rng.integers(0, 9))) for _ in range(40)]
    monkeypatch.setattr(editing, "CELLS", 900)  # several chunks

    def plain(metric, a, b):
        a, b = a.rstrip("*"), b.rstrip("*")
        d = {(i, j): (0 if metric == "lcs" else i + j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                if metric == "lcs":
                    d[i, j] = d[i - 1, j - 1] + 1 if same else max(d[i - 1, j], d[i, j - 1])
                    continue
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + same)
                if metric == "osa" and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + same)
        return max(len(a), len(b)) - d[len(a), len(b)] if metric == "lcs" else d[len(a), len(b)]

    for metric in ("lv", "osa", "lcs"):
        got = editing.edit_distances(metric, [list(r) for r in rows], [list(r) for r in rows[:25]])
        assert (got == np.array([[plain(metric, a, b) for b in rows[:25]] for a in rows])).all()
    assert editing.edit_distances("lv", [], [["A"]]).shape == (0, 1)


def merged_pair_by_pair(d, k, linkage):
    """The first closest pair of all, again and again."""
    n, members = len(d), {i: [i] for i in range(len(d))}
    d, sizes, made = d.astype(float) ** (2 if linkage == "ward.D2" else 1), np.ones(n), {}
    for step in range(n - k):
        alive = sorted(members)
        i, j = min(((x, y) for x in alive for y in alive if x < y), key=lambda p: (d[p], p))
        ni, nj, dij = sizes[i], sizes[j], d[i, j]
        for m in set(alive) - {i, j}:
            a, b, nm = d[m, i], d[m, j], sizes[m]
            d[i, m] = d[m, i] = {
                "single": min(a, b), "complete": max(a, b), "average": (ni * a + nj * b) / (ni + nj), "mcquitty": (a + b) / 2, "median": (a + b) / 2 - dij / 4,
                "centroid": (ni * a + nj * b) / (ni + nj) - ni * nj * dij / (ni + nj) ** 2,
            }.get(linkage, ((ni + nm) * a + (nj + nm) * b - nm * dij) / (ni + nj + nm))
        members[i] += members.pop(j)
        sizes[i], made[i] = sizes[i] + nj, step
    out = np.empty(n, int)
    for number, c in enumerate(sorted(members, key=lambda c: (c in made, made.get(c, c)))):
        out[members[c]] = number
    return out


@pytest.mark.parametrize("linkage", editing.LINKAGES)
@pytest.mark.parametrize("ties", [False, True])
def test_linkages_merge_the_first_closest_pair(linkage, ties):
    rng = np.random.default_rng(6)
    for n in (2, 3, 17, 40):
        x = rng.integers(0, 4, (n, 3)).astype(float) if ties else rng.standard_normal((n, 3))
        d = np.abs(x[:, None] - x).sum(2)
        for k in {1, 2, n // 2 or 1, n}:
            assert (editing.hierarchical(d.copy(), k, linkage) == merged_pair_by_pair(d, k, linkage)).all()


def test_hamming_and_clusters(spark):
    s = seqs(spark, ["AAA"] * 4 + ["BBB"] * 4)
    d = {(r.i, r.j): r.d for r in clustering.distances(s, "hamming", blocks=3).collect()}
    assert len(d) == 28 and d[0, 1] == 0 and d[0, 7] == 3
    for method in ("pam", *editing.LINKAGES):
        found = clustering.cluster_sequences(s, 2, method=method)
        member = {r.id: r.cluster for r in found.assignments.collect()}
        assert len({member[k] for k in range(4)}) == 1 and member[0] != member[7] and found.sizes == [4, 4], method
        assert found.silhouette == 1.0
    for bad in ({"k": 1}, {"k": 9}, {"k": 2, "method": "guess"}, {"k": 2, "dissimilarity": "taste"}):
        with pytest.raises(ValueError):
            clustering.cluster_sequences(s, **bad)


def test_weighted_hamming_and_symbols_for_missing(spark):
    s = seqs(spark, ["AB", "AX"])
    assert clustering.distances(s, weighted=True).first()["d"] == pytest.approx(math.exp(-1))
    assert clustering.distances(seqs(spark, ["A*", "A%"])).first()["d"] == 0


def test_adjusted_p_values(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.04, 0.03, None])], "k int, p_value double")
    got = lambda m: [r.p_adjusted and round(r.p_adjusted, 9) for r in stats.p_adjust(rows, method=m).orderBy("k").collect()]
    assert got("none") == [0.01, 0.04, 0.03, None] and got("bonferroni") == [0.03, 0.12, 0.09, None]
    assert got("holm") == [0.03, 0.06, 0.06, None] and got("fdr") == got("BH") == [0.03, 0.04, 0.04, None]


def test_bootstrap_of_equal_sequences_has_no_spread(spark):
    m = model.tna(seqs(spark, ["ABA"] * 6))
    draws = resample.drawn(spark, list(range(6)), 20, 1)
    rows = {(r.from_state, r.to_state): r for r in resample.bootstrap(m, resample.bootstrap_weights(m, 20, draws=draws)).collect()}
    assert rows["A", "B"].mean == 1.0 and rows["A", "B"].sd == 0.0 and rows["A", "B"].p_value == pytest.approx(1 / 21) and rows["A", "B"].sig
    # an edge of weight zero is beyond both ends of its range in every replicate
    assert rows["A", "A"].p_value == pytest.approx(41 / 21)


def test_permutation_finds_what_differs(spark):
    s = seqs(spark, ["AB"] * 30 + ["AC"] * 30)
    ids = list(range(60))
    real = spark.createDataFrame([(k, "x" if k < 30 else "y") for k in ids], "seq_id long, side string")
    again = resample.shuffled(spark, ids, ["x"] * 30 + ["y"] * 30, 50, 3)
    edges, none = resample.permutation_test(s, "relative", real, again, "x", "y")
    rows = {(r.from_state, r.to_state): r for r in edges.collect()}
    assert none is None and rows["A", "B"].diff == 1.0 and rows["A", "B"].p_value < 0.05 and rows["B", "A"].diff == 0.0 and rows["B", "A"].effect_size is None


def test_intervals():
    low, high = stats.bca_ci(np.arange(50.0), np.mean, 300, seed=1)
    assert low < 24.5 < high


def test_stability_of_whole_samples_is_one(spark):
    m = model.tna(seqs(spark, ["ABC", "BCA", "CAB", "AAB", "BBC"]))
    kept = spark.createDataFrame([(0.1, 0, k) for k in range(5)], "prop double, rep int, seq_id long")
    found = resample.stability(m, kept, ("OutStrength", "InStrength"))
    assert all(r["corr"] == pytest.approx(1.0) for r in found.collect())
    assert {r.measure: r.cs for r in resample.cs_coefficients(found).collect()} == {"OutStrength": 0.1, "InStrength": 0.1}


def test_colours_and_histogram(spark):
    assert len(set(palette.color_palette(12))) == 12 and set(palette.create_color_map(["a", "b"])) == {"a", "b"}
    rows = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,)], "weight double")
    assert [r.n for r in plotdata.histogram(rows, bins=4, positive=False).orderBy("bin").collect()] == [1, 1, 1, 1]
    assert [r.n for r in plotdata.histogram(rows, bins=3).orderBy("bin").collect()] == [1, 1, 1]


def test_saved_models_come_back(spark, tmp_path):
    m = model.tna(seqs(spark, ["ABC"]))
    m.save(str(tmp_path))
    assert weights(model.load(spark, str(tmp_path), "relative")) == weights(m)


def test_attention_over_blocks_is_the_sum_over_all_pairs(spark):
    """Sequences of several blocks of 666 places, and steep decays that start a new one every 3."""
    rng, beta = np.random.default_rng(1), 0.9
    states = ["".join(rng.choice(list("ABC"), n)) for n in (1500, 30, 1, 601, 1333)]
    frame = spark.createDataFrame([(k, i, c) for k, row in enumerate(states) for i, c in enumerate(row)], "seq_id long, raw_pos int, state string")
    got = {(r.from_state, r.to_state): r.n for r in transitions.attention(sequences.Sequences(frame), beta).collect()}
    want = {}
    for row in states:
        held = dict.fromkeys("ABC", 0.0)
        for c in row:
            held = {s: v * math.exp(-beta) for s, v in held.items()}
            for s, v in held.items():
                want[s, c] = want.get((s, c), 0.0) + v
            held[c] += 1
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())
    steep = {(r.from_state, r.to_state): r.n for r in transitions.attention(seqs(spark, ["ABCABCAB"]), 200.0).collect()}
    assert steep["A", "B"] == pytest.approx(3 * math.exp(-200)) and steep["A", "C"] == pytest.approx(2 * math.exp(-400))
    flat = {(r.from_state, r.to_state): r.n for r in transitions.attention(seqs(spark, ["AAB"]), 0.0).collect()}
    assert flat == {("A", "A"): 1.0, ("A", "B"): 2.0}


def test_adjusted_p_values_of_ties_by_group(spark):
    values = {"a": [0.01, 0.01, 0.02, 0.02, 0.02, 0.9], "b": [0.2, 0.001, None]}
    rows = spark.createDataFrame([(g, k, p) for g, ps in values.items() for k, p in enumerate(ps)], "g string, k int, p_value double")
    for method in ("bonferroni", "holm", "fdr"):
        got = {(r.g, r.k): r.p_adjusted for r in stats.p_adjust(rows, method=method, keys=("g",)).collect()}
        for g, ps in values.items():
            known = sorted((p, k) for k, p in enumerate(ps) if p is not None)
            n, want = len(known), {}
            steps = [p * {"bonferroni": n, "holm": n - r, "fdr": n / (r + 1)}[method] for r, (p, _) in enumerate(known)]
            for r, (_, k) in enumerate(known):
                want[k] = min(1.0, {"bonferroni": steps[r], "holm": max(steps[: r + 1]), "fdr": min(steps[r:])}[method])
            assert {k: got[g, k] for k in want} == pytest.approx(want) and all(got[g, k] is None for k, p in enumerate(ps) if p is None)


def test_replicates_are_independent_poisson_draws(spark):
    """Ids that a period of the old hash tied together, and as many that it didn't: no correlation over the replicates."""
    keys = [1, 9974, 2, 9975, 3_000_000_000, 3_000_009_973, 77, 78]
    frame = spark.createDataFrame([(k,) for k in keys], "seq_id long").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(3999))))
    rows = frame.withColumn("m", resample.poisson_multiplicity("seq_id", "rep")).collect()
    m = np.zeros((len(keys), 4000))
    for r in rows:
        m[keys.index(r.seq_id), r.rep] = r.m
    assert np.abs(m.mean(1) - 1).max() < 0.06 and np.abs(m.var(1) - 1).max() < 0.12
    assert np.abs(np.corrcoef(m) - np.eye(len(keys))).max() < 0.06


def test_bootstrap_in_one_call(spark):
    m = model.tna(seqs(spark, ["ABAB", "ABBA", "BABA", "AABB"] * 10))
    found = resample.bootstrap_tna(m, 60)
    assert found.weights.select("rep").distinct().count() == 60
    assert found.summary.count() == found.edges.where("weight > 0").count() > 0
    other = resample.bootstrap_tna(m, 60, seed=1).edges
    assert other.join(found.edges.withColumnRenamed("mean", "mean0"), ["from_state", "to_state"]).where("mean <> mean0").count() > 0
    with pytest.raises(ValueError, match="no sequences"):
        resample.bootstrap_tna(model.from_matrix(spark.createDataFrame([("A", "B", 1.0)], "from_state string, to_state string, weight double")))


def test_models_are_compared_in_one_call(spark):
    x, y = seqs(spark, ["ABAC"] * 60 + ["BCAB"] * 60), seqs(spark, ["ACAB"] * 60 + ["CCBA"] * 60)
    a, b = model.tna(x), model.tna(y)
    edges, measures = resample.permutation_test_models(a, b, 40, "holm", measures=("InStrength",))
    real = weights(a)
    rows = {(r.from_state, r.to_state): r for r in edges.collect()}
    other = weights(b)
    assert all(r.diff == pytest.approx(real[k] - other[k]) for k, r in rows.items())
    assert rows["B", "C"].p_value < 0.5 and measures.count() == 3
    paired = {(r.from_state, r.to_state): r.p_value for r in resample.permutation_test_models(a, a, 40, paired=True)[0].collect()}
    assert set(paired.values()) == {1.0}
    less = sequences.Sequences(y.frame.where("seq_id > 3"), y.ids)
    with pytest.raises(ValueError, match="same ids"):
        resample.permutation_test_models(a, model.tna(less), 10, paired=True)
    with pytest.raises(ValueError, match="same states"):
        resample.permutation_test_models(a, model.tna(seqs(spark, ["AB", "BA"])), 10)
    with pytest.raises(ValueError, match="need their sequences"):
        resample.permutation_test_models(a, model.from_matrix(a.weights), 10)
    table = resample.permutation_test_edges(x, seqs(spark, ["AB", "BD"] * 60), 40, "bonferroni")
    found = {(r.from_state, r.to_state): r for r in table.collect()}
    assert len(found) == 16 and table.columns == ["from_state", "to_state", "diff", "p_value", "p_adjusted", "significant"]
    assert found["B", "D"].diff == -1.0 and all(r.p_value == r.p_adjusted and r.significant == (r.p_value < 0.05) for r in found.values())


def test_pairs_are_neighbours_or_halves(spark):
    ids, sides = list(range(8)), ["x"] * 4 + ["y"] * 4
    rows = resample.shuffled(spark, ids, sides, 30, 5, paired="halves").collect()
    side = {(r.rep, r.seq_id): r.side for r in rows}
    assert all({side[rep, k], side[rep, k + 4]} == {"x", "y"} for rep in range(30) for k in range(4)) and len(set(side[rep, 0] for rep in range(30))) == 2
    near = resample.shuffled(spark, ids, ["x", "y"] * 4, 30, 5, paired=True).collect()
    side = {(r.rep, r.seq_id): r.side for r in near}
    assert all({side[rep, k], side[rep, k + 1]} == {"x", "y"} for rep in range(30) for k in (0, 2, 4, 6))


def test_patterns_need_two_groups(spark):
    one = seqs(spark, ["ABAB"] * 9, groups=["g"] * 9)
    with pytest.raises(ValueError, match="two groups"):
        patterns.compare(one, "grp")


def test_streams_of_sessions_and_steps(spark, tmp_path):
    rows = [("u", 0, "a"), ("u", 30, "b"), ("u", 500, "c"), ("v", 10, "a"), ("v", 40, "c"), ("u", 90_000, "a")]
    for k, part in enumerate((rows[:4], rows[4:])):
        frame = spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), a) for u, s, a in part], "user string, at timestamp, action string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user string, at timestamp, action string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drained(frame, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table(name).collect()

    steps = {(r.actor, r.from_state, r.to_state) for r in drained(streaming.transitions(source, "user", "at", "action", 60, "1 day"), "steps")}
    assert steps == {("u", "a", "b"), ("v", "a", "c")}
    closed = {(r.user, r.n_events) for r in drained(streaming.sessions(source, "user", "at", "60 seconds", "1 hour"), "closed")}
    assert closed == {("u", 2), ("u", 1), ("v", 2)}
