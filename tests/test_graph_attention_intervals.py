"""Greedy modularity, label propagation, attention over many states and intervals of edges, against plain loops."""

import math
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from stepweave.functions import graph, stats
from stepweave.operators import model, network, resample, transitions
from stepweave.operators.sequences import Sequences


def symmetric(n, seed, share=0.5):
    rng = np.random.default_rng(seed)
    s = np.tril(rng.random((n, n)) * (rng.random((n, n)) < share), -1)
    return s + s.T


def greedy(s):
    """The best of all merges of two groups with an edge between, modularity anew for each."""
    member = np.arange(len(s))
    while True:
        now, groups = graph.modularity(s, member), np.unique(member)
        gains = [(graph.modularity(s, np.where(member == b, a, member)) - now, -a, -b) for k, a in enumerate(groups) for b in groups[k + 1 :] if s[np.ix_(member == a, member == b)].any()]
        if not gains or max(gains)[0] <= 1e-12:
            return member
        _, a, b = max(gains)
        member = np.where(member == -b, -a, member)


@pytest.mark.parametrize("seed", range(8))
def test_greedy_merges_are_the_best_ones(seed):
    s = symmetric(4 + 3 * seed, seed, 0.3 + 0.08 * seed)
    assert (graph.fast_greedy(s) == greedy(s)).all()


def test_greedy_merges_of_many_states():
    start = time.perf_counter()
    blocks = np.arange(300) // 30
    s = symmetric(300, 1, 0.6) * np.where(blocks[:, None] == blocks[None], 1, 0.005)
    found = graph.fast_greedy(s)
    assert time.perf_counter() - start < 20
    assert graph.modularity(s, found) >= graph.modularity(s, blocks) - 0.01
    assert (graph.fast_greedy(np.zeros((3, 3))) == [0, 1, 2]).all()


def propagated(s):
    """One node after the other, by colours: no two of a colour are neighbours, so this is all at once."""
    n, near = len(s), [np.flatnonzero(row > 0).tolist() for row in s]
    colour = {}
    for v in sorted(range(n), key=lambda v: -len(near[v])):
        colour[v] = min(set(range(n + 1)) - {colour.get(u) for u in near[v]})
    label = list(range(n))

    def best(v):
        votes = Counter(label[u] for u in near[v])
        return [x for x, c in votes.items() if c == max(votes.values())]

    while any(label[v] not in best(v) for v in range(n) if near[v]):
        for c in sorted(set(colour.values())):
            for v in (v for v in range(n) if colour[v] == c and near[v]):
                if label[v] not in best(v):
                    label[v] = max(best(v))
    return label


@pytest.mark.parametrize("seed", range(10))
def test_labels_spread_by_colours(seed):
    s = symmetric(6 + 2 * seed, seed, 0.15 + 0.03 * seed)
    assert graph.label_propagation(s).tolist() == propagated(s)
    assert all(s[nodes][:, nodes].sum() == 0 for nodes in graph._colours(s > 0))


def long(spark, texts, groups=None):
    rows = [(k, p, None if s == "." else s, groups[k] if groups else "g") for k, t in enumerate(texts) for p, s in enumerate(t)]
    return Sequences(spark.createDataFrame(rows, "seq_id long, raw_pos int, state string, grp string"), groups=("grp",) if groups else ())


@pytest.mark.parametrize("beta", [0.0, 0.7, 90.0])
def test_attention_over_many_states(spark, monkeypatch, beta):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ABCDE."), rng.integers(1, 40))) for _ in range(15)]
    groups = ["g", "h", "h"] * 5
    want = Counter()
    for t, g in zip(texts, groups):
        t = t.replace(".", "")
        for q in range(len(t)):
            for p in range(q):
                want[g, t[p], t[q]] += math.exp(-beta * (q - p))
    for wide in (64, 2):
        monkeypatch.setattr(transitions, "WIDE", wide)
        got = {(r.grp, r.from_state, r.to_state): r.n for r in transitions.attention(long(spark, texts, groups), beta).collect()}
        assert {k: v for k, v in got.items() if v > 1e-30} == pytest.approx({k: v for k, v in want.items() if v > 1e-30})


def test_the_plan_of_attention_does_not_grow_with_states(spark):
    plans = []
    for n in (100, 1000):
        rows = spark.range(2 * n).selectExpr("id div 10 as seq_id", "cast(id % 10 as int) as raw_pos", f"concat('s', id % {n}) as state")
        plan = transitions.attention(Sequences(rows))
        plans.append(len(plan._jdf.queryExecution().optimizedPlan().toString()))
        assert plan.count() > n
    assert abs(plans[0] - plans[1]) < 50


@pytest.mark.parametrize("type_", ["relative", "frequency"])
def test_intervals_of_edges_are_those_of_left_out_sequences(spark, type_):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ABC"), rng.integers(1, 8), p=[0.5, 0.3, 0.2])) for _ in range(30)] + ["CA"]
    m = model.build_model(long(spark, texts), type_)
    draws = resample.bootstrap_draws(m, 80, 3)
    boot = {}
    for r in draws.collect():
        boot.setdefault((r.from_state, r.to_state), []).append(r.weight)
    counts = [Counter(zip(t, t[1:])) for t in texts]

    def weights(parts):
        c = sum(parts, Counter())
        w = np.array([[c[a, b] for b in "ABC"] for a in "ABC"], float)
        rows = w.sum(1, keepdims=True)
        return np.divide(w, rows, out=np.zeros_like(w), where=rows > 0) if type_ == "relative" else w

    whole, left = weights(counts), np.array([weights(counts[:k] + counts[k + 1 :]) for k in range(len(texts))])
    found = resample.bca_edges(m, draws=draws).collect()
    assert len(found) == 9
    for r in found:
        i, j = "ABC".index(r.from_state), "ABC".index(r.to_state)
        off = left[:, i, j].mean() - left[:, i, j]
        spread = 6 * (off**2).sum() ** 1.5
        a = (off**3).sum() / spread if spread else 0.0
        values = np.array(boot[r.from_state, r.to_state])
        assert r.weight == pytest.approx(whole[i, j]) and r.acceleration == pytest.approx(a, abs=1e-9)
        assert (r.bias, r.ci_lower, r.ci_upper) == pytest.approx(stats.bca_ends(values, float((values < r.weight).mean()), a))


def test_intervals_of_scaled_models_are_refused(spark):
    with pytest.raises(ValueError, match="before scaling"):
        resample.bca_edges(model.tna(long(spark, ["AB", "BA"]), scaling="max"))


def searched_from(weights, source):
    """Distances by relaxing all edges until none gets shorter, then paths counted along them by distance."""
    n, far = len(weights), {source: 0.0}
    edges = [(u, v, 1.0 / weights[u, v]) for u in range(n) for v in range(n) if u != v and weights[u, v] > 0]
    changed = True
    while changed:
        changed = False
        for u, v, d in edges:
            if u in far and far[u] + d < far.get(v, math.inf):
                far[v], changed = far[u] + d, True
    count = dict.fromkeys(far, 0)
    count[source] = 1
    for v in sorted(far, key=far.get):
        if v != source:
            count[v] = sum(count[u] for u, x, d in edges if x == v and u in far and far[u] + d == far[v])
    return far, count


@pytest.mark.parametrize("seed", range(6))
def test_paths_side_by_side(seed):
    rng = np.random.default_rng(seed)
    w = 2.0 ** rng.integers(0, 3, (9, 9)) * (rng.random((9, 9)) < 0.4)  # lengths that add up exactly, so paths tie
    far, count, order = graph.paths(w, np.arange(9))
    for s in range(9):
        want, paths = searched_from(w, s)
        assert {v: d for v, d in enumerate(far[s]) if d < math.inf} == want
        assert {v: count[s, v] for v in want} == paths
        assert sorted(order[s][order[s] >= 0]) == sorted(want) and (np.diff(far[s, order[s][order[s] >= 0]]) >= 0).all()
    parts = [np.array([0, 3]), np.array([], int), np.array([1, 2, 4, 5, 6, 7, 8])]
    for whole, part in ((graph.betweenness(w), [graph.betweenness(w, sources=p) for p in parts]), (graph.edge_betweenness(w, False), [graph.edge_betweenness(w, False, p) for p in parts])):
        assert np.allclose(whole, sum(part))
    assert np.array_equal(graph.closeness(w), sum(graph.closeness(w, p) for p in parts))


def test_paths_by_blocks_of_sources(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(g, f"s{a}", f"s{b}", float(x)) for g in ("a", None, "o'x") for a in range(12) for b in range(12) if (x := rng.random()) < 0.5]
    edges = spark.createDataFrame(rows, "grp string, from_state string, to_state string, weight double")
    for type_ in ("relative", "co-occurrence"):
        m = model.Model(edges, edges.limit(0), edges.limit(0), type_, ("grp",))
        measures = ["ClosenessIn", "Closeness", "Betweenness", "InStrength", "Clustering"]
        found = {}
        for size in (64, 5, 1):
            monkeypatch.setattr(network, "SOURCES", size)
            values = {(r.grp, r.state, r.measure): r.value for r in network.centralities(m, measures).collect()}
            flows = {(r.grp, r.from_state, r.to_state): r.weight for r in network.betweenness_network(m).weights.collect()}
            found[size] = (values, flows)
        for k in (0, 1):
            assert len(found[64][k]) == (3 * 12 * 5, 3 * 144)[k]
            assert found[5][k] == pytest.approx(found[64][k], abs=1e-9) and found[1][k] == pytest.approx(found[64][k], abs=1e-9)


def test_paths_of_many_states_take_many_tasks(spark):
    n = 200
    rng = np.random.default_rng(5)
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.3)
    cells = spark.createDataFrame([(f"s{a:03}", f"s{b:03}", float(w[a, b])) for a in range(n) for b in range(n)], "from_state string, to_state string, weight double")
    m = model.from_matrix(cells, "frequency")
    got = {r.state: r.value for r in network.centralities(m, ["Betweenness"]).collect()}
    np.fill_diagonal(w, 0)
    assert np.allclose([got[f"s{a:03}"] for a in range(n)], graph.betweenness(w))
    blocks = network._by_source(m.weights, (), lambda labels, w, sources, first: pd.DataFrame({"n": [len(sources)]}), "n long").collect()
    assert len(blocks) == 4 and sum(r.n for r in blocks) == n
    empty = model.Model(cells.limit(0), cells, cells, "relative")
    assert network.centralities(empty).count() == 0 and network.betweenness_network(empty).weights.count() == 0
