"""The nine-state model that is printed with its weights and centralities: fixed values, in the order of STATES."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.functions import graph
from stepweave.operators import network
from stepweave.operators.model import from_matrix

STATES = ["adapt", "cohesion", "consensus", "coregulate", "discuss", "emotion", "monitor", "plan", "synthesis"]
COUNTS = np.array([
    [0, 139, 243, 11, 30, 61, 17, 8, 0],
    [5, 46, 844, 202, 101, 196, 56, 239, 6],
    [30, 94, 519, 1188, 1190, 460, 295, 2505, 48],
    [32, 71, 265, 46, 539, 339, 170, 471, 37],
    [282, 188, 1269, 333, 770, 418, 88, 46, 557],
    [7, 923, 909, 97, 289, 218, 103, 283, 8],
    [16, 80, 228, 83, 538, 130, 26, 309, 23],
    [6, 155, 1788, 106, 418, 904, 465, 2304, 11],
    [153, 22, 304, 29, 41, 46, 8, 49, 0],
], float)
EXPECTED = {
    "OutStrength": [1.0, 0.972861356932153, 0.917996523937431, 0.976649746192893, 0.805112629713996, 0.923158265773705, 0.981856245638521, 0.625791781711873, 1.0],
    "InStrength": [0.344577787953137, 0.811647784954297, 2.667218549507990, 0.566581079944861, 1.188231522647023, 0.894131246276868, 0.345714956560509, 1.193784260014568, 0.191539362041319],
    "ClosenessIn": [0.008339570131235, 0.013800358906669, 0.035123315719608, 0.015546719101785, 0.019591856586706, 0.014102579452180, 0.007580598453937, 0.027426128875219, 0.009967580555985],
    "ClosenessOut": [0.015168577227034, 0.012386811515627, 0.012535497744412, 0.015004153699868, 0.013071651541832, 0.012056070286577, 0.013684054771456, 0.011509488834405, 0.015790195673322],
    "Closeness": [0.024792561875215, 0.026543117094488, 0.038294808609938, 0.021041713513592, 0.027104254929150, 0.023112084770781, 0.019277663165081, 0.027426128875219, 0.024315306503490],
    "Betweenness": [1, 0, 30, 0, 16, 5, 0, 9, 7],
    "BetweennessRSP": [1, 19, 103, 27, 53, 36, 11, 61, 3],
    "Diffusion": [5.586291969638066, 5.208632770201142, 4.659727805733428, 5.147938118060861, 4.627576670649398, 5.069888019796327, 5.156836527833763, 3.487528601796722, 5.582502363886841],
    "Clustering": [0.336983862677757, 0.299648677165664, 0.160777291853848, 0.305784186111251, 0.239710760651376, 0.290479309565872, 0.288881938704651, 0.287490437349879, 0.358613621392574],
}


@pytest.fixture(scope="module")
def model(spark):
    cells = [(a, b, float(COUNTS[i, j])) for i, a in enumerate(STATES) for j, b in enumerate(STATES)]
    return from_matrix(spark.createDataFrame(cells, "from_state string, to_state string, weight double"))


def test_weights(model):
    found = {(r.from_state, r.to_state): r.weight for r in model.weights.collect()}
    want = COUNTS / COUNTS.sum(1, keepdims=True)
    assert all(abs(found[a, b] - want[i, j]) < 1e-12 for i, a in enumerate(STATES) for j, b in enumerate(STATES))
    assert abs(found["consensus", "plan"] - 0.395797124348238) < 1e-12


def test_centralities(model):
    found = {(r.measure, r.state): r.value for r in network.centralities(model).collect()}
    for name, values in EXPECTED.items():
        assert np.allclose([found[name, s] for s in STATES], values, atol=1e-10), name


def test_normalized_centralities_span_zero_to_one(model):
    ends = network.centralities(model, ["OutStrength", "Betweenness"], normalize=True).groupBy("measure").agg(F.min("value"), F.max("value")).collect()
    assert all(tuple(r)[1:] == (0.0, 1.0) for r in ends)


def test_diffusion_by_joins(model):
    found = {r.state: r.value for r in network.diffusion(model, len(STATES)).collect()}
    assert np.allclose([found[s] for s in STATES], EXPECTED["Diffusion"], atol=1e-10)


def test_cliques_agree_with_all_triples(model):
    from itertools import combinations

    w = COUNTS / COUNTS.sum(1, keepdims=True)
    want = {tuple(STATES[k] for k in t) for t in combinations(range(9), 3) if all(w[a, b] > 0.05 and w[b, a] > 0.05 for a, b in combinations(t, 2))}
    assert {tuple(r) for r in network.cliques(model, 3, 0.05).collect()} == want


@pytest.mark.parametrize("method", graph.METHODS)
def test_communities_cover_all_states(model, method):
    found = network.communities(model, (method,)).collect()
    assert sorted(r.state for r in found) == STATES
    assert {r.community for r in found} == set(range(len({r.community for r in found})))


def test_two_blocks_are_two_communities():
    s = np.zeros((6, 6))
    s[:3, :3] = s[3:, 3:] = 5.0
    s[0, 3] = s[3, 0] = 0.1
    np.fill_diagonal(s, 0)
    for method in graph.METHODS:
        found = graph.communities(s, method)
        if method == "label_prop":  # knows no weights
            continue
        assert len(set(found[:3])) == 1 and len(set(found[3:])) == 1 and found[0] != found[3], method


def test_unknown_names_are_refused(model):
    with pytest.raises(ValueError):
        network.centralities(model, ["Nearness"])
    with pytest.raises(ValueError):
        network.communities(model, ("astrology",))
