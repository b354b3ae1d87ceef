"""Logs of one actor, dealt by ranges, against windows over it; linkages, PAM and silhouettes against whole matrices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.functions import editing
from stepweave.operators import clustering, linkage, model, prepare, shared
from stepweave.operators.sequences import Sequences

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def many_ranges(spark):
    """As many ranges as partitions, however few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def log(spark, n=400, actors=("u", "u", "u", "v", None), nulls=True, seed=3):
    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.choice([1, 5, 60, 61, 4000], n, p=[0.4, 0.2, 0.15, 0.15, 0.1]))
    order = rng.permutation(n)
    rows = [(int(k), actors[rng.integers(len(actors))], None if nulls and rng.random() < 0.02 else START + dt.timedelta(seconds=int(at[k])), "abc"[rng.integers(3)]) for k in order]
    return spark.createDataFrame(rows, "event_id long, who string, at timestamp, action string")


@pytest.mark.parametrize("options", [
    {"actor": "who", "time": "at"}, {"time": "at"}, {"actor": ["who"], "time": "at", "order": "event_id"}, {"actor": "who"}, {},
])
def test_ranges_give_the_sessions_of_windows(spark, monkeypatch, many_ranges, options):
    events = log(spark)
    options = {"action": "action", "tiebreak": ("event_id",), "time_threshold": 60} | options
    want = prepare.prepare(events, **options).long
    monkeypatch.setattr(shared, "HOT", 50)
    got = prepare.prepare(events, **options).long
    assert sorted(got.columns) == sorted(want.columns) and dict(got.dtypes)["raw_pos"] == dict(want.dtypes)["raw_pos"]
    columns = ["event_id", "actor", "session", "session_id", "raw_pos", "state"]
    plain = lambda rows: sorted(map(str, rows.select(*columns).collect()))
    assert plain(got) == plain(want)


def test_no_window_has_a_whole_hot_actor(spark, monkeypatch, many_ranges):
    monkeypatch.setattr(shared, "HOT", 50)
    events = log(spark, 600, nulls=False)
    ranged = []
    written = prepare.written
    monkeypatch.setattr(prepare, "written", lambda df, name: ranged.append((name, out := written(df, name))) or out)
    found = prepare.prepare(events, "action", time="at", tiebreak=("event_id",), time_threshold=60).long
    (ranges,) = [df for name, df in ranged if name == "ranges"]
    sizes = [r.n for r in ranges.groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) < 400 and found.count() == 600


@pytest.mark.parametrize("options", [{"actor": "user"}, {}, {"actor": "user", "window_type": "sliding", "window_size": 3}, {"window_type": "sliding", "window_size": 4}, {"window_size": 3}, {"window_size": 2, "aggregate": True}])
def test_ranges_give_the_windows_of_onehot_rows(spark, monkeypatch, many_ranges, options):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, "xy"[k % 3 % 2], *rng.integers(0, 2, 3).tolist()) for k in range(150)], "day long, user string, A int, B int, C int")
    want, params = prepare.onehot(rows, ["A", "B", "C"], ["day"], **options)
    want = sorted(map(str, want.frame.select(*want.ids, "w", "t", "raw_pos", "state").collect()))
    monkeypatch.setattr(shared, "HOT", 20)
    got, again = prepare.onehot(rows, ["A", "B", "C"], ["day"], **options)
    assert sorted(map(str, got.frame.select(*got.ids, "w", "t", "raw_pos", "state").collect())) == want and params == again


def test_groups_with_quotes_and_dots(spark):
    frame = spark.createDataFrame([(k, p, s, g) for k, (t, g) in enumerate([("AB", "o'x"), ("BA", 'q"y'), ("AA", None)]) for p, s in enumerate(t)], "seq_id long, raw_pos int, state string, grp string")
    m = model.group_tna(Sequences(frame), "grp")
    one = m.group(grp="o'x")
    assert {(r.from_state, r.to_state): r.weight for r in one.weights.collect()} == {("A", "A"): 0.0, ("A", "B"): 1.0, ("B", "A"): 0.0, ("B", "B"): 0.0}
    assert m.names().count() == 2 and one.inits.count() == 2


def matrix(n, seed, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, 4)).astype(float) if ties else rng.standard_normal((n, 4))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def as_rows(spark, d):
    return spark.createDataFrame([(k, bytearray(np.ascontiguousarray(row).tobytes())) for k, row in enumerate(d)], "idx long, d binary")


def same_parts(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("method", linkage.REDUCIBLE)
def test_rounds_give_the_clusters_of_one_merge_after_the_other(spark, method):
    d, sizes = matrix(60, 2), np.ones(60)
    sizes[[3, 17, 40]] = [2, 5, 3]
    found = linkage.merges(as_rows(spark, d), sizes, method, small=6)
    assert len(found) == 59 and len({a for a, _, _ in found}) == 59
    for k in (1, 2, 3, 7, 20, 59, 60):
        assert (linkage.cut(found, sizes, k) == editing.hierarchical(d.copy(), k, method, sizes)).all()


def test_rounds_are_few_where_all_distances_are_equal(spark, monkeypatch):
    rounds = []
    step = linkage._next
    monkeypatch.setattr(linkage, "_next", lambda *a: rounds.append(1) or step(*a))
    d = 1.0 - np.eye(64)
    found = linkage.merges(as_rows(spark, d), np.ones(64), "average", small=8)
    assert len(found) == 63 and all(h == 1.0 for *_, h in found) and len(rounds) <= 12


@pytest.mark.parametrize("method", ["single", "complete"])
def test_ties_of_a_height_merge_to_the_same_parts(spark, method):
    """Below a height that nothing ties with, single linkage has one answer however ties are broken."""
    d = matrix(40, 4, ties=True)
    found = linkage.merges(as_rows(spark, d), np.ones(40), method, small=4)
    heights = sorted(h for *_, h in found)
    if method == "single":
        whole = sorted(h for *_, h in editing.merging(d, np.ones(40), "single"))
        assert heights == pytest.approx(whole)
        k = 40 - sum(h < 1.2 for h in heights)
        assert same_parts(linkage.cut(found, np.ones(40), k), editing.hierarchical(d.copy(), k, "single"))
    else:
        assert heights == sorted(heights) and len(found) == 39


def sequences_of(spark, n, states, longest, seed):
    rng = np.random.default_rng(seed)
    data = {100 + 3 * k: ["ABCDEFGH"[s] for s in rng.integers(0, states, rng.integers(1, longest + 1))] for k in range(n)}
    frame = spark.createDataFrame([(k, p, s) for k, row in data.items() for p, s in enumerate(row)], "seq_id long, raw_pos int, state string")
    return data, Sequences(frame)


def padded(data, weights=None):
    width = max(map(len, data.values()))
    x = np.array([row + ["*"] * (width - len(row)) for row in data.values()])
    w = np.ones(width) if weights is None else weights[:width]
    return ((x[:, None] != x[None]) * w).sum(2)


def test_clusters_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(linkage, "SMALL", 8)
    data, seqs = sequences_of(spark, 50, 8, 9, 6)
    found = clustering.cluster_sequences(seqs, 4, "hamming", "average", weighted=True, lambda_=0.3)
    d = padded(data, np.exp(-0.3 * np.arange(20)))
    want = editing.hierarchical(d, 4, "average")
    got = np.array([r.cluster for r in found.assignments.orderBy("id").collect()]) - 1
    assert same_parts(got, want) and found.silhouette == pytest.approx(editing.silhouette(d, want))


@pytest.mark.parametrize("weighted", [False, True])
def test_hamming_silhouettes_need_no_pairs(spark, weighted):
    data, seqs = sequences_of(spark, 60, 2, 4, 7)
    holes = seqs.frame.where("seq_id % 5 <> 0 or raw_pos % 2 = 1 or raw_pos = 0")
    kept = {(r.seq_id, r.raw_pos) for r in holes.collect()}
    data = {k: ["*" if (k, p) not in kept else s for p, s in enumerate(row)] for k, row in data.items()}
    member = np.random.default_rng(1).integers(0, 3, 60)
    member[7] = 3
    frame = spark.createDataFrame([(k, int(m)) for k, m in zip(data, member)], "id long, cluster int")
    found = clustering.sequence_silhouette(Sequences(holes), frame, "hamming", weighted, 0.5)
    assert found.first()[0] == pytest.approx(editing.silhouette(padded(data, np.exp(-0.5 * np.arange(9)) if weighted else None), member))
    assert "applyInArrow" not in found._jdf.queryExecution().toString() and "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()


def test_passes_of_pam_do_not_grow_with_clusters(spark, monkeypatch):
    passes = []
    swaps = clustering._swaps
    monkeypatch.setattr(clustering, "_swaps", lambda both, medoids: passes.append(list(medoids)) or swaps(both, medoids))
    data, seqs = sequences_of(spark, 40, 3, 6, 8)
    for k in (2, 6):
        passes.clear()
        found = clustering.cluster_sequences(seqs, k)
        want = editing.pam(padded(data), k)
        assert [r.cluster - 1 for r in found.assignments.orderBy("id").collect()] == want.tolist()
        assert len(passes) == 1 + sum(a != b for a, b in zip(passes, passes[1:]))
