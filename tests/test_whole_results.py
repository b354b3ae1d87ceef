"""Queries and operators give all of a result: no prefix, no fixed size, no row lost."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stepweave.functions import editing
from stepweave.operators import clustering, sequences
from stepweave.plans import catalogue


def sessions(sf_dir):
    """Events of each session in order, by plain loops."""
    events = sorted(pq.read_table(f"{sf_dir}/events.parquet").to_pylist(), key=lambda r: (r["user_id"], r["ts"], r["event_id"]))
    out, last, number = {}, None, 0
    for r in events:
        if last is None or last["user_id"] != r["user_id"]:
            number = 1
        elif r["ts"] - last["ts"] > dt.timedelta(days=1):
            number += 1
        out.setdefault(f"{r['user_id']}_{number}", []).append(r)
        last = r
    return out


@pytest.mark.parametrize(("name", "cell"), [("sequences_wide_all", lambda r: r["event_type"]), ("time_wide_all", lambda r: (r["ts"] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))])
def test_wide_form_has_every_place(spark, sf_dir, name, cell):
    want = {k: [cell(r) for r in rows] for k, rows in sessions(sf_dir).items()}
    width = max(map(len, want.values()))
    assert width > 8
    got = {r[0]: list(r[1:]) for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
    assert got == {k: row + [None] * (width - len(row)) for k, row in want.items()}


def test_wide_round_trip_has_every_place(spark, tmp_path):
    spark.range(11).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.concat(F.lit("r"), "id").alias("role")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.QUERIES["wide_round_trip"](spark, str(tmp_path)).orderBy("raw_pos").collect()
    assert [tuple(r) for r in got] == [(1, k, f"r{k}") for k in range(11)]


def random_sequences(spark, n, seed, longest=4):
    rng = np.random.default_rng(seed)
    rows = {k: [str(x) for x in rng.choice(list("AB*"), rng.integers(1, longest + 1))] for k in range(n)}
    frame = spark.createDataFrame([(k, p, s) for k, row in rows.items() for p, s in enumerate(row)], "seq_id long, raw_pos int, state string")
    return rows, sequences.Sequences(frame)


def matrix(rows, metric):
    def one(a, b):
        if metric != "hamming":
            return getattr(editing, metric)(a, b)
        n = max(len(a), len(b))
        return float(sum(x != y for x, y in zip(a + ["*"] * (n - len(a)), b + ["*"] * (n - len(b)))))

    return np.array([[0.0 if i == j else one(rows[i], rows[j]) for j in rows] for i in rows])


@pytest.mark.parametrize("metric", editing.METRICS)
def test_blocks_follow_the_sequences(spark, monkeypatch, metric):
    monkeypatch.setattr(clustering, "BLOCK", 8)
    rows, seqs = random_sequences(spark, 40, 1)
    d = matrix(rows, metric)
    found = clustering.distances(seqs, metric)
    assert {(r.i, r.j): r.d for r in found.collect()} == {(i, j): d[i, j] for i in rows for j in rows if i < j}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64" in plan and ", 5)" in plan, plan  # 40 sequences are 5 blocks of about 8


@pytest.mark.parametrize("metric", editing.METRICS)
def test_silhouette_of_classes_is_that_of_all_pairs(spark, metric):
    rows, seqs = random_sequences(spark, 40, 2)
    member = np.array([k % 3 for k in rows])
    member[7] = 3  # alone
    frame = spark.createDataFrame([(k, int(member[k])) for k in rows], "id long, cluster int")
    assert clustering.sequence_silhouette(seqs, frame, metric).first()[0] == pytest.approx(editing.silhouette(matrix(rows, metric), member), abs=1e-12)


@pytest.mark.parametrize(("metric", "method", "k"), [("hamming", "pam", 3), ("lcs", "pam", 4), ("lv", "pam", 3), ("osa", "pam", 2), *[(m, x, 3) for m, x in zip(("hamming", "lcs") * 4, editing.LINKAGES)], ("lv", "average", 3)])
def test_clusters_are_those_of_the_whole_matrix(spark, monkeypatch, metric, method, k):
    rows, seqs = random_sequences(spark, 40, 3, 3)
    d = matrix(rows, metric)
    want = editing.pam(d, k) if method == "pam" else editing.hierarchical(d, k, method)
    if method == "pam" or metric in clustering.COLLAPSING:
        monkeypatch.setattr(clustering, "DRIVER_ROWS", 39)  # neither needs a matrix of all sequences
    found = clustering.cluster_sequences(seqs, k, metric, method)
    assert {r.id: r.cluster - 1 for r in found.assignments.collect()} == dict(zip(rows, want.tolist()))
    assert found.silhouette == pytest.approx(editing.silhouette(d, want), abs=1e-12) and found.sizes == np.bincount(want, minlength=k).tolist()


def test_linkages_refuse_more_points_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(clustering, "DRIVER_ROWS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        clustering.cluster_sequences(random_sequences(spark, 40, 3, 3)[1], 3, "hamming", "average")


def test_glued_customers_do_not_overlap(spark, tmp_path):
    orders = spark.range(63).select(F.when(F.col("id") < 60, 2).otherwise(3).cast("long").alias("o_custkey"), F.lit("2024-01-01").cast("date").alias("o_orderdate"), F.col("id").alias("o_orderkey"), F.concat(F.lit("p"), "id").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["seq_concat"](spark, str(tmp_path)).orderBy("raw_pos").collect()
    assert [tuple(r) for r in got] == [(1, k, f"p{k}") for k in range(63)]


@pytest.fixture
def other_types(spark, tmp_path):
    """Events of six types, customers of six segments."""
    rows = [(k, dt.datetime(2024, 1, 1, 0, k), 1 + k // 12, f"kind{k * k % 7 % 6}" if k % 5 else "sixth", 1.0, "") for k in range(36)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(12).select(F.col("id").alias("c_custkey"), F.concat(F.lit("segment"), F.col("id") % 6).alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(48).select((F.col("id") % 12).alias("o_custkey"), F.lit("2024-01-01").cast("date").alias("o_orderdate"), F.col("id").alias("o_orderkey"), F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path), sorted({r[3] for r in rows})


def test_every_type_of_event_is_a_state(spark, other_types):
    path, kinds = other_types
    of = lambda name: catalogue.QUERIES[name](spark, path)
    for name in ("onehot_tumbling", "onehot_tumbling_agg"):
        assert {r.state for r in of(name).where("state is not null").collect()} == set(kinds)
    assert {r.from_state for r in of("model_onehot_ctna").collect()} == set(kinds)
    assert of("model_matrix_pivot").columns == ["from_state", *kinds]


def test_diffusion_takes_a_step_a_state(spark, other_types):
    path, kinds = other_types
    cells = {(r.from_state, r.to_state): r.weight for r in catalogue.QUERIES["model_relative"](spark, path).collect()}
    w = np.array([[0 if a == b else cells[a, b] for b in kinds] for a in kinds])
    want = sum(np.linalg.matrix_power(w, k + 1) for k in range(len(kinds))).sum(1)
    got = {r.state: r.value for r in catalogue.QUERIES["cent_diffusion"](spark, path).collect()}
    assert [got[k] for k in kinds] == pytest.approx(want.tolist(), abs=1e-6)


def test_shuffled_groups_are_all_groups(spark, other_types, monkeypatch):
    drawn = []
    monkeypatch.setattr(catalogue.patterns, "permutation_test", lambda seqs, grp, shuffled, *a, **o: drawn.append(shuffled) or seqs.frame.selectExpr("1 as length", "'' as pattern", "0d as statistic", "0d as effect_size", "0d as p_value", "0d as p_adjusted"))
    catalogue.QUERIES["patterns_perm_test"](spark, other_types[0])
    assert {r.grp for r in drawn[0].select("grp").distinct().collect()} == {f"segment{k}" for k in range(6)}


@pytest.mark.parametrize("metric", editing.METRICS)
def test_pairs_of_few_kinds_come_from_their_table(spark, monkeypatch, metric):
    """Pairs are joined from a table of the different sequences, without Python, and are those of the blocks' kernels."""
    rows, seqs = random_sequences(spark, 60, 5)
    seqs = replace(seqs, frame=seqs.frame.unionByName(seqs.frame.where("seq_id = 7").withColumn("seq_id", F.lit(None).cast("long"))))  # in no pair
    pairs = lambda **more: clustering.distances(seqs, metric, weighted=True, lambda_=0.5, digits=9, **more)
    for blocks in (None, 1, 7):
        found = pairs(blocks=blocks)
        assert "InArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) == len(rows) * (len(rows) - 1) // 2
        with monkeypatch.context() as m:
            m.setattr(clustering, "KINDS", 0)
            assert set(got) == {tuple(r) for r in pairs().collect()}


@pytest.mark.parametrize("metric", editing.METRICS)
def test_pairs_of_many_strips_and_rounds_are_all_pairs(spark, monkeypatch, metric):
    for name, value in (("STRIP", 4), ("ROUND", 2), ("MEMBERS", 8)):
        monkeypatch.setattr(clustering, name, value)
    rows, seqs = random_sequences(spark, 61, 6)
    rows = {9 * k - 200: row for k, row in rows.items()}  # ids are neither places nor from 0
    seqs = replace(seqs, frame=seqs.frame.withColumn("seq_id", 9 * F.col("seq_id") - 200))
    d = dict(zip(rows, matrix(rows, metric)))
    at = {k: n for n, k in enumerate(rows)}
    for blocks in (None, 3):
        got = [tuple(r) for r in clustering.distances(seqs, metric, blocks=blocks).collect()]
        assert len(got) == 61 * 60 // 2 and set(got) == {(i, j, d[i][at[j]]) for i in rows for j in rows if i < j}


@pytest.mark.parametrize("metric", ["lcs", "lv", "osa", "hamming"])
def test_files_of_pairs_take_a_fraction_of_a_byte_each(spark, tmp_path, metric):
    """The same state, or kind of row, follows itself: 47 billion pairs at 6 GB once took more disk than there is."""
    n = 3000
    frame = spark.range(n).select(F.col("id").alias("seq_id"), F.explode(F.sequence(F.lit(0), (F.hash("id") % 5 + 5).cast("int"))).alias("raw_pos")).withColumn("state", F.when(F.hash("seq_id", "raw_pos") % 9 == 0, "B").otherwise("A"))
    found = clustering.distances(sequences.Sequences(frame.where("raw_pos < 6")), metric, weighted=True, lambda_=0.5, digits=9)
    found.write.parquet(f"{tmp_path}/pairs")
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert sum(pq.read_metadata(f).num_rows for f in files) == n * (n - 1) // 2
    assert sum(f.stat().st_size for f in files) < 0.5 * n * (n - 1) // 2
