"""Operators on embeddings and pages: brute force over all pairs, whole round trips and odd rows."""

import base64
import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.llm import ann, common, embedding_dedup, warc
from stepweave.llm.common import hadoop, remove_written, shared_dir, shared_folder, table

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def clustered(n=400, d=16, seed=3):
    """Vectors of three labels, one of them most rows, with chains of near copies and exact copies."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, d))
    rows = []
    for k in range(n):
        v = centres[k % 30] + 0.09 * rng.standard_normal(d)
        rows.append((k, [float(np.float32(x)) for x in v], 0 if k % 3 else k % 2 + 1))
    return rows + [(1000 + k, rows[4][1], rows[4][2]) for k in range(40)]


ODD = [
    (2000, None, 0),
    (2001, [0.0] * 16, 0),
    (2002, [NAN] + [1.0] * 15, 0),
    (2003, [INF] + [1.0] * 15, 0),
    (2004, [None] + [1.0] * 15, 0),
    (2005, [1.0] * 16, None),
    (2006, [1.0] * 8, 0),
    (2007, [], 0),
    (None, [1.0] * 16, 0),
    (2009, [1.0] * 16, 0),
    (2009, [1.0] * 16, 0),
]


def fine(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.createDataFrame(clustered() + ODD, VECTORS)
    return rows.select("*", *[F.lit("x").alias(c) for c in ("v", "d", "node", "id", "links", "component", "part", "block", "first")])


@pytest.mark.parametrize("tile", [2048, 16])
def test_links_are_those_of_all_pairs(vectors, tile):
    rows = clustered() + ODD
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a is not None and a == b and fine(v) and fine(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    want = []
    for i, (k, _, _) in enumerate(rows):
        least = min((x for x in members[root(i)] if x is not None), default=None)
        want.append((str(k), links[i], least))
    got = [(str(r.vec_id), r.n_links, r.component_id) for r in embedding_dedup.near_vectors(vectors, tile=tile).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(links) > 1000


def test_no_vectors(vectors):
    assert embedding_dedup.near_vectors(vectors.where("1 = 0")).count() == 0
    assert embedding_dedup.near_vectors(vectors.where("vec_id in (2000, 2001)")).where("kept").count() == 2
    assert ann.nearest(vectors.where("1 = 0")).count() == 0


@pytest.mark.parametrize("part", [8192, 60])
def test_nearest_are_found_and_ranked(vectors, part):
    rows = [r for r in clustered() + ODD if r[0] is not None and fine(r[1])]
    got = {}
    for r in ann.nearest(vectors, k=10, part=part, queries=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for k, v, _ in rows:
        if k % 20:
            continue
        every = sorted((-float(np.dot(v, w)), j) for j, w, _ in rows if j != k and len(w) == len(v))[:10]
        found = sorted(got[k])
        assert [r for r, _, _ in found] == list(range(1, len(every) + 1))
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        best = dict((j, -s) for s, j in every)
        assert all(abs(best[j] - s) < 1e-9 for _, j, s in found if j in best)
        hits += sum(s >= -every[-1][0] - 1e-9 for _, _, s in found)
        total += len(every)
    assert hits >= 0.97 * total


def test_recall_on_the_test_table(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    x = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    hits = 0
    found = ann.nearest(rows).collect()
    for k in {r.query_id for r in found}:
        every = sorted(((-float(x[k] @ w), j) for j, w in x.items() if j != k))[:20]
        hits += len({j for _, j in every} & {r.vec_id for r in found if r.query_id == k})
    assert hits >= 0.95 * len(found)


@pytest.mark.parametrize("d", [64, 7, 100])
def test_estimates_hold_their_bounds(d):
    rng = np.random.default_rng(8)
    vectors, queries = rng.standard_normal((3000, d)), rng.standard_normal((40, d))
    centre, rotation = vectors.mean(0), np.linalg.qr(rng.standard_normal((d, d)))[0]
    codes = ann.coded(vectors, centre, rotation)
    assert codes.words.dtype == np.uint64 and codes.words.shape[1] == -(-d // 64)
    total, bound = ann.estimate(codes, queries, centre, rotation)
    signs = np.where((vectors - centre) @ rotation > 0, 1.0, -1.0)
    opened = (queries @ centre)[:, None] + (queries @ rotation) @ signs.T * codes.scale
    assert np.abs(total - opened).max() < 0.1 * np.abs(opened).max()  # rounding of queries alone
    assert (np.abs(total - queries @ vectors.T) <= bound).mean() > 0.97


def test_rows_of_a_repeated_id_are_queries_of_their_own(spark):
    rows = [(k, [float(k % 7 + 1), float(k % 5), 1.0], 0) for k in range(1, 40)] + [(40, [1.0, 0.0, 0.0], 0), (40, [0.0, 1.0, 0.0], 0), (40, [0.0, 1.0, 0.0], 0)]
    got = [(r.rank, r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, VECTORS), k=5).where("query_id = 40").collect()]
    want = []
    for i in (39, 40, 41):
        every = sorted((-float(np.dot(rows[i][1], v)), k) for j, (k, v, _) in enumerate(rows) if j != i)[:5]
        want += [(n, k, -s) for n, (s, k) in enumerate(every, 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("spread", [0.0, 1e-9])
def test_tiles_stay_small_whatever_the_ties(spark, spread):
    """3,000 multiples of one vector, tied on every axis, and 1,000 far from them: no group of more than two tiles, and
    no group of tiles that are far apart."""
    rng = np.random.default_rng(4)
    one = rng.standard_normal(16)
    rows = [(k, (one * (1 + k) * (1 + spread * rng.standard_normal(16))).tolist(), 0) for k in range(3000)]
    rows += [(3000 + k, (0.2 * rng.standard_normal(16) - one).tolist(), 0) for k in range(1000)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    classes = frame.select("label", "v", F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"))
    rotations = {16: np.eye(16)}
    placed = embedding_dedup.tiled(classes, rotations, 64)
    sizes = [r["count"] for r in placed.groupBy("t").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 80
    pairs = embedding_dedup.tile_pairs(placed, 0.93)
    assert pairs.count() < len(sizes) * (len(sizes) + 1) / 2 and pairs.where("x = y").count() == len(sizes)
    got = embedding_dedup.near_vectors(frame.withColumnRenamed("v", "embedding").where("vec_id < 700 or vec_id >= 3500"), tile=64).collect()
    x = np.array([r[1] for r in rows if r[0] < 700 or r[0] >= 3500])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = dict(zip([r[0] for r in rows if r[0] < 700 or r[0] >= 3500], ((x @ x.T) >= 0.93).sum(1) - 1))
    assert {r.vec_id: r.n_links for r in got} == want


# WARC

PAGES = "page_id long, url string, html string"
ODD_PAGES = [
    (5, "http://a.example/ü?q=1 2", "<p>same</p>"),
    (3, "http://b.example/", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (1, "http://c.example/\r\nX: 1", None),
    (2, "", ""),
    (None, "http://d.example/", "<p>same</p>"),
    (None, "http://e.example/", "<p>alone</p>"),
    (7, "http://f.example/", "ß漢" * 100000),
    (8, "http://g.example/", "a\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "http://g.example/", "a\r\n\r\nWARC/1.1\r\n\r\n"),
    (-4, "http://h.example/", "minus"),
]


def bundles(spark, rows, **options):
    return warc.write_bundles(rows, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", **options)


@pytest.mark.parametrize("frame", [1 << 18, 300])
def test_archives_come_back_whole(spark, frame):
    rows = spark.createDataFrame(ODD_PAGES, PAGES).withColumn("salt", F.lit(1)).withColumn("payload", F.lit(2))
    index = bundles(spark, rows, frame_bytes=frame)
    got = warc.read_bundles(index, payload=True).collect()
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    holder = {}
    for k, _, html in ODD_PAGES:
        if k is not None:
            holder[digest(html)] = min(k, holder.get(digest(html), k))
    want = []
    for k, _, html in ODD_PAGES:
        d, data = digest(html), (html or "").encode()
        revisit = d in holder and holder[d] != k
        want.append((str(k), len(data), d, "revisit" if revisit else "response", holder[d] if revisit else None, b"" if revisit else data))
    assert sorted(want, key=str) == sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str)
    for r in index.collect():
        assert warc.read_record(r.bundle, r.frame, r.offset)["page_id"] == r.page_id


def test_small_payloads_can_stay_whole(spark):
    rows = spark.createDataFrame(ODD_PAGES, PAGES)
    got = warc.read_bundles(bundles(spark, rows, least=12)).collect()
    assert {r.record_type for r in got} == {"response"} and len(got) == len(ODD_PAGES)


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_a_hot_payload_joins_either_way(spark, monkeypatch, most):
    """More copies than salts, with repeats broadcast or joined by salt."""
    monkeypatch.setattr(warc, "REPEATS", most)
    rows = spark.createDataFrame([(k, "http://a.example/", "hot" if k % 3 else f"own {k}") for k in range(600)], PAGES)
    got = warc.read_bundles(bundles(spark, rows)).collect()
    assert len(got) == 600 and sum(r.record_type == "revisit" for r in got) == 399
    assert all(r.refers_to == 1 for r in got if r.record_type == "revisit")


def test_no_pages(spark):
    assert warc.read_bundles(bundles(spark, spark.createDataFrame([], PAGES))).count() == 0


def test_record_ids_tell_payloads_of_one_page_apart(spark):
    rows = spark.createDataFrame([(5, "http://a.example/", "x"), (5, "http://a.example/", "y"), (7, "http://b.example/", "y"), (-1, None, "x"), (None, None, "z")], PAGES)
    got = warc.read_bundles(bundles(spark, rows)).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(False, -1, "response", 0), (False, 5, "response", 0), (False, 5, "revisit", -1), (False, 7, "revisit", 5), (True, 0, "response", 0)]
    digests = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"x", b"y")]
    for page in (0, 5, -1, (1 << 63) - 1, -(1 << 63)):
        ids = {warc.record_id(page, url, d) for d in digests for url in (None, "http://a.example/")}
        assert len(ids) == 2 and {warc.page_of(x) for x in ids} == {page}
    assert warc.page_of(warc.record_id(None, "http://a.example/", digests[0])) is None and warc.page_of(None) is None


def test_bundles_of_lost_tasks_are_removed(spark, tmp_path):
    for folder in (f"{tmp_path}/plain", f"file://{tmp_path}/uri"):
        index = warc.write_bundles(spark.createDataFrame(ODD_PAGES, PAGES), folder)
        writer = warc.BundleWriter(f"{folder}/lost.warc.zst")
        writer.record(b"half")
        writer.close()
        assert warc.remove_unnamed(index, folder) == 1 and warc.remove_unnamed(index, folder) == 0
        assert warc.read_bundles(index).count() == len(ODD_PAGES)
    assert warc.remove_unnamed(index, f"{tmp_path}/none") == 0


def opened_elsewhere(path):
    from pyarrow import fs

    return fs.LocalFileSystem(), path.removeprefix("other:/")


def test_paths_of_other_file_systems(spark, tmp_path):
    assert warc.arrow_uri("s3a://b/k") == "s3://b/k" and warc.arrow_uri("hdfs://n:8020/k") == "hdfs://n:8020/k"
    assert warc.arrow_uri("file:/tmp/x") == warc.arrow_uri("file:///tmp/x") == "file:///tmp/x" and warc.arrow_uri("/tmp/a:b") == "/tmp/a:b"
    writer = warc.BundleWriter(f"other:/{tmp_path}/one.warc.zst", opened=opened_elsewhere)
    digest = base64.b32encode(hashlib.sha1(b"p").digest()).decode()
    where = writer.record(warc.warc_record(3, None, b"p", digest, None, False))
    writer.close()
    assert warc.read_record(f"other:/{tmp_path}/one.warc.zst", *where, opened=opened_elsewhere)["page_id"] == 3
    index = warc.write_bundles(spark.createDataFrame(ODD_PAGES, PAGES), f"{tmp_path}/more", opened=opened_here)
    assert warc.read_bundles(index, opened=opened_here).count() == len(ODD_PAGES)


def opened_here(path):
    return opened_elsewhere("other:/" + path.removeprefix("file:"))


def test_written_tables_and_archives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(common, "_made", [])  # other tests' tables stay
    before = shared_dir(spark)
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(spark.createDataFrame(ODD_PAGES, PAGES), folder)
    assert index.count() == len(ODD_PAGES)
    assert remove_written(spark) >= 3 and remove_written(spark) == 0
    path, system = hadoop(spark, folder)
    assert not system.exists(path) and shared_dir(spark) == before


def test_bundles_are_plain_zstandard(spark, sf_dir):
    import zstandard
    from pyarrow import fs

    index = bundles(spark, table(spark, sf_dir, "pages"), frame_bytes=1 << 14, bundle_bytes=1 << 14)
    names = [r.bundle for r in index.select("bundle").distinct().collect()]
    assert len(names) > 1
    seen = 0
    for name in names:
        system, path = fs.FileSystem.from_uri(name)
        with system.open_input_file(path) as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        seen += sum(1 for _ in warc.records(plain))
    assert seen == index.count() == table(spark, sf_dir, "pages").count()
