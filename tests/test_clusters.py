"""DBSCAN, neighbours, hulls, silhouettes and topics against plain-Python versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import clustering, neighbors, topics
from glyphmill.operators.components import components


def plain_dbscan(pts, eps, least):
    """The usual sequential algorithm in id order."""
    n = len(pts)
    near = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(pts[i], pts[j])) <= eps * eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label, now = [-1] * n, -1
    for i in range(n):
        if label[i] != -1 or not core[i]:
            continue
        now += 1
        stack = [i]
        while stack:
            v = stack.pop()
            if label[v] != -1:
                continue
            label[v] = now
            if core[v]:
                stack.extend(j for j in near[v] if label[j] == -1)
    return label


def run_dbscan(spark, pts, eps, least, parts=4):
    dims = ["x", "y", "z"][: len(pts[0])]
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "id long, " + ", ".join(f"{d} double" for d in dims)).repartition(parts)
    got = {r["id"]: r["label"] for r in clustering.dbscan(df, "id", dims, eps, least).collect()}
    return [got[i] for i in range(len(pts))]


CASES = {
    "exact_eps": ([(0, 0), (1, 0), (2, 0), (9, 9)], 1.0, 2),
    "blobs_border_noise": ([(0, 0), (0, 0.5), (0.5, 0), (4, 0), (4, 0.5), (4.5, 0), (2.2, 0.2), (9, 9)], 2.0, 4),
    "all_noise": ([(0, 0), (5, 5), (9, 1)], 1.0, 2),
    "copies": ([(1, 1)] * 30 + [(1.4, 1)] + [(5, 5)] * 2, 0.5, 5),
    "one_point": ([(0, 0)], 1.0, 1),
}


@pytest.mark.parametrize("name", CASES)
def test_dbscan_cases(spark, name):
    pts, eps, least = CASES[name]
    assert run_dbscan(spark, pts, eps, least) == plain_dbscan(pts, eps, least)


@pytest.mark.parametrize("seed,dims,eps,least", [(1, 2, 0.09, 4), (2, 2, 0.2, 8), (3, 3, 0.25, 5), (4, 1, 0.02, 3)])
def test_dbscan_random(spark, seed, dims, eps, least, monkeypatch):
    if seed == 2:
        # Every key treated as hot, and no cell small enough for direct comparison.
        monkeypatch.setattr("glyphmill.operators.skew.MIN_HOT", 1)
        monkeypatch.setattr(clustering, "_FEW", 0)
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.random((120, dims)), rng.normal(0.5, 0.03, (80, dims))]).round(3).tolist()
    assert run_dbscan(spark, pts, eps, least) == plain_dbscan(pts, eps, least)


def test_vector_dbscan_matches(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(4, 12))
    pts = (np.repeat(centers, 30, axis=0) + rng.normal(scale=0.15, size=(120, 12))).tolist() + rng.normal(size=(10, 12)).tolist()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "id long, v array<double>").repartition(5)
    got = {r["id"]: r["label"] for r in clustering.dbscan_vectors(df, "id", "v", 0.8, 5, block_rows=17).collect()}
    assert [got[i] for i in range(len(pts))] == plain_dbscan(pts, 0.8, 5)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed, hot_keys):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {}
    find = lambda v: v if parent.setdefault(v, v) == v else find(parent[v])
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {v: find(v) for e in edges for v in e if any(v in f and f[0] != f[1] for f in edges)}
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_knn_ties_and_both_paths(spark, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 4, (60, 3)).astype(float)
    queries = rng.integers(0, 4, (25, 3)).astype(float)
    b = spark.createDataFrame([(i, v.tolist(), int(v[0])) for i, v in enumerate(base)], "vec_id long, embedding array<double>, label int").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbors.knn(b, q, 7, broadcast_bytes=limit).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    labels = {r["query_id"]: r["label"] for r in neighbors.knn_label(b, q, 7, broadcast_bytes=limit).collect()}
    for i, v in enumerate(queries):
        d = ((base - v) ** 2).sum(axis=1)
        want = sorted(range(60), key=lambda j: (d[j], j))[:7]
        assert [got[i][k] for k in range(1, 8)] == want
        votes = [int(base[j][0]) for j in want]
        assert labels[i] == max(dict.fromkeys(votes), key=votes.count)


def test_hull(spark):
    pts = [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)]
    rows = [(1, float(x), float(y)) for x, y in pts] + [(2, 0.0, 0.0), (2, 1.0, 1.0), (-1, 0.0, 0.0), (-1, 1.0, 0.0), (-1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "label int, x double, y double").repartition(3)
    got = sorted(tuple(r) for r in clustering.cluster_hulls(df, "label", "x", "y").collect())
    assert got == sorted((1, float(x), float(y)) for x, y in pts[:4])


def test_silhouette_needs_two_clusters(spark):
    df = spark.createDataFrame([([0.0], 0), ([1.0], 0), ([9.0], -1)], "v array<double>, label int")
    assert clustering.silhouette(df, "v", "label") is None


def test_sampling_members(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(11)], "id long, label int")
    with_repeats = clustering.sample_members(df, "id", "label", 20).collect()
    assert len(with_repeats) == 40 and all(r["id"] % 2 == r["label"] for r in with_repeats)
    without = clustering.sample_members(df, "id", "label", 3, replace=False).collect()
    assert len({r["id"] for r in without}) == 6


def test_pca_explains_the_main_direction(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 5)) @ np.diag([5, 2, 0.3, 0.2, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = topics.project_pca(df, "id", "v", 2).orderBy("id").toPandas()
    values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert got["x"].var() == pytest.approx(values[0], rel=1e-6) and got["y"].var() == pytest.approx(values[1], rel=1e-6)


def test_embeddings_are_unit_and_alike_for_alike_texts(spark):
    texts = ["the cat sat on the mat", "the cat sat on a mat", "completely different words here", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    v = {r["id"]: np.array(r["embedding"]) for r in topics.embed_text(df, "id", "t", 64).collect()}
    assert np.linalg.norm(v[0]) == pytest.approx(1) and np.linalg.norm(v[3]) == 0
    assert v[0] @ v[1] > v[0] @ v[2]
    again = {r["id"]: np.array(r["embedding"]) for r in topics.embed_text(df.repartition(3), "id", "t", 64).collect()}
    assert all(np.allclose(v[i], again[i]) for i in v)


def test_every_cluster_gets_a_prompt(spark):
    df = spark.createDataFrame([(i, i % 2, f"text {i}") for i in range(8)], "id long, label int, text string")
    samples = clustering.sample_members(df, "id", "label", 3)
    rows = topics.topic_prompts(samples, df, "id", "text", "label", instruction="Say it.", template="<{examples}|{instruction}>").collect()
    assert len(rows) == 2 and all(r["prompt"].startswith("<Example 1:\ntext") and r["prompt"].endswith("|Say it.>") for r in rows)


def test_save_and_load(spark):
    from glyphmill.session import scratch_path

    pts = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 0.0, -1)], "id long, x double, y double, label int")
    path = scratch_path(spark, "c")
    topics.save_clusters(pts, None, path)
    assert sorted(map(tuple, topics.load_clusters(spark, path).collect())) == sorted(map(tuple, pts.collect()))


def test_summaries_are_read_back(spark):
    from glyphmill.session import scratch_path

    path = scratch_path(spark, "clusters")
    points = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1)], "id long, x double, label int")
    topics.save_clusters(points, spark.createDataFrame([(0, "first"), (1, "second")], "label int, summary string"), path)
    assert sorted(tuple(r) for r in topics.load_summaries(spark, path).collect()) == [(0, "first"), (1, "second")]
    assert topics.load_clusters(spark, path).count() == 2


def test_searches_of_rows_reach_the_blocks(spark, monkeypatch):
    from glyphmill.plans import vector_queries

    sf = "/root/testdata/sf0.001"
    rows = vector_queries.embeddings(spark, sf)
    n, asked = rows.count(), rows.where("vec_id % 100 = 0").count()
    got = {tuple(r) for r in vector_queries.knn_search_rows(spark, sf).collect()}
    assert len(got) == 5 * asked and asked > 1
    assert vector_queries.similarity_rows(spark, sf).count() == asked * n
    monkeypatch.setattr(vector_queries.neighbors.knn, "__defaults__", ("vec_id", "query_id", "embedding", 0))
    assert {tuple(r) for r in vector_queries.knn_search_rows(spark, sf).collect()} == got


def test_exact_silhouette_against_all_distances(spark):
    from glyphmill.operators import clustering

    rng = np.random.default_rng(3)
    vecs = np.vstack([rng.normal(c, 1.0, (20, 4)) for c in (0.0, 3.0, 6.0)] + [[[9.0] * 4]])
    labels = [0] * 20 + [1] * 20 + [-1] * 20 + [2]
    dist = np.sqrt(((vecs[:, None] - vecs) ** 2).sum(axis=2))
    mean = lambda i, lab: dist[i, [j for j in range(61) if labels[j] == lab and j != i]].mean()
    want = {}
    for i, lab in enumerate(labels):
        if lab != -1:
            a, b = (0.0 if lab == 2 else mean(i, lab)), min(mean(i, o) for o in {0, 1, 2} - {lab})
            want[i] = 0.0 if lab == 2 else (b - a) / max(a, b)
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(vecs, labels))], "id long, v array<double>, label int").repartition(4)
    got = {r["id"]: r["silhouette"] for r in clustering.exact_silhouette(df, "id", "v", "label").collect()}
    assert got == {i: pytest.approx(s) for i, s in want.items()}
    assert clustering.exact_silhouette(df.where("label = 0"), "id", "v", "label").count() == 0


def test_bands_bring_every_pair_within_eps_together(spark, monkeypatch):
    from glyphmill.operators.bands import Bands

    # Grids in every cell that holds more than four blocks.
    monkeypatch.setattr("glyphmill.operators.skew.MIN_HOT", 1)
    rng = np.random.default_rng(12)
    centers = rng.normal(scale=4, size=(40, 16))
    pts = np.repeat(centers, 30, axis=0) + rng.normal(scale=0.1, size=(1200, 16))
    pts[300:700] = pts[300]
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(pts)], "id long, v array<double>, e long").repartition(4)
    near = np.square(pts[:, None] - pts[None]).sum(axis=2) <= 0.6**2

    def pairs(a_ids, a, _a, b_ids, b, _b):
        hit = np.square(a[:, None] - b[None]).sum(axis=2) <= 0.6**2
        return pd.DataFrame({"id": a_ids, "n": hit.sum(axis=1), "compared": len(b_ids)})

    bands = Bands(df, 0.6, block_rows=16)
    placed = bands.placed(df)
    got = bands.run(placed, placed, pairs, "id long, n long, compared long").groupBy("id").sum("n", "compared").collect()
    assert {r["id"]: r["sum(n)"] for r in got} == dict(enumerate(near.sum(axis=1)))
    # The copies alone are a ninth of all pairs; of the others, few are compared.
    copies = set(range(300, 700))
    others = sum(r["sum(compared)"] for r in got if r["id"] not in copies)
    assert others <= 0.1 * 800 * 1200


def test_vector_dbscan_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert clustering.dbscan_vectors(df, "id", "v", 0.5, 3).collect() == []


def test_new_texts_take_the_label_of_the_saved_texts_near_them(spark):
    from glyphmill.session import scratch_path

    rng = np.random.default_rng(4)
    words = [[f"{topic}{i}" for i in range(30)] for topic in ("sea", "hill", "town")]
    texts = [" ".join(rng.choice(words[i % 3], 20)) for i in range(90)] + ["", "..."]
    saved = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    embedder = topics.Embedder.fit(saved, "text")
    points = embedder.embed(saved, "doc_id", "text").join(saved.select("doc_id", "label"), "doc_id")
    path = scratch_path(spark, "labels")
    topics.save_clusters(points, None, path, embedder)
    assert np.array_equal(topics.Embedder.load(spark, path + "/embedder").weights, embedder.weights)

    fresh = [" ".join(rng.choice(words[i % 3], 15)) for i in range(30)] + [texts[7], "", None, " . "]
    new = spark.createDataFrame(list(enumerate(fresh)), "id long, t string")
    base = {r["doc_id"]: (np.array(r["embedding"]), r["label"]) for r in points.collect()}
    asked = {r["id"]: np.array(r["embedding"]) for r in embedder.embed(new, "id", "t").collect()}
    got = {r["id"]: (r["label"], r["votes"]) for r in topics.label_texts(new, "id", "t", path, k=5).collect()}
    assert len(got) == len(fresh)
    for i, v in asked.items():
        if not v.any():
            assert got[i] == (None, 0)
            continue
        near = sorted((((b - v) ** 2).sum(), j) for j, (b, _) in base.items() if b.any())[:5]
        votes = [base[j][1] for _, j in near]
        best = max(dict.fromkeys(votes), key=votes.count)
        assert got[i] == (best, votes.count(best))
    assert all(got[i][0] == i % 3 for i in range(30)) and got[30][0] == 7 % 3
    loose = {r["id"]: r["label"] for r in topics.label_texts(new, "id", "t", path, k=5, exact=False).collect()}
    assert np.mean([loose[i] == got[i][0] for i in got]) >= 0.9


def exact_neighbours(base, asked, k):
    far = {q: np.square(np.array(list(base.values())) - v).sum(axis=1) for q, v in asked.items()}
    ids = np.array(list(base))
    return {q: list(ids[np.lexsort((ids, d))[:k]]) for q, d in far.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_approximate_search_against_brute_force(spark, monkeypatch, hot):
    from glyphmill.operators import hashed_search

    if hot:
        monkeypatch.setattr("glyphmill.operators.skew.MIN_HOT", 1)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(60, 24))
    pts = np.repeat(centers, 50, axis=0) + rng.normal(scale=0.2, size=(3000, 24))
    pts[1000:2000] = pts[1000]
    base = dict(enumerate(pts))
    asked = {q: pts[q] for q in range(0, 3000, 100)}
    rows = [(i, v.tolist()) for i, v in base.items()] + [(-1, None), (-2, []), (-3, [float("nan")] + [0.0] * 23), (-4, [None] + [0.0] * 23), (None, [0.0] * 24)]
    b = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()] + [(-9, None)], "query_id long, embedding array<double>")
    got = {}
    for r in hashed_search.knn_approx(b, q, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
        assert r["distance"] == pytest.approx(np.square(base[r["id"]] - asked[r["query_id"]]).sum(), abs=1e-9)
    want = exact_neighbours(base, asked, 10)
    assert set(got) == set(asked)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in asked]) >= 0.9
    # A query among a thousand copies finds the copies of the smallest ids.
    assert got[1500] == list(range(1000, 1010))


def test_approximate_search_looks_at_a_part_of_the_rows(spark):
    from glyphmill.operators import hashed_search

    rng = np.random.default_rng(10)
    pts = np.repeat(rng.normal(size=(200, 24)), 20, axis=0) + rng.normal(scale=0.2, size=(4000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "id long, v array<double>")
    asked = rows.where("id % 100 = 0").select(rows["id"].alias("query_id"), rows["v"].alias("qv"))
    pairs = hashed_search.candidates(rows, asked, hashed_search.fit_planes(rows, 8), 2).collect()
    assert len({(r["query_id"], r["id"]) for r in pairs}) == len(pairs) < 0.5 * 40 * 4000


def test_approximate_search_of_nothing(spark):
    from glyphmill.operators import hashed_search

    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    ask = lambda df: df.withColumnRenamed("vec_id", "query_id")
    assert hashed_search.knn_approx(empty, ask(one), 3).collect() == []
    assert hashed_search.knn_approx(one, ask(empty), 3).collect() == []
    assert [tuple(r) for r in hashed_search.knn_approx(one, ask(one), 3).collect()] == [(1, 1, 1, 0.0)]


def test_registered_approximate_search_reaches_its_recall(spark):
    from glyphmill.plans import vector_queries

    sf = "/root/testdata/sf0.01"
    exact = {(r["query_id"], r["vec_id"]) for r in vector_queries.knn_search_rows(spark, sf).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in vector_queries.knn_approx_rows(spark, sf).collect()}
    assert len(found & exact) >= 0.9 * len(exact) > 0


def test_products_give_exact_distances():
    """Copies have distance 0 and close pairs keep their digits, far from the origin too; bad components stay bad."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(700, 8)) + 1000.0
    b = np.vstack([a[:300], a[300:500] + 1e-5, rng.normal(size=(100, 8))])
    plain = np.stack([np.square(b - row).sum(axis=1) for row in a])
    got = neighbors.squared_distances(a, b)
    assert (got[plain == 0] == 0).all() and (plain == 0).sum() == 300
    np.testing.assert_allclose(np.sqrt(got), np.sqrt(plain), rtol=1e-6)
    a[0, 0], b[1, 0] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert np.isnan(neighbors.squared_distances(a, b)[0]).all() and np.isinf(neighbors.squared_distances(a, b)[2, 1])


def test_near_blocks_decides_the_edge_by_differences():
    """Pairs at exactly eps are near, as by plain differences."""
    a = np.arange(600.0)[:, None] * np.array([[0.25, 0.0]]) + 100.0
    plain = np.stack([np.square(a - row).sum(axis=1) for row in a]) <= 0.25
    assert (clustering._near_blocks(0.5)(a, a) == plain).all()


@pytest.mark.parametrize("shift, scale", [(0, 1), (50, 1), (3000, 1), (1e9, 1), (0, 1e25), (0, 1e-30)])
def test_near_pairs_in_single_precision_and_beyond(shift, scale):
    """Far from the origin, very long, very short and with values that are no numbers: as by plain differences."""
    rng = np.random.default_rng(6)
    a = (np.round(rng.normal(size=(700, 5)), 1) + shift) * scale
    b = (np.round(rng.normal(size=(90, 5)), 1) + shift) * scale
    b[:40], b[40, 0], b[41, 1] = a[:40], np.nan, np.inf if scale == 1 else 1.0
    eps = 1.3 * scale
    with np.errstate(invalid="ignore", over="ignore"):
        for x in (a, b):
            plain = np.stack([np.square(x - row).sum(axis=1) for row in a]) <= eps * eps
            hit = np.zeros(plain.shape, bool)
            for r, c in clustering._near_pairs(eps)(a, x):
                hit[r, c] = True
            assert (hit == plain).all()


def test_vector_dbscan_compares_two_blocks_once(spark, monkeypatch):
    """Blocks of seven rows, copies of rows and ids among them: the labels of plain DBSCAN from half of the block pairs."""
    from glyphmill.operators.bands import Bands

    asked = []
    run = Bands.run
    monkeypatch.setattr(Bands, "run", lambda self, left, right, *a, **k: asked.append((left is right, k.get("once", False))) or run(self, left, right, *a, **k))
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(size=(3, 6))[[0, 1, 2] * 20] + rng.normal(scale=0.2, size=(60, 6)), rng.normal(size=(10, 6))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>").repartition(3)
    got = {r["id"]: r["label"] for r in clustering.dbscan_vectors(df, "id", "v", 0.7, 4, block_rows=7).collect()}
    assert [got[i] for i in range(len(pts))] == plain_dbscan(pts.tolist(), 0.7, 4)
    assert asked == [(True, True), (True, True), (False, False)]
    monkeypatch.setattr("glyphmill.operators.bands.LEAST", 1)
    floats = df.selectExpr("id", "cast(v AS array<float>) AS v")
    got = {r["id"]: r["label"] for r in clustering.dbscan_vectors(floats, "id", "v", 0.7, 4, block_rows=7).collect()}
    assert [got[i] for i in range(len(pts))] == plain_dbscan(pts.astype(np.float32).astype(float).tolist(), 0.7, 4)
    rows = Bands(df.selectExpr("id", "v", "0L AS e"), 0.7, block_rows=7)
    placed = rows.placed(df.selectExpr("id", "v", "0L AS e"))
    both, half = (rows.meetings(placed, placed, once).selectExpr("a_ids[0] AS a", "b_ids[0] AS b") for once in (False, True))
    own = both.where("a = b").count()
    assert 0 < own and half.count() == (both.count() - own) // 2 + own


def test_blocks_meet_once_on_the_grid(spark):
    a, b = spark.range(40).toDF("a"), spark.range(30).toDF("b")
    left, right = neighbors.on_grid(a, b, 50)
    assert left.count() == 40 * 8 and right.count() == 30 * 8
    assert left.join(right, "slot").select("a", "b").distinct().count() == left.join(right, "slot").count() == 1200


def test_similarity_frames_do_not_grow_with_the_right_table():
    rng = np.random.default_rng(6)
    left, right = rng.normal(size=(5, 4)), rng.normal(size=(2000, 4))
    frames = list(neighbors._cosine_frames(np.arange(5), left, np.arange(2000), right))
    assert max(map(len, frames)) <= 5 * 512
    whole = neighbors._cosines(np.arange(5), left, np.arange(2000), right).sort_values(["left_id", "right_id"])
    got = pd.concat(frames).sort_values(["left_id", "right_id"])
    np.testing.assert_allclose(got.to_numpy(), whole.to_numpy(), atol=1e-12)
