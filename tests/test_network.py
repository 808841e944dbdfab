"""Word networks and centralities against plain-Python versions."""

import itertools
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import network


def edges_of(spark, pairs):
    return spark.createDataFrame([(min(p), max(p), 1) for p in pairs], "w1 string, w2 string, weight long")


def brandes(nodes, adj):
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, preds, sigma, dist = [], {v: [] for v in nodes}, dict.fromkeys(nodes, 0.0), {s: 0}
        sigma[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {v: c * scale for v, c in score.items()}


def power(nodes, adj):
    n = len(nodes)
    x = dict.fromkeys(nodes, 1 / n)
    for _ in range(100):
        last = x
        x = {v: last[v] + sum(last[w] for w in adj[v]) for v in nodes}
        length = sum(a * a for a in x.values()) ** 0.5
        x = {v: a / length for v, a in x.items()}
        if sum(abs(x[v] - last[v]) for v in nodes) < n * 1e-6:
            return x
    raise RuntimeError


GRAPHS = {
    "path": [("a", "b"), ("b", "c"), ("c", "d")],
    "star": [("h", x) for x in "abcd"],
    "triangle_tail": [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")],
    "two_parts": [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")],
}
_rng = random.Random(4)
GRAPHS["random"] = _rng.sample(list(itertools.combinations("abcdefghij", 2)), 18)


@pytest.mark.parametrize("name", GRAPHS)
def test_centralities(spark, name, monkeypatch):
    if name == "random":
        monkeypatch.setattr("glyphmill.operators.skew.MIN_HOT", 1)
    pairs = GRAPHS[name]
    nodes = sorted({v for p in pairs for v in p})
    adj = {v: sorted({b if a == v else a for a, b in pairs if v in (a, b)}) for v in nodes}
    edges = edges_of(spark, pairs)
    want = brandes(nodes, adj)
    for r in network.betweenness(edges).collect():
        assert r["betweenness"] == pytest.approx(want[r["word"]], abs=1e-12)
    want = power(nodes, adj)
    for r in network.eigenvector(edges).collect():
        assert r["eigenvector"] == pytest.approx(want[r["word"]], abs=1e-9)
    deg = {r["word"]: r["centrality"] for r in network.degree_centrality(edges).collect()}
    assert deg == {v: pytest.approx(len(adj[v]) / (len(nodes) - 1)) for v in nodes}


def test_non_convergence_raises(spark):
    with pytest.raises(RuntimeError):
        network.eigenvector(edges_of(spark, GRAPHS["path"]), max_rounds=2)


def test_self_loop_counts_twice(spark):
    df = spark.createDataFrame([(1, "x x y x")], "id long, text string")
    got = {(r["w1"], r["w2"]): r["weight"] for r in network.word_edges(df, "text", 1).collect()}
    assert got == {("x", "x"): 2, ("x", "y"): 2}
    deg = {r["word"]: r["degree"] for r in network.degrees(network.word_edges(df, "text", 1)).collect()}
    assert deg == {"x": 3, "y": 1}


def test_one_node_has_centrality_one(spark):
    assert network.degree_centrality(edges_of(spark, [("a", "a")])).first()["centrality"] == 1.0


def test_filter_keeps_isolated_nodes(spark):
    # Two hubs without a common edge: both stay, no edge does.
    pairs = [("h", x) for x in "abc"] + [("k", x) for x in "abc"]
    edges, nodes = network.filter_by_centrality(edges_of(spark, pairs), 0.7)
    assert sorted(r["word"] for r in nodes.collect()) == ["h", "k"] and edges.count() == 0
    deg = {r["word"]: r["centrality"] for r in network.degree_centrality(edges, nodes).collect()}
    assert deg == {"h": 0.0, "k": 0.0}


@pytest.mark.parametrize("cross", [None, "id"])
@pytest.mark.parametrize("min_freq", [1, 3])
def test_word_edges(spark, cross, min_freq, hot_keys):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(9)))) for i in range(30)]
    texts = [t.split() for _, t in docs]
    if cross:
        texts = [[w for t in texts for w in t]]
    freq = Counter(w for t in texts for w in t)
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    want = {}
    for a, b in {tuple(sorted(p)) for p in pairs}:
        if freq[a] >= min_freq and freq[b] >= min_freq:
            want[a, b] = pairs[a, b] + pairs[b, a]
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "id long, text string").repartition(5)
    got = {(r["w1"], r["w2"]): r["weight"] for r in network.word_edges(df, "text", min_freq, cross).collect()}
    assert got == want


def test_centralities_of_the_whole_network(spark):
    from glyphmill.plans import training_queries

    sf = "/root/testdata/sf0.001"
    edges = [(r.w1, r.w2) for r in training_queries.word_network(spark, sf).collect()]
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    got = {r.word: r for r in training_queries.word_centralities(spark, sf).collect()}
    assert set(got) == set(adj)
    want = power(list(adj), adj)
    ends = Counter(w for e in edges for w in e)
    assert all(abs(got[w].eigenvector - want[w]) < 1e-5 and abs(got[w].degree - ends[w] / (len(adj) - 1)) < 1e-5 for w in adj)
    assert 0 < sum(r.betweenness is not None for r in got.values()) < len(got)


def test_eigenvector_over_several_blocks(spark, monkeypatch):
    """Blocks of three words and cells of two links give the values of one block, and a round moves no words."""
    pairs = GRAPHS["random"]
    nodes = sorted({v for p in pairs for v in p})
    adj = {v: sorted({b if a == v else a for a, b in pairs if v in (a, b)}) for v in nodes}
    monkeypatch.setattr(network, "BLOCK_WORDS", 3)
    monkeypatch.setattr(network, "CELL_LINKS", 2)
    monkeypatch.setattr(network, "BROADCAST_BYTES", 0)
    seen = []
    joined = network.join_by_key
    monkeypatch.setattr(network, "join_by_key", lambda *a: seen.append(a) or joined(*a))
    want = power(nodes, adj)
    got = {r["word"]: r["eigenvector"] for r in network.eigenvector(edges_of(spark, pairs)).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert len(seen) == 2


def test_eigenvector_of_lone_words_and_loops(spark):
    edges = edges_of(spark, [("a", "a"), ("a", "b")])
    nodes = spark.createDataFrame([("a",), ("b",), ("lone",)], "word string")
    got = {r["word"]: r["eigenvector"] for r in network.eigenvector(edges, nodes).collect()}
    # (A + I) is [[2, 1], [1, 1]] on a and b.
    top = (3 + 5**0.5) / 2
    a, b = 1.0, top - 2
    assert got["a"] == pytest.approx(a / (a * a + b * b) ** 0.5, abs=1e-4) and got["b"] / got["a"] == pytest.approx(b, abs=1e-4)
    assert got["lone"] == pytest.approx(0, abs=1e-4)


def test_words_are_found_once_per_text(spark):
    df = spark.createDataFrame([("a b b a",), ("b",), ("",), (None,), ("c a",)], "t string")
    pairs = network.document_bigrams(df, "t")
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b"), ("b", "a"), ("b", "b"), ("c", "a")]


@pytest.mark.parametrize("cross", [None, "doc_id"])
def test_word_edges_over_many_blocks_keep_no_row_per_pair(spark, monkeypatch, cross):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "été", "日本"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 30, 90]))) for _ in range(60)] + [None, "", "w0 w0 w0"]
    monkeypatch.setattr(network, "CODED_WORDS", 100, raising=False)
    monkeypatch.setattr(network, "BUCKET_PAIRS", 50, raising=False)
    kept = []
    plain = network.materialize
    monkeypatch.setattr(network, "materialize", lambda df: kept.append(plain(df)) or kept[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.w1, r.w2): (r.weight, r.freq1, r.freq2) for r in network.frequent_edges(df, "text", 20, cross).collect()}
    words = [t.lower().split() if t else [] for t in texts]
    freq = Counter(w for ws in words for w in ws)
    pairs = [p for ws in ([[w for ws in words for w in ws]] if cross else words) for p in zip(ws, ws[1:])]
    weight = Counter()
    for a, b in pairs:
        weight[min(a, b, key=lambda x: x.encode()), max(a, b, key=lambda x: x.encode())] += 1 + (a == b)
    assert got == {(a, b): (n, freq[a], freq[b]) for (a, b), n in weight.items() if freq[a] >= 20 and freq[b] >= 20}
    assert kept[-1].count() < len(weight) / 10


@pytest.mark.parametrize("near", [True, False])
@pytest.mark.parametrize("cross", [None, "doc_id"])
def test_packed_networks_give_degrees_sizes_and_filters(spark, monkeypatch, cross, near):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(50)] + ["Straße", "ÉTÉ", "été", "日本"]
    texts = [" ".join(rng.choice(pool[: rng.choice([4, 20, 54])]) for _ in range(rng.choice([0, 1, 2, 20, 60]))) for _ in range(50)] + [None, "", "w0 w0 w0"]
    for name, value in {"CODED_WORDS": 90, "BUCKET_PAIRS": 40, "MOST_WIDTH": 7}.items():
        monkeypatch.setattr(network, name, value)
    if not near:
        monkeypatch.setattr(network, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = [t.lower().split() if t else [] for t in texts]
    freq = Counter(w for ws in words for w in ws)
    pairs = [p for ws in ([[w for ws in words for w in ws]] if cross else words) for p in zip(ws, ws[1:])]
    weight = Counter()
    for a, b in pairs:
        if freq[a] >= 9 and freq[b] >= 9:
            weight[min(a, b, key=str.encode), max(a, b, key=str.encode)] += 1 + (a == b)
    degree = Counter(w for p in weight for w in p)
    packed = network.word_edges(df, "text", 9, cross, packed=True)
    assert packed.side > 2 and {r.word: r.freq for r in packed.words.collect()} == {w: n for w, n in freq.items() if n >= 9}
    assert sorted(r.id for r in packed.words.collect()) == list(range(packed.words.count()))
    assert {r.word: r.degree for r in network.degrees(packed).collect()} == degree
    lone = spark.createDataFrame([("lone",), ("w0",)], "word string")
    assert {r.word: r.degree for r in network.degrees(packed, lone).collect()} == {**degree, "lone": 0}
    size = network.network_size(packed).first()
    assert tuple(size) == (len(weight), sum(weight.values()), len(degree))
    limit = sorted(degree.values())[len(degree) // 2] / (len(degree) - 1)
    edges, nodes = network.filter_by_centrality(packed, limit)
    kept = {w for w, n in degree.items() if n / (len(degree) - 1) >= limit}
    assert {r.word for r in nodes.collect()} == kept and 0 < len(kept) < len(degree)
    assert {(r.w1, r.w2): r.weight for r in edges.collect()} == {p: n for p, n in weight.items() if kept.issuperset(p)}


def test_packed_networks_without_words(spark):
    df = spark.createDataFrame([("",), (None,), ("a b",)], "text string")
    packed = network.word_edges(df, "text", 3, packed=True)
    edges, nodes = network.filter_by_centrality(packed, 0.05)
    assert edges.count() == nodes.count() == network.degree_centrality(packed).count() == 0
    assert tuple(network.network_size(packed).first()) == (0, 0, 0)
    one = network.word_edges(spark.createDataFrame([("a a a",)], "text string"), "text", 3, packed=True)
    assert [tuple(r) for r in network.degree_centrality(one).collect()] == [("a", 2, 1.0)]


@pytest.mark.parametrize("name", ["degree_centrality", "network_size", "filter_network", "word_network", "betweenness"])
def test_network_queries_keep_no_row_per_edge(spark, monkeypatch, name):
    from glyphmill.plans import text_queries, training_queries
    from glyphmill.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    n_edges = QUERIES["word_edges"](spark, sf).count()
    kept = []
    plain = network.materialize
    for module in (network, text_queries, training_queries):
        monkeypatch.setattr(module, "materialize", lambda df: kept.append(plain(df)) or kept[-1], raising=False)
    out = QUERIES[name](spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(t.count() for t in kept) < n_edges / 3
    # The few filtered edges may be exploded.
    assert name == "word_network" or "explode(array(w1" not in plan


def test_betweenness_as_tables_by_groups_of_sources(spark, monkeypatch):
    """Links that no task may hold: groups of two sources, the values of one search; nodes without links and doubled ones."""
    monkeypatch.setattr(network, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(network, "STATE_ROWS", 22)
    for name in ("random", "two_parts"):
        pairs = GRAPHS[name]
        nodes = sorted({v for p in pairs for v in p}) + ["lone"]
        adj = {v: sorted({b if a == v else a for a, b in pairs if v in (a, b)}) for v in nodes}
        table = spark.createDataFrame([(v,) for v in nodes], "word string")
        got = {r["word"]: r["betweenness"] for r in network.betweenness(edges_of(spark, pairs + [("a", "a")]), table).collect()}
        assert got == pytest.approx(brandes(nodes, adj), abs=1e-12)


@pytest.mark.parametrize("once", [True, False])
def test_betweenness_of_some_sources_and_a_long_path(spark, monkeypatch, once):
    monkeypatch.setattr(network, "BLOCK_WORDS", 4)
    if not once:
        monkeypatch.setattr(network, "BROADCAST_BYTES", 0)
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)]
    sources = spark.createDataFrame([("n00",), ("n00",), ("n12",), (None,)], "word string")
    got = {r["word"]: r["betweenness"] for r in network.betweenness(edges_of(spark, pairs), None, sources).collect()}
    # Every inner word owes the words behind it, 12 from both ends together; the sum is scaled from four rows to 13 words.
    want = {f"n{i:02d}": (12 if 0 < i < 12 else 0) / (12 * 11) * 13 / 4 for i in range(13)}
    assert got == pytest.approx(want, abs=1e-12)


def test_network_metrics_has_the_betweenness_of_every_word(spark, tmp_path):
    """Forty legs of two words at one hub: the words of the legs are no hubs."""
    from glyphmill.plans import training_queries

    legs = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rows = [(i, f"hub x{x} y{x}", "en", "s", 1) for i, x in enumerate(legs * 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.betweenness for r in training_queries.network_metrics(spark, str(tmp_path)).collect()}
    want = {f"x{x}": round(2 * 79 / (80 * 79), 6) for x in legs} | {f"y{x}": 0.0 for x in legs} | {"hub": round((80 * 79 - 80) / (80 * 79), 6)}
    assert got == pytest.approx(want, abs=2e-6)
