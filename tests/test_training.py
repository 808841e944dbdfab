"""Encoding, masking, schedules, merges, inference and metrics."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import merges as merges_of
from glyphmill.operators import encoding, evaluation, inference


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame([(0, "a b a c a b"), (1, ""), (2, "zz a")], "id long, text string")
    vocab = encoding.word_vocabulary(df, tx.word_tokens(F.col("text")), 2)
    return df, vocab


def encoded(toy, **kw):
    df, vocab = toy
    out = encoding.encode(df, tx.word_tokens(F.col("text")), vocab, 6, keep=["id"], **kw)
    return {r["id"]: r for r in out.collect()}


def test_padding_right_and_left(toy):
    right, left = encoded(toy), encoded(toy, pad_left=True)
    assert right[0]["input_ids"] == [2, 5, 6, 5, 1, 3]
    assert right[1]["input_ids"] == [2, 3, 0, 0, 0, 0] and left[1]["input_ids"] == [0, 0, 0, 0, 2, 3]
    assert right[2]["attention_mask"] == [1, 1, 1, 1, 0, 0] and left[2]["attention_mask"] == [0, 0, 1, 1, 1, 1]
    assert right[2]["special_tokens_mask"] == [1, 0, 0, 1, 1, 1]
    assert encoded(toy, pad=False)[2]["input_ids"] == [2, 1, 5, 3]


def test_masking_shares(spark):
    n, length = 400, 102
    df = spark.range(n).select(
        "id", F.array_repeat(F.lit(7), length).alias("input_ids"),
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when((i == 0) | (i == length - 1), 1).otherwise(0)).alias("special_tokens_mask"),
    )
    rows = encoding.mlm_mask(df, "id", 10_000, p=0.3).collect()
    ids = np.array([r["input_ids"] for r in rows])
    labels = np.array([r["labels"] for r in rows])
    assert (labels[:, [0, -1]] == -100).all() and (ids[:, [0, -1]] == 7).all()
    chosen = labels[:, 1:-1] != -100
    assert chosen.mean() == pytest.approx(0.3, abs=0.01)
    picked = ids[:, 1:-1][chosen]
    assert (picked == encoding.MASK_ID).mean() == pytest.approx(0.8, abs=0.02)
    assert (picked == 7).mean() == pytest.approx(0.1, abs=0.02)
    assert (ids[:, 1:-1][~chosen] == 7).all()
    assert rows[0]["input_ids"] == encoding.mlm_mask(df.repartition(3), "id", 10_000, p=0.3).where("id = %d" % rows[0]["id"]).first()["input_ids"]


def test_causal_labels(spark):
    df = spark.createDataFrame([([2, 9, 3, 0],)], "ids array<int>")
    assert df.select(encoding.causal_labels(F.col("ids"))).first()[0] == [2, 9, 3, -100]
    assert df.select(encoding.causal_labels(F.col("ids"), None)).first()[0] == [2, 9, -100, 0]


@pytest.mark.parametrize("n,batch", [(1000, 1), (1000, 8), (37, 5)])
def test_curriculum(spark, n, batch):
    points, seq = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], encoding.context_lengths(128, 1024)
    assert seq == [128 + i * (1024 - 128) // 5 for i in range(5)] + [1024]
    total = math.ceil(n / batch)
    out = encoding.curriculum(spark.range(n), "id", 128, 1024, batch).collect()
    for r in out:
        step = r["id"] // batch
        progress = step / total
        want = next((seq[i] for i in range(5) if points[i] <= progress < points[i + 1]), 1024)
        # A whole-number comparison stands in for the rounded quotient at the breakpoints.
        if not any(math.isclose(progress, p) for p in points):
            assert r["max_length"] == want
        assert r["step"] == step
    assert encoding.total_steps(1001, 3, 4, 2, 2) == math.ceil(1001 * 3 / 16)


def plain_merges(freq, n):
    words = {w: list(w) for w in freq}
    out = []
    while len(out) < n:
        pairs = Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += freq[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        for w, s in words.items():
            i, new = 0, []
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                    new.append(s[i] + s[i + 1])
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            words[w] = new
    return out


@pytest.mark.parametrize("text,n", [
    ("low " * 5 + "lower " * 2 + "newest " * 6 + "widest " * 3, 12),
    ("aaa aaaa aa banana bandana " * 3 + "abab ababab", 10),
    ("a$b a$b a\\c a\\c x", 4),
])
def test_merges_equal_one_by_one_merging(spark, text, n):
    df = spark.createDataFrame([(t,) for t in text.split()], "text string")
    alphabet, merges = merges_of.train_merges(df, F.split("text", " "), n)
    assert merges == plain_merges(Counter(text.split()), n)
    assert alphabet == sorted(set(text.replace(" ", "")))


def test_batch_inference(spark):
    df = spark.createDataFrame([(1, "say <mask> now"), (2, "<mask> first")], "id long, text string")
    out = inference.batch_infer(df, "id", "text", {"prev": inference.fill_with_previous(), "n": inference.count_words}, 1)
    assert sorted(map(tuple, out.collect())) == [(1, "n", "3"), (1, "prev", "say say now"), (2, "n", "2"), (2, "prev", " first")]
    assert inference.wide(out, "id", ["prev", "n"]).where("id = 1").first()["prev"] == "say say now"


def test_lm_metrics(spark):
    logits = [[1000.0, 999.0, -1000.0], [0.5, 0.1, 0.2], [0.0, 3.0, 1.0]]
    labels = [0, -100, 2]
    df = spark.createDataFrame(list(zip(logits, labels)), "logits array<double>, label int")
    r = evaluation.lm_metrics(df, "logits", "label").first()
    x = np.array(logits)
    logp = x - x.max(axis=1, keepdims=True)
    logp -= np.log(np.exp(logp).sum(axis=1, keepdims=True))
    loss = -np.mean([logp[0, 0], logp[2, 2]])
    p = np.exp(logp).mean(axis=0)
    assert r["loss"] == pytest.approx(loss) and r["perplexity"] == pytest.approx(np.exp(loss))
    assert r["accuracy"] == pytest.approx(0.5) and r["accuracy_all"] == pytest.approx(1 / 3)
    assert r["token_entropy"] == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum())


def test_pooling(spark):
    rows = [(1, 0, 1, [1.0, -5.0]), (1, 1, 1, [3.0, -1.0]), (1, 2, 0, [99.0, 99.0]), (2, 0, 0, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "doc long, pos int, mask int, v array<double>")
    pooled = evaluation.pool_vectors(df, ["doc"], "pos", "mask", "v")
    get = lambda kind: {r["doc"]: r["embedding"] for r in evaluation.as_vectors(pooled, ["doc"], kind).collect()}
    assert get("cls") == {1: [1.0, -5.0], 2: [7.0, 7.0]}
    assert get("mean") == {1: [2.0, -3.0], 2: [0.0, 0.0]}
    assert get("max")[1] == [3.0, -1.0]


def test_leaderboard_published_rates(spark):
    # wins, comparisons and rates of a published arena
    arena = {"large": (105, 120, 87.5), "medium": (99, 127, 77.95), "base": (19, 130, 14.62)}
    rows = [(m, i < w) for m, (w, n, _) in arena.items() for i in range(n)]
    board = evaluation.leaderboard(spark.createDataFrame(rows, "model string, won boolean"), "model", F.col("won"))
    assert [(r["model"], r["wins"], r["total"], r["win_rate"]) for r in board.collect()] == [(m, *v) for m, v in arena.items()]
    gains = {r["model"]: r["gain_points"] for r in evaluation.gain_over(board, "base").collect()}
    assert gains["large"] == 72.88 and gains["base"] == 0.0


def test_every_epoch_has_its_own_order_and_progress(spark):
    from glyphmill.functions.hashing import py_int31
    from glyphmill.operators import encoding

    ids = list(range(37))
    order = [(e, i) for e in range(3) for i in sorted(ids, key=lambda i: (py_int31(f"5|{e}|{i}"), i))]
    steps = -(-len(order) // 4)
    lengths = encoding.context_lengths(16, 64)
    want = {(i, e, at // 4, lengths[(at // 4) * 5 // steps]) for at, (e, i) in enumerate(order)}
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = encoding.epoch_schedule(df, "id", 16, 64, 4, epochs=3, seed=5).collect()
    assert len(got) == len(order) and {tuple(r) for r in got} == want
    assert encoding.epoch_schedule(df.limit(0), "id", 16, 64, 4, epochs=2).count() == 0


def test_fill_mask_scores_both_neighbours(spark):
    from glyphmill.operators import inference

    counts = spark.createDataFrame([("a", "x", 3), ("x", "b", 2), ("a", "y", 6), ("y", "b", 1), ("a", "z", 9), ("q", "b", 9)], "w1 string, w2 string, n_pairs long")
    rows = [(1, "A <mask> b"), (2, "<mask> b"), (3, "a <mask>"), (4, "a b"), (5, None), (6, ""), (7, "n <mask> b"), (8, "c a <mask> b d")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = sorted(tuple(r) for r in inference.fill_by_bigrams(df, "id", "t", counts, 2).collect())
    assert got == [(i, rank, w, 6) for i in (1, 8) for rank, w in ((1, "x"), (2, "y"))]


def test_fill_candidates_come_from_the_smaller_side(spark):
    """A left word of few successors before a right word of many predecessors, and the reverse."""
    rows = [("rare", "x", 2), ("x", "the", 3), ("rare", "y", 1), ("y", "the", 1), ("the", "x", 5), ("x", "end", 1)]
    rows += [(f"p{i}", "the", 1) for i in range(30)] + [("the", f"s{i}", 1) for i in range(30)]
    counts = spark.createDataFrame(rows, "w1 string, w2 string, n_pairs long")
    before = counts.selectExpr("w1 AS left", "w2 AS word", "n_pairs AS _n1")
    after = counts.selectExpr("w1 AS word", "w2 AS right", "n_pairs AS _n2")
    contexts = spark.createDataFrame([("rare", "the"), ("the", "end"), ("the", "nowhere")], "left string, right string")
    got = sorted(tuple(r) for r in inference.candidates(contexts, before, after).select("left", "right", "word", "_n1", "_n2").collect())
    assert got == [("rare", "the", "x", 2, 3), ("rare", "the", "y", 1, 1), ("the", "end", "x", 5, 1)]


@pytest.mark.parametrize("blocks, looked_up, contexts", [(1 << 21, 1 << 22, 1 << 22), (40, 3, 1 << 22), (40, 1, 7)])
def test_packed_fill_mask_equals_counting_by_hand(spark, monkeypatch, blocks, looked_up, contexts):
    """Many blocks of candidate words, few look-ups at once and several shares of the contexts; ties, loops, hot words and rows without a context."""
    from collections import defaultdict

    from glyphmill.operators import network

    for name, value in (("BLOCK_PAIRS", blocks), ("LOOKED_UP", looked_up), ("CONTEXTS", contexts), ("BUCKET", 4)):
        monkeypatch.setattr(inference, name, value)
    monkeypatch.setattr(network, "CODED_WORDS", 16)
    rng = random.Random(3)
    vocabulary = ["the", "the", "the", "été", "a", "ab", "b", "c", "dd", "zz", "of", "of"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "lone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    counts = Counter(p for t in texts for p in zip((t or "").split(), (t or "").split()[1:]))
    masked = [(i, f"{rng.choice(vocabulary)} <mask> {rng.choice([*vocabulary, 'UNSEEN', 'The'])} x") for i in range(50)]
    masked += [(50, "<mask> the"), (51, "the <mask>"), (52, None), (53, "the of"), (7, "the <mask> of")]
    want = []
    for i, t in masked:
        w = (t or "").split(" ")
        if "<mask>" not in w or not 0 < w.index("<mask>") < len(w) - 1:
            continue
        left, right = w[w.index("<mask>") - 1].lower(), w[w.index("<mask>") + 1].lower()
        scores = defaultdict(int)
        for (x, y), n in counts.items():
            if x == left and counts[y, right]:
                scores[y] = n * counts[y, right]
        best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:3]
        want += [(i, rank + 1, word, score) for rank, (word, score) in enumerate(best)]
    rows = spark.createDataFrame(masked, "id long, m string")
    packed = network.bigram_counts(docs, "t", packed=True)
    got = inference.fill_by_bigrams(rows, "id", "m", packed, 3)
    plain = inference.fill_by_bigrams(rows, "id", "m", network.bigram_counts(docs, "t"), 3)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(want) == sorted(map(tuple, plain.collect()))


def test_packed_bigrams_across_documents_and_of_nothing(spark):
    from glyphmill.operators import network

    docs = spark.createDataFrame([(1, "b a"), (2, ""), (3, "a a c")], "id long, t string")
    packed = network.bigram_counts(docs, "t", "id", packed=True)
    names = {r.id: r.word for r in packed.words.collect()}
    assert names == {0: "a", 1: "b", 2: "c"}
    found = {}
    for block in network.numbered_pairs(packed.pairs.toArrow().to_batches()):
        for a, b, n in zip(*(x.tolist() for x in block)):
            found[names[a], names[b]] = found.get((names[a], names[b]), 0) + n
    assert found == {tuple(r)[:2]: r.n_pairs for r in network.bigram_counts(docs, "t", "id").collect()}
    masked = spark.createDataFrame([(1, "a <mask> c")], "id long, m string")
    assert inference.fill_by_bigrams(masked, "id", "m", network.bigram_counts(docs.limit(0), "t", packed=True)).collect() == []


def test_fill_mask_makes_no_row_per_candidate(spark, monkeypatch):
    from glyphmill.plans import training_queries

    monkeypatch.setattr(inference, "candidates", lambda *a: pytest.fail("a row per candidate"))
    assert training_queries.fill_mask(spark, "/root/testdata/sf0.001").count() > 0
