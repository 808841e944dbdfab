import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import encoding, merges
from glyphmill.plans import training_queries


def joined(s, pair):
    out, j = [], 0
    while j < len(s):
        if tuple(s[j : j + 2]) == pair:
            out.append(s[j] + s[j + 1])
            j += 2
        else:
            out.append(s[j])
            j += 1
    return out


def plain_merges(words, n):
    """One pair at a time, with an index from pairs to words; ties by the smaller symbols."""
    types = [(list(w), k) for w, k in words.items()]
    count, where = Counter(), defaultdict(set)
    for i, (s, k) in enumerate(types):
        for p in zip(s, s[1:]):
            count[p] += k
            where[p].add(i)
    heap = [(-k, p) for p, k in count.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < n:
        k, best = heapq.heappop(heap)
        if not count[best] or -k != count[best]:
            continue
        out.append(best)
        changed = set()
        for i in list(where[best]):
            s, k = types[i]
            new = joined(s, best)
            types[i] = (new, k)
            for p in zip(s, s[1:]):
                count[p] -= k
                changed.add(p)
            for p in zip(new, new[1:]):
                count[p] += k
                where[p].add(i)
                changed.add(p)
        for p in changed:
            if count[p]:
                heapq.heappush(heap, (-count[p], p))
    return out


def words_of(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


@pytest.mark.parametrize("look", [2, 512])
def test_batches_equal_merging_one_by_one(spark, look):
    rng = random.Random(look)
    words = ["".join(rng.choice("aab$\\é") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    alphabet, got = merges.train_merges(df, F.array("w"), 16, look)
    assert got == plain_merges(Counter(words), 16) and alphabet == sorted(set("".join(words)))


def test_types_go_over_many_blocks_and_flushes(spark, monkeypatch):
    """Blocks and held sums of a few numbers; runs of one symbol and characters beyond 16 bits."""
    monkeypatch.setattr(merges, "BLOCK", 20)
    monkeypatch.setattr(merges, "HELD", 8)
    rng = random.Random(5)
    words = ["".join(rng.choice("aaab\U0001D400é") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    frames = [merges.word_types(df, F.array("w")).toPandas().iloc[i : i + 5] for i in (0, 5, 10)]
    blocks = [b for f in merges._pack(iter(frames)) if f["kind"].iloc[0] == 0 for b in f["symbols"]]
    assert 1 < len(blocks) <= 3 and all(len(b) % 4 == 0 for b in blocks)
    alphabet, got = merges.train_merges(df, F.array("w"), 25, 8)
    assert got == plain_merges(Counter(words), 25) and alphabet == sorted(set("".join(words)))


@pytest.mark.parametrize("whole, pairs", [(0, 4), (150, 4), (1 << 24, 4), (1 << 24, 1 << 17)])
def test_all_merges_in_rounds_and_in_one_task(spark, monkeypatch, whole, pairs):
    """Until no pair is left: by rounds alone, by one task after some rounds, and by one task that follows few pairs or all."""
    monkeypatch.setattr(merges, "WHOLE", whole)
    monkeypatch.setattr(merges, "PAIRS", pairs)
    monkeypatch.setattr(merges, "EVERY", 2)
    rng = random.Random(11)
    words = ["".join(rng.choice("aabbc\U0001D400") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    want = plain_merges(Counter(words), 10_000)
    assert merges.train_merges(df, F.array("w"), 10_000, 512)[1] == want


@pytest.mark.parametrize("pairs", [3, 50, 1 << 17])
def test_one_array_of_many_words_against_plain_merging(monkeypatch, pairs):
    monkeypatch.setattr(merges, "PAIRS", pairs)
    for seed in range(12):
        rng = random.Random(seed)
        words = Counter("".join(rng.choice("aaabcd"[: 2 + seed % 5]) for _ in range(rng.randint(1, 14))) for _ in range(150))
        s, n = merges._longer(np.array([c for w in words for c in [*map(ord, w), -1]], np.int32), np.array(list(words.values())))
        whole, got = merges._Whole(s, n, []), []
        while (pair := whole.merge()) is not None:
            got.append(pair)
        assert got == plain_merges(words, 10_000)


def test_the_trained_vocabulary_has_as_many_entries_as_the_reference():
    assert training_queries.MERGES == 70_000


def test_no_pairs_and_empty_tables(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "w string")
    assert merges.train_merges(df, F.array("w"), 5) == (["a"], [])
    assert merges.train_merges(df.limit(0), F.array("w"), 5) == ([], [])


def test_two_thousand_merges_of_a_corpus(spark):
    df = words_of(spark, "sf0.01")
    alphabet, got = merges.train_merges(df, tx.clean_words(F.col("text")), 2000)
    words = Counter({r.w: r.n for r in df.select(F.explode(tx.clean_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()})
    assert len(got) == 2000 and got == plain_merges(words, 2000)


def test_subword_queries_against_plain_merging(spark, monkeypatch):
    """Every row of the queries, with words cut by going through all merges in order."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(training_queries, "MERGES", 60)
    monkeypatch.setattr(training_queries, "_TRAINED", {})
    vocab = training_queries.subwords(spark, sf)
    entries = list(dict.fromkeys([*vocab.alphabet, *(a + b for a, b in vocab.merges)]))
    assert vocab.size == 5 + len(entries)
    ids = {s: 5 + i for i, s in enumerate(entries)}
    plain = {}
    rows = words_of(spark, "sf0.001").select("doc_id", tx.clean_words(F.col("text")).alias("w")).collect()
    for w in {w for r in rows for w in r.w}:
        s = list(w)
        for pair in vocab.merges:
            s = joined(s, pair)
        plain[w] = [ids[x] for x in s]
    want = {r.doc_id: [i for w in r.w for i in plain[w]] for r in rows}
    get = lambda name: {r.doc_id: r for r in getattr(training_queries, name)(spark, sf).collect()}
    assert {k: (r.n_words, r.n_tokens) for k, r in get("token_count_subword").items()} == {r.doc_id: (len(r.w), len(want[r.doc_id])) for r in rows}
    shown = lambda xs: ",".join(map(str, xs))
    cut = {k: [2, *v[:510], 3] for k, v in want.items()}
    assert {k: (r.input_ids, r.n_ids) for k, r in get("encode_subword_truncate").items()} == {k: (shown(v), len(v)) for k, v in cut.items()}
    long = {k: [2, *v[:2046], 3] for k, v in want.items()}
    padded = {k: (shown(v + [0] * (2048 - len(v))), shown([1] * len(v) + [0] * (2048 - len(v)))) for k, v in long.items()}
    assert {k: (r.input_ids, r.attention_mask) for k, r in get("encode_subword_pad").items()} == padded
    assert {k: r.labels for k, r in get("causal_labels_subword").items()} == {k: shown(v + [-100] * (2048 - len(v))) for k, v in long.items()}
    for k, r in get("mlm_mask_subword").items():
        given, labels = list(map(int, r.input_ids.split(","))), list(map(int, r.labels.split(",")))
        whole = cut[k] + [0] * (512 - len(cut[k]))
        assert all(y in (-100, x) and (y != -100 or g == x) and 0 <= g < vocab.size for x, y, g in zip(whole, labels, given))


def test_unknown_characters_and_bounded_memory():
    known = merges.Segmenter(["a", "b"], [("a", "b")], first_id=5, unknown=1, remember=2)
    assert [known[w] for w in ("ab", "aab", "c", "ab", "", "bb")] == [[7], [5, 7], [1], [7], [], [6, 6]] and len(known) <= 2
