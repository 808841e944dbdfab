"""Near-duplicate removal against a sequential pass in plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.functions.hashing import MERSENNE_31, py_int31
from glyphmill.operators import dedup, near_pairs


def sequential(rows, keep_groups=False):
    """Drop a row that shares a bucket with an earlier kept row."""
    seen, dropped = set(), set()
    buckets = {}
    for o, key in rows:
        buckets.setdefault(o, []).append(key)
    for o in sorted(buckets):
        if any(k in seen for k in buckets[o]):
            dropped.add(o)
        else:
            seen.update(buckets[o])
    return dropped


def test_band_sizes():
    assert dedup.best_bands(0.75, 128) == (11, 11)
    assert dedup.best_bands(0.8, 128) == (9, 13)


def test_chain_keeps_both_ends(spark):
    bands = spark.createDataFrame([(1, 0, "p"), (2, 0, "p"), (2, 1, "q"), (3, 1, "q"), (1, 1, "x"), (3, 0, "y")], "ord long, band int, key string")
    assert {r["ord"] for r in dedup.greedy_dropped(bands, ["band", "key"]).collect()} == {2}


@pytest.mark.parametrize("seed", range(2))
def test_greedy_equals_a_sequential_pass(spark, seed, hot_keys):
    rng = random.Random(seed)
    n, width = 60, rng.choice([2, 8, 30])
    rows = [(o, (b, str(rng.randrange(width)))) for o in range(n) for b in range(3)]
    rows += [(o, (3, "hot")) if o % 3 == 0 else (o, (3, f"own{o}")) for o in range(n, 2 * n)]
    df = spark.createDataFrame([(o, b, k) for o, (b, k) in rows], "ord long, band int, key string")
    got = {r["ord"] for r in dedup.greedy_dropped(df.repartition(rng.choice([1, 4, 16])), ["band", "key"]).collect()}
    assert got == sequential(rows)


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(60)]
        texts.append(base)
        for _ in range(rng.randrange(3)):
            near = list(base)
            near[rng.randrange(60)] = "changed"
            texts.append(near)
    rng.shuffle(texts)
    rows = [(i, "test" if i % 7 == 6 else "train", " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(900, "train", None), (901, "train", "  "), (902, "train", "two words"), (903, "train", rows[0][2])]


def plain_bands(text, n=3, num_perm=128):
    toks = text.lower().split() if text else []
    if len(toks) < n:
        return None
    hs = [py_int31(" ".join(toks[i : i + n])) for i in range(len(toks) - n + 1)]
    sig = [min((a * h + b) % MERSENNE_31 for h in hs) for a, b in dedup.permutations(num_perm)]
    return [(i, tuple(sig[i * 11 : i * 11 + 11])) for i in range(11)]


@pytest.mark.parametrize("cross", [True, False])
def test_near_duplicates_end_to_end(spark, cross):
    rows = corpus()
    place = lambda r: ((0 if r[1] == "train" else 1), r[0])
    kept, seen = [], {}
    for r in sorted(rows, key=place):
        keys = plain_bands(r[2])
        if keys is None:
            continue
        index = seen.setdefault(None if cross else r[1], set())
        if not any(k in index for k in keys):
            kept.append(r[0])
            index.update(keys)
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "id long, split string, text string")
    df = df.withColumn("ord", F.struct(F.when(F.col("split") == "train", 0).otherwise(1).alias("s"), F.col("id").alias("r")))
    got = dedup.drop_near(df, by=[] if cross else ["split"])
    assert sorted(r["id"] for r in got.collect()) == sorted(kept)
    if cross:
        again = dedup.drop_near(got)
        assert again.count() == len(kept)


def test_keep_short(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "x y z w")], "ord long, text string")
    assert dedup.drop_near(df).count() == 1 and dedup.drop_near(df, keep_short=True).count() == 2


def test_links_point_to_the_first_of_a_bucket(spark, hot_keys):
    rows = [(o, 0, "hot") for o in range(50)] + [(7, 1, "z"), (9, 1, "z"), (3, 1, "alone")]
    links = dedup.candidate_links(spark.createDataFrame(rows, "ord long, band int, key string"))
    assert sorted(tuple(r) for r in links.collect()) == sorted([(o, 0) for o in range(1, 50)] + [(9, 7)])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=0, max_size=8), min_size=2, max_size=6))
def test_jaccard(spark, docs):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id long, t string")
    sets = {r["id"]: set(r["s"]) for r in df.select("id", tx.shingles(F.col("t"), 2).alias("s")).collect()}
    links = spark.createDataFrame([(i, 0) for i in range(1, len(docs))], "ord long, leader long")
    for r in dedup.verified_links(df, links, "t", "id", 2).collect():
        a, b = sets[r["ord"]], sets[r["leader"]]
        assert r["jaccard"] == (pytest.approx(len(a & b) / len(a | b)) if a | b else None)


def test_source_overlap_counts_texts_once(spark):
    df = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), ("t", "c"), ("u", "a"), ("u", "b"), ("v", "a")], "text string, source string")
    got = sorted(tuple(r) for r in dedup.source_overlap(df, "text", "source").collect())
    assert got == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def grams(text):
    words = text.lower().split() if text else []
    return frozenset(" ".join(words[i : i + 3]) for i in range(len(words) - 2))


def similarity(a, b):
    return len(a & b) / len(a | b)


def plain_buckets(text):
    hashes = [py_int31(g) for g in grams(text)]
    sig = [min((a * h + b) % MERSENNE_31 for h in hashes) for a, b in dedup.permutations(128)]
    return {(i, tuple(sig[i * near_pairs.ROWS : (i + 1) * near_pairs.ROWS])) for i in range(near_pairs.BANDS)}


@pytest.mark.parametrize("limits", [{}, {"block_rows": 3}, {"block_shingles": 200}])
def test_verified_pairs_equal_all_pairs(spark, hot_keys, limits):
    rows = corpus()
    sets = {o: grams(t) for o, _, t in rows if grams(t)}
    first = {}
    for o in sorted(sets):
        first.setdefault(sets[o], o)
    buckets = {o: plain_buckets(t) for o, _, t in rows if o in first.values()}
    want = {
        (b, a): similarity(sets[a], sets[b])
        for a in buckets for b in buckets if a < b and buckets[a] & buckets[b] and similarity(sets[a], sets[b]) >= 0.75
    }
    df = spark.createDataFrame(rows, "ord long, split string, text string").repartition(5)
    pairs, membership = near_pairs.verified_pairs(df, "text", "ord", 0.75, **limits)
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(want) and {(a, b): pytest.approx(s) for a, b, s in found} == want
    ends = [o for pair in want for o in pair]
    assert {tuple(r) for r in membership.collect()} == {(o, first[s], ends.count(first[s])) for o, s in sets.items()}


@pytest.mark.parametrize("by", [None, ["split"]])
def test_verified_removal_equals_a_sequential_pass(spark, by):
    rows = corpus()
    kept = []
    for o, split, text in sorted(rows):
        mine = grams(text)
        mates = [t for _, s, t in kept if by is None or s == split]
        if mine and all(similarity(mine, grams(m)) < 0.8 or not plain_buckets(text) & plain_buckets(m) for m in mates):
            kept.append((o, split, text))
    df = spark.createDataFrame(rows, "ord long, split string, text string").repartition(5)
    got = near_pairs.drop_verified(df, by=by, threshold=0.8)
    assert sorted(r["ord"] for r in got.collect()) == [o for o, _, _ in kept]
    assert near_pairs.drop_verified(df, by=by, threshold=0.8, keep_short=True).count() == len(kept) + 3


def test_a_template_family_is_kept_whole_in_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    shared = [f"t{i}" for i in range(80)]
    rows = [(o, " ".join([*shared, *[f"x{rng.randrange(10**9)}" for _ in range(20)]])) for o in range(2000)]
    rounds = []
    plain = near_pairs.is_empty
    monkeypatch.setattr(near_pairs, "is_empty", lambda df: rounds.append(1) or plain(df))
    df = spark.createDataFrame(rows, "ord long, text string")
    assert near_pairs.drop_verified(df).count() == 2000
    assert len(rounds) <= 10


def test_first_kept_over_a_chain(spark):
    links = [(o + 1, o) for o in range(30)] + [(100, 0), (101, 1)]
    gone = {r["ord"] for r in near_pairs.first_kept(spark.createDataFrame(links, "later long, earlier long")).collect()}
    assert gone == set(range(1, 31, 2)) | {100}


def test_verified_pairs_of_empty_and_short_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b")]
    for part in (rows, []):
        pairs, membership = near_pairs.verified_pairs(spark.createDataFrame(part, "ord long, text string"), "text", "ord")
        assert pairs.count() == 0 and membership.count() == 0


def test_a_long_chain_of_links_finishes(spark):
    rows = [(o, 0, f"{o // 2}") for o in range(300)] + [(o, 1, f"{(o + 1) // 2}") for o in range(300)]
    bands = spark.createDataFrame(rows, "ord long, band int, key string")
    gone = {r["ord"] for r in dedup.greedy_dropped(bands.where("ord < 40"), ["band", "key"]).collect()}
    assert gone == set(range(1, 40, 2))


def test_sets_move_only_to_the_bucket_where_a_pair_is_compared(spark, monkeypatch):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(20)]
    rows = [(2 * o + k, " ".join([*t, f"end{k}"])) for o, t in enumerate(texts) for k in (0, 1)]
    sent = []
    plain = near_pairs.materialize

    def noted(df):
        out = plain(df)
        if "side" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(near_pairs, "materialize", noted)
    pairs, _ = near_pairs.verified_pairs(spark.createDataFrame(rows, "ord long, text string"), "text", "ord")
    assert {(r.later, r.earlier) for r in pairs.collect()} == {(2 * o + 1, 2 * o) for o in range(20)}
    assert sent == [40]


@pytest.mark.parametrize("seed", range(5))
def test_rows_met_in_a_bucket_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n = 120
    frame = pd.DataFrame({"band": 2, "key": np.sort(rng.integers(0, 6, n)), "i": 0, "j": rng.integers(0, 2, n), "size": rng.integers(5, 15, n)})
    frame["side"] = [int(rng.integers(0, 2)) if j else 0 for j in frame["j"]]
    frame["keys"] = [*rng.integers(0, 4, (n, 4))]
    frame = frame.sort_values(near_pairs.UNIT, kind="stable", ignore_index=True)
    rows = frame.to_dict("records")

    def meet(x, y):
        same = all(x[c] == y[c] for c in near_pairs.UNIT) and (x["i"] == x["j"] or x["side"] != y["side"])
        ratio = min(x["size"], y["size"]) / max(x["size"], y["size"])
        return same and ratio >= 0.75 and not (x["keys"][:2] == y["keys"][:2]).any()

    want = [any(meet(x, y) for k, y in enumerate(rows) if k != a) for a, x in enumerate(rows)]
    assert near_pairs.met_here(frame, 0.75).tolist() == want and 0 < sum(want) < n
    cut = [frame.iloc[a : a + 7] for a in range(0, n, 7)]
    units = [f for f in near_pairs.whole_units(iter(cut))]
    assert pd.concat(units, ignore_index=True)["keys"].map(tuple).tolist() == frame["keys"].map(tuple).tolist()
    assert len({k for f in units for k in map(tuple, f[near_pairs.UNIT].drop_duplicates().to_numpy())}) == sum(len(f[near_pairs.UNIT].drop_duplicates()) for f in units)


def test_signature_at_the_ends_of_the_hashes():
    ab = dedup.permutations(128)
    for hashes in ([0], [MERSENNE_31], [MERSENNE_31 - 1, 1], list(range(1, 1200))):
        got = dedup._signature(np.array(hashes, dtype=">u4"), *(np.array(x, dtype=np.uint64) for x in zip(*ab)))
        assert got.tolist() == [min((a * h + b) % MERSENNE_31 for h in hashes) for a, b in ab]
