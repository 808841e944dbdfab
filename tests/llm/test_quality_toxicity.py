import random
from collections import Counter

import numpy as np
import pytest
from helpers import docs_frame, make_docs
from pyspark.sql import functions as F

from glyphmill.llm import host_rules, toxicity


def plain_repeats(words, window=8):
    runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    many = Counter(runs)
    return len({i + k for i, r in enumerate(runs) if many[r] > 1 for k in range(window)})


def test_repeated_words():
    rng = random.Random(2)
    for n in (0, 7, 8, 9, 16, 40, 300):
        for letters in (1, 2, 3):
            words = [rng.choice("abc"[:letters]) for _ in range(n)]
            assert host_rules.repeated_words(words) == plain_repeats(words)
    block = "one two three four five six seven eight".split()
    assert host_rules.repeated_words([*block, "x", *block]) == 16


def test_counts_of_odd_texts():
    assert host_rules.text_counts(None) == host_rules.text_counts("") == (0, 0, 0, 0, 0, 0)
    words, chars, symbols, lines, dups, _ = host_rules.text_counts("é#b\x0bc d\n\n \nx<>\nx<>\n")
    assert (words, chars, symbols, lines, dups) == (4, 12, 5, 3, 1)


def test_rates_shrink_towards_the_mean(spark):
    rows = [("big", i % 2 == 0) for i in range(200)] + [("good", False)] * 200 + [("tiny", True)]
    df = spark.createDataFrame(rows, "h string, bad boolean")
    rates = {r.h: r for r in host_rules.host_rates(df, "h", "bad").collect()}
    mean = 101 / 401
    assert mean < rates["tiny"].rate < 1 and 0 < rates["good"].rate < mean < rates["big"].rate < 0.5
    assert host_rules.host_rates(df.limit(0), "h", "bad").count() == 0


def test_verdicts(spark, hot_keys):
    clean = " ".join(f"word{i}" for i in range(30))
    junk = " ".join(["#$%"] * 40)
    rows = [(i, clean, "", "good", 0) for i in range(40)] + [(100 + i, junk if i else clean, "", "spam", 0) for i in range(40)]
    rows += [(200, clean, "", None, 0), (201, None, "", None, 0), (202, "", "", "good", 0), (203, clean, "", "good", 0), (203, clean, "", "good", 0)]
    df = docs_frame(spark, rows).withColumn("kept", F.lit("x")).withColumn("n", F.lit(1))
    counted = df.select("doc_id", "source", "kept", "n", host_rules.count_texts(F.col("text")).alias("c")).select("doc_id", "source", "kept", "n", "c.*")
    out = {r.doc_id: r for r in host_rules.judge(counted.drop("n"), "source").collect()}
    assert all(out[i].kept for i in range(40)) and out[203].kept and out[200].kept
    assert not any(out[100 + i].kept for i in range(40)) and not out[100].base_failed
    assert out[201].base_failed and not out[202].kept
    assert host_rules.judge(counted.limit(0), "source").count() == 0


def plain_segments(scores):
    """Maximal segments by definition: split at the highest one, left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-9 or (at and abs(s - best) <= 1e-9 and j - i < at[1] - at[0]):
                best, at = s, (i, j)
    if at is None:
        return []
    left = plain_segments(scores[: at[0]])
    right = [(i + at[1], j + at[1], s) for i, j, s in plain_segments(scores[at[1] :])]
    return [*left, (*at, best), *right]


def test_segments_against_the_definition():
    rng = random.Random(8)
    for _ in range(300):
        # Distinct powers keep sums apart, so that the definition has one answer.
        scores = [rng.choice([-1, 1]) * (rng.random() + 0.01) for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        want = plain_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def labelled(n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["Vilecur,", "vilecast", "nastyone."])
        docs.append((i, " ".join(words), "", "", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learned_scores_tell_the_classes_apart(spark):
    docs, labels = labelled()
    frame = docs_frame(spark, [*docs, (9000, None, "", "", 0), (9001, "", "", "", 0), (9002, "w1 " * 30_000, "", "", 0), (None, "vilecur vilecur nastyone", "", "", 0)])
    marks = spark.createDataFrame([*labels[:400], (None, 0, 1), (7777, 1, None), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame, marks)
    out = {r.doc_id: r.s for r in frame.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    held = [(out[i].score >= 0.7) == bool(t) for i, _, t in labels[400:]]
    assert sum(held) / len(held) > 0.97
    assert all(0 <= s.score <= 1 for s in out.values()) and max(out[i].score for i in (9000, 9001, 9002)) < 0.3
    assert out[None].score > 0.7
    words = "w1 w2 w3 vilecur nastyone w4 w5".split()
    (start, end, score, p), *_ = model.spans(" ".join(words))
    assert (start, end) == (3, 5) and score > 0 and p < 0.05


def test_one_class_or_no_label(spark):
    frame = docs_frame(spark)
    for rows in ([], [(1, 1, 0), (2, 1, 0)]):
        model = toxicity.fit(frame, spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"))
        scores = frame.select(toxicity.score(F.col("text"), model, spark)["score"].alias("s")).collect()
        assert len(scores) == len(make_docs()) and all(r.s < 0.5 for r in scores)
    assert frame.limit(0).select(toxicity.score(F.col("text"), model, spark)["score"].alias("s")).count() == 0
