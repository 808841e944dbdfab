import math
import random
import zlib

import numpy as np
import pytest
from helpers import docs_frame
from pyspark.sql import functions as F

from glyphmill.llm import quality, queries

TABLES = "/root/testdata/sf0.1"


def plain_fit(rows, step, rounds=quality.ROUNDS, shards=quality.SHARDS):
    """The same steps with dictionaries: rows are (shard, place, label, buckets) in any order."""
    z, n = {}, {}
    last = quality.BUCKETS

    def weight(z, n, b):
        size = abs(z.get(b, 0.0)) - (0 if b == last else step.l1)
        return 0.0 if size <= 0 else -math.copysign(size, z[b]) / ((step.beta + math.sqrt(n[b])) / step.alpha + step.l2)

    for _ in range(rounds):
        moves = []
        for shard in range(shards):
            own_z, own_n = dict(z), dict(n)
            for _, _, label, buckets in sorted(r for r in rows if r[0] == shard):
                values = {b: 1 / math.sqrt(max(len(buckets), 1)) for b in buckets} | {last: 1.0}
                p = 1 / (1 + math.exp(-sum(weight(own_z, own_n, b) * v for b, v in values.items())))
                for b, v in values.items():
                    g, w, before = (p - label) * v, weight(own_z, own_n, b), own_n.get(b, 0.0)
                    own_n[b] = before + g * g
                    own_z[b] = own_z.get(b, 0.0) + g - (math.sqrt(own_n[b]) - math.sqrt(before)) / step.alpha * w
            moves.append((own_z, own_n))
        keys = set().union(*(m[0] for m in moves))
        z = {b: z.get(b, 0.0) + sum(m[0].get(b, z.get(b, 0.0)) - z.get(b, 0.0) for m in moves) / shards for b in keys}
        n = {b: n.get(b, 0.0) + sum(m[1].get(b, n.get(b, 0.0)) - n.get(b, 0.0) for m in moves) / shards for b in keys}
    return {b: weight(z, n, b) for b in z}


def test_model_equals_plain_steps(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["good", "fine", "plain", "BAD!!", "x*** y", "z"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    labels = spark.createDataFrame([(i, int("!!" not in t)) for i, t in enumerate(texts)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    rows = [(r.shard, r.place, r.label, tuple(r.buckets)) for r in quality.featured(docs, labels, "quality", 1000).collect()]
    want = plain_fit(rows, quality.Step())
    got = {int(b): float(model.weights[b]) for b in np.flatnonzero(model.weights)}
    assert math.isclose(model.constant, want.pop(quality.BUCKETS), abs_tol=1e-6)
    assert got == pytest.approx({b: w for b, w in want.items() if w}, abs=1e-6)
    for text in texts:
        held = set(quality.Featurizer().buckets(text).tolist())
        x = sum(want.get(b, 0.0) for b in held) / math.sqrt(max(len(held), 1)) + model.constant
        assert math.isclose(model.score(quality.Featurizer().buckets(text)), 1 / (1 + math.exp(-x)), abs_tol=1e-5)


def test_features_of_words_pairs_and_shapes(monkeypatch):
    f = quality.Featurizer()
    assert len(f.buckets(None)) == len(f.buckets("")) == len(f.buckets(" \n\t ")) == 0
    assert len(f.buckets("one")) == 2 and len(f.buckets("one two")) == 2 + 1 + 1 + 1  # words, their one shape, and the pairs
    again, other = f.buckets("erti erti erti"), f.buckets("erti orti arti")
    assert not np.array_equal(again, other) and np.array_equal(f.buckets("a B  c"), f.buckets("a\nB c"))
    texts = [" ".join(f"w{i * j % 17}{'!' * (i % 3)}" for i in range(j)) for j in range(40)]
    want = [f.buckets(t).tolist() for t in texts]
    monkeypatch.setattr(quality, "REMEMBER", 4)
    small = quality.Featurizer()
    assert [small.buckets(t).tolist() for t in texts] == want


def test_odd_rows_and_missing_labels(spark):
    docs = docs_frame(spark).withColumn("label", F.lit("x")).withColumn("buckets", F.lit(1)).withColumn("quality", F.lit(9))
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (None, 1), (3, 7), (4, 1), (4, 1)], "doc_id bigint, quality int")
    rows = quality.featured(docs, labels, "quality", 100)
    assert sorted((r.label for r in rows.collect())) == [0, 1, 1]
    model = quality.fit(docs, labels)
    out = docs.withColumn("score", quality.score(F.col("text"), model, spark))
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.s for r in docs.select(quality.score(F.col("text"), none, spark).alias("s")).collect()} == {0.5}
    assert quality.fit(docs.limit(0), labels).constant == 0.0


def test_held_out_rows(spark):
    got = queries.QUERIES["op13_ftrl_quality"](spark, TABLES).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    assert len(got) == 10000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.predicted, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    good, bad = [p for p, q in held if q == 1], [p for p, q in held if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.03 * len(bad)
    # Reruns agree bit by bit.
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.QUERIES["op13_ftrl_quality"](spark, TABLES).collect()))


def test_parts_of_the_buckets_do_not_change_the_model(spark, monkeypatch):
    """Moves are added up by parts of the buckets in tasks; the number of parts is not seen in the weights."""
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} tail{i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "PARTS", 3)
    again = quality.fit(docs, labels)
    assert (model.weights == again.weights).all() and model.constant == again.constant and (model.weights != 0).any()
