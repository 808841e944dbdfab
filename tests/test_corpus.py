"""Stacking, unions, exact duplicates, order-based operators and statistics."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.hashing import py_int31
from glyphmill.operators import dedup, ordering, schema, stacking, stats
from glyphmill.plans import assembly
from glyphmill.session import scratch_path
from glyphmill.sources import tables


def test_stack_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(0, None, "b0", "it's"), (1, "a1", "b1", None)], "row long, a string, b string, m string")
    out = stacking.stack_source(stacking.SourceSpec("src", df, ["row"], ["m"])).orderBy("ord").collect()
    assert [r["text"] for r in out] == [None, "a1", "b0", "b1"]
    assert [r["metadata"] for r in out] == [str({"m": "it's"}), str({"m": "None"})] * 2
    assert {r["dataset_source"] for r in out} == {"src"} and {r["split"] for r in out} == {"train"}


def test_stack_alternates_columns_per_batch(spark):
    df = spark.range(2500).select(F.col("id").alias("row"), F.concat(F.lit("a"), "id").alias("a"), F.concat(F.lit("b"), "id").alias("b"))
    got = [r["text"] for r in stacking.stack_source(stacking.SourceSpec("s", df, ["row"])).orderBy("ord").collect()]
    want = [f"{c}{i}" for lo in range(0, 2500, 1000) for c in "ab" for i in range(lo, min(lo + 1000, 2500))]
    assert got == want


def test_label_from_a_column_covers_every_text_column(spark):
    df = spark.createDataFrame([(0, "x", "y", "site")], "row long, a string, b string, src string")
    out = stacking.stack_source(stacking.SourceSpec("s", df, ["row"], ["src"], "src")).collect()
    assert [r["dataset_source"] for r in out] == ["site", "site"]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, "t")], "row long, text string")
    with pytest.raises(ValueError, match="topic"):
        stacking.stack_source(stacking.SourceSpec("s", df, ["row"], ["topic"]))
    with pytest.raises(ValueError, match="nope"):
        schema.drop_columns(df, ["nope"])


def test_concat_splits_fills_and_passes_through(spark):
    a = spark.createDataFrame([("train", "x", 1)], "split string, text string, a int")
    b = spark.createDataFrame([("test", "y", 2.0)], "split string, text string, b double")
    out = {r["split"]: r for r in stacking.concat_splits(a, b).collect()}
    assert out["train"]["b"] is None and out["test"]["a"] is None and set(out) == {"train", "test"}


def test_mix_repeats_sources(spark):
    df = spark.createDataFrame([("en",), ("fr",), ("de",)], "lang string")
    got = sorted(tuple(r) for r in stacking.mix(df, "lang", {"m": {"en": 2, "fr": 1}, "n": {"fr": 1}}).collect())
    assert got == [("en", "m"), ("en", "m"), ("fr", "m"), ("fr", "n")]


def test_exact_keeps_first_per_split(spark):
    data = [("train", None, 0), ("train", None, 1), ("train", "a", 2), ("test", "a", 3), ("train", "a", 4), ("train", "b", 5)]
    df = spark.createDataFrame(random.Random(1).sample(data, len(data)), "split string, text string, ord long")
    assert sorted(r["ord"] for r in dedup.drop_exact(df, by=["split"]).collect()) == [0, 2, 3, 5]
    assert sorted(r["ord"] for r in dedup.drop_exact(df).collect()) == [0, 2, 5]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_row_index_with_gaps_and_a_hot_group(spark, partitions):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 400)
    rows = [(i, "hot" if k % 3 else f"g{k % 5}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {r["id"]: r["row_idx"] for r in ordering.row_index(df.repartition(partitions), "id", by=["g"]).collect()}
    want = {}
    for g in {g for _, g in rows}:
        for n, i in enumerate(sorted(i for i, h in rows if h == g)):
            want[i] = n
    assert got == want


@pytest.mark.parametrize("n", [1, 10, 99, 100, 250])
def test_sample_is_exact_and_repeatable(spark, n):
    df = spark.range(100)
    want = sorted(range(100), key=lambda i: (py_int31(f"5|{i}"), i))[:n]
    for parts in (1, 5):
        got = sorted(r["id"] for r in ordering.sample_exact(df.repartition(parts), "id", n, seed=5).collect())
        assert got == sorted(want)


def test_split_has_exact_size(spark):
    for n in (1, 99, 101, 250):
        out = ordering.split_exact(spark.range(n), "id", 0.01).where("split = 'test'").count()
        assert out == math.ceil(n * 0.01)


def test_first_per_group(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(99, "z")], "id long, t string")
    got = sorted(tuple(r) for r in ordering.first_per_group(df, "t", ["id"], {"a": 2, "b": 3}).collect())
    assert got == [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (5, "b")]
    with pytest.raises(ValueError):
        ordering.first_per_group(df, "t", ["id"], {})


@pytest.mark.parametrize("values", [[4] * 6, [7], list(range(61)), [0, 30], [1, 5, 5, 9, 100]])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = [r["n_rows"] for r in stats.histogram(df, "v").orderBy("bin").collect()]
    assert got == np.histogram(values, bins=30)[0].tolist()


def test_distribution(spark):
    values = [1, 2, 3, 50, 60]
    r = stats.distribution(spark.createDataFrame([(v,) for v in values], "v int"), "v", 10).first()
    assert r["mean_all"] == pytest.approx(np.mean(values)) and r["std_all"] == pytest.approx(np.std(values))
    assert r["n_above"] == 2 and r["percent_above"] == pytest.approx(40.0)
    assert r["mean_capped"] == pytest.approx(2.0) and r["lower_mark"] == pytest.approx(2 - np.std([1, 2, 3]))


def test_publish_and_read_back(spark):
    df = spark.createDataFrame([("train", "a b", 2), ("test", "c", 1)], "split string, text string, token_count int")
    path = scratch_path(spark, "t")
    manifest = tables.publish(df, path, "hello", tokens=F.col("token_count")).first()
    assert (manifest["n_rows"], manifest["n_tokens"], manifest["message"]) == (2, 3, "hello")
    assert tables.read_published(spark, path, "test").first()["text"] == "c"
    assert list(tables.iterate_texts(df.orderBy("text"), "text", 1)) == [["a b"], ["c"]]


def test_csv_round_trip_with_quotes_and_newlines(spark):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, "plain")]
    path = tables.write_csv(spark.createDataFrame(rows, "id long, text string"), scratch_path(spark, "csv"))
    assert sorted(tuple(r) for r in tables.read_csv(spark, path, "id BIGINT, text STRING").collect()) == rows


def test_configurations_and_rows_in_memory(spark):
    folder = scratch_path(spark, "named")
    tables.from_rows(spark, [(1, "train"), (2, "test")], "id long, split string").write.parquet(f"{folder}/books/plain")
    assert [r["id"] for r in tables.read_table(spark, folder, "books", config="plain", split="test").collect()] == [2]
    tables.from_rows(spark, [(3, "train")], "id long, split string").write.parquet(f"{folder}/books.parquet")
    assert tables.head_pandas(tables.read_table(spark, folder, "books"), 1, "id")["id"].tolist() == [3]


def test_thresholded_split_is_close_and_repeatable(spark):
    out = ordering.split_threshold(spark.range(4000), "id", 0.1, seed=3)
    test = {r["id"] for r in out.where("split = 'test'").collect()}
    assert 300 < len(test) < 500
    assert test == {r["id"] for r in ordering.split_threshold(spark.range(4000).repartition(7), "id", 0.1, seed=3).where("split = 'test'").collect()}


@pytest.mark.parametrize("keys", [["a"], ["a", "b", "c"], ["c", "a"], ["d", "b"]])
def test_keys_of_any_number_and_kind_order_the_rows(spark, keys):
    rng = random.Random(6)
    rows = [(rng.choice([-5, 0, 3, 10**12, None]), rng.choice(["", "a", "ab", "b", None]), i, (rng.randint(-2, 2), f"x{i % 3}")) for i in range(40)]
    df = spark.createDataFrame(rows, "a long, b string, c int, d struct<n:int,t:string>")
    key = F.concat(*[stacking.sort_text(F.col(k), df.schema[k].dataType) for k in keys])
    got = [r["k"] for r in df.select("c", key.alias("k")).orderBy(*keys).collect()]
    assert got == sorted(got)
    with pytest.raises(ValueError):
        stacking.sort_text(F.lit(1.5), df.select(F.lit(1.5).cast("double")).schema[0].dataType)


def test_ties_in_the_order_raise_and_all_keys_count(spark):
    rows = [(0, 0, 0, "a"), (0, 0, 1, "a"), (0, 0, 2, "b")]
    table = spark.createDataFrame(rows, "x long, y long, z long, text string")
    out = assembly.assemble([stacking.SourceSpec("s", table, ["x", "y", "z"])])
    assert sorted(r["text"] for r in out.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        assembly.assemble([stacking.SourceSpec("s", table, ["x", "y"], text_columns=["text"], metadata=["z"])])


@pytest.mark.parametrize("own", [None, "ord long", "ord string"])
def test_new_rows_win_over_a_published_corpus(spark, own):
    new = stacking.SourceSpec("new", spark.createDataFrame([(1, "same"), (2, "fresh")], "id long, text string"), ["id"])
    rows = [("train", "same", "old"), ("train", "kept", "old"), ("train", "kept", "old"), ("test", "same", "old")]
    published = spark.createDataFrame(rows, "split string, text string, dataset_source string")
    if own:
        published = spark.createDataFrame([(*r, i if "long" in own else f"k{i}") for i, r in enumerate(rows)], f"split string, text string, dataset_source string, {own}")
    got = sorted((r["split"], r["text"], r["dataset_source"]) for r in assembly.assemble([new], published).collect())
    assert got == [("test", "same", "old"), ("train", "fresh", "new"), ("train", "kept", "old"), ("train", "same", "new")]
    again = assembly.assemble([new], assembly.assemble([new], published))
    assert sorted(r["text"] for r in again.collect()) == ["fresh", "kept", "same", "same"]


def test_exact_copies_with_missing_splits(spark):
    rows = [(None, "a b", 1), (None, "a b", 2), ("train", "a b", 3), (None, None, 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "split string, text string, ord int")
    assert sorted(r.ord for r in dedup.drop_exact(df, by=["split"]).collect()) == [1, 3, 4]
    published = df.where("text IS NOT NULL").withColumn("dataset_source", F.lit("old"))
    placed = assembly.after_new(published, 1)
    assert {r.split for r in placed.collect()} == {"train"}
    assert dedup.drop_exact(placed, by=["split"]).count() == 1


@pytest.mark.parametrize("first, buckets", [(1, 7), (32, 2048), (5000, 4096)])
def test_frequent_ngrams_equal_a_full_count(spark, first, buckets):
    rng = np.random.default_rng(2)
    odds = 1 / np.arange(1, 401)
    texts = [" ".join(f"w{w}" for w in rng.choice(400, 60, p=odds / odds.sum())) for _ in range(150)] + [None, "", "one", "one two"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    seen = {}
    got = {tuple(r) for r in stats.frequent_ngrams(df, "t", [1, 2, 3], 6, buckets, first, seen).collect()}
    assert got == {tuple(r) for r in stats.top_ngrams(df, "t", [1, 2, 3], 6).select("n", "ngram", "freq", "rank").collect()}
    every = stats.top_ngrams(df, "t", [1, 2, 3], 1 << 30).count()
    if first == 32:
        assert seen["counted"] <= every / 10


def test_frequent_ngrams_when_all_are_wanted(spark):
    df = spark.createDataFrame([("a b c a b",), ("a b",)], "t string")
    got = {tuple(r) for r in stats.frequent_ngrams(df, "t", [2, 9], 50, 64, 1).collect()}
    assert got == {(2, "a b", 3, 1), (2, "b c", 1, 2), (2, "c a", 1, 3)}
    assert stats.frequent_ngrams(df.limit(0), "t", [2], 5).collect() == []


def test_top_ngrams_shuffle_hash_buckets_and_equal_a_plain_count(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["", None, "Ünd ÜND ünd"]
    plain = {n: Counter(" ".join(w[i : i + n]) for t in texts if t for w in [t.lower().split()] for i in range(len(w) - n + 1)) for n in (1, 2, 3)}
    want = {(n, g, c, r) for n in plain for r, (g, c) in enumerate(sorted(plain[n].items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    counted = []
    monkeypatch.setattr(stats, "materialize", lambda df: counted.append(df.columns) or df.localCheckpoint())
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    assert {tuple(r) for r in stats.top_ngrams(df, "t", [1, 2, 3], 5).select("n", "ngram", "freq", "rank").collect()} == want
    assert ["n", "bucket", "load"] in counted
