import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import as_set, docs_frame, make_docs
from pyspark.sql import functions as F

from glyphmill.llm import mixing, rows, sharding
from glyphmill.operators import ordering


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    p = sharding.Permutation(n, seed=4)
    x = np.arange(n)
    y = p.place(x)
    assert sorted(y) == list(range(n))
    assert (p.row_no(y) == x).all()


def test_large_row_numbers():
    p = sharding.Permutation(1 << 61, seed=1)
    x = np.array([0, 1, (1 << 61) - 1, 1 << 50])
    y = p.place(x)
    assert ((y >= 0) & (y < 1 << 61)).all() and (p.row_no(y) == x).all()


def test_shards_are_even_and_slots_have_no_gaps(spark):
    df = docs_frame(spark).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), F.lit(9).alias("slot"))
    out = sharding.shard_rows(df, [F.col("doc_id"), F.col("crc")], 4, seed=2).collect()
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    assert len(out) == len(make_docs())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())


def test_places_are_computed_and_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    first = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df.repartition(1), [F.col("doc_id")], 8, 7).collect()}
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df.repartition(16), [F.col("doc_id")], 8, 7).collect()}
    assert first == again
    for i in (0, 17, 499):
        assert sharding.locate(i, 500, 8, 7) == first[i]
        assert sharding.row_at(*first[i], 500, 8, 7) == i
    assert sharding.shard_rows(df.limit(0), [F.col("doc_id")], 8).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(df, [F.col("doc_id")], 0)


def test_numbers_and_running_totals(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(300)], "k int, v int").repartition(9)
    order = [F.col("k"), F.col("v")]
    want = sorted((i % 7, i) for i in range(300))
    got = {(r.k, r.v): r.row_no for r in ordering.numbered(df, *order).collect()}
    assert got == {kv: n for n, kv in enumerate(want)}
    total, sums = 0, {}
    for k, v in want:
        sums[k, v] = total
        total += v
    assert {(r.k, r.v): r.t for r in rows.running(df, order, {"t": "v"}).collect()} == sums


def fill(sizes, weights, share, most):
    """Targets by repeated sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        full = {s for s in open_ if left * w[s] / sum(w[o] for o in open_) > most * sizes[s]}
        if not full:
            target |= {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_and_takings(spark):
    docs = docs_frame(spark).select("doc_id", "source", "text")
    out = mixing.mix(docs, F.size(rows.words(F.col("text"))).cast("bigint"), [F.col("doc_id")], [5, 2, 1], 1.5, 2).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        assert 0 <= r.copies <= 2
        assert r.size == len((r.text or "").encode().split())
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    want = fill(sizes, [5, 2, 1], 1.5, 2)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    again = mixing.mix(docs.repartition(3), F.size(rows.words(F.col("text"))).cast("bigint"), [F.col("doc_id")], [5, 2, 1], 1.5, 2)
    assert sorted((str(r.doc_id), r.size, r.copies) for r in out) == sorted((str(r.doc_id), r.size, r.copies) for r in again.collect())


def test_copies_follow_the_prefix_sums(spark):
    df = spark.createDataFrame([(i, "s", i) for i in range(200)], "doc_id int, source string, size int")
    for units in (0, mixing.UNIT // 3, mixing.UNIT, mixing.UNIT * 2, mixing.UNIT * 7 // 5):
        expected = spark.createDataFrame([("s", units)], "source string, units bigint")
        copies = [r.copies for r in mixing.systematic(df, "source", [F.col("size")], expected).orderBy("size").collect()]
        e = units / mixing.UNIT
        assert abs(sum(copies) - 200 * e) <= 1 and all(int(e) <= c <= int(e) + (e > int(e)) for c in copies)


def test_mixed_rows_repeat_whole_rows(spark):
    docs = docs_frame(spark)
    out = mixing.mixed_rows(docs, F.size(rows.words(F.col("text"))).cast("bigint"), [5, 2, 1], 1.5, 2)
    assert out.columns == docs.columns
    originals = Counter(as_set(docs))
    for row, n in Counter(as_set(out)).items():
        assert n <= 2 * originals[row]
    assert mixing.mixed_rows(docs.limit(0), F.lit(1).cast("bigint"), [5, 2, 1], 1.5, 2).count() == 0


def test_mixed_rows_move_texts_once(spark):
    """The join has brought equal rows together already; no second exchange by key and id."""
    docs = spark.createDataFrame([(i, f"w{i} x y", "s") for i in range(50)], "doc_id long, text string, source string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.mixed_rows(docs, F.lit(3).cast("bigint"), [5, 2, 1], 1.5, 2)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not re.search(r"hashpartitioning\(_row#\d+L?, (doc_id|coalesce\(doc_id)", plan)
    assert re.search(r"hashpartitioning\(_row#\d+L?, \d+", plan)
