import random

import numpy as np
import pytest
import xxhash
from helpers import as_set, docs_frame, make_docs
from pyspark.sql import functions as F

from glyphmill.llm import simhash


def plain_print(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, limit=2):
    """Smallest index reachable, by trying all pairs."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_the_hash_of_spark(spark):
    texts = [r[1] for r in make_docs()] + ["A\x0bb\x0cC d", "ÀB c D", "one", "one two", "\x1cx y z w"]
    assert [simhash.fingerprint_of(t) for t in texts] == [plain_print(t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = df.select("doc_id", simhash.as_hex(simhash.fingerprint(F.col("text"))).alias("fp")).collect()
    assert {r.doc_id: r.fp for r in got} == {i: f"{plain_print(t):016x}" for i, t in enumerate(texts)}
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64(b"a b c", seed=42).intdigest()


def noisy_prints(seed, centres, each, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.append(x)
    return out


@pytest.mark.parametrize("block_rows", [2048, 3])
def test_components_against_all_pairs(spark, hot_keys, block_rows, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (2, block_rows))
    prints = noisy_prints(1, 12, 12, 3) + [0, 0, 2**64 - 1, 2**63, 1, 3, 7, 15]
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(signed)], "doc_id bigint, fp bigint, low string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(plain_groups(prints)))


def test_ids_missing_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 5), (None, 5), (3, 4), (8, 255 << 50), (None, 255 << 30)], "doc_id bigint, fp bigint")
    got = sorted(map(str, ((r.fp, r.component_id) for r in simhash.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(5, 3), (5, 3), (4, 3), (255 << 50, 8), (255 << 30, None)]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_links(df, limit=3)


def test_one_row_of_each_group_stays(spark):
    rows = make_docs()
    docs = docs_frame(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = plain_groups([plain_print(r[1]) for r in rows])
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    want = {}
    for i, g in enumerate(groups):
        if g not in want or order(i) < order(want[g]):
            want[g] = i
    assert {(r.doc_id, r.text) for r in kept.collect()} == {rows[i][:2] for i in want.values()}
    assert len(as_set(kept)) == len(want)
