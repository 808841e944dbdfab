"""Tables whose columns have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import host_rules, mixing, sharding, simhash

NAMES = "_salt _salt0 _salts _place _part _row_no _mark _at _before _rank _from _upto _stratum _n _host _fails _off_units row key0 key1 n fp".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"one two three four {i % 3}", "ab"[i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.concat(F.lit(f"{c}|"), F.col("doc_id")) for c in NAMES})


OPERATORS = {
    "shard_rows": lambda df: sharding.shard_rows(df, [F.col("doc_id"), F.col("key0")], 3),
    "mix": lambda df: mixing.mix(df, F.lit(4), [F.col("doc_id")], [5, 2], 1.5, 2),
    "judge": lambda df: host_rules.judge(df.drop("n").withColumns({c: F.lit(5).cast("bigint") for c in host_rules.COUNTS}), "source"),
    "near_duplicates": lambda df: simhash.near_duplicates(df.drop("fp").withColumn("fp", F.xxhash64("text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_every_column_comes_back(spark, docs, monkeypatch, name, hot):
    monkeypatch.setattr("glyphmill.operators.skew.MIN_HOT", hot)
    out = OPERATORS[name](docs)
    kept = [c for c in ("doc_id", "text", "source", *NAMES) if c in out.columns]
    assert {"n", "fp"} >= set(NAMES) - set(kept)
    if name in ("judge", "near_duplicates"):
        kept = [c for c in kept if c not in ("n", "fp")]
    got = sorted(map(tuple, out.select(*kept).collect()))
    assert got == sorted(map(tuple, docs.select(*kept).collect()))
