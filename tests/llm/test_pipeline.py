import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from helpers import docs_frame, make_docs
from pyspark.sql import functions as F

from glyphmill.llm import oracles, queries
from glyphmill.session import scratch_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with the odd documents and labels."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs_frame(spark, make_docs()).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 9 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_keep_columns_and_extra_ones(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({"_score": F.lit(1), "fp": F.lit(2), "size": F.lit(3), "_row": F.lit(4).cast("int")})
    docs = docs.withColumns({"_bits": F.lit(5), "_copies": F.lit(6), "_mark": F.lit(None).cast("string")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        out = stage(spark, docs, small)
        assert out.columns == columns, name
        path = scratch_path(spark, "stage-test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.where("not intact").count() == 0 and last.count() == docs.count()


def test_run_and_empty_documents(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in oracles.SQL if n != "op1_feistel_shards"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(oracles.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == Counter(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in oracles.SQL or n == "op1_feistel_shards"])
def test_other_queries_return_every_row(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert out.count() == (25 * 20 if name.startswith("op4") else n)
