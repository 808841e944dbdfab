"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, rel.fetchall())


@pytest.mark.parametrize("name", ["embed_text", "project_pca"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and df.columns == ["split", "dataset_source", "n_rows", "n_tokens", "n_words"]
