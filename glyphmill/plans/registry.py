"""Registry of queries: a Spark callable per key and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.functions import text as tx
from glyphmill.operators.schema import with_split
from glyphmill.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with its derived split."""
    return with_split(table(spark, sf_dir, "documents"), "doc_id")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table as it is scanned, or dealt to as many tasks as ``spark.glyphmill.spread`` asks for."""
    return spread(table(spark, sf_dir, name), key, int(spark.conf.get("spark.glyphmill.spread", "0")))


def spread_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    slim = table(spark, sf_dir, "documents").select("doc_id", *columns)
    return spread(slim, "doc_id", int(spark.conf.get("spark.glyphmill.spread", "0")))


# SQL fragments with the same text classes as functions/text.py.

SPLIT = "CASE WHEN doc_id % 100 = 99 THEN 'test' ELSE 'train' END"


def sql_words(col: str) -> str:
    return f"regexp_extract_all({col}, '{tx.NON_WS_RUN}')"


def sql_tokens(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{tx.WORD_RUN}')"


def sql_runs(col: str) -> str:
    return f"regexp_extract_all({col}, '{tx.WORD_RUN}')"


def sql_clean(col: str) -> str:
    return f"lower(array_to_string({sql_runs(col)}, ' '))"


def sql_clean_words(col: str) -> str:
    return f"list_transform({sql_runs(col)}, lambda w: lower(w))"


def sql_int31(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT & 2147483647)"


def sql_draw(seed: int, *keys: str) -> str:
    return sql_int31(" || '|' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]]))


def sql_ngrams(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


def sql_not_blank(col: str) -> str:
    return f"({col} IS NOT NULL AND regexp_matches({col}, '[^{tx.WS}]'))"
