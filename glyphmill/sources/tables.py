"""Named tables, CSV, published corpora and bounded exports."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.ordering import row_index


def read_table(spark: SparkSession, folder: str, name: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """A named Parquet table; ``config`` is a sub-folder, ``split`` prunes on the split column."""
    flat = os.path.join(folder, f"{name}.parquet")
    path = flat if config is None else os.path.join(folder, name, config)
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def spread(df: DataFrame, key: str, parts: int = 0) -> DataFrame:
    """Deal rows out to ``parts`` tasks by ``key`` where the caller asks for it (a few small files on many cores)."""
    return df.repartition(parts, key) if parts else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """CSV with a header and an explicit schema.

    Quoted fields may hold line ends (``multi_line``); each file is then one task. Switch it off for
    data of one line per row, which Spark splits.
    """
    return (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small in-memory table (configuration, quotas)."""
    return spark.createDataFrame(rows, schema)


def publish(df: DataFrame, path: str, message: str, partition_by: str = "split", tokens: Column | None = None) -> DataFrame:
    """Write the corpus partitioned by split, then a manifest with rows, tokens and a message."""
    df.write.mode("errorifexists").partitionBy(partition_by).parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    totals = written.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("n_tokens") if tokens is not None else F.lit(None).cast("bigint").alias("n_tokens"),
    ).withColumn("message", F.lit(message))
    totals.write.mode("errorifexists").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def read_published(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/data")
    return df if split is None else df.where(F.col("split") == split)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows in a stated order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def head_pandas(df: DataFrame, n: int, *order: str) -> pd.DataFrame:
    return head(df, n, *order).toPandas()


def numbered_batches(df: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """Add ``batch_no`` so that rows in order fall into batches of ``size``."""
    return row_index(df, order, name="_row").withColumn("batch_no", F.floor(F.col("_row") / size)).drop("_row")


def iterate_texts(df: DataFrame, text: str, size: int = 1000) -> Iterator[list[str]]:
    """Stream texts to a local consumer in lists of ``size``, one partition in memory at a time."""
    batch: list[str] = []
    for row in df.select(text).toLocalIterator(prefetchPartitions=False):
        batch.append(row[0])
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
