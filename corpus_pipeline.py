"""Training corpus from documents: toxic texts go, shared lines go, near duplicates go, sources are mixed, texts become ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import line_dedup, mixing, pieces, queries, rows, simhash, toxicity
from glyphmill.session import scratch_path, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels that are not held out."""
    ship_package(spark)
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    (score,) = rows.fresh(docs, "_score")
    scored = docs.withColumn(score, toxicity.score(F.col("text"), model, spark)["score"])
    return scored.where(F.col(score) < queries.TOXIC_FROM).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five of them share, but for one place."""
    return line_dedup.drop_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link, with the shingles and the limit of the operator's query."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    size = F.size(rows.words(F.col("text"))).cast("bigint")
    return mixing.mixed_rows(docs, size, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST, queries.MIX_SEED)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, its piece ids and their number; ``intact`` says that they decode to the text."""
    ship_package(spark)
    return pieces.encode(docs.select("doc_id", "text"), queries.TOKENIZER).select("doc_id", F.size("ids").alias("n_ids"), "ids", "intact")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_duplicates),
    ("mix", mix_sources),
    ("pieces", to_pieces),
]

# The model, the fingerprints and the pieces are no SQL; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again in the shared folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
