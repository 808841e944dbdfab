"""Corpus assembly: stack and union sources, drop blanks and duplicates, count, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import dedup, stacking


def after_new(published: DataFrame, source_no: int) -> DataFrame:
    """A published corpus with an ``ord`` behind all new sources, in its own order.

    A missing split is 'train'. Its own ``ord``, of any type, is kept as the key within the corpus. Without one, rows go by their
    text's digest, and rows with equal split and text are reduced to the least one.
    """
    split = F.col("split") if "split" in published.columns else F.lit(None)
    published = published.withColumn("split", F.coalesce(split, F.lit("train")))
    if "ord" in published.columns:
        key = stacking.sort_text(F.col("ord"), published.schema["ord"].dataType)
    else:
        others = [c for c in published.columns if c not in ("split", "text")]
        if others:
            published = published.groupBy("split", "text").agg(F.min(F.struct(*others)).alias("_row")).select("split", "text", "_row.*")
        else:
            published = published.distinct()
        key = F.sha2(F.coalesce("text", F.lit("")), 256)
    place = F.struct(
        F.lit(source_no).alias("source_no"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).alias("col"), key.alias("key")
    )
    return published.withColumn("ord", place)


def assemble(new: list[stacking.SourceSpec], published: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """The deduplicated corpus with token and word counts.

    New sources come before the rows already published, so their copy of a text wins.
    """
    stacked = stacking.combine_sources(new)
    if published is not None:
        counts = [c for c in ("token_count", "word_count") if c in published.columns]
        stacked = stacking.concat_splits(stacked, after_new(published.drop(*counts), len(new)))
    kept = dedup.drop_exact(stacked.where(tx.not_blank(F.col("text"))), "text", "ord", by=["split"])
    return kept.withColumn("token_count", tx.token_count(F.col("text"), max_tokens)).withColumn(
        "word_count", tx.word_count(F.col("text"))
    )


def assembled_totals(new: list[stacking.SourceSpec]) -> DataFrame:
    """Rows, tokens and words per split and source of the assembled corpus.

    Counts are taken before the duplicates are resolved, so only digests and numbers are shuffled.
    """
    stacked = stacking.combine_sources(new).where(tx.not_blank(F.col("text")))
    t = F.col("text")
    slim = stacked.select(
        "split", F.unhex(F.sha2(t, 256)).alias("digest"),
        F.struct("ord", "dataset_source", tx.token_count(t).alias("tokens"), tx.word_count(t).alias("words")).alias("row"),
    )
    first = slim.groupBy("split", "digest").agg(F.min("row").alias("row"))
    return first.groupBy("split", F.col("row.dataset_source").alias("dataset_source")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("row.tokens").cast("bigint").alias("n_tokens"), F.sum("row.words").cast("bigint").alias("n_words"),
    )
