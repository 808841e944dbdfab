"""Benchmark table for fill-mask and causal models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.functions.hashing import draw
from glyphmill.operators import ordering


def benchmark_rows(
    df: DataFrame, id_col: str, text: str, topic: str, quotas: dict[str, int], seed: int,
    mask: str = "<mask>", min_chars: int = 20,
) -> DataFrame:
    """The first sentences of each topic longer than ``min_chars``, masked and cut for both tasks."""
    long_enough = df.where(F.length(text) > min_chars).select(id_col, text, topic)
    taken = ordering.first_per_group(long_enough, topic, [id_col], quotas)
    t = F.col(text)
    return taken.select(
        t.alias("ground_truth"), tx.mask_word(t, draw(seed, F.col(id_col)), mask).alias("masked_sentence"),
        tx.causal_prefix(t).alias("causal_sentence"), F.col(topic).alias("topic"),
    )
