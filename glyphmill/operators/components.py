"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.skew import join_by_key
from glyphmill.session import stored


def _to_smallest(pairs: DataFrame, total: int) -> DataFrame:
    """Rows ``(u, v, m)`` with ``m`` the smallest of ``u`` and its partners ``v``."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size"))
    return join_by_key(pairs, least, ["u"], "size", total, ["v"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, root)`` for every id in ``edges``: the smallest id of its component.

    Hub ids are handled by the skew-safe join, so a component of any size is spread over tasks.
    """
    current = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v").distinct()
    current = stored(current)
    before = None
    while True:
        n, mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n == 0 or (n, mark) == before:
            return current.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        before = (n, mark)
        total = 2 * n
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # The small star works on pairs oriented from the larger to the smaller id.
        small = _to_smallest(large, total)
        linked = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = stored(linked.where("u <> v").distinct())
