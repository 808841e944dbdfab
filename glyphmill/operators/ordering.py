"""Row numbers, exact-size samples and splits without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.hashing import draw
from glyphmill.operators.skew import join_by_key
from glyphmill.session import materialize

# A draw has 31 bits; its top 16 bits name one of 65,536 equally filled buckets.
_BUCKET_SHIFT = 15


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with its chunk ``_part`` and place ``_at`` in it.

    The rows are written once (checkpoint), so a chunk holds the same rows in every later read.
    The chunks follow each other in the given order; an equal run of keys can span several.
    """
    mark = F.monotonically_increasing_id()
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", mark))
    # The mark holds the partition above bit 33 and the row within it below.
    return placed.withColumns({"_part": F.shiftright("_mark", 33).cast("int"), "_at": F.col("_mark").bitwiseAND(F.lit(2**33 - 1))}).drop("_mark")


def numbered(df: DataFrame, *order: Column, name: str = "row_no") -> DataFrame:
    """Add each row's 0-based position in the global ``order``; no task sees all rows."""
    placed = in_order(df, *order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the range exchange: bounded by spark.sql.shuffle.partitions.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def row_index(df: DataFrame, order: str, by: list[str] | None = None, name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (unique), per ``by`` group.

    Rows are numbered over all groups and shifted by the first number of their group, so one large
    group is spread over all partitions. Give key columns only and join the payload afterwards.
    """
    if not by:
        return numbered(df, F.col(order), name=name)
    rows = numbered(df, *[F.col(c) for c in by], F.col(order), name="_row_no")
    groups = materialize(rows.groupBy(*by).agg(F.min("_row_no").alias("_first"), F.count(F.lit(1)).alias("_size")))
    total = groups.agg(F.sum("_size")).first()[0] or 0
    joined = join_by_key(rows, groups, by, "_size", total, ["_row_no"])
    return joined.withColumn(name, F.col("_row_no") - F.col("_first")).drop("_row_no", "_first", "_size")


def first_drawn(df: DataFrame, id_col: str, n: Column | int, seed: int) -> Column:
    """Condition that holds for exactly the ``n`` rows with the smallest ``(draw, id)``.

    A histogram of the draws finds the bucket where the n-th row lies; only that bucket
    (about 1/65,536 of the rows) is sorted to find the exact limit.
    """
    drawn = df.select(draw(seed, F.col(id_col)).alias("_draw"), F.col(id_col).alias("_id"))
    drawn = drawn.withColumn("_bucket", F.shiftright("_draw", _BUCKET_SHIFT))
    hist = drawn.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(n, Column):
        total = hist.agg(n.alias("_want"))
        want = total.scalar()
    else:
        want = F.lit(n)
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = hist.select("_bucket", "_n", F.sum("_n").over(running).alias("_upto"))
    at = reached.where((F.col("_upto") >= want) & (F.col("_upto") - F.col("_n") < want))
    bucket = at.select("_bucket").scalar()
    left = want - at.select(F.col("_upto") - F.col("_n")).scalar()
    inside = drawn.where(F.col("_bucket") == bucket)
    ranked = inside.select(
        F.struct("_draw", "_id").alias("_key"), F.row_number().over(Window.orderBy("_draw", "_id")).alias("_rn")
    )
    limit = ranked.where(F.col("_rn") == left).select("_key").scalar()
    key = F.struct(draw(seed, F.col(id_col)).alias("_draw"), F.col(id_col).alias("_id"))
    # Fewer rows than asked for: the limit is NULL and every row qualifies.
    return F.coalesce(key <= limit, F.lit(True))


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int = 1998) -> DataFrame:
    """A repeatable sample of exactly ``n`` rows (all rows when there are fewer)."""
    return df.where(first_drawn(df, id_col, n, seed)) if n > 0 else df.limit(0)


def split_exact(df: DataFrame, id_col: str, test_share: float = 0.01, seed: int = 1998, name: str = "split") -> DataFrame:
    """Mark exactly ``ceil(rows * test_share)`` rows as ``test``, the others as ``train``."""
    want = F.ceil(F.sum("_n") * F.lit(test_share))
    return df.withColumn(name, F.when(first_drawn(df, id_col, want, seed), "test").otherwise("train"))


def split_threshold(df: DataFrame, id_col: str, test_share: float = 0.01, seed: int = 1998, name: str = "split") -> DataFrame:
    """One-pass split with an expected (not exact) test share."""
    limit = int(test_share * 2**31)
    return df.withColumn(name, F.when(draw(seed, F.col(id_col)) < limit, "test").otherwise("train"))


def first_per_group(df: DataFrame, group: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """First rows of each group in order, as many as its quota says.

    The limit by the largest quota is a literal, so Spark cuts each group before the shuffle.
    """
    if len(set(quotas)) != len(quotas) or not quotas:
        raise ValueError("give one quota per group")
    kept = df.where(F.col(group).isin(list(quotas)))
    ranked = kept.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(group))
    return ranked.where(F.col("_rn") <= max(quotas.values())).where(F.col("_rn") <= quota).drop("_rn")


def follow(df: DataFrame, order: str, values: dict[str, str]) -> DataFrame:
    """Bring columns of the next row in order to this row (``values``: column of next row -> new name)."""
    indexed = row_index(df, order, name="_pos")
    nxt = indexed.select((F.col("_pos") - 1).alias("_pos"), *[F.col(c).alias(n) for c, n in values.items()])
    return indexed.join(nxt, "_pos", "left").drop("_pos")
