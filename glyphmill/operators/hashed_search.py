"""Approximate nearest neighbours: sign buckets of random projections, several probes, exact ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import vectors as vec_fn
from glyphmill.functions.text import let
from glyphmill.operators.skew import hot_size, join_by_key
from glyphmill.session import is_empty, materialize

# Rows that a bucket holds on average; the number of bits follows the size of the table.
BUCKET_ROWS = 64

_FOUND = "query_id bigint, rank int, id bigint, distance double"


def usable(v: Column) -> Column:
    """True for a vector that is not NULL or empty and has neither NULL nor non-finite entries."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def _constant(values: np.ndarray) -> Column:
    """A constant vector, as one text that the optimiser parses once."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def _home(sides: Column) -> Column:
    """One bit per direction: on which side of it the vector lies."""
    return F.aggregate(F.reverse(sides), F.lit(0).cast("bigint"), lambda acc, p: acc * 2 + F.when(p > 0, 1).otherwise(0))


@dataclass(frozen=True)
class Planes:
    """Directions ``(tables, bits, dims)`` of +1 and -1, and the mean from which vectors are seen."""

    mean: np.ndarray
    signs: np.ndarray

    def _sides(self, v: Column, table: int) -> Column:
        return F.array(*[vec_fn.dot(v, _constant(p)) - float(p @ self.mean) for p in self.signs[table]])

    def buckets(self, v: Column) -> Column:
        """The vector's bucket in every table."""
        return F.array(*[_home(self._sides(v, t)) for t in range(len(self.signs))])

    def probes(self, v: Column, unsure: int) -> Column:
        """Per table the vector's bucket and those that differ in any of its ``unsure`` least certain bits."""
        m = min(unsure, self.signs.shape[1])

        def near(sides: Column) -> Column:
            one = F.lit(1).cast("bigint")
            ranked = F.array_sort(F.transform(sides, lambda p, i: F.struct(F.abs(p).alias("margin"), F.call_function("shiftleft", one, i).alias("bit"))))
            parts = F.struct(_home(sides).alias("home"), F.transform(F.slice(ranked, 1, m), lambda s: s["bit"]).alias("flips"))
            flipped = lambda b, mask: reduce(lambda acc, i: acc.bitwiseXOR(b["flips"][i]), [i for i in range(m) if mask >> i & 1], b["home"])
            return let(parts, lambda b: F.array(*[flipped(b, mask) for mask in range(1 << m)]))

        return F.array(*[let(self._sides(v, t), near) for t in range(len(self.signs))])


def fit_planes(rows: DataFrame, tables: int, bucket_rows: int = BUCKET_ROWS, seed: int = 1998) -> Planes:
    """Directions for the vectors ``v`` of ``rows``: as many bits as give ``bucket_rows`` rows a bucket if
    they fell evenly, at least 1 and at most 40. The mean is that of all rows."""
    size = F.size("v")
    n, dims, least = rows.agg(F.count(F.lit(1)), F.max(size), F.min(size)).first()
    if dims != least:
        raise ValueError(f"vectors of {least} to {dims} entries")
    mean = rows.agg(*[F.avg(F.col("v")[i]) for i in range(dims)]).first()
    bits = min(max(math.ceil(math.log2(max(n / bucket_rows, 2))), 1), 40)
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, bits, dims))
    return Planes(np.array(mean, dtype=float), signs)


def _salted(index: DataFrame, asked: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: the rows of a hot bucket are dealt to salts, its probes go to each of them.

    Fewer than 1,000 buckets can be hot by the choice of the limit, so their names may be broadcast.
    """
    sizes = materialize(index.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    limit = hot_size(sizes.agg(F.sum("n")).first()[0])
    hot = F.broadcast(sizes.where(F.col("n") > limit).select(*key, F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))
    dealt = index.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    return dealt, asked.join(hot, key, "left").withColumn("salt", every).drop("salts")


def candidates(rows: DataFrame, asked: DataFrame, planes: Planes, unsure: int) -> DataFrame:
    """``query_id, id, distance`` for every row that shares a probed bucket with a query, once per pair.

    A pair that meets in several tables is measured in the first of them only, which both sides' buckets
    tell, so no exchange is needed to find repeated pairs.
    """
    key = ["table", "bucket"]
    # Written once: the index is read for the bucket sizes and for the join, and no bucket is computed twice.
    homes = materialize(rows.withColumn("homes", planes.buckets(F.col("v"))))
    index = homes.select("id", "v", "homes", F.posexplode("homes").alias("table", "bucket"))
    probed = materialize(asked.withColumn("all", planes.probes(F.col("qv"), unsure)))
    probed = probed.select("query_id", "qv", "all", F.posexplode("all").alias("table", "some"))
    probed = probed.select("query_id", "qv", "all", "table", F.explode("some").alias("bucket"))
    dealt, sent = _salted(index, probed, key)
    first = F.array_position(F.zip_with("homes", "all", lambda home, some: F.array_contains(some, home)), True) - 1
    met = dealt.join(sent, [*key, "salt"]).where(first == F.col("table"))
    return met.select("query_id", "id", vec_fn.squared_l2(F.col("v"), F.col("qv")).alias("distance"))


def knn_approx(
    base: DataFrame, queries: DataFrame, k: int, base_id: str = "vec_id", query_id: str = "query_id", vec: str = "embedding",
    tables: int = 8, unsure: int = 3, bucket_rows: int = BUCKET_ROWS, seed: int = 1998,
) -> DataFrame:
    """The ``k`` nearest base rows found per query, ``query_id, rank, id, distance`` (squared L2, ties by id).

    Every row is indexed in ``tables`` tables; a query looks into ``2 ** unsure`` buckets of each and ranks
    what it finds by exact distance. More tables and more unsure bits raise recall and work. Rows found
    may be fewer than ``k``.

    Of rows with equal vectors only the ``k`` with the smallest ids can be among anyone's ``k`` nearest, so
    only they are indexed; queries with equal vectors are searched once. NULL, empty and non-finite
    vectors and NULL ids take no part; an id in several rows may be found several times. A table without
    usable rows on either side gives no rows; vectors of different lengths raise.
    """
    spark = base.sparkSession
    # The index keeps the caller's type: a vector of floats is shuffled at half the width.
    rows = base.select(F.col(base_id).cast("bigint").alias("id"), F.col(vec).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    same = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = materialize(rows.withColumn("same", same).where(F.col("same") <= k).drop("same"))
    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vec).cast("array<double>").alias("qv"))
    asked = asked.where(usable(F.col("qv")) & F.col("query_id").isNotNull())
    if is_empty(rows) or is_empty(asked):
        return spark.createDataFrame([], _FOUND)
    planes = fit_planes(rows, tables, bucket_rows, seed)
    classes = materialize(asked.groupBy("qv").agg(F.min("query_id").alias("query_id"), F.count(F.lit(1)).alias("n")))
    pairs = candidates(rows, classes.drop("n"), planes, unsure)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    # At most k rows a class, so a list of them is bounded.
    found = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("found"))
    per_class = materialize(classes.join(found, "query_id").select("qv", "n", "found"))
    total = classes.agg(F.sum("n")).first()[0]
    every = join_by_key(asked, per_class, ["qv"], "n", total, ["query_id"])
    return every.select("query_id", F.explode("found").alias("f")).select("query_id", "f.rank", "f.id", "f.distance")
