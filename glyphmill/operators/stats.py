"""Counts, distributions, frequencies and the corpus card."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.session import is_empty, materialize


def count_by(df: DataFrame, *cols: str, name: str = "n_rows") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def total_by(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(value).cast("bigint").alias(name))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, NULLs left out, most frequent first."""
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), col)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def distribution(df: DataFrame, value: str, max_value: float | None = None, by: str | None = None) -> DataFrame:
    """Mean and population deviation of all rows and of the rows up to ``max_value``, in one pass."""
    v = F.col(value)
    low = v if max_value is None else F.when(v <= max_value, v)
    above = F.lit(0) if max_value is None else F.when(v > max_value, 1).otherwise(0)
    aggs = [
        F.count(v).alias("n_rows"), F.avg(v).alias("mean_all"), F.stddev_pop(v).alias("std_all"),
        F.sum(above).cast("bigint").alias("n_above"), F.avg(low).alias("mean_capped"), F.stddev_pop(low).alias("std_capped"),
    ]
    out = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    lower = F.col("mean_capped") - F.col("std_capped")
    return (
        out.withColumn("percent_above", F.try_divide(100.0 * F.col("n_above"), F.col("n_rows")))
        .withColumn("lower_mark", F.when(lower > 0, lower))
        .withColumn("upper_mark", F.col("mean_capped") + F.col("std_capped"))
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; a constant column widens by 0.5 each way."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    no = F.least(F.floor((F.col("v") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = v.select(no.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"))
    # One row per bin on the left, so empty bins are listed too.
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return every.join(counts, "bin", "left").select(
        "bin", (lo + width * F.col("bin")).alias("bin_from"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")
    )


def word_frequency(df: DataFrame, words: Column) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _hashed_words(df: DataFrame, text: str) -> DataFrame:
    """``_w, _h``: the words of every text and their hashes."""
    words = df.select(tx.clean_words(F.col(text)).alias("_w"))
    return words.select("_w", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))


def _starts(n: int) -> Column:
    """Where n-grams of :func:`_hashed_words` begin."""
    return F.when(F.size("_h") >= n, F.sequence(F.lit(0), F.size("_h") - n))


def _bucket(n: int, buckets: int, first: int) -> Callable[[Column], Column]:
    """Bucket, from ``first`` on, of the n-gram that begins at a place; from the hashes of its words, so nothing is spelled for it."""
    return lambda i: (F.pmod(F.xxhash64(*[F.get("_h", i + k) for k in range(n)]), F.lit(buckets)) + first).cast("int")


def _spelled(n: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[F.get("_w", i + k) for k in range(n)]).alias("ngram"))


def _bitmap(chosen: DataFrame, buckets: int) -> Column:
    """Array of 64-bit words, a constant; bit ``b % 64`` of word ``b div 64`` says that bucket ``b`` is among ``chosen``."""
    words = dict(chosen.groupBy(F.expr("bucket div 64")).agg(F.expr("bit_or(shiftleft(1L, bucket % 64))")).collect())
    return F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(buckets // 64 + 1))), ",").cast("array<bigint>")


def top_ngrams(df: DataFrame, text: str, sizes: list[int], k: int) -> DataFrame:
    """The ``k`` most frequent n-grams of each size, ties by n-gram."""
    return frequent_ngrams(df, text, sizes, k)


def frequent_ngrams(df: DataFrame, text: str, sizes: list[int], k: int, buckets: int = 1 << 18, first: int = 4096, seen: dict | None = None) -> DataFrame:
    """The ``k`` most frequent n-grams of each size, ties by n-gram, without a shuffle of all distinct n-grams.

    First only the loads of ``buckets`` hash buckets per size are counted, a number of rows per task that
    does not grow with the text. The n-grams of the ``first`` heaviest buckets are then counted
    exactly; their ``k``-th count is a bound that every n-gram of the answer reaches, and so does its bucket.
    Whatever other bucket reaches it is counted as well, so the result is exact for any data. The buckets
    chosen are a bitmap of ``buckets`` bits per size, and only their n-grams are spelled. The text is read twice,
    or three times if the heaviest buckets were not enough.

    ``seen``, if given, receives the number of n-grams that were counted exactly.
    """
    sizes = list(dict.fromkeys(sizes))
    hashed = _hashed_words(df, text)
    bucket = [_bucket(n, buckets, at * buckets) for at, n in enumerate(sizes)]
    none = F.array().cast("array<int>")
    every = hashed.select(F.explode(F.concat(*[F.coalesce(F.transform(_starts(n), f), none) for n, f in zip(sizes, bucket)])).alias("bucket"))
    size = F.get(F.array(*map(F.lit, sizes)), F.expr(f"int(bucket div {buckets})")).alias("n")
    loads = materialize(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("load")).select(size, "bucket", "load"))
    by_load = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("load"), "bucket"))
    heavy = materialize(loads.withColumn("place", by_load).where(F.col("place") <= first).select("n", "bucket"))

    def recount(chosen: DataFrame) -> DataFrame:
        bits = _bitmap(chosen, len(sizes) * buckets)
        none = F.array().cast("array<struct<n:int,ngram:string>>")

        def found(n: int, bucket: Callable[[Column], Column]) -> Column:
            inside = lambda b: F.getbit(F.get(bits, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1
            return F.coalesce(F.transform(F.filter(_starts(n), lambda i: inside(bucket(i))), _spelled(n)), none)

        met = hashed.select(F.inline(F.concat(*[found(n, f) for n, f in zip(sizes, bucket)])))
        return materialize(met.groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("freq")))

    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("freq"), "ngram"))
    counted = recount(heavy)
    bound = counted.withColumn("rank", rank).where(F.col("rank") == k).select("n", F.col("freq").alias("bound"))
    left = loads.join(F.broadcast(heavy), ["n", "bucket"], "left_anti").join(F.broadcast(bound), "n", "left")
    left = materialize(left.where(F.col("load") >= F.coalesce("bound", F.lit(0))).select("n", "bucket"))
    if not is_empty(left):
        counted = counted.unionByName(recount(left))
    if seen is not None:
        seen["counted"] = counted.count()
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("n", "ngram", "freq", "rank")


def word_cloud(df: DataFrame, text: str, k: int) -> DataFrame:
    """The most frequent words with their weight relative to the first."""
    top = word_frequency(df, tx.clean_words(F.col(text))).orderBy(F.desc("freq"), "word").limit(k)
    return top.withColumn("weight", F.col("freq") / top.agg(F.max("freq")).scalar())


def corpus_card(df: DataFrame, text: str, by: str) -> DataFrame:
    """Rows, bytes, words and tokens per group in one pass."""
    t = F.col(text)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.coalesce(F.sum(tx.word_count(t)), F.lit(0)).cast("bigint").alias("n_words"),
        F.coalesce(F.sum(tx.token_count(t)), F.lit(0)).cast("bigint").alias("n_tokens"),
    )
