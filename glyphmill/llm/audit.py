"""Audit of how quality filters interact, as a stream over files that retracts what a smaller id takes back.

All files of a table are processed as available-now micro-batches. A text's state, found by its digest, is
the smallest id that holds it and the rows counted under that id: they are the only ones that the copy
filter spares. When a smaller id arrives, their earlier mask of failures is retracted from the counters
of their part and the mask with the copy filter is counted instead. Counters of (part, mask, marks) hold
all that the orders of the filters need. Some thousand texts, by their digests, share a key of the
state store, because a call for each text costs far more than the text.

Rows of a batch meet by digest and marks before they are shuffled, so a text that many rows share is a few
rows of any batch, and its state counts rows instead of holding them.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.llm.rows import words
from glyphmill.session import scratch_path, stored

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
# Micro-batches that the files are dealt into; the result is the same for any number.
BATCHES = 4
# Texts that share a key of the state, on average.
TEXTS = 4096
# Rows that a task gathers before it adds them up.
GATHERED = 1 << 17

_MARKS = ["part", "mask", "good", "toxic"]
_ADDED = "bucket bigint, digest binary, part string, mask int, good boolean, toxic boolean, known boolean, least bigint, at_least bigint, n bigint"
_STATE = "texts binary"
_MOVES = "part string, mask int, good boolean, toxic boolean, n bigint"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; NULL counts as empty."""
    known = F.coalesce(text, F.lit(""))
    own = words(text)
    fails = [
        F.size(own) < 200,
        100 * F.size(F.array_distinct(own)) < 50 * F.size(own),
        100 * F.regexp_count(known, F.lit("[A-Z]")) > 3 * F.length(known),
        known.rlike("[#$%&*|]"),
    ]
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0)).cast("int")


def _added(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task by digest and marks: the smallest id, how many rows have it, and how many there are."""
    keys = ["bucket", "digest", *_MARKS, "known"]

    def summed(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        rows["least"] = rows.groupby(keys, sort=False)["doc_id"].transform("min")
        rows["at_least"] = rows["doc_id"] == rows["least"]
        rows["n"] = 1
        return rows.groupby([*keys, "least"], sort=False, as_index=False).agg({"at_least": "sum", "n": "sum"})

    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= GATHERED:
            yield summed(held)
            held, size = [], 0
    if size:
        yield summed(held)


def _followed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters that new rows make, retractions included; the state maps digests to ``(least, spared rows)``."""
    texts = pickle.loads(state.get[0]) if state.exists else {}
    moves: Counter = Counter()
    for frame in frames:
        for digest, part, mask, good, toxic, known, first, at_first, n in zip(*(frame[c].tolist() for c in ["digest", *_MARKS, "known", "least", "at_least", "n"])):
            marks = (part, good, toxic)
            if not known:
                # A row without an id is no copy of a smaller one and no other row's smaller one.
                moves[marks, mask] += n
                continue
            least, spared = texts.get(digest, (None, {}))
            if least is None or first < least:
                for earlier, count in spared.items():
                    moves[earlier, mask] -= count
                    moves[earlier, mask | COPY] += count
                least, spared = first, {}
                texts[digest] = (least, spared)
            stays = at_first if first == least else 0
            if stays:
                spared[marks] = spared.get(marks, 0) + stays
                moves[marks, mask] += stays
            moves[marks, mask | COPY] += n - stays
    state.update((pickle.dumps(texts, pickle.HIGHEST_PROTOCOL),))
    yield pd.DataFrame([(part, bits, good, toxic, n) for ((part, good, toxic), bits), n in moves.items() if n], columns=["part", "mask", "good", "toxic", "n"])


def counters(spark: SparkSession, path: str, labels: DataFrame, part: str = "lang", batches: int = BATCHES) -> DataFrame:
    """``part, mask, good, toxic, n``: documents of the Parquet files under ``path`` by what they fail and how they are labelled.

    The files hold ``doc_id, text`` and the column ``part`` (NULL: empty string), any others are not read. ``labels`` has
    ``doc_id, quality, toxic``; an id labelled more than once has a mark if any of its rows does. State, log and
    changes lie in the shared folder; a stream that lost executors goes on from its last batch.

    NULL texts are empty texts, and equal to them. A row without an id fails the copy filter never and makes no other row
    fail it; rows with equal id and text don't either. Rows without a label have no mark. An empty table gives no rows.
    """
    table = spark.read.parquet(path)
    # Counted from the files' footers.
    buckets = max(1, table.count() // TEXTS)
    files = max(1, -(-len(table.inputFiles()) // batches))
    # A pattern, because a stream takes no single file by its plain name.
    given = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    text, known = F.col("text"), F.col("doc_id").isNotNull()
    slim = given.select(
        "doc_id", known.alias("known"), F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)).alias("digest"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"),
        # Rows without an id are dealt out as if they had different ones.
        F.when(known, 0).otherwise(F.xxhash64(text)).alias("spread"),
    )
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    marked = stored(marked.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")))
    marked = marked.withColumn("spread", F.lit(0).cast("bigint"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = slim.join(marked, ["doc_id", "spread"], "left").select(
        F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc_id"), "known", F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), "digest", "part", "mask",
        no("good"), no("toxic"),
    )
    followed = rows.mapInPandas(_added, _ADDED).groupBy("bucket").applyInPandasWithState(_followed, _MOVES, _STATE, "append", GroupStateTimeout.NoTimeout)
    out = scratch_path(spark, "audit-moves")
    stream = followed.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "audit-log"))
    stream.outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    moves = spark.read.schema(_MOVES).parquet(out)
    return moves.groupBy(*_MARKS).agg(F.sum("n").alias("n")).where("n <> 0")


def _orders() -> list[tuple[str, int, int, int]]:
    """``(order, step, bit of its filter, bits of the filters before)``."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order):
            out.append(("".join(FILTERS[j] for j in order), step + 1, 1 << i, before))
            before |= 1 << i
    return out


def interactions(counted: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the table of :func:`counters`.

    ``kept`` documents after the step, ``removed`` in it, ``redundant`` (failing its filter, removed before), ``unique_fails``
    (failing it only), ``good_lost`` and ``toxic_lost`` (removed in it, with the mark), and ``shapley``: what its filter removes, over all orders.
    """
    spark = counted.sparkSession
    orders = F.broadcast(spark.createDataFrame(_orders(), "filter_order string, step int, bit int, before int"))
    bit, before, n = F.col("bit"), F.col("before"), F.col("n")
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(before) != 0
    count = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")
    # At most 128 counters of a part meet the 600 steps.
    steps = counted.join(orders).groupBy("part", "filter_order", "step", "bit").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("mask") == bit).alias("unique_fails"), count(fails & ~gone & F.col("good")).alias("good_lost"),
        count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    shares = steps.groupBy("part", "bit").agg(F.sum("removed").cast("bigint").alias("shapley"))
    return steps.join(shares, ["part", "bit"]).drop("bit")


def audit(spark: SparkSession, path: str, labels: DataFrame, part: str = "lang", batches: int = BATCHES) -> DataFrame:
    """:func:`interactions` of the :func:`counters` of all documents under ``path``."""
    return interactions(stored(counters(spark, path, labels, part, batches)))
