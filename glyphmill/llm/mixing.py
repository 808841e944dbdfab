"""Mix sources to target weights: water-filled word targets and systematic sampling of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.hashing import int31
from glyphmill.llm.rows import apart, fresh, row_key, running
from glyphmill.operators.ordering import in_order, numbered
from glyphmill.session import materialize

# Expected copies are whole numbers of 1 / UNIT copies, so that prefix sums are exact.
UNIT = 1 << 20


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """Word target of every source.

    ``sizes`` has one row per ``source`` with ``source_size``. Sources in code-point order (NULL
    last) take ``weights`` in turn and share ``share`` times all words. A target stops at ``most``
    times the source's words; the excess goes to the others by weight until none is above. That
    fixed point is ``least(most * size, level * weight)`` with one level for all sources, which
    running totals over sources sorted by ``most * size / weight`` find without iteration.
    Returns ``source, source_size, target``.
    """
    ranked = numbered(sizes, F.col("source").isNull(), F.col("source"), name="_rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", turn.cast("bigint").alias("_w"), (F.col("source_size") * most).alias("_cap"))
    # Compare cap / weight as whole numbers: multiply by a common multiple of the weights.
    multiple = 1
    for w in weights:
        multiple *= w
    weighed = weighed.withColumn("_ratio", F.expr(f"_cap * ({multiple} div _w)"))
    order = [F.col("_ratio"), F.col("source").isNull(), F.col("source")]
    filled = materialize(running(weighed, order, {"_caps": "_cap", "_ws": "_w"}))
    all_words, all_w = (filled.agg(F.sum(c).alias("x")).select("x").scalar() for c in ("source_size", "_w"))
    level = (F.lit(float(share)) * all_words - F.col("_caps")) / (all_w - F.col("_ws"))
    # The level is that of the first source, in this order, which does not reach its cap.
    found = filled.where(level * F.col("_w") <= F.col("_cap")).agg(F.min_by(level, F.struct("_ratio", F.col("source").isNull(), "source")).alias("x"))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(found.select("x").scalar() * F.col("_w"), F.col("_cap").cast("double")))
    return filled.select("source", "source_size", target.alias("target"))


def systematic(rows: DataFrame, stratum: str, order: list[Column], expected: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``copies``: how often systematic sampling emits each row.

    ``expected`` has one row per ``stratum`` with ``units``, the expected copies of each of its rows
    in 1 / UNIT. The expected copies are prefix-summed within the stratum in ``order``, shifted by
    the stratum's one random offset, and a row is emitted once per whole number that its interval
    crosses: floor or ceiling of its expectation, and the stratum's total within one copy. When
    ``order`` begins with a size, the sizes drawn also follow the stratum's sizes evenly.

    A stratum may span any number of chunks of the global order; only chunk totals are put in
    sequence, so a stratum that holds a third of all rows is spread like any other.
    """
    keys = {f"key{i}": k for i, k in enumerate([F.col(stratum).isNull(), F.col(stratum), *order])}
    held = apart(rows, ["copies", *[c.lower() for c in expected.columns if c != stratum]], **keys, _stratum=_known(F.col(stratum)))
    placed = in_order(held, *[F.col(k) for k in keys])
    chunks = placed.groupBy("_part", "_stratum").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_stratum").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    rates = expected.select(_known(F.col(stratum)).alias("_stratum"), *[c for c in expected.columns if c != stratum])
    chunks = chunks.join(rates, "_stratum")
    local = Window.partitionBy("_part", "_stratum").orderBy("_at")
    ranked = placed.withColumn("_rank", F.row_number().over(local)).join(chunks, ["_part", "_stratum"])
    shift = F.pmod(int31(F.concat(F.lit(f"{seed}|"), F.col("_stratum"))), F.lit(UNIT))
    upto = (F.col("_before") + F.col("_rank")) * F.col("units") + shift
    crossed = ranked.withColumns({"_upto": upto, "_from": upto - F.col("units")})
    copies = F.expr(f"_upto div {UNIT} - _from div {UNIT}")
    return crossed.withColumn("copies", copies).select("row.*", *[c for c in expected.columns if c != stratum], "copies")


def _known(value: Column) -> Column:
    """A join key that tells NULL from every text."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.lit("+"), value))


def mix(docs: DataFrame, size: Column, order: list[Column], weights: list[int], share: float, most: int, seed: int = 0) -> DataFrame:
    """``docs`` (slim rows with ``source``) with ``size, source_size, target, copies``.

    NULL sources form one source. A source without words gets target 0 and no copies; a row of size
    0 may be emitted but takes no words. An empty table gives an empty table. Equal rows are
    interchangeable. Columns ``size, source_size, target, units, copies`` of ``docs`` are replaced, all others stay. No row is emitted more than ``most`` times.
    """
    rows = docs.withColumn("size", size).drop("source_size", "target", "units", "copies")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    units = F.when(F.col("source_size") > 0, F.floor(F.col("target") * UNIT / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rates = materialize(targets.withColumn("units", units))
    return systematic(rows, "source", [F.col("size"), *order], rates, seed).drop("units")


def mixed_rows(docs: DataFrame, size: Column, weights: list[int], share: float, most: int, seed: int = 0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (rows taken no time go), columns unchanged.

    Only ids, sources and sizes are sorted and sampled; texts move once, to meet their copies.
    """
    row, copy, key, own, copies = fresh(docs, "_row", "_copy", "_key", "_id", "_copies")
    named = docs.withColumn(row, row_key(docs))
    slim = named.select("doc_id", "source", F.col(row).alias("row"), size.alias("size"))
    mixed = mix(slim, F.col("size"), [F.col("doc_id"), F.col("row")], weights, share, most, seed)
    # Equal rows are one row here and their copies are added up.
    taken = mixed.groupBy(F.col("row").alias(key), F.col("doc_id").alias(own)).agg(F.sum("copies").cast("int").alias(copies))
    # The key holds the id as well; comparing ids in no form that would be a second join key, the texts
    # lie by ``row`` alone after the join and dropping their equals moves them no second time.
    same_id = F.coalesce(F.col("doc_id") == F.col(own), F.col("doc_id").isNull() & F.col(own).isNull())
    met = named.join(taken.where(F.col(copies) > 0), (F.col(row) == F.col(key)) & same_id)
    single = met.dropDuplicates([row, "doc_id"])
    return single.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
