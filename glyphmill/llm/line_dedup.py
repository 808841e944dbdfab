"""Remove lines that many documents share; native DataFrame operations only.

Hashes of the long lines are range-partitioned with a secondary sort by document (largest first) and
position, which spares the grouping by document an exchange. An aggregate over each line, not the
order, names the document that keeps it. What comes back is a compressed keep bitmap per document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.rows import ASCII_SPACE, ascii_lower, fresh
from glyphmill.operators.skew import join_by_key
from glyphmill.session import materialize


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def text_mark(text: Column) -> Column:
    """Tells rows with the same id but another text apart."""
    return F.hash(text)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h1, h2, doc_id, mark, at)`` for every long line: one row per line hash and document, in line order.

    The exchange is by ranges of (hash, document, largest first), so a line that a third of all
    documents hold is cut over many partitions; grouping by the same columns needs no further one.
    """
    split = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keyed = split.where(F.col("doc_id").isNotNull()).select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    # The hashes stand in for the 128-bit identity of a key; the text goes no further.
    hashed = keyed.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "mark", "pos"
    )
    # Range bounds are sampled before rows are dealt: written once, the texts are not split twice.
    hashed = materialize(hashed)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("mark")]
    ordered = hashed.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    return ordered.groupBy("h1", "h2", "doc_id", "mark").agg(F.collect_list("pos").alias("at"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``(doc_id, mark, n_dropped, bits)`` for every document that loses a line.

    A line whose key has at least ``min_chars`` code points and is found in at least ``min_docs``
    documents stays only in the largest ``doc_id`` that holds it, in all its places there. ``bits``
    is the keep bitmap: bit ``i mod 64`` of word ``i div 64`` is 1 if line ``i`` stays. Words after
    the last dropped line are left out and mean 'all stay'.

    Rows without a ``doc_id`` neither count nor lose lines. Rows that share a ``doc_id`` are one
    document (equal rows get equal bitmaps). NULL and empty texts are one empty line.
    """
    held = materialize(occurrences(docs, min_chars))
    # Partial sums leave each task once per line, however many documents hold the line. In this order
    # a line's first occurrence is the one in its largest document.
    firsts = held.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("_docs"), F.max("doc_id").alias("_first"))
    firsts = materialize(firsts.where(F.col("_docs") >= min_docs))
    total = firsts.agg(F.sum("_docs")).first()[0] or 0
    shared = join_by_key(held, firsts, ["h1", "h2"], "_docs", total, ["doc_id"])
    places = shared.where(F.col("doc_id") < F.col("_first")).select("doc_id", "mark", F.explode("at").alias("pos"))
    bit = F.expr("shiftleft(1L, pos & 63)")
    gone = places.groupBy("doc_id", "mark", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("gone"), F.count(F.lit(1)).alias("n"))
    packed = gone.groupBy("doc_id", "mark").agg(
        F.sum("n").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("words")
    )
    # Fill the words between dropped lines with 'all stay'.
    before = lambda i: F.when(i > 0, F.get("words", i - 1)["word"]).otherwise(F.lit(-1))
    dense = F.flatten(F.transform("words", lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), w["word"] - before(i) - 1), F.array(w["keep"]))))
    return packed.select("doc_id", "mark", "n_dropped", dense.alias("bits"))


def kept_text(text: Column, bits: Column) -> Column:
    """The lines that a keep bitmap leaves, joined by newlines."""
    stays = lambda i: F.coalesce(F.getbit(F.get(bits, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 1, F.lit(True))
    return F.array_join(F.filter(lines(text), lambda _, i: stays(i)), "\n")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, bits: str = "_bits", n_dropped: str = "_n_dropped") -> DataFrame:
    """``docs`` with the columns ``bits`` and ``n_dropped`` (NULL where nothing is dropped)."""
    mark, own, its = fresh(docs, "_mark", "_id", "_m")
    marked = docs.withColumn(mark, text_mark(F.col("text")))
    verdicts = bitmaps.select(F.col("doc_id").alias(own), F.col("mark").alias(its), F.col("bits").alias(bits), F.col("n_dropped").alias(n_dropped))
    return marked.join(verdicts, (F.col("doc_id") == F.col(own)) & (F.col(mark) == F.col(its)), "left").drop(own, its, mark)


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the same columns and the shared lines taken out of ``text``; other texts are untouched."""
    bits, n_dropped = fresh(docs, "_bits", "_n_dropped")
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), bits, n_dropped)
    text = F.when(F.col(bits).isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col(bits)))
    return joined.withColumn("text", text).select(*docs.columns)
