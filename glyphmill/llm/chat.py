"""Collapse cumulative snapshots of conversations and render what remains; native operations only.

A log often stores a conversation after every turn, so that shorter rows are prefixes of longer ones.
Rolling hashes of every turn prefix find them: a conversation whose last hash is an inner hash of
another is its prefix and goes; of equal conversations the smallest ``conv_id`` stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.ordering import numbered
from glyphmill.operators.skew import join_by_key
from glyphmill.session import materialize

# Turns whose hashes roll in one window, and turns in one part of a rendered conversation.
BLOCK = 4096
CONV = ["no_id", "conv"]
PREFIX = ["n", "h1", "h2"]


def placed_turns(turns: DataFrame) -> DataFrame:
    """Turns with their 0-based ``pos`` and the conversation's ``n_turns``, in order of turn, role and text."""
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("no_id"), F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    ranked = materialize(numbered(rows, *order, name="row_no"))
    spans = ranked.groupBy(*CONV).agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n_turns"))
    joined = join_by_key(ranked, spans, CONV, "n_turns", ranked.count(), ["row_no"])
    return joined.select(*CONV, "role", "text", (F.col("row_no") - F.col("first")).alias("pos"), "n_turns")


def rolling_prefixes(placed: DataFrame) -> DataFrame:
    """``no_id, conv, pos, n_turns, h1, h2``: each turn with the 128-bit hash of the prefix that it ends.

    A prefix's hash is the exclusive or of its turns' hashes, each salted with its position. It rolls
    from turn to turn within blocks of ``BLOCK`` turns and from block to block, so a conversation of
    any length is spread over tasks.
    """
    block = F.expr(f"pos div {BLOCK}")
    own = placed.select(*CONV, "pos", "n_turns", block.alias("block"), *[F.xxhash64(F.lit(s), "pos", "role", "text").alias(s) for s in ("a", "b")])
    inside = Window.partitionBy(*CONV, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy(*CONV, "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    blocks = blocks.select(*CONV, "block", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(f"{s}0") for s in "ab"])
    rolled = own.withColumns({s: F.bit_xor(s).over(inside) for s in "ab"}).join(blocks, [*CONV, "block"])
    return rolled.select(*CONV, "pos", "n_turns", F.col("a").bitwiseXOR(F.col("a0")).alias("h1"), F.col("b").bitwiseXOR(F.col("b0")).alias("h2"))


def maximal(placed: DataFrame) -> DataFrame:
    """``no_id, conv, n_turns`` of the conversations that are no prefix of a longer one, one of each equal set."""
    prefixes = materialize(rolling_prefixes(placed).withColumn("n", F.col("pos") + 1))
    # Both sides shrink to one row per prefix before they meet: a first turn that a third of all
    # conversations share, or thousands of copies of a conversation, are single rows.
    inner = prefixes.where(F.col("n") < F.col("n_turns")).select(*PREFIX).distinct()
    ends = prefixes.where(F.col("n") == F.col("n_turns")).groupBy(*PREFIX).agg(F.min(F.struct(*CONV)).alias("who"))
    kept = ends.join(inner, PREFIX, "left_anti")
    return kept.select("who.*", F.col("n").alias("n_turns"))


def render_turn(role: Column, text: Column, start: str, end: str) -> Column:
    return F.concat(F.lit(start), role, F.lit("\n"), text, F.lit(end), F.lit("\n"))


def collapse_and_render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """``conv_id, part, n_turns, text``: every maximal conversation in chat markup.

    Turns go by ``turn`` (NULL first), then role, then text hash. A NULL role reads 'unknown', a NULL text is
    empty; turns without ``conv_id`` form one conversation of their own, after all others in rank.
    A conversation has one row per ``BLOCK`` turns (``part`` 0, 1, ...); the parts joined are its
    text, and ``n_turns`` counts the turns of the part. Of equal conversations the smallest id stays.
    An empty table gives an empty table; other columns are ignored.
    """
    placed = materialize(placed_turns(turns))
    kept = materialize(maximal(placed))
    total = kept.agg(F.sum("n_turns")).first()[0] or 0
    rows = join_by_key(placed.drop("n_turns"), kept, CONV, "n_turns", total, ["pos"])
    shown = rows.select(*CONV, F.expr(f"pos div {BLOCK}").alias("part"), "pos", render_turn(F.col("role"), F.col("text"), start, end).alias("shown"))
    parts = shown.groupBy(*CONV, "part").agg(F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("turns"))
    conv_id = F.when(~F.col("no_id"), F.col("conv"))
    return parts.select(conv_id.alias("conv_id"), F.col("part").cast("bigint"), F.size("turns").cast("bigint").alias("n_turns"), F.array_join(F.col("turns.shown"), "").alias("text"))
