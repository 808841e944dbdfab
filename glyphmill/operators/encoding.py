"""Vocabularies, encoding, masking, labels and the context-length schedule."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.hashing import MERSENNE_31, draw
from glyphmill.operators.merges import Segmenter
from glyphmill.operators.ordering import numbered, row_index

# Special tokens and their ids, and the label that losses ignore.
PAD, UNK, CLS, SEP, MASK = "<pad>", "<unk>", "<s>", "</s>", "<mask>"
SPECIALS = [PAD, UNK, CLS, SEP, MASK]
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = range(5)
IGNORED_LABEL = -100
MAX_VOCAB = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Word ids of at most ``MAX_VOCAB`` words, shared with every worker once."""

    spark: SparkSession
    words: list[str]

    @property
    def size(self) -> int:
        return len(SPECIALS) + len(self.words)

    def broadcast(self):
        index = {w: i + len(SPECIALS) for i, w in enumerate(self.words)}
        return self.spark.sparkContext.broadcast(index)


def word_vocabulary(df: DataFrame, words: Column, size: int) -> Vocabulary:
    """The ``size`` most frequent words, ids by falling frequency, ties by word."""
    if size > MAX_VOCAB:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCAB} words")
    counted = df.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "w").limit(size).collect()
    return Vocabulary(df.sparkSession, [r["w"] for r in top])


def word_ids(words: Column, vocab: Vocabulary) -> Column:
    """Ids of an array of words, unknown words as ``UNK_ID`` (Arrow batches, no shuffle)."""
    shared = vocab.broadcast()

    @F.pandas_udf("array<int>")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = shared.value.get
        for s in batches:
            yield s.map(lambda ws: np.fromiter((get(w, UNK_ID) for w in ws), dtype=np.int32, count=len(ws)))

    return look_up(words)


@dataclass(frozen=True)
class Subwords:
    """A trained byte-pair vocabulary: ids of its characters and merges after the special ones."""

    spark: SparkSession
    alphabet: list[str]
    merges: list[tuple[str, str]]

    @property
    def size(self) -> int:
        return len(SPECIALS) + len(self.alphabet) + len({a + b for a, b in self.merges} - set(self.alphabet))


def subword_ids(words: Column, vocab: Subwords) -> Column:
    """Ids of the symbols of an array of words, one after the other (Arrow batches; a task cuts a word once and remembers it)."""
    shared = vocab.spark.sparkContext.broadcast((vocab.alphabet, vocab.merges))

    @F.pandas_udf("array<int>")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Segmenter(*shared.value, first_id=len(SPECIALS), unknown=UNK_ID)
        for s in batches:
            yield s.map(lambda ws: np.fromiter(chain.from_iterable(map(known.__getitem__, ws)), dtype=np.int32))

    return look_up(words)


def encode(
    df: DataFrame, words: Column, vocab: Vocabulary, max_length: int | Column,
    pad: bool = True, pad_left: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``special_tokens_mask``.

    A sequence is start, words, end, cut to ``max_length`` and padded to it when asked.
    Words beyond the limit are cut before they are looked up.
    """
    limit = F.lit(max_length) if isinstance(max_length, int) else max_length
    cut = df.select(*(keep or df.columns), limit.cast("int").alias("_limit"), F.slice(words, F.lit(1), limit.cast("int") - 2).alias("_w"))
    return _framed(cut.withColumn("_ids", word_ids(F.col("_w"), vocab)).drop("_w"), keep or df.columns, pad, pad_left)


def encode_subwords(
    df: DataFrame, words: Column, vocab: Subwords, max_length: int | Column,
    pad: bool = True, pad_left: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """:func:`encode` with the symbols that the merges leave of every word; only characters can be unknown.

    No word has fewer than one symbol, so words beyond the limit are cut before the look-up and symbols after it.
    """
    limit = (F.lit(max_length) if isinstance(max_length, int) else max_length).cast("int")
    cut = df.select(*(keep or df.columns), limit.alias("_limit"), F.slice(words, F.lit(1), limit - 2).alias("_w"))
    found = cut.withColumn("_ids", subword_ids(F.col("_w"), vocab)).drop("_w")
    return _framed(found.withColumn("_ids", F.slice("_ids", F.lit(1), F.col("_limit") - 2)), keep or df.columns, pad, pad_left)


def _framed(out: DataFrame, keep: list[str], pad: bool, pad_left: bool) -> DataFrame:
    """Start and end, padding and the masks around ``_ids`` of rows with a ``_limit``."""
    n_pad = F.col("_limit") - F.size("_ids") - 2 if pad else F.lit(0)
    pads = lambda v: F.array_repeat(F.lit(v), n_pad)
    edge = lambda v: F.array(F.lit(v))

    def build(first: Column, middle: Column, last: Column, filler: int) -> Column:
        parts = [first, middle, last]
        return F.concat(pads(filler), *parts) if pad_left else F.concat(*parts, pads(filler))

    body = F.transform("_ids", lambda _: F.lit(1))
    none = F.transform("_ids", lambda _: F.lit(0))
    return out.select(
        *keep,
        build(edge(CLS_ID), F.col("_ids"), edge(SEP_ID), PAD_ID).alias("input_ids"),
        build(edge(1), body, edge(1), 0).alias("attention_mask"),
        build(edge(1), none, edge(1), 1).alias("special_tokens_mask"),
    )


def mlm_mask(df: DataFrame, id_col: str, vocab_size: int, p: float = 0.15, seed: int = 1998, epoch: int = 0) -> DataFrame:
    """Mask encoded rows: each non-special position is chosen with probability ``p``; of those 80 %
    become the mask, 10 % a random word and 10 % stay. ``labels`` holds the chosen ids, else -100.

    One draw per (seed, epoch, row, position) decides, so the result does not depend on partitioning.
    """
    span = float(MERSENNE_31 + 1)
    chosen, masked, random = int(p * span), int(0.8 * p * span), int(0.9 * p * span)
    places = F.transform(
        F.arrays_zip("input_ids", "special_tokens_mask"),
        lambda t, i: F.struct(
            t["input_ids"].alias("id"),
            F.when(t["special_tokens_mask"] == 1, F.lit(MERSENNE_31).cast("bigint")).otherwise(draw(seed, F.lit(epoch), F.col(id_col), i)).alias("u"),
            i.alias("i"),
        ),
    )
    words = vocab_size - len(SPECIALS)
    swapped = lambda i: (F.pmod(draw(seed + 1, F.lit(epoch), F.col(id_col), i), F.lit(words)) + len(SPECIALS)).cast("int")
    out = df.withColumn("_p", places)
    return out.withColumn(
        "input_ids",
        F.transform("_p", lambda t: F.when(t["u"] < masked, F.lit(MASK_ID)).when(t["u"] < random, swapped(t["i"])).otherwise(t["id"])),
    ).withColumn("labels", F.transform("_p", lambda t: F.when(t["u"] < chosen, t["id"]).otherwise(F.lit(IGNORED_LABEL)))).drop("_p")


def causal_labels(ids: Column, pad_id: int | None = PAD_ID, eos_id: int = SEP_ID) -> Column:
    """Copy of the ids with pads as -100; without a pad id the end token serves as pad."""
    ignored = eos_id if pad_id is None else pad_id
    return F.transform(ids, lambda x: F.when(x == ignored, F.lit(IGNORED_LABEL)).otherwise(x))


# ---------------------------------------------------------------- context-length schedule

def context_lengths(initial: int, final: int, steps: int = 5) -> list[int]:
    """Lengths at the start of each of ``steps`` equal parts of training, then the final length."""
    return [initial + i * (final - initial) // steps for i in range(steps)] + [final]


def total_steps(rows: int, epochs: int, batch: int, accumulation: int = 1, devices: int = 1) -> int:
    return math.ceil(rows * epochs / (batch * accumulation * devices))


def curriculum(
    df: DataFrame, order: str, initial: int, final: int, effective_batch: int, epochs: int = 1, parts: int = 5,
) -> DataFrame:
    """Add the training ``step`` and the ``max_length`` in force when a row is first reached.

    Intervals are half open: progress exactly on a breakpoint has the later length; full progress
    has the final one.
    """
    steps = max(total_steps(df.count(), epochs, effective_batch), 1)
    lengths = context_lengths(initial, final, parts)
    out = row_index(df, order, name="_row").withColumn("step", F.floor(F.col("_row") / effective_batch)).drop("_row")
    # progress >= i / parts, in whole numbers
    length = F.lit(lengths[0])
    for i in range(1, parts + 1):
        length = F.when(F.col("step") * parts >= i * steps, F.lit(lengths[i])).otherwise(length)
    return out.withColumn("max_length", length)


def epoch_schedule(
    ids: DataFrame, id_col: str, initial: int, final: int, effective_batch: int, epochs: int = 1, parts: int = 5, seed: int = 1998,
) -> DataFrame:
    """``id, epoch, step, max_length`` of every row in every epoch, each epoch in an order of its own.

    The order is a draw of (seed, epoch, id), ties by id. Only ids are numbered and nothing else moves:
    join texts or encodings to the schedule, not the schedule's order to the texts. Progress exactly on
    a breakpoint has the later length, as in :func:`curriculum`.
    """
    if epochs < 1:
        raise ValueError("epochs is at least 1")
    every = ids.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    drawn = every.withColumn("_draw", draw(seed, F.col("epoch"), F.col(id_col)))
    placed = numbered(drawn, F.col("epoch"), F.col("_draw"), F.col(id_col), name="_row")
    steps = max(math.ceil(placed.count() / effective_batch), 1)
    lengths = context_lengths(initial, final, parts)
    step = F.floor(F.col("_row") / effective_batch)
    # The breakpoints as whole steps; their place in the list is that of the length in force.
    reached = F.size(F.filter(F.array(*[F.lit(-(-i * steps // parts)) for i in range(1, parts + 1)]), lambda b: step >= b))
    return placed.select(id_col, "epoch", step.alias("step"), F.get(F.array(*[F.lit(v) for v in lengths]), reached).alias("max_length"))
