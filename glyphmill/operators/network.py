"""Word co-occurrence networks: bigrams, edges, centralities and filtering.

A network is two tables: ``edges(w1, w2, weight)`` with ``w1 <= w2`` and ``nodes(word)``. Degrees, sizes and filters also
take :class:`PackedEdges`.
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import ordering
from glyphmill.operators.neighbors import BROADCAST_BYTES
from glyphmill.operators.skew import join_by_key
from glyphmill.session import discard, is_empty, materialize, stored

# Words of a block of the vector at least, its blocks at most, and links in a packed row (a batch of rows more at most).
BLOCK_WORDS, MOST_BLOCKS, CELL_LINKS = 1 << 14, 16, 1 << 18
# Rows of the searches that go at once in a network whose links no task can hold.
STATE_ROWS = 1 << 26
# Words of a block of texts, pairs of words of a cell on average, and numbers of a block at most, that are added up at once.
CODED_WORDS, BUCKET_PAIRS, MOST_WIDTH = 1 << 20, 1 << 19, 1 << 20


# ---------------------------------------------------------------- bigrams and edges

def adjacent(words: Column) -> Column:
    """Array of adjacent word pairs ``(w1, w2)``; empty below two words."""
    def pairs(w: Column) -> Column:
        inner = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, inner), F.slice(w, 2, inner), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))

    return tx.let(words, pairs)


def document_bigrams(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), F.inline(adjacent(tx.clean_words(F.col(text)))))


def border_bigrams(df: DataFrame, text: str, order: str) -> DataFrame:
    """Pairs across neighbouring documents: last word of one, first word of the next with any words."""
    worded = df.where(F.col(text).rlike(tx.WORD_RUN))
    ends = worded.select(F.col(order).alias("_ord"), tx.clean_words(F.col(text)).alias("_w"))
    ends = ends.select("_ord", F.element_at("_w", 1).alias("_first"), F.element_at("_w", -1).alias("w1"))
    return ordering.follow(ends, "_ord", {"_first": "w2"}).where("w2 IS NOT NULL").select("w1", "w2")


def bigram_counts(df: DataFrame, text: str, cross_document_order: str | None = None, packed: bool = False) -> DataFrame | PackedBigrams:
    """Directed counts of adjacent words, within documents or over the documents read as one text.

    ``packed`` gives them by numbers and by blocks of text, for readers that need no row per pair.
    """
    if packed:
        return packed_bigrams(df, text, cross_document_order)
    pairs = document_bigrams(df, text)
    if cross_document_order:
        pairs = pairs.unionByName(border_bigrams(df, text, cross_document_order))
    return pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n_pairs"))


def undirected(pairs: DataFrame) -> DataFrame:
    """Weight of each unordered pair: both directions added; a word next to itself counts twice."""
    doubled = F.when(F.col("w1") == F.col("w2"), F.col("n_pairs") * 2).otherwise(F.col("n_pairs"))
    return pairs.groupBy(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.sum(doubled).alias("weight"))


def counted_steps(df: DataFrame, text: str) -> DataFrame:
    """Counts of each word followed by the next one (``w2`` is NULL after a document's last word).

    One pass over the text gives both the pairs and, summed over ``w2``, the word frequencies.
    """
    def steps(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.struct(x.alias("w1"), F.get(w, i + 1).alias("w2")))

    pairs = df.select(F.inline(tx.let(tx.clean_words(F.col(text)), steps)))
    return pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n_pairs"))


def with_frequencies(edges: DataFrame, freq: DataFrame, total: int, min_freq: int = 1) -> DataFrame:
    """Edges whose two words both occur at least ``min_freq`` times, with the two frequencies.

    ``total`` is the number of words. A word has at most twice its occurrences as edges, so only
    very frequent words can overload a task.
    """
    known = freq.where(F.col("freq") >= min_freq)
    left = known.select(F.col("word").alias("w1"), F.col("freq").alias("freq1"))
    right = known.select(F.col("word").alias("w2"), F.col("freq").alias("freq2"))
    one = join_by_key(edges, left, ["w1"], "freq1", total, ["w2"])
    return join_by_key(one, right, ["w2"], "freq2", total, ["w1"])


def _lists(offsets: np.ndarray, values) -> pa.Array:
    """One list per stretch of ``values`` between two offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _pressed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Numbers in order, each once, with a count each: as compressed steps."""
    parts = (np.diff(key, prepend=0).astype(np.int64), n.astype(np.int64))
    return pickle.dumps((len(key), *(pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts)))


def _unpressed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and counts of :func:`_pressed`."""
    size, *parts = pickle.loads(data)
    steps, n = (np.frombuffer(pa.decompress(x, 8 * size, "zstd", asbytes=True), np.int64) for x in parts)
    return np.cumsum(steps), n


def _coded_block(lists: pa.Array, counted: np.ndarray, directed: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``words, n, key, weight`` of a block of word lists: its words in order, how often they occur in ``counted``
    lists, and its unordered pairs of adjacent words by their places in ``words`` (a word next to itself counts twice),
    the first place times the number of words and the second one in one ``key``.
    ``directed`` pairs are the first and the second word, each counted as it is."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[coded.indices.to_numpy()]
    n = np.bincount(at[np.repeat(counted, lengths)], minlength=len(order))
    goes_on = np.ones(len(at), bool)
    goes_on[np.cumsum(lengths)[lengths > 0] - 1] = False
    first = np.flatnonzero(goes_on)
    a, b = at[first], at[first + 1]
    key, times = np.unique(a * len(order) + b if directed else np.minimum(a, b) * len(order) + np.maximum(a, b), return_counts=True)
    lo, hi = np.divmod(key, max(len(order), 1))
    return coded.dictionary.take(pa.array(order)), n, key, np.where((lo == hi) & (not directed), 2 * times, times)


def _code(block_words: int, directed: bool = False):
    """Task function over word lists: blocks of some ``block_words`` words, one row each."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, held_words = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            lists = pa.concat_arrays([b.column(0) for b in held])
            counted = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held]).astype(bool)
            words, n, key, weight = _coded_block(lists, counted, directed)
            columns = [pa.array([(part << 32) + number], pa.int64())]
            columns += [_lists([0, len(words)], c) for c in (words, n.astype(np.int64))]
            columns += [pa.array([len(key)], pa.int64()), pa.array([_pressed(key, weight)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "words", "n", "n_pairs", "pairs"])

        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            start = 0
            while start < len(lengths):
                # As many lists as fill the block, at least one.
                stop = int(np.searchsorted(sums, sums[start] + block_words - held_words))
                stop = min(max(stop, start + 1), len(lengths))
                held.append(batch.slice(start, stop - start))
                held_words += int(sums[stop] - sums[start])
                if held_words >= block_words:
                    yield row()
                    number, held, held_words = number + 1, [], 0
                start = stop
        if held_words:
            yield row()

    return code


def _stretches(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """Rows sorted by ``keys``: each key with its rows."""
    at, held = None, []
    for batch in batches:
        values = [batch.column(k).to_numpy() for k in keys]
        changes = np.any([v[1:] != v[:-1] for v in values], axis=0)
        cuts = [0, *(np.flatnonzero(changes) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            key = tuple(int(v[lo]) for v in values)
            if held and key != at:
                yield at, held
                held = []
            at = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, held


def _values(rows: list[pa.RecordBatch], column: str) -> np.ndarray:
    """The values of a list column of some rows, one after the other."""
    return np.concatenate([r.column(column).flatten().to_numpy() for r in rows])


def _number(min_freq: int, held_words: int):
    """Task function over the words of blocks, sorted by word: the words of at least ``min_freq`` occurrences, numbered
    from 0 in each task, and per block the places of its words with their numbers."""
    names = ["part", "first", "words", "freq", "block", "pos", "at"]

    def packed(part: int, first: int, words: list, freq: list, places: list) -> Iterator[pa.RecordBatch]:
        lists = [_lists([0, sum(map(len, x))], c) for x, c in ((words, pa.concat_arrays(words)), (freq, np.concatenate(freq)))]
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), *lists, *none], names=names)
        block, pos, at = (np.concatenate(x) for x in zip(*places))
        order = np.argsort(block, kind="stable")
        own, sizes = np.unique(block, return_counts=True)
        offsets, n = np.concatenate([[0], np.cumsum(sizes)]), len(own)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))]
        places = [pa.array(own, pa.int64()), _lists(offsets, pos[order].astype(np.int32)), _lists(offsets, at[order])]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), *none, *places], names=names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, rest = TaskContext.get().partitionId(), 0, 0, None
        words, freq, places, held = [], [], [], 0
        for batch in itertools.chain(batches, [None]):
            here = [x for x in (rest, batch) if x is not None and x.num_rows]
            if not here:
                continue
            rows = pa.concat_batches(here)
            index = rows.column("word").dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(index[1:] != index[:-1]) + 1])
            # The last word may go on in the next batch.
            done = rows.num_rows if batch is None else int(starts[-1])
            rest, rows = (None if batch is None else rows.slice(done)), rows.slice(0, done)
            starts = starts[starts < done]
            if not done:
                continue
            block, pos, n = (rows.column(c).to_numpy() for c in ("block", "pos", "n"))
            sums = np.add.reduceat(n, starts)
            often = sums >= min_freq
            at = np.repeat(last + np.cumsum(often) - 1, np.diff([*starts, done]))
            own = np.repeat(often, np.diff([*starts, done]))
            if not often.any():
                continue
            words.append(rows.column("word").take(pa.array(starts[often])))
            freq.append(sums[often])
            places.append((block[own], pos[own], at[own]))
            last, held = last + int(often.sum()), held + int(own.sum())
            if held >= held_words:
                yield from packed(part, first, words, freq, places)
                first, words, freq, places, held = last, [], [], [], 0
        if words:
            yield from packed(part, first, words, freq, places)

    return number


def _deal(width: int, side: int):
    """Task function over blocks with the numbers of their frequent words: the pairs of such words, by cells."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = lambda c: batch.column(c).slice(k, 1).flatten()
                ids = _known_ids(cell("known"), batch.column("n_words")[k].as_py())
                key, weight = _unpressed(batch.column("pairs")[k].as_py())
                a, b = (ids[x] for x in np.divmod(key, len(ids)))
                both = np.flatnonzero((a >= 0) & (b >= 0))
                (i, lo), (j, hi) = np.divmod(a[both], width), np.divmod(b[both], width)
                at = i * side + j
                order = np.argsort((at * width + lo) * width + hi, kind="stable")
                used, sizes = np.unique(at, return_counts=True)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                columns = [lo[order].astype(np.int32), hi[order].astype(np.int32), weight[both][order]]
                out = [pa.array((used // side).astype(np.int32)), pa.array((used % side).astype(np.int32)), *[_lists(offsets, c) for c in columns]]
                yield pa.RecordBatch.from_arrays(out, names=["i", "j", "lo", "hi", "weight"])

    return deal


def _merge(width: int):
    """Task function over rows sorted by cell: the pairs of a cell, each once with its weights added up."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), rows in _stretches(batches, "i", "j"):
            key = _values(rows, "lo").astype(np.int64) * width + _values(rows, "hi")
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            weight = np.add.reduceat(_values(rows, "weight")[order], starts)
            lo, hi = np.divmod(key[starts], width)
            columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32())]
            columns += [_lists([0, len(lo)], c) for c in (lo.astype(np.int32), hi.astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([int(weight.sum())])], names=["i", "j", "lo", "hi", "weight", "total"])

    return merge


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and number: the words of a block with their frequencies."""
    for (i,), rows in _stretches(batches, "i"):
        columns = [pa.concat_arrays([r.column(c) for r in rows]) for c in ("word", "freq")]
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[_lists([0, len(c)], c) for c in columns]], names=["i", "words", "freq"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with the words of their two blocks: the edges by their words."""
    for batch in batches:
        for k in range(batch.num_rows):
            cell = lambda c: batch.column(c).slice(k, 1).flatten()
            lo, hi = cell("lo"), cell("hi")
            columns = [cell("words1").take(lo), cell("words2").take(hi), cell("weight"), cell("freqs1").take(lo), cell("freqs2").take(hi)]
            yield from pa.table(columns, names=["w1", "w2", "weight", "freq1", "freq2"]).to_batches(max_chunksize=1 << 16)


class PackedEdges(NamedTuple):
    """A network by numbers: ``words(id, word, freq)`` numbered from 0 in no order, and ``cells(i, j, lo, hi, weight, total)``.

    A cell has the edges between the words of the blocks ``i`` and ``j`` of ``width`` numbers, by their places in the
    blocks, ``w1 <= w2`` as everywhere; ``total`` is the sum of its weights. There are ``side`` blocks.
    """

    words: DataFrame
    cells: DataFrame
    width: int
    side: int


def _numbered_blocks(
    df: DataFrame, text: str, min_freq: int, cross_document_order: str | None, directed: bool = False,
) -> tuple[DataFrame, int, DataFrame, int, DataFrame]:
    """``blocks`` of texts and the number of their pairs, ``words(id, word, freq)`` and their number, ``found(block, known)``: the numbers of the words of a block.

    The words of ``directed`` blocks are numbered in their order, else in that of a hash.
    """
    lists = df.select(tx.clean_words(F.col(text)).alias("_w"), F.lit(True).alias("_counted"))
    if cross_document_order:
        across = border_bigrams(df, text, cross_document_order)
        lists = lists.unionByName(across.select(F.array("w1", "w2").alias("_w"), F.lit(False).alias("_counted")))
    blocks = materialize(lists.mapInArrow(_code(CODED_WORDS, directed), "block bigint, words array<string>, n array<bigint>, n_pairs bigint, pairs binary"))
    n_pairs = blocks.agg(F.sum("n_pairs")).first()[0] or 0
    places = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "_x")).select("block", "pos", F.col("_x.words").alias("word"), "_x.n")
    dealt = places.repartitionByRange("word") if directed else places.repartition("word")
    numbers = materialize(dealt.sortWithinPartitions("word").mapInArrow(
        _number(min_freq, CODED_WORDS), "part int, first bigint, words array<string>, freq array<bigint>, block bigint, pos array<int>, at array<bigint>",
    ))
    spelled = numbers.where("block IS NULL").select("part", "first", "words", "freq")
    sizes = spelled.groupBy("part").agg(F.sum(F.size("words")).alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the exchange by words: bounded by spark.sql.shuffle.partitions.
    offsets = F.broadcast(sizes.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before")))
    n_words = sizes.agg(F.sum("_n")).first()[0] or 0
    found = numbers.where("block IS NOT NULL").join(offsets, "part").groupBy("block").agg(F.collect_list(F.struct("before", "pos", "at")).alias("known"))
    words = spelled.join(offsets, "part").select((F.col("before") + F.col("first")).alias("_from"), F.posexplode(F.arrays_zip("words", "freq")).alias("_at", "_x"))
    return blocks, n_pairs, words.select((F.col("_from") + F.col("_at")).alias("id"), F.col("_x.words").alias("word"), "_x.freq"), n_words, found


def _known_ids(known: pa.Array, n_words: int) -> np.ndarray:
    """The numbers of the words of a block, -1 for those that have none."""
    ids = np.full(n_words, -1, np.int64)
    before, pos, at = (known.field(c) for c in ("before", "pos", "at"))
    ids[pos.flatten().to_numpy()] = np.repeat(before.to_numpy(), pc.list_value_length(pos).to_numpy()) + at.flatten().to_numpy()
    return ids


class PackedBigrams(NamedTuple):
    """Directed pairs by numbers: ``words(id, word, freq)`` numbered from 0 in their order, and ``pairs(n_words, pairs, known)``, a row
    per block of texts (:func:`numbered_pairs` reads it). A pair is in as many rows as blocks have it; there are ``n_pairs`` in all rows."""

    words: DataFrame
    pairs: DataFrame
    n_words: int
    n_pairs: int


def packed_bigrams(df: DataFrame, text: str, cross_document_order: str | None = None) -> PackedBigrams:
    """Directed counts of adjacent words by the numbers of the words, counted in blocks of texts (see :func:`packed_edges`)."""
    blocks, n_pairs, words, n_words, found = _numbered_blocks(df, text, 0, cross_document_order, directed=True)
    pairs = blocks.select("block", F.size("words").alias("n_words"), "pairs").join(found, "block")
    return PackedBigrams(words, pairs.select("n_words", "pairs", "known"), n_words, n_pairs)


def numbered_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The numbers of the two words and the counts of the pairs of each row of :class:`PackedBigrams`."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = _known_ids(batch.column("known").slice(k, 1).flatten(), batch.column("n_words")[k].as_py())
            key, n = _unpressed(batch.column("pairs")[k].as_py())
            a, b = np.divmod(key, len(ids))
            yield ids[a], ids[b], n


def packed_edges(df: DataFrame, text: str, min_freq: int = 2, cross_document_order: str | None = None) -> PackedEdges:
    """Undirected weighted edges between words of at least ``min_freq`` occurrences, packed by the numbers of the words.

    Texts are cut into blocks of words whose distinct words and pairs are counted by place. The words move once, to be
    added up and numbered (a word is in a block once, so no word is hot); a block gets the numbers of its frequent words
    back and sends the pairs of such words only, to the cells of a grid over the numbers, where they are added up.
    As words are numbered in the order of a hash, frequent ones are spread over the grid.
    """
    blocks, n_pairs, words, n_words, found = _numbered_blocks(df, text, min_freq, cross_document_order)
    side = max(math.isqrt(max(n_pairs - 1, 0) // BUCKET_PAIRS) + 1, -(-n_words // MOST_WIDTH))
    width = max(-(-n_words // side), 1)
    sent = blocks.select("block", F.size("words").alias("n_words"), "pairs").join(found, "block")
    dealt = sent.mapInArrow(_deal(width, side), "i int, j int, lo array<int>, hi array<int>, weight array<bigint>")
    sorted_cells = dealt.repartition("i", "j").sortWithinPartitions("i", "j")
    cells = sorted_cells.mapInArrow(_merge(width), "i int, j int, lo array<int>, hi array<int>, weight array<bigint>, total bigint")
    return PackedEdges(words, cells, width, side)


def frequent_edges(df: DataFrame, text: str, min_freq: int = 2, cross_document_order: str | None = None) -> DataFrame:
    """Undirected weighted edges between words of at least ``min_freq`` occurrences, with both frequencies.

    They are counted by numbers (see :func:`packed_edges`); a cell gets the words of its two blocks at the end.
    """
    packed = packed_edges(df, text, min_freq, cross_document_order)
    dealt = packed.words.select(F.floor(F.col("id") / packed.width).cast("int").alias("i"), "id", "word", "freq")
    by_block = dealt.repartition("i").sortWithinPartitions("i", "id").mapInArrow(_word_blocks, "i int, words array<string>, freq array<bigint>")
    every = F.explode(F.sequence(F.lit(0), F.lit(packed.side - 1)))
    one = by_block.select("i", every.alias("j"), F.col("words").alias("words1"), F.col("freq").alias("freqs1"))
    two = by_block.select(F.col("i").alias("j"), every.alias("i"), F.col("words").alias("words2"), F.col("freq").alias("freqs2"))
    both = packed.cells.drop("total").join(one, ["i", "j"]).join(two, ["i", "j"])
    return both.mapInArrow(_spell, "w1 string, w2 string, weight bigint, freq1 bigint, freq2 bigint")


def word_edges(df: DataFrame, text: str, min_freq: int = 2, cross_document_order: str | None = None, packed: bool = False) -> DataFrame | PackedEdges:
    """The word network: undirected weighted edges between frequent words.

    ``packed`` gives them by numbers and written once, for degrees, sizes and filters that need no row per edge.
    """
    if packed:
        found = packed_edges(df, text, min_freq, cross_document_order)
        return found._replace(cells=materialize(found.cells))
    return frequent_edges(df, text, min_freq, cross_document_order).select("w1", "w2", "weight")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("w1", "w2")).alias("word")).distinct()


# ---------------------------------------------------------------- degree and filtering

def _ends(width: int):
    """Task function over cells: how many edges each number of the two blocks has in the cell."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for block, places in (("i", "lo"), ("j", "hi")):
                    n = np.bincount(batch.column(places).slice(k, 1).flatten().to_numpy(), minlength=width).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(block).slice(k, 1), _lists([0, width], n)], names=["i", "degree"])

    return ends


def _sums(width: int):
    """Task function over rows sorted by block: the counts of a block added up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i,), rows in _stretches(batches, "i"):
            total = np.zeros(width, np.int64)
            for n in (r.column("degree").flatten().to_numpy() for r in rows):
                total += n.reshape(-1, width).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), _lists([0, width], total)], names=["i", "degree"])

    return sums


def _degree_blocks(edges: PackedEdges) -> DataFrame:
    """Degrees by blocks of numbers; zero for words without an edge."""
    ends = edges.cells.select("i", "j", "lo", "hi").mapInArrow(_ends(edges.width), "i int, degree array<int>")
    return ends.repartition("i").sortWithinPartitions("i").mapInArrow(_sums(edges.width), "i int, degree array<bigint>")


def degrees(edges: DataFrame | PackedEdges, nodes: DataFrame | None = None) -> DataFrame:
    """Degree per node; a self-loop adds two, an isolated node has zero."""
    if isinstance(edges, PackedEdges):
        counted = _degree_blocks(edges).select("i", F.posexplode("degree").alias("_at", "_one")).where("_one > 0")
        counted = counted.select((F.col("i").cast("bigint") * edges.width + F.col("_at")).alias("id"), "_one")
        ends = materialize(edges.words.join(counted, "id").select("word", "_one"))
    else:
        ends = edges.select(F.explode(F.array("w1", "w2")).alias("word"), F.lit(1).alias("_one"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("word", F.lit(0).alias("_one")))
    return ends.groupBy("word").agg(F.sum("_one").alias("degree"))


def degree_centrality(edges: DataFrame | PackedEdges, nodes: DataFrame | None = None) -> DataFrame:
    """``degree / (n - 1)``; one node alone has centrality 1."""
    deg = degrees(edges, nodes)
    n = deg.agg(F.count(F.lit(1)).alias("n")).scalar()
    return deg.withColumn("centrality", F.when(n > 1, F.col("degree") / F.nullif(n - 1, F.lit(0))).otherwise(F.lit(1.0)))


def network_size(edges: DataFrame | PackedEdges, nodes: DataFrame | None = None) -> DataFrame:
    if isinstance(edges, PackedEdges):
        linked = _degree_blocks(edges).agg(F.coalesce(F.sum(F.size(F.filter("degree", lambda n: n > 0))), F.lit(0)).alias("n_nodes"))
        n_edges, weight = F.coalesce(F.sum(F.size("lo")), F.lit(0)), F.sum("total")
        rows = edges.cells
    else:
        linked = nodes_of(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
        n_edges, weight = F.count(F.lit(1)), F.sum("weight")
        rows = edges
    n_nodes = linked if nodes is None else nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    return rows.agg(n_edges.alias("n_edges"), F.coalesce(weight, F.lit(0)).alias("total_weight")).withColumn("n_nodes", n_nodes.scalar())


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with the kept places of their two blocks: the edges between them."""
    for batch in batches:
        for k in range(batch.num_rows):
            lo, hi, weight, kept1, kept2 = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in ("lo", "hi", "weight", "kept1", "kept2"))
            both = np.flatnonzero(np.isin(lo, kept1) & np.isin(hi, kept2))
            columns = [pa.array(np.full(len(both), batch.column(c)[k].as_py(), np.int32)) for c in ("i", "j")]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x[both]) for x in (lo, hi, weight)]], names=["i", "j", "lo", "hi", "weight"])


def _between(edges: PackedEdges, kept: DataFrame) -> DataFrame:
    """The edges between the words of ``kept``, by their words."""
    numbered = materialize(edges.words.join(kept, "word").select("id", "word"))
    few = 8 * numbered.count() <= BROADCAST_BYTES
    near = lambda t: F.broadcast(t) if few else t  # the cells stay where they lie while few words are kept
    places = numbered.groupBy(F.floor(F.col("id") / edges.width).cast("int").alias("i")).agg(F.collect_list(F.pmod("id", F.lit(edges.width)).cast("int")).alias("kept1"))
    cells = edges.cells.join(near(places), "i").join(near(places.select(F.col("i").alias("j"), F.col("kept1").alias("kept2"))), "j")
    inner = cells.select("i", "j", "lo", "hi", "weight", "kept1", "kept2").mapInArrow(_inside, "i int, j int, lo int, hi int, weight bigint")
    at = lambda block, place: F.col(block).cast("bigint") * edges.width + F.col(place)
    inner = inner.select(at("i", "lo").alias("_a"), at("j", "hi").alias("_b"), "weight")
    inner = inner.join(near(numbered.select(F.col("id").alias("_a"), F.col("word").alias("w1"))), "_a")
    return inner.join(near(numbered.select(F.col("id").alias("_b"), F.col("word").alias("w2"))), "_b").select("w1", "w2", "weight")


def filter_by_centrality(edges: DataFrame | PackedEdges, threshold: float, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep nodes with degree centrality of at least ``threshold`` and the edges between them.

    Returns ``(edges, nodes)``: nodes left without edges stay in the node table.
    """
    scored = degree_centrality(edges, nodes)
    kept = scored.where(F.col("centrality") >= threshold).select("word")
    if isinstance(edges, PackedEdges):
        kept = materialize(kept)
        return _between(edges, kept), kept
    inner = edges.join(kept.withColumnRenamed("word", "w1"), "w1", "left_semi")
    inner = inner.join(kept.withColumnRenamed("word", "w2"), "w2", "left_semi")
    return inner.select("w1", "w2", "weight"), kept


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, a self-loop once."""
    forward = edges.select(F.col("w1").alias("word"), F.col("w2").alias("next"))
    return forward.unionByName(edges.where("w1 <> w2").select(F.col("w2").alias("word"), F.col("w1").alias("next")))


# ---------------------------------------------------------------- iterative centralities

def _cells(edges: DataFrame, numbered: DataFrame, width: int) -> DataFrame:
    """Both directions of every edge, a self-loop once, packed by the blocks of ``width`` words that they lead from and to.

    ``i, j`` are the blocks, ``src`` and ``dst`` the places in them; a row holds at most ``CELL_LINKS`` links.
    """
    ends = edges.select(F.explode(F.array("w1", "w2")).alias("word"))
    sized = materialize(ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_links")).join(numbered, "word"))
    total = 2 * edges.count()
    left = sized.select(F.col("word").alias("w1"), F.col("id").alias("a"), F.col("n_links").alias("n1"))
    right = sized.select(F.col("word").alias("w2"), F.col("id").alias("b"), F.col("n_links").alias("n2"))
    one = join_by_key(edges.select("w1", "w2"), left, ["w1"], "n1", total, ["w2"])
    pairs = join_by_key(one, right, ["w2"], "n2", total, ["w1"]).select("a", "b")
    both = pairs.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    at = lambda c: F.floor(F.col(c) / width).cast("int")
    place = lambda c: F.pmod(F.col(c), F.lit(width)).cast("int")
    dealt = both.select(at("a").alias("i"), at("b").alias("j"), place("a").alias("src"), place("b").alias("dst"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row() -> pd.DataFrame:
            return pd.DataFrame({"i": [cell[0]], "j": [cell[1]], "src": [np.concatenate(src)], "dst": [np.concatenate(dst)]})

        cell, src, dst, held = None, [], [], 0
        for pdf in batches:
            for name, part in pdf.groupby(["i", "j"], sort=False):
                if src and (name != cell or held >= CELL_LINKS):
                    yield row()
                    src, dst, held = [], [], 0
                cell, held = name, held + len(part)
                src.append(part["src"].to_numpy())
                dst.append(part["dst"].to_numpy())
        if src:
            yield row()

    sorted_cells = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "src", "dst")
    return sorted_cells.mapInPandas(pack, "i int, j int, src array<int>, dst array<int>")


def eigenvector(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration of (A + I) from a uniform start, unit length after every round.

    Stops when the summed change is below ``n * tolerance`` and raises after ``max_rounds``. The links are packed
    once by blocks of words; a round sends blocks of the vector to the cells that lead from them and adds up the
    blocks of sums that come back, so no round moves or sorts words or links.
    """
    every = materialize(nodes if nodes is not None else nodes_of(edges))
    n = every.count()
    if n == 0:
        return every.withColumn("eigenvector", F.lit(0.0))
    numbered = materialize(ordering.numbered(every, F.col("word"), name="id"))
    width = max(BLOCK_WORDS, -(-n // MOST_BLOCKS))
    spark = edges.sparkSession
    n_blocks = -(-n // width)
    cells = materialize(_cells(edges, numbered, width))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame({"i": [i], "x": [np.full(min(width, n - i * width), 1.0 / n)]})

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                size = min(width, n - row.j * width)
                sums = np.bincount(row.dst, np.asarray(row.x)[row.src], size)
                yield pd.DataFrame({"i": [row.j], "part": [row.i], "first": [row.src[0] * width + row.dst[0]], "x": [sums]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        # In one order, so that reruns agree; what stays in the block comes as part -1.
        group = group.sort_values(["part", "first"])
        old, total = np.asarray(group["x"].iloc[0]), np.sum(np.stack(group["x"].to_numpy()), axis=0)
        return pd.DataFrame({"i": [group["i"].iloc[0]], "x": [total], "old": [old], "squares": [float(total @ total)]})

    current = spark.range(n_blocks).mapInPandas(start, "i int, x array<double>")
    for _ in range(max_rounds):
        # The vector goes to the links where they lie while it is small; larger ones meet them by a shuffle.
        blocks = current.select("i", "x")
        sent = cells.join(F.broadcast(blocks) if 8 * n <= BROADCAST_BYTES else blocks, "i").mapInPandas(multiply, "i int, part int, first bigint, x array<double>")
        stay = current.select("i", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("first"), "x")
        raw = materialize(sent.unionByName(stay).groupBy("i").applyInPandas(add, "i int, x array<double>, old array<double>, squares double"))
        length = sum(r[1] for r in sorted(raw.select("i", "squares").collect())) ** 0.5 or 1.0
        scaled = raw.select("i", F.transform("x", lambda v: v / length).alias("x"), "old")
        gaps = scaled.select("i", F.aggregate(F.zip_with("x", "old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d).alias("gap"))
        change = sum(r[1] for r in sorted(gaps.collect()))
        current = scaled.select("i", "x")
        if change < n * tolerance:
            values = current.select("i", F.posexplode("x").alias("at", "eigenvector"))
            values = values.select((F.col("i").cast("bigint") * width + F.col("at")).alias("id"), "eigenvector")
            return numbered.join(values, "id").select("word", "eigenvector")
    raise RuntimeError(f"eigenvector centrality did not converge in {max_rounds} rounds")


def _ranges(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the links of ``rows`` one after the other, and how many each has."""
    sizes = start[rows + 1] - start[rows]
    ends = np.cumsum(sizes)
    return np.repeat(start[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


def _dependencies(start: np.ndarray, to: np.ndarray, source: int, score: np.ndarray) -> None:
    """Adds to ``score`` what the shortest paths from ``source`` owe to every other node between their ends.

    Links are read from the side that has fewer: from the last level, or from the nodes not reached yet.
    """
    n = len(start) - 1
    links = np.diff(start)
    paths = np.zeros(n)
    paths[source] = 1.0
    open_nodes = np.ones(n, bool)
    open_nodes[source] = False
    left, levels = int(links.sum() - links[source]), [np.array([source])]
    while left:
        level = levels[-1]
        if int(links[level].sum()) <= left:
            at, sizes = _ranges(start, level)
            sums = np.bincount(to[at], np.repeat(paths[level], sizes), n)
            ahead = np.flatnonzero((sums > 0) & open_nodes)
            sums = sums[ahead]
        else:
            here = np.zeros(n)
            here[level] = paths[level]
            rows = np.flatnonzero(open_nodes & (links > 0))
            at, sizes = _ranges(start, rows)
            sums = np.add.reduceat(here[to[at]], np.cumsum(sizes) - sizes)
            ahead, sums = rows[sums > 0], sums[sums > 0]
        if not len(ahead):
            break
        paths[ahead] = sums
        open_nodes[ahead] = False
        left -= int(links[ahead].sum())
        levels.append(ahead)
    credit = np.zeros(n)
    for depth in range(len(levels) - 1, 1, -1):
        level, above = levels[depth], levels[depth - 1]
        # Each node passes (1 + credit) / paths to its predecessors one level up, times their paths.
        share = (1.0 + credit[level]) / paths[level]
        if int(links[level].sum()) <= int(links[above].sum()):
            at, sizes = _ranges(start, level)
            credit[above] = np.bincount(to[at], np.repeat(share, sizes), n)[above] * paths[above]
        else:
            here = np.zeros(n)
            here[level] = share
            at, sizes = _ranges(start, above)
            credit[above] = np.add.reduceat(here[to[at]], np.cumsum(sizes) - sizes) * paths[above]
        score[above] += credit[above]


def _scores_at_once(edges: DataFrame, numbered: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """``word, credit`` of a network whose links every task can hold: each task goes from some of the sources."""
    spark = edges.sparkSession
    width = max(BLOCK_WORDS, -(-n // MOST_BLOCKS))
    cells = _cells(edges, numbered, width).toArrow()
    sizes = pc.list_value_length(cells["src"]).to_numpy()
    key, to = (np.repeat(cells[b].to_numpy().astype(np.int64) * width, sizes) + pc.list_flatten(cells[p]).to_numpy() for b, p in (("i", "src"), ("j", "dst")))
    key *= n
    key += to
    key.sort()
    start = np.searchsorted(key, np.arange(n + 1) * n)
    key %= n
    shared = spark.sparkContext.broadcast((start, key.astype(np.int32)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, some = np.zeros(n), False
        for batch in batches:
            for source in batch.column(0).to_pylist():
                some = True
                _dependencies(*shared.value, source, score)
        for i in range(-(-n // width) if some else 0):
            part = score[i * width : (i + 1) * width]
            columns = [pa.array([x], pa.int32()) for x in (i, TaskContext.get().partitionId())]
            yield pa.RecordBatch.from_arrays([*columns, _lists([0, len(part)], part)], names=["i", "part", "x"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")  # in one order, so that reruns agree
        return pd.DataFrame({"i": [group["i"].iloc[0]], "x": [np.sum(np.stack(group["x"].to_numpy()), axis=0)]})

    tasks = 4 * spark.sparkContext.defaultParallelism
    dealt = starts.join(numbered, "word").select("id").repartition(tasks, "id")
    # As many partial sums as tasks, each as long as the vector.
    summed = dealt.mapInArrow(walk, "i int, part int, x array<double>").groupBy("i").applyInPandas(add, "i int, x array<double>")
    credit = summed.select("i", F.posexplode("x").alias("_at", "credit"))
    credit = credit.select((F.col("i").cast("bigint") * width + F.col("_at")).alias("id"), "credit")
    return numbered.join(credit, "id").select("word", "credit")


def _levels(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``word, credit`` by breadth-first search from ``starts`` as tables, one level per round, and a sweep back.

    Every table is removed when it is read no more.
    """
    level = stored(starts.select("source", F.col("source").alias("word"), F.lit(1.0).alias("paths")))
    levels = [level]
    while True:
        # What a level leads to lies on it, on the one before, or ahead.
        near = level.select("source", "word")
        if len(levels) > 1:
            near = near.unionByName(levels[-2].select("source", "word"))
        ahead = level.join(links, "word").groupBy("source", F.col("next").alias("word")).agg(F.sum("paths").alias("paths"))
        level = stored(ahead.join(near, ["source", "word"], "left_anti"))
        if is_empty(level):
            discard(level)
            break
        levels.append(level)
    parts, below = [], None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth]
        credit = here.withColumn("credit", F.lit(0.0)) if below is None else here.join(below, ["source", "word"], "left").fillna(0.0, ["credit"])
        credit = stored(credit)
        parts.append(credit)
        # Each node passes (1 + credit) / paths to its predecessors one level up, times their paths.
        share = credit.select("source", F.col("word").alias("next"), ((1.0 + F.col("credit")) / F.col("paths")).alias("share"))
        below = (
            share.join(links, "next").join(levels[depth - 1], ["source", "word"])
            .groupBy("source", "word").agg(F.sum(F.col("share") * F.col("paths")).alias("credit"))
        )
    if parts:
        every = functools.reduce(DataFrame.unionByName, [p.select("word", "credit") for p in parts])
    else:
        every = starts.select(F.col("source").alias("word"), F.lit(0.0).alias("credit")).limit(0)
    summed = stored(every.groupBy("word").agg(F.sum("credit").alias("credit")))
    for table in (*levels, *parts):
        discard(table)
    return summed


def _scores_by_groups(edges: DataFrame, numbered: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """``word, credit`` of a larger network, from groups of sources whose searches have at most ``STATE_ROWS`` rows."""
    links = materialize(neighbours(edges).where("word <> next"))
    group = max(STATE_ROWS // n, 1)
    known = materialize(starts.join(numbered, "word").select(F.col("word").alias("source"), F.floor(F.col("id") / group).alias("_group")))
    total = None
    for g in range(-(-n // group)):
        mine = known.where(F.col("_group") == g).drop("_group")
        if is_empty(mine):
            continue
        part = _levels(links, mine)
        if total is not None:
            old, both = total, total.unionByName(part)
            total = stored(both.groupBy("word").agg(F.sum("credit").alias("credit")))
            discard(old)
            discard(part)
        else:
            total = part
    return starts.select("word", F.lit(0.0).alias("credit")).limit(0) if total is None else total


def betweenness(edges: DataFrame, nodes: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Shortest-path betweenness, unweighted, normalised over ordered pairs.

    A breadth-first search from every source counts shortest paths; a second sweep from the deepest level back adds
    up dependencies. Links of up to ``BROADCAST_BYTES`` go to all tasks, which share the sources; a task holds the
    links and a few vectors of the words. In larger networks groups of sources are searched as tables, one level per
    round. ``sources`` restricts the starting points (pivots); the sum is then scaled up to all nodes. The work is
    that of an exact all-pairs search: it grows with the words times the links.
    """
    every = materialize(nodes if nodes is not None else nodes_of(edges))
    n = every.count()
    starts = every.select("word") if sources is None else sources.select("word")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if sources is not None:
        scale = scale * n / max(starts.count(), 1)
    starts = starts.where("word IS NOT NULL").distinct()
    known = nodes_of(edges).unionByName(every.select("word")).unionByName(starts).where("word IS NOT NULL").distinct()
    numbered = materialize(ordering.numbered(known, F.col("word"), name="id"))
    size = numbered.count()
    linked = edges.where("w1 <> w2").select("w1", "w2")
    n_links = 2 * linked.count()
    if not n_links:
        return every.select("word", F.lit(0.0).alias("betweenness"))
    search = _scores_at_once if 4 * n_links + 8 * size <= BROADCAST_BYTES else _scores_by_groups
    summed = materialize(search(linked, numbered, starts, size))
    return every.join(summed, "word", "left").select("word", (F.coalesce("credit", F.lit(0.0)) * scale).alias("betweenness"))


def network_metrics(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Degree, betweenness and eigenvector centrality per word, highest degree first."""
    edges = materialize(edges)
    every = materialize(nodes if nodes is not None else nodes_of(edges))
    degree = degree_centrality(edges, every).select("word", F.col("centrality").alias("degree"))
    out = degree.join(betweenness(edges, every), "word").join(eigenvector(edges, every, max_rounds, tolerance), "word")
    return out.orderBy(F.desc("degree"), "word")
