"""SimHash near-duplicates: fingerprints, candidate blocks, pivot distance tables, components.

Pairs are compared only inside blocks of fingerprints that agree on half of their bits; within a
block, rows are sorted by their distance to a first reference fingerprint (pivot), pairs whose
distances to any of the pivots differ by more than the limit are discarded (triangle inequality),
and the survivors are verified bit by bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.rows import fresh, row_key
from glyphmill.operators.components import components
from glyphmill.operators.skew import join_by_key
from glyphmill.session import is_empty, materialize

PIVOTS = [int(hashlib.md5(f"pivot|{i}".encode()).hexdigest()[:16], 16) for i in range(16)]
# Rows of the largest block that is compared as it is; larger ones are split by more bits.
BLOCK_ROWS = 2048
_PARTS = 4


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 of all word shingles, as an unsigned 64-bit number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts, starts[shingle:])
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in pairs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """:func:`fingerprint_of` as a column (bigint with the same bits)."""

    @F.pandas_udf("bigint")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint_of(t, shingle, seed) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return prints(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _half_masks(bits: list[int]) -> list[tuple[int, list[int]]]:
    """Masks of two of four parts of ``bits``, each with the bits it leaves open.

    Fingerprints that differ in at most two bits agree on at least two of four parts.
    """
    size = len(bits) // _PARTS
    parts = [bits[i * size : (i + 1) * size] for i in range(_PARTS)]
    out = []
    for pair in combinations(range(_PARTS), 2):
        held = [b for i in pair for b in parts[i]]
        out.append((sum(1 << b for b in held), [b for b in bits if b not in held]))
    return out


def _levels(depth: int = 3) -> list[list[tuple[int, int, list[int]]]]:
    """Per level: ``(parent mask index, mask, open bits)``. At depth 3 a block has at most 256 fingerprints."""
    levels: list[list[tuple[int, int, list[int]]]] = []
    parents: list[tuple[int, list[int]]] = [(0, list(range(64)))]
    for _ in range(depth):
        level = [(p, held | mask, left) for p, (held, bits) in enumerate(parents) for mask, left in _half_masks(bits)]
        levels.append(level)
        parents = [(mask, left) for _, mask, left in level]
    return levels


def _keyed(rows: DataFrame, level: list[tuple[int, int, list[int]]], parent: Column) -> DataFrame:
    children: dict[int, list[int]] = {}
    for i, (p, _, _) in enumerate(level):
        children.setdefault(p, []).append(i)
    masks = F.array(*[F.lit(_signed(mask)) for _, mask, _ in level])
    mine = F.get(F.array(*[F.array(*[F.lit(i) for i in children[p]]) for p in sorted(children)]), parent)
    exploded = rows.select("fp", F.explode(mine).alias("mask"))
    return exploded.select("fp", "mask", F.col("fp").bitwiseAND(F.get(masks, F.col("mask"))).alias("key"))


def _links_of(fps: np.ndarray, block: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints (sorted by block and first pivot distance) within ``limit`` bits of each other."""
    pivots = np.array(PIVOTS, np.uint64)
    table = np.bitwise_count(fps[:, None] ^ pivots).astype(np.int8)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links = []
    active = np.arange(len(fps) - 1)
    step = 1
    while len(active):
        # Rows are in order of the first coordinate: once it is too far, it stays so for the row.
        near = (block[active] == block[active + step]) & (table[active + step, 0] - table[active, 0] <= limit)
        active = active[near]
        close = active[np.abs(table[active + step] - table[active]).max(axis=1, initial=0) <= limit]
        close = close[np.bitwise_count(fps[close] ^ fps[close + step]) <= limit]
        for i in close.tolist():
            a, b = root(i), root(i + step)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, i + step))
        step += 1
        active = active[active + step < len(fps)]
    return links


def _compare(limit: int):
    """Task function: links within the blocks of a partition sorted by block and first pivot distance."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def found(frame: pd.DataFrame) -> pd.DataFrame:
            fps = frame["fp"].to_numpy().view(np.uint64)
            block = frame.groupby(["mask", "key"], sort=False).ngroup().to_numpy()
            at = np.array(_links_of(fps, block, limit), np.int64).reshape(-1, 2)
            signed = fps.view(np.int64)
            return pd.DataFrame({"a": signed[at[:, 0]], "b": signed[at[:, 1]]})

        for batch in batches:
            if not len(batch):
                continue
            # The last block of a batch may go on in the next one.
            last = batch.iloc[-1]
            open_rows = (batch["mask"] == last["mask"]) & (batch["key"] == last["key"])
            if open_rows.all() and rows and (held[-1].iloc[-1][["mask", "key"]] == last[["mask", "key"]]).all():
                held.append(batch)
                rows += len(batch)
                continue
            yield found(pd.concat([*held, batch[~open_rows]]))
            held, rows = [batch[open_rows]], int(open_rows.sum())
        if rows:
            yield found(pd.concat(held))

    return links


def near_links(prints: DataFrame, limit: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints ``fp`` within ``limit`` (at most 2) bits of each other.

    Every pair within the limit is compared, and links that only close a circle inside a task are
    left out. Blocks above ``block_rows`` are split by half of their open bits, at most three times.
    """
    if not 0 <= limit <= 2:
        raise ValueError("blocks of two of four parts find up to two differing bits")
    rows, parent, links = prints.select("fp"), F.lit(0), []
    levels = _levels()
    for depth, level in enumerate(levels):
        keyed = _keyed(rows, level, parent)
        sizes = materialize(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        blocks = join_by_key(keyed, sizes, ["mask", "key"], "n", total, ["fp"])
        small = blocks if depth == len(levels) - 1 else blocks.where(F.col("n") <= block_rows)
        first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(PIVOTS[0]))))
        sorted_blocks = small.select("fp", "mask", "key", first.alias("d")).repartition("mask", "key").sortWithinPartitions("mask", "key", "d", "fp")
        links.append(materialize(sorted_blocks.mapInPandas(_compare(limit), "a bigint, b bigint")))
        rows = materialize(blocks.where(F.col("n") > block_rows).select("fp", "mask"))
        if depth == len(levels) - 1 or is_empty(rows):
            break
        parent = F.col("mask")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(prints: DataFrame, limit: int = 2) -> DataFrame:
    """``prints`` (``doc_id, fp``, any more columns) with ``component_id`` and ``group``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, ``group`` the smallest fingerprint.
    Fingerprints link at ``limit`` or fewer differing bits; equal ones always. Rows without an id
    belong to components like others, and a component without any id has a NULL ``component_id``.
    Copies are never paired: links join distinct fingerprints. An empty table gives an empty table.
    """
    prints = prints.drop("component_id", "group")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    links = near_links(distinct, limit)
    roots = materialize(components(links, "a", "b"))
    members = roots.join(distinct, roots["id"] == distinct["fp"]).select("fp", "root", "first")
    lowest = materialize(members.groupBy("root").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("m")))
    total = lowest.agg(F.sum("m")).first()[0] or 0
    grouped = join_by_key(members, lowest, ["root"], "m", total, ["fp"]).select("fp", "low", "root")
    by_print = distinct.join(grouped, "fp", "left").select(
        "fp", "n", F.coalesce("low", "first").alias("component_id"), F.coalesce("root", "fp").alias("group")
    )
    by_print = materialize(by_print)
    rows = by_print.agg(F.sum("n")).first()[0] or 0
    (size,) = fresh(prints, "_n")
    return join_by_key(prints, by_print.withColumnRenamed("n", size), ["fp"], size, rows, ["doc_id"]).drop(size)


def drop_near_duplicates(docs: DataFrame, limit: int = 2, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` (``doc_id, text``, any more columns) for each group of near duplicates.

    The row of the smallest ``doc_id`` (NULL first) stays, unchanged; of equal rows one. Texts are
    read twice, and move once, to meet the few bytes that name the rows to keep.
    """
    (row,) = fresh(docs, "_row")
    named = docs.withColumn(row, row_key(docs))
    prints = materialize(named.select("doc_id", F.col(row).alias("row"), fingerprint(F.col("text"), shingle).alias("fp")))
    keepers = near_duplicates(prints, limit).groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("keep"))
    keys = keepers.select(F.col("keep.row").alias("_key"), F.col("keep.doc_id").alias("_id"))
    same = (named[row] == keys["_key"]) & named["doc_id"].eqNullSafe(keys["_id"])
    return named.join(keys, same, "left_semi").dropDuplicates([row, "doc_id"]).select(*docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
