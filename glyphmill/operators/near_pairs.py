"""Near-duplicate pairs verified by true Jaccard similarity, and keep-first removal over them.

Rows with equal shingle sets are one class and are never paired. Class representatives meet in the
buckets of many short bands (verification removes the chance hits). A bucket of any size is cut into
blocks by a hash and the pairs of blocks are dealt to tasks; a task compares what the size filter
leaves, and only pairs that reach the threshold leave it. A pair that shares several buckets is
compared in the first one alone; who has such a pair in a bucket is found by the bucket hashes before any set moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators.dedup import _known, _union, minhash, shingle_sets
from glyphmill.operators.skew import join_by_key
from glyphmill.session import is_empty, materialize

# Of pairs at similarity 0.8 (0.75) these bands let 5 in 100,000 (1 in 1,000) pass unseen.
BANDS, ROWS = 25, 5
# What names a pair of blocks of a bucket.
UNIT = ["band", "key", "i", "j"]
# Rows and shingles of a block, so that two blocks fit a task whatever the length of the texts.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20


def bucket_hashes(signature: Column, group: list[str], bands: int = BANDS, rows: int = ROWS) -> Column:
    """One 64-bit hash per band of a signature; an accidental equality is only one more pair to verify."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(i, F.slice(signature, i * rows + 1, rows), *[F.col(g) for g in group]),
    )


def set_classes(
    df: DataFrame, text: str, ord_col: str, by: list[str] | None = None, n: int = 3,
    num_perm: int = 128, seed: int = 1, bands: int = BANDS, rows: int = ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``members(ord, class)`` and ``classes(class, rep, n_rows, size, keys)`` of all rows of ``n`` words or more.

    A class holds the rows of one shingle set (per ``by`` group); ``rep`` is its first row in ``ord``,
    ``size`` the number of its shingles and ``keys`` its bucket hashes. Rows without shingles are in no class.
    """
    group = [f"_by{i}" for i in range(len(by or []))]
    signed = df.select(
        F.col(ord_col).alias("ord"), *[_known(c).alias(g) for g, c in zip(group, by or [])],
        minhash(tx.word_tokens(F.col(text)), n, num_perm, seed, named=True).alias("_m"),
    ).select("ord", *group, "_m.*").where("signature IS NOT NULL")
    named = F.md5(F.concat_ws("\n", "digest", *group)) if group else F.col("digest")
    signed = signed.select("ord", *group, named.alias("class"), "size", F.col("signature").alias("_sig"))
    rows_of = materialize(signed.select("ord", "class", "size", bucket_hashes(F.col("_sig"), group, bands, rows).alias("keys")))
    first = F.min_by(F.struct("ord", "size", "keys"), "ord")
    classes = rows_of.groupBy("class").agg(first.alias("_f"), F.count(F.lit(1)).alias("n_rows"))
    return rows_of.select("ord", "class"), classes.select("class", F.col("_f.ord").alias("rep"), "n_rows", F.col("_f.size").alias("size"), F.col("_f.keys").alias("keys"))


def block_entries(classes: DataFrame, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``class, size, keys, band, key, i, j, side``: every class in every pair of blocks of its shared buckets.

    A bucket has as many blocks as its rows and shingles ask for. Each class goes to one block by a
    hash and with it to the pairs of that block with all blocks of the bucket, itself included.
    """
    placed = classes.select("class", "size", "keys", F.posexplode("keys").alias("band", "key"))
    buckets = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_all")).where("_n > 1")
    buckets = materialize(buckets.select("band", "key", "_n", F.greatest(F.ceil(F.col("_n") / block_rows), F.ceil(F.col("_all") / block_shingles)).cast("int").alias("_g")))
    total = buckets.agg(F.sum("_n")).first()[0] or 0
    met = join_by_key(placed, buckets, ["band", "key"], "_n", total, ["class"])
    mine = F.pmod(F.xxhash64("class"), F.col("_g")).cast("int")
    dealt = met.withColumn("side", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return dealt.select("class", "size", "keys", "band", "key", F.least("side", "_o").alias("i"), F.greatest("side", "_o").alias("j"), "side")


def whole_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block pair as frames of whole block pairs: one that goes on in the next batch waits for it."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        unit = batch[UNIT].to_numpy(np.int64)
        before = np.flatnonzero((unit != unit[-1]).any(axis=1))
        start = int(before[-1]) + 1 if len(before) else 0
        goes_on = bool(held) and bool((held[-1][UNIT].iloc[-1].to_numpy(np.int64) == unit[0]).all())
        if start == 0 and goes_on:
            held.append(batch)
            continue
        done = [*held, batch.iloc[:start]] if start else held
        if done:
            yield pd.concat(done, ignore_index=True)
        held = [batch.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def met_here(frame: pd.DataFrame, threshold: float) -> np.ndarray:
    """Mask of the rows that have somebody to be compared with in their block pair.

    That is a row of the other block (of the same one, where a block is paired with itself) whose size allows the
    ``threshold`` and that shares no earlier bucket. All block pairs of the frame are gone over at once, by distance.
    """
    unit = frame[UNIT].to_numpy(np.int64)
    number = np.concatenate([[0], np.cumsum((unit[1:] != unit[:-1]).any(axis=1))])
    order = np.lexsort((frame["size"].to_numpy(), number))
    number, size, side = number[order], frame["size"].to_numpy()[order], frame["side"].to_numpy()[order]
    band, inside = frame["band"].to_numpy()[order], (frame["i"] == frame["j"]).to_numpy()[order]
    keys = np.stack(frame["keys"].to_numpy())[order]
    most = np.floor(size / threshold + 1e-9)
    needed = np.zeros(len(frame), bool)
    at, step = np.arange(len(frame)), 1
    while len(at := at[at + step < len(frame)]):
        # Sizes ascend within a block pair: whoever is too small for this partner is so for all later ones.
        at = at[(number[at] == number[at + step]) & (size[at + step] <= most[at])]
        pairs = at[~(needed[at] & needed[at + step]) & (inside[at] | (side[at] != side[at + step]))]
        if len(pairs):
            earlier = np.arange(keys.shape[1]) < band[pairs, None]
            pairs = pairs[~((keys[pairs] == keys[pairs + step]) & earlier).any(axis=1)]
            needed[pairs] = needed[pairs + step] = True
        step += 1
    out = np.empty(len(frame), bool)
    out[order] = needed
    return out


def block_pairs(
    names: np.ndarray, sizes: np.ndarray, side: np.ndarray, earlier: np.ndarray, sets: list[np.ndarray], inside: bool, threshold: float,
) -> list[tuple[str, str, float]]:
    """Pairs of one pair of blocks that reach ``threshold`` and share no earlier bucket; rows ascend by size."""
    entries, where = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(entries), np.int32)
    found: list[tuple[str, str, float]] = []
    # Similarity is at most the ratio of the sizes, so the partners of a row are the next ones up to a size.
    ends = np.searchsorted(sizes, np.floor(sizes / threshold + 1e-9), side="right")
    for a in range(len(sizes) - 1):
        b = int(ends[a])
        if b <= a + 1:
            continue
        mine = where[starts[a] : starts[a + 1]]
        marked[mine] = 1
        lo, hi = starts[a + 1], starts[b]
        common = np.add.reduceat(marked[where[lo:hi]], starts[a + 1 : b] - lo)
        marked[mine] = 0
        similar = common / (sizes[a] + sizes[a + 1 : b] - common)
        good = similar >= threshold
        if not inside:
            good &= side[a + 1 : b] != side[a]
        for k in np.flatnonzero(good):
            other = a + 1 + int(k)
            if not (earlier[a] == earlier[other]).any():
                found.append((names[a], names[other], float(similar[k])))
    return found


def _needed(threshold: float):
    """Task function over rows sorted by block pair: the rows that have somebody to be compared with."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_units(batches):
            yield frame[met_here(frame, threshold)]

    return rows


def _compare(threshold: float):
    """Task function over rows sorted by block pair: the pairs that reach the threshold."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_units(batches):
            unit = frame[UNIT].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1), len(frame)]
            names, sizes, sides, sets = (frame[c].to_numpy() for c in ("class", "size", "side", "_s"))
            keys = np.stack(frame["keys"].to_numpy())
            found: list[tuple[str, str, float]] = []
            for lo, hi in zip(cuts, cuts[1:]):
                rows = lo + np.argsort(sizes[lo:hi], kind="stable")
                band, _, i, j = unit[lo]
                found += block_pairs(names[rows], sizes[rows], sides[rows], keys[rows, :band], list(sets[rows]), i == j, threshold)
            yield pd.DataFrame(found, columns=["a", "b", "jaccard"])

    return pairs


def class_pairs(
    df: DataFrame, classes: DataFrame, text: str, ord_col: str, threshold: float, n: int = 3,
    block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``a, b, jaccard`` of the class pairs that share a bucket and reach ``threshold`` (above 0), each once.

    Only texts of representatives in shared buckets are read again and cut into shingles.
    """
    if threshold <= 0:
        raise ValueError("the threshold is above 0: at 0 every pair of a bucket would be listed")
    # Near copies share most of their buckets and meet in the first alone, so the sets go only where a pair is compared.
    entries = block_entries(classes, block_rows, block_shingles)
    entries = materialize(entries.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInPandas(_needed(threshold), entries.schema))
    wanted = classes.join(entries.select("class").distinct(), "class", "left_semi").select("class", F.col("rep").alias("ord"))
    sets = materialize(shingle_sets(df, wanted.select("ord"), text, ord_col, n).join(wanted, "ord").select("class", "_s"))
    sorted_units = entries.join(sets, "class").repartition(*UNIT).sortWithinPartitions(*UNIT)
    return materialize(sorted_units.mapInPandas(_compare(threshold), "a string, b string, jaccard double"))


def verified_pairs(
    df: DataFrame, text: str, ord_col: str, threshold: float = 0.75, by: list[str] | None = None, n: int = 3, **limits: int,
) -> tuple[DataFrame, DataFrame]:
    """``pairs(later, earlier, jaccard)`` of representatives and ``membership(ord, rep, n_links)`` of all rows.

    ``n_links`` counts the other classes that a row's class is linked to. Copies are not expanded:
    the pairs and the membership together hold every link between different texts.
    """
    members, classes = set_classes(df, text, ord_col, by, n)
    classes = materialize(classes)
    linked = class_pairs(df, classes, text, ord_col, threshold, n, **limits)
    reps = classes.select("class", "rep")
    pairs = linked.join(reps.toDF("a", "_ra"), "a").join(reps.toDF("b", "_rb"), "b")
    pairs = materialize(pairs.select(F.greatest("_ra", "_rb").alias("later"), F.least("_ra", "_rb").alias("earlier"), "jaccard"))
    ends = pairs.select(F.explode(F.array("later", "earlier")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    counted = materialize(classes.join(ends, "rep", "left").select("class", "rep", "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    # A class of very many copies is salted.
    total = counted.agg(F.sum("n_rows")).first()[0] or 0
    return pairs, join_by_key(members, counted, ["class"], "n_rows", total, ["ord"]).select("ord", "rep", "n_links")


def first_kept(pairs: DataFrame) -> DataFrame:
    """``ord`` of the representatives that a sequential pass over ``pairs(later, earlier)`` drops.

    A row is kept unless it is linked to an earlier kept row. A row decides as soon as all its earlier
    neighbours have: what has none left is kept and drops its later neighbours, whose links then count
    no more. The rounds are at most the links of the longest chain of rows that wait for one another.
    """
    open_links = pairs.select("later", "earlier")
    dropped: list[DataFrame] = []
    while not is_empty(open_links):
        total = open_links.count()
        sizes = open_links.groupBy("earlier").agg(F.count(F.lit(1)).alias("_n"))
        waiting = open_links.select(F.col("later").alias("earlier")).distinct()
        kept = materialize(sizes.join(waiting, "earlier", "left_anti"))
        gone = materialize(join_by_key(open_links, kept, ["earlier"], "_n", total, ["later"]).select(F.col("later").alias("ord")).distinct())
        dropped.append(gone)
        # Links of dropped rows decide nothing any more, on either end.
        rest = open_links.join(gone.withColumnRenamed("ord", "later"), "later", "left_anti")
        open_links = materialize(rest.join(gone.withColumnRenamed("ord", "earlier"), "earlier", "left_anti"))
    return _union(dropped, pairs.select(F.col("later").alias("ord")))


def drop_verified(
    df: DataFrame, text: str = "text", ord_col: str = "ord", by: list[str] | None = None, n: int = 3,
    threshold: float = 0.75, keep_short: bool = False,
) -> DataFrame:
    """Keep-first removal by true similarity: a row goes if it reaches ``threshold`` with an earlier kept row.

    Rows of one shingle set leave their first one, and rows of fewer than ``n`` words go unless
    ``keep_short``. Few rows leave, so they are what meets the texts.
    """
    pairs, membership = verified_pairs(df, text, ord_col, threshold, by, n)
    membership = materialize(membership)
    gone = first_kept(pairs).unionByName(membership.where(F.col("ord") > F.col("rep")).select("ord")).distinct()
    kept = df.join(gone.withColumnRenamed("ord", ord_col), ord_col, "left_anti").select(*df.columns)
    return kept if keep_short else kept.where(F.size(tx.word_tokens(F.col(text))) >= n)
