"""Exact and near-duplicate removal, keep-first."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.functions.hashing import MERSENNE_31, py_int31
from glyphmill.operators.skew import join_by_key
from glyphmill.session import is_empty, materialize


# ---------------------------------------------------------------- exact

def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("+"), F.col(text)), F.lit("-")), 256))


def _known(column: str) -> Column:
    """A column as text that is never NULL."""
    return F.coalesce(F.concat(F.lit("+"), F.col(column).cast("string")), F.lit("-"))


def later_copies(df: DataFrame, text: str, ord_col: str, by: list[str]) -> DataFrame:
    """``_by0.., _digest, ord`` of the rows that are not the first, in ``ord``, of their text; NULL counts as one text.

    Only digests and ``ord`` move; copies are counted before the shuffle, and a text that many
    rows share is salted. Two equal texts with an equal ``ord`` have no first one: that raises.
    """
    keys = [*[f"_by{i}" for i in range(len(by))], "_digest"]
    slim = df.select(*[_known(c).alias(k) for k, c in zip(keys, by)], _digest(text).alias("_digest"), F.col(ord_col).alias("_ord"))
    groups = slim.groupBy(*keys).agg(F.min("_ord").alias("_first"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = materialize(groups)
    total = groups.agg(F.sum("_size")).first()[0] or 0
    copies = materialize(join_by_key(slim, groups, keys, "_size", total, ["_ord"]))
    firsts = copies.where(F.col("_ord") == F.col("_first")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not is_empty(firsts.where("n > 1")):
        raise ValueError(f"{ord_col} is not unique: equal texts share one")
    return copies.where(F.col("_ord") > F.col("_first")).select(*keys, "_ord")


def drop_exact(df: DataFrame, text: str = "text", ord_col: str = "ord", by: list[str] | None = None) -> DataFrame:
    """Keep the first row, in ``ord``, of each distinct text per ``by`` group.

    The rows to drop are few, so they are what is joined. NULL in a ``by`` column is a value
    like others; ``ord`` holds no NULLs.
    """
    by = by or []
    gone = later_copies(df, text, ord_col, by).withColumnRenamed("_ord", ord_col)
    keyed = df.withColumns({f"_by{i}": _known(c) for i, c in enumerate(by)} | {"_digest": _digest(text)})
    return keyed.join(gone, gone.columns, "left_anti").select(*df.columns)


def source_overlap(df: DataFrame, text: str, source: str) -> DataFrame:
    """Number of distinct texts that each pair of sources shares.

    Texts are first counted per set of sources; pairs are formed once per distinct set.
    """
    sets = (
        df.groupBy(F.sha2(F.col(text), 256).alias("_digest"))
        .agg(F.sort_array(F.collect_set(source)).alias("_set"))
        .where(F.size("_set") > 1).groupBy("_set").agg(F.count(F.lit(1)).alias("_n"))
    )
    left = sets.select("_set", "_n", F.posexplode("_set").alias("_i", "source_a"))
    both = left.select("_n", "source_a", F.explode(F.slice("_set", F.col("_i") + 2, F.size("_set"))).alias("source_b"))
    return both.groupBy("source_a", "source_b").agg(F.sum("_n").alias("n_texts"))


# ---------------------------------------------------------------- MinHash

def permutations(num_perm: int, seed: int = 1) -> list[tuple[int, int]]:
    """The ``(a, b)`` of each hash ``(a*h + b) mod (2^31 - 1)``, derived from the seed."""
    return [
        (py_int31(f"a|{seed}|{i}") % (MERSENNE_31 - 1) + 1, py_int31(f"b|{seed}|{i}") % MERSENNE_31) for i in range(num_perm)
    ]


def best_bands(threshold: float, num_perm: int, steps: int = 1000) -> tuple[int, int]:
    """Bands and rows that minimise the mean of false-positive and false-negative area."""
    def area(b: int, r: int, lo: float, hi: float, miss: bool) -> float:
        s = np.linspace(lo, hi, steps)
        hit = 1.0 - (1.0 - s**r) ** b
        return float(np.trapezoid(1.0 - hit if miss else hit, s))

    choices = [(b, r) for b in range(1, num_perm + 1) for r in range(1, num_perm // b + 1)]
    return min(choices, key=lambda c: 0.5 * area(*c, 0.0, threshold, False) + 0.5 * area(*c, threshold, 1.0, True))


def word_runs(words: str, n: int) -> set[str]:
    """The distinct runs of ``n`` words of a text whose words are joined by single spaces."""
    w = words.split(" ") if words else []
    return {*map(" ".join, zip(*(w[k:] for k in range(n))))}


def _digests(grams: set[str]) -> np.ndarray:
    """The md5 of each n-gram as four big-endian words of 32 bits."""
    return np.frombuffer(b"".join([md5(g.encode("utf8")).digest() for g in grams]), ">u4").reshape(-1, 4)


def _signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.uint64)
    out = np.full(a.shape, MERSENNE_31, dtype=np.uint32)
    # Blocks small enough for the cache.
    for start in range(0, len(h), 512):
        block = np.multiply.outer(a, h[start : start + 512])
        block += b[:, None]
        # x mod (2^31 - 1): add the high bits to the low ones, then take off one modulus if needed. Where it is
        # not, taking it off wraps around to a large number, so the smaller of the two is the rest (without a mask).
        high = block >> np.uint64(31)
        block &= np.uint64(MERSENNE_31)
        block += high
        rest = block.astype(np.uint32)
        np.minimum(rest, rest - np.uint32(MERSENNE_31), out=rest)
        np.minimum(out, rest.min(axis=1), out=out)
    return out.astype(np.int32)


def minhash(words: Column, n: int = 3, num_perm: int = 128, seed: int = 1, named: bool = False) -> Column:
    """``signature, digest, size`` of the n-gram set of an array of words; all NULL below ``n`` words.

    ``signature`` is the MinHash signature over 31-bit hashes of the n-grams (the first digits of their md5), ``digest``
    names the set where ``named`` asks for it and ``size`` counts it. Arrow batches; one small matrix per row.
    """
    ab = permutations(num_perm, seed)

    @F.pandas_udf("signature array<int>, digest string, size int")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = np.array([x for x, _ in ab], dtype=np.uint64)
        b = np.array([y for _, y in ab], dtype=np.uint64)
        for s in batches:
            rows = []
            for joined in s:
                grams = word_runs(joined, n)
                if not grams:
                    rows.append((None, None, None))
                    continue
                bits = _digests(grams)
                name = md5(bits[np.lexsort(bits.view(np.uint64).T)].tobytes()).hexdigest() if named else None
                rows.append((_signature(bits[:, 0] & np.uint32(MERSENNE_31), a, b), name, len(grams)))
            out = pd.DataFrame(rows, columns=["signature", "digest", "size"])
            yield out.astype({"size": "Int32"})

    # Keeps a later filter on the signature from being pushed below, where everything would be computed again.
    return sign.asNondeterministic()(F.array_join(words, " "))


def signatures(
    df: DataFrame, text: str, keep: list[str | Column], n: int = 3, num_perm: int = 128, seed: int = 1, name: str = "signature"
) -> DataFrame:
    """MinHash signature of every row of at least ``n`` words, next to the ``keep`` columns. No shuffle."""
    # Blank and short rows have no n-grams and so no signature. Testing them earlier would be pushed
    # below as a second tokenisation of every text.
    signed = df.select(*keep, minhash(tx.word_tokens(F.col(text)), n, num_perm, seed).alias("_m"))
    return signed.select("*", F.col("_m.signature").alias(name)).drop("_m").where(F.col(name).isNotNull())


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """Array of ``(band, key)``; the key is the 16-byte digest of the band's signature slice."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.struct(i.alias("band"), F.unhex(F.md5(F.array_join(F.slice(signature, i * rows + 1, rows), ","))).alias("key")),
    )


def band_table(
    df: DataFrame, text: str, ord_col: str, by: list[str] | None = None,
    n: int = 3, num_perm: int = 128, threshold: float = 0.75, seed: int = 1,
) -> DataFrame:
    """One row ``(ord, [by..], band, key)`` per comparable row and band."""
    bands, rows = best_bands(threshold, num_perm)
    signed = signatures(df, text, [F.col(ord_col).alias("ord"), *(by or [])], n, num_perm, seed, "_sig")
    return signed.select("ord", *(by or []), F.inline(band_keys(F.col("_sig"), bands, rows)))


def bucket_leaders(bands: DataFrame, keys: list[str]) -> DataFrame:
    """First row and size of each bucket that more than one row falls into."""
    return bands.groupBy(*keys).agg(F.min("ord").alias("leader"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)


def candidate_links(bands: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each row that shares a bucket with an earlier row, linked to the bucket's first row.

    One link per row and bucket instead of all pairs, so a bucket of any size stays linear.
    """
    keys = keys or ["band", "key"]
    leaders = bucket_leaders(bands, keys)
    total = bands.count()
    linked = join_by_key(bands, leaders, keys, "size", total, ["ord"])
    return materialize(linked.where(F.col("ord") > F.col("leader")).select("ord", "leader").distinct())


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two shingle sets; NULL when both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.try_divide(common, F.size(a) + F.size(b) - common)


def shingle_sets(df: DataFrame, ids: DataFrame, text: str, ord_col: str, n: int = 3) -> DataFrame:
    """``ord, _s``: the shingle set of each row named in ``ids``, as 64-bit hashes."""
    wanted = df.withColumnRenamed(ord_col, "ord").join(ids, "ord", "left_semi")
    return wanted.select("ord", F.transform(tx.shingles(F.col(text), n), lambda x: F.xxhash64(x)).alias("_s"))


def link_similarity(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``ord, leader, jaccard`` of each link."""
    left = links.join(sets.withColumnRenamed("_s", "_a"), "ord")
    # The first row of a large bucket is the leader of many links.
    sizes = links.groupBy("leader").agg(F.count(F.lit(1)).alias("_n"))
    leaders = materialize(sets.withColumnRenamed("ord", "leader").withColumnRenamed("_s", "_b").join(sizes, "leader"))
    both = join_by_key(left, leaders, ["leader"], "_n", links.count(), ["ord"])
    return both.select("ord", "leader", jaccard(F.col("_a"), F.col("_b")).alias("jaccard"))


def verified_links(df: DataFrame, links: DataFrame, text: str, ord_col: str, n: int = 3) -> DataFrame:
    """True Jaccard similarity of each link's two texts; only linked texts are cut into shingles."""
    ids = materialize(links.select("ord").unionByName(links.select(F.col("leader").alias("ord"))).distinct())
    return link_similarity(shingle_sets(df, ids, text, ord_col, n), links)


# ---------------------------------------------------------------- greedy keep-first over buckets

def greedy_dropped(bands: DataFrame, keys: list[str]) -> DataFrame:
    """``ord`` of the rows that a sequential pass would drop.

    A pass in ``ord`` keeps a row unless it shares a bucket with a kept earlier row. That is the
    first maximal independent set of the collision graph, found in rounds over the buckets: an
    undecided row that comes first in all of its buckets is kept, every other row in those buckets
    is dropped. Buckets are only ever reduced to their first row, never to pairs.
    """
    # Rows alone in all of their buckets are kept at once; a row alone in one bucket ignores that bucket.
    leaders = bucket_leaders(bands, keys)
    total = bands.count()
    shared = join_by_key(bands, leaders, keys, "size", total, ["ord"]).select("ord", *keys)
    per_row = shared.groupBy("ord").agg(F.count(F.lit(1)).alias("n_buckets"))
    open_rows = materialize(shared.join(per_row, "ord"))
    dropped = []
    # Every round decides at least the first open row.
    while not is_empty(open_rows):
        firsts = open_rows.groupBy(*keys).agg(
            F.min(F.struct("ord", "n_buckets")).alias("_first"), F.count(F.lit(1)).alias("size")
        ).select(*keys, F.col("_first.ord").alias("leader"), F.col("_first.n_buckets").alias("need"), "size")
        firsts = materialize(firsts)
        kept = firsts.groupBy("leader", "need").agg(F.count(F.lit(1)).alias("led")).where(F.col("led") == F.col("need"))
        taken = firsts.join(kept.select("leader"), "leader", "left_semi").select(*keys, "leader", "size")
        hit = join_by_key(open_rows, taken, keys, "size", total, ["ord"])
        decided = materialize(hit.groupBy("ord").agg(F.max(F.col("ord") != F.col("leader")).alias("is_drop")))
        dropped.append(decided.where("is_drop").select("ord"))
        open_rows = materialize(open_rows.join(decided.select("ord"), "ord", "left_anti"))
    return _union(dropped, bands)


def _union(parts: list[DataFrame], bands: DataFrame) -> DataFrame:
    if not parts:
        return bands.select("ord").limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_near(
    df: DataFrame, text: str = "text", ord_col: str = "ord", by: list[str] | None = None,
    n: int = 3, num_perm: int = 128, threshold: float = 0.75, seed: int = 1, keep_short: bool = False,
) -> DataFrame:
    """Near-duplicate removal, keep-first, by buckets alone; :func:`near_pairs.drop_verified` asks for true similarity.

    ``by`` keeps separate indexes (for example per split); without it one index serves all rows in
    ``ord``. Blank rows and rows of fewer than ``n`` words are dropped unless ``keep_short``.
    """
    by = by or []
    bands = materialize(band_table(df, text, ord_col, by, n, num_perm, threshold, seed))
    keys = [*by, "band", "key"]
    dropped = greedy_dropped(bands, keys)
    if keep_short:
        return df.join(dropped.withColumnRenamed("ord", ord_col), ord_col, "left_anti").select(*df.columns)
    # Every comparable row has exactly one entry in band 0.
    kept = bands.where("band = 0").select("ord").join(dropped, "ord", "left_anti").withColumnRenamed("ord", ord_col)
    return df.join(kept, ord_col, "left_semi").select(*df.columns)
