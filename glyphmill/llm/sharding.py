"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

Row number -> permuted place -> ``shard = place mod shards``, ``slot = place div shards``. Each step
has an inverse, so the shard and slot of a row, and the row of a shard and slot, are computed, not
looked up. Shard sizes differ by at most one and slots have no gaps.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.rows import apart
from glyphmill.operators.ordering import numbered

ROUNDS = 6
MASK = 0xFFFFFFFF


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Two odd 31-bit multipliers and a 31-bit addend for each round."""
    keys = []
    for r in range(ROUNDS):
        a, b, c = (int(hashlib.md5(f"{seed}|{r}|{part}".encode()).hexdigest()[:8], 16) >> 1 for part in "abc")
        keys.append((a | 1, b | 1, c))
    return keys


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced Feistel domain that holds 0 to n - 1."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


@dataclass(frozen=True)
class Permutation:
    """A seeded permutation of 0 .. n - 1 (n up to 2**62)."""

    n: int
    seed: int = 0

    def _mix(self, half: np.ndarray, key: tuple[int, int, int], bits: int) -> np.ndarray:
        a, b, c = (np.uint64(k) for k in key)
        t = (half * a + c) & np.uint64(MASK)
        t ^= t >> np.uint64(15)
        t = (t * b) & np.uint64(MASK)
        t ^= t >> np.uint64(13)
        return t >> np.uint64(32 - bits)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits = half_bits(self.n)
        left, right = x >> np.uint64(bits), x & np.uint64((1 << bits) - 1)
        keys = round_keys(self.seed)
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ self._mix(left, key, bits), left
            else:
                left, right = right, left ^ self._mix(right, key, bits)
        return (left << np.uint64(bits)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        """Apply the permutation of the whole domain until every value is below n: a cycle returns there."""
        out = self._once(np.asarray(x, dtype=np.uint64), back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def place(self, row_no: np.ndarray) -> np.ndarray:
        return self._walk(row_no, back=False)

    def row_no(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, back=True)


def place_of(row_no: Column, n: int, seed: int) -> Column:
    """Permuted place of a row number, as a column."""
    permutation = Permutation(n, seed)

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.place(numbers.to_numpy()))

    return place(row_no)


def locate(row_no: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """``(shard, slot)`` of a row number, without any table."""
    place = int(Permutation(n, seed).place(np.array([row_no]))[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies at ``slot`` of ``shard``."""
    return int(Permutation(n, seed).row_no(np.array([slot * shards + shard]))[0])


def shard_rows(df: DataFrame, order: list[Column], shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (bigint) to every row of ``df``.

    ``order`` is a total order of the rows (rows that tie in all its columns are interchangeable).
    Give the key columns only and join the payload afterwards: ``df`` is sorted once. An empty table
    gives an empty table; NULL keys sort first; columns ``shard`` and ``slot`` of ``df`` are replaced, all others stay.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    keys = {f"key{i}": k for i, k in enumerate(order)}
    held = apart(df, ["shard", "slot"], **keys)
    rows = numbered(held, *[F.col(k) for k in keys], name="_row_no")
    n = df.count()
    place = place_of(F.col("_row_no"), max(n, 1), seed)
    placed = rows.withColumn("_place", place)
    shard = F.pmod("_place", F.lit(shards)).cast("int")
    # Integer division keeps every bit; a double would not above 2**53.
    slot = F.expr(f"_place div {shards}")
    return placed.withColumns({"shard": shard, "slot": slot}).select("row.*", "shard", "slot")
