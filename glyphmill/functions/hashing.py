"""Deterministic draws: every random choice is a hash of (seed, stable id, counter)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MERSENNE_31 = 2_147_483_647
TWO_31 = 2_147_483_648.0


def int31(value: Column) -> Column:
    """31-bit integer from the first 8 hex digits of the md5 of ``value``."""
    digits = F.conv(F.substring(F.md5(value), 1, 8), 16, 10)
    return digits.cast("bigint").bitwiseAND(F.lit(MERSENNE_31))


def draw(seed: int, *keys: Column) -> Column:
    """31-bit integer drawn for the given keys; the same on any partitioning."""
    return int31(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform double in [0, 1) drawn for the given keys."""
    return draw(seed, *keys) / F.lit(TWO_31)


def py_int31(value: str) -> int:
    """Plain-Python twin of :func:`int31`, for plan-time constants."""
    return int(hashlib.md5(value.encode("utf8")).hexdigest()[:8], 16) & MERSENNE_31
