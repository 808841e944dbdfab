"""Joins of a large table with a per-key table when a few keys may hold most rows."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The least number of rows of a hot key.
MIN_HOT = 2


def hot_size(total: int) -> int:
    """Rows above which a key counts as hot; fewer than 1000 keys of ``total`` rows can exceed it."""
    return max(total // 1000, MIN_HOT)


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, total: int, spread_by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row per key) that no key can overload.

    ``size`` is the per-key column with a bound of the key's rows and ``total`` their sum. A hot
    key is cut into as many salts as it holds limits' worth of rows: its rows are spread over the
    salts and its per-key row is repeated for each. Only the names of the hot keys, fewer than
    1000 by the choice of the limit, are broadcast; the sum of all salts is bounded the same way.
    The plan is the same at every size. ``per_key`` is read twice: materialise it if it is dear.
    """
    limit = hot_size(total)
    extra = [c for c in per_key.columns if c not in keys]
    taken = {c.lower() for c in (*rows.columns, *per_key.columns)}
    salt = next(name for i in count() if (name := f"_salt{i}") not in taken and f"{name}s" not in taken)
    salts = F.ceil(F.col(size) / limit).cast("int")
    hot = per_key.where(F.col(size) > limit).select(*keys, salts.alias(f"{salt}s"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.col(f"{salt}s")).cast("int")
    marked = marked.withColumn(salt, F.coalesce(spread, F.lit(0)))
    repeated = per_key.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return marked.join(repeated, [*keys, salt]).select(*rows.columns, *extra)
