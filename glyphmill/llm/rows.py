"""Running totals in a global order, and a few expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.ordering import in_order

# The ASCII white space that separates words, and a run of anything else.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add exclusive running totals of the columns ``sums`` (new name -> column) in the global ``order``."""
    placed = in_order(df, *order)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums])
    local = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()})
    joined = own.join(F.broadcast(offsets), "_part")
    added = joined.withColumns({n: F.col(f"_own_{n}") + F.col(f"_off_{n}") for n in sums})
    return added.drop("_part", "_at", *[f"_{k}_{n}" for n in sums for k in ("own", "off")])


def apart(df: DataFrame, without: list[str], **keys: Column) -> DataFrame:
    """``row`` (the columns of ``df`` but ``without``, in one struct) next to the named keys, so that no name of ``df`` can clash."""
    held = [F.col(f"`{c}`") for c in df.columns if c.lower() not in without]
    return df.select(F.struct(*held).alias("row"), *[k.alias(name) for name, k in keys.items()])


def words(text: Column) -> Column:
    """Words of a text between ASCII white space; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    # Plain ASCII, the most of it, takes the faster general way.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(_translated(text))


def _translated(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(df: DataFrame) -> Column:
    """64-bit hash of all columns: with the id, it names a row up to equal rows. Maps are hashed as JSON."""
    plain = [F.to_json(F.struct(c)) if kind.startswith(("map", "variant")) or "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(*plain)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that ``df`` does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out
