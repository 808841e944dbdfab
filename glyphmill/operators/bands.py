"""Pairs of vectors within eps, compared only where their distances to a few pivots allow it."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import vectors as vec_fn
from glyphmill.functions.hashing import draw
from glyphmill.operators.neighbors import BLOCK_ROWS
from glyphmill.operators.skew import hot_size
from glyphmill.session import materialize

# Rows that pivots are chosen from; the choice decides the work, never the result.
PIVOT_ROWS = 256
# Shares that the block pairs are cut into at least, and block pairs of a share at least.
TASKS, LEAST = 64, 16

Tile = Callable[..., "pd.DataFrame | None"]


def choose_pivots(rows: DataFrame, n: int, seed: int = 1998) -> np.ndarray:
    """``n`` vectors far from each other among the ``PIVOT_ROWS`` rows of the smallest draws."""
    drawn = [r[0] for r in rows.orderBy(draw(seed, F.col("id")), "id").select("v").limit(PIVOT_ROWS).collect()]
    if not drawn:
        return np.empty((0, 0))
    pool = np.array(drawn, dtype=float)
    picked = [int(np.square(pool - pool.mean(axis=0)).sum(axis=1).argmax())]
    while len(picked) < min(n, len(pool)):
        gap = np.min([np.square(pool - pool[i]).sum(axis=1) for i in picked], axis=0)
        picked.append(int(gap.argmax()))
    return pool[picked]


class Bands:
    """Cells of rows by ``floor(distance to a pivot / eps)`` for each pivot.

    By the triangle inequality two rows within eps differ by at most one band on every pivot, so a row
    meets its own and the neighbouring cells and no others. The width has a margin for rounding.
    """

    def __init__(self, rows: DataFrame, eps: float, pivots: int = 3, block_rows: int = BLOCK_ROWS) -> None:
        self.pivots, self.width, self.block_rows = choose_pivots(rows, pivots), eps * (1 + 1e-9), block_rows
        self.names = [f"band{i}" for i in range(len(self.pivots))]

    def placed(self, rows: DataFrame) -> DataFrame:
        """``id, v, e`` with the bands of each row."""
        constant = lambda p: F.split(F.lit(",".join(repr(float(x)) for x in p)), ",").cast("array<double>")
        far = [F.sqrt(vec_fn.squared_l2(F.col("v"), constant(p))) for p in self.pivots]
        return rows.select("id", "v", "e", *[F.floor(d / self.width).cast("bigint").alias(c) for c, d in zip(self.names, far)])

    def blocks(self, rows: DataFrame, side: str) -> DataFrame:
        """Placed rows packed by cell into blocks of at most ``block_rows``; the cell's bands stay columns.

        The rows of a cell are brought together, those of a hot cell over several tasks.
        """
        placed = rows.select("id", "v", "e", *self.names)
        sizes = placed.groupBy(*self.names).agg(F.count(F.lit(1)).alias("n"))
        limit = max(hot_size(placed.count()), self.block_rows)
        hot = F.broadcast(sizes.where(F.col("n") > limit).select(*self.names, F.ceil(F.col("n") / limit).cast("int").alias("salts")))
        salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))
        dealt = placed.join(hot, self.names, "left").withColumn("salt", salt).drop("salts")
        dealt = dealt.repartition(*self.names, "salt").sortWithinPartitions(*self.names)
        names, most = self.names, self.block_rows

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for cell, group in pdf.groupby(names, sort=False):
                    for at in range(0, len(group), most):
                        cut = group.iloc[at : at + most]
                        yield pd.DataFrame({**{c: [int(b)] for c, b in zip(names, cell)}, "first": [int(cut["id"].iloc[0])],
                                            "ids": [cut["id"].to_numpy()], "flat": [np.concatenate(cut["v"].to_numpy())], "extra": [cut["e"].to_numpy()]})

        cells = ", ".join(f"{c} bigint" for c in names)
        flat = rows.schema["v"].dataType.simpleString()
        packed = dealt.mapInPandas(pack, f"{cells}, first bigint, ids array<bigint>, flat {flat}, extra array<bigint>")
        return packed.toDF(*names, *[f"{side}_{c}" for c in ("first", "ids", "flat", "extra")])

    def meetings(self, left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
        """Blocks of placed rows: every left block next to every right block of its own and the neighbouring cells.

        ``once``, for rows that meet themselves, gives two blocks in one order only, the one with the smaller first id first;
        blocks with the same first id (one block, or copies of an id) still meet both ways.

        Within a hot cell the left blocks are dealt to rows and the right blocks to columns of a grid, so
        that no task meets all of them; fewer cells are hot than there are shares.
        """
        a = materialize(self.blocks(left, "a"))
        same = [*self.names, *[f"b_{c}" for c in ("first", "ids", "flat", "extra")]]
        b = a.toDF(*same) if left is right else materialize(self.blocks(right, "b"))
        steps = F.array(*[F.struct(*[F.lit(s).alias(c) for c, s in zip(self.names, step)]) for step in itertools.product((-1, 0, 1), repeat=len(self.names))])
        kept = [c for c in b.columns if c not in self.names]
        visiting = b.withColumn("step", F.explode(steps))
        visiting = visiting.select(*[(F.col(c) + F.col(f"step.{c}")).alias(c) for c in self.names], *kept)
        # Most neighbouring cells of clustered rows are empty; what would visit those is not sent.
        visiting = visiting.join(a.select(*self.names).distinct(), self.names, "left_semi")

        def sizes(blocks: DataFrame, side: str) -> DataFrame:
            return blocks.groupBy(*self.names).agg(F.count(F.lit(1)).alias(f"n_{side}"))

        # A cell with more than its share of the block pairs is cut into a grid, in the proportion of its two sides, so that few copies are sent.
        work = sizes(a, "a").join(sizes(visiting.drop("b_ids", "b_flat", "b_extra"), "b"), self.names).withColumn("work", F.col("n_a") * F.col("n_b"))
        work = materialize(work)
        share = max((work.agg(F.sum("work")).first()[0] or 0) // max(TASKS, 4 * a.sparkSession.sparkContext.defaultParallelism), LEAST)
        slots = F.ceil(F.col("work") / share)
        hot = work.where(F.col("work") > share).withColumn("a_slots", F.ceil(F.sqrt(slots * F.col("n_a") / F.col("n_b"))).cast("int"))
        hot = F.broadcast(hot.select(*self.names, "a_slots", F.ceil(slots / F.col("a_slots")).cast("int").alias("b_slots")))

        def dealt(blocks: DataFrame, own: str, other: str) -> DataFrame:
            both = blocks.join(hot, self.names, "left")
            mine = F.coalesce(F.pmod(F.xxhash64(f"{own}_first"), F.col(f"{own}_slots")).cast("int"), F.lit(0))
            every = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_slots", F.lit(1)) - 1))
            return both.withColumn(f"{own}_slot", mine).withColumn(f"{other}_slot", every).drop("a_slots", "b_slots")

        pairs = dealt(a, "a", "b").join(dealt(visiting, "b", "a"), [*self.names, "a_slot", "b_slot"])
        if once:
            pairs = pairs.where("a_first <= b_first")
        return pairs.select(*[f"{s}_{c}" for s in "ab" for c in ("ids", "flat", "extra")])

    def run(self, left: DataFrame, right: DataFrame, tile: Tile, schema: str, once: bool = False) -> DataFrame:
        """``tile`` on every pair of blocks that :meth:`meetings` brings together; its tables as one."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    a_ids, b_ids = np.asarray(row.a_ids), np.asarray(row.b_ids)
                    out = tile(
                        a_ids, np.asarray(row.a_flat, dtype=float).reshape(len(a_ids), -1), np.asarray(row.a_extra),
                        b_ids, np.asarray(row.b_flat, dtype=float).reshape(len(b_ids), -1), np.asarray(row.b_extra),
                    )
                    if out is not None and len(out):
                        yield out

        return self.meetings(left, right, once).mapInPandas(each, schema)
