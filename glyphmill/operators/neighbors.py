"""Exact nearest neighbours and similarity blocks over vector tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 4096


def _small_matrix(df: DataFrame, id_col: str, vec: str, limit_bytes: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of ``df`` on the driver, or None when they exceed ``limit_bytes``."""
    first = df.select(F.size(vec)).first()
    if first is None:
        return np.empty(0, dtype=np.int64), np.empty((0, 1))
    most = max(limit_bytes // (8 * max(first[0], 1)), 1)
    rows = df.select(id_col, vec).limit(most + 1).collect()
    if len(rows) > most:
        return None
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)


# Queries and rows of one tile of distances.
TILE = (512, 4096)


class _Best:
    """Running k best per query over tiles of rows."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.names, self.queries, self.k = query_ids, queries, k
        self.q, self.ids, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(rows), TILE[1]):
            tile, tile_ids = rows[start : start + TILE[1]], ids[start : start + TILE[1]]
            for at in range(0, len(self.queries), TILE[0]):
                q, r = self._close(self.queries[at : at + TILE[0]], tile)
                # Differences, not products: no cancellation near zero.
                exact = np.square(tile[r] - self.queries[at + q]).sum(axis=1)
                self.q, self.ids, self.dist = np.r_[self.q, at + q], np.r_[self.ids, tile_ids[r]], np.r_[self.dist, exact]
            self._cut()

    def _close(self, queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that can be among the k best of the tile, by a matrix product with a margin for its rounding."""
        far = np.square(rows).sum(axis=1) - 2.0 * queries @ rows.T
        if len(rows) <= self.k:
            return tuple(x.ravel() for x in np.indices(far.shape))
        margin = 1e-9 * (1.0 + np.square(queries).sum(axis=1) + np.square(rows).sum(axis=1).max())
        limit = np.partition(far, self.k - 1, axis=1)[:, self.k - 1] + margin
        return np.nonzero(far <= limit[:, None])

    def _cut(self) -> None:
        order = np.lexsort((self.ids, self.dist, self.q))
        q = self.q[order]
        best = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.q, self.ids, self.dist = self.q[best], self.ids[best], self.dist[best]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.names[self.q], "id": self.ids, "distance": self.dist})


_PART = "query_id bigint, id bigint, distance double"


def knn(
    base: DataFrame, queries: DataFrame, k: int, base_id: str = "vec_id", query_id: str = "query_id",
    vec: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact ``k`` nearest base rows per query by squared L2 distance, ties by id.

    Queries within ``broadcast_bytes`` go to every task, which keeps k rows per query; larger sets
    are packed into blocks and met with the base blocks by an equi-join on block numbers.
    """
    b = base.select(F.col(base_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vec).cast("array<double>").alias("v"))
    small = _small_matrix(q, "query_id", "v", broadcast_bytes)
    if small is not None:
        shared = base.sparkSession.sparkContext.broadcast(small)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best = _Best(ids, matrix, k)
            for pdf in batches:
                if len(pdf) and len(ids):
                    best.add(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()))
            if len(best.q):
                yield best.frame()

        part = b.mapInPandas(scan, _PART)
    else:
        part = _knn_blocks(b, q, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def packed(df: DataFrame, id_col: str, vec: str, side: str, block_rows: int = BLOCK_ROWS, extra: str | None = None) -> DataFrame:
    """Rows packed into blocks ``(side, side_ids, side_flat[, side_extra])``, named by their first id."""
    slim = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"),
        (F.col(extra) if extra else F.lit(0)).cast("bigint").alias("e"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), block_rows):
                cut = pdf.iloc[at : at + block_rows]
                yield pd.DataFrame({"first": [int(cut["id"].iloc[0])], "ids": [cut["id"].to_numpy()],
                                    "flat": [np.concatenate(cut["v"].to_numpy())], "extra": [cut["e"].to_numpy()]})

    out = slim.mapInPandas(pack, "first bigint, ids array<bigint>, flat array<double>, extra array<bigint>")
    return out.toDF(side, f"{side}_ids", f"{side}_flat", f"{side}_extra")


# A squared distance below this part of the squared lengths loses digits in a product and is taken from differences.
CLOSE = 1e-6


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two blocks by a matrix product, pairs that are close by their differences."""
    sizes = np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :]
    out = sizes - 2.0 * (a @ b.T)
    # Not "<": a pair whose product is no number is looked at as well.
    r, c = np.nonzero(~(out > CLOSE * sizes))
    for at in range(0, len(r), TILE[1]):
        q, w = r[at : at + TILE[1]], c[at : at + TILE[1]]
        out[q, w] = np.square(a[q] - b[w]).sum(axis=1)
    return out


def on_grid(left: DataFrame, right: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """Blocks ``a`` in a row and blocks ``b`` in a column of a grid of about ``slots`` slots: each pair shares one ``slot``."""
    side = max(math.ceil(slots**0.5), 1)
    across, own = F.sequence(F.lit(0), F.lit(side - 1)), lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    dealt = left.withColumn("slot", F.explode(F.transform(across, lambda c: own("a") * side + c)))
    return dealt, right.withColumn("slot", F.explode(F.transform(across, lambda r: r * side + own("b"))))


def block_pairs(left: DataFrame, right: DataFrame, tile: Callable[..., pd.DataFrame | None], schema: str) -> DataFrame:
    """Run ``tile`` on every left block with every right block.

    Left blocks (side ``a``) are dealt to the rows of a grid of slots and right blocks (side ``b``) to its columns,
    so a block is copied for one row or column and not for every slot; the equi-join on the slot spreads the
    tiles evenly. ``tile`` reduces a pair of blocks to a table with at most a few rows per member, so pairs of
    rows are never written.
    """
    slots = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, visiting = on_grid(left, right, slots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a_ids, b_ids = np.asarray(row.a_ids), np.asarray(row.b_ids)
                out = tile(
                    a_ids, np.asarray(row.a_flat).reshape(len(a_ids), -1), np.asarray(row.a_extra),
                    b_ids, np.asarray(row.b_flat).reshape(len(b_ids), -1), np.asarray(row.b_extra),
                )
                if out is not None and len(out):
                    yield out

    columns = [f"{s}_{c}" for s in "ab" for c in ("ids", "flat", "extra")]
    # A set number of partitions and no broadcast: small tables are few tasks otherwise, and sizes after a checkpoint are guesses.
    tasks = dealt.repartition(max(math.ceil(slots**0.5), 1) ** 2, "slot")
    return tasks.join(visiting.hint("merge"), "slot").select(*columns).mapInPandas(run, schema)


def _knn_blocks(b: DataFrame, q: DataFrame, k: int) -> DataFrame:
    def tile(q_ids, q_vecs, _q, b_ids, b_vecs, _b):
        best = _Best(q_ids, q_vecs, k)
        best.add(b_ids, b_vecs)
        return best.frame()

    return block_pairs(packed(q, "query_id", "v", "a"), packed(b, "id", "v", "b"), tile, _PART)


def vote(neighbours: DataFrame, labels: DataFrame, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """Majority label of each query's neighbours; a tie goes to the label met first."""
    named = neighbours.join(labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")), "id")
    counted = named.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "first"))
    return counted.withColumn("_rn", best).where("_rn = 1").select("query_id", "label", "votes")


def knn_label(base: DataFrame, queries: DataFrame, k: int = 1, label: str = "label", **names: str) -> DataFrame:
    """Label new rows by the majority of their ``k`` nearest labelled rows."""
    return vote(knn(base, queries, k, **names), base, names.get("base_id", "vec_id"), label)


_SIMILARITY = "left_id bigint, right_id bigint, similarity double"


def _cosines(left_ids: np.ndarray, left: np.ndarray, right_ids: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = unit(left) @ unit(right).T
    return pd.DataFrame({"left_id": np.repeat(left_ids, len(right_ids)), "right_id": np.tile(right_ids, len(left_ids)), "similarity": sims.ravel()})


def _cosine_frames(left_ids: np.ndarray, left: np.ndarray, right_ids: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
    """The pairs in frames of 512 right rows, so that a frame does not grow with the right table."""
    for at in range(0, len(right_ids), 512):
        yield _cosines(left_ids, left, right_ids[at : at + 512], right[at : at + 512])


def similarity_matrix(left: DataFrame, right: DataFrame, id_col: str, vec: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Cosine similarity of every left row with every right row, as the caller's two tables ask for.

    A right table within ``broadcast_bytes`` goes to every task; a larger one is met block by block.
    """
    small = _small_matrix(
        right.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")), "id", "v", broadcast_bytes
    )
    if small is None:
        tile = lambda a_ids, a, _a, b_ids, b, _b: _cosines(a_ids, a, b_ids, b)
        return block_pairs(packed(left, id_col, vec, "a", 512), packed(right, id_col, vec, "b", 512), tile, _SIMILARITY)
    shared = left.sparkSession.sparkContext.broadcast(small)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = shared.value
        for pdf in batches:
            for at in range(0, len(pdf) if len(ids) else 0, 512):
                cut = pdf.iloc[at : at + 512]
                left_ids, rows = cut["left_id"].to_numpy(), np.stack(cut["v"].to_numpy())
                yield from _cosine_frames(left_ids, rows, ids, m)

    slim = left.select(F.col(id_col).cast("bigint").alias("left_id"), F.col(vec).cast("array<double>").alias("v"))
    return slim.mapInPandas(block, _SIMILARITY)
