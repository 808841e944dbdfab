"""Nearest neighbours by largest inner product with a vantage-point tree per shard.

Vectors are lifted by one coordinate to equal length, where the largest inner product is the least
distance, so the triangle inequality prunes: a subtree is skipped for a query when its least possible
distance is above ``factor`` times the distance of the query's last candidate. Factor 1 is exact
(within the shard, and so overall, because every shard is searched); less prunes more.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import materialize

SHARD_ROWS, QUERY_ROWS, LEAF = 2048, 2048, 64
# Shards are searched in so many families, each by one task for a block of queries.
FAMILIES = 16
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Has components, all finite and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}


class Tree:
    """Vantage-point tree over distinct vectors; equal vectors share a place with their smallest ids."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.points, self.ids, self.first = parts["points"], parts["ids"], parts["first"]
        self.order, self.nodes, self.bounds = parts["order"], parts["nodes"], parts["bounds"]
        self.top = float(parts["top"])

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, keep: int) -> dict[str, np.ndarray]:
        """``keep``: ids held of equal vectors, the smallest; more can never be among that many nearest."""
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], np.ascontiguousarray(vectors[by_id]) + 0.0
        # Number distinct vectors by their smallest id, so that equal scores order by place.
        rows = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, where, group = np.unique(rows, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(where))
        place = rank[group.ravel()]
        points = vectors[np.sort(where)]
        grouped = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[grouped], np.arange(len(points)))
        nth = np.arange(len(grouped)) - starts[place[grouped]]
        held = grouped[nth < keep]
        first = np.searchsorted(place[held], np.arange(len(points) + 1))
        norms = np.einsum("ij,ij->i", points, points)
        top = float(norms.max())
        lifted = np.hstack([points, np.sqrt(np.maximum(top - norms, 0.0))[:, None]])
        order = np.arange(len(points))
        nodes: list[list[int]] = []  # start, end, vantage point (-1: leaf), inner, outer
        bounds: list[list[float]] = []  # least and greatest distance of the inner and outer half

        def grow(start: int, end: int) -> int:
            me = len(nodes)
            nodes.append([start, end, -1, -1, -1])
            bounds.append([0.0] * 4)
            if end - start <= LEAF:
                return me
            mine = order[start:end]
            away = np.linalg.norm(lifted[mine] - lifted[mine[0]], axis=1)
            vantage = int(mine[np.argmax(away)])
            far = np.linalg.norm(lifted[mine] - lifted[vantage], axis=1)
            sort = np.argsort(far, kind="stable")
            order[start:end], far = mine[sort], far[sort]
            half = (end - start) // 2
            bounds[me] = [far[0], far[half - 1], far[half], far[-1]]
            nodes[me][2] = vantage
            nodes[me][3] = grow(start, start + half)
            nodes[me][4] = grow(start + half, end)
            return me

        grow(0, len(points))
        return {"points": points, "ids": ids[held], "first": first, "order": order, "nodes": np.array(nodes), "bounds": np.array(bounds), "top": np.array(top)}

    def search(self, queries: np.ndarray, k: int, factor: float, floor: np.ndarray) -> np.ndarray:
        """Places of the best ``k`` distinct vectors of each query (-1: none), best first.

        What scores below the query's ``floor`` need not be found.
        """
        n = len(queries)
        scores, found = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        lengths = np.einsum("ij,ij->i", queries, queries) + self.top

        def distance(score: np.ndarray, who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(lengths[who] - 2.0 * score, 0.0))

        def reachable(who: np.ndarray, least: np.ndarray) -> np.ndarray:
            last = np.maximum(scores[who, k - 1], floor[who])
            return who[least <= factor * np.where(np.isneginf(last), np.inf, distance(last, who)) + _SLACK]

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            start, end, vantage, inner, outer = self.nodes[node]
            if vantage < 0:
                mine = self.order[start:end]
                new = queries[who] @ self.points[mine].T
                better = new.max(axis=1) >= np.maximum(scores[who, k - 1], floor[who])
                who, new = who[better], new[better]
                both = np.hstack([scores[who], new])
                places = np.hstack([found[who], np.broadcast_to(mine, new.shape)])
                best = np.lexsort((places, -both), axis=1)[:, :k]
                scores[who], found[who] = np.take_along_axis(both, best, 1), np.take_along_axis(places, best, 1)
                return
            away = distance(queries[who] @ self.points[vantage], who)
            b = self.bounds[node]
            to_inner = np.maximum(0.0, np.maximum(away - b[1], b[0] - away))
            to_outer = np.maximum(0.0, np.maximum(away - b[3], b[2] - away))
            near = away - b[1] <= b[2] - away
            for child, other, first, least_here, least_there in (
                (inner, outer, near, to_inner, to_outer), (outer, inner, ~near, to_outer, to_inner)
            ):
                visit(child, reachable(who[first], least_here[first]))
                visit(other, reachable(who[first], least_there[first]))

        visit(0, np.arange(n))
        return found


def _built(keep: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(rows["vector"].tolist(), np.float64)
        parts = Tree.build(rows["vec_id"].to_numpy(np.int64), vectors, keep)
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "tree": [_pack(**parts)]})

    return build


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    blob = _pack(ids=rows["vec_id"].to_numpy(np.int64), vectors=np.array(rows["vector"].tolist(), np.float64))
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "block": [rows["block"].iloc[0]], "queries": [blob]})


class Best:
    """The nearest so far of a block of queries, over the trees that were searched."""

    def __init__(self, block: dict[str, np.ndarray], k: int):
        self.own, self.queries, self.k = block["ids"], block["vectors"], k
        self.q, self.ids, self.exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(self.own), -np.inf)

    def add(self, tree: Tree, factor: float) -> None:
        # One more than asked for: a query's own vector may be the best place.
        places = tree.search(self.queries, self.k + 1, factor, self.floor)
        q, col = np.nonzero(places >= 0)
        at = places[q, col]
        # Every id held of the places found, with the exact score of each place.
        exact = (self.queries[q] * tree.points[at]).sum(axis=1)
        sizes = tree.first[at + 1] - tree.first[at]
        row = np.repeat(np.arange(len(at)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids, q, exact = tree.ids[tree.first[at][row] + within], q[row], exact[row]
        other = ids != self.own[q]
        q, ids, exact = (np.concatenate(x) for x in ((self.q, q[other]), (self.ids, ids[other]), (self.exact, exact[other])))
        sort = np.lexsort((ids, -exact, q))
        q, ids, exact = q[sort], ids[sort], exact[sort]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        top = nth < self.k
        self.q, self.ids, self.exact, nth = q[top], ids[top], exact[top], nth[top]
        full = nth == self.k - 1
        # Less a little, since the trees add up products in another order.
        self.floor[self.q[full]] = self.exact[full] - _SLACK * (1.0 + np.abs(self.exact[full]))

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.own[self.q], "vec_id": self.ids, "score": self.exact})


def _searched(k: int, factor: float):
    """Task function over rows sorted by their key: one result for each block of queries and group of shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best = None, None
        for batch in batches:
            for key, tree, queries in zip(zip(batch["dim"], batch["family"], batch["block"]), batch["tree"], batch["queries"]):
                if key != at:
                    if best is not None:
                        yield best.rows()
                    at, best = key, Best(_unpack(queries), k)
                best.add(Tree(_unpack(tree)), factor)
        if best is not None:
            yield best.rows()

    return run


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector, dim`` of the rows that take part: one per id (of several, the least vector)."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def build_index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``dim, shard, tree``: a tree over every vector. Shards are dealt by a hash of the id, so they are even."""
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(_built(keep), "dim int, shard int, tree binary"))


def nearest(index: DataFrame, queries: DataFrame, k: int, factor: float, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of each query over all shards of an index.

    ``queries`` are vectors like those of the index. Blocks of queries meet families of shards; ``k``
    rows per query and family come back. Ties in score go to the smaller id; a query is not its own neighbour.
    Vectors of another length are no candidates. With fewer candidates than ``k`` all are
    returned; without queries or candidates nothing is.
    """
    blocks = max(1, -(-queries.count() // query_rows))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int"))
    packed = materialize(dealt.groupBy("dim", "block").applyInPandas(_packed, "dim int, block int, queries binary"))
    # A task takes one block of queries through one family of shards, a tree at a time, and returns
    # k rows a query: the families are a fixed number, so the rows returned follow the queries.
    keyed = index.withColumn("family", F.pmod("shard", F.lit(FAMILIES))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = packed.withColumn("family", F.explode(F.sequence(F.lit(0), F.lit(FAMILIES - 1))))
    key = ["dim", "family", "block"]
    pairs = keyed.join(spread, key).select(*key, "tree", "queries").sortWithinPartitions(*key)
    hits = pairs.mapInPandas(_searched(k, factor), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
