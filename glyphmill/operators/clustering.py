"""Density clustering of projected points, cluster tables and cluster quality."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.hashing import draw
from glyphmill.operators.bands import Bands
from glyphmill.operators.components import components
from glyphmill.operators.neighbors import BLOCK_ROWS, TILE, block_pairs, packed, squared_distances
from glyphmill.operators.ordering import row_index
from glyphmill.operators.skew import join_by_key
from glyphmill.session import is_empty, materialize

NOISE = -1


# ---------------------------------------------------------------- DBSCAN on a grid

class _Grid:
    """Cells whose diagonal is just below eps: two points of one cell are always neighbours."""

    def __init__(self, dims: list[str], eps: float) -> None:
        if not 1 <= len(dims) <= 3:
            raise ValueError("the grid serves 1 to 3 dimensions; project the vectors first")
        if eps <= 0:
            raise ValueError("eps must be positive")
        self.dims, self.eps = dims, eps
        self.side = eps / math.sqrt(len(dims)) * (1 - 1e-9)
        self.cell = [f"c{i}" for i in range(len(dims))]
        reach = math.floor(eps / self.side) + 1
        steps = itertools.product(range(-reach, reach + 1), repeat=len(dims))
        gap = lambda o: math.sqrt(sum((max(abs(k) - 1, 0) * self.side) ** 2 for k in o))
        self.offsets = [o for o in steps if gap(o) <= eps * (1 + 1e-9)]

    def cells(self) -> list[Column]:
        return [F.floor(F.col(d) / self.side).alias(c) for d, c in zip(self.dims, self.cell)]

    def around(self, df: DataFrame, keep: list[str], forward_only: bool = False) -> DataFrame:
        """One row per row and neighbouring cell (``forward_only``: each unordered pair of cells once)."""
        origin = tuple([0] * len(self.dims))
        offsets = [o for o in self.offsets if not forward_only or o > origin]
        options = F.array(*[F.struct(*[F.lit(k).alias(f"o{i}") for i, k in enumerate(o)]) for o in offsets])
        out = df.withColumn("_o", F.explode(options))
        return out.select(*keep, *[(F.col(c) + F.col(f"_o.o{i}")).alias(c) for i, c in enumerate(self.cell)])

    def near(self, left: str, right: str) -> Column:
        parts = [(F.col(f"{left}{d}") - F.col(f"{right}{d}")) ** 2 for d in self.dims]
        return reduce(lambda x, y: x + y, parts) <= self.eps * self.eps


def _probe_cells(grid: _Grid, probes: DataFrame) -> DataFrame:
    """Per cell, the probes that can reach it. Probes sit in cells of fewer than ``min_samples``
    points, so a cell's list is bounded by ``min_samples`` times the number of neighbour cells."""
    spread = grid.around(probes, ["site", *grid.dims])
    item = F.struct(F.col("site").alias("probe"), *[F.col(d).alias(f"p_{d}") for d in grid.dims])
    return spread.groupBy(*grid.cell).agg(F.collect_list(item).alias("probes"))


def _meet(grid: _Grid, sites: DataFrame, probes: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """Sites next to the probes within eps of them, from the sites' side so that a full cell is spread."""
    per_cell = _probe_cells(grid, probes).join(sizes, grid.cell)
    met = join_by_key(sites, per_cell, grid.cell, "cell_points", total, ["site"])
    opened = met.select(*sites.columns, F.inline("probes"))
    return opened.where(grid.near("", "p_"))


def density_sites(points: DataFrame, id_col: str, dims: list[str], eps: float, min_samples: int) -> DataFrame:
    """Distinct places with their weight, cell and whether they are core.

    A cell of ``min_samples`` points is all core without comparing anything; only points of
    emptier cells look around.
    """
    grid = _Grid(dims, eps)
    place = [(F.col(d).cast("double") + 0.0).alias(d) for d in dims]
    sites = points.select(F.col(id_col).cast("bigint").alias("_id"), *place).groupBy(*dims).agg(
        F.min("_id").alias("site"), F.count(F.lit(1)).alias("weight")
    )
    sites = materialize(sites.select("site", "weight", *dims, *grid.cells()))
    total = sites.agg(F.sum("weight")).first()[0] or 0
    sizes = materialize(sites.groupBy(*grid.cell).agg(F.sum("weight").alias("cell_points")))
    sized = join_by_key(sites, sizes, grid.cell, "cell_points", total, ["site"])
    sparse = sized.where(F.col("cell_points") < min_samples)
    counted = _meet(grid, sites, sparse, sizes, total).groupBy(F.col("probe").alias("site")).agg(F.sum("weight").alias("_near"))
    lonely = sparse.join(counted, "site").withColumn("is_core", F.col("_near") >= min_samples).drop("_near")
    dense = sized.where(F.col("cell_points") >= min_samples).withColumn("is_core", F.lit(True))
    return materialize(dense.unionByName(lonely))


def core_points(points: DataFrame, id_col: str, dims: list[str], eps: float, min_samples: int) -> DataFrame:
    """``(id, is_core)``: whether a point has ``min_samples`` points, itself included, within eps."""
    sites = density_sites(points, id_col, dims, eps, min_samples).select(*dims, "weight", "is_core")
    total = sites.agg(F.sum("weight")).first()[0] or 0
    ids = points.select(F.col(id_col), *[(F.col(d).cast("double") + 0.0).alias(d) for d in dims])
    return join_by_key(ids, sites, dims, "weight", total, [id_col]).select(id_col, "is_core")


def _boxes(grid: _Grid, core: DataFrame, level: int) -> DataFrame:
    """Occupied sub-boxes of the cells at a level: extent, a member and the number of places."""
    finer = 2**level
    box = [F.floor(F.col(d) / (grid.side / finer)).alias(f"b{i}") for i, d in enumerate(grid.dims)]
    up = [F.floor(F.col(d) / (grid.side / (finer // 2))).alias(f"u{i}") if level else F.lit(0).alias(f"u{i}") for i, d in enumerate(grid.dims)]
    aggs = [F.min("site").alias("member"), F.count(F.lit(1)).alias("n")]
    for d in grid.dims:
        aggs += [F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"), F.min(F.struct("site", d))[d].alias(f"at_{d}")]
    return core.select("site", "cell_id", *grid.dims, *box, *up).groupBy(
        "cell_id", *[f"u{i}" for i in range(len(box))], *[f"b{i}" for i in range(len(box))]
    ).agg(*aggs)


# Two cells of at most this many points are compared point by point.
_FEW = 16


def _linked_cells(grid: _Grid, core: DataFrame) -> DataFrame:
    """Pairs of neighbouring core cells with two core points within eps of each other.

    Two cells of few points are compared directly. For fuller cells, pairs of boxes are settled by
    one member each (near enough: linked) or by their extents (too far apart: never); what stays
    open is cut into halves. Points are not paired within cells.
    """
    dims, k = grid.dims, len(grid.dims)
    few = F.col("cell_points") <= _FEW
    place = F.struct(*[F.col(d).alias(d) for d in dims])
    cells = core.groupBy("cell_id", *grid.cell).agg(
        F.max("cell_points").alias("points"), F.collect_list(F.when(few, place)).alias("few")
    )
    left = grid.around(cells.select(F.col("cell_id").alias("a"), *grid.cell, "points", "few"), ["a", "points", "few"], forward_only=True)
    left = left.withColumnsRenamed({"points": "a_points", "few": "a_few"})
    right = cells.select(F.col("cell_id").alias("b"), *grid.cell, F.col("points").alias("b_points"), F.col("few").alias("b_few"))
    met_cells = left.join(right, grid.cell)
    both_few = (F.col("a_points") <= _FEW) & (F.col("b_points") <= _FEW)
    gap = lambda p, q: reduce(lambda x, y: x + y, [(p[d] - q[d]) ** 2 for d in dims])
    touching = F.exists("a_few", lambda p: F.exists("b_few", lambda q: gap(p, q) <= grid.eps * grid.eps))
    met_cells = materialize(met_cells.select("a", "b", F.when(both_few, touching).alias("touch")).where("touch IS NULL OR touch"))
    links: list[DataFrame] = [met_cells.where("touch").select("a", "b")]
    open_cells = met_cells.where("touch IS NULL")
    if is_empty(open_cells):
        return links[0]
    open_pairs = open_cells.select("a", "b", *[F.lit(0).alias(f"{s}{i}") for s in ("ua", "ub") for i in range(k)])
    for level in count():
        boxes = _boxes(grid, core, level)

        def side(name: str) -> DataFrame:
            return boxes.select(
                F.col("cell_id").alias(name), *[F.col(f"u{i}").alias(f"u{name}{i}") for i in range(k)],
                *[F.col(f"b{i}").alias(f"b{name}{i}") for i in range(k)], F.col("n").alias(f"n{name}"),
                *[F.col(f"{p}_{d}").alias(f"{name}_{p}_{d}") for p in ("lo", "hi", "at") for d in dims],
            )

        pairs = open_pairs.join(side("a"), ["a", *[f"ua{i}" for i in range(k)]]).join(side("b"), ["b", *[f"ub{i}" for i in range(k)]])
        zero = F.lit(0.0)
        apart = reduce(lambda x, y: x + y, [
            F.greatest(F.col(f"a_lo_{d}") - F.col(f"b_hi_{d}"), F.col(f"b_lo_{d}") - F.col(f"a_hi_{d}"), zero) ** 2 for d in dims])
        met = grid.near("a_at_", "b_at_")
        judged = pairs.select(
            "a", "b", *[f"b{s}{i}" for s in ("a", "b") for i in range(k)], met.alias("met"),
            ((apart <= grid.eps**2 * (1 + 1e-9)) & ((F.col("na") > 1) | (F.col("nb") > 1))).alias("open"),
        ).where("met OR open")
        judged = materialize(judged)
        done = judged.where("met").select("a", "b").distinct()
        links.append(done)
        left_open = judged.where("NOT met").join(done, ["a", "b"], "left_anti")
        open_pairs = left_open.select("a", "b", *[F.col(f"b{s}{i}").alias(f"u{s}{i}") for s in ("a", "b") for i in range(k)])
        if is_empty(open_pairs):
            return reduce(DataFrame.unionByName, links)


def dbscan(points: DataFrame, id_col: str, dims: list[str], eps: float = 0.08, min_samples: int = 50) -> DataFrame:
    """Exact DBSCAN labels ``(id, label)``: distance up to eps, a point counts itself, -1 is noise.

    Clusters are numbered by their smallest core id; a border point takes the smallest label
    among its core neighbours, as a pass in id order would give it.
    """
    grid = _Grid(dims, eps)
    sites = density_sites(points, id_col, dims, eps, min_samples)
    total = sites.agg(F.sum("weight")).first()[0] or 0
    core = sites.where("is_core")
    named = core.groupBy(*grid.cell).agg(F.min("site").alias("cell_id"), F.max("cell_points").alias("_points"))
    core = materialize(
        join_by_key(core, named, grid.cell, "_points", total, ["site"]).drop("_points")
    )
    roots = components(_linked_cells(grid, core), "a", "b")
    cells = core.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_sites"), F.max("cell_points").alias("cell_points"))
    rooted = cells.join(roots.withColumnRenamed("id", "cell_id"), "cell_id", "left").select(
        "cell_id", "cell_points", F.coalesce("root", "cell_id").alias("root")
    )
    clusters = row_index(materialize(rooted.select("root").distinct()), "root", name="label")
    # Each cell has one label; a cell's points meet it through the skew-safe join.
    cell_label = materialize(rooted.join(clusters, "root").select("cell_id", F.col("cell_points").alias("_points"), F.col("label").cast("int").alias("label")))
    labelled = materialize(
        join_by_key(core, cell_label, ["cell_id"], "_points", total, ["site"]).drop("_points")
    )
    sizes = sites.select(*grid.cell, "cell_points").distinct()
    border = _meet(grid, labelled.select("site", "label", *dims, *grid.cell), sites.where("NOT is_core"), sizes, total)
    border = border.groupBy(F.col("probe").alias("site")).agg(F.min("label").alias("label"))
    known = labelled.select("site", "label").unionByName(border)
    by_place = sites.select("site", "weight", *dims).join(known, "site", "left").select(
        *dims, "weight", F.coalesce("label", F.lit(NOISE)).alias("label")
    )
    ids = points.select(F.col(id_col), *[(F.col(d).cast("double") + 0.0).alias(d) for d in dims])
    return join_by_key(ids, by_place, dims, "weight", total, [id_col]).select(id_col, "label")


# ---------------------------------------------------------------- DBSCAN on whole vectors

# Rounding of a product in single precision, for each entry of the vectors, as a share of both squared lengths; lengths beyond
# LONGEST and tiles of which more than UNSURE of the pairs could go either way are taken in double precision.
SINGLE, LONGEST, UNSURE = 2.5e-7, 1e30, 0.01


def _near_pairs(eps: float) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Which rows of two blocks lie within eps, by tiles of rows: by a matrix product, and by exact differences where its rounding could decide.

    The product is taken in single precision first, which leaves out most pairs.
    """
    limit = eps * eps

    def exact(rows: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        near = np.empty(len(r), bool)
        for to in range(0, len(r), TILE[1]):
            q, w = r[to : to + TILE[1]], c[to : to + TILE[1]]
            near[to : to + TILE[1]] = np.square(b[w] - rows[q]).sum(axis=1) <= limit
        return near

    def double(rows: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = sizes - 2.0 * (rows @ b.T)
        part = far <= limit
        r, c = np.nonzero(~(np.abs(far - limit) > 1e-9 * sizes))
        part[r, c] = exact(rows, b, r, c)
        return np.nonzero(part)

    def near(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size_a, size_b = np.square(a).sum(axis=1), np.square(b).sum(axis=1)
        most = size_a.max(initial=0.0) + size_b.max(initial=0.0)
        # Not ">": lengths that are no numbers go the other way as well.
        short = bool(most <= LONGEST) and limit <= LONGEST
        if short:
            slack = SINGLE * (a.shape[1] + 4) * (most + limit)
            low, high = np.float32(limit - slack), np.nextafter(np.float32(limit + slack), np.float32(np.inf))
            left = np.column_stack([a, size_a, np.ones(len(a))]).astype(np.float32)
            right = np.column_stack([-2.0 * b, np.ones(len(b)), size_b]).astype(np.float32).T
        for at in range(0, len(a), TILE[0]):
            rows = a[at : at + TILE[0]]
            if short:
                far = left[at : at + TILE[0]] @ right
                place = np.flatnonzero(far <= high)
                unsure = far.ravel()[place] >= np.nextafter(low, np.float32(-np.inf))
                if unsure.sum() <= UNSURE * far.size:
                    r, c = np.divmod(place, len(b))
                    keep = ~unsure
                    keep[unsure] = exact(rows, b, r[unsure], c[unsure])
                    yield r[keep] + at, c[keep]
                    continue
            r, c = double(rows, b, size_a[at : at + TILE[0], None] + size_b[None, :])
            yield r + at, c

    return near


def _near_blocks(eps: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which rows of two blocks lie within eps, as a matrix."""
    pairs = _near_pairs(eps)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit = np.zeros((len(a), len(b)), bool)
        for r, c in pairs(a, b):
            hit[r, c] = True
        return hit

    return near


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``id, to``: each id of the links ``a, b`` that is not the smallest of those it is linked with, and the smallest one."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        # What a root is linked with its whole tree is.
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            break
        root = low
    linked = root != np.arange(len(ids))
    return ids[linked], ids[root[linked]]


def dbscan_vectors(
    df: DataFrame, id_col: str, vec: str, eps: float = 0.08, min_samples: int = 50, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact DBSCAN on vectors of any length, by comparing blocks of rows.

    Blocks meet only where the distances of their rows to a few pivots allow a pair within eps
    (:class:`bands.Bands`); a pair of blocks yields a count, a tree edge or a label per member, never the
    pairs within eps. Rows that lie in few bands, as in one dense cloud or at nearly equal distances, are
    still compared all with all.
    """
    near = _near_pairs(eps)
    # Vectors of floats move as floats.
    kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast(kind).alias("v"), F.lit(0).cast("bigint").alias("e"))
    if is_empty(rows):
        return df.select(F.col(id_col).cast("bigint").alias(id_col), F.lit(NOISE).alias("label"))
    bands = Bands(rows, eps, block_rows=block_rows)
    rows = materialize(bands.placed(rows))

    def count(a_ids, a, _a, b_ids, b, _b):
        n_a, n_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        for r, c in near(a, b):
            n_a += np.bincount(r, minlength=len(n_a))
            n_b += np.bincount(c, minlength=len(n_b))
        if a_ids[0] == b_ids[0]:
            return pd.DataFrame({"id": a_ids, "n": n_a})
        return pd.DataFrame({"id": np.r_[a_ids, b_ids], "n": np.r_[n_a, n_b]}).query("n > 0")

    counted = bands.run(rows, rows, count, "id bigint, n bigint", once=True)
    is_core = counted.groupBy("id").agg((F.sum("n") >= min_samples).alias("is_core"))
    marked = materialize(rows.join(is_core, "id"))
    core = marked.where("is_core")

    def trees(a_ids, a, _a, b_ids, b, _b):
        found = [_forest(a_ids[r], b_ids[c]) for r, c in near(a, b)]
        ids, to = _forest(*(np.concatenate(part) for part in zip(*found)))
        return pd.DataFrame({"id": ids, "to": to})

    roots = components(materialize(bands.run(core, core, trees, "id bigint, to bigint", once=True)), "id", "to")
    rooted = materialize(core.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    clusters = row_index(materialize(sizes), "root", name="_label").select("root", "_n", F.col("_label").cast("int").alias("label"))
    labelled = materialize(join_by_key(rooted, clusters, ["root"], "_n", rooted.count(), ["id"]).select("id", "label"))

    def border(a_ids, a, _a, b_ids, b, b_label):
        first = np.full(len(a_ids), np.iinfo(np.int64).max)
        for r, c in near(a, b):
            np.minimum.at(first, r, b_label[c])
        return pd.DataFrame({"id": a_ids, "label": first})[first < np.iinfo(np.int64).max]

    named = core.drop("e").join(labelled, "id").withColumn("e", F.col("label").cast("bigint"))
    edge = bands.run(marked.where("NOT is_core"), named, border, "id bigint, label bigint")
    edge = edge.groupBy("id").agg(F.min("label").cast("int").alias("label"))
    known = labelled.unionByName(edge)
    return rows.select("id").join(known, "id", "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(NOISE)).alias("label"))


# ---------------------------------------------------------------- cluster tables

def non_noise(df: DataFrame, label: str = "label", noise: int = NOISE) -> DataFrame:
    return df.where(F.col(label) != noise)


def members(df: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """One row per member with its cluster's size; long form, so no cluster is collected."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("cluster_size"))
    return join_by_key(df.select(label, id_col), sizes, [label], "cluster_size", df.count(), [id_col])


def centroids(df: DataFrame, label: str, dims: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(d).alias(d) for d in dims])


def cluster_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of labels; noise counts as one."""
    return df.agg(F.count_distinct(F.col(label)).alias("n_clusters"))


def mean_vectors(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector per label; entries are summed per (label, position)."""
    long = df.select(label, F.posexplode(F.col(vec)).alias("pos", "v"))
    means = long.groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias(vec))


def sample_members(df: DataFrame, id_col: str, label: str, m: int, seed: int = 1998, replace: bool = True) -> DataFrame:
    """``m`` members of each cluster, drawn with replacement (or the ``m`` smallest draws without)."""
    if not replace:
        order = Window.partitionBy(label).orderBy(draw(seed, F.col(id_col)), id_col)
        ranked = df.select(label, id_col).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= m)
        return ranked.select(label, F.col("_rn").alias("draw_no"), id_col)
    placed = row_index(df.select(label, id_col), id_col, by=[label], name="_pos")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    drawn = sizes.withColumn("draw_no", F.explode(F.sequence(F.lit(1), F.lit(m))))
    drawn = drawn.withColumn("_pos", F.pmod(draw(seed, F.col(label), F.col("draw_no")), F.col("_n")))
    return drawn.join(placed, [label, "_pos"]).select(label, "draw_no", id_col)


def density_grid(df: DataFrame, label: str, x: str, y: str, step: float, min_points: int = 4) -> DataFrame:
    """Points per grid square and cluster, for clusters of at least ``min_points`` points."""
    binned = df.groupBy(label, F.floor(F.col(x) / step).alias("bx"), F.floor(F.col(y) / step).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    enough = binned.groupBy(label).agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_points)
    return binned.join(enough, label, "left_semi")


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq: np.ndarray) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def cluster_hulls(df: DataFrame, label: str, x: str, y: str, noise: int = NOISE, min_points: int = 3) -> DataFrame:
    """Convex hull corners per cluster: a hull per partition first, then one of those few corners."""
    schema = f"{label} int, x double, y double"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}
        for pdf in batches:
            for lab, grp in pdf.groupby(label):
                pts = grp[["x", "y"]].to_numpy()
                best[lab] = _hull(np.vstack([best[lab], pts]) if lab in best else pts)
        for lab, pts in best.items():
            yield pd.DataFrame({label: np.full(len(pts), lab, dtype=np.int32), "x": pts[:, 0], "y": pts[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({label: np.full(len(pts), pdf[label].iloc[0], dtype=np.int32), "x": pts[:, 0], "y": pts[:, 1]})

    enough = non_noise(df, label, noise).groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    slim = df.join(enough, label, "left_semi").select(F.col(label).cast("int").alias(label), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return slim.mapInPandas(part, schema).groupBy(label).applyInPandas(whole, schema)


def silhouette(df: DataFrame, vec: str, label: str, noise: int | None = NOISE) -> float | None:
    """Mean silhouette with squared Euclidean distance, from per-cluster sums (linear in the rows).

    None when fewer than two clusters are left.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    kept = df if noise is None else non_noise(df, label, noise)
    if len(kept.select(label).distinct().limit(2).collect()) < 2:
        return None
    ready = kept.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(ready)


def exact_silhouette(df: DataFrame, id_col: str, vec: str, label: str, noise: int | None = NOISE) -> DataFrame:
    """``id, silhouette`` of every row by Euclidean distance, from sums per row and cluster.

    Blocks of rows meet each other and a pair of blocks leaves one sum per row and cluster it met, so
    pairs of rows are never written; the distances themselves are quadratic, as the definition is. A row
    alone in its cluster has 0; without a second cluster there are no rows.
    """
    kept = df if noise is None else non_noise(df, label, noise)
    blocks = materialize(packed(kept, id_col, vec, "b", extra=label))
    others = blocks.toDF("a", "a_ids", "a_flat", "a_extra")

    def tile(ids: np.ndarray, rows: np.ndarray, mine: np.ndarray, _: np.ndarray, met: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
        # By label, so that the distances to one are neighbours; a bounded number of distances at a time.
        order = np.argsort(labels, kind="stable")
        met, (names, first) = met[order], np.unique(labels[order], return_index=True)
        sums = np.empty((len(rows), len(names)))
        for at in range(0, len(rows), TILE[0]):
            sums[at : at + TILE[0]] = np.add.reduceat(np.sqrt(squared_distances(rows[at : at + TILE[0]], met)), first, axis=1)
        return pd.DataFrame({"id": np.repeat(ids, len(names)), "label": np.repeat(mine, len(names)),
                             "other": np.tile(names, len(ids)), "total": sums.ravel()})

    parts = block_pairs(others, blocks, tile, "id bigint, label bigint, other bigint, total double")
    sums = parts.groupBy("id", "label", "other").agg(F.sum("total").alias("total"))
    sizes = kept.groupBy(F.col(label).cast("bigint").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("label") == F.col("other")
    # A row is at distance 0 from itself and so counts in no sum, only in the number it is divided by.
    mean = F.col("total") / F.when(own, F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("n"))
    both = sums.join(sizes, "other").groupBy("id").agg(
        F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"), F.max(F.when(own, F.col("n"))).alias("n")
    ).where("b IS NOT NULL")
    value = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return both.select(F.col("id").alias(id_col), value.alias("silhouette"))


def sweep(points: DataFrame, id_col: str, dims: list[str], grid: list[tuple[float, int]]) -> DataFrame:
    """DBSCAN over a small grid of parameters with clusters, noise rows and silhouette for each."""
    spark = points.sparkSession
    rows = []
    for eps, least in grid:
        labels = materialize(dbscan(points, id_col, dims, eps, least))
        n, noise = labels.agg(F.count_distinct(F.when(F.col("label") != NOISE, F.col("label"))), F.count_if(F.col("label") == NOISE)).first()
        joined = points.join(labels, id_col).select(F.array(*dims).alias("_v"), "label")
        rows.append((eps, least, n, noise, silhouette(joined, "_v", "label")))
    return spark.createDataFrame(rows, "eps double, min_samples int, n_clusters bigint, n_noise bigint, silhouette double")
