"""Exact nearest neighbours without an index library: grids whose cells grow until the nearest are certain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances that are held at once.
BLOCK = 4_000_000


def brute(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of b for each of a, ties by index: (distances, indices), padded with inf and -1."""
    n, m = len(a), len(b)
    dist, index = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    if not m:
        return dist, index
    for start in range(0, n, max(1, BLOCK // m)):
        part = a[start : start + max(1, BLOCK // m)]
        d = np.sqrt(((part[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        top = min(k, m)
        if top < m:  # all up to the k-th distance, ties with it included, and then an exact order
            limit = np.partition(d, top - 1, axis=1)[:, top - 1]
            rows, cols = np.nonzero(d <= limit[:, None])
        else:
            rows, cols = np.nonzero(np.ones_like(d, bool))
        values = d[rows, cols]
        order = np.lexsort((cols, values, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < top
        dist[start + rows[keep], rank[keep]], index[start + rows[keep], rank[keep]] = values[keep], cols[keep]
    return dist, index


def _near(a: np.ndarray, b: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, distance) with j in the 27 cells around i's: all pairs nearer than cell are among them."""
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    ca, cb = (np.floor((p - low) / cell).astype(np.int64) + 1 for p in (a, b))
    size = np.maximum(ca.max(axis=0), cb.max(axis=0)) + 2
    code = lambda c: (c[:, 0] * size[1] + c[:, 1]) * size[2] + c[:, 2]
    keys = code(cb)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    out_i, out_j = [], []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            at = code(ca + np.array([dx, dy, 0]))
            first, last = np.searchsorted(keys, at - 1), np.searchsorted(keys, at + 1, "right")
            n = last - first
            rows = np.repeat(np.arange(len(a)), n)
            out_i.append(rows)
            out_j.append(order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    return i, j, np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))


def within(a: np.ndarray, b: np.ndarray, radius: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances, indices, nearest): for each of a the k nearest of b within radius, ties by index, and the exact distance to
    the nearest at any range. Grids of ever larger cells find the nearest of points that have none near; no pair of clouds is
    multiplied out."""
    n = len(a)
    dist, index, nearest = np.full((n, k), np.inf), np.full((n, k), -1, np.int64), np.full(n, np.inf)
    if not n or not len(b):
        return dist, index, nearest
    chunk, cell = 100_000, max(radius, 1e-9)
    for start in range(0, n, chunk):
        i, j, d = _near(a[start : start + chunk], b, cell)
        keep = d <= radius
        i, j, d = i[keep], j[keep], d[keep]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        np.minimum.at(nearest, start + i, d)
        keep = rank < k
        dist[start + i[keep], rank[keep]], index[start + i[keep], rank[keep]] = d[keep], j[keep]
    todo = np.flatnonzero(np.isinf(nearest))
    span = float((np.maximum(a.max(axis=0), b.max(axis=0)) - np.minimum(a.min(axis=0), b.min(axis=0))).max()) or 1.0
    while len(todo) and cell < span:
        cell *= 4
        if len(todo) * len(b) <= BLOCK:
            break
        i, _, d = _near(a[todo], b, cell)
        best = np.full(len(todo), np.inf)
        np.minimum.at(best, i, d)
        done = best <= cell
        nearest[todo[done]] = best[done]
        todo = todo[~done]
    if len(todo):
        nearest[todo] = brute(a[todo], b, 1)[0][:, 0]
    return dist, index, nearest


def nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as brute(), by a grid: a point's k nearest are certain once the k-th is nearer than a cell is wide. Cells begin small
    and double for the points that aren't certain yet, so dense parts are settled by small cells and sparse ones by large."""
    n, m = len(a), len(b)
    if n * m <= BLOCK or m <= k:
        return brute(a, b, k)
    dist, index = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    span = np.maximum(np.maximum(a.max(axis=0), b.max(axis=0)) - low, 1e-9)
    # a shell of the larger box holds the points of a scan rather than its inside
    cell, todo = float(span.max() * np.sqrt(k / m)) / 8, np.arange(n)
    while len(todo):
        if cell >= span.max():
            dist[todo], index[todo] = brute(a[todo], b, k)
            break
        grid = Grid(b, low, cell)
        first, last = grid.ranges(a[todo])
        sizes = (last - first).sum(axis=1)
        left = []
        for part in np.split(np.arange(len(todo)), np.searchsorted(np.cumsum(sizes), np.arange(BLOCK, int(sizes.sum()), BLOCK))):
            if not len(part):
                continue
            i, j = grid.pairs(first[part], last[part])
            d = np.sqrt(((a[todo[part]][i] - b[j]) ** 2).sum(axis=1))
            keep = d < cell * (1 - 1e-9)
            i, j, d = i[keep], j[keep], d[keep]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            certain = np.bincount(i, minlength=len(part)) >= k
            keep = (rank < k) & certain[i]
            rows = todo[part][i[keep]]
            dist[rows, rank[keep]], index[rows, rank[keep]] = d[keep], j[keep]
            left.append(todo[part][~certain])
        todo, cell = np.concatenate(left), cell * 2
    return dist, index


class Grid:
    """Points by the cell that they are in."""

    def __init__(self, points: np.ndarray, low: np.ndarray, cell: float):
        self.low, self.cell = low, cell
        at = self._cells(points)
        self.size = at.max(axis=0) + 3
        keys = self._code(at)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _cells(self, points: np.ndarray) -> np.ndarray:
        return np.floor((points - self.low) / self.cell).astype(np.int64) + 1

    def _code(self, at: np.ndarray) -> np.ndarray:
        return (at[:, 0] * self.size[1] + at[:, 1]) * self.size[2] + at[:, 2]

    def ranges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the points of the 27 cells around each point begin and end, as nine runs of three cells."""
        at = self._cells(points)
        shape = (len(points), 9)
        first, last = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for c, (dx, dy) in enumerate((x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)):
            near = at + np.array([dx, dy, 0])
            inside = ((near[:, :2] >= 0) & (near[:, :2] < self.size[:2])).all(axis=1) & (near[:, 2] < self.size[2] + 1)
            z0, z1 = np.clip(near[:, 2] - 1, 0, self.size[2] - 1), np.clip(near[:, 2] + 1, 0, self.size[2] - 1)
            base = self._code(np.column_stack([near[:, 0], near[:, 1], np.zeros(len(near), np.int64)]))
            first[:, c] = np.where(inside, np.searchsorted(self.keys, base + z0), 0)
            last[:, c] = np.where(inside, np.searchsorted(self.keys, base + z1, "right"), 0)
        return first, np.maximum(first, last)

    def pairs(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (last - first).ravel()
        rows = np.repeat(np.repeat(np.arange(len(first)), first.shape[1]), n)
        return rows, self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first.ravel(), n)]


def knn_join(points: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """(anchor_frame, frame_id, anchor_id, point_id, distance, rank): exact, ties by point id.

    pairs has (anchor_frame, frame_id). A group is a pair of frames, so the work is spread over frame pairs and a task holds
    two frames; no cross join is planned."""
    wanted = ["point_id", "x", "y", "z"]
    a = pairs.join(points.select(F.col("frame_id").alias("anchor_frame"), *wanted), "anchor_frame").withColumn("side", F.lit(0))
    b = pairs.join(points.select("frame_id", *wanted), "frame_id").withColumn("side", F.lit(1))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        xyz = np.column_stack([table.column(c).to_numpy() for c in "xyz"])
        ids = table.column("point_id").to_numpy()
        by = np.argsort(ids, kind="stable")
        left, right = by[side[by] == 0], by[side[by] == 1]
        dist, index = nearest(xyz[left], xyz[right], k)
        i, r = np.nonzero(index >= 0)
        n = len(i)
        frames = [pa.array(np.full(n, table.column(c)[0].as_py() if table.num_rows else 0, np.int32)) for c in ("anchor_frame", "frame_id")]
        cols = [*frames, pa.array(ids[left][i]), pa.array(ids[right][index[i, r]] if n else np.empty(0, np.int64)), pa.array(dist[i, r]), pa.array((r + 1).astype(np.int32))]
        return pa.Table.from_arrays(cols, ["anchor_frame", "frame_id", "anchor_id", "point_id", "distance", "rank"])

    both = a.select("anchor_frame", "frame_id", "side", *wanted).unionByName(b.select("anchor_frame", "frame_id", "side", *wanted))
    return both.groupBy("anchor_frame", "frame_id").applyInArrow(run, "anchor_frame int, frame_id int, anchor_id long, point_id long, distance double, rank int")


def radius_join(points: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """(anchor_frame, frame_id, anchor_id, point_id, distance) of all pairs within radius: an equi-join on grid cells of that
    size, each anchor looking into the 27 around it."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.select("frame_id", "point_id", "x", "y", "z", *(cell(c).alias(f"c{c}") for c in "xyz"))
    step = F.sequence(F.lit(-1), F.lit(1))
    a = pairs.join(p.withColumnRenamed("frame_id", "anchor_frame").withColumnRenamed("point_id", "anchor_id"), "anchor_frame")
    for c in "xyz":
        a = a.withColumn("d", F.explode(step)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d")).drop("d").withColumnRenamed(c, f"a{c}")
    joined = a.join(p, ["frame_id", "cx", "cy", "cz"])
    d = F.sqrt(sum((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "xyz"))
    return joined.select("anchor_frame", "frame_id", "anchor_id", "point_id", d.alias("distance")).where(F.col("distance") <= radius)


def anchor_order(neighbours: DataFrame) -> DataFrame:
    """Anchors by the summed distance to their nearest in each frame: (anchor_frame, anchor_id, total, position)."""
    from pyspark.sql.window import Window

    total = neighbours.where("rank = 1").groupBy("anchor_frame", "anchor_id").agg(F.sum("distance").alias("total"))
    return total.withColumn("position", F.row_number().over(Window.partitionBy("anchor_frame").orderBy("total", "anchor_id")))
