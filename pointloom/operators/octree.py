"""Octree layout of frame pairs. A leaf is a cell of the root box cut DEPTH times; inner nodes are prefixes of cell codes, so
building, sizing and decoding are aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 15


def root_bounds(points: DataFrame) -> DataFrame:
    """(pair_id, lo and hi of x, y, z) of each two frames."""
    p = points.withColumn("pair_id", F.floor(F.col("frame_id") / 2).cast("int"))
    return p.groupBy("pair_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))


def axis_cell(v: Column, lo: Column, hi: Column, depth: int = DEPTH) -> Column:
    """The cell of a value along an axis: a value on a centre belongs to the lower half."""
    n = 1 << depth
    u = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), (F.ceil(u * n) - 1).cast("int")))


def cells(points: DataFrame, bounds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """points with pair_id and their cell (cx, cy, cz)."""
    p = points.withColumn("pair_id", F.floor(F.col("frame_id") / 2).cast("int")).join(bounds, "pair_id")
    return p.withColumns({f"c{c}": axis_cell(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), depth) for c in "xyz"}).drop(*(f"{n}_{c}" for n in ("lo", "hi") for c in "xyz"))


def leaves(celled: DataFrame) -> DataFrame:
    """(pair_id, cx, cy, cz, n0, n1): points of each member in each cell."""
    member = F.col("frame_id") % 2
    return celled.groupBy("pair_id", "cx", "cy", "cz").agg(F.count_if(member == 0).alias("n0"), F.count_if(member == 1).alias("n1"))


def level_nodes(leaf_rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair_id, level, cx, cy, cz, n0, n1): all nodes, level 0 the root. Each leaf names its prefixes, and they are aggregated
    before they are shuffled."""
    rows = leaf_rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shifted = rows.select("pair_id", "level", *(F.expr(f"shiftright(c{c}, {depth} - level)").alias(f"c{c}") for c in "xyz"), "n0", "n1")
    return shifted.groupBy("pair_id", "level", "cx", "cy", "cz").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("pair_id", "level").agg(F.count("*").alias("nodes"), F.max(F.greatest("n0", "n1")).alias("most"))


def size_bits(nodes: DataFrame, clouds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair_id, bits): a type bit and a bit per cloud for each node, an 8-bit child mask per cloud present in inner nodes, and
    the counts of leaves at the width that the largest needs. clouds is (pair_id, clouds)."""
    from pointloom.functions.geometry import bits_needed

    present = (F.col("n0") > 0).cast("int") + (F.col("n1") > 0).cast("int")
    leaf = F.col("level") == depth
    per = nodes.groupBy("pair_id").agg(
        F.count("*").alias("nodes"),
        F.sum(F.when(~leaf, present * 8).otherwise(0)).alias("masks"),
        F.sum(F.when(leaf, present).otherwise(0)).alias("counts"),
        F.max(F.when(leaf, F.greatest("n0", "n1"))).alias("most"),
    )
    bits = F.col("nodes") * (1 + F.col("clouds")) + F.col("masks") + F.col("counts") * bits_needed(F.col("most"))
    return per.join(clouds, "pair_id").select("pair_id", bits.cast("long").alias("bits"))


def clouds_of(points: DataFrame) -> DataFrame:
    """(pair_id, clouds): two, or one for an odd frame at the end."""
    return points.select(F.floor(F.col("frame_id") / 2).cast("int").alias("pair_id"), "frame_id").groupBy("pair_id").agg(F.countDistinct("frame_id").cast("int").alias("clouds"))


def regenerate(leaf_rows: DataFrame, bounds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(frame_id, x, y, z, copy): the centre of each cell as often as the member has points there."""
    both = leaf_rows.select("pair_id", "cx", "cy", "cz", F.posexplode(F.array("n0", "n1")).alias("member", "n")).where("n > 0").join(bounds, "pair_id")
    side = {c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (1 << depth) for c in "xyz"}
    centre = {c: F.col(f"lo_{c}") + (F.col(f"c{c}") + 0.5) * side[c] for c in "xyz"}
    return both.select((F.col("pair_id") * 2 + F.col("member")).cast("int").alias("frame_id"), *(v.alias(c) for c, v in centre.items()), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))


def child_bounds(lo: Column, hi: Column, octant: Column, axis: int) -> tuple[Column, Column]:
    """An axis of octant's box: bit axis set means the upper half."""
    middle = (lo + hi) / 2
    upper = F.shiftright(octant, axis).bitwiseAND(F.lit(1)) == 1
    return F.when(upper, middle).otherwise(lo), F.when(upper, hi).otherwise(middle)


STREAM = "pair_id int, clouds int, width int, bits long, stream binary"


def _codes(cells: np.ndarray, depth: int) -> np.ndarray:
    """Cells (n, 3) as one number each, in which the octant at each level is three bits, the root's first."""
    code = np.zeros(len(cells), np.int64)
    for level in range(depth - 1, -1, -1):
        for axis in range(3):
            code = code << 1 | (cells[:, 2 - axis] >> level & 1)
    return code


def _cells(code: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros((len(code), 3), np.int64)
    for level in range(depth):
        for axis in range(3):
            out[:, axis] |= (code >> (3 * level + axis) & 1) << level
    return out


def encode_tree(cells: np.ndarray, counts: np.ndarray, clouds: int, depth: int = DEPTH) -> tuple[np.ndarray, int]:
    """The bits of a tree of leaves with counts (n, clouds), and the width of its counts.

    Nodes go level by level in the order of their codes. A node is a type bit (1 for a leaf) and a bit for each cloud that is in it;
    an inner node then has a mask of eight children for each such cloud, and a leaf its count for each."""
    width = max(1, int(counts.max(initial=0)).bit_length())
    order = np.argsort(_codes(cells, depth))
    leaf, there = _codes(cells, depth)[order], counts[order]
    out = []
    for level in range(depth + 1):
        nodes, of = np.unique(leaf >> 3 * (depth - level), return_inverse=True)
        inside = np.zeros((len(nodes), clouds), bool)
        np.logical_or.at(inside, of, there > 0)
        last = level == depth
        head = np.column_stack([np.full(len(nodes), last), inside])
        if last:
            body = there[:, :, None] >> np.arange(width - 1, -1, -1) & 1
        else:
            child = leaf >> 3 * (depth - level - 1) & 7
            body = np.zeros((len(nodes), clouds, 8), bool)
            for c in range(clouds):
                rows = there[:, c] > 0
                body[of[rows], c, child[rows]] = True
        # bits of clouds that aren't in a node are left out
        whole = np.concatenate([head, body.reshape(len(nodes), -1).astype(bool)], axis=1)
        keep = np.concatenate([np.ones_like(head, bool), np.repeat(inside, body.shape[2], axis=1)], axis=1)
        out.append(whole[keep])
    return np.concatenate(out), width


def decode_tree(bits: np.ndarray, clouds: int, width: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The leaves' cells and counts of a tree's bits. A level's nodes are known from the masks of the one above."""
    at, nodes = 0, np.zeros(1, np.int64)
    for level in range(depth + 1):
        size = width if level == depth else 8
        found, children = np.zeros((len(nodes), clouds), np.int64), []
        for k in range(len(nodes)):
            if bits[at] != (level == depth):
                raise ValueError("the stream isn't a tree of this depth")
            inside = bits[at + 1 : at + 1 + clouds]
            n = int(inside.sum())
            body = bits[at + 1 + clouds : at + 1 + clouds + n * size].reshape(n, size)
            at += 1 + clouds + n * size
            if level == depth:
                found[k, np.flatnonzero(inside)] = body @ (1 << np.arange(width - 1, -1, -1))
            else:
                children.append(nodes[k] << 3 | np.flatnonzero(body.any(axis=0)))
        if level == depth:
            return _cells(nodes, depth), found
        nodes = np.concatenate(children)
    raise AssertionError


def serialise(leaf_rows: DataFrame, clouds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair_id, clouds, width, bits, stream): each pair's tree as a stream of bits, filled up to whole bytes. A group is a pair of
    frames."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("clouds")[0].as_py()
        cells = np.column_stack([table.column(f"c{c}").to_numpy() for c in "xyz"]).astype(np.int64)
        counts = np.column_stack([table.column(f"n{k}").to_numpy() for k in range(2)]).astype(np.int64)[:, :n]
        bits, width = encode_tree(cells, counts, n, depth)
        row = (table.column("pair_id")[0].as_py(), n, width, len(bits), np.packbits(bits).tobytes())
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in STREAM.split(", ")])

    return leaf_rows.join(clouds, "pair_id").groupBy("pair_id").applyInArrow(run, STREAM)


def deserialise(streams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair_id, cx, cy, cz, n0, n1) of streams as serialise() makes them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                bits = np.unpackbits(np.frombuffer(row["stream"], np.uint8))[: row["bits"]].astype(np.int64)
                cells, counts = decode_tree(bits, row["clouds"], row["width"], depth)
                both = np.column_stack([counts, np.zeros((len(counts), 2 - row["clouds"]), np.int64)])
                cols = [pa.array(np.full(len(cells), row["pair_id"], np.int32)), *(pa.array(cells[:, k].astype(np.int32)) for k in range(3)), *(pa.array(both[:, k]) for k in range(2))]
                yield pa.RecordBatch.from_arrays(cols, ["pair_id", "cx", "cy", "cz", "n0", "n1"])

    return streams.mapInArrow(run, "pair_id int, cx int, cy int, cz int, n0 long, n1 long")
