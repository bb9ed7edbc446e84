"""Connected components of an edge table: in one task while the edges are few, else by rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import discard, staged

#: Edges that one task takes, 16 bytes each; more go through rounds of joins. Both ways give the same rows.
ONE_TASK = 1_000_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its neighbours that are larger (large), or those that are smaller and itself, to the least of them.

    The least neighbour is a plain aggregate that is combined before the shuffle, and the join that follows it is one that
    adaptive execution splits, so a hub with any number of neighbours isn't one task's work."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select("u", "v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.distinct()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the least node that each reaches: labels fall to the least of a node's neighbours and on to those
    labels' labels, until nothing changes."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        # a root takes the least label that an edge of its tree offers
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(nearer := label[label], label):
            label = nearer
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _in_one_task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in it if b.num_rows]
    if got:
        table = pa.Table.from_batches(got)
        found = forest(table.column("u").to_numpy(), table.column("v").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """(id, component) for each node that an edge touches, staged; component is the least node reachable.

    Up to one_task edges (ONE_TASK) are one task's work. More take about log2 of the longest chain rounds, which end when one
    changes nothing. Loops and repeats are allowed; no edges give no rows. Edges with a null end are left out."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    now = staged(pairs, "edges")
    before = sign(now)
    if before[0] <= (ONE_TASK if one_task is None else one_task):
        found = staged(now.coalesce(1).mapInArrow(_in_one_task, "id long, component long"), "components")
        discard(now)
        return found
    for _ in range(rounds):
        last, now = now, staged(_stars(_stars(now, True), False), "edges")
        discard(last)
        if (after := sign(now)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = staged(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    discard(now)
    return found
