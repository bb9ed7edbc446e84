"""Baseline layouts behind the same questions: raw frames, one quantised frame a partition, and octrees of frame pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.codec import decode, encode
from pointloom.operators import octree


def frames_of(queries: DataFrame) -> DataFrame:
    """(query_id, frame_id) of lookups or ranges."""
    if "frame_id" in queries.columns:
        return queries.select("query_id", "frame_id")
    return queries.where("start_frame < end_frame").select("query_id", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame_id"))


def raw_search(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Points of the queried frames as they were read."""
    return frames_of(queries).join(points, "frame_id")


def write_quantised(points: DataFrame, path: str) -> None:
    encode(points).repartition("frame_id").write.mode("overwrite").partitionBy("frame_id").parquet(path)


def quantised_search(queries: DataFrame, coded: DataFrame) -> DataFrame:
    """The same from quantised frames; what the store is partitioned by prunes the scan."""
    return decode(frames_of(queries).join(coded, "frame_id"))


class OctreeStore:
    """Bounds and leaves of all frame pairs, as tables; they can be written and opened again without the points."""

    def __init__(self, bounds: DataFrame, leaves: DataFrame):
        self.bounds, self.leaves = bounds, leaves

    @classmethod
    def build(cls, points: DataFrame) -> OctreeStore:
        bounds = octree.root_bounds(points)
        return cls(bounds, octree.leaves(octree.cells(points, bounds)))

    def write(self, path: str) -> None:
        self.bounds.write.mode("overwrite").parquet(f"{path}/bounds")
        self.leaves.write.mode("overwrite").partitionBy("pair_id").parquet(f"{path}/leaves")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> OctreeStore:
        return cls(spark.read.parquet(f"{path}/bounds"), spark.read.parquet(f"{path}/leaves"))

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, frame_id, x, y, z, copy): frame f is member f % 2 of pair f // 2. Only pairs that are asked for are decoded."""
        frames = frames_of(queries)
        pairs = frames.select(F.floor(F.col("frame_id") / 2).cast("int").alias("pair_id")).distinct()
        made = octree.regenerate(self.leaves.join(pairs, "pair_id", "left_semi"), self.bounds)
        return frames.join(made, "frame_id")


def octree_reads(queries: DataFrame, last_frame: int) -> DataFrame:
    """(query_id, pair_reads): files that a range reads. An even frame that isn't the range's last brings its pair along; an odd
    first and an even last frame read theirs for themselves."""
    first, end = F.col("start_frame"), F.least("end_frame", F.lit(last_frame + 1))
    return queries.select("query_id", (F.floor((end - 1) / 2) - F.floor(first / 2) + 1).cast("long").alias("pair_reads"))
