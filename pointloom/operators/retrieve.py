"""Frame lookups, ranges and boxes over the deduplicated store; a whole workload is one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import apply_inverse, apply_pose, sensor_pose
from pointloom.operators.store import HEADER, TRAILER
from pointloom.options import Options


def frame_map(segments: DataFrame) -> DataFrame:
    """(frame_id, segment_id, start_frame, end_frame): a row a frame, so that lookups are equi-joins at any number of segments."""
    return segments.where("start_frame < end_frame").select(F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame_id"), "segment_id", "start_frame", "end_frame")


def lookup_segment(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """Each queried frame with its segment, [start, end). Segments tile a sequence, so a frame has one at most."""
    return queries.join(frame_map(segments), "frame_id")


def overlap_segments(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """Each range with the segments that it overlaps, and the frames of each that it reads: (query_id, segment_id, seg_start,
    first, last), last exclusive. Ranges name their frames, and those are grouped again by segment."""
    frames = queries.where("start_frame < end_frame").select("query_id", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame_id"))
    joined = frames.join(frame_map(segments), "frame_id")
    return joined.groupBy("query_id", "segment_id", F.col("start_frame").alias("seg_start")).agg(F.min("frame_id").alias("first"), (F.max("frame_id") + 1).alias("last"))


def wanted_frames(queries: DataFrame, segments: DataFrame, n_frames: int | None = None) -> DataFrame:
    """(query_id, frame_id, segment_id, frame_rel) of lookups (query_id, frame_id) or ranges (query_id, start_frame, end_frame).

    With n_frames, frames out of bounds and empty ranges raise an error."""
    if "frame_id" in queries.columns:
        if n_frames is not None:
            bad = (F.col("frame_id") < 0) | (F.col("frame_id") >= n_frames)
            queries = queries.withColumn("frame_id", F.when(bad, F.raise_error(F.concat(F.lit("frame out of bounds: "), F.col("frame_id")))).otherwise(F.col("frame_id")))
        found = lookup_segment(queries, segments)
        return found.select("query_id", "frame_id", "segment_id", (F.col("frame_id") - F.col("start_frame")).alias("frame_rel"))
    if n_frames is not None:
        bad = (F.col("start_frame") < 0) | (F.col("end_frame") > n_frames) | (F.col("start_frame") >= F.col("end_frame"))
        queries = queries.withColumn("end_frame", F.when(bad, F.raise_error(F.lit("empty range or out of bounds"))).otherwise(F.col("end_frame")))
    frames = queries.select("query_id", "start_frame", "end_frame").where("start_frame < end_frame")
    frames = frames.select("query_id", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame_id"))
    found = frames.join(frame_map(segments), "frame_id")
    return found.select("query_id", "frame_id", "segment_id", (F.col("frame_id") - F.col("start_frame")).alias("frame_rel"))


def reconstruct(wanted: DataFrame, store: dict[str, DataFrame], segments: DataFrame, poses: DataFrame, options: Options = Options()) -> DataFrame:
    """(query_id, frame_id, segment_id, patch_id, ord, x, y, z, intensity) of the wanted frames.

    The index join keeps patches whose subset has the frame; geometry of patches matched in the world is taken from the anchor
    to the frame; the intensity is the shared channel or the frame's own. Frames that nothing is stored for give no rows."""
    frames = wanted.join(store["patches"].select("segment_id", "patch_id", "subset", "anchor", "intensity_signal", "transposed"), "segment_id")
    frames = frames.where(F.array_contains("subset", F.col("frame_rel")))
    channel = F.when(F.col("intensity_signal"), F.lit(0)).otherwise((F.array_position("subset", F.col("frame_rel")) - 1).cast("int"))
    frames = frames.withColumn("channel", channel).drop("subset", "intensity_signal")
    rows = frames.join(store["patch_points"], ["segment_id", "patch_id"]).join(store["patch_intensity"].drop("frame_rel"), ["segment_id", "patch_id", "channel", "ord"])
    placed = segments.select("segment_id", F.col("start_frame").alias("seg_start"))
    sensor = poses.select("frame_id", sensor_pose(F.col("pose"), options.tr).alias("pose"))
    rows = rows.join(placed, "segment_id").withColumn("anchor_frame", F.col("seg_start") + F.col("anchor"))
    rows = rows.join(sensor.select("frame_id", F.col("pose").alias("pose_f")), "frame_id", "left").join(sensor.select(F.col("frame_id").alias("anchor_frame"), F.col("pose").alias("pose_a")), "anchor_frame", "left")
    local = tuple(F.col(f"{c}q") / options.coordinate_scale for c in "xyz")
    moved = apply_inverse(F.col("pose_f"), *apply_pose(F.col("pose_a"), *local))
    away = F.col("transposed") & (F.col("anchor") != F.col("frame_rel"))
    xyz = (F.when(away, m).otherwise(p).alias(c) for c, m, p in zip("xyz", moved, local))
    return rows.select("query_id", "frame_id", "segment_id", "patch_id", "ord", *xyz, (F.col("iq") / options.intensity_scale).alias("intensity"))


def io_cost(wanted: DataFrame, store: dict[str, DataFrame], blobs: DataFrame) -> DataFrame:
    """(query_id, kb): bytes of the distinct blobs that a query touches, geometry once however many of a segment's frames ask
    for it, and each segment's index."""
    frames = wanted.join(store["patches"], "segment_id").where(F.array_contains("subset", F.col("frame_rel")))
    channel = F.when(F.col("intensity_signal"), F.lit(0)).otherwise((F.array_position("subset", F.col("frame_rel")) - 1).cast("int"))
    touched = frames.select("query_id", "segment_id", "patch_id", F.explode(F.array(F.lit(-1), channel)).alias("channel")).distinct()
    parts = touched.join(blobs, ["segment_id", "patch_id", "channel"]).groupBy("query_id", "segment_id").agg(F.sum("n_bytes").alias("bytes"))
    return parts.groupBy("query_id").agg((F.sum(F.col("bytes") + HEADER + TRAILER) / 1024).alias("kb"))


def window_search(points: DataFrame, start: int, end: int) -> DataFrame:
    """Frames start to end, end inclusive."""
    return points.where(F.col("frame_id").between(start, end))


def in_box(lo: tuple[float, float, float], hi: tuple[float, float, float]) -> Column:
    low, *rest = (F.col(c).between(a, b) for c, a, b in zip("xyz", lo, hi))
    return low & rest[0] & rest[1]


def range_search(points: DataFrame, frame: int, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> DataFrame:
    """Points of a frame in a box, faces included."""
    return points.where((F.col("frame_id") == frame) & in_box(lo, hi))


def range_window_search(points: DataFrame, start: int, end: int, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> DataFrame:
    return window_search(points, start, end).where(in_box(lo, hi))
