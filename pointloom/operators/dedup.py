"""Deduplication of a segment's points: greedy matching of anchors to candidates, first in sensor space, then in the world.

The matching keeps a running average over a segment and so is one call per segment; segments are independent, and a group holds
one segment, whose length in frames is bounded by the planner."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.neighbours import within
from pointloom.options import Options

#: One row per stored point. ord counts points within a patch; intensities has one entry if they are shared, else one for each
#: frame of the subset (frames counted from the segment's first).
STORED = (
    "segment_id int, patch_id int, subset array<int>, anchor int, intensity_signal boolean, transposed boolean, ord int, "
    "x double, y double, z double, intensities array<double>, point_ids array<bigint>"
)


def cluster_order(n: int) -> list[tuple[list[int], int]]:
    """Runs of frames, longest first, down to two, with the middle frame (left of it for even sizes) as anchor."""
    return [(list(range(s, s + size)), s + (size - 1) // 2) for size in range(n, 1, -1) for s in range(n - size + 1)]


@dataclass
class Frame:
    """What is left of a frame: coordinates, intensities and point ids, in point order."""

    xyz: np.ndarray
    intensity: np.ndarray
    ids: np.ndarray

    def without(self, gone: np.ndarray) -> Frame:
        keep = np.ones(len(self.ids), bool)
        keep[gone] = False
        return Frame(self.xyz[keep], self.intensity[keep], self.ids[keep])


def greedy(near: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and frame the accepted candidate (-1: none), and its distance.

    Anchors go in order of the summed distance to their nearest, ties by index. A candidate is taken if it is free, within the
    soft ratio times the threshold, and keeps the average of all accepted distances within the threshold; the first accepted is
    exempt from the average. What an anchor that doesn't match in all frames has taken stays taken."""
    threshold, total, count = options.distance_threshold, 0.0, 0
    order = np.argsort(sum((top for _, _, top in near), np.zeros(n)), kind="stable")
    matched, taken = np.full((n, len(near)), -1, np.int64), np.full((n, len(near)), np.nan)
    used: list[set[int]] = [set() for _ in near]
    lists = [(index.tolist(), dist.tolist()) for dist, index, _ in near]
    for a in order.tolist():
        for f, (index, dist) in enumerate(lists):
            for c, d in zip(index[a], dist[a]):
                if c < 0:
                    break  # beyond the radius
                if c not in used[f] and (count == 0 or (total + d) / (count + 1) <= threshold):
                    used[f].add(c)
                    matched[a, f], taken[a, f] = c, d
                    total, count = total + d, count + 1
                    break
    return matched, taken


def match_step(frames: list[Frame], subset: list[int], anchor: int, options: Options) -> tuple[np.ndarray, dict[int, np.ndarray]] | None:
    """Fully matched anchors, and for each other frame their candidates; None if the anchor or another frame is empty."""
    others = [f for f in subset if f != anchor]
    if not len(frames[anchor].ids) or any(not len(frames[f].ids) for f in others):
        return None
    radius = options.soft_distance_ratio * options.distance_threshold
    near = [within(frames[anchor].xyz, frames[f].xyz, radius, options.neighbours) for f in others]
    matched, _ = greedy(near, len(frames[anchor].ids), options)
    full = np.flatnonzero((matched >= 0).all(axis=1))
    return full, {f: matched[full, k] for k, f in enumerate(others)}


def _move(pose: np.ndarray, xyz: np.ndarray) -> np.ndarray:
    return xyz @ pose[:3, :3].T + pose[:3, 3]


def dedup_segment(frames: list[Frame], poses: list[np.ndarray], options: Options) -> list[dict]:
    """The stored patches of a segment; poses are 4 x 4, sensor to world. Each patch: key fields, xyz in the anchor's (for
    transposed ones) or any (for others) sensor coordinates, intensities (n, channels) and point ids (n, frames)."""
    patches: list[dict] = []

    def emit(subset: list[int], anchor: int, shared: bool, transposed: bool, xyz, intensities, ids) -> None:
        if len(xyz):
            patches.append({"subset": subset, "anchor": anchor, "intensity_signal": shared, "transposed": transposed, "xyz": xyz, "intensities": intensities, "ids": ids})

    def one_pass(frames: list[Frame], transposed: bool) -> list[Frame]:
        for subset, anchor in cluster_order(len(frames)):
            step = match_step(frames, subset, anchor, options)
            if step is None or not len(step[0]):
                continue
            full, found = step
            own = {**found, anchor: full}
            values = np.column_stack([frames[f].intensity[own[f]] for f in subset])
            ids = np.column_stack([frames[f].ids[own[f]] for f in subset])
            xyz = frames[anchor].xyz[full]
            if transposed:
                xyz = _move(np.linalg.inv(poses[anchor]), xyz)
            base = frames[anchor].intensity[full]
            same = (np.abs(values - base[:, None]) < options.intensity_threshold).all(axis=1) & options.deduplicate_intensity
            emit(subset, anchor, True, transposed, xyz[same], base[same][:, None], ids[same])
            emit(subset, anchor, False, transposed, xyz[~same], values[~same], ids[~same])
            frames = [f.without(own[k]) if k in own else f for k, f in enumerate(frames)]
        return frames

    if options.relative_absolute in ("both", "relative"):
        frames = one_pass(frames, False)
    if options.relative_absolute in ("both", "absolute"):
        world = one_pass([Frame(_move(p, f.xyz) if len(f.ids) else f.xyz, f.intensity, f.ids) for p, f in zip(poses, frames)], True)
        keep = [np.isin(f.ids, w.ids) for f, w in zip(frames, world)]  # the rest stays as it was read, without a way there and back
        frames = [Frame(f.xyz[k], f.intensity[k], f.ids[k]) for f, k in zip(frames, keep)]
    for k, f in enumerate(frames):
        emit([k], k, True, False, f.xyz, f.intensity[:, None], f.ids[:, None])
    return patches


def dedup(points: DataFrame, segments: DataFrame, poses: DataFrame, options: Options = Options()) -> DataFrame:
    """STORED rows of all segments. points: frame_id, point_id, x, y, z, intensity; segments: segment_id, start_frame,
    end_frame; poses: frame_id, pose (12 numbers, camera). Points of frames in no segment are left out."""
    from pointloom.functions.geometry import sensor_pose
    from pointloom.operators.retrieve import frame_map

    framed = points.select("frame_id", "point_id", "x", "y", "z", "intensity").join(frame_map(segments), "frame_id")
    placed = framed.join(poses.select("frame_id", sensor_pose(F.col("pose"), options.tr).alias("pose")), "frame_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, stop = int(pdf["start_frame"].iloc[0]), int(pdf["end_frame"].iloc[0])
        pdf = pdf.sort_values(["frame_id", "point_id"], kind="stable")
        frames, at = [], []
        for f in range(start, stop):
            own = pdf[pdf["frame_id"] == f]
            frames.append(Frame(own[["x", "y", "z"]].to_numpy(float), own["intensity"].to_numpy(float), own["point_id"].to_numpy(np.int64)))
            pose = np.eye(4)
            if len(own) and own["pose"].iloc[0] is not None:
                pose[:3] = np.asarray(own["pose"].iloc[0], float).reshape(3, 4)
            at.append(pose)
        out = []
        for k, p in enumerate(dedup_segment(frames, at, options)):
            n = len(p["xyz"])
            rows = pd.DataFrame({"segment_id": int(pdf["segment_id"].iloc[0]), "patch_id": k, "subset": [p["subset"]] * n, "anchor": p["anchor"], "intensity_signal": p["intensity_signal"], "transposed": p["transposed"], "ord": range(n)})
            rows[["x", "y", "z"]] = p["xyz"]
            rows["intensities"], rows["point_ids"] = p["intensities"].tolist(), p["ids"].tolist()
            out.append(rows)
        names = [c.split()[0] for c in STORED.split(", ")]
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({c: [] for c in names})

    return placed.groupBy("segment_id").applyInPandas(run, STORED)


def patches(stored: DataFrame) -> DataFrame:
    """One row per patch."""
    return stored.groupBy("segment_id", "patch_id", "subset", "anchor", "intensity_signal", "transposed").agg(F.count("*").alias("n_points"))


def frame_patches(patch_rows: DataFrame) -> DataFrame:
    """The inverted index: (segment_id, frame_rel, patch_id)."""
    return patch_rows.select("segment_id", F.explode("subset").alias("frame_rel"), "patch_id")


def stored_fraction(patch_rows: DataFrame, points: DataFrame) -> DataFrame:
    """Stored points, original points and their ratio (0 without points)."""
    original = points.agg(F.count("*").alias("original"))
    ratio = F.when(F.col("original") > 0, F.col("stored") / F.col("original")).otherwise(0.0)
    return patch_rows.agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("stored")).join(original).select("stored", "original", ratio.alias("fraction"))


def greedy_match(points: DataFrame, segments: DataFrame, poses: DataFrame, options: Options = Options()) -> DataFrame:
    """Points that the longest step of the sensor-space pass matches: (segment_id, anchor_id, frame_rel, point_id)."""
    rows = dedup(points, segments, poses, options).where("size(subset) > 1 and not transposed")
    anchored = rows.withColumn("anchor_id", F.element_at("point_ids", F.array_position("subset", F.col("anchor")).cast("int")))
    return anchored.select("segment_id", "anchor_id", F.posexplode("point_ids").alias("at", "point_id"), "subset").select("segment_id", "anchor_id", F.get("subset", F.col("at")).alias("frame_rel"), "point_id")


def greedy_pairs(neighbours: DataFrame, options: Options = Options()) -> DataFrame:
    """One-to-one pairs of two frames from their nearest neighbours (anchor_frame, frame_id, anchor_id, point_id, distance):
    by distance, within the soft ratio times the threshold; a pair is taken if both are free and either it is nearer than the
    threshold or the average of the taken stays within it; the first is taken in any case."""
    radius, threshold = options.soft_distance_ratio * options.distance_threshold, options.distance_threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a: set[int] = set()
        used_c: set[int] = set()
        total, out = 0.0, []
        for r in pdf.sort_values(["distance", "anchor_id", "point_id"]).itertuples():
            if r.anchor_id in used_a or r.point_id in used_c:
                continue
            if not out or r.distance < threshold or (total + r.distance) / (len(out) + 1) <= threshold:
                used_a.add(r.anchor_id)
                used_c.add(r.point_id)
                total += r.distance
                out.append((r.anchor_frame, r.frame_id, r.anchor_id, r.point_id, r.distance))
        return pd.DataFrame(out, columns=["anchor_frame", "frame_id", "anchor_id", "point_id", "distance"])

    near = neighbours.where(F.col("distance") <= radius).select("anchor_frame", "frame_id", "anchor_id", "point_id", "distance")
    return near.groupBy("anchor_frame", "frame_id").applyInPandas(run, "anchor_frame int, frame_id int, anchor_id long, point_id long, distance double")


def cluster_order_rows(spark: SparkSession, n: int) -> DataFrame:
    """(position, size, start, anchor) of the runs of n frames, from sequences."""
    size, start = F.col("size"), F.col("start")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(n), F.lit(2), F.lit(-1))).alias("size")).select("size", F.explode(F.sequence(F.lit(0), n - size)).alias("start"))
    before = (n - size) * (n - size + 1) / 2
    return rows.select((before + start).cast("int").alias("position"), "size", "start", (start + F.floor((size - 1) / 2)).cast("int").alias("anchor"))


def related_subsets(spark: SparkSession, n: int, anchor: int) -> DataFrame:
    """Runs of fewer frames (n - 1 down to 2) that hold the anchor: (size, start)."""
    size, start = F.col("size"), F.col("start")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(n - 1), F.lit(2), F.lit(-1))).alias("size")).select("size", F.explode(F.sequence(F.lit(0), n - size)).alias("start"))
    return rows.where((start <= anchor) & (anchor < start + size))


def subset_anchors(subset: Column) -> Column:
    """The middle element, or both of an even number; an empty subset is an error."""
    size = F.size(subset)
    middle = F.floor(size / 2).cast("int")
    return F.when(size == 0, F.raise_error(F.lit("the subset is empty"))).when(size % 2 == 1, F.slice(subset, middle + 1, 1)).otherwise(F.slice(subset, F.greatest(middle, F.lit(1)), 2))

