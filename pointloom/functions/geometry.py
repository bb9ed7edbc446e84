"""Geometry as column expressions: poses, transforms, angles, cells. All of it stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micro(c: Column | str) -> Column:
    """A number in millionths, rounded, as long: what results are compared in."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("long")


def quaternion_to_pose(q: Column) -> Column:
    """[qx, qy, qz, qw, tx, ty, tz] -> 12 numbers of [R t], row-major. The quaternion is normalised first."""
    norm = F.sqrt(sum((q[i] * q[i] for i in range(1, 4)), q[0] * q[0]))
    x, y, z, w = (q[i] / norm for i in range(4))
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), q[4]),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), q[5]),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), q[6]),
    )
    return F.array(*(c for row in rows for c in row))


def sensor_pose(pose: Column, tr: Sequence[float]) -> Column:
    """Tr^-1 C Tr of a camera pose C: each entry is linear in C's entries, with coefficients known beforehand."""
    t = np.asarray(tr, float).reshape(4, 4)
    inverse = np.linalg.inv(t)
    out = []
    for i in range(3):
        for j in range(4):
            terms = [(inverse[i, a] * t[b, j], 4 * a + b) for a in range(3) for b in range(4)]
            constant = float(inverse[i, 3] * t[3, j])
            acc = F.lit(constant)
            for c, at in terms:
                if c:
                    acc = acc + (pose[at] if c == 1 else pose[at] * float(c))
            out.append(acc)
    return F.array(*out)


def apply_pose(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """R p + t."""
    return tuple(pose[4 * i] * x + pose[4 * i + 1] * y + pose[4 * i + 2] * z + pose[4 * i + 3] for i in range(3))


def apply_inverse(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """R^T (p - t); poses are rigid."""
    dx, dy, dz = x - pose[3], y - pose[7], z - pose[11]
    return tuple(pose[i] * dx + pose[4 + i] * dy + pose[8 + i] * dz for i in range(3))


def transformed(points: DataFrame, poses: DataFrame, inverse: bool = False) -> DataFrame:
    """points with x, y, z taken to the world (or back) by the pose of their frame; poses are a few numbers a frame, and
    Spark joins them in the way their size allows."""
    joined = points.join(poses.select("frame_id", "pose"), "frame_id")
    move = apply_inverse if inverse else apply_pose
    x, y, z = move(F.col("pose"), F.col("x"), F.col("y"), F.col("z"))
    return joined.withColumns({"x": x, "y": y, "z": z}).drop("pose")


def to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    return transformed(points, poses)


def from_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    return transformed(points, poses, inverse=True)


def anchor_to_frame(points: DataFrame, poses: DataFrame, anchor: str = "anchor_frame", frame: str = "frame_id") -> DataFrame:
    """Points in their anchor's coordinates taken to another frame's: inv(P_f) P_a."""
    pa = poses.select(F.col("frame_id").alias(anchor), F.col("pose").alias("pose_a"))
    pf = poses.select(F.col("frame_id").alias(frame), F.col("pose").alias("pose_f"))
    joined = points.join(pa, anchor).join(pf, frame)
    world = apply_pose(F.col("pose_a"), F.col("x"), F.col("y"), F.col("z"))
    x, y, z = apply_inverse(F.col("pose_f"), *world)
    return joined.withColumns({"x": x, "y": y, "z": z}).drop("pose_a", "pose_f")


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def normalise_angle(theta: Column, turns: float = 1.0) -> Column:
    """theta modulo turns * pi, never negative."""
    return F.pmod(theta, F.lit(float(turns) * np.pi))


def angle_difference(a: Column, b: Column) -> Column:
    """The shortest way between two angles."""
    return F.abs(F.atan2(F.sin(a - b), F.cos(a - b)))


def bits_needed(most: Column) -> Column:
    """Bits for counts up to most: at least one."""
    return F.greatest(F.lit(1), F.ceil(F.log2(most + 1)).cast("int"))


def segment_file_name(start: Column, stop: Column) -> Column:
    """The name of the file of the frames [start, stop): a.laz for one frame, else a-b.bin with b inclusive."""
    return F.when(stop - start == 1, F.concat(start.cast("string"), F.lit(".laz"))).otherwise(F.concat_ws("-", start.cast("string"), F.concat((stop - 1).cast("string"), F.lit(".bin"))))
