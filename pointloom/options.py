"""Options of the engine. Defaults follow the published command line; the three that it reads but never declares have the
values that its README and signatures give."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    distance_threshold: float = 0.03
    soft_distance_ratio: float = 2.0
    neighbours: int = 10
    max_cluster_length: int = 4
    #: "both", "relative" or "absolute": which spaces points are matched in.
    relative_absolute: str = "both"
    deduplicate_intensity: bool = False
    intensity_threshold: float = 0.01
    intensity_scale: float = 32767.0
    coordinate_scale: float = 10000.0
    time_budget: float = 0.25
    same_segment: bool = False
    octree_depth: int = 15
    #: Calibration, row-major 4 x 4.
    tr: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    #: Build seconds and encoded KB of a segment by its length in frames (fixed values of the cost model).
    time_cost: dict[int, float] = field(default_factory=lambda: {1: 0.1914682388305664, 2: 6.162039518356323, 3: 15.435150146484375, 4: 34.22509431838989})
    score_cost: dict[int, float] = field(default_factory=lambda: {1: 461.71875, 2: 842.2587890625, 3: 1210.3564453125, 4: 1598.0810546875})
    seed: int = 42
