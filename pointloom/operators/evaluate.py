"""Agreement of detections on reconstructed frames with those on raw ones, and the workload that is measured."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.geometry import angle_difference, normalise_angle

SQUARE = 1e-2


def candidate_pairs(found: DataFrame, raw: DataFrame, distance: float = 1.5, angle: float = math.pi / 10, turns: float = 1.0) -> DataFrame:
    """(frame_id, label, box_1, box_2) that may match: the same frame and label, centres nearer than distance, and angles nearer
    than angle, or half a turn apart if both boxes are square. Boxes are [x, y, z, l, w, h, theta]. Only boxes in adjoining cells
    of the ground are paired; a cell is a little wider than distance, so rounding loses none."""
    a = found.select("frame_id", "label", F.col("box_idx").alias("box_1"), F.col("box").alias("b1"))
    b = raw.select("frame_id", "label", F.col("box_idx").alias("box_2"), F.col("box").alias("b2"))
    cell = lambda box, k: F.floor(F.col(box)[k] / (distance * 1.001))
    near = lambda k: F.explode(F.sequence(cell("b1", k) - 1, cell("b1", k) + 1))
    a = a.withColumn("cx", near(0)).withColumn("cy", near(1))
    pairs = a.join(b.withColumn("cx", cell("b2", 0)).withColumn("cy", cell("b2", 1)), ["frame_id", "label", "cx", "cy"])
    b1, b2 = F.col("b1"), F.col("b2")
    apart = F.sqrt(sum(((b1[k] - b2[k]) * (b1[k] - b2[k]) for k in (1, 2)), (b1[0] - b2[0]) * (b1[0] - b2[0])))
    turn = angle_difference(normalise_angle(b1[6], turns), normalise_angle(b2[6], turns))
    square = (F.abs(b1[3] - b1[4]) < SQUARE) & (F.abs(b2[3] - b2[4]) < SQUARE)
    return pairs.where((apart < distance) & ((turn < angle) | (square & (F.abs(turn - math.pi) < angle)))).select("frame_id", "label", "box_1", "box_2")


def sides(detections: DataFrame, score: float, both: bool = True) -> tuple[DataFrame, DataFrame]:
    """Reconstructed and raw boxes; those of the raw side, or of both, score above score."""
    good = F.col("score") > score
    found = detections.where("source = 'reconstructed'")
    return found.where(good) if both else found, detections.where("source = 'raw'").where(good)


def first_fit(pairs: DataFrame, outer: str, inner: str) -> DataFrame:
    """One-to-one matches: the outer side's boxes in order each take their first free candidate. A group is a frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for o, rows in pdf.sort_values([outer, inner]).groupby(outer, sort=True):
            for i, label in zip(rows[inner], rows["label"]):
                if i not in used:
                    used.add(i)
                    out.append((pdf["frame_id"].iloc[0], label, o, i))
                    break
        return pd.DataFrame(out, columns=["frame_id", "label", outer, inner])

    return pairs.groupBy("frame_id").applyInPandas(run, f"frame_id int, label int, {outer} int, {inner} int")


def forward_match(detections: DataFrame, score: float = 0.45, distance: float = 1.5, angle: float = math.pi / 10) -> DataFrame:
    """Reconstructed boxes in order take raw ones; angles modulo half a turn; both sides filtered by score."""
    return first_fit(candidate_pairs(*sides(detections, score), distance, angle, 1.0), "box_1", "box_2")


def reverse_match(detections: DataFrame, score: float = 0.5, distance: float = 1.5, angle: float = math.pi / 6) -> DataFrame:
    """Raw boxes in order take reconstructed ones, of any score; angles modulo a whole turn."""
    return first_fit(candidate_pairs(*sides(detections, score, both=False), distance, angle, 2.0), "box_2", "box_1")


def unmatched(boxes: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Boxes of a side that no match names."""
    return boxes.join(matches.select("frame_id", F.col(side).alias("box_idx")), ["frame_id", "box_idx"], "left_anti")


def accuracy(frames: DataFrame, matches: DataFrame, raw: DataFrame) -> DataFrame:
    """(frame_id, matched, boxes, accuracy): matches over raw boxes, 1 for a frame without."""
    m = matches.groupBy("frame_id").agg(F.count("*").alias("matched"))
    b = raw.groupBy("frame_id").agg(F.count("*").alias("boxes"))
    joined = frames.select("frame_id").join(m, "frame_id", "left").join(b, "frame_id", "left").na.fill(0, ["matched", "boxes"])
    return joined.withColumn("accuracy", F.when(F.col("boxes") == 0, 1.0).otherwise(F.col("matched") / F.col("boxes")))


def random_workload(spark: SparkSession, n_frames: int, n: int, seed: int = 42) -> DataFrame:
    """(query_id, frame_id): n frames, or all if there are fewer, drawn without repeats by a seeded hash."""
    frames = spark.range(n_frames).select(F.col("id").cast("int").alias("frame_id"))
    drawn = frames.orderBy(F.xxhash64("frame_id", F.lit(seed)), "frame_id").limit(n)
    from pyspark.sql.window import Window

    order = Window.orderBy(F.xxhash64("frame_id", F.lit(seed)), "frame_id")  # n rows
    return drawn.select((F.row_number().over(order) - 1).cast("int").alias("query_id"), "frame_id")


def sequential_workload(spark: SparkSession, n_frames: int, n: int, length: int, seed: int = 42) -> DataFrame:
    """(query_id, start_frame, end_frame): n ranges from seeded starts, cut at the end of the sequence."""
    from pointloom.operators.planner import clipped

    ids = spark.range(n).select(F.col("id").cast("int").alias("query_id"))
    start = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(n_frames)).cast("int")
    a, b = clipped(start, length, n_frames)
    return ids.select("query_id", a.alias("start_frame"), b.alias("end_frame"))


def metrics(random: DataFrame, sequential: DataFrame, segments: DataFrame, kb: DataFrame, fraction: DataFrame, construct_seconds: float) -> DataFrame:
    """One row: what a run of the benchmark reports, with a list entry per query (ordered by query_id). random has query_id,
    accuracy, io_cost, load_time; sequential has query_id, io_cost, load_time."""

    def in_order(c: str):
        return F.transform(F.array_sort(F.collect_list(F.struct("query_id", c))), lambda s: s[c]).alias(c)

    def listed(df: DataFrame, *cols: str) -> DataFrame:
        return df.agg(*map(in_order, cols))

    r = listed(random, "accuracy", "io_cost", "load_time").select(F.struct("*").alias("random"))
    s = listed(sequential, "io_cost", "load_time").select(F.struct("*").alias("sequential"))
    lengths = segments.groupBy((F.col("end_frame") - F.col("start_frame")).alias("length")).agg(F.count("*").alias("n"))
    counts = lengths.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("length").cast("string"), "n")))).alias("segment_counts"))
    out = r.join(s).join(counts).join(kb.select(F.col("kb").alias("disk_consume"))).join(fraction.select(F.col("fraction").alias("deduplicated_percentage")))
    return out.withColumn("construct_time", F.lit(float(construct_seconds)))
