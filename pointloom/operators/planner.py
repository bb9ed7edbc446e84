"""Planning of segments: how many of which length, and where; the store is then built for what was planned."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointloom.options import Options

#: Fixed values of the block choice: blocks a round, reach, gain and spread of the smoothing, and the least weight.
ROUND, REACH, GAIN, SIGMA, FLOOR = 8, 4, 20.0, 2.0, math.exp(-6)


def time_budget(n_frames: int, length: int, options: Options = Options()) -> float:
    """Build seconds that a sequence may take: between those of the two longest segment lengths, by the budget's fraction."""
    t, b = options.time_cost, options.time_budget
    if options.same_segment:
        return t[length] * n_frames / length
    return ((1 - b) * t[length - 1] / (length - 1) + b * t[length] / length) * n_frames


def segment_mix(spark: SparkSession, n_frames: int, budget: float, time_cost: dict[int, float], score_cost: dict[int, float]) -> DataFrame:
    """Counts of segments of each length with sum(length * count) = n_frames and time within budget, of which one is the best: one
    row a mix, columns n_<length>, score and time.

    Each length's range depends on what the longer ones leave. What is left for the two shortest, of which the shortest is one
    frame, is split in closed form, as time and score are linear in the split: a row is the best split for its longer lengths. So
    rows are the counts of all lengths but two, made where the longest's counts are dealt out."""
    lengths = sorted(time_cost, reverse=True)
    closed = len(lengths) > 1 and lengths[-1] == 1
    mixes = spark.range(n_frames // lengths[0] + 1).select(F.lit(n_frames).cast("int").alias("left"), F.lit(0.0).alias("time"), F.lit(0.0).alias("score"), F.col("id").cast("int").alias("first"))
    for k, length in enumerate(lengths):
        name, left = f"n_{length}", F.col("left")
        if closed and k == len(lengths) - 2:
            each, per = time_cost[length] - length * time_cost[1], score_cost[length] - length * score_cost[1]
            most = F.floor(left / length).cast("int")
            spare = F.lit(budget) - F.col("time") - left * time_cost[1]
            time = lambda n: F.col("time") + n * time_cost[length] + (left - n * length) * time_cost[1]
            # the last count within the budget, looked at again as sums round; beyond it time grows or falls
            edge = F.lit(0) if each == 0 else F.greatest(F.lit(-1), F.least(F.lit(n_frames + 1), (F.floor(spare / each) if each > 0 else F.ceil(spare / each)))).cast("int")
            upper = most if each <= 0 else F.least(most, F.when(time(edge + 1) <= budget, edge + 1).when(time(edge) <= budget, edge).otherwise(edge - 1))
            lower = F.lit(0) if each >= 0 else F.greatest(F.lit(0), F.when(time(edge - 1) <= budget, edge - 1).when(time(edge) <= budget, edge).otherwise(edge + 1))
            mixes = mixes.withColumns({"upper": upper, "lower": lower}).where("upper >= lower").withColumn(name, F.col("upper" if per <= 0 else "lower")).drop("upper", "lower")
        elif k == 0:
            mixes = mixes.withColumnRenamed("first", name) if len(lengths) > 1 else mixes.where(F.col("first") * length == n_frames).withColumnRenamed("first", name)
        elif k < len(lengths) - 1:
            mixes = mixes.withColumn(name, F.explode(F.sequence(F.lit(0), F.floor(left / length).cast("int"))))
        else:
            mixes = mixes.where(left % length == 0).withColumn(name, F.floor(left / length).cast("int"))
        count = F.col(name)
        mixes = mixes.withColumns({"left": left - count * length, "time": F.col("time") + count * time_cost[length], "score": F.col("score") + count * score_cost[length]})
        mixes = mixes.where(F.col("time") <= budget)
    return mixes.where("left = 0").drop("left", "first")


def best_mix(spark: SparkSession, n_frames: int, budget: float, time_cost: dict[int, float], score_cost: dict[int, float]) -> dict[int, int]:
    """The mix of least score (ties: longer segments first); zero counts are left out; RuntimeError if none is feasible."""
    mixes = segment_mix(spark, n_frames, budget, time_cost, score_cost)
    row = mixes.orderBy("score", *(F.desc(f"n_{k}") for k in sorted(time_cost, reverse=True))).first()
    if row is None:
        raise RuntimeError(f"no mix of segments covers {n_frames} frames within {budget}")
    return {k: row[f"n_{k}"] for k in sorted(time_cost) if row[f"n_{k}"]}


def direct_segments(spark: SparkSession, n_frames: int, length: int) -> DataFrame:
    """Tiles of one length: (segment_id, start_frame, end_frame)."""
    starts = spark.range(0, n_frames // length).select(F.col("id").cast("int").alias("segment_id"))
    return starts.select("segment_id", (F.col("segment_id") * length).alias("start_frame"), (F.col("segment_id") * length + length).alias("end_frame"))


def smoothed(scores: np.ndarray, selected: np.ndarray, block: int, reward: float) -> np.ndarray:
    """Scores after a block's reward has spread to its neighbours that aren't selected."""
    out = scores.copy()
    for o in range(-REACH, REACH + 1):
        j = block + o
        if 0 <= j < len(out) and not selected[j]:
            out[j] = max(out[j] + GAIN * reward * math.exp(-(o * o) / (2 * SIGMA * SIGMA)), FLOOR)
    return out


def smoothing_weights(spark: SparkSession, n_blocks: int, block: int, reward: float) -> DataFrame:
    """The same for scores of one and nothing selected, as rows (block, score)."""
    o = F.col("id") - block
    score = F.when(F.abs(o) <= REACH, F.greatest(F.lit(1.0) + GAIN * reward * F.exp(-(o * o) / (2 * SIGMA * SIGMA)), F.lit(FLOOR))).otherwise(F.lit(1.0))
    return spark.range(n_blocks).select(F.col("id").cast("int").alias("block"), score.alias("score"))


def rewards(gains: DataFrame) -> DataFrame:
    """(seq, gain, avg, reward) of gains (seq, gain) in order: the average is over all gains so far, this one too, and 1 for the
    first."""
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    avg = F.when(F.col("seq") == 0, F.lit(1.0)).otherwise(F.avg("gain").over(w))
    return gains.withColumn("avg", avg).withColumn("reward", (F.col("gain") - F.col("avg")) / F.col("avg"))


def reward_of(gain: float, total: float, done: int) -> float:
    """A block's reward: its gain against the average of all so far, this one too (total), after done others; 1 stands for the average
    of the first."""
    avg = total / (done + 1) if done else 1.0
    return (gain - avg) / avg if avg else 0.0


def assign_segments(n_frames: int, counts: dict[int, int], block_gains: Callable[[Sequence[tuple[int, int]]], Sequence[float]], seed: int = 42) -> list[tuple[int, int]]:
    """Places for counts[length] segments of each length: (start, end) in order, which tile the frames.

    Blocks of as many frames as the longest length and the one below have in common are drawn by weight, ROUND at a time
    without repeats, and get long segments; block_gains says, for a round's blocks at once, how much smaller each is than if its
    frames were stored one by one, and a block's reward makes its neighbours likelier. What is left gets the other lengths, the
    longest first. The control loop is here, as a round depends on the one before; a round's blocks are one Spark job."""
    if sum(k * n for k, n in counts.items()) != n_frames:
        raise RuntimeError(f"segments {counts} don't cover {n_frames} frames")
    long = max(counts)
    left = dict(counts)
    size = math.lcm(long - 1, long) if long > 1 else 1
    per_block = size // long
    n_blocks = (counts[long] * long) // size + (counts.get(long - 1, 0) * (long - 1)) // size
    n_blocks = min(n_blocks, n_frames // size)
    rng = np.random.default_rng(seed)
    scores, selected = np.ones(n_blocks), np.zeros(n_blocks, bool)
    total, done, placed = 0.0, 0, []
    while left[long] >= per_block and not selected.all():
        weight = np.where(selected, 0.0, scores)
        if weight.sum() <= 0:
            break
        m = min(ROUND, left[long] // per_block, int((weight > 0).sum()))
        drawn = rng.choice(n_blocks, size=m, replace=False, p=weight / weight.sum()).tolist()
        for b, gain in zip(drawn, block_gains([(b * size, (b + 1) * size) for b in drawn]), strict=True):
            total += gain
            scores = smoothed(scores, selected, b, reward_of(gain, total, done))
            selected[b] = True
            left[long] -= per_block
            done += 1
            placed += [(s, s + long) for s in range(b * size, (b + 1) * size, long)]
    gaps, at = [], 0
    for s, e in [*sorted(placed), (n_frames, n_frames)]:
        if s > at:
            gaps.append((at, s))
        at = e
    return sorted(placed + _filled(gaps, left))


def _filled(gaps: list[tuple[int, int]], left: dict[int, int]) -> list[tuple[int, int]]:
    """The remaining segments laid out over the gaps: for each gap lengths that add up to it, longest first, with a way back
    where a choice leaves a gap that can't be filled; RuntimeError if there is no way. The path so far is a list, so a sequence of any
    number of segments is laid out."""
    lengths = sorted(left, reverse=True)
    counts = [left[n] for n in lengths]
    tried: set[tuple] = set()
    path: list[tuple[int, int, int]] = []  # gap, start, which length
    k, at, which = 0, gaps[0][0] if gaps else 0, 0
    while True:
        while k < len(gaps) and at >= gaps[k][1]:
            k, at = k + 1, gaps[k + 1][0] if k + 1 < len(gaps) else 0
        if k == len(gaps) and not any(counts):
            return [(s, s + lengths[c]) for _, s, c in path]
        if k < len(gaps) and (which or (k, at, *counts) not in tried):
            while which < len(lengths) and not (counts[which] and at + lengths[which] <= gaps[k][1]):
                which += 1
            if which < len(lengths):
                path.append((k, at, which))
                counts[which] -= 1
                at, which = at + lengths[which], 0
                continue
            tried.add((k, at, *counts))
        if not path:
            raise RuntimeError("the remaining segments don't fit the remaining frames")
        k, at, which = path.pop()
        counts[which] += 1
        which += 1


def plan(spark: SparkSession, n_frames: int, block_gains: Callable, options: Options = Options()) -> list[tuple[int, int]]:
    """Budget, mix and places in one go; a mix of one length is tiled."""
    length = min(options.max_cluster_length, n_frames)
    costs = {k: v for k, v in options.time_cost.items() if k <= length}
    mix = best_mix(spark, n_frames, time_budget(n_frames, length, options), costs, {k: options.score_cost[k] for k in costs})
    if len(mix) == 1:
        (k,) = mix
        return [(s, s + k) for s in range(0, n_frames, k)]
    return assign_segments(n_frames, mix, block_gains, options.seed)


def measured_gains(points: DataFrame, poses: DataFrame, options: Options, length: int) -> Callable:
    """block_gains by building: for a round's blocks, KB of all frames stored alone less KB of segments of the given length."""
    from pointloom.operators.dedup import dedup
    from pointloom.operators.store import segment_sizes

    def gains(blocks: Sequence[tuple[int, int]]) -> list[float]:
        spark = points.sparkSession
        rows = [(k * 1000 + i, s, min(s + n, b)) for k, (a, b) in enumerate(blocks) for n, base in ((1, 0), (length, 500)) for i, s in enumerate(range(a, b, n), base)]
        made = dedup(points, spark.createDataFrame(rows, "segment_id int, start_frame int, end_frame int"), poses, options)
        kb = {r["segment_id"]: r["kb"] for r in segment_sizes(made, options).collect()}  # a few rows a block
        single = [sum(v for s, v in kb.items() if s // 1000 == k and s % 1000 < 500) for k in range(len(blocks))]
        joint = [sum(v for s, v in kb.items() if s // 1000 == k and s % 1000 >= 500) for k in range(len(blocks))]
        return [a - b for a, b in zip(single, joint)]

    return gains


def covers(segments: DataFrame, n_frames: int) -> DataFrame:
    """(frame_id, n_segments) for each frame: one everywhere if the segments tile the sequence."""
    hit = segments.select(F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame_id"))
    frames = segments.sparkSession.range(n_frames).select(F.col("id").cast("int").alias("frame_id"))
    return frames.join(hit.groupBy("frame_id").agg(F.count("*").alias("n_segments")), "frame_id", "left").na.fill(0, ["n_segments"])


def measured_costs(points: DataFrame, poses: DataFrame, options: Options, longest: int) -> dict[int, tuple[float, float]]:
    """The cost model by building the first 1 .. longest frames as one segment: length -> (seconds, KB)."""
    import time

    from pointloom.operators.dedup import dedup
    from pointloom.operators.store import segment_sizes

    out = {}
    for length in range(1, longest + 1):
        segment = points.sparkSession.createDataFrame([(0, 0, length)], "segment_id int, start_frame int, end_frame int")
        began = time.time()
        kb = segment_sizes(dedup(points, segment, poses, options), options).first()["kb"]
        out[length] = (time.time() - began, float(kb))
    return out


def total_score(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.sum("kb").alias("kb"))


def clipped(start: Column, length: int, total: int) -> tuple[Column, Column]:
    """A range of a workload: [start, start + length) cut at the end of the sequence."""
    return start, F.least(start + length, F.lit(total))
