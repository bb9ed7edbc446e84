"""A deterministic sequence made from the embeddings table: a static scene seen by a moving sensor, eight frames.

Four fifths of the points stand still in the world, one fifth moves with the sensor, and one in eleven (point, frame) pairs is
missing. The same tables exist as DataFrames here and, for checking, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 8
SEGMENTS = ((0, 0, 4), (1, 4, 8))
Q_RANDOM = ((0, 0), (1, 3), (2, 5), (3, 7))
Q_SEQ = ((0, 0, 8), (1, 2, 6), (2, 3, 4))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id int, point_id long, x, y, z, intensity double. No shuffle: each point makes its own frames."""
    e = F.col("embedding")
    wide = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        *((e[k].cast("double") * 20).alias(f"e{c}") for k, c in enumerate("xyz")),
        F.abs(e[3].cast("double")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame_id"),
    )
    p, f = F.col("point_id"), F.col("frame_id")
    world = wide.where((p * 31 + f * 17) % 11 != 0).select(
        "frame_id",
        "point_id",
        (p % 5 == 0).alias("ego"),
        (F.col("ex") + 0.012 * F.sin(7 * p + 13 * f)).alias("wx"),
        (F.col("ey") + 0.012 * F.cos(5 * p + 11 * f)).alias("wy"),
        (F.col("ez") + 0.012 * F.sin(3 * p + 17 * f)).alias("wz"),
        F.least(F.lit(1.0), F.col("i") + 0.004 * ((f + p) % 4)).alias("intensity"),
    )
    ego, wx, wy, a = F.col("ego"), F.col("wx"), F.col("wy"), 0.02 * f
    dx = wx - 0.8 * f
    return world.select(
        "frame_id",
        "point_id",
        F.when(ego, wx).otherwise(F.cos(a) * dx + F.sin(a) * wy).alias("x"),
        F.when(ego, wy).otherwise(-F.sin(a) * dx + F.cos(a) * wy).alias("y"),
        F.col("wz").alias("z"),
        "intensity",
    )


def poses(spark: SparkSession) -> DataFrame:
    f = F.col("frame_id")
    a, zero, one = 0.02 * f, F.lit(0.0), F.lit(1.0)
    frames = spark.range(FRAMES).select(F.col("id").cast("int").alias("frame_id"))
    return frames.select("frame_id", F.array(F.cos(a), -F.sin(a), zero, 0.8 * f, F.sin(a), F.cos(a), zero, zero, zero, zero, one, zero).alias("pose"))


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEGMENTS), "segment_id int, start_frame int, end_frame int")


def q_random(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(Q_RANDOM), "query_id int, frame_id int")


def q_seq(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(Q_SEQ), "query_id int, start_frame int, end_frame int")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, source, box_idx, label, score, box [x, y, z, l, w, h, theta], from events; the reconstructed frame's boxes are
    the raw ones a little moved, turned and rescored, with one in seven missing."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    base = e.select(
        i,
        (i % FRAMES).cast("int").alias("frame_id"),
        F.floor(i / FRAMES).cast("int").alias("box_idx"),
        (F.length("event_type") % 3).cast("int").alias("label"),
        (F.abs(F.col("value")) / 50 % 1).alias("score"),
    )
    sides = base.select("*", F.explode(F.array(F.lit("raw"), F.lit("reconstructed"))).alias("source"))
    moved = (F.col("source") == "reconstructed").cast("double")
    box = F.array(
        (i % 97).cast("double") + moved * 0.4 * F.sin(i.cast("double")),
        (i % 89).cast("double") + moved * 0.4 * F.cos(i.cast("double")),
        (i % 5).cast("double") * 0.5,
        2.0 + (i % 3).cast("double"),
        2.0 + (i % 2).cast("double"),
        F.lit(1.5),
        (i % 63).cast("double") * 0.1 - 3.1 + moved * 0.2 * F.sin(3.0 * i),
    )
    kept = (F.col("source") == "raw") | (i % 7 != 0)
    score = F.col("score") - moved * 0.03
    return sides.where(kept).select("frame_id", "source", "box_idx", "label", score.alias("score"), box.alias("box"))


def _values(rows, names: str) -> str:
    return f"(select * from (values {', '.join(str(tuple(r)) if len(r) > 1 else f'({r[0]})' for r in rows)}) as v({names}))"


#: The same tables for DuckDB, whose lists count from 1.
DUCK = {
    "points": """(with f as (select cast(range as int) as frame_id from range(8)),
e as (select vec_id, 20*cast(embedding[1] as double) x, 20*cast(embedding[2] as double) y, 20*cast(embedding[3] as double) z, abs(cast(embedding[4] as double)) i from embeddings),
w as (select f.frame_id, e.vec_id as point_id, e.vec_id % 5 = 0 as ego, e.i, e.x + 0.012*sin(7*e.vec_id+13*f.frame_id) as wx,
e.y + 0.012*cos(5*e.vec_id+11*f.frame_id) as wy, e.z + 0.012*sin(3*e.vec_id+17*f.frame_id) as wz
from e cross join f where (e.vec_id*31 + f.frame_id*17) % 11 <> 0)
select frame_id, point_id, case when ego then wx else cos(0.02*frame_id)*(wx-0.8*frame_id) + sin(0.02*frame_id)*wy end as x,
case when ego then wy else -sin(0.02*frame_id)*(wx-0.8*frame_id) + cos(0.02*frame_id)*wy end as y, wz as z,
least(1.0, i + 0.004*((frame_id + point_id) % 4)) as intensity from w)""",
    "poses": """(select cast(range as int) as frame_id, cos(0.02*range) as c, sin(0.02*range) as s, 0.8*range as tx from range(8))""",
    "segments": _values(SEGMENTS, "segment_id, start_frame, end_frame"),
    "q_random": _values(Q_RANDOM, "query_id, frame_id"),
    "q_seq": _values(Q_SEQ, "query_id, start_frame, end_frame"),
    "detections": """(select event_id as i, cast(event_id % 8 as int) as frame_id, cast(event_id // 8 as int) as box_idx, cast(length(event_type) % 3 as int) as label, source,
((abs(value) / 50) % 1) - m * 0.03 as score, (event_id % 97) + m * 0.4 * sin(event_id) as bx, (event_id % 89) + m * 0.4 * cos(event_id) as by_, (event_id % 5) * 0.5 as bz,
2.0 + (event_id % 3) as l, 2.0 + (event_id % 2) as w, (event_id % 63) * 0.1 - 3.1 + m * 0.2 * sin(3.0 * event_id) as theta
from events cross join (values ('raw', 0.0::double), ('reconstructed', 1.0::double)) as v(source, m) where source = 'raw' or event_id % 7 <> 0)""",
}


def duck(body: str, *tables: str, also: str = "") -> str:
    """body with the named fixture tables, and further expressions, before it."""
    parts = [f"{t} as {DUCK[t]}" for t in tables] + ([also] if also else [])
    return f"with {', '.join(parts)} {body}" if parts else body
