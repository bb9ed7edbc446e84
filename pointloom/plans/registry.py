"""All queries of the point-cloud engine, by name, and the SQL that checks them.

A query with SQL gives integers (coordinates in millionths), so that two engines' results can be equal. Queries whose result
depends on an order of decisions have no SQL; tests hold them against recorded counts and invariants."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointloom.functions import codec, geometry
from pointloom.functions.geometry import micro
from pointloom.operators import baselines, dedup, evaluate, neighbours, octree, planner, retrieve, store
from pointloom.options import Options
from pointloom.plans import fixture as fx
from pointloom.plans.fixture import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPTIONS = Options()
LO, HI = (-10.0, -10.0, -10.0), (10.0, 10.0, 10.0)
XYZ = ("x", "y", "z")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def coded(df: DataFrame, *keep: str, of: tuple[str, ...] = (*XYZ, "intensity")) -> DataFrame:
    """keep as long or as it is, and coordinates in millionths."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes if c in keep), *(micro(c).alias(c) for c in of))


def m(expr: str, name: str) -> str:
    return f"cast(round(({expr}) * 1e6) as bigint) as {name}"


def b(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"


P4 = ", ".join(m(c, c) for c in (*XYZ, "intensity"))
P3 = ", ".join(m(c, c) for c in XYZ)
#: World coordinates of fixture points in SQL, and a frame's from the world.
WORLD = "q.c*p.x - q.s*p.y + q.tx, q.s*p.x + q.c*p.y, p.z"


def stored(spark: SparkSession, sf_dir: str, options: Options = OPTIONS) -> DataFrame:
    return dedup.dedup(fx.points(spark, sf_dir), fx.segments(spark), fx.poses(spark), options)


def kept(spark: SparkSession, sf_dir: str, options: Options = OPTIONS) -> DataFrame:
    """The stored rows written once and read again: a query that needs several of the store's tables matches once.

    They go to the shared folder if the session names one; otherwise lineage is kept."""
    rows = stored(spark, sf_dir, options)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return rows
    import uuid

    path = f"{folder.rstrip('/')}/stored/{uuid.uuid4().hex}"
    rows.write.partitionBy("segment_id").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def written_frames(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each frame, where all executors see it; a folder of this machine where there is but one."""
    import re
    import tempfile
    import uuid

    from pointloom.sources.writers import write_frames

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pointloom-")
    path = f"{folder.rstrip('/')}/frames/{uuid.uuid4().hex}"
    write_frames(fx.points(spark, sf_dir), path)
    return path


@query(duck(f"select {b('frame_id', 'frame_id')}, lpad(cast(frame_id as varchar), 6, '0') || '.bin' as file_name, {b('count(*)', 'n_points')}, {b('count(*) * 16', 'file_bytes')} from points group by frame_id", "points"))
def frame_catalog(spark, sf_dir):
    """The catalog of frame files that were written from the points."""
    from pointloom.sources import readers

    return readers.frame_catalog(spark, written_frames(spark, sf_dir)).select(F.col("frame_id").cast("long"), "file_name", F.col("n_points").cast("long"), F.col("file_bytes").cast("long"))


@query(duck(f"select {b('frame_id', 'frame_id')}, {b('row_number() over (partition by frame_id order by point_id) - 1', 'point_id')}, {', '.join(b(f'round(cast({c} as float)::double * 1e3)', c) for c in (*XYZ, 'intensity'))} from points", "points"))
def frame_scan(spark, sf_dir):
    """Points read back from frame files; coordinates, which files hold as floats, in thousandths."""
    from pointloom.sources import readers

    rows = readers.read_frames(spark, written_frames(spark, sf_dir))
    return rows.select(F.col("frame_id").cast("long"), "point_id", *(F.round(F.col(c).cast("double") * 1e3).cast("long").alias(c) for c in (*XYZ, "intensity")))


@query(duck(f"select {b('q.query_id', 'query_id')}, {b('p.frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {P4} from points p join q_random q on p.frame_id = q.frame_id", "points", "q_random"))
def raw_random(spark, sf_dir):
    return coded(baselines.raw_search(fx.q_random(spark), fx.points(spark, sf_dir)), "query_id", "frame_id", "point_id")


@query(duck(f"select {b('query_id', 'query_id')}, {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {P4} from points p join q_seq q on p.frame_id >= q.start_frame and p.frame_id < q.end_frame", "points", "q_seq"))
def raw_sequential(spark, sf_dir):
    return coded(baselines.raw_search(fx.q_seq(spark), fx.points(spark, sf_dir)), "query_id", "frame_id", "point_id")


@query(duck(f"select {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {P4} from points where frame_id between 2 and 5", "points"))
def window_search(spark, sf_dir):
    return coded(retrieve.window_search(fx.points(spark, sf_dir), 2, 5), "frame_id", "point_id")


BOX = "x between -10 and 10 and y between -10 and 10 and z between -10 and 10"


@query(duck(f"select {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {P4} from points where frame_id = 3 and {BOX}", "points"))
def range_search(spark, sf_dir):
    return coded(retrieve.range_search(fx.points(spark, sf_dir), 3, LO, HI), "frame_id", "point_id")


@query(duck(f"select {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {P4} from points where frame_id between 1 and 4 and {BOX}", "points"))
def range_window_search(spark, sf_dir):
    return coded(retrieve.range_window_search(fx.points(spark, sf_dir), 1, 4, LO, HI), "frame_id", "point_id")


QUAT = "(select cast(range as int) as frame_id, 0.1*range as x, 0.2 as y, 0.05*range - 0.3 as z, 1.0 - 0.02*range as w, range*0.5 as tx, -1.0 as ty, 2.0 as tz from range(8))"
QN = f"quats as {QUAT}, n as (select frame_id, x/l as x, y/l as y, z/l as z, w/l as w, tx, ty, tz from (select *, sqrt(x*x+y*y+z*z+w*w) as l from quats))"
ROT = ("1-2*(y*y+z*z)", "2*(x*y-z*w)", "2*(x*z+y*w)", "tx", "2*(x*y+z*w)", "1-2*(x*x+z*z)", "2*(y*z-x*w)", "ty", "2*(x*z-y*w)", "2*(y*z+x*w)", "1-2*(x*x+y*y)", "tz")


@query(f"with {QN} select {b('frame_id', 'frame_id')}, {', '.join(m(e, f'm{k}') for k, e in enumerate(ROT))} from n")
def quat_to_pose(spark, sf_dir):
    f = F.col("id")
    q = F.array(0.1 * f, F.lit(0.2), 0.05 * f - 0.3, 1.0 - 0.02 * f, f * 0.5, F.lit(-1.0), F.lit(2.0))
    pose = geometry.quaternion_to_pose(F.col("q"))
    rows = spark.range(8).select(F.col("id").alias("frame_id"), q.alias("q")).select("frame_id", pose.alias("p"))
    return rows.select("frame_id", *(micro(F.col("p")[k]).alias(f"m{k}") for k in range(12)))


#: A calibration that swaps axes, as between a camera and a scanner: x -> z, y -> -x, z -> -y, and an offset.
SWAP = (0.0, -1.0, 0.0, 0.1, 0.0, 0.0, -1.0, -0.2, 1.0, 0.0, 0.0, 0.3, 0.0, 0.0, 0.0, 1.0)
# the SQL has Tr^-1 C Tr written out for SWAP and a turn about z with a shift along x


@query(
    duck(
        "select cast(frame_id as bigint) as frame_id, "
        + ", ".join(
            m(e, f"m{k}")
            for k, e in enumerate(
                ("1", "0", "0", "0", "0", "c", "-s", "-(c*0.1 - s*(-0.2) + tx) + 0.1", "0", "s", "c", "-(s*0.1 + c*(-0.2)) + (-0.2)")
            )
        )
        + " from poses",
        "poses",
    )
)
def pose_velodyne(spark, sf_dir):
    rows = fx.poses(spark).select("frame_id", geometry.sensor_pose(F.col("pose"), SWAP).alias("p"))
    return rows.select(F.col("frame_id").cast("long"), *(micro(F.col("p")[k]).alias(f"m{k}") for k in range(12)))


@query(duck(f"select {b('p.frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {m('q.c*p.x - q.s*p.y + q.tx', 'x')}, {m('q.s*p.x + q.c*p.y', 'y')}, {m('p.z', 'z')}, {m('p.intensity', 'intensity')} from points p join poses q on p.frame_id = q.frame_id", "points", "poses"))
def to_world(spark, sf_dir):
    return coded(geometry.to_world(fx.points(spark, sf_dir), fx.poses(spark)), "frame_id", "point_id")


@query(duck(f"select {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {P3} from points", "points"))
def world_roundtrip(spark, sf_dir):
    there = geometry.to_world(fx.points(spark, sf_dir), fx.poses(spark))
    return coded(geometry.from_world(there, fx.poses(spark)), "frame_id", "point_id", of=XYZ)


def segment_pairs(spark: SparkSession) -> DataFrame:
    """Each frame as an anchor with all other frames of its segment."""
    frames = fx.segments(spark).select("segment_id", F.explode(F.expr("sequence(start_frame, end_frame - 1)")).alias("frame_id"))
    return frames.withColumnRenamed("frame_id", "anchor_frame").join(frames, "segment_id").where("anchor_frame <> frame_id").select("anchor_frame", "frame_id")


#: The same pairs in SQL.
FRAME_PAIRS = "frame_pairs as (select a.range as anchor_frame, c.range as frame_id from segments s, range(8) a, range(8) c where a.range <> c.range and a.range >= start_frame and a.range < end_frame and c.range >= start_frame and c.range < end_frame)"


@query(
    duck(
        f"select {b('w.frame_id', 'anchor_frame')}, {b('f.frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {m('f.c*(wx-f.tx) + f.s*wy', 'x')}, {m('-f.s*(wx-f.tx) + f.c*wy', 'y')}, {m('z', 'z')} from w join frame_pairs g on w.frame_id = g.anchor_frame join poses f on f.frame_id = g.frame_id",
        "points",
        "poses",
        "segments",
        also=f"{FRAME_PAIRS}, w as (select p.frame_id, point_id, q.c*p.x - q.s*p.y + q.tx as wx, q.s*p.x + q.c*p.y as wy, z from points p join poses q on p.frame_id = q.frame_id)",
    )
)
def anchor_to_frame(spark, sf_dir):
    p = fx.points(spark, sf_dir).withColumnRenamed("frame_id", "anchor_frame").join(segment_pairs(spark), "anchor_frame")
    return coded(geometry.anchor_to_frame(p, fx.poses(spark)), "anchor_frame", "frame_id", "point_id", of=XYZ)


DIST = "sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z))"
KNN = f"{FRAME_PAIRS}, knn as (select *, row_number() over (partition by anchor_frame, frame_id, anchor_id order by d, point_id) as rk from (select g.anchor_frame, a.point_id as anchor_id, c.frame_id, c.point_id, {DIST} as d from frame_pairs g join points a on a.frame_id = g.anchor_frame join points c on c.frame_id = g.frame_id))"


@query(duck(f"select {b('anchor_frame', 'anchor_frame')}, {b('frame_id', 'frame_id')}, {b('anchor_id', 'anchor_id')}, {b('point_id', 'point_id')}, {b('rk', 'rank')}, {m('d', 'distance')} from knn where rk <= 10", "points", "segments", also=KNN))
def knn_join(spark, sf_dir):
    rows = neighbours.knn_join(fx.points(spark, sf_dir), segment_pairs(spark), OPTIONS.neighbours)
    return coded(rows, "anchor_frame", "frame_id", "anchor_id", "point_id", "rank", of=("distance",))


@query(duck(f"select {b('anchor_frame', 'anchor_frame')}, {b('frame_id', 'frame_id')}, {b('anchor_id', 'anchor_id')}, {b('point_id', 'point_id')}, {m('d', 'distance')} from knn where d <= 0.06", "points", "segments", also=KNN))
def radius_join(spark, sf_dir):
    rows = neighbours.radius_join(fx.points(spark, sf_dir), segment_pairs(spark), OPTIONS.soft_distance_ratio * OPTIONS.distance_threshold)
    return coded(rows, "anchor_frame", "frame_id", "anchor_id", "point_id", of=("distance",))


@query(duck(f"select {b('anchor_frame', 'anchor_frame')}, {b('anchor_id', 'anchor_id')}, {m('t', 'total')}, {b('row_number() over (partition by anchor_frame order by t, anchor_id)', 'position')} from (select anchor_frame, anchor_id, sum(d) as t from knn where rk = 1 group by anchor_frame, anchor_id)", "points", "segments", also=KNN))
def anchor_order(spark, sf_dir):
    near = neighbours.knn_join(fx.points(spark, sf_dir), segment_pairs(spark), 1)
    return coded(neighbours.anchor_order(near), "anchor_frame", "anchor_id", "position", of=("total",))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in names or df.columns))


@query("select cast((5-s)*(5-s+1)//2 + a as bigint) as position, cast(s as bigint) as size, cast(a as bigint) as start, cast(a + (s-1)//2 as bigint) as anchor from (select range as s from range(2, 6)) cross join (select range as a from range(0, 4)) where a + s <= 5")
def cluster_order(spark, sf_dir):
    return longs(dedup.cluster_order_rows(spark, 5))


@query("select cast(s as bigint) as size, cast(a as bigint) as start from (select range as s from range(2, 5)) cross join (select range as a from range(0, 4)) where a + s <= 5 and a <= 2 and 2 < a + s")
def related_subsets(spark, sf_dir):
    return longs(dedup.related_subsets(spark, 5, 2))


@query("select cast(n as bigint) as size, array_to_string(case when n % 2 = 1 then [n//2] else [n//2 - 1, n//2] end, ',') as anchors from (select range as n from range(1, 7))")
def subset_anchors(spark, sf_dir):
    rows = spark.range(1, 7).select(F.col("id").alias("size"), dedup.subset_anchors(F.sequence(F.lit(0), F.col("id").cast("int") - 1)).alias("a"))
    return rows.select("size", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("anchors"))


@query(duck("select cast(q.query_id as bigint) as query_id, cast(q.frame_id as bigint) as frame_id, cast(segment_id as bigint) as segment_id from q_random q join segments s on q.frame_id >= s.start_frame and q.frame_id < s.end_frame", "q_random", "segments"))
def lookup_segment(spark, sf_dir):
    return longs(retrieve.lookup_segment(fx.q_random(spark), fx.segments(spark)), "query_id", "frame_id", "segment_id")


@query(duck("select cast(query_id as bigint) as query_id, cast(segment_id as bigint) as segment_id, cast(greatest(q.start_frame, s.start_frame) as bigint) as first, cast(least(q.end_frame, s.end_frame) as bigint) as last from q_seq q join segments s on s.start_frame < q.end_frame and s.end_frame > q.start_frame", "q_seq", "segments"))
def overlap_segments(spark, sf_dir):
    return longs(retrieve.overlap_segments(fx.q_seq(spark), fx.segments(spark)), "query_id", "segment_id", "first", "last")


TILES = "(select * from (values (0,0,4),(1,4,8),(2,8,9),(3,9,12)) as v(segment_id, start_frame, end_frame))"


@query(f"select cast(segment_id as bigint) as segment_id, case when end_frame - start_frame = 1 then start_frame || '.laz' else start_frame || '-' || (end_frame - 1) || '.bin' end as file_name from {TILES}")
def segment_file_name(spark, sf_dir):
    rows = spark.createDataFrame([(0, 0, 4), (1, 4, 8), (2, 8, 9), (3, 9, 12)], "segment_id long, start_frame int, end_frame int")
    return rows.select("segment_id", geometry.segment_file_name(F.col("start_frame"), F.col("end_frame")).alias("file_name"))


@query(f"select case when end_frame - start_frame = 1 then start_frame || '.laz' else start_frame || '-' || (end_frame - 1) || '.bin' end as file_name, cast(start_frame as bigint) as start_frame, cast(end_frame as bigint) as end_frame from {TILES}")
def catalog_from_store(spark, sf_dir):
    from pointloom.sources.readers import catalog_from_names

    names = segment_file_name(spark, sf_dir).select("file_name")
    return catalog_from_names(names).select("file_name", F.col("start_frame").cast("long"), F.col("end_frame").cast("long"))


BOUNDS = "bounds as (select cast(frame_id // 2 as int) as pair_id, min(x) lo_x, max(x) hi_x, min(y) lo_y, max(y) hi_y, min(z) lo_z, max(z) hi_z from points group by 1)"
CELL = "least(32767, greatest(0, cast(ceil(case when hi_{0} > lo_{0} then ({0}-lo_{0})/(hi_{0}-lo_{0}) else 0.0 end * 32768) as int) - 1)) as c{0}"
CELLS = f"{BOUNDS}, cells as (select p.frame_id, p.point_id, b.pair_id, {', '.join(CELL.format(c) for c in XYZ)} from points p join bounds b on p.frame_id // 2 = b.pair_id)"
LEAVES = f"{CELLS}, leaves as (select pair_id, cx, cy, cz, count(*) filter (where frame_id % 2 = 0) as n0, count(*) filter (where frame_id % 2 = 1) as n1 from cells group by all)"
NODES = f"{LEAVES}, nodes as (select pair_id, l as level, cx >> (15-l) as cx, cy >> (15-l) as cy, cz >> (15-l) as cz, sum(n0) as n0, sum(n1) as n1 from leaves cross join (select cast(range as int) as l from range(16)) group by all)"


@query(duck(f"select {b('pair_id', 'pair_id')}, {', '.join(m(f'{n}_{c}', f'{n}_{c}') for c in XYZ for n in ('lo', 'hi'))} from bounds", "points", also=BOUNDS))
def root_bounds(spark, sf_dir):
    return coded(octree.root_bounds(fx.points(spark, sf_dir)), "pair_id", of=tuple(f"{n}_{c}" for c in XYZ for n in ("lo", "hi")))


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir)
    return octree.cells(p, octree.root_bounds(p))


@query(duck(f"select {', '.join(b(c, c) for c in ('frame_id', 'point_id', 'pair_id', 'cx', 'cy', 'cz'))} from cells", "points", also=CELLS))
def octree_cells(spark, sf_dir):
    return longs(celled(spark, sf_dir), "frame_id", "point_id", "pair_id", "cx", "cy", "cz")


@query(duck(f"select {', '.join(b(c, c) for c in ('pair_id', 'cx', 'cy', 'cz', 'n0', 'n1'))} from leaves", "points", also=LEAVES))
def octree_leaves(spark, sf_dir):
    return longs(octree.leaves(celled(spark, sf_dir)))


@query(duck(f"select {b('pair_id', 'pair_id')}, {b('level', 'level')}, {b('count(*)', 'nodes')}, {b('max(greatest(n0, n1))', 'most')} from nodes group by pair_id, level", "points", also=NODES))
def octree_level_counts(spark, sf_dir):
    return longs(octree.level_counts(octree.level_nodes(octree.leaves(celled(spark, sf_dir)))))


@query("select cast(range as bigint) as most, cast(greatest(1, ceil(log2(range + 1))) as bigint) as bits from range(0, 40)")
def bits_needed(spark, sf_dir):
    return spark.range(40).select(F.col("id").alias("most"), geometry.bits_needed(F.col("id")).cast("long").alias("bits"))


@query(duck(f"select {', '.join(b(c, c) for c in ('pair_id', 'cx', 'cy', 'cz', 'n0', 'n1'))} from leaves", "points", also=LEAVES))
def octree_stream(spark, sf_dir):
    """Leaves that went through the bit stream."""
    p = fx.points(spark, sf_dir)
    return longs(octree.deserialise(octree.serialise(octree.leaves(celled(spark, sf_dir)), octree.clouds_of(p))))


OCTREE_BITS = "select cast(pair_id as bigint) as pair_id, cast(count(*) * 3 + sum(case when level < 15 then 8 * (cast(n0 > 0 as int) + cast(n1 > 0 as int)) else 0 end) + sum(case when level = 15 then cast(n0 > 0 as int) + cast(n1 > 0 as int) else 0 end) * greatest(1, ceil(log2(max(case when level = 15 then greatest(n0, n1) end) + 1))) as bigint) as bits from nodes group by pair_id"


@query(duck(OCTREE_BITS, "points", also=NODES))
def octree_stream_bits(spark, sf_dir):
    """Bits of the streams as they are written."""
    p = fx.points(spark, sf_dir)
    return longs(octree.serialise(octree.leaves(celled(spark, sf_dir)), octree.clouds_of(p)).select("pair_id", "bits"))


@query(
    duck(
        "select cast(pair_id as bigint) as pair_id, cast(count(*) * 3 + sum(case when level < 15 then 8 * (cast(n0 > 0 as int) + cast(n1 > 0 as int)) else 0 end) + sum(case when level = 15 then cast(n0 > 0 as int) + cast(n1 > 0 as int) else 0 end) * greatest(1, ceil(log2(max(case when level = 15 then greatest(n0, n1) end) + 1))) as bigint) as bits from nodes group by pair_id",
        "points",
        also=NODES,
    )
)
def octree_size_bits(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return longs(octree.size_bits(octree.level_nodes(octree.leaves(celled(spark, sf_dir))), octree.clouds_of(p)))


CENTRE = ", ".join(m(f"lo_{c} + (c{c} + 0.5) * (hi_{c} - lo_{c}) / 32768", c) for c in XYZ)
REGEN = f"{LEAVES}, made as (select c.frame_id, {CENTRE}, cast(row_number() over (partition by c.frame_id, c.cx, c.cy, c.cz order by point_id) as bigint) as copy from cells c join bounds b on c.pair_id = b.pair_id)"


@query(duck("select cast(frame_id as bigint) as frame_id, x, y, z, copy from made", "points", also=REGEN))
def octree_regenerate(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    bounds = octree.root_bounds(p)
    return coded(octree.regenerate(octree.leaves(octree.cells(p, bounds)), bounds), "frame_id", "copy", of=XYZ)


@query(duck("select cast(q.query_id as bigint) as query_id, cast(made.frame_id as bigint) as frame_id, x, y, z, copy from made join q_random q on q.frame_id = made.frame_id", "points", "q_random", also=REGEN))
def octree_random(spark, sf_dir):
    return coded(baselines.OctreeStore.build(fx.points(spark, sf_dir)).search(fx.q_random(spark)), "query_id", "frame_id", "copy", of=XYZ)


@query(duck("select cast(q.query_id as bigint) as query_id, cast(made.frame_id as bigint) as frame_id, x, y, z, copy from made join q_seq q on made.frame_id >= q.start_frame and made.frame_id < q.end_frame", "points", "q_seq", also=REGEN))
def octree_sequential(spark, sf_dir):
    return coded(baselines.OctreeStore.build(fx.points(spark, sf_dir)).search(fx.q_seq(spark)), "query_id", "frame_id", "copy", of=XYZ)


@query(duck("select cast(query_id as bigint) as query_id, cast(count(distinct f // 2) as bigint) as pair_reads from q_seq cross join (select range as f from range(8)) where f >= start_frame and f < end_frame group by query_id", "q_seq"))
def octree_seq_io(spark, sf_dir):
    return longs(baselines.octree_reads(fx.q_seq(spark), 7))


@query(duck(f"select {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {', '.join(b(f'round_even({c} * 1000, 0)', c + 'q') for c in XYZ)} from points", "points"))
def quantize(spark, sf_dir):
    return fx.points(spark, sf_dir).select(F.col("frame_id").cast("long"), "point_id", *(codec.quantise_even(F.col(c)).alias(f"{c}q") for c in XYZ))


@query(duck(f"select {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {b('v - min(v) over (partition by frame_id)', 'delta')}, {b('min(v) over (partition by frame_id)', 'base')} from (select frame_id, point_id, round_even(x * 1000, 0) as v from points)", "points"))
def delta_for(spark, sf_dir):
    rows = fx.points(spark, sf_dir).select("frame_id", "point_id", codec.quantise_even(F.col("x")).alias("v"))
    return longs(codec.frame_of_reference(rows, "v", "frame_id"), "frame_id", "point_id", "delta", "base")


BYTES = "d as (select frame_id, cast(v - min(v) over (partition by frame_id) as bigint) as delta from (select frame_id, round_even(x * 1000, 0) as v from points))"


@query(duck("select cast(frame_id as bigint) as frame_id, cast((delta >> (8*k)) & 255 as bigint) as byte, cast(count(*) as bigint) as n from d cross join (select cast(range as int) as k from range(4)) group by 1, 2", "points", also=BYTES))
def byte_histogram(spark, sf_dir):
    return longs(codec.byte_counts(delta_for(spark, sf_dir), "delta", "frame_id"))


@query()
def huffman_size(spark, sf_dir):
    return codec.huffman_size(byte_histogram(spark, sf_dir), "frame_id")


@query()
def group_codec(spark, sf_dir):
    return codec.group_codec_sizes(stored(spark, sf_dir))


@query("select cast(o as bigint) as octant, cast(a as bigint) as axis, " + m("case when (o >> a) & 1 = 1 then 1.0 else -2.0 end", "lo") + ", " + m("case when (o >> a) & 1 = 1 then 4.0 else 1.0 end", "hi") + " from (select cast(range as int) as o from range(8)) cross join (select cast(range as int) as a from range(3))")
def child_bounds(spark, sf_dir):
    rows = spark.range(8).select(F.col("id").cast("int").alias("octant"))
    found = None
    for axis in range(3):
        lo, hi = octree.child_bounds(F.lit(-2.0), F.lit(4.0), F.col("octant"), axis)
        one = rows.select(F.col("octant").cast("long"), F.lit(axis).cast("long").alias("axis"), micro(lo).alias("lo"), micro(hi).alias("hi"))
        found = one if found is None else found.unionByName(one)
    return found


COSTS = f"(select * from (values {', '.join(f'({k}, {OPTIONS.time_cost[k]!r}::double, {OPTIONS.score_cost[k]!r}::double)' for k in OPTIONS.time_cost)}) as v(len, t, s))"
MIX = f"""with c as {COSTS}, mixes as (select n4, n3, n2, 48 - 4*n4 - 3*n3 - 2*n2 as n1 from (select cast(range as int) as n4 from range(13)) cross join (select cast(range as int) as n3 from range(17)) cross join (select cast(range as int) as n2 from range(25)) where 4*n4 + 3*n3 + 2*n2 <= 48),
costed as (select *, n4*(select t from c where len=4) + n3*(select t from c where len=3) + n2*(select t from c where len=2) + n1*(select t from c where len=1) as time, n4*(select s from c where len=4) + n3*(select s from c where len=3) + n2*(select s from c where len=2) + n1*(select s from c where len=1) as score from mixes)
select cast(n1 as bigint) as n_1, cast(n2 as bigint) as n_2, cast(n3 as bigint) as n_3, cast(n4 as bigint) as n_4, {m('score', 'score')} from costed where time <= {planner.time_budget(48, 4)!r} order by score, n4 desc, n3 desc, n2 desc limit 1"""


@query(MIX)
def segment_mix_ip(spark, sf_dir):
    mixes = planner.segment_mix(spark, 48, planner.time_budget(48, 4), OPTIONS.time_cost, OPTIONS.score_cost)
    best = mixes.orderBy("score", F.desc("n_4"), F.desc("n_3"), F.desc("n_2")).limit(1)
    return coded(best, "n_1", "n_2", "n_3", "n_4", of=("score",))


@query(f"select cast(n as bigint) as n_frames, {m('(0.75*15.435150146484375::double/3 + 0.25*34.22509431838989::double/4)*n', 'budget')} from (values (24), (48), (100)) as v(n)")
def time_budget(spark, sf_dir):
    return coded(spark.createDataFrame([(n, planner.time_budget(n, 4)) for n in (24, 48, 100)], "n_frames long, budget double"), "n_frames", of=("budget",))


@query("select cast(range as bigint) as segment_id, cast(range*4 as bigint) as start_frame, cast(range*4+4 as bigint) as end_frame from range(6)")
def segments_direct(spark, sf_dir):
    return longs(planner.direct_segments(spark, 24, 4))


@query(f"select cast(range as bigint) as block, {m('case when abs(range-5) <= 4 then greatest(1.0 + 20.0*0.3*exp(-((range-5)*(range-5))/8.0), exp(-6.0)) else 1.0 end', 'score')} from range(12)")
def gaussian_smooth(spark, sf_dir):
    """The planner's own step, for scores of one and nothing selected."""
    scores = planner.smoothed(np.ones(12), np.zeros(12, bool), 5, 0.3)
    return coded(spark.createDataFrame(list(enumerate(scores.tolist())), "block long, score double"), "block", of=("score",))


GAINS = "(select range as seq, 10.0 + 3.0*sin(range) as gain from range(10))"


@query(f"select seq, {m('a', 'avg')}, {m('(gain - a) / a', 'reward')} from (select seq, gain, case when seq = 0 then 1.0 else avg(gain) over (order by seq rows unbounded preceding) end as a from {GAINS})")
def bandit_reward(spark, sf_dir):
    """Rewards as the planner's loop computes them, and the averages by an expression."""
    gains = [10.0 + 3.0 * math.sin(k) for k in range(10)]
    own = [(k, planner.reward_of(g, sum(gains[: k + 1]), k)) for k, g in enumerate(gains)]
    rows = spark.range(10).select(F.col("id").alias("seq"), (10.0 + 3.0 * F.sin("id")).alias("gain"))
    avg = planner.rewards(rows).select("seq", "avg")
    return coded(avg.join(spark.createDataFrame(own, "seq long, reward double"), "seq"), "seq", of=("avg", "reward"))


@query("select cast(range as bigint) as query_id, cast(range*11 % 100 as bigint) as start_frame, cast(least(range*11 % 100 + 30, 100) as bigint) as end_frame from range(10)")
def workload_clip(spark, sf_dir):
    start = (F.col("id") * 11 % 100).cast("int")
    a, e = planner.clipped(start, 30, 100)
    return spark.range(10).select(F.col("id").alias("query_id"), a.cast("long").alias("start_frame"), e.cast("long").alias("end_frame"))


QUANT = ", ".join([m(f"round({c} * 10000) / 10000.0", c) for c in XYZ] + [m("floor(intensity * 32767) / 32767.0", "intensity")])


@query(duck(f"select {b('q.query_id', 'query_id')}, {b('p.frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {QUANT} from points p join q_random q on p.frame_id = q.frame_id", "points", "q_random"))
def laz_random(spark, sf_dir):
    return coded(baselines.quantised_search(fx.q_random(spark), codec.encode(fx.points(spark, sf_dir))), "query_id", "frame_id", "point_id")


@query(duck(f"select {b('query_id', 'query_id')}, {b('frame_id', 'frame_id')}, {b('point_id', 'point_id')}, {QUANT} from points p join q_seq q on p.frame_id >= q.start_frame and p.frame_id < q.end_frame", "points", "q_seq"))
def laz_sequential(spark, sf_dir):
    return coded(baselines.quantised_search(fx.q_seq(spark), codec.encode(fx.points(spark, sf_dir))), "query_id", "frame_id", "point_id")


@query(f"select range as id, {m('((0.37*range - 9) % pi() + pi()) % pi()', 'half')}, {m('((0.37*range - 9) % (2*pi()) + 2*pi()) % (2*pi())', 'whole')}, {m('abs(atan2(sin(0.37*range - 9 - 1.1), cos(0.37*range - 9 - 1.1)))', 'turn')} from range(60)")
def angle_diff(spark, sf_dir):
    a = 0.37 * F.col("id") - 9
    return spark.range(60).select("id", micro(geometry.normalise_angle(a)).alias("half"), micro(geometry.normalise_angle(a, 2.0)).alias("whole"), micro(geometry.angle_difference(a, F.lit(1.1))).alias("turn"))


def _pairs_sql(filter_1: str, filter_2: str, angle: str, modulus: str) -> str:
    turned = f"(({{}}.theta % ({modulus})) + {modulus}) % ({modulus})"
    diff = f"abs(atan2(sin({turned.format('a')} - {turned.format('c')}), cos({turned.format('a')} - {turned.format('c')})))"
    return f"""det_pairs as (select a.frame_id, a.label, a.box_idx as box_1, c.box_idx as box_2 from detections a join detections c on a.frame_id = c.frame_id and a.label = c.label
where a.source = 'reconstructed' and c.source = 'raw' and {filter_1} and {filter_2} and sqrt((a.bx-c.bx)*(a.bx-c.bx) + (a.by_-c.by_)*(a.by_-c.by_) + (a.bz-c.bz)*(a.bz-c.bz)) < 1.5
and ({diff} < {angle} or (abs(a.l-a.w) < 0.01 and abs(c.l-c.w) < 0.01 and abs({diff} - pi()) < {angle})))"""


FWD = _pairs_sql("a.score > 0.45", "c.score > 0.45", "pi()/10", "pi()")


@query(duck(f"select {', '.join(b(c, c) for c in ('frame_id', 'label', 'box_1', 'box_2'))} from det_pairs", "detections", also=FWD))
def det_pairs_fwd(spark, sf_dir):
    return longs(evaluate.candidate_pairs(*evaluate.sides(fx.detections(spark, sf_dir), 0.45)))


@query(duck(f"select {', '.join(b(c, c) for c in ('frame_id', 'box_idx'))} from detections d where source = 'raw' and score > 0.45 and not exists (select 1 from det_pairs p where p.frame_id = d.frame_id and p.box_2 = d.box_idx)", "detections", also=FWD))
def det_unmatched(spark, sf_dir):
    """Raw boxes without any candidate."""
    found, raw = evaluate.sides(fx.detections(spark, sf_dir), 0.45)
    return longs(evaluate.unmatched(raw, evaluate.candidate_pairs(found, raw), "box_2"), "frame_id", "box_idx")


@query()
def det_match_fwd(spark, sf_dir):
    return evaluate.forward_match(fx.detections(spark, sf_dir))


@query()
def det_match_rev(spark, sf_dir):
    return evaluate.reverse_match(fx.detections(spark, sf_dir))


@query()
def det_accuracy(spark, sf_dir):
    d = fx.detections(spark, sf_dir)
    raw = d.where("source = 'raw' and score > 0.5")
    return evaluate.accuracy(fx.poses(spark), evaluate.reverse_match(d), raw)


@query()
def greedy_match(spark, sf_dir):
    return dedup.greedy_match(fx.points(spark, sf_dir), fx.segments(spark), fx.poses(spark))


@query()
def greedy_pair_match(spark, sf_dir):
    near = neighbours.knn_join(fx.points(spark, sf_dir), segment_pairs(spark), OPTIONS.neighbours)
    return dedup.greedy_pairs(near)


@query()
def dedup_patches(spark, sf_dir):
    return dedup.patches(stored(spark, sf_dir))


@query()
def dedup_modes(spark, sf_dir):
    """Stored points by mode and segment."""
    found = None
    for mode in ("both", "relative", "absolute"):
        one = dedup.patches(stored(spark, sf_dir, Options(relative_absolute=mode))).groupBy("segment_id").agg(F.sum("n_points").alias("stored"))
        one = one.select(F.lit(mode).alias("mode"), "segment_id", "stored")
        found = one if found is None else found.unionByName(one)
    return found


@query()
def dedup_intensity(spark, sf_dir):
    """Patch points with one shared intensity and with one a frame."""
    p = dedup.patches(stored(spark, sf_dir, Options(deduplicate_intensity=True))).where("size(subset) > 1")
    return p.groupBy("segment_id", "intensity_signal").agg(F.sum("n_points").alias("n_points"))


@query()
def remaining_points(spark, sf_dir):
    rows = stored(spark, sf_dir).where("size(subset) = 1")
    return rows.select("segment_id", F.col("anchor").alias("frame_rel"), F.col("point_ids")[0].alias("point_id"), *XYZ)


@query()
def frame_patch_index(spark, sf_dir):
    return dedup.frame_patches(dedup.patches(stored(spark, sf_dir)))


@query()
def stored_fraction(spark, sf_dir):
    return dedup.stored_fraction(dedup.patches(stored(spark, sf_dir)), fx.points(spark, sf_dir))


def search(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    wanted = retrieve.wanted_frames(queries, fx.segments(spark), fx.FRAMES)
    return retrieve.reconstruct(wanted, store.tables(kept(spark, sf_dir)), fx.segments(spark), fx.poses(spark))


@query()
def random_search(spark, sf_dir):
    return search(spark, sf_dir, fx.q_random(spark))


@query()
def sequential_search(spark, sf_dir):
    return search(spark, sf_dir, fx.q_seq(spark))


@query()
def reconstruct_points(spark, sf_dir):
    everything = spark.range(fx.FRAMES).select(F.lit(0).alias("query_id"), F.col("id").cast("int").alias("frame_id"))
    return search(spark, sf_dir, everything)


@query(duck("select cast(frame_id as bigint) as frame_id, cast(count(*) as bigint) as n_points from points group by frame_id", "points"))
def reconstruct_counts(spark, sf_dir):
    """Points of each frame after going through the store: as many as were read."""
    return longs(reconstruct_points(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("n_points")))


@query(duck("select cast(query_id as bigint) as query_id, cast(frame_id as bigint) as frame_id, cast(count(*) as bigint) as n_points from points p join q_seq q on p.frame_id >= q.start_frame and p.frame_id < q.end_frame group by 1, 2", "points", "q_seq"))
def seq_frame_counts(spark, sf_dir):
    return longs(sequential_search(spark, sf_dir).groupBy("query_id", "frame_id").agg(F.count("*").alias("n_points")))


@query(duck("select cast(sum(n) as bigint) as stored_appearances, cast(count(*) as bigint) as frames from (select frame_id, count(*) as n from points group by frame_id)", "points"))
def conservation(spark, sf_dir):
    """Each stored point stands for one point in each frame of its subset: in sum, all points that were read."""
    p = dedup.patches(stored(spark, sf_dir))
    total = p.agg(F.sum(F.col("n_points") * F.size("subset")).alias("stored_appearances"))
    return total.select("stored_appearances", F.lit(fx.FRAMES).cast("long").alias("frames"))


@query()
def seq_io_cost(spark, sf_dir):
    rows = kept(spark, sf_dir)
    return retrieve.io_cost(retrieve.wanted_frames(fx.q_seq(spark), fx.segments(spark)), store.tables(rows), store.patch_blobs(rows))


@query(duck("select round(sum(n) * 16 / 1024.0, 6) as kb from (select count(*) as n from points)", "points"))
def disk_consume(spark, sf_dir):
    """KB of the files in a folder: frames as they are written."""
    return store.disk_consume(spark, written_frames(spark, sf_dir)).select(F.round("kb", 6).alias("kb"))


@query()
def segment_sizes(spark, sf_dir):
    return store.segment_sizes(kept(spark, sf_dir))


@query()
def block_gain(spark, sf_dir):
    single = spark.range(fx.FRAMES).select(F.col("id").cast("int").alias("segment_id"), F.col("id").cast("int").alias("start_frame"), (F.col("id") + 1).cast("int").alias("end_frame"))
    p, q = fx.points(spark, sf_dir), fx.poses(spark)
    alone = store.segment_sizes(dedup.dedup(p, single, q)).select(F.floor(F.col("segment_id") / 4).alias("block"), "kb")
    joint = store.segment_sizes(stored(spark, sf_dir)).select(F.col("segment_id").cast("long").alias("block"), "kb")
    return store.block_gain(alone, joint)


@query("select cast(range as bigint) as frame_id, cast(1 as bigint) as n_segments from range(100)")
def segments_cover(spark, sf_dir):
    """The planner's assignment of a mix of lengths covers each of 100 frames once."""
    mix = planner.best_mix(spark, 100, planner.time_budget(100, 4), OPTIONS.time_cost, OPTIONS.score_cost)
    placed = planner.assign_segments(100, mix, lambda blocks: [10.0 + 3.0 * math.sin(s) for s, _ in blocks], OPTIONS.seed)
    rows = spark.createDataFrame([(k, s, e) for k, (s, e) in enumerate(placed)], "segment_id int, start_frame int, end_frame int")
    return longs(planner.covers(rows, 100))


@query(duck("select cast(query_id as bigint) as query_id, cast(p.frame_id as bigint) as frame_id, cast(count(*) as bigint) as n_points, cast(0 as bigint) as too_far from points p join q_random q on p.frame_id = q.frame_id group by 1, 2", "points", "q_random"))
def random_search_bounds(spark, sf_dir):
    """For each lookup the points that came out of the store, and how many of them are farther from all points of the raw frame than a
    shared point may be from the one that it stands for: the soft threshold, and the step of the stored coordinates."""
    # found is computed twice, and its rows may come in another order: an id by coordinates is the same both times
    found = random_search(spark, sf_dir).withColumn("point_id", F.row_number().over(Window.partitionBy("query_id", "frame_id").orderBy(*XYZ)).cast("long"))
    radius = OPTIONS.soft_distance_ratio * OPTIONS.distance_threshold + 1e-3
    made = found.select((F.col("frame_id") + 100).cast("int").alias("frame_id"), "query_id", "point_id", *XYZ)
    both = made.drop("query_id").unionByName(fx.points(spark, sf_dir).select("frame_id", "point_id", *XYZ))
    pairs = spark.createDataFrame([(f + 100, f) for _, f in fx.Q_RANDOM], "anchor_frame int, frame_id int")
    near = neighbours.radius_join(both, pairs, radius).select("frame_id", F.col("anchor_id").alias("point_id")).distinct()
    far = found.select("query_id", "frame_id", "point_id").join(near.withColumn("near", F.lit(1)), ["frame_id", "point_id"], "left")
    return longs(far.groupBy("query_id", "frame_id").agg(F.count("*").alias("n_points"), F.count_if(F.col("near").isNull()).alias("too_far")))
