"""python -m pointloom.cli: builds a sequence's store by one of four methods, runs its workload, and writes a metrics document.

The sequence's folder has frame files, and poses.txt with calib.txt or <sequence>.json; the workload folder has
random_queries_<sequence>.json and sequential_queries_<sequence>.json. Folders must be shared by driver and executors."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.log import create_logger
from pointloom.operators import baselines, dedup, evaluate, planner, retrieve, store
from pointloom.options import Options
from pointloom.sources import readers, writers

METHODS = ("dedup", "octree", "laz", "raw")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    d = Options()
    p.add_argument("--method", choices=METHODS, default="dedup")
    p.add_argument("--data_path", required=True)
    p.add_argument("--sequence_id", default="01")
    p.add_argument("--ext", default=".bin")
    p.add_argument("--query_path", required=True)
    p.add_argument("--root_store_path", required=True)
    p.add_argument("--results", required=True)
    p.add_argument("--log_file")
    p.add_argument("--detections", help="Parquet of frame_id, source, box_idx, label, score, box; without it accuracies are null")
    p.add_argument("--deduplicate_intensity", action="store_true")
    p.add_argument("--same_segment", action="store_true")
    p.add_argument("--relative_absolute", choices=("both", "relative", "absolute"), default=d.relative_absolute)
    for name in ("intensity_threshold", "distance_threshold", "soft_distance_ratio", "intensity_scale", "time_budget"):
        p.add_argument(f"--{name}", type=float, default=getattr(d, name))
    for name in ("max_cluster_length", "seed"):
        p.add_argument(f"--{name}", type=int, default=getattr(d, name))
    return p.parse_args(argv)


def load_poses(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, tuple[float, ...]]:
    """Poses and calibration: of the text files, or of the JSON document, whose calibration is the identity."""
    from pyspark.errors import AnalysisException

    try:
        poses = readers.read_poses(spark, f"{args.data_path}/poses.txt")
    except AnalysisException as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        return readers.read_pose_json(spark, f"{args.data_path}/{args.sequence_id}.json"), Options().tr
    return poses, readers.read_calibration(spark, f"{args.data_path}/calib.txt")


def build(spark: SparkSession, args: argparse.Namespace, options: Options, points: DataFrame, poses: DataFrame, n_frames: int):
    """(searches by a DataFrame of queries, KB by query or None, segments, stored fraction)."""
    root = f"{args.root_store_path}/{args.method}_{args.sequence_id}"
    whole = spark.createDataFrame([(f, f, f + 1) for f in range(n_frames)], "segment_id int, start_frame int, end_frame int")
    one = spark.createDataFrame([(1.0,)], "fraction double")
    if args.method == "raw":
        return lambda q: baselines.raw_search(q, points), None, whole, one
    if args.method == "laz":
        baselines.write_quantised(points, root)
        coded = spark.read.parquet(root)
        return lambda q: baselines.quantised_search(q, coded), None, whole, one
    if args.method == "octree":
        baselines.OctreeStore.build(points).write(root)
        return baselines.OctreeStore.open(spark, root).search, None, whole, one
    length = min(options.max_cluster_length, n_frames)
    placed = planner.plan(spark, n_frames, planner.measured_gains(points, poses, options, length), options)
    segments = spark.createDataFrame([(k, s, e) for k, (s, e) in enumerate(placed)], "segment_id int, start_frame int, end_frame int")
    store.write(dedup.dedup(points, segments, poses, options), root, options)
    tables = store.read(spark, root)
    stored = spark.read.parquet(f"{root}/stored")
    blobs = store.patch_blobs(stored, options)

    def search(queries: DataFrame) -> DataFrame:
        return retrieve.reconstruct(retrieve.wanted_frames(queries, segments, n_frames), tables, segments, poses, options)

    def cost(queries: DataFrame) -> DataFrame:
        return retrieve.io_cost(retrieve.wanted_frames(queries, segments), tables, blobs)

    return search, cost, segments, dedup.stored_fraction(tables["patches"], points)


def measured(spark: SparkSession, queries: DataFrame, search, cost, catalog: DataFrame) -> DataFrame:
    """(query_id, load_time, io_cost) with each query run by itself, as a workload of lookups arrives. Without a cost function
    a query reads the whole files of its frames."""
    rows = []
    for q in queries.orderBy("query_id").collect():  # a workload is a list of a hundred or so
        one = spark.createDataFrame([q], queries.schema)
        began = time.perf_counter()
        search(one).write.format("noop").mode("overwrite").save()
        rows.append((q["query_id"], time.perf_counter() - began))
    times = spark.createDataFrame(rows, "query_id int, load_time double")
    if cost is None:
        kb = baselines.frames_of(queries).join(catalog, "frame_id").groupBy("query_id").agg((F.sum("file_bytes") / 1024).alias("kb"))
    else:
        kb = cost(queries)
    return times.join(kb.select("query_id", F.col("kb").alias("io_cost")), "query_id", "left")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    log = create_logger(path=args.log_file)
    catalog = readers.frame_catalog(spark, args.data_path, args.ext)
    n_frames = catalog.count()
    points = readers.read_frames(spark, args.data_path, args.ext).withColumns({c: F.col(c).cast("double") for c in ("x", "y", "z", "intensity")})
    poses, tr = load_poses(spark, args)
    random, sequential = readers.read_workload(spark, args.query_path, args.sequence_id)
    names = ("distance_threshold", "soft_distance_ratio", "max_cluster_length", "relative_absolute", "deduplicate_intensity", "intensity_threshold", "intensity_scale", "time_budget", "same_segment", "seed")
    options = Options(tr=tr, **{n: getattr(args, n) for n in names})
    log.info("%d frames, method %s", n_frames, args.method)
    began = time.perf_counter()
    search, cost, segments, fraction = build(spark, args, options, points, poses, n_frames)
    seconds = time.perf_counter() - began
    log.info("built in %.1f s", seconds)
    lookups, ranges = (measured(spark, q, search, cost, catalog) for q in (random, sequential))
    accuracy = None
    if args.detections:
        boxes = spark.read.parquet(args.detections)
        accuracy = evaluate.accuracy(catalog, evaluate.reverse_match(boxes), boxes.where("source = 'raw' and score > 0.5"))
    lookups = lookups.join(random, "query_id")
    lookups = lookups.join(accuracy.select("frame_id", "accuracy"), "frame_id", "left") if accuracy is not None else lookups.withColumn("accuracy", F.lit(None).cast("double"))
    root = args.data_path if args.method == "raw" else f"{args.root_store_path}/{args.method}_{args.sequence_id}"
    out = evaluate.metrics(lookups, ranges, segments, store.disk_consume(spark, root), fraction, seconds)
    writers.write_metrics(out, args.results)
    return spark.read.json(args.results)


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("pointloom").getOrCreate()
    run(spark, arguments(argv)).show(truncate=False)


if __name__ == "__main__":
    main()
