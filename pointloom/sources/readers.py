"""Readers of a sequence's files: frames, poses, calibration, workloads, and the catalog of a store's file names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINTS = "frame_id int, point_id long, x float, y float, z float, intensity float"


def frame_catalog(spark: SparkSession, folder: str, ext: str = ".bin") -> DataFrame:
    """(frame_id, file_name, n_points, file_bytes): a frame's id is its rank among its folder's sorted names. Only names and
    sizes are read; a path that matches many folders has each ranked by itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    order = Window.partitionBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).orderBy("file_name")
    named = files.select("path", name.alias("file_name"), F.col("length").alias("file_bytes"))
    return named.select((F.row_number().over(order) - 1).cast("int").alias("frame_id"), "file_name", F.floor(F.col("file_bytes") / 16).alias("n_points"), "file_bytes", "path")


def read_frames(spark: SparkSession, folder: str, ext: str = ".bin") -> DataFrame:
    """Points of all frame files: little-endian float32 x, y, z, intensity in turn (.npy: the same after a header). A point's id
    is its place in the file; bytes after the last whole point are an error."""
    catalog = frame_catalog(spark, folder, ext).select("frame_id", "path")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(folder).select("path", "content").join(catalog, "path")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in it:
            for frame, path, content in zip(batch.column("frame_id").to_pylist(), batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                flat = np.load(io.BytesIO(content)).astype("<f4").ravel() if path.endswith(".npy") else np.frombuffer(content, "<f4") if len(content) % 4 == 0 else np.empty(1)
                if len(flat) % 4:
                    raise ValueError(f"{path} doesn't hold whole points")
                xyzi = flat.reshape(-1, 4)
                n = len(xyzi)
                for start in range(0, n, 500_000):
                    part = xyzi[start : start + 500_000]
                    cols = [pa.array(np.full(len(part), frame, np.int32)), pa.array(np.arange(start, start + len(part), dtype=np.int64)), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(4))]
                    yield pa.RecordBatch.from_arrays(cols, ["frame_id", "point_id", "x", "y", "z", "intensity"])

    return files.select("frame_id", "path", "content").mapInArrow(run, POINTS)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, pose) of a text file with 12 numbers a line; a frame's id is its line. The file is read as one value, as the
    number of a line isn't known to a split of it."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.rtrim(F.col("value")), r"\r?\n")).alias("frame_id", "line"))
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double"))
    return lines.where("trim(line) <> ''").select("frame_id", numbers.alias("pose"))


def read_calibration(spark: SparkSession, path: str) -> tuple[float, ...]:
    """The 4 x 4 matrix of the first line that begins with Tr:, row-major; ValueError if there is none."""
    row = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?m)^Tr:\s*(.*)$", 1).alias("tr")).first()
    values = [float(v) for v in (row["tr"] if row else "").split()]
    if len(values) != 12:
        raise ValueError(f"{path} has no line Tr: with 12 numbers")
    return (*values, 0.0, 0.0, 0.0, 1.0)


def read_pose_json(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, pose) of a JSON document of quaternion poses, ordered by their ids as numbers; frames are numbered anew."""
    from pointloom.functions.geometry import quaternion_to_pose

    schema = "frames array<struct<frame_id:string,pose:array<double>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("frames"))
    order = Window.orderBy(F.col("frame_id").cast("long"))  # a row a frame of one sequence
    return rows.select((F.row_number().over(order) - 1).cast("int").alias("id"), quaternion_to_pose(F.col("pose")).alias("pose")).withColumnRenamed("id", "frame_id")


def read_workload(spark: SparkSession, folder: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, frame_id) and (query_id, start_frame, end_frame) of a sequence's two query files; a missing file is empty."""
    from pyspark.errors import AnalysisException

    def load(name: str, kind: str) -> DataFrame:
        try:
            text = spark.read.text(f"{folder}/{name}_{sequence}.json", wholetext=True)
        except AnalysisException as why:
            if "PATH_NOT_FOUND" not in str(why):
                raise
            text = spark.createDataFrame([], "value string")
        return text.select(F.posexplode(F.from_json("value", f"array<{kind}>")).alias("query_id", "q"))

    random = load("random_queries", "int").select("query_id", F.col("q").alias("frame_id"))
    return random, load("sequential_queries", "array<int>").select("query_id", F.col("q")[0].alias("start_frame"), F.col("q")[1].alias("end_frame"))


def catalog_from_names(names: DataFrame, column: str = "file_name") -> DataFrame:
    """(start_frame, end_frame) of a store's file names: a-b.bin is [a, b + 1), a.laz is [a, a + 1); other names are an error."""
    n = F.col(column)
    a, b = F.regexp_extract(n, r"^(\d+)-(\d+)\.bin$", 1), F.regexp_extract(n, r"^(\d+)-(\d+)\.bin$", 2)
    single = F.regexp_extract(n, r"^(\d+)\.laz$", 1)
    bad = F.raise_error(F.concat(F.lit("not a segment's name: "), n)).cast("int")
    start = F.when(a != "", a.try_cast("int")).when(single != "", single.try_cast("int")).otherwise(bad)
    end = F.when(b != "", b.try_cast("int") + 1).otherwise(single.try_cast("int") + 1)
    return names.select(n.alias("file_name"), start.alias("start_frame"), end.alias("end_frame"))
