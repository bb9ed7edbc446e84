"""New frame files as a stream: points as they arrive, and counts by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_frames(spark: SparkSession, folder: str, ext: str = ".bin", files_a_batch: int = 64) -> DataFrame:
    """A row a file as it arrives: (file_name, modified, n_points). Points themselves are read of a batch's files by read_frames
    or unpacked in foreachBatch; here only sizes are taken, so the content column is pruned."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{ext}").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("modificationTime").alias("modified"), F.floor(F.col("length") / 16).alias("n_points"))


def points_by_window(files: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, files, points) of arrivals; state of windows past the watermark is dropped."""
    return files.withWatermark("modified", late).groupBy(F.window("modified", window)).agg(F.count("*").alias("files"), F.sum("n_points").alias("points"))
