"""The store of a deduplicated sequence: geometry once, one intensity channel per frame, and what its parts weigh.

Three tables, each partitioned by segment: patches (one row a patch), patch_points (quantised geometry) and patch_intensity (one
row a point and channel). A lookup prunes segments by partition, patches by the subset and channels by a filter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.codec import delta_blob, intensity_code, quantise
from pointloom.operators.dedup import patches
from pointloom.options import Options

TABLES = ("patches", "patch_points", "patch_intensity")


def patch_points(stored: DataFrame, options: Options = Options()) -> DataFrame:
    return stored.select("segment_id", "patch_id", "ord", *(quantise(F.col(c), options.coordinate_scale).alias(f"{c}q") for c in "xyz"))


def patch_intensity(stored: DataFrame, options: Options = Options()) -> DataFrame:
    """(segment_id, patch_id, channel, frame_rel, ord, iq). A shared channel has the number 0 and no frame of its own."""
    long = stored.select("segment_id", "patch_id", "subset", "intensity_signal", "ord", F.posexplode("intensities").alias("channel", "intensity"))
    frame = F.when(~F.col("intensity_signal"), F.get("subset", F.col("channel")))
    return long.select("segment_id", "patch_id", "channel", frame.alias("frame_rel"), "ord", intensity_code(F.col("intensity"), options.intensity_scale).alias("iq"))


def tables(stored: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    return {"patches": patches(stored), "patch_points": patch_points(stored, options), "patch_intensity": patch_intensity(stored, options)}


def write(stored: DataFrame, path: str, options: Options = Options()) -> None:
    """Writes the store. stored is written first, so that segments are matched once and not once a table."""
    spark = stored.sparkSession
    stored.write.mode("overwrite").partitionBy("segment_id").parquet(f"{path}/stored")
    kept = spark.read.schema(stored.schema).parquet(f"{path}/stored")
    for name, df in tables(kept, options).items():
        by = ["patch_id", "channel", "ord"] if name == "patch_intensity" else ["patch_id", "ord"] if name == "patch_points" else ["patch_id"]
        df.repartition("segment_id").sortWithinPartitions("segment_id", *by).write.mode("overwrite").partitionBy("segment_id").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    schemas = {
        "patches": "patch_id int, subset array<int>, anchor int, intensity_signal boolean, transposed boolean, n_points long, segment_id int",
        "patch_points": "patch_id int, ord int, xq int, yq int, zq int, segment_id int",
        "patch_intensity": "patch_id int, channel int, frame_rel int, ord int, iq int, segment_id int",
    }
    return {name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in schemas.items()}


BLOB = "segment_id int, patch_id int, channel int, n_bytes long"


def patch_blobs(stored: DataFrame, options: Options = Options()) -> DataFrame:
    """Encoded bytes of each patch's geometry (channel -1) and channels. A group is a patch, which is bounded by its segment."""
    geometry = patch_points(stored, options)
    channels = patch_intensity(stored, options).select("segment_id", "patch_id", "channel", "ord", F.array("iq").alias("v"))
    rows = geometry.select("segment_id", "patch_id", F.lit(-1).alias("channel"), "ord", F.array("xq", "yq", "zq").alias("v")).unionByName(channels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("ord")["v"].tolist()
        size = sum(len(delta_blob([v[k] for v in values])) for k in range(len(values[0])))
        return pd.DataFrame({"segment_id": [pdf["segment_id"].iloc[0]], "patch_id": [pdf["patch_id"].iloc[0]], "channel": [pdf["channel"].iloc[0]], "n_bytes": [size]})

    return rows.groupBy("segment_id", "patch_id", "channel").applyInPandas(run, BLOB)


#: Bytes of a segment beside its blobs: a header, the entries of the frame index, and six lengths at its end.
HEADER, TRAILER = 4, 24


def segment_sizes(stored: DataFrame, options: Options = Options()) -> DataFrame:
    """(segment_id, kb): the blobs and the index of a segment, without writing anything."""
    blobs = patch_blobs(stored, options).groupBy("segment_id").agg(F.sum("n_bytes").alias("bytes"))
    index = patches(stored).groupBy("segment_id").agg((F.sum(F.size("subset")) * 4 + F.countDistinct(F.element_at("subset", 1)) * 8 + HEADER + TRAILER).alias("meta"))
    return blobs.join(index, "segment_id").select("segment_id", ((F.col("bytes") + F.col("meta")) / 1024).alias("kb"))


def block_gain(single: DataFrame, joint: DataFrame) -> DataFrame:
    """(block, gain) of two size tables (block, kb): KB of single frames less KB of long segments."""
    a, b = (df.groupBy("block").agg(F.sum("kb").alias(n)) for df, n in ((single, "single"), (joint, "joint")))
    return a.join(b, "block").select("block", (F.col("single") - F.col("joint")).alias("gain"))


def disk_consume(spark: SparkSession, path: str) -> DataFrame:
    """KB of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / 1024).alias("kb"))
