"""Writers: frames as float32 files, and the metrics document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def frame_blobs(points: DataFrame) -> DataFrame:
    """(frame_id, content): a frame's points in order as float32 x, y, z, intensity; without an intensity column it is 0."""
    if "intensity" not in points.columns:
        points = points.withColumn("intensity", F.lit(0.0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "content": [pdf[["x", "y", "z", "intensity"]].to_numpy("<f4").tobytes()]})

    return points.select("frame_id", "point_id", "x", "y", "z", "intensity").groupBy("frame_id").applyInPandas(run, "frame_id int, content binary")


class FrameFiles(DataSource):
    """format("pcbin"): writes (frame_id int, content binary) as one file a frame, in a folder that driver and executors share.

    A file is written under another name and renamed, so a task that is run again leaves the same files."""

    @classmethod
    def name(cls) -> str:
        return "pcbin"

    def schema(self) -> str:
        return "frame_id int, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FrameWriter(self.options["path"], self.options.get("ext", ".bin"))


class _FrameWriter(DataSourceWriter):
    def __init__(self, path: str, ext: str):
        self.path, self.ext = path.removeprefix("file://"), ext

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            target = os.path.join(self.path, f"{row['frame_id']:06d}{self.ext}")
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, target)
        return WriterCommitMessage()


def write_frames(points: DataFrame, path: str, ext: str = ".bin") -> None:
    points.sparkSession.dataSource.register(FrameFiles)
    frame_blobs(points).write.format("pcbin").option("ext", ext).mode("append").save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one-row metrics document as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def pad_width(rows: np.ndarray) -> np.ndarray:
    """(n, 3) points with an intensity of 0 added; other widths than 3 and 4 are an error."""
    if rows.ndim != 2 or rows.shape[1] not in (3, 4):
        raise ValueError("points have three or four columns")
    return rows if rows.shape[1] == 4 else np.column_stack([rows, np.zeros(len(rows), rows.dtype)])
