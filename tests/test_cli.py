"""The command line over a small sequence on disk, by each method."""

import json

import numpy as np
import pytest

from pointloom import cli
from pointloom.plans import fixture as fx
from pointloom.sources import writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sequence(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sequence")
    data, queries = root / "data", root / "queries"
    queries.mkdir()
    writers.write_frames(fx.points(spark, SF), str(data))
    poses = fx.poses(spark).orderBy("frame_id").collect()
    (data / "poses.txt").write_text("\n".join(" ".join(map(str, r["pose"])) for r in poses))
    (data / "calib.txt").write_text("Tr: " + " ".join(map(str, np.eye(4)[:3].ravel())))
    (queries / "random_queries_01.json").write_text("[0, 5]")
    (queries / "sequential_queries_01.json").write_text("[[2, 6]]")
    return root


@pytest.mark.parametrize("method", cli.METHODS)
def test_benchmark(spark, sequence, tmp_path, method):
    args = ["--method", method, "--data_path", f"{sequence}/data", "--query_path", f"{sequence}/queries", "--root_store_path", str(tmp_path / "store"), "--results", str(tmp_path / "out"), "--time_budget", "1.0"]
    if method == "dedup":
        boxes = str(tmp_path / "boxes")
        fx.detections(spark, SF).write.parquet(boxes)
        args += ["--detections", boxes]
    row = cli.run(spark, cli.arguments(args)).first().asDict(recursive=True)
    assert len(row["random"]["load_time"]) == 2 and len(row["sequential"]["io_cost"]) == 1 and row["disk_consume"] > 0
    assert json.dumps(row["segment_counts"]) == ('{"4": 2}' if method == "dedup" else '{"1": 8}')
    assert (row["deduplicated_percentage"] < 0.5) == (method == "dedup")
