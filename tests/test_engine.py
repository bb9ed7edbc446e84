"""Sources, sinks, codecs, planner, octree and evaluation in small cases."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.functions import codec
from pointloom.operators import baselines, evaluate, octree, planner
from pointloom.options import Options
from pointloom.plans import fixture as fx
from pointloom.plans.registry import QUERIES
from pointloom.sources import readers, writers
from pointloom.streaming import frames as streaming

SF = "/root/testdata/sf0.001"


def test_frames_there_and_back(spark, tmp_path):
    folder = str(tmp_path / "frames")
    p = fx.points(spark, SF).where("frame_id < 3")
    writers.write_frames(p, folder)
    catalog = readers.frame_catalog(spark, folder).toPandas()
    assert catalog.file_name.tolist() == ["000000.bin", "000001.bin", "000002.bin"] and catalog.n_points.sum() == p.count()
    got = readers.read_frames(spark, folder).toPandas().sort_values(["frame_id", "point_id"])
    want = p.toPandas().sort_values(["frame_id", "point_id"])
    assert np.allclose(got[["x", "y", "z", "intensity"]].to_numpy(), want[["x", "y", "z", "intensity"]].to_numpy(np.float32))
    writers.write_frames(p.drop("intensity").where("frame_id = 0"), folder)
    assert readers.read_frames(spark, folder).where("frame_id = 0").agg(F.max("intensity")).first()[0] == 0


def test_broken_frame_is_an_error(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0" * 20)
    with pytest.raises(Exception, match="whole points"):
        readers.read_frames(spark, str(tmp_path)).collect()


def test_poses_and_calibration(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("1 0 0 1.5 0 1 0 0 0 0 1 0\n0 -1 0 2 1 0 0 0 0 0 1 3\n")
    rows = readers.read_poses(spark, str(tmp_path / "poses.txt")).orderBy("frame_id").collect()
    assert [r["frame_id"] for r in rows] == [0, 1] and rows[1]["pose"][:4] == [0, -1, 0, 2]
    (tmp_path / "calib.txt").write_text("P0: 1 2\nTr: 1 0 0 0.5 0 1 0 0 0 0 1 0\n")
    assert readers.read_calibration(spark, str(tmp_path / "calib.txt")) == (1, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    (tmp_path / "none.txt").write_text("P0: 1\n")
    with pytest.raises(ValueError):
        readers.read_calibration(spark, str(tmp_path / "none.txt"))
    (tmp_path / "p.json").write_text(json.dumps({"frames": [{"frame_id": "10", "pose": [0, 0, 0, 1, 1, 2, 3]}, {"frame_id": "9", "pose": [0, 0, 1, 1, 0, 0, 0]}]}))
    rows = readers.read_pose_json(spark, str(tmp_path / "p.json")).orderBy("frame_id").collect()
    assert np.allclose(rows[0]["pose"], [0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]) and rows[1]["pose"][3] == 1


def test_workload_files(spark, tmp_path):
    (tmp_path / "random_queries_01.json").write_text("[4, 2]")
    random, sequential = readers.read_workload(spark, str(tmp_path), "01")
    assert [tuple(r) for r in random.collect()] == [(0, 4), (1, 2)] and sequential.count() == 0
    (tmp_path / "sequential_queries_01.json").write_text("[[0, 30], [5, 9]]")
    assert [tuple(r) for r in readers.read_workload(spark, str(tmp_path), "01")[1].collect()] == [(0, 0, 30), (1, 5, 9)]


def test_workloads_are_seeded(spark):
    a, b = (evaluate.random_workload(spark, 50, 10).collect() for _ in range(2))
    assert a == b and len({r["frame_id"] for r in a}) == 10
    assert evaluate.random_workload(spark, 5, 10).count() == 5
    assert all(0 <= r["start_frame"] < r["end_frame"] <= 50 for r in evaluate.sequential_workload(spark, 50, 10, 30).collect())


def test_strange_store_name_is_an_error(spark):
    with pytest.raises(Exception, match="not a segment"):
        readers.catalog_from_names(spark.createDataFrame([("notes.txt",)], "file_name string")).collect()


@given(st.binary(max_size=400))
@settings(deadline=None, max_examples=60)
def test_huffman_there_and_back(data):
    assert codec.huffman_decode(*codec.huffman_encode(data)) == data


def test_lone_symbol_has_a_code():
    packed, bits, codes = codec.huffman_encode(b"aaaa")
    assert bits == 4 and codec.huffman_decode(packed, bits, codes) == b"aaaa"


@pytest.mark.parametrize("n, budget, want", [(24, 143.948542, {3: 8}), (48, 287.897085, {3: 12, 4: 3}), (100, 599.785593, {3: 28, 4: 4})])
def test_segment_mix(spark, n, budget, want):
    assert math.isclose(planner.time_budget(n, 4), budget, rel_tol=1e-8)
    assert planner.best_mix(spark, n, budget, Options().time_cost, Options().score_cost) == want


def test_segment_mix_of_another_model(spark):
    time, score = {1: 0.1, 2: 3.0, 3: 6.0, 4: 10.0}, {1: 1.0, 2: 0.4, 3: 0.54, 4: 0.7}
    assert planner.best_mix(spark, 51, 100.0, time, score) == {2: 3, 3: 15}
    with pytest.raises(RuntimeError):
        planner.best_mix(spark, 3, 0.0, {2: 1.0}, {2: 1.0})


@given(st.integers(0, 12), st.integers(0, 12), st.integers(0, 5), st.integers(0, 1000))
@settings(deadline=None, max_examples=60)
def test_assignment_tiles(n4, n3, n1, seed):
    counts = {k: c for k, c in ((4, n4), (3, n3), (1, n1)) if c}
    n = sum(k * c for k, c in counts.items())
    if not counts:
        return
    placed = planner.assign_segments(n, counts, lambda blocks: [1.0 + s % 5 for s, _ in blocks], seed)
    assert [s for s, _ in placed] == [0, *(e for _, e in placed)][:-1] and placed[-1][1] == n
    assert {k: sum(e - s == k for s, e in placed) for k in counts} == counts


def test_plan_with_measured_gains(spark):
    gains = planner.measured_gains(fx.points(spark, SF), fx.poses(spark), Options(), 4)
    assert gains([(0, 4), (4, 8)])[0] > 0
    placed = planner.plan(spark, 8, gains, Options(time_budget=1.0))
    assert placed[0][0] == 0 and placed[-1][1] == 8
    assert set(planner.measured_costs(fx.points(spark, SF), fx.poses(spark), Options(), 2)) == {1, 2}


def test_octree_of_an_odd_frame_and_flat_axis(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 1.0, 1.0, 1.0), (1, 0, 0.0, 0.0, 1.0), (2, 0, 5.0, 5.0, 5.0)], "frame_id int, point_id long, x double, y double, z double")
    tree = baselines.OctreeStore.build(p)
    got = tree.search(spark.createDataFrame([(0, 0, 3)], "query_id int, start_frame int, end_frame int")).toPandas()
    assert got.groupby("frame_id").size().to_dict() == {0: 2, 1: 1, 2: 1}
    assert {r["pair_id"]: r["clouds"] for r in octree.clouds_of(p).collect()} == {0: 2, 1: 1}
    assert got[got.frame_id == 2].x.iloc[0] == 5.0


def test_octree_opened_again(spark, tmp_path):
    tree = baselines.OctreeStore.build(fx.points(spark, SF))
    tree.write(str(tmp_path / "o"))
    q = fx.q_random(spark)
    assert baselines.OctreeStore.open(spark, str(tmp_path / "o")).search(q).count() == tree.search(q).count() == 1818


def test_quantised_frames_on_disk(spark, tmp_path):
    p = fx.points(spark, SF)
    baselines.write_quantised(p, str(tmp_path / "q"))
    got = baselines.quantised_search(fx.q_random(spark), spark.read.parquet(str(tmp_path / "q")))
    assert got.count() == 1818 and got.join(p.withColumnRenamed("x", "x0"), ["frame_id", "point_id"]).agg(F.max(F.abs(F.col("x") - F.col("x0")))).first()[0] <= 5.01e-5


def test_first_fit_takes_the_first_free_box(spark):
    pairs = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1), (0, 1, 1, 0)], "frame_id int, label int, box_1 int, box_2 int")
    got = evaluate.first_fit(pairs, "box_1", "box_2").collect()
    assert [(r["box_1"], r["box_2"]) for r in got] == [(0, 0)]


def test_accuracy_without_boxes_is_one(spark):
    none = spark.createDataFrame([], "frame_id int, label int, box_1 int, box_2 int")
    raw = spark.createDataFrame([(1, 0)], "frame_id int, box_idx int")
    got = evaluate.accuracy(fx.poses(spark), none, raw).toPandas().set_index("frame_id").accuracy
    assert got[0] == 1.0 and got[1] == 0.0


def test_metrics_document(spark, tmp_path):
    random = spark.createDataFrame([(1, 0.5, 2.0, 0.1), (0, 1.0, 3.0, 0.2)], "query_id int, accuracy double, io_cost double, load_time double")
    seq = spark.createDataFrame([(0, 9.0, 0.3)], "query_id int, io_cost double, load_time double")
    kb, fraction = spark.createDataFrame([(7.0,)], "kb double"), spark.createDataFrame([(0.3,)], "fraction double")
    writers.write_metrics(evaluate.metrics(random, seq, fx.segments(spark), kb, fraction, 1.5), str(tmp_path / "m"))
    row = spark.read.json(str(tmp_path / "m")).first()
    assert row["random"]["accuracy"] == [1.0, 0.5] and row["segment_counts"]["4"] == 2 and row["disk_consume"] == 7.0


def test_points_of_three_columns():
    assert writers.pad_width(np.ones((2, 3))).tolist() == [[1, 1, 1, 0]] * 2
    with pytest.raises(ValueError):
        writers.pad_width(np.ones((2, 5)))


def test_stream_of_frames(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "000000.bin").write_bytes(b"\0" * 32)
    files = streaming.stream_frames(spark, str(folder))
    q = files.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (folder / "000001.bin").write_bytes(b"\0" * 16)
    q.processAllAvailable()
    q.stop()
    assert {r["file_name"]: r["n_points"] for r in spark.table("arrived").collect()} == {"000000.bin": 2, "000001.bin": 1}
    assert streaming.points_by_window(files).isStreaming


def test_detections_are_all_events(spark):
    """Matching by cells over all events equals first fit over all pairs."""
    sf = "/root/testdata/sf0.01"
    d = fx.detections(spark, sf).toPandas()
    assert (d.source == "raw").sum() == spark.read.parquet(f"{sf}/events.parquet").count()
    raw, found = d[(d.source == "raw") & (d.score > 0.5)], d[d.source == "reconstructed"]
    want = set()
    for (frame, label), r in raw.groupby(["frame_id", "label"]):
        f = found[(found.frame_id == frame) & (found.label == label)]
        b1, b2 = np.array(f.box.tolist()), np.array(r.box.tolist())
        apart = np.sqrt(((b1[:, None, :3] - b2[None, :, :3]) ** 2).sum(-1))
        turn = b1[:, None, 6] - b2[None, :, 6]
        turn = np.abs(np.arctan2(np.sin(turn), np.cos(turn)))
        square = (np.abs(b1[:, 3] - b1[:, 4]) < 0.01)[:, None] & (np.abs(b2[:, 3] - b2[:, 4]) < 0.01)[None]
        ok = (apart < 1.5) & ((turn < math.pi / 6) | (square & (np.abs(turn - math.pi) < math.pi / 6)))
        used: set[int] = set()
        for j in np.argsort(r.box_idx.to_numpy()):
            free = sorted(x for x in f.box_idx.to_numpy()[ok[:, j]] if x not in used)
            if free:
                used.add(free[0])
                want.add((frame, label, free[0], r.box_idx.iloc[j]))
    got = {(r["frame_id"], r["label"], r["box_1"], r["box_2"]) for r in QUERIES["det_match_rev"](spark, sf).collect()}
    assert got == want and max(j for *_, j in got) >= 60
    boxes = QUERIES["det_accuracy"](spark, sf).agg(F.sum("boxes"), F.sum("matched")).first()
    assert tuple(boxes) == (len(raw), len(want))
