"""The dedup store against recorded counts, invariants and small hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import dedup, neighbours, retrieve, store
from pointloom.operators.dedup import Frame, cluster_order, dedup_segment, greedy
from pointloom.options import Options
from pointloom.plans import fixture as fx
from pointloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
GOLDEN = {"both": 591, "relative": 1573, "absolute": 836}


def made(spark, **options):
    return dedup.dedup(fx.points(spark, SF), fx.segments(spark), fx.poses(spark), Options(**options))


@pytest.mark.parametrize("mode", sorted(GOLDEN))
def test_stored_points(spark, mode):
    patches = dedup.patches(made(spark, relative_absolute=mode)).where("segment_id = 0").toPandas()
    assert patches.n_points.sum() == GOLDEN[mode]


def test_patches_by_key(spark):
    p = dedup.patches(made(spark)).where("segment_id = 0 and size(subset) > 1").toPandas()
    found = {(tuple(r.subset), r.anchor, r.transposed): r.n_points for r in p.itertuples()}
    assert found == {
        ((0, 1, 2, 3), 1, False): 63, ((0, 1, 2), 1, False): 9, ((1, 2, 3), 2, False): 10, ((0, 1), 0, False): 9, ((2, 3), 2, False): 9,
        ((0, 1, 2, 3), 1, True): 255, ((0, 1, 2), 1, True): 36, ((1, 2, 3), 2, True): 36, ((0, 1), 0, True): 36, ((2, 3), 2, True): 37,
    }


def test_shared_intensities(spark):
    p = dedup.patches(made(spark, deduplicate_intensity=True)).where("segment_id = 0 and size(subset) > 1")
    assert {r["intensity_signal"]: r["n"] for r in p.groupBy("intensity_signal").agg(F.sum("n_points").alias("n")).collect()} == {True: 276, False: 224}


@pytest.mark.parametrize("shared", [False, True])
def test_every_point_is_stored_once(spark, shared):
    rows = made(spark, deduplicate_intensity=shared).select("segment_id", F.posexplode("point_ids").alias("at", "point_id"), "subset")
    frames = rows.select((F.col("segment_id") * 4 + F.get("subset", F.col("at"))).alias("frame_id"), "point_id")
    want = fx.points(spark, SF).select("frame_id", "point_id")
    assert frames.exceptAll(want).count() == 0 and want.exceptAll(frames).count() == 0


@pytest.mark.parametrize("shared", [False, True])
def test_reconstruction_is_near(spark, shared):
    """Anchors come back to quantisation, others within the matching radius; intensities are their own channel's."""
    options = Options(deduplicate_intensity=shared)
    rows = made(spark, deduplicate_intensity=shared)
    queries = spark.range(8).select(F.lit(0).alias("query_id"), F.col("id").cast("int").alias("frame_id"))
    got = retrieve.reconstruct(retrieve.wanted_frames(queries, fx.segments(spark)), store.tables(rows, options), fx.segments(spark), fx.poses(spark), options)
    key = rows.select("segment_id", "patch_id", "ord", F.posexplode("point_ids").alias("at", "point_id"), "subset", "anchor")
    key = key.select("segment_id", "patch_id", "ord", "point_id", "anchor", F.get("subset", F.col("at")).alias("frame_rel"))
    joined = got.withColumn("frame_rel", F.col("frame_id") % 4).join(key, ["segment_id", "patch_id", "ord", "frame_rel"])
    p = fx.points(spark, SF).select("frame_id", "point_id", *(F.col(c).alias(f"{c}0") for c in ("x", "y", "z", "intensity")))
    both = joined.join(p, ["frame_id", "point_id"]).toPandas()
    assert len(both) == 3636
    off = np.sqrt(sum((both[c] - both[f"{c}0"]) ** 2 for c in "xyz"))
    own = both.frame_rel == both.anchor
    assert off[own].max() < 1e-4 and off.max() <= 0.06 + 1e-3
    assert (both.intensity - both.intensity0).abs().max() <= (0.01 + 1e-4 if shared else 1e-4)


def test_stored_to_files_and_read_again(spark, tmp_path):
    rows = made(spark)
    store.write(rows, str(tmp_path / "s"))
    tables = store.read(spark, str(tmp_path / "s"))
    got = retrieve.reconstruct(retrieve.wanted_frames(fx.q_random(spark), fx.segments(spark)), tables, fx.segments(spark), fx.poses(spark))
    assert got.count() == 1818
    assert store.disk_consume(spark, str(tmp_path / "s")).first()["kb"] > 0


def test_bounds_are_errors(spark):
    bad = spark.createDataFrame([(0, 99)], "query_id int, frame_id int")
    with pytest.raises(Exception, match="out of bounds"):
        retrieve.wanted_frames(bad, fx.segments(spark), 8).collect()
    empty = spark.createDataFrame([(0, 3, 3)], "query_id int, start_frame int, end_frame int")
    with pytest.raises(Exception, match="empty range"):
        retrieve.wanted_frames(empty, fx.segments(spark), 8).collect()


def test_range_reads_geometry_once(spark):
    rows = made(spark)
    blobs, tables = store.patch_blobs(rows), store.tables(rows)
    one = spark.createDataFrame([(f, f, f + 1) for f in range(4)] + [(9, 0, 4)], "query_id int, start_frame int, end_frame int")
    kb = {r["query_id"]: r["kb"] for r in retrieve.io_cost(retrieve.wanted_frames(one, fx.segments(spark)), tables, blobs).collect()}
    assert kb[9] < sum(kb[f] for f in range(4))


def frame(xyz, first=0):
    xyz = np.asarray(xyz, float).reshape(-1, 3)
    return Frame(xyz, np.full(len(xyz), 0.5), np.arange(first, first + len(xyz)))


def test_a_frame_emptied_in_the_first_pass():
    same = [[0, 0, 0], [5, 0, 0]]
    patches = dedup_segment([frame(same), frame(same), frame([*same, [9, 9, 9]])], [np.eye(4)] * 3, Options())
    assert sum(len(p["xyz"]) for p in patches) == 3
    assert [p["subset"] for p in patches] == [[0, 1, 2], [2]]


def test_empty_frame_and_single_frame():
    patches = dedup_segment([frame([[0, 0, 0]]), frame([])], [np.eye(4)] * 2, Options())
    assert [p["subset"] for p in patches] == [[0]]
    assert len(dedup_segment([frame([[0, 0, 0], [1, 1, 1]])], [np.eye(4)], Options())[0]["xyz"]) == 2
    assert dedup_segment([frame([])], [np.eye(4)], Options()) == []


def test_partial_matches_stay_taken():
    """An anchor that finds a match in one of two frames only keeps it from others, and counts in the average."""
    inf = np.inf
    first = (np.array([[0.01], [0.02]]), np.array([[0], [0]]), np.array([0.01, 0.02]))
    second = (np.array([[inf], [0.01]]), np.array([[-1], [0]]), np.array([0.0, 0.5]))
    matched, _ = greedy([first, second], 2, Options())
    assert matched.tolist() == [[0, -1], [-1, 0]]


def test_first_match_is_exempt_from_the_average():
    one = (np.array([[0.05], [0.055]]), np.array([[0], [1]]), np.array([0.05, 0.055]))
    matched, _ = greedy([one], 2, Options())
    assert matched.ravel().tolist() == [0, -1]


def test_cluster_order():
    assert cluster_order(3) == [([0, 1, 2], 1), ([0, 1], 0), ([1, 2], 1)]
    assert cluster_order(1) == []


def test_grid_neighbours_equal_all_pairs():
    rng = np.random.default_rng(0)
    for n, m, scale in ((200, 300, 1.0), (50, 5, 40.0), (30, 1, 1000.0), (5, 0, 1.0), (400, 400, 0.05)):
        a, b = rng.normal(size=(n, 3)) * scale, rng.normal(size=(m, 3)) * scale
        dist, index, nearest = neighbours.within(a, b, 0.06, 10)
        all_d, all_i = neighbours.brute(a, b, 10)
        keep = all_d <= 0.06
        assert (index[keep] == all_i[keep]).all() and (index[~keep] == -1).all() and np.allclose(dist[keep], all_d[keep])
        assert np.allclose(nearest, all_d[:, 0])


def test_ties_go_to_the_lower_id():
    a, b = np.zeros((1, 3)), np.array([[0.01, 0, 0], [-0.01, 0, 0], [0, 0.01, 0]])
    assert neighbours.within(a, b, 0.06, 2)[1].tolist() == [[0, 1]]
    assert neighbours.brute(a, b, 2)[1].tolist() == [[0, 1]]


def test_pairs_of_all_segments_equal_brute_force(spark):
    p = fx.points(spark, SF).toPandas().sort_values("point_id")
    ratio, threshold, want = Options().soft_distance_ratio, Options().distance_threshold, set()
    for _, start, end in fx.SEGMENTS:
        for a in range(start, end):
            for c in set(range(start, end)) - {a}:
                one, two = p[p.frame_id == a], p[p.frame_id == c]
                d = np.sqrt(((one[["x", "y", "z"]].to_numpy()[:, None] - two[["x", "y", "z"]].to_numpy()[None]) ** 2).sum(-1))
                near = np.argsort(d, axis=1, kind="stable")[:, : Options().neighbours]
                found = sorted((d[i, j], one.point_id.iloc[i], two.point_id.iloc[j]) for i in range(len(one)) for j in near[i] if d[i, j] <= ratio * threshold)
                used, total, n = set(), 0.0, 0
                for x, i, j in found:
                    if (0, i) not in used and (1, j) not in used and (not n or x < threshold or (total + x) / (n + 1) <= threshold):
                        used |= {(0, i), (1, j)}
                        total, n = total + x, n + 1
                        want.add((a, c, i, j))
    got = {(r["anchor_frame"], r["frame_id"], r["anchor_id"], r["point_id"]) for r in QUERIES["greedy_pair_match"](spark, SF).collect()}
    assert got == want and {a for a, *_ in got} == set(range(fx.FRAMES))
