"""Blocks, volumes, trained detection of missing patches, outlines and resizing on small known inputs."""

import numpy as np
import pytest

from voxelry.operators import blockwise, filters, geometry, missing, tracking

PX = "image_id string, t int, z int, y int, x int, c int, v double"
LAB = PX.replace("v double", "v long")


def test_windows_are_read_row_by_row_and_absent_pixels_are_zero(spark):
    px = spark.createDataFrame([("a/b", 0, 0, 0, 0, 0, 5.0), ("a/b", 0, 0, 0, 1, 0, 7.0), ("a/b", 0, 0, 3, 3, 0, 9.0)], PX)
    got = {(r["y"], r["x"]): r["f"] for r in blockwise.neighbourhood_vectors(px).collect()}
    assert got == {(0, 0): [0, 0, 0, 0, 5, 7, 0, 0, 0], (0, 1): [0, 0, 0, 5, 7, 0, 0, 0, 0], (3, 3): [0, 0, 0, 0, 9, 0, 0, 0, 0]}
    assert blockwise.neighbourhood_vectors(px.where("false")).count() == 0


def test_blocks_undo_themselves_and_objects_across_borders_are_whole(spark):
    rows = [("a/b", 0, 0, 7, x, 0, 1.0) for x in range(6, 11)] + [("a/b", 0, 0, 1, 1, 0, 1.0)]
    px = spark.createDataFrame(rows, PX)
    assert sorted(blockwise.out_of_blocks(blockwise.in_blocks(px, 8, 5), 8).collect()) == sorted(px.collect())
    by_size = lambda f: f.selectExpr("image_id", "t", "object_id", "cast(count as int) as class")
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in blockwise.blockwise_object_classification(px, px, by_size, 8, 5).collect()}
    assert got == {("a/b", 7, x): 5 for x in range(6, 11)} | {("a/b", 1, 1): 1}


def test_volume_features_equal_the_single_filters_and_do_not_depend_on_blocks(spark):
    rows = [("i", 0, z, y, x, 0, float((7 * z + 3 * y + 5 * x) % 11)) for z in range(5) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, PX)
    names = blockwise.VOLUME_FEATURES
    got = {(r["z"], r["y"], r["x"]): r["f"] for r in blockwise.volume_feature_bank(px, [0.7], block=16).collect()}
    other = {(r["z"], r["y"], r["x"]): r["f"] for r in blockwise.volume_feature_bank(px, [0.7], block=4).collect()}
    assert len(got) == len(rows) and got.keys() == other.keys()
    for k, f in got.items():
        assert f == pytest.approx(other[k], abs=1e-4)
    shape = {"z": 5, "y": 6, "x": 6}
    smooth = {(r["z"], r["y"], r["x"]): r["v"] for r in filters.gaussian_smoothing(px, 0.7, "zyx", shape).collect()}
    eigen = {(r["z"], r["y"], r["x"], r["c"]): r["v"] for r in filters.hessian_eigenvalues(px, 0.7, shape, "zyx").collect()}
    for k, f in got.items():
        assert f[0] == pytest.approx(smooth[k], abs=1e-4)
        assert [f[names.index(f"hessian_{i}")] for i in range(3)] == pytest.approx([eigen[(*k, i)] for i in range(3)], abs=1e-3)


def test_hulls_of_flat_objects_need_no_search_in_space(monkeypatch):
    rng, thin = np.random.default_rng(3), blockwise._hull_of_lines
    shapes = [np.argwhere(rng.random(np.where(np.arange(3) == i % 3, 1, 4)) < 0.6) for i in range(60)]
    lines = [np.array([(z, y, min(x for a, b, x in v.tolist() if (a, b) == (z, y)), 1 + max(x for a, b, x in v.tolist() if (a, b) == (z, y))) for z, y in sorted({(a, b) for a, b, _ in v.tolist()})]).T for v in shapes if len(v)]
    whole = [blockwise._hull_volume(np.concatenate([np.stack([z + dz, y + dy, x], axis=1) for dz in (0, 1) for dy in (0, 1) for x in (lo, hi)])) for z, y, lo, hi in lines]
    monkeypatch.setattr(blockwise, "_hull_volume", None)
    assert [thin(*at) for at in lines] == whole


def test_hulls_of_a_box_a_voxel_and_two_far_voxels(spark):
    box = [("i", 0, z, y, x, 0, 1) for z in range(2) for y in range(3) for x in range(4)]
    pair = [("i", 0, 0, 20, 20, 0, 3), ("i", 0, 0, 20, 25, 0, 3)]
    step = [("i", 0, 0, 40, 0, 0, 4), ("i", 0, 0, 40, 1, 0, 4), ("i", 0, 0, 41, 0, 0, 4)]
    px = spark.createDataFrame([*box, ("i", 0, 9, 9, 9, 0, 2), *pair, *step, ("i", 0, 0, 50, 50, 0, 0)], LAB)
    got = {r["object_id"]: (r["count"], r["hull_volume"]) for r in blockwise.volume_hull_features(px).collect()}
    assert got == {1: (24, 24.0), 2: (1, 1.0), 3: (2, 6.0), 4: (3, 3.5)}


def test_the_detector_learns_from_hard_examples(spark):
    good = [(0, [0.2 + 0.01 * (i % 5), 0.8 - 0.01 * (i % 5), 0.0]) for i in range(60)] + [(0, [0.85, 0.0, 0.15]) for _ in range(6)]
    bad = [(1, [1.0 - 0.001 * (i % 3), 0.001 * (i % 3), 0.0]) for i in range(20)]
    schema = "label int, h array<double>"
    model = missing.train_missing_detector(spark.createDataFrame(good + bad, schema), rounds=6)
    px = spark.createDataFrame([("i", 0, 0, 0, x, 0, 0.0 if x < 4 else 150.0) for x in range(8)], PX)
    assert {(r["px"], r["missing"]) for r in missing.detect_missing_trained(px, model, 4, 3, (0.0, 300.0)).collect()} == {(0, True), (1, False)}
    assert missing.train_missing_detector(spark.createDataFrame(good, schema)) is None


def test_without_a_trained_detector_patches_of_the_first_bin_are_missing(spark):
    px = spark.createDataFrame([("i", 0, 0, 0, x, 0, 0.0 if x < 4 else 150.0) for x in range(8)], PX)
    found = missing.detect_missing_trained(px, None, 4, 3, (0.0, 300.0))
    assert found.columns == ["image_id", "t", "z", "c", "py", "px", "missing"]
    assert {(r["px"], r["missing"]) for r in found.collect()} == {(0, True), (1, False)}


def test_outlines_go_around(spark):
    square = spark.createDataFrame([("i", 0, 0, y, x, 0, 1) for y in range(3) for x in range(3)], LAB)
    got = [(r["y"], r["x"]) for r in sorted(tracking.outline_records(square).collect(), key=lambda r: r["position"])]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]


@pytest.mark.parametrize("order", [2, 3])
def test_resizing_keeps_parabolas_inside_and_corners(spark, order):
    px = spark.createDataFrame([("i", 0, 0, 0, x, 0, float(x * x + 1)) for x in range(9)], PX)
    got = {r["x"]: r["v"] for r in geometry.resize(px, {"x": 9}, {"x": 17}, order).collect()}
    assert got[0] == pytest.approx(1.0) and got[16] == pytest.approx(65.0)
    assert all(got[i] == pytest.approx((i / 2) ** 2 + 1) for i in range(3, 13))


def test_a_single_missing_slice_is_filled_by_the_cubic_and_longer_gaps_by_lines(spark):
    value = {z: float(z**3 - 4 * z) for z in range(12)}
    rows = [("i", 0, z, 0, 0, 0, -9.0 if z in (3, 7, 8) else value[z], z in (3, 7, 8)) for z in range(12)]
    px = spark.createDataFrame(rows, PX + ", missing boolean")
    got = {r["z"]: r["v"] for r in missing.interpolate_missing(px, method="cubic").collect()}
    line = [value[6] + (value[9] - value[6]) * i / 3 for i in (1, 2)]
    assert got == pytest.approx(value | {7: line[0], 8: line[1]})
