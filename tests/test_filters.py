"""Block stencils with functions of users, splines, scales smoothed beforehand: against dense arrays."""

import math
import random

import numpy as np
import pytest

from voxelry.operators import filters, geometry

PX = "image_id string, t int, z int, y int, x int, c int, v double"


def scattered(spark, h, w, share=0.7, depth=1, seed=4):
    rng = random.Random(seed)
    rows = [("a", 0, z, y, x, 0, rng.uniform(-5, 9)) for z in range(depth) for y in range(h) for x in range(w) if rng.random() < share]
    dense = np.zeros((depth, h, w))
    for r in rows:
        dense[r[2], r[3], r[4]] = r[6]
    return spark.createDataFrame(rows, PX), dense


def arrays(df, shape, channel=0):
    out = np.zeros(shape)
    for r in df.where(df.c == channel).collect():
        out[r["z"], r["y"], r["x"]] = r["v"]
    return out


def test_stencils_of_users_do_not_depend_on_blocks(spark):
    def greatest(b):
        """A user's stencil: the largest value within one pixel, and how many pixels are there."""
        pad = np.pad(np.where(b.present, b.values, -np.inf), 1, constant_values=-np.inf)
        count = np.pad(b.present.astype(float), 1)
        around = [np.s_[dy : dy + b.values.shape[0], dx : dx + b.values.shape[1]] for dy in range(3) for dx in range(3)]
        return [np.max([pad[s] for s in around], axis=0), np.sum([count[s] for s in around], axis=0)], b.present

    px, dense = scattered(spark, 20, 27)
    here = {(r["y"], r["x"]): r["v"] for r in px.collect()}
    for block in (64, 7):
        got = filters.stencil(px, greatest, 1, block, shape={"y": 20, "x": 27})
        for r in got.collect():
            near = [here[p] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (p := (r["y"] + dy, r["x"] + dx)) in here]
            assert r["v"] == (max(near) if r["c"] == 0 else len(near))
        assert got.count() == 2 * len(here)
    assert filters.stencil(px.limit(0), greatest, 1).count() == 0


def recursive_spline(line, order):
    """Coefficients along a line by the causal and the anticausal recursion, the border a mirror."""
    pole = {2: 2 * math.sqrt(2) - 3, 3: math.sqrt(3) - 2}[order]
    n = len(line)
    period = [line[k] if k < n else line[2 * (n - 1) - k] for k in range(2 * (n - 1))] if n > 1 else list(line)
    c = [0.0] * n
    c[0] = sum(v * pole**k for k, v in enumerate(period)) / (1 - pole ** len(period))
    for k in range(1, n):
        c[k] = line[k] + pole * c[k - 1]
    out = [0.0] * n
    out[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
    for k in range(n - 2, -1, -1):
        out[k] = pole * (out[k + 1] - c[k])
    return np.array(out) * {2: 8.0, 3: 6.0}[order]


@pytest.mark.parametrize("order", [2, 3])
def test_splines_are_those_of_the_recursive_filter(spark, order):
    px, dense = scattered(spark, 90, 9, 1.0)
    want = np.apply_along_axis(recursive_spline, 2, np.apply_along_axis(recursive_spline, 1, dense, order), order)
    assert np.abs(arrays(geometry.spline_coefficients(px, order, {"y": 90, "x": 9}), dense.shape) - want).max() < 1e-9
    same = arrays(geometry.resize(px, {"y": 90, "x": 9}, {"y": 179, "x": 17}, order, spline=True), (1, 179, 17))
    assert np.abs(same[:, ::2, ::2] - dense).max() < 1e-9  # a spline passes through its pixels


def test_bank_of_smoothed_scales_is_near_the_direct_filters_and_cheaper(spark):
    px, dense = scattered(spark, 60, 60, 1.0)
    for sigma in (1.6, 3.5):
        bank = {(r["y"], r["x"]): r["f"] for r in filters.feature_bank(px, [0.7, sigma], ["gaussian", "gradient"], block=16).collect()}
        g = filters.gaussian_kernel(sigma)
        direct = filters.correlate(filters.correlate(dense[0], g, 0), g, 1)
        inner = [(y, x) for y in range(16, 44) for x in range(16, 44)]
        got = np.array([bank[p][2] for p in inner])
        want = np.array([direct[p] for p in inner])
        assert np.abs(got - want).max() < 0.02 * np.abs(dense).max()
        before, at = filters.presmoothing(sigma)
        assert 2 * len(filters.gaussian_kernel(before)) + 12 * len(filters.gaussian_kernel(at)) < 12 * len(g)
    alone = {(r["y"], r["x"]): r["f"] for r in filters.feature_bank(px, [3.5], ["gradient"], block=64).collect()}
    assert all(abs(alone[p][0] - bank[p][3]) < 1e-4 for p in alone)


def test_three_dimensions_and_single_axes(spark):
    px, dense = scattered(spark, 12, 13, 0.5, 5)
    want = dense
    for axis in range(3):
        want = filters.correlate(want, filters.gaussian_kernel(0.8), axis)
    assert np.abs(arrays(filters.gaussian_smoothing(px, 0.8, "zyx", {"z": 5, "y": 12, "x": 13}), dense.shape) - want).max() < 1e-9
    along = arrays(filters.anisotropic_smoothing(px, {"x": 1.0}, {"z": 5, "y": 12, "x": 13}), dense.shape)
    assert np.abs(along - filters.correlate(dense, filters.gaussian_kernel(1.0), 2)).max() < 1e-9
    first = arrays(filters.hessian_first_eigenvalue(px, 0.8, {"z": 5, "y": 12, "x": 13}, "zyx"), dense.shape)
    every = filters.hessian_eigenvalues(px, 0.8, {"z": 5, "y": 12, "x": 13}, "zyx")
    assert np.abs(first - arrays(every, dense.shape)).max() < 1e-9 and every.agg({"c": "max"}).first()[0] == 2


@pytest.mark.parametrize("axes, block, side", [("yx", 16, 48 + 22), ("zyx", 16, 32 + 22)])
def test_small_blocks_share_a_tile(spark, axes, block, side):
    """Blocks of 16 do not each bring a halo of their own, and arrays are no larger than what is present."""
    full = [(k, y, x) for k in range(2) for y in range(48) for x in range(48)]
    px = spark.createDataFrame([("a", 0 if "z" in axes else k, k if "z" in axes else 0, y, x, 0, 1.0) for k, y, x in full], "image_id string, t int, z int, y int, x int, c int, v double")
    found = filters.at_pixels(px, lambda values, at: np.tile([values.shape[-1], values.sum()], (at.shape[1], 1)), 11, block, axes)
    rows = found.collect()
    assert len(rows) == len(full)
    assert max(r.f[0] for r in rows) == side
    assert len({(r.image_id, r.t, r.f[0], r.f[1]) for r in rows}) <= 4
