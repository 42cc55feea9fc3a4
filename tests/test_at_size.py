"""Shared steps that keep what they shuffle small, on small tables."""

import itertools
import random

from pyspark.sql import functions as F

from voxelry.operators import regions, superpixels, tracking
from voxelry.plans import queries, segmentation

PX = "image_id string, t int, z int, y int, x int, c int, v double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_within_a_block_are_labelled_without_joins(spark):
    px = spark.createDataFrame([("a", t, 0, y, x, 0, 1.0) for t in range(3) for y, x in ((0, 0), (0, 1), (5, 5), (9, 0))], PX)
    found = regions.connected_components(px)
    assert "Join" not in _plan(found) and "Exchange" not in _plan(found)
    assert sorted((r["t"], r["y"], r["x"], r["v"]) for r in found.collect()) == [(t, y, x, v) for t in range(3) for y, x, v in ((0, 0, 1), (0, 1, 1), (5, 5, 2), (9, 0, 3))]


def test_labels_do_not_depend_on_the_blocks(spark):
    rng = random.Random(3)
    some = [("wide", 0, z, y, x, 0, float(rng.randrange(3))) for z in range(5) for y in range(9) for x in range(9)]
    px = spark.createDataFrame(some + [("small", 1, 0, y, x, 0, 1.0) for y, x in ((1, 1), (1, 2), (3, 3))], PX)
    for full in (False, True):
        found = [sorted(map(tuple, regions.connected_components(px, block, full).collect())) for block in (64, 4, 3)]
        assert found[0] == found[1] == found[2]


def test_edges_over_blocks_channels_and_gaps(spark, monkeypatch):
    """Against all pairs of pixels, in blocks of 3, with superpixels of two channels, several, missing and null values."""
    monkeypatch.setattr(superpixels, "EDGE_BLOCK", {"z": 2, "y": 3, "x": 3})
    rng = random.Random(5)
    places = [(t, z, y, x) for t in range(2) for z in range(3) for y in range(-4, 5) for x in range(7)]
    sp = [("a", *p, c, rng.randrange(1, 5)) for p in places for c in range(2) if rng.random() < 0.8]
    values = [("a", *p, c, None if rng.random() < 0.1 else rng.random()) for p in places for c in range(2) if rng.random() < 0.7]
    label = {r[1:6]: r[6] for r in sp}
    want: dict = {}
    for (t, z, y, x, c), a in label.items():
        for dz, dy, dx in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
            b = label.get((t, z + dz, y + dy, x + dx, c))
            if b is not None and a != b:
                ends = ((t, z, y, x), (t, z + dz, y + dy, x + dx))
                want.setdefault((min(a, b), max(a, b)), []).extend(r[6] for r, end in itertools.product(values, ends) if r[1:5] == end)
    got = {(r["sp1"], r["sp2"]): r for r in superpixels.edge_features(spark.createDataFrame(sp, PX.replace("double", "long")), spark.createDataFrame(values, PX)).collect()}
    assert got.keys() == want.keys()
    for edge, all_ in want.items():
        v, r = [x for x in all_ if x is not None], got[edge]
        mean = sum(v) / len(v)
        assert (r["n"], r["min"], r["max"]) == (len(all_), min(v), max(v))
        assert abs(r["mean"] - mean) < 1e-9 and abs(r["var"] - sum((x - mean) ** 2 for x in v) / len(v)) < 1e-9


def test_edges_gather_pixels_once(spark):
    sp = spark.range(100).select(F.lit("a").alias("image_id"), F.lit(0).alias("t"), F.lit(0).alias("z"), (F.col("id") % 10).cast("int").alias("y"), (F.col("id") / 10).cast("int").alias("x"), F.lit(0).alias("c"), (F.col("id") % 3).alias("v"))
    assert "Join" not in _plan(superpixels.edge_features(sp, sp.withColumn("v", F.lit(1.0))))


def test_carving_computes_the_edges_once(spark, small, monkeypatch):
    kept = []
    monkeypatch.setattr(segmentation.growing, "carve", lambda edges, *rest: kept.append(edges) or edges)
    queries.queries()["w15_carve"](spark, small)
    assert "lineitem" not in kept[0]._jdf.queryExecution().optimizedPlan().toString() and "FlatMapGroups" not in _plan(kept[0])


def test_window_links_send_only_the_nearest(spark):
    """Against all pairs, for objects of several runs over many cells; far pairs are dropped before the shuffle."""
    rng = random.Random(7)
    pixels = {(t, y, x): rng.randrange(1, 40) for t in range(2) for y in range(60) for x in range(60) if rng.random() < 0.3}
    labels = spark.createDataFrame([("a", t, 0, y, x, 0, v) for (t, y, x), v in pixels.items()], PX.replace("double", "long"))
    objects = labels.groupBy("image_id", "t", F.col("v").alias("object_id")).agg(F.count(F.lit(1)).alias("count"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    centre = {(r["t"], r["object_id"]): (r["cy"], r["cx"]) for r in objects.collect()}
    found = tracking.window_links(objects, labels, 10, 2, 3)
    assert "WindowGroupLimit" in _plan(found)
    want = set()
    for (t, src), (cy, cx) in centre.items():
        y0, x0 = round(cy) - 5, round(cx) - 5
        near = {v for (u, y, x), v in pixels.items() if u == t + 1 and y0 <= y < y0 + 10 and x0 <= x < x0 + 10}
        far = sorted((((centre[t + 1, k][0] - cy) ** 2 + (centre[t + 1, k][1] - cx) ** 2) ** 0.5, k) for k in near)
        want |= {(t, src, k, i + 1) for i, (_, k) in enumerate(far[:3])}
    assert {(r["t"], r["src"], r["dst"], r["rank"]) for r in found.collect()} == want
    assert found.count() == len(want)
