"""Selection, skeletons, regions of annotations, family trees and filters on small known inputs."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from voxelry.operators import counting, filters, geometry, labels, learning, objects, selection, tracking
from voxelry.plans.stored import written

PX = "image_id string, t int, z int, y int, x int, c int, v double"
LAB = PX.replace("v double", "v long")


def image(spark, rows, schema=PX):
    return spark.createDataFrame([("i", 0, 0, y, x, 0, v) for y, x, v in rows], schema)


def test_the_informative_features_are_chosen_and_copies_come_last(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        y = rng.randrange(1, 3)
        a = y + rng.random() * 0.8
        rows.append((y, [rng.random(), a, a, rng.choice([y, y, 3 - y]) + rng.random() * 0.1]))
    m = spark.createDataFrame(rows, "label int, f array<double>")
    chosen = selection.information_feature_selection(m, ["noise", "good", "copy", "weak"], 4)
    assert chosen[0] == "good" and chosen.index("copy") > 0
    assert selection.information_feature_selection(m.where("false"), ["noise", "good", "copy", "weak"], 2) == []
    assert selection.wrapper_feature_selection(m, ["noise", "good", "copy", "weak"], trees=3) == ["good"]
    for parts in (1, 5):  # however the rows lie
        assert selection.wrapper_feature_selection(m.repartition(parts), ["noise", "good", "copy", "weak"], trees=3) == ["good"]
    left = selection.wrapper_feature_selection(m, ["noise", "good", "copy", "weak"], backward=True, trees=3)
    assert left in (["good"], ["copy"])


def test_missing_and_infinite_values_have_a_bin_of_their_own(spark):
    m = spark.createDataFrame([(1, [0.0, None]), (2, [float("inf"), 1.0]), (2, [float("nan"), 1.0]), (1, [8.0, 1.0])], "label int, f array<double>")
    assert sorted(map(tuple, (r["b"] for r in selection.binned(m, 2, 4).collect()))) == [(-1, 0), (-1, 0), (0, -1), (3, 0)]


def test_skeleton_of_a_ring_and_of_a_bar(spark):
    ring = [(y, x, 1) for y in range(9) for x in range(9) if not (3 <= y <= 5 and 3 <= x <= 5)]
    bar = [(y, x, 2) for y in range(20, 23) for x in range(15)]
    got = {r["object_id"]: r for r in objects.skeleton_features(image(spark, ring + bar, LAB)).collect()}
    assert got[1]["holes"] == 1 and got[1]["ends"] == 0 and got[1]["branches"] == 1
    assert got[2]["holes"] == 0 and got[2]["ends"] == 2 and got[2]["branches"] == 1
    assert got[2]["total_length"] == got[2]["skeleton_pixels"] - 1 and abs(got[2]["skeleton_cy"] - 21) < 0.5
    assert objects.skeleton_features(image(spark, [], LAB)).count() == 0


def test_annotation_regions_touch_diagonally_but_not_across_labels(spark):
    rows = labels.annotation_regions(image(spark, [(0, 0, 1), (1, 1, 1), (1, 0, 2), (5, 5, 1)], LAB)).collect()
    got = sorted((r["label"], r["pixels"], r["y0"], r["x0"], r["y1"], r["x1"], r["anchor_y"], r["anchor_x"]) for r in rows)
    assert got == [(1, 1, 5, 5, 6, 6, 5, 5), (1, 2, 0, 0, 2, 2, 1, 1), (2, 1, 1, 0, 2, 1, 1, 0)]


def test_regions_are_connected_across_faces_of_equal_label_only(spark):
    rows = [("a", 0, 0, 1, 0, 8, 4, 8), ("b", 0, 1, 1, 6, 9, 8, 12), ("c", 0, 1, 2, 0, 5, 8, 12), ("d", 1, 0, 1, 8, 9, 0, 4)]
    df = spark.createDataFrame([(n, "i", 0, 0, by, bx, label, 0, 1, y0, y1, x0, x1) for n, by, bx, label, y0, y1, x0, x1 in rows], "region string, image_id string, t int, bz int, by int, bx int, label int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    assert dict(map(tuple, labels.connect_regions(df).collect())) == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_a_division_ends_a_track_and_starts_two(spark):
    objs = spark.createDataFrame([("i", 0, 1), ("i", 1, 1), ("i", 2, 1), ("i", 2, 2)], "image_id string, t int, object_id long")
    links = spark.createDataFrame([("i", 0, 1, 1, 1.0), ("i", 1, 1, 1, 1.0), ("i", 1, 1, 2, 2.0)], "image_id string, t int, src long, dst long, cost double")
    chosen = tracking.link_tracks(links)
    second = tracking.division_links(links, chosen, objs.where("t = 1"))
    got = {(r["t"], r["object_id"]): (r["track_id"], r["lineage_id"], r["parent_track_id"]) for r in tracking.family_tree(objs, chosen, second).collect()}
    assert got == {(0, 1): (1, 1, 0), (1, 1): (1, 1, 0), (2, 1): (2, 1, 1), (2, 2): (3, 1, 1)}


def test_resize_keeps_corners_and_lines(spark):
    px = image(spark, [(0, x, float(x)) for x in range(5)])
    wide = {r["x"]: r["v"] for r in geometry.resize(px, {"x": 5}, {"x": 9}).collect()}
    assert wide == pytest.approx({i: i / 2 for i in range(9)})
    assert {r["x"]: r["v"] for r in geometry.resize(px, {"x": 5}, {"x": 3}, 0).collect()} == {0: 0.0, 1: 2.0, 2: 4.0}


def test_hessian_of_a_bowl_in_three_dimensions(spark):
    n = 13
    rows = [("i", 0, z, y, x, 0, float((z - 6) ** 2 + 2 * (y - 6) ** 2 + 3 * (x - 6) ** 2)) for z in range(n) for y in range(n) for x in range(n)]
    px = spark.createDataFrame(rows, PX)
    got = filters.hessian_eigenvalues(px, 1.0, {"z": n, "y": n, "x": n}, "zyx").where("z = 6 and y = 6 and x = 6").orderBy("c").collect()
    assert [r["v"] for r in got] == pytest.approx([6.0, 4.0, 2.0], rel=0.02)


def test_density_is_rescaled_to_counts_of_boxes(spark):
    density = image(spark, [(0, 0, 0.5), (0, 1, 0.5), (5, 5, 2.0)])
    boxes = spark.createDataFrame([("a", "i", 0, 0, 1, 0, 2, 3.0), ("b", "i", 0, 8, 9, 0, 2, 4.0)], "box string, image_id string, t int, y0 int, y1 int, x0 int, x1 int, count double")
    assert sorted(r["v"] for r in counting.fit_to_boxes(density, boxes).collect()) == [1.5, 1.5, 2.0]
    assert counting.train_density(spark.createDataFrame([], "f array<double>, v double")) == []


def test_autocontext_computes_each_bank_once(spark):
    px = spark.createDataFrame([("a", 0, 0, y, x, 0, float(30 * (x % 3))) for y in range(6) for x in range(6)], "image_id string, t int, z int, y int, x int, c int, v double")
    marks = px.select("image_id", "t", "z", "y", "x", "c", (F.col("v") > 20).cast("int").alias("label")).withColumn("label", F.col("label") + 1)
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return [float(v)]

    once = F.udf(count, "array<float>").asNondeterministic()
    scored = selection.autocontext(px, marks, 2, lambda p: p.withColumn("f", once("v")), 2, trees=2)
    assert scored.count() == 36
    assert seen.value == 36 + 2 * 36  # the image, and two channels of probabilities


def test_sets_of_features_are_tried_side_by_side(spark, monkeypatch):
    matrix = spark.createDataFrame([(1 + i % 2, [float(i), float(-i), float(i % 2)]) for i in range(30)], "label int, f array<double>")
    running, most = [], []

    def slow(*_, **__):
        running.append(1)
        most.append(len(running))
        time.sleep(0.5)
        running.pop()

    monkeypatch.setattr(selection, "train", slow)
    assert selection.wrapper_feature_selection(matrix, ["a", "b", "c"]) == []
    assert max(most) > 1


def test_rows_are_dealt_once_for_all_sets_of_features(spark, monkeypatch):
    matrix = spark.createDataFrame([(1 + i % 2, [float(i), float(-i), float(i % 2)]) for i in range(60)], "label int, f array<double>")
    learned = []

    class Forest(learning.RandomForestClassifier):
        def fit(self, rows):
            learned.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(rows)

    monkeypatch.setattr(learning, "RandomForestClassifier", Forest)
    assert selection.wrapper_feature_selection(matrix, ["a", "b", "c"], trees=3) == ["c"]
    assert len(learned) > 1 and all("InMemoryRelation" in plan and "Repartition" not in plan for plan in learned)


def test_what_is_shuffled_for_a_written_table_goes_with_it(spark):
    rows = written(spark.range(2000).repartition(7, "id"), "rows")
    held = lambda: {p for d, _, names in os.walk(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]) for p in names if p.startswith("shuffle_")}
    before = held()
    assert len(written(rows.repartition(5, "id"), "again").collect()) == 2000
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def _blobs(spark, n=40):
    rng = random.Random(12)
    pixels = {}
    for v in range(1, 15):
        y, x, h, w = rng.randrange(n - 8), rng.randrange(n - 8), rng.randrange(2, 12), rng.randrange(2, 16)
        pixels |= {(y + a, x + b): v for a in range(h) for b in range(w) if rng.random() < 0.93 and y + a < n and x + b < n}
    return image(spark, [(y, x, v) for (y, x), v in pixels.items()], LAB)


def _zhang_suen(pixels):
    """Thinning of one object, pixel by pixel."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(pixels)
        for first in (True, False):
            gone = set()
            for y, x in pixels:
                p = [(y + dy, x + dx) in pixels for dy, dx in ring]
                north, east, south, west = p[0], p[2], p[4], p[6]
                open_ = not (north and east and south) and not (east and south and west) if first else not (north and east and west) and not (north and south and west)
                if 2 <= sum(p) <= 6 and sum(not p[i] and p[(i + 1) % 8] for i in range(8)) == 1 and open_:
                    gone.add((y, x))
            pixels = pixels - gone
        if len(pixels) == before:
            return pixels


def test_thinning_by_blocks_is_that_of_each_object(spark, monkeypatch):
    labels = _blobs(spark).cache()
    objects_of = {}
    for r in labels.collect():
        objects_of.setdefault(r["v"], set()).add((r["y"], r["x"]))
    want = {(v, *p) for v, pixels in objects_of.items() for p in _zhang_suen(pixels)}
    for side, rounds in ((64, 16), (8, 1), (5, 2)):
        monkeypatch.setattr(objects, "THIN_BLOCK", side)
        monkeypatch.setattr(objects, "THIN_ROUNDS", rounds)
        assert {(r["v"], r["y"], r["x"]) for r in objects.skeletons(labels).collect()} == want


def test_skeletons_within_a_block_are_done_frame_by_frame(spark, monkeypatch):
    labels = _blobs(spark).cache()
    rows = lambda: [(r[:5] + tuple(round(x, 9) if isinstance(x, float) else x for x in r[5:])) for r in sorted(map(tuple, objects.skeleton_features(labels).collect()))]
    with monkeypatch.context() as m:
        for name in ("skeletons", "connected_components", "_holes"):
            m.setattr(objects, name, None)
        found = objects.skeleton_features(labels)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
        within = rows()
    monkeypatch.setattr(objects, "THIN_BLOCK", 16)
    beyond = rows()
    assert [r[:5] + r[8:10] for r in within] == [r[:5] + r[8:10] for r in beyond] and len(within) > 5
    assert all(abs(a - b) < 1e-9 for p, q in zip(within, beyond) for a, b in zip(p[2:], q[2:]))
