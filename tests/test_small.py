"""Small functions that no query shows: each on a few rows."""

import numpy as np
from pyspark.sql import functions as F

from voxelry.operators import counting, geometry, growing, learning, objects, superpixels, tracking

PX = "image_id string, t int, z int, y int, x int, c int, v double"


def test_objects_at_a_place(spark):
    store = spark.createDataFrame([("cell", "a", 7), ("wall", "a", 8), ("other", "b", 7)], "name string, image_id string, sp long")
    sp = spark.createDataFrame([("a", 0, 0, 1, 2, 0, 7), ("a", 0, 0, 1, 3, 0, 8)], "image_id string, t int, z int, y int, x int, c int, v long")
    assert [tuple(r) for r in growing.carved_at(store, sp, {"y": 1, "x": 2}).collect()] == [("a", "cell")]
    assert growing.carved_at(store, sp, {"y": 9}).count() == 0


def test_edges_ranked_by_probability(spark):
    edges = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 1, 3, 0.1), ("a", 1, 4, 0.5), ("a", 2, 3, 0.9)], "image_id string, sp1 long, sp2 long, p double")
    assert {(r["sp1"], r["sp2"], r["rank"]) for r in superpixels.best_edge_rank(edges).collect()} == {(1, 3, 1), (1, 2, 2), (1, 4, 3), (2, 3, 1)}


def test_labels_of_one_kind_decide_all_edges(spark):
    edges = spark.createDataFrame([("a", 1, 2, 3.0), ("a", 2, 3, 5.0)], "image_id string, sp1 long, sp2 long, mean double")
    for kind, p in ((1, 0.0), (2, 1.0)):
        labels = spark.createDataFrame([("a", 1, 2, kind)], "image_id string, sp1 long, sp2 long, label int")
        assert {r["p"] for r in superpixels.trained_probabilities(edges, None, labels).collect()} == {p}
    assert sorted(r["p"] for r in superpixels.trained_probabilities(edges, None, None).collect()) == [0.0, 1.0]


def test_features_chosen_by_importance(spark):
    rows = [(1 + k % 2, [float(k % 7), float(k % 2) + 0.1 * (k % 3)]) for k in range(80)]
    matrix = spark.createDataFrame(rows, "label int, f array<double>")
    assert learning.gini_feature_selection(matrix, ["noise", "signal"], 1) == ["signal"]
    assert learning.gini_feature_selection(matrix.limit(0), ["noise", "signal"], 1) == []


def test_tables_for_track_editors(spark):
    found = spark.createDataFrame([("a", 0, 1, 5.0), ("a", 1, 1, 6.0), ("a", 1, 2, 7.0)], "image_id string, t int, object_id long, size double")
    tree = spark.createDataFrame([("a", 0, 1, 1, 1, 0), ("a", 1, 1, 2, 1, 1), ("a", 1, 2, 3, 1, 1)], "image_id string, t int, object_id long, track_id long, lineage_id long, parent_track_id long")
    links = spark.createDataFrame([("a", 0, 1, 1), ("a", 0, 1, 2)], "image_id string, t int, src long, dst long")
    spots, tied, spans = tracking.spots_and_links(found, tree, links)
    assert {(r["object_id"], r["size"], r["track_id"]) for r in spots.where("t = 1").collect()} == {(1, 6.0, 2), (2, 7.0, 3)}
    assert {(r["src"], r["dst"], r["track_id"]) for r in tied.collect()} == {(1, 1, 1), (1, 2, 1)}
    assert {(r["track_id"], r["first"], r["last"], r["parent_track_id"]) for r in spans.collect()} == {(1, 0, 0, 0), (2, 1, 1, 1), (3, 1, 1, 1)}


def test_margin_of_densities(spark):
    px = spark.createDataFrame([("a", 0, 0, 0, 0, c, v) for c, v in enumerate((0.2, 0.9, 0.5))] + [("a", 0, 0, 0, 1, 0, 0.7)], PX)
    assert {(r["x"], round(r["v"], 6)) for r in counting.density_margin(px).collect()} == {(0, 0.6), (1, 0.0)}


def test_object_tables_with_probabilities_and_chosen_features(spark):
    found = spark.createDataFrame([("a", 0, 1, 5, 1.5), ("a", 0, 2, 6, 2.5)], "image_id string, t int, object_id long, count int, mean double")
    labels = spark.createDataFrame([("a", 0, 2, 2)], "image_id string, t int, object_id long, label int")
    predicted = spark.createDataFrame([("a", 0, 1, 1, [0.8, 0.2])], "image_id string, t int, object_id long, label int, p array<double>")
    table = objects.object_table(found, labels, predicted, ["mean"], 2)
    assert table.columns == ["image_id", "t", "object_id", "mean", "user_label", "predicted", "probability_1", "probability_2"]
    assert {tuple(r)[2:] for r in table.collect()} == {(1, 1.5, 0, 1, 0.8, 0.2), (2, 2.5, 2, 0, None, None)}


def test_statistics_around_objects(spark):
    values = spark.createDataFrame([("a", 0, 0, 0, x, 0, float(x * x)) for x in range(6)], PX)
    labels = spark.createDataFrame([("a", 0, 0, 0, 2, 0, 1), ("a", 0, 0, 0, 3, 0, 2)], "image_id string, t int, z int, y int, x int, c int, v long")
    got = {r["object_id"]: r.asDict() for r in objects.neighbourhood_statistics(values, labels, 1).collect()}
    assert (got[1]["shell_count"], got[1]["shell_sum"], got[1]["both_max"], got[2]["shell_min"], got[2]["both_mean"]) == (2, 10.0, 9.0, 4.0, 29 / 3)
    lone = objects.neighbourhood_statistics(values.where("x = 2"), labels.where("x = 2"), 1).first()
    assert lone["shell_count"] == 0 and lone["shell_mean"] is None and lone["both_mean"] == 4.0 and lone["both_var"] == 0.0
    assert objects.neighbourhood_statistics(values, labels.where(F.lit(False)), 1).count() == 0


def test_shells_across_blocks_are_those_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    raw = [("a", 0, 0, y, x, 0, float(rng.integers(1, 9))) for y in range(12) for x in range(11) if rng.random() < 0.7]
    own = [("a", 0, 0, y, x, 0, int(rng.integers(1, 4))) for y in range(12) for x in range(11) if rng.random() < 0.3]
    monkeypatch.setattr(objects, "SHELL_BLOCK", 5)
    px = "image_id string, t int, z int, y int, x int, c int, v "
    found = objects.neighbourhood_features(spark.createDataFrame(raw, px + "double"), spark.createDataFrame(own, px + "long"), 2)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the blocks and the objects
    want = {}
    for k in (1, 2, 3):
        mine = {(o[3], o[4]) for o in own if o[6] == k}
        shell = [r[6] for r in raw if (r[3], r[4]) not in mine and any((r[3] - y) ** 2 + (r[4] - x) ** 2 <= 4 for y, x in mine)]
        want[k] = (len(shell), round(sum(shell) / len(shell), 9))
    assert {r["object_id"]: (r["shell_count"], round(r["shell_mean"], 9)) for r in found.collect()} == want


def test_texture_and_resizing_take_one_shuffle(spark):
    px = spark.createDataFrame([("a", 0, 0, 3, 4, 0, 2.0)], "image_id string, t int, z int, y int, x int, c int, v double")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(objects.lbp_image(px)) == 1
    assert shuffles(geometry.resize(px, {"y": 9, "x": 9}, {"y": 20, "x": 140}, 3, spline=True)) == 1
    assert [r["code"] for r in objects.lbp_image(px).collect()] == [0]


def test_links_of_small_and_large_frames_are_chosen_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("a", t, int(s), int(d), float(rng.integers(0, 5))) for t in (0, 1) for s in range(8) for d in rng.permutation(8)[:3]]
    links = spark.createDataFrame([*rows, ("a", 0, 1, 99, None)], "image_id string, t int, src long, dst long, cost double")
    want = []
    for t in (0, 1):
        taken = (set(), set())
        for _, s, d in sorted((c, s, d) for _, u, s, d, c in rows if u == t):
            if s not in taken[0] and d not in taken[1]:
                taken[0].add(s), taken[1].add(d), want.append((t, s, d))
    found = lambda: sorted((r["t"], r["src"], r["dst"]) for r in tracking.link_tracks(links).collect())
    assert found() == sorted(want)
    monkeypatch.setattr(tracking, "LINKS_AT_ONCE", 0)
    assert found() == sorted(want)
