"""Object classification, edge training, feature choice, catalogs, exports, tables of tracking, scoring of new images."""

import io

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from voxelry.operators import components, filters, learning, object_classes, objects, regions, superpixels, tracking
from voxelry.sources import files
from voxelry.streaming.scoring import score_new_images

PX = "image_id string, t int, z int, y int, x int, c int, v double"


def objects_of(spark, rows):
    return spark.createDataFrame([("a", 0, i, *r) for i, r in enumerate(rows, 1)], "image_id string, t int, object_id long, count double, mean double")


def test_objects_are_learned_and_predicted(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(10 if i % 2 else 30, 2)), float(rng.normal(5))) for i in range(60)]
    table = objects_of(spark, [*rows, (None, 5.0), (float("inf"), float("nan"))])
    labels = spark.createDataFrame([("a", 0, i + 1, 1 + i % 2) for i in range(40)] + [("a", 0, 50, 0), ("a", 0, 999, 2)], "image_id string, t int, object_id long, label int")
    assert object_classes.selected_features(table) == ["count", "mean"]
    assert object_classes.feature_array(table, labels).count() == 40
    for learner in (None, lambda seed: LogisticRegression(maxIter=20)):
        model = object_classes.object_train(table, labels, trees=10, learner=learner)
        found = {r["object_id"]: r for r in object_classes.object_predict(table, model, 3).collect()}
        assert len(found) == 62 and all(found[i + 1]["predicted"] == 1 + i % 2 for i in range(60))
        assert found[61]["bad"] == ["count"] and found[62]["bad"] == ["count", "mean"]
        for r in found.values():
            assert len(r["p"]) == 3 and r["p"][2] == 0 and sum(r["p"]) == pytest.approx(1)
            assert r["uncertainty"] == pytest.approx(1 - abs(r["p"][0] - r["p"][1]))
    warned = object_classes.bad_objects(object_classes.object_predict(table, None, 3)).collect()
    assert [(r["objects"], r["features"]) for r in warned] == [(2, ["count", "mean"])]


def test_no_labels_give_no_classes(spark):
    table = objects_of(spark, [(1.0, 2.0), (3.0, 4.0)])
    assert object_classes.object_train(table, spark.createDataFrame([], "image_id string, t int, object_id long, label int")) is None
    rows = object_classes.object_predict(table, None, 2).collect()
    assert [(r["predicted"], list(r["p"])) for r in rows] == [(0, [0.0, 0.0])] * 2
    with pytest.raises(ValueError):
        object_classes.selected_features(table, ["size"])


def test_class_and_probability_images(spark):
    lab = spark.createDataFrame([("a", 0, 0, 0, x, 0, 1 + x // 2) for x in range(6)], PX.replace("double", "long"))
    predictions = spark.createDataFrame([("a", 0, 1, 2, [0.25, 0.75]), ("a", 0, 2, 1, [1.0, 0.0])], "image_id string, t int, object_id long, predicted int, p array<double>")
    image = {r["x"]: r["v"] for r in object_classes.class_image(lab, predictions).collect()}
    assert image == {0: 2, 1: 2, 2: 1, 3: 1, 4: 0, 5: 0}
    channels = {(r["x"], r["c"]): r["v"] for r in object_classes.probability_images(lab, predictions, 2).collect()}
    assert channels[0, 1] == 0.75 and channels[3, 0] == 1.0 and len(channels) == 8


def test_edges_are_learned(spark):
    rng = np.random.default_rng(1)
    tile = lambda a: a // 4
    sp = spark.createDataFrame([("a", 0, 0, y, x, 0, int(1 + tile(y) * 4 + tile(x))) for y in range(16) for x in range(16)], PX.replace("double", "long"))
    truth = sp.withColumn("v", F.floor(F.col("x") / 8) + 1)
    raw = spark.createDataFrame([("a", 0, 0, y, x, 0, float(rng.normal(9.0 if x in (7, 8) else 1.0, 0.3))) for y in range(16) for x in range(16)], PX)
    labels = superpixels.edge_labels_from_segments(sp, truth)
    cut = {(r["sp1"], r["sp2"]) for r in labels.where("label = 2").collect()}
    assert cut == {(k, k + 1) for k in (2, 6, 10, 14)}
    nodes, p, image = superpixels.edge_training_multicut(sp, raw, labels, trees=5)
    assert {(r["sp1"], r["sp2"]) for r in p.where("p > 0.5").collect()} == cut
    assert len({r["segment"] for r in nodes.collect()}) == 2 and image.count() == 256
    assert image.join(truth.select("y", "x", F.col("v").alias("w")), ["y", "x"]).select("v", "w").distinct().count() == 2
    one = labels.where("label = 1")
    edges = superpixels.edge_features(sp, raw)
    assert superpixels.train_edges(edges, one) is None
    assert superpixels.trained_probabilities(edges, None).count() == edges.count()


def test_chosen_features_are_channels(spark, small):
    rng = np.random.default_rng(2)
    px = spark.createDataFrame([("a", 0, 0, y, x, 0, float(v)) for (y, x), v in np.ndenumerate(rng.random((20, 20)))], PX)
    got = filters.select_features(px, {"gradient": [1.0], "gaussian": [1.0, 0.7]}, block=8)
    assert {(r["c"], r["name"]) for r in got.select("c", "name").distinct().collect()} == {(0, "gaussian 0.7"), (1, "gaussian 1.0"), (2, "gradient 1.0")}
    plain = {(r["y"], r["x"]): r["v"] for r in filters.gaussian_smoothing(px, 1.0, "yx", {"y": 20, "x": 20}).collect()}
    assert all(r["v"] == pytest.approx(plain[r["y"], r["x"]], abs=1e-5) for r in got.where("c = 1").collect())
    for wrong in ({}, {"nothing": [1.0]}):
        with pytest.raises(ValueError):
            filters.select_features(px, wrong)


def test_masked_pixels_are_not_predicted(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, x, 0, float(x > 3), [float(x)], 1 + int(x > 3)) for x in range(8)], PX + ", f array<double>, label int")
    model = learning.train(rows, trees=3)
    mask = spark.createDataFrame([("a", 0, 0, 0, x, 0, float(x != 2)) for x in range(6)], PX)
    found = {r["x"]: list(r["p"]) for r in learning.predict(rows.drop("label"), model, 2, mask=mask).collect()}
    assert len(found) == 8 and all((sum(p) == 0) == (x in (2, 6, 7)) for x, p in found.items())


def test_catalog_finds_what_does_not_fit(spark):
    px = lambda name, n: spark.createDataFrame([(name, 0, 0, y, x, 0, 1.0) for y in range(3) for x in range(n)], PX)
    good = files.dataset_catalog({"raw": px("a", 4), "labels": px("a", 4)})
    assert files.check_catalog(good, "raw").count() == 2
    bad = files.dataset_catalog({"raw": px("a", 4), "labels": px("a", 5), "more": px("b", 4)})
    assert {(r["image_id"], r["missing"], tuple(r["differs"])) for r in files.catalog_mismatches(bad, "raw").collect()} == {("a", False, ("x",)), ("b", True, ())}
    with pytest.raises(ValueError, match="labels"):
        files.check_catalog(bad, "raw")


def test_results_are_exported(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, 0, y, x, 0, float(10 * y + x)) for y in range(5) for x in range(7)], PX)
    at = files.export_selected({"Raw": px, "Other": px.limit(0)}, "Raw", f"{tmp_path}/{{lane}}_{{choice}}", {"lane": "one"}, "npy")
    assert at == f"{tmp_path}/one_raw"
    blocks = spark.read.parquet(at).collect()
    assert len(blocks) == 1 and np.load(io.BytesIO(blocks[0]["npy"]))[0, 4, 6] == 46.0
    files.write_volume(px, f"{tmp_path}/csv", "csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 35
    for wrong in ({"choice": "None"}, {"choice": "Raw", "kind": "tiff"}):
        with pytest.raises(ValueError):
            files.export_selected({"Raw": px}, path=f"{tmp_path}/x", lane={}, **wrong)


def test_tracking_tables(spark):
    table = spark.createDataFrame([("a", t, o, 5) for t in range(2) for o in (1, 2)], "image_id string, t int, object_id long, count int")
    tree = spark.createDataFrame([("a", 0, 1, 7, 3, 0), ("a", 1, 1, 8, 3, 7), ("a", 1, 2, 9, 3, 7)], "image_id string, t int, object_id long, track_id long, lineage_id long, parent_track_id long")
    rows = [tuple(r) for r in tracking.full_tracking_table(table, tree).collect()]
    assert rows == [("a", 0, 1, 7, 3, 0, 0, 5), ("a", 0, 2, -1, -1, 0, 0, 5), ("a", 1, 1, 8, 3, 7, 0, 5), ("a", 1, 2, 9, 3, 7, 0, 5)]
    assert {r["value"] for r in tracking.track_lines(tree).collect()} == {"7 0 0 0", "8 1 1 7", "9 1 1 7"}
    costs = {r["k"]: r["cost"] for r in tracking.detection_costs(table.limit(1), {0: 0.1, 1: 0.9}).collect()}
    assert costs[0] == pytest.approx(-10 * np.log(0.1)) and costs[1] == pytest.approx(-10 * np.log(0.9))
    cutouts = objects.object_cutouts(spark.createDataFrame([("a", 0, 0, 1, 1, 0, 1)], PX.replace("double", "long")), spark.createDataFrame([("a", 0, 0, y, x, 0, 1.0) for y in range(3) for x in range(3)], PX), 1)
    joined = {(r["t"], r["object_id"]): r["cutout"] for r in objects.object_table_with_cutouts(table, cutouts).collect()}
    assert len(joined[0, 1]) == 9 and sum(p["mask"] for p in joined[0, 1]) == 1 and joined[1, 2] is None


def test_two_levels_with_smoothing_and_channels(spark):
    spot = [("a", 0, 0, y, x, c, 100.0) for y in range(4, 8) for x in range(4, 8) for c in (0, 1)] + [("a", 0, 0, 20, 20, 0, 100.0)]
    got = regions.two_level_pipeline(spark.createDataFrame(spot, PX), 0.3, 0.8, 4, 100, (0.0, 100.0), {"z": 0.0, "y": 0.7, "x": 0.7}, {"y": 32, "x": 32}, 0, 1).collect()
    assert {r["v"] for r in got} == {1} and all(2 <= r["y"] <= 9 and 2 <= r["x"] <= 9 for r in got) and len(got) >= 16


def test_new_images_are_scored_once(spark, tmp_path):
    image = lambda name: spark.createDataFrame([(name, 0, 0, 0, x, 0, float(x)) for x in range(4)], PX)
    paths = [f"{tmp_path}/{p}" for p in ("in", "out", "checkpoint")]
    score = lambda batch: batch.groupBy("image_id").agg(F.sum("v").alias("total"))
    for name in ("a", "b"):
        image(name).coalesce(1).write.mode("append").parquet(paths[0])
        score_new_images(spark, *paths, score).awaitTermination()
    assert sorted((r["image_id"], r["total"]) for r in spark.read.parquet(paths[1]).collect()) == [("a", 6.0), ("b", 6.0)]


def test_numbers_do_not_depend_on_chunks(spark):
    rows = spark.createDataFrame([(k, i * 3) for k in "ab" for i in range(50)], "k string, i long")
    for chunk in (F.lit(0), F.floor(F.col("i") / 7), F.floor(F.col("i") / 1000)):
        got = {(r["k"], r["i"]): r["number"] for r in components.numbered(rows, ["k"], "i", chunk, 5).collect()}
        assert got == {(k, i * 3): i + 5 for k in "ab" for i in range(50)}
    assert components.numbered(rows.limit(0), ["k"], "i", F.lit(0)).count() == 0
