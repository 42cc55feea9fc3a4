"""Registered queries of object classification, edge training, catalogs and tables of tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import assignment, filters, geometry, labels, learning, object_classes, objects, regions, superpixels, tracking
from voxelry.plans.queries import (
    COMPONENTS, DIVISION_COLUMNS, EDGES, FACES, FEATURES, LABELS, LEVEL, PAINTED, PX_FRAMES, SHAPE, TILES, WINDOWS, P, _edges, _superpixels, _with, features_of_sales, labels_of_sales, px_frames, query, rounded, window_divisions,
)
from voxelry.plans.stored import written
from voxelry.sources import files, tables
from voxelry.sources.tables import COORDINATES, PX_CHANNELS, PX_SALES, PX_TIME, STROKES, px_sales, px_time

OBJECT = objects.OBJECT
LINK = ["image_id", "t", "src", "dst"]

# objects


def _marked(f):
    """Labels of two thirds of the objects: large or bright ones are of class 2."""
    return f.where("object_id % 3 <> 0").select(*OBJECT, F.when((F.col("count") >= 6) | (F.col("max") >= 110), 2).otherwise(1).alias("label"))


MARKED = "marked as (select image_id, t, object_id, case when count >= 6 or max >= 110 then 2 else 1 end as label from f where object_id % 3 <> 0)"


@query("o15_feature_array", _with(LABELS, FEATURES, MARKED) + "select image_id, t, object_id, label, count::double as f_count, round(mean, 6) as f_mean, sum::double as f_sum from f join marked using (image_id, t, object_id)")
def o15(spark, sf_dir):
    f = written(features_of_sales(spark, sf_dir), "features")
    a = object_classes.feature_array(f, _marked(f), ["sum", "mean", "count"])
    return rounded(a.select(*OBJECT, "label", *(F.get("f", F.lit(i)).alias(f"f_{c}") for i, c in enumerate(["count", "mean", "sum"]))), "f_mean")


@query("o16_replace_missing", _with(LABELS, FEATURES) + "select image_id, t, object_id, case when object_id % 4 = 0 then 0.0 else round(mean, 6) end as mean, case when object_id % 4 = 1 then 0.0 else sum end as sum, case object_id % 4 when 0 then 'mean' when 1 then 'sum' else '' end as bad from f")
def o16(spark, sf_dir):
    f = features_of_sales(spark, sf_dir).select(*OBJECT, F.when(F.col("object_id") % 4 != 0, F.col("mean")).alias("mean"), F.when(F.col("object_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("sum")).alias("sum"))
    return rounded(objects.replace_missing(f, ["mean", "sum"]).withColumn("bad", F.concat_ws(",", "bad")), "mean")


@query("o18_object_predictions")
def o18(spark, sf_dir):
    f = written(features_of_sales(spark, sf_dir), "features")
    predictions = object_classes.object_predict(f, object_classes.object_train(f, _marked(f), ["count", "max", "mean"], trees=10), 2, ["count", "max", "mean"])
    return predictions.select(*OBJECT, "predicted", F.get("p", F.lit(0)).alias("p_1"), F.get("p", F.lit(1)).alias("p_2"), "uncertainty")


@query("o19_object_classes")
def o19(spark, sf_dir):
    px, lab = px_sales(spark, sf_dir), written(labels_of_sales(spark, sf_dir), "labels")
    f = objects.region_features(px, lab)
    return object_classes.object_classification(px, lab, _marked(f), 2, ["count", "max"], trees=5)[1]


@query("s14_object_table", _with(LABELS, FEATURES, MARKED) + "select image_id, t, object_id, count, coalesce(label, 0) as user_label, case when object_id % 2 = 0 then 1 else 0 end as predicted from f left join marked using (image_id, t, object_id)")
def s14(spark, sf_dir):
    f = written(features_of_sales(spark, sf_dir), "features")
    predicted = f.where("object_id % 2 = 0").select(*OBJECT, F.lit(1).alias("label"))
    return objects.object_table(f.select(*OBJECT, "count"), _marked(f), predicted)


@query("s21_catalog_mismatches", _with(PX_SALES) + "select image_id, 'labels' as role, false as missing, 'x' as differs from px group by image_id having max(x) >= 40 union all select image_id || '?', 'more', true, '' from px group by image_id")
def s21(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    catalog = files.dataset_catalog({"raw": px, "labels": px.where("x < 40"), "more": px.withColumn("image_id", F.concat("image_id", F.lit("?")))})
    return files.catalog_mismatches(catalog, "raw").withColumn("differs", F.concat_ws(",", "differs"))


# regions and labels


@query("r04_zero_based_mapping", _with(LABELS) + "select image_id, t, v as old, dense_rank() over (partition by image_id, t order by v) - 1 as new from lab where v % 2 = 0 group by image_id, t, v")
def r04(spark, sf_dir):
    return regions.relabel_mapping(labels_of_sales(spark, sf_dir).where("v % 2 = 0"), 0)


_CORES = COMPONENTS.format(level="90")
for _name in ("bright", "near", "reach", "root", "lab"):
    _CORES = _CORES.replace(f"{_name} as (", f"{_name}_c as (").replace(f"from {_name} ", f"from {_name}_c ").replace(f"join {_name} ", f"join {_name}_c ").replace(f"from {_name})", f"from {_name}_c)").replace(f"from {_name} group", f"from {_name}_c group")
TWO_LEVELS = (
    "core_sizes as (select image_id, t, v from lab_c group by all having count(*) >= 2), "
    "hit as (select distinct lab.image_id, lab.t, lab.v from lab join lab_c k using (image_id, t, z, y, x) join core_sizes s on s.image_id = k.image_id and s.t = k.t and s.v = k.v), "
    "kept as (select image_id, t, v from lab group by all having count(*) >= 2), "
    "two as (select lab.* from lab join hit using (image_id, t, v) join kept using (image_id, t, v))"
)


@query("r08_two_levels", _with(LABELS, _CORES, TWO_LEVELS) + f"select {P}, c, dense_rank() over (partition by image_id, t order by v) as v from two")
def r08(spark, sf_dir):
    return regions.two_level_pipeline(px_sales(spark, sf_dir), 0.6, 0.9, 2, 10**6, (0.0, 100.0))


BOX = "select image_id, t, v as object_id, min(y) as y0, max(y) + 1 as y1, min(x) as x0, max(x) + 1 as x1 from {lab} group by all"


@query(
    "l09_transfer_labels",
    _with(LABELS, _CORES, f"o as ({BOX.format(lab='lab_c')})", f"n as ({BOX.format(lab='lab')})", "p as (select o.image_id, o.t, o.object_id, n.object_id as new_id, (least(o.y1, n.y1) - greatest(o.y0, n.y0)) * (least(o.x1, n.x1) - greatest(o.x0, n.x0)) as overlap from o join n on n.image_id = o.image_id and n.t = o.t and o.y0 < n.y1 and n.y0 < o.y1 and o.x0 < n.x1 and n.x0 < o.x1)", "b as (select image_id, t, object_id, new_id, overlap, object_id % 2 + 1 as label from (select *, row_number() over (partition by image_id, t, object_id order by overlap desc, new_id) as k from p) where k = 1)")
    + "select *, case when min(label) over w <> max(label) over w then 'conflict' else 'kept' end as state from b window w as (partition by image_id, t, new_id)",
)
def l09(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    boxes = lambda level: regions.object_bounding_boxes(regions.labeled_threshold(px, level)).select(*OBJECT, "y0", "y1", "x0", "x1")
    return labels.transfer_object_labels(boxes(90.0).withColumn("label", F.col("object_id") % 2 + 1), boxes(LEVEL))


@query("l10_label_pipeline", f"with {STROKES}, {PAINTED} select image_id, v, count(*) as n from lab group by all")
def l10(spark, sf_dir):
    return labels.label_pipeline(tables.strokes(spark, sf_dir), {"y": 8, "x": 8})[2]


# matrices and stored results


@query("c02_concat_matrices", _with(PX_SALES) + "select case when v >= 60 then 2 else 1 end as label, count(*) as n, round(sum(v), 4) as total from px group by 1")
def c02(spark, sf_dir):
    matrix = lambda flag: px_sales(spark, sf_dir).where(F.col("image_id").startswith(flag)).select(F.when(F.col("v") >= 60, 2).otherwise(1).alias("label"), F.array("v").alias("f"))
    rows = learning.concat_matrices([matrix(flag) for flag in "ANR"])
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("f", F.lit(0))), 4).alias("total"))


@query("c13_held_out_error")
def c13(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    matrix = written(px.select(F.when(F.col("v") + F.col("y") >= 60, 2).otherwise(1).alias("label"), F.array("v", F.col("y").cast("double")).alias("f")), "matrix")
    return spark.createDataFrame([(learning.held_out_error(matrix, trees=5),)], "error double")


@query("c15_stored_segmentation", _with(PX_CHANNELS) + f"select {P}, 0 as c, c + 1 as v from (select *, row_number() over (partition by {P} order by v desc, c) as k from px) where k = 1")
def c15(spark, sf_dir):
    return learning.predictions_to_segmentation(written(px_sales(spark, sf_dir, True), "probabilities"))


@query("c15_stored_uncertainty", _with(PX_CHANNELS) + f"select {P}, 0 as c, round(case when count(*) > 1 then 1 - (max(v) - max(case when k = 2 then v end)) else 0.0 end, 6) + 0.0 as v from (select *, row_number() over (partition by {P} order by v desc, c) as k from px) group by {P}")
def c15_uncertainty(spark, sf_dir):
    return rounded(learning.predictions_to_uncertainty(written(px_sales(spark, sf_dir, True), "probabilities")), "v")


@query("l10_labelled_blocks", f"with {STROKES}, {PAINTED} select distinct image_id, t, cast(y // 8 as int) as by, cast(x // 8 as int) as bx from lab where v <> 0")
def l10_blocks(spark, sf_dir):
    return labels.label_pipeline(tables.strokes(spark, sf_dir), {"y": 8, "x": 8})[1]


@query("l04_clear_label", f"with {STROKES}, {PAINTED} select image_id, t, z, y, x, c, v from lab where v <> 2")
def l04_clear(spark, sf_dir):
    return labels.clear_label(labels.paint(tables.strokes(spark, sf_dir)), 2).select(*COORDINATES, "v")


STATISTICS = ["count", "mean", "sum", "min", "max", "deviation"]


@query("o02_moments", _with(LABELS) + "select *, case when m2 > 0 then round(m3 / m2 ** 1.5, 5) + 0.0 else 0.0 end as skew, case when m2 > 0 then round(m4 / m2 ** 2 - 3, 5) + 0.0 else 0.0 end as kurt from (select image_id, t, object_id, avg((v - m) ** 2) as m2, avg((v - m) ** 3) as m3, avg((v - m) ** 4) as m4 from (select px.image_id, px.t, lab.v as object_id, px.v, avg(px.v) over (partition by px.image_id, px.t, lab.v) as m from px join lab using (image_id, t, z, y, x)) group by all)".replace("select *, case", "select image_id, t, object_id, case", 1))
def o02(spark, sf_dir):
    f = features_of_sales(spark, sf_dir)
    return f.select(*OBJECT, *(F.round(c, 5) + F.lit(0.0) for c in ("skew", "kurt"))).toDF(*OBJECT, "skew", "kurt")


@query(
    "o07_statistics",
    _with(LABELS, "nearby as (select l.image_id, l.t, l.v as object_id, px.y, px.x, px.v, max(case when px.y = l.y and px.x = l.x then 1 else 0 end) as own from lab l join px on px.image_id = l.image_id and px.t = l.t and (px.y - l.y) ** 2 + (px.x - l.x) ** 2 <= 4 group by all)")
    + "select image_id, t, object_id, " + ", ".join(f"{f'round({e}, 5)' if s in ('mean', 'sum') else e} as {n}_{s}" for n, v in (("shell", "case when own = 0 then v end"), ("both", "v")) for s, e in (("count", f"count({v})"), ("mean", f"avg({v})"), ("sum", f"sum({v})"), ("min", f"min({v})"), ("max", f"max({v})"), ("deviation", f"round(stddev_pop({v}), 5)"))) + " from nearby group by all",
)
def o07_statistics(spark, sf_dir):
    found = objects.neighbourhood_statistics(px_sales(spark, sf_dir), labels_of_sales(spark, sf_dir), 2)
    found = found.withColumns({f"{n}_deviation": F.sqrt(f"{n}_var") for n in ("shell", "both")})
    return found.select(*OBJECT, *((F.round(c, 5) if s in ("mean", "sum", "deviation") else F.col(c)).alias(c) for n in ("shell", "both") for s in STATISTICS for c in [f"{n}_{s}"]))


@query("g23_contact_shell", _with(PX_SALES, "l as (select image_id, t, z, y, x, case when v < 20 then 1 when v >= 60 then 2 end as v from px)") + f"select b.image_id, b.t, b.z, b.y, b.x from l b join l a on a.image_id = b.image_id and a.t = b.t and a.v = 1 and b.v = 2 group by all having min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) > 1 and min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) <= 4")
def g23_shell(spark, sf_dir):
    two = px_sales(spark, sf_dir).withColumn("v", F.when(F.col("v") < 20, 1).when(F.col("v") >= 60, 2))
    return geometry.contact_pixels(two, 1, 2, 2, shell=True)


@query("g20_merged_metadata", _with(PX_SALES) + "select image_id, max(t) + 1 as n_t, case when image_id like 'A%' then 99 else count(*) end as pixels, case when image_id like 'A%' then 'first' end as nickname from px group by image_id")
def g20_merged(spark, sf_dir):
    meta = geometry.image_meta(px_sales(spark, sf_dir)).select("image_id", "n_t", "pixels")
    other = meta.where("image_id like 'A%'").select("image_id", F.lit(99).cast("long").alias("pixels"), F.lit("first").alias("nickname"))
    return geometry.merge_metadata(meta, other).select("image_id", "n_t", "pixels", "nickname")


@query("m01_missing_windows", _with(PX_TIME, "s as (select unnest([0, 7, 14, 17]) as s)") + "select image_id, t, z, c, a.s as y0, b.s as x0, count(*) as pixels, max(greatest(least(floor(v * 30 / 900.0), 29), 0)) = 0 as missing from px, s a, s b where y >= a.s - 2 and y < a.s + 9 and x >= b.s - 2 and x < b.s + 9 group by all")
def m01_windows(spark, sf_dir):
    from voxelry.operators.missing import missing_windows

    return missing_windows(px_time(spark, sf_dir), {"y": 24, "x": 24}, 7, 2, 30, (0.0, 900.0))


@query("s12_formatted", _with(PX_SALES) + "select image_id, cast(x as int) as x, cast(y - 5 as int) as y, t, z, c, cast(round(greatest(least(v, 120.0), 0.0) / 120.0 * 255) as int) as v from px where y >= 5 and y < 30".replace("greatest(least(v, 120.0), 0.0)", "v") + " and v between 0 and 120")
def s12(spark, sf_dir):
    px = px_sales(spark, sf_dir).where("v between 0 and 120")
    return files.formatted(px, {"y": 5, "x": -3}, {"y": 30, "x": 99}, (0.0, 120.0), 255.0, "int", "xytzc")


@query("s19_count_table", _with(PX_SALES) + "select 'lane ' || image_id as nickname, round(sum(v), 4) as total from px group by image_id")
def s19(spark, sf_dir):
    from voxelry.operators.counting import count_table

    px = px_sales(spark, sf_dir)
    names = px.select("image_id", F.concat(F.lit("lane "), "image_id").alias("nickname")).distinct()
    return count_table(px, names).select("nickname", F.round("total", 4).alias("total"))


@query("f11_select_features")
def f11(spark, sf_dir):
    return filters.select_features(px_sales(spark, sf_dir), {"gaussian": [0.7, 1.6], "gradient": [1.0]}, block=16)


# edges


EDGE_LABELS = "el as (select image_id, sp1, sp2, (sp1 + sp2) % 3 as label from e)"


def _edge_labels(edges):
    return edges.select(*superpixels.EDGE, ((F.col("sp1") + F.col("sp2")) % 3).cast("int").alias("label"))


@query("w06_edge_matrix", _with(PX_FRAMES, TILES, FACES, EDGES, EDGE_LABELS) + "select image_id, sp1, sp2, label, max::double as f_max, round(mean, 6) as f_mean, n::double as f_n from e join el using (image_id, sp1, sp2) where label in (1, 2)")
def w06(spark, sf_dir):
    edges = written(_edges(spark, sf_dir), "edges")
    m = superpixels.edge_matrix(edges, _edge_labels(edges))
    return rounded(m.select(*superpixels.EDGE, "label", F.get("f", F.lit(0)).alias("f_max"), F.get("f", F.lit(1)).alias("f_mean"), F.get("f", F.lit(3)).alias("f_n")), "f_mean")


@query("w06_edge_labels", _with(PX_FRAMES, TILES, FACES) + "select distinct image_id, sp1, sp2, case when (sp1 - 1) // 16 = (sp2 - 1) // 16 and (sp1 - 1) % 8 // 2 = (sp2 - 1) % 8 // 2 then 1 else 2 end as label from faces")
def w06b(spark, sf_dir):
    truth = px_frames(spark, sf_dir).withColumn("v", F.floor(F.col("y") / 12) * 4 + F.floor(F.col("x") / 12) + 1)
    return superpixels.edge_labels_from_segments(_superpixels(spark, sf_dir), truth)


@query("w07_trained_probabilities")
def w07(spark, sf_dir):
    edges = written(_edges(spark, sf_dir), "edges")
    marks = edges.where("(sp1 + sp2) % 2 = 0").select(*superpixels.EDGE, F.when(F.col("mean") >= 45, 2).otherwise(1).alias("label"))
    return superpixels.trained_probabilities(edges, superpixels.train_edges(edges, marks, trees=5))


@query("w13_edge_training_multicut")
def w13(spark, sf_dir):
    sp, px = _superpixels(spark, sf_dir), px_frames(spark, sf_dir)
    truth = px.withColumn("v", F.floor(F.col("y") / 12) * 4 + F.floor(F.col("x") / 12) + 1)
    return superpixels.edge_training_multicut(sp, px, superpixels.edge_labels_from_segments(sp, truth), trees=5)[0]


# tracking


@query("t05_combined_features", _with(LABELS, FEATURES, WINDOWS) + "select f.image_id, f.t, f.object_id, count, " + ", ".join(f"round({c} + 1e-9, 5) as {c}" for c in DIVISION_COLUMNS) + " from f left join divs on divs.image_id = f.image_id and divs.t = f.t and divs.object_id = f.object_id")
def t05(spark, sf_dir):
    f, divisions = window_divisions(spark, sf_dir)
    both = tracking.combined_features(f.select(*OBJECT, "count"), divisions)
    return both.select(*OBJECT, "count", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in DIVISION_COLUMNS))


@query("t06_border_costs", _with(LABELS, FEATURES, "k as (select image_id, t, object_id, least(cy, 47 - cy, cx, 47 - cx) as m from f)", "s as (select *, case when m >= 10 then 1.0 else greatest(m, 0.0) / 10.0 end as s from k)") + "select image_id, t, object_id, round(case when t = 0 then 0.0 else 500.0 * s end, 6) as appear, round(case when t = 6 then 0.0 else 300.0 * s end, 6) as disappear from s")
def t06(spark, sf_dir):
    return rounded(tracking.border_costs(features_of_sales(spark, sf_dir), 6, SHAPE, 500.0, 300.0, 10.0), "appear", "disappear")


@query("t06_division_costs", _with(LABELS, FEATURES, "k as (select image_id, t, object_id, least(count / 50.0, 1.0) as p from f)") + "select image_id, t, object_id, d as divides, round(-10.0 * ln(least(greatest(case when d then p else 1 - p end, 0.0000000001), 0.9999999999)), 5) as cost from k, (select unnest([true, false]) as d)")
def t06b(spark, sf_dir):
    p = features_of_sales(spark, sf_dir).select(*OBJECT, F.least(F.col("count") / 50.0, F.lit(1.0)).alias("p"))
    return tracking.division_costs(p).withColumn("cost", F.round("cost", 5) + F.lit(0.0))


def _joint(spark, sf_dir):
    """Tracking as a whole: links by distance, borders, false detections by size, divisions by size and shape of the children."""
    f, divisions = window_divisions(spark, sf_dir)
    borders = tracking.border_costs(f, 6, SHAPE, 60.0, 60.0, 10.0)
    cells = f.select(*OBJECT, F.array(F.greatest(0.6 - F.col("count") / 20.0, F.lit(0.05)), F.least(0.4 + F.col("count") / 20.0, F.lit(0.95))).alias("p"))
    able = f.join(divisions, OBJECT).where("angle >= 90 and count >= 4").select(*OBJECT, F.least(F.coalesce("children_ratio", F.lit(0.0)), F.lit(0.9)).alias("p"))
    nodes = written(assignment.tracking_problem(f, borders, tracking.detection_costs(cells), tracking.division_costs(able)), "nodes")
    links = written(tracking.link_costs(tracking.candidate_links(f, 3, 12.0)), "links")
    return nodes, links


@query("t07_joint_links")
def t07_joint(spark, sf_dir):
    links, false = assignment.joint_links(*_joint(spark, sf_dir))
    return links.select(*LINK, F.round("cost", 6).alias("cost"), "second").unionByName(false.select("image_id", "t", F.col("object_id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("cost"), F.lit(False).alias("second")))


@query("t07_total_costs")
def t07_costs(spark, sf_dir):
    """The total cost of joint tracking for each image, beside that of mutually cheapest links."""
    nodes, links = _joint(spark, sf_dir)
    joint = assignment.assignment_cost(nodes, *assignment.joint_links(nodes, links))
    greedy = assignment.assignment_cost(nodes, tracking.link_tracks(links))
    return rounded(joint.join(greedy.withColumnRenamed("cost", "greedy_cost"), "image_id"), "cost", "greedy_cost")


@query("t11_refreshed_features", _with(LABELS, FEATURES) + "select image_id, t, object_id, case when object_id % 2 = 0 then count + 1000 else count end as count from f where object_id % 3 <> 0 or object_id % 2 = 0")
def t11(spark, sf_dir):
    f = written(features_of_sales(spark, sf_dir).select(*OBJECT, "count"), "features")
    return tracking.merge_refreshed_features(f.where("object_id % 3 <> 0"), f.where("object_id % 2 = 0").withColumn("count", F.col("count") + 1000))


@query("t13_track_annotations")
def t13_annotations(spark, sf_dir):
    """Annotations of the joint tracks: appearances, disappearances, divisions, and misdetections."""
    nodes, links = _joint(spark, sf_dir)
    chosen, false = assignment.joint_links(nodes, links)
    kept = nodes.select(*OBJECT).join(false, OBJECT, "left_anti")
    tree = tracking.family_tree(kept, chosen.where("not second"), chosen.where("second"))
    return tracking.tracking_annotations(written(tree, "tree"), 6, nodes.select(*OBJECT))


@query("t13_annotations", _with(LABELS) + "select image_id, v as track_id, min(t) as first, max(t) as last, min(t) > 0 as appears, max(t) < 6 as disappears from (select distinct image_id, t, v from lab) group by all")
def t13(spark, sf_dir):
    tracks = labels_of_sales(spark, sf_dir).select("image_id", "t", F.col("v").alias("track_id")).distinct()
    return tracking.annotations(tracks, 6)


# time


@query("m03_fill_missing", _with(PX_TIME, "q as (select image_id, t, z, c, y // 8 as py, x // 8 as px_, max(greatest(least(floor(v * 30 / 900.0), 29), 0)) = 0 as missing from px group by all)", "g as (select px.*, missing from px join q on q.image_id = px.image_id and q.t = px.t and q.z = px.z and q.c = px.c and q.py = px.y // 8 and q.px_ = px.x // 8)", "h as (select *, last_value(case when not missing then t end ignore nulls) over b as bt, last_value(case when not missing then v end ignore nulls) over b as bv, first_value(case when not missing then t end ignore nulls) over a as nt, first_value(case when not missing then v end ignore nulls) over a as av from g window b as (partition by image_id, z, y, x, c order by t rows between unbounded preceding and 1 preceding), a as (partition by image_id, z, y, x, c order by t rows between 1 following and unbounded following))") + f"select {P}, c, round(least(greatest(case when not missing then v when bt is not null and nt is not null then bv + (av - bv) * (t - bt) / (nt - bt) else coalesce(bv, av, 0.0) end, 0.0), 900.0), 6) as v from h")
def m03(spark, sf_dir):
    from voxelry.operators.missing import fill_missing_slices

    px = px_time(spark, sf_dir).withColumn("v", F.least("v", F.lit(900.0)))
    return rounded(fill_missing_slices(px, 8, 30, (0.0, 900.0), "t"), "v").select(*COORDINATES, "v")
