"""Registered queries of training, selection, counting, texture, skeletons, resizing and family trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import counting, filters, geometry, labels, learning, objects, regions, selection, tracking
from voxelry.plans.queries import ANNOTATED, FEATURES, LABELS, SHAPE, P, _annotation, _links, _painted, _smooth_sql, _with, features_of_sales, labels_of_sales, query, rounded
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES, PX_SALES, px_sales

# resizing and matrices of derivatives


def _linear_sql(source: str, axis: str, m: int, n: int, name: str) -> str:
    other = "x" if axis == "y" else "y"
    at = f"(i * {m - 1}::double / {n - 1})"
    return f"{name} as (select image_id, t, z, {other}, c, i::int as {axis}, sum(v * (1 - abs({at} - {axis}))) as v from {source}, (select unnest(range({n})) as i) where abs({at} - {axis}) < 1 group by image_id, t, z, {other}, c, i)"


@query("g11_resize_linear", _with(PX_SALES, _linear_sql("px", "y", 48, 60, "a"), _linear_sql("a", "x", 48, 70, "b")) + f"select {P}, c, round(v, 5) + 0.0 as v from b where abs(v) > 1e-4")
def g11(spark, sf_dir):
    px = geometry.resize(px_sales(spark, sf_dir), SHAPE, {"y": 60, "x": 70})
    return px.where("abs(v) > 1e-4").withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("g11_resize_shrunk", _with(PX_SALES, *_smooth_sql("px", 0.5, "g"), _linear_sql("g", "y", 48, 24, "a"), _linear_sql("a", "x", 48, 24, "b")) + f"select {P}, c, round(v, 5) + 0.0 as v from b where abs(v) > 1e-4")
def g11_shrunk(spark, sf_dir):
    """Images of half the size, smoothed beforehand."""
    px = geometry.resize(px_sales(spark, sf_dir), SHAPE, {"y": 24, "x": 24})
    return px.where("abs(v) > 1e-4").withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("g11_resize_spline")
def g11_spline(spark, sf_dir):
    px = geometry.resize(px_sales(spark, sf_dir), SHAPE, {"y": 60, "x": 70}, 3, spline=True)
    return px.where("abs(v) > 1e-4").withColumn("v", F.round("v", 5) + F.lit(0.0))


HESSIAN = [*_smooth_sql("px", 1.0, "hyy", 2, 0), *_smooth_sql("px", 1.0, "hyx", 1, 1), *_smooth_sql("px", 1.0, "hxx", 0, 2), f"h as (select {P}, max(case when k = 0 then v end) as a, max(case when k = 1 then v end) as b, max(case when k = 2 then v end) as d from (select *, 0 as k from hyy union all select *, 1 as k from hyx union all select *, 2 as k from hxx) group by {P})"]


@query("f06_hessian", _with(PX_SALES, *HESSIAN) + f"select {P}, u.c, round(u.v, 6) + 0.0 as v from (select *, unnest([{{'c': 0, 'v': a}}, {{'c': 1, 'v': b}}, {{'c': 2, 'v': d}}]) as u from h)")
def f06(spark, sf_dir):
    return rounded(filters.hessian(px_sales(spark, sf_dir), 1.0, SHAPE), "v")


@query("f03_hessian_eigenvalues", _with(PX_SALES, *HESSIAN, "e as (select *, (a + d) / 2 as m, sqrt(((a - d) / 2) ** 2 + b * b) as r from h)") + f"select {P}, 0 as c, round(m + r, 5) + 0.0 as v from e union all select {P}, 1 as c, round(m - r, 5) + 0.0 as v from e")
def f03(spark, sf_dir):
    return filters.hessian_eigenvalues(px_sales(spark, sf_dir), 1.0, SHAPE).withColumn("v", F.round("v", 5) + F.lit(0.0))


_UPPER = f"select {P}, max(case when c = 0 then v end) as a, max(case when c = 1 then v end) as b, max(case when c = 2 then v end) as d from"
TENSOR = [*_smooth_sql("px", 1.0, "gy", 1, 0), *_smooth_sql("px", 1.0, "gx", 0, 1), f"two as ({_UPPER} (select {P}, 0 as c, v from gy union all select {P}, 1 as c, v from gx) group by {P})", f"products as (select {P}, u.c, u.v from (select *, unnest([{{'c': 0, 'v': a * a}}, {{'c': 1, 'v': a * b}}, {{'c': 2, 'v': b * b}}]) as u from two))", *_smooth_sql("products", 0.5, "s"), f"h as ({_UPPER} s group by {P})"]


@query("f05_structure_tensor", _with(PX_SALES, *TENSOR, "e as (select *, (a + d) / 2 as m, sqrt(((a - d) / 2) ** 2 + b * b) as r from h)") + f"select {P}, 0 as c, round(m + r, 5) + 0.0 as v from e union all select {P}, 1 as c, round(m - r, 5) + 0.0 as v from e")
def f05(spark, sf_dir):
    return filters.structure_tensor_eigenvalues(px_sales(spark, sf_dir), 1.0, 0.5, SHAPE).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("f12_anisotropic_smoothing", _with(PX_SALES, *[s.replace("px_", "p_") for s in (_smooth_sql("px", 0.7, "q")[0], _smooth_sql("q_y", 1.5, "r")[1].replace("from r_y", "from q_y"))]) + f"select {P}, c, round(v, 6) + 0.0 as v from r")
def f12(spark, sf_dir):
    return rounded(filters.anisotropic_smoothing(px_sales(spark, sf_dir), {"z": 0.0, "y": 0.7, "x": 1.5}, SHAPE), "v")


# choice of features


def _labelled_features(spark, sf_dir):
    bank = filters.feature_bank(px_sales(spark, sf_dir), [0.7], block=16)
    marks = px_sales(spark, sf_dir).select(*COORDINATES, F.when(F.col("v") >= 30, 2).otherwise(1).alias("label"))
    return learning.label_feature_matrix(bank, marks, COORDINATES).select("label", "f")


def _matrix(spark, sf_dir):
    return written(_labelled_features(spark, sf_dir), "matrix")


@query("c10_information_selection")
def c10(spark, sf_dir):
    chosen = selection.information_feature_selection(_matrix(spark, sf_dir), filters.FEATURES, 4)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "rank int, feature string")


@query("c11_wrapper_selection")
def c11(spark, sf_dir):
    chosen = selection.wrapper_feature_selection(_labelled_features(spark, sf_dir), filters.FEATURES, trees=3)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "rank int, feature string")


@query("c12_gini_selection")
def c12(spark, sf_dir):
    model = learning.train(_matrix(spark, sf_dir), trees=10)
    return spark.createDataFrame(learning.feature_importances(model, filters.FEATURES), "feature string, importance double")


@query("c09_autocontext")
def c09(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    marks = px.where((F.col("y") + F.col("x")) % 5 == 0).select(*COORDINATES, F.when(F.col("v") >= 30, 2).otherwise(1).alias("label"))
    scored = selection.autocontext(px, marks, 2, lambda p: filters.feature_bank(p, [0.7], ["gaussian", "gradient"], block=16), 2, trees=5)
    return learning.argmax_channel(learning.probability_image(scored))


# annotations, texture, skeletons


@query("l07_annotation_regions")
def l07(spark, sf_dir):
    return labels.annotation_regions(_painted(spark, sf_dir))


A = 0.7071067811865476
LBP = (
    "nb as (select a.image_id, a.t, a.y, a.x, " + ", ".join(f"coalesce(max(case when b.y = a.y + ({dy}) and b.x = a.x + ({dx}) then b.v end), 0.0) as n{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + " from px a join px b on a.image_id = b.image_id and a.t = b.t and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3, 4), "
    "bits as (select *, [" + ", ".join((f"n{y}{x}" if 1 in (y, x) else f"n11 * {(1 - A) ** 2!r}::double + (n1{x} + n{y}1) * {A * (1 - A)!r}::double + n{y}{x} * {A * A!r}::double") for y, x in objects.RING) + "] as s from nb), "
    "code as (select image_id, t, y, x, list_transform(s, lambda v: case when v - n11 >= -1e-9 then 1 else 0 end) as b from bits), "
    "coded as (select image_id, t, y, x, case when " + " + ".join(f"abs(b[{i + 1}] - b[{(i + 1) % 8 + 1}])" for i in range(8)) + " <= 2 then list_sum(b)::int else 9 end as code from code)"
)


@query("o21_lbp_histogram", _with(LABELS, LBP, "n as (select lab.image_id, lab.t, lab.v as object_id, code, count(*) as n from coded join lab using (image_id, t, y, x) group by all)") + "select image_id, t, object_id, code, round(n / sum(n) over (partition by image_id, t, object_id), 6) as share from n")
def o21(spark, sf_dir):
    return rounded(objects.lbp_histogram(px_sales(spark, sf_dir), labels_of_sales(spark, sf_dir)), "share")


@query("o10_skeleton")
def o10(spark, sf_dir):
    return objects.skeleton_features(regions.filter_labels(labels_of_sales(spark, sf_dir, 30.0), 8, 10**6))


# family trees and counting


def _tree(spark, sf_dir):
    f, links = _links(spark, sf_dir)
    costs = written(tracking.link_costs(links), "costs")
    chosen = written(tracking.link_tracks(costs), "chosen")
    second = written(tracking.division_links(costs, chosen, f.where("count >= 4")), "second")
    return f, chosen, second


@query("t08_family_tree")
def t08(spark, sf_dir):
    return tracking.family_tree(*_tree(spark, sf_dir))


@query("t14_link_weights")
def t14(spark, sf_dir):
    links = written(_links(spark, sf_dir)[1], "candidates")
    weights = tracking.learn_link_weights(links, tracking.link_tracks(tracking.link_costs(links)), ["dist", "rank"])
    return spark.createDataFrame(list(weights.items()), "feature string, weight double")


@query("t12_untracked", _with(LABELS, FEATURES) + f"select {P}, c, case when object_id is null then 1 else 0 end as v from lab left join (select image_id, t, object_id from f where count >= 3) k on k.image_id = lab.image_id and k.t = lab.t and k.object_id = lab.v".replace("image_id, t, z, y, x", "lab.image_id, lab.t, lab.z, lab.y, lab.x"))
def t12(spark, sf_dir):
    given = features_of_sales(spark, sf_dir).where("count >= 3").select(*objects.OBJECT, F.col("object_id").alias("track_id"))
    return tracking.manual_tracking(labels_of_sales(spark, sf_dir), given)[1]


@query("d05_predict_density")
def d05(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    bank = written(filters.feature_bank(px, [0.7, 1.2], ["gaussian", "laplacian"], block=16), "bank")
    a = _annotation(spark, sf_dir)
    samples = counting.density_samples(counting.density_labels(a, 1.2, SHAPE), a).join(bank, COORDINATES).select("f", "v")
    models = counting.train_density(samples, 2, trees=5)
    return geometry.channel_mean(counting.predict_density(bank, models))


BOXES = [("a", "A0", 0, 4, 20, 4, 20, 12.0), ("b", "N0", 2, 10, 40, 30, 48, 5.0), ("c", "A0", 0, 30, 40, 30, 40, 7.0)]


@query("d04_fit_to_boxes", _with(PX_SALES, ANNOTATED, *_smooth_sql("dots", 1.2, "g"), "boxes(box, image_id, t, y0, y1, x0, x1, count) as (values " + ", ".join(map(str, BOXES)) + ")", "s as (select box, any_value(count) / sum(v) as factor from g join boxes using (image_id, t) where y >= y0 and y < y1 and x >= x0 and x < x1 group by box)", "k as (select boxes.*, factor from boxes join s using (box))") + "select g.image_id, g.t, g.z, g.y, g.x, g.c, round(g.v * coalesce(factor, 1.0), 6) + 0.0 as v from g left join k on k.image_id = g.image_id and k.t = g.t and g.y >= y0 and g.y < y1 and g.x >= x0 and g.x < x1")
def d04(spark, sf_dir):
    dots = _annotation(spark, sf_dir).where("v = 1").withColumn("v", F.lit(1.0))
    boxes = spark.createDataFrame(BOXES, "box string, image_id string, t int, y0 int, y1 int, x0 int, x1 int, count double")
    return rounded(counting.fit_to_boxes(filters.gaussian_smoothing(dots, 1.2, "yx", SHAPE), boxes), "v")
