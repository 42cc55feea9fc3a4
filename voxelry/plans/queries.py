"""Registered queries of the image operators, each with the same result in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.functions import registry
from voxelry.operators import counting, filters, geometry, labels, learning, missing, objects, regions, superpixels, tracking
from voxelry.plans.stored import expect_packed_files, written
from voxelry.sources import tables
from voxelry.sources.tables import COORDINATES, POINTS, PX_CHANNELS, PX_PATCH, PX_SALES, PX_TIME, STROKES, px_patch, px_sales, px_time

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
P = "image_id, t, z, y, x"
SHAPE = {"y": 48, "x": 48}


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir) under a name, and its SQL."""

    def keep(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            expect_packed_files(spark)
            return f(spark, sf_dir)

        _queries[name] = run
        if sql:
            _sql[name] = sql
        return f

    return keep


def _all() -> None:
    """The other modules of queries register theirs when they are imported."""
    from voxelry.plans import blocks, classes, models, segmentation  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of floating numbers depend on their order; results are compared to six places."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _with(*ctes: str) -> str:
    return "with recursive " + ", ".join(ctes) + " "


# the flagship: how many bright objects are in each image, how large and how bright are they

COMPONENTS = (
    "bright as (select * from px where v >= {level}), "
    "near as (select a.image_id, a.t, a.y * 48 + a.x as p, b.y * 48 + b.x as q from bright a join bright b on a.image_id = b.image_id and a.t = b.t and abs(a.y - b.y) + abs(a.x - b.x) = 1), "
    "reach as (select image_id, t, y * 48 + x as p, y * 48 + x as q from bright union select r.image_id, r.t, r.p, n.q from reach r join near n on r.image_id = n.image_id and r.t = n.t and r.q = n.p), "
    "root as (select image_id, t, p, min(q) as r from reach group by all), "
    "lab as (select image_id, t, 0 as z, cast(p // 48 as int) as y, cast(p % 48 as int) as x, 0 as c, dense_rank() over (partition by image_id, t order by r) as v from root)"
)
LEVEL = 60.0
LABELS = f"{PX_SALES}, {COMPONENTS.format(level=LEVEL)}"


def labels_of_sales(spark: SparkSession, sf_dir: str, level: float = LEVEL) -> DataFrame:
    return regions.labeled_threshold(px_sales(spark, sf_dir), level)


FEATURES = "f as (select px.image_id, px.t, lab.v as object_id, count(*) as count, avg(px.y) as cy, avg(px.x) as cx, min(px.y) as min_y, max(px.y) + 1 as max_y, min(px.x) as min_x, max(px.x) + 1 as max_x, avg(px.v) as mean, sum(px.v) as sum, min(px.v) as min, max(px.v) as max, var_pop(px.v) as var from px join lab using (image_id, t, z, y, x) group by all)"


def bright_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels that objects of sales consist of, written as their labels and values are read apart."""
    return written(px_sales(spark, sf_dir).where(F.col("v") >= LEVEL), "bright")


def features_of_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = bright_pixels(spark, sf_dir)
    return objects.region_features(bright, regions.labeled_threshold(bright, LEVEL))


@query("bright_objects", _with(LABELS, FEATURES) + "select image_id, t, object_id, count, round(cy, 6) as cy, round(cx, 6) as cx, min_y, max_y, min_x, max_x, round(mean, 6) as mean, sum, min, max, round(var, 6) as var from f")
def bright_objects(spark, sf_dir):
    f = features_of_sales(spark, sf_dir).select("image_id", "t", "object_id", "count", "cy", "cx", "min_y", "max_y", "min_x", "max_x", "mean", "sum", "min", "max", "var")
    return rounded(f, "cy", "cx", "mean", "var")


# geometry


@query("g01_subregion", _with(PX_SALES) + "select image_id, t, z, y - 2 as y, x - 5 as x, c, v from px where y >= 2 and y < 30 and x >= 5 and x < 45")
def g01(spark, sf_dir):
    return geometry.subregion(px_sales(spark, sf_dir), {"y": 2, "x": 5}, {"y": 30, "x": 45})


@query("g02_select_channel", _with(PX_CHANNELS) + f"select {P}, 0 as c, v from px where c = 1")
def g02(spark, sf_dir):
    return geometry.select_channel(px_sales(spark, sf_dir, True), 1)


@query("g03_select_channels", _with(PX_CHANNELS) + f"select {P}, 0 as c, v from px where c = 2 union all select {P}, 1 as c, v from px where c = 0 union all select {P}, 2 as c, v from px where c = 2")
def g03(spark, sf_dir):
    return geometry.select_channels(px_sales(spark, sf_dir, True), [2, 0, 2])


@query("g04_slice_axis", _with(PX_SALES) + "select image_id || '/t' || t as image_id, 0 as t, z, y, x, c, v from px where t in (0, 2)")
def g04(spark, sf_dir):
    return geometry.slice_axis(px_sales(spark, sf_dir), "t", [0, 2])


@query("g05_stack", _with(PX_SALES) + "select image_id, t, z, y, x, c, v from px union all select image_id, t, z, y, x + 48 as x, c, v from px")
def g05(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    return geometry.stack([px, px], "x", [48, 48])


@query("g06_reorder_axes", _with(PX_SALES) + "select image_id, x, y, t, v from px")
def g06(spark, sf_dir):
    return geometry.reorder_axes(px_sales(spark, sf_dir), "xyt")


@query("g07_convert_dtype", _with(PX_SALES) + f"select {P}, c, cast(((cast(trunc(v * 3) as bigint) % 256) + 256) % 256 as bigint) as v from px")
def g07(spark, sf_dir):
    return geometry.convert_dtype(geometry.pixel_apply(px_sales(spark, sf_dir), lambda v: v * 3), "uint8", "wrap")


@query("g08_renormalize", _with(PX_SALES) + f"select {P}, c, round((v - 1.0) / 238.0, 6) as v from px")
def g08(spark, sf_dir):
    return rounded(geometry.renormalize(px_sales(spark, sf_dir), 1.0, 239.0), "v")


@query("g09_merge_images", _with(PX_SALES) + f"select {P}, c, max(v) as v from (select * from px union all select image_id, t, z, x as y, y as x, c, v from px) group by all")
def g09(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    return geometry.merge_images([px, px.select("image_id", "t", "z", F.col("x").alias("y"), F.col("y").alias("x"), "c", "v")], F.max)


@query("g10_sum_channels", _with(PX_CHANNELS) + f"select {P}, 0 as c, 1 - sum(v) as v from px where c in (0, 2) group by all")
def g10(spark, sf_dir):
    return geometry.sum_channels(px_sales(spark, sf_dir, True), [0, 2], invert=True)


@query("g11_downscale", _with(PX_SALES) + "select image_id, t, z, cast(y // 2 as int) as y, cast(x // 2 as int) as x, c, round(avg(v), 6) as v from px group by 1, 2, 3, 4, 5, 6")
def g11(spark, sf_dir):
    return rounded(geometry.downscale(px_sales(spark, sf_dir), {"y": 2, "x": 2}), "v")


@query("g11_resize_nearest", _with(PX_SALES) + "select image_id, t, z, y * 2 + a as y, x * 2 + b as x, c, v from px, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b)")
def g11b(spark, sf_dir):
    return geometry.resize_nearest(px_sales(spark, sf_dir), {"y": 2, "x": 2})


@query("g12_max_channel", _with(PX_CHANNELS) + f"select {P}, c, case when row_number() over (partition by {P} order by v desc, c) = 1 then 1.0 else 0.0 end::double as v from px")
def g12(spark, sf_dir):
    return geometry.max_channel_indicator(px_sales(spark, sf_dir, True))


@query("g13_threshold_mask", _with(PX_SALES) + f"select {P}, c, case when v between 20 and 60 then 0.0 else v end as v from px")
def g13(spark, sf_dir):
    return geometry.threshold_mask(px_sales(spark, sf_dir), 20, 60, inverted=True)


@query("g14_deviation_from_mean", _with(PX_PATCH) + f"select {P}, c, round((v - avg(v) over (partition by t, z, y, x, c)) * 2 + 1, 6) + 0.0 as v from px")
def g14(spark, sf_dir):
    return rounded(geometry.deviation_from_mean(px_patch(spark, sf_dir), 2.0, 1.0), "v")


@query("g15_channel_mean", _with(PX_CHANNELS) + f"select {P}, 0 as c, round(avg(v), 6) as v from px group by all")
def g15(spark, sf_dir):
    return rounded(geometry.channel_mean(px_sales(spark, sf_dir, True)), "v")


@query("g16_volume_reduce", _with(PX_SALES) + "select image_id, sum(v) as v from px group by all")
def g16(spark, sf_dir):
    return geometry.volume_reduce(px_sales(spark, sf_dir))


@query("g17_normalize_255", _with(PX_SALES) + f"select {P}, c, round((v - min(v) over w) * 255 / (max(v) over w - min(v) over w), 6) as v from px window w as (partition by image_id)")
def g17(spark, sf_dir):
    return rounded(geometry.normalize_255(px_sales(spark, sf_dir)), "v")


@query("g18_image_difference", _with(PX_CHANNELS) + f"select {P}, 0 as c, case when a.v is not distinct from b.v then 0.0 else b.v end as v from (select {P}, v from px where c = 1) b left join (select {P}, v from px where c = 0) a using ({P})")
def g18(spark, sf_dir):
    px = px_sales(spark, sf_dir, True)
    return geometry.image_difference(geometry.select_channel(px, 0), geometry.select_channel(px, 1))


@query("g19_zero_default", _with(PX_SALES) + f"select f.image_id, f.t, f.z, g.y, h.x, f.c, coalesce(px.v, 0.0) as v from (select distinct image_id, t, z, c from px) f, (select unnest(range(48))::int as y) g, (select unnest(range(48))::int as x) h left join px on px.image_id = f.image_id and px.t = f.t and px.y = g.y and px.x = h.x")
def g19(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    return geometry.zero_default(px, px.select("image_id", "t", "z", "c").distinct(), 48, 48)


@query("g20_image_meta", _with(PX_CHANNELS) + "select image_id, max(t) + 1 as n_t, max(z) + 1 as n_z, max(y) + 1 as n_y, max(x) + 1 as n_x, max(c) + 1 as n_c, count(*) as pixels, min(v) as v_min, max(v) as v_max from px group by all")
def g20(spark, sf_dir):
    return geometry.image_meta(px_sales(spark, sf_dir, True))


@query("g21_project_labels", _with(PX_SALES) + "select image_id, z, y, x, c, round((1 - min(t) / 7.0) * (254.0 / 255) + 1.0 / 255, 6) as v from px where v >= 60 group by all")
def g21(spark, sf_dir):
    return rounded(geometry.project_labels_2d(regions.threshold(px_sales(spark, sf_dir), 60), "t", 7), "v")


CROPS = [("a", 0, 3, 0, 1, 0, 20, 10, 40), ("b", 1, 7, 0, 1, 15, 48, 0, 17), ("c", 2, 3, 0, 1, 5, 6, 5, 6)]


@query("g22_crop_members", _with(PX_SALES, "crops(crop, t0, t1, z0, z1, y0, y1, x0, x1) as (values " + ", ".join(map(str, CROPS)) + ")") + f"select crop, {P}, c, v from px join crops on t >= t0 and t < t1 and y >= y0 and y < y1 and x >= x0 and x < x1")
def g22(spark, sf_dir):
    crops = spark.createDataFrame(CROPS, "crop string, t0 int, t1 int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    return geometry.crop_members(px_sales(spark, sf_dir), crops)


@query("g23_contact_pixels", _with(PX_SALES, "l as (select image_id, t, z, y, x, case when v < 20 then 1 when v >= 60 then 2 end as v from px)") + f"select b.image_id, b.t, b.z, b.y, b.x from l b join l a on a.image_id = b.image_id and a.t = b.t and a.v = 1 and b.v = 2 group by all having round(sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2))) = 2")
def g23(spark, sf_dir):
    two = px_sales(spark, sf_dir).withColumn("v", F.when(F.col("v") < 20, 1).when(F.col("v") >= 60, 2))
    return geometry.contact_pixels(two, 1, 2, 2)


@query("g24_subsample", _with(PX_SALES) + "select image_id, t, z, cast(y // 3 as int) as y, cast(x // 2 as int) as x, c, v from px where y % 3 = 0 and x % 2 = 0")
def g24(spark, sf_dir):
    return geometry.subsample(px_sales(spark, sf_dir), {"y": 3, "x": 2})


@query("g25_combine_channels", _with(PX_SALES) + f"select {P}, 0 as c, v from px union all select {P}, 1 as c, v * 2 as v from px")
def g25(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    return geometry.combine_channels([px, geometry.pixel_apply(px, lambda v: v * 2)])


@query("g26_pointcloud_density", f"with {POINTS} select cast(floor((z_px - (select min(z_px) from points)) / 4) as int) as z, cast(floor((y_px - (select min(y_px) from points)) / 4) as int) as y, cast(floor((x_px - (select min(x_px) from points)) / 4) as int) as x, round(sum(size_px), 6) as v from points group by 1, 2, 3")
def g26(spark, sf_dir):
    return rounded(geometry.pointcloud_density(tables.points(spark, sf_dir), 4.0, "by_size"), "v")


# filters


def _kernel_sql(source: str, axis: str, kernel: list[float], name: str, value: str = "v") -> str:
    r = len(kernel) // 2
    weights = ", ".join(f"({i - r}, {w!r}::double)" for i, w in enumerate(kernel))
    keys = ", ".join(f"{axis} - d as {axis}" if k == axis else k for k in COORDINATES)
    grouped = ", ".join(f"{axis} - d" if k == axis else k for k in COORDINATES)
    return f"{name} as (select {keys}, sum({value} * w) as v from {source}, (values {weights}) k(d, w) where {axis} - d between 0 and 47 group by {grouped})"


def _smooth_sql(source: str, sigma: float, name: str, oy: int = 0, ox: int = 0) -> list[str]:
    return [_kernel_sql(source, "y", filters.gaussian_kernel(sigma, oy), f"{name}_y"), _kernel_sql(f"{name}_y", "x", filters.gaussian_kernel(sigma, ox), name)]


@query("f01_gaussian_smoothing", _with(PX_SALES, *_smooth_sql("px", 1.0, "g")) + f"select {P}, c, round(v, 6) + 0.0 as v from g")
def f01(spark, sf_dir):
    return rounded(filters.gaussian_smoothing(px_sales(spark, sf_dir), 1.0, "yx", SHAPE), "v")


@query("f02_difference_of_gaussians", _with(PX_SALES, *_smooth_sql("px", 1.0, "g"), *_smooth_sql("px", 0.66, "h")) + f"select {P}, c, round(sum(v), 6) + 0.0 as v from (select * from g union all select {P}, c, -v as v from h) group by {P}, c")
def f02(spark, sf_dir):
    return rounded(filters.difference_of_gaussians(px_sales(spark, sf_dir), 1.0, 0.66, SHAPE), "v")


@query("f07_gradient_magnitude", _with(PX_SALES, *_smooth_sql("px", 1.0, "gy", 1, 0), *_smooth_sql("px", 1.0, "gx", 0, 1)) + f"select {P}, 0 as c, round(sqrt(sum(v * v)), 6) as v from (select * from gy union all select * from gx) group by {P}")
def f07(spark, sf_dir):
    return rounded(filters.gradient_magnitude(px_sales(spark, sf_dir), 1.0, SHAPE), "v")


@query("f08_laplacian", _with(PX_SALES, *_smooth_sql("px", 1.0, "gy", 2, 0), *_smooth_sql("px", 1.0, "gx", 0, 2)) + f"select {P}, 0 as c, round(sum(v), 6) + 0.0 as v from (select * from gy union all select * from gx) group by {P}")
def f08(spark, sf_dir):
    return rounded(filters.laplacian(px_sales(spark, sf_dir), 1.0, SHAPE), "v")


@query("f09_feature_bank")
def f09(spark, sf_dir):
    return filters.feature_bank(px_sales(spark, sf_dir), [0.7, 1.0, 1.6], block=16)


@query("f10_invalid_scales", _with(PX_SALES) + "select image_id, s as scale from (select image_id, max(y) + 1 as n_y, max(x) + 1 as n_x from px group by all), (select unnest([1.0, 10.0, 13.0, 14.0, 20.0])::double as s) where ceil(s * 3.5) + 1 > least(n_y, n_x)")
def f10(spark, sf_dir):
    return filters.invalid_scales(geometry.image_meta(px_sales(spark, sf_dir)), [1, 10, 13, 14, 20])


# decisions on probabilities

PROBABILITIES = "p as (select image_id, t, z, y, x, c, v / sum(v) over (partition by image_id, t, z, y, x) as v from px)"


def _probabilities(spark, sf_dir):
    px = px_sales(spark, sf_dir, True)
    return px.join(px.groupBy(*geometry.PIXEL).agg(F.sum("v").alias("s")), geometry.PIXEL).select(*COORDINATES, (F.col("v") / F.col("s")).alias("v"))


@query("c05_ensemble_margin", _with(PX_CHANNELS, PROBABILITIES, "k as (select image_id, t, z, y, x, list_reverse_sort(list(v)) as k from p group by all)") + f"select {P}, 0 as c, round(case when len(k) > 1 then 1 - (k[1] - k[2]) else 0.0 end, 6) as v from k")
def c05(spark, sf_dir):
    return rounded(learning.ensemble_margin(_probabilities(spark, sf_dir)), "v")


@query("c06_argmax_channel", _with(PX_CHANNELS) + f"select {P}, 0 as c, c + 1 as v from (select *, row_number() over (partition by {P} order by v desc, c) as k from px) where k = 1")
def c06(spark, sf_dir):
    return learning.argmax_channel(px_sales(spark, sf_dir, True))


@query("c08_pixel_classification")
def c08(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    bank = written(filters.feature_bank(px, [0.7, 1.6], block=16), "bank")
    marks = px.where((F.col("y") + F.col("x")) % 5 == 0).select(*COORDINATES, F.when(F.col("v") >= 30, 2).otherwise(1).alias("label"))
    return learning.argmax_channel(learning.probability_image(learning.pixel_classification(bank, marks, 2, trees=10)))


# annotations

PAINTED = f"lab as (select * from (select {P}, c, arg_max(value, seq) as v from strokes where value <> 0 group by all) where v <> 255)"


def _painted(spark, sf_dir):
    return labels.paint(tables.strokes(spark, sf_dir))


@query("l01_paint", f"with {STROKES}, {PAINTED} select * from lab")
def l01(spark, sf_dir):
    return _painted(spark, sf_dir)


@query("l02_ingest_labels", f"with {STROKES}, o as (select -1 as seq, {P}, c, value as v0 from strokes where seq % 3 = 0 and value in (1, 2)), u as (select seq, {P}, c, max(v0) as value from o group by all union all select seq, {P}, c, value from strokes where seq % 3 = 1) select * from (select {P}, c, arg_max(value, seq) as v from u where value <> 0 group by all) where v <> 255")
def l02(spark, sf_dir):
    s = tables.strokes(spark, sf_dir)
    old = s.where("seq % 3 = 0 and value in (1, 2)").groupBy(*COORDINATES).agg(F.max("value").alias("v"))
    return labels.ingest_labels(old, s.where("seq % 3 = 1"))


@query("l03_delete_label", f"with {STROKES}, {PAINTED} select {P}, c, case when v > 1 then v - 1 else v end as v from lab where v <> 1")
def l03(spark, sf_dir):
    return labels.delete_label(_painted(spark, sf_dir), 1)


@query("l04_merge_labels", f"with {STROKES}, {PAINTED} select {P}, c, case when v = 3 then 1 else v end as v from lab")
def l04(spark, sf_dir):
    return labels.merge_labels(_painted(spark, sf_dir), 3, 1)


@query("l05_nonzero_blocks", f"with {STROKES}, {PAINTED} select distinct image_id, t, cast(y // 8 as int) as by, cast(x // 8 as int) as bx from lab")
def l05(spark, sf_dir):
    return labels.nonzero_blocks(_painted(spark, sf_dir), {"y": 8, "x": 8})


@query("l06_label_counts", f"with {STROKES}, {PAINTED} select image_id, v, count(*) as n from lab group by all")
def l06(spark, sf_dir):
    return labels.label_counts(_painted(spark, sf_dir))


@query("c14_max_label", f"with {STROKES}, {PAINTED} select coalesce(max(v), 0) as max_label from lab")
def c14(spark, sf_dir):
    return labels.max_label(_painted(spark, sf_dir))


# regions


@query("r01_connected_components", _with(LABELS) + f"select {P}, c, v from lab")
def r01(spark, sf_dir):
    return regions.connected_components(regions.threshold(px_sales(spark, sf_dir), LEVEL), block=16)


SIZES = "sizes as (select image_id, t, v, count(*) as n from lab group by all)"


@query("r02_filter_labels", _with(LABELS, SIZES) + f"select {P}, c, v from lab join sizes using (image_id, t, v) where n between 2 and 6")
def r02(spark, sf_dir):
    return regions.filter_labels(labels_of_sales(spark, sf_dir), 2, 6)


@query("r03_relabel_consecutive", _with(LABELS, SIZES) + f"select {P}, c, dense_rank() over (partition by image_id, t order by v) + 9 as v from lab join sizes using (image_id, t, v) where n >= 3")
def r03(spark, sf_dir):
    return regions.relabel_consecutive(regions.filter_labels(labels_of_sales(spark, sf_dir), 3, 10**6), 10)


@query("r06_hysteresis", _with(LABELS) + f"select {P}, c, v from lab where (image_id, t, v) in (select (lab.image_id, lab.t, lab.v) from lab join px using ({P}) where px.v >= 90)")
def r06(spark, sf_dir):
    return regions.hysteresis_threshold(px_sales(spark, sf_dir), LEVEL, 90.0)


@query("r09_bounding_boxes", _with(LABELS) + "select image_id, t, v as object_id, 0 as z0, greatest(min(y) - 1, 0) as y0, greatest(min(x) - 1, 0) as x0, 1 as z1, least(max(y) + 2, 48) as y1, least(max(x) + 2, 48) as x1 from lab group by image_id, t, v")
def r09(spark, sf_dir):
    return regions.object_bounding_boxes(labels_of_sales(spark, sf_dir), 1, {"z": 1, **SHAPE})


@query("r10_center_image", _with(LABELS, FEATURES) + "select distinct image_id, t, 0 as z, cast(floor(cy) as int) as y, cast(floor(cx) as int) as x, 0 as c, 1 as v from f")
def r10(spark, sf_dir):
    return regions.object_center_image(features_of_sales(spark, sf_dir))


@query("r11_relabel_by_map", _with(LABELS) + f"select {P}, c, case when v % 2 = 0 then v * 10 else 0 end as v from lab")
def r11(spark, sf_dir):
    lab = written(labels_of_sales(spark, sf_dir), "labels")
    mapping = lab.where("v % 2 = 0").select("image_id", "t", F.col("v").alias("old"), (F.col("v") * 10).alias("new")).distinct()
    return regions.relabel_by_map(lab, mapping)


@query("r12_objects_per_frame", _with(LABELS) + "select image_id, t, max(v) as objects from lab group by all")
def r12(spark, sf_dir):
    return regions.objects_per_frame(labels_of_sales(spark, sf_dir))


@query("t16_contours", _with(LABELS) + f"select {P}, c, v from lab l where (select count(*) from lab n where n.image_id = l.image_id and n.t = l.t and n.v = l.v and abs(n.y - l.y) + abs(n.x - l.x) = 1) < 4")
def t16(spark, sf_dir):
    return regions.boundary_pixels(labels_of_sales(spark, sf_dir))


# objects


@query("o03_histogram", _with(LABELS, "span as (select image_id, min(v) as lo, max(v) as hi from px group by all)") + "select px.image_id, px.t, lab.v as object_id, cast(least(floor((px.v - lo) * 64 / (hi - lo)), 63) as int) as bin, count(*) as n from px join lab using (image_id, t, z, y, x) join span using (image_id) group by 1, 2, 3, 4")
def o03(spark, sf_dir):
    return objects.histogram(px_sales(spark, sf_dir), labels_of_sales(spark, sf_dir))


@query("o03_quantiles", _with(LABELS) + "select px.image_id, px.t, lab.v as object_id, " + ", ".join(f"round(quantile_cont(px.v, {s}), 6) as q{round(100 * s)}" for s in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) + " from px join lab using (image_id, t, z, y, x) group by 1, 2, 3")
def o03b(spark, sf_dir):
    q = objects.quantiles(px_sales(spark, sf_dir), labels_of_sales(spark, sf_dir))
    return rounded(q, *[c for c in q.columns if c.startswith("q")])


@query("o04_channel_covariance", _with(PX_CHANNELS, "o as (select image_id, t, y // 12 * 4 + x // 12 + 1 as object_id, y, x, max(case when c = 0 then v end) as a, max(case when c = 1 then v end) as b from px group by all)") + "select image_id, t, object_id, round(covar_pop(a, b), 6) + 0.0 as cov from o where a is not null and b is not null group by all")
def o04(spark, sf_dir):
    px = px_sales(spark, sf_dir, True)
    tiles = px.select(*geometry.PIXEL).distinct().withColumn("c", F.lit(0)).withColumn("v", (F.floor(F.col("y") / 12) * 4 + F.floor(F.col("x") / 12) + 1))
    return rounded(objects.channel_covariance(px, tiles, 0, 1), "cov")


@query("o06_region_radii", _with(LABELS, "m as (select image_id, t, v as object_id, var_pop(y) as yy, var_pop(x) as xx, covar_pop(y, x) as yx from lab group by all)") + "select image_id, t, object_id, round(sqrt((yy + xx) / 2 + sqrt(((yy - xx) / 2) ** 2 + yx * yx)), 5) + 0.0 as radius_0 from m")
def o06(spark, sf_dir):
    return objects.region_radii(labels_of_sales(spark, sf_dir)).select(*objects.OBJECT, (F.round("radius_0", 5) + 0.0).alias("radius_0"))


@query("o07_neighbourhood", _with(LABELS) + "select l.image_id, l.t, l.v as object_id, count(distinct (px.y, px.x)) as shell_count from lab l join px on px.image_id = l.image_id and px.t = l.t and (px.y - l.y) ** 2 + (px.x - l.x) ** 2 <= 4 where not exists (select 1 from lab o where o.image_id = l.image_id and o.t = l.t and o.v = l.v and o.y = px.y and o.x = px.x) group by 1, 2, 3")
def o07(spark, sf_dir):
    return objects.neighbourhood_features(px_sales(spark, sf_dir), labels_of_sales(spark, sf_dir), 2).select(*objects.OBJECT, "shell_count")


@query("o08_convex_hull")
def o08(spark, sf_dir):
    return objects.convex_hull_features(labels_of_sales(spark, sf_dir))


@query("o12_atlas_mapping", _with(LABELS, FEATURES) + "select f.image_id, f.t, f.object_id, px.v as atlas from f left join px on px.image_id = f.image_id and px.t = f.t and px.y = floor(cy + 0.5) and px.x = floor(cx + 0.5)")
def o12(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    return objects.atlas_mapping(features_of_sales(spark, sf_dir), px)


@query("o13_cutouts", _with(LABELS, "b as (select image_id, t, v as object_id, min(y) - 1 as y0, max(y) + 2 as y1, min(x) - 1 as x0, max(x) + 2 as x1 from lab group by all having count(*) >= 3)") + "select b.image_id, b.t, b.object_id, px.z, px.y - y0 as y, px.x - x0 as x, px.c, px.v, coalesce(lab.v = b.object_id, false) as mask from b join px on px.image_id = b.image_id and px.t = b.t and px.y >= y0 and px.y < y1 and px.x >= x0 and px.x < x1 left join lab on lab.image_id = px.image_id and lab.t = px.t and lab.y = px.y and lab.x = px.x")
def o13(spark, sf_dir):
    large = regions.filter_labels(labels_of_sales(spark, sf_dir), 3, 10**6)
    return objects.object_cutouts(large, px_sales(spark, sf_dir), 1)


@query("s18_label_info", _with(LABELS, FEATURES) + "select image_id, t, '[' || string_agg('{\"object_id\":' || object_id || ',\"label\":' || (object_id % 3) || ',\"min_y\":' || min_y || ',\"max_y\":' || max_y || ',\"min_x\":' || min_x || ',\"max_x\":' || max_x || '}', ',' order by object_id) || ']' as info from f where object_id % 3 > 0 group by all")
def s18(spark, sf_dir):
    f = written(features_of_sales(spark, sf_dir), "features")
    return objects.label_info_json(f, f.select(*objects.OBJECT, (F.col("object_id") % 3).alias("label")))


@query("s20_pointcloud_export", _with(LABELS, FEATURES) + "select round(cx, 6) as x_px, round(cy, 6) as y_px, 0.0::double as z_px, count as size_px, min_x as min_x_px, min_y as min_y_px, 0 as min_z_px, max_x as max_x_px, max_y as max_y_px, 1 as max_z_px from f")
def s20(spark, sf_dir):
    return rounded(objects.pointcloud(features_of_sales(spark, sf_dir)), "x_px", "y_px")


@query("u02_object_plugins", _with(LABELS) + "select px.image_id, px.t, lab.v as object_id, max(px.v) - min(px.v) as spread, round(sum(px.v * px.y) / sum(px.v), 6) as weighted_y from px join lab using (image_id, t, z, y, x) group by 1, 2, 3")
def u02(spark, sf_dir):
    values = objects.labelled_values(px_sales(spark, sf_dir), labels_of_sales(spark, sf_dir))
    return rounded(registry.apply_features(values, ["spread", "weighted_y"]), "weighted_y")


@query("u01_pixel_function", _with(PX_SALES) + f"select {P}, c, round(sqrt(v), 6) as v from px")
def u01(spark, sf_dir):
    return rounded(registry.apply_pixel(px_sales(spark, sf_dir), "sqrt"), "v")


# superpixels: squares of 6 x 6 pixels stand in for a watershed; each frame is an image of its own

PX_FRAMES = PX_SALES[:-1].replace("px as (", "px as (select image_id || '/' || t as image_id, 0 as t, z, y, x, c, v from (", 1) + "))"

TILES = "sp as (select image_id, t, z, y, x, c, cast(y // 6 * 8 + x // 6 + 1 as bigint) as v from px)"
NEXT = "(values (0, 1), (1, 0)) d(dy, dx)"
FACES = f"faces as (select a.image_id, least(a.v, b.v) as sp1, greatest(a.v, b.v) as sp2, a.t, a.y as ya, a.x as xa, b.y as yb, b.x as xb from sp a, {NEXT}, sp b where b.image_id = a.image_id and b.t = a.t and b.y = a.y + dy and b.x = a.x + dx and a.v <> b.v)"
EDGES = "e as (select image_id, sp1, sp2, count(*) as n, avg(v) as mean, min(v) as min, max(v) as max, var_pop(v) as var from (select f.*, px.v from faces f join px on px.image_id = f.image_id and px.t = f.t and px.y = ya and px.x = xa union all select f.*, px.v from faces f join px on px.image_id = f.image_id and px.t = f.t and px.y = yb and px.x = xb) group by image_id, sp1, sp2)"
SCALED = "pr as (select image_id, sp1, sp2, (mean - min(mean) over w) / (max(mean) over w - min(mean) over w) as p from e window w as (partition by image_id))"


def px_frames(spark, sf_dir):
    return px_sales(spark, sf_dir).withColumn("image_id", F.concat_ws("/", "image_id", F.col("t").cast("string"))).withColumn("t", F.lit(0))


def _tiles(px):
    tiles = F.floor(F.col("y") / 6) * 8 + F.floor(F.col("x") / 6) + 1
    return px.withColumn("v", tiles.cast("long"))


def _superpixels(spark, sf_dir):
    return _tiles(px_frames(spark, sf_dir))


def _edges(spark, sf_dir):
    px = written(px_frames(spark, sf_dir), "frames")
    return superpixels.edge_features(_tiles(px), px)


@query("w04_region_adjacency", _with(PX_FRAMES, TILES, FACES) + "select image_id, sp1, sp2, count(*) as n_faces from faces group by 1, 2, 3")
def w04(spark, sf_dir):
    return superpixels.region_adjacency(_superpixels(spark, sf_dir))


@query("w05_edge_features", _with(PX_FRAMES, TILES, FACES, EDGES) + "select image_id, sp1, sp2, n, round(mean, 6) as mean, min, max, round(var, 6) as var from e")
def w05(spark, sf_dir):
    return rounded(_edges(spark, sf_dir), "mean", "var")


@query("w07_untrained_probabilities", _with(PX_FRAMES, TILES, FACES, EDGES, SCALED) + "select image_id, sp1, sp2, round(p, 6) as p from pr")
def w07(spark, sf_dir):
    return rounded(superpixels.untrained_probabilities(_edges(spark, sf_dir)), "p")


MERGED = "near as (select image_id, sp1 as a, sp2 as b from pr where p <= 0.4 union all select image_id, sp2, sp1 from pr where p <= 0.4), reach as (select distinct image_id, v as a, v as b from sp union select r.image_id, r.a, n.b from reach r join near n on r.image_id = n.image_id and r.b = n.a), seg as (select image_id, a as sp, min(b) as segment from reach group by 1, 2)"


def _segments(spark, sf_dir):
    sp = _superpixels(spark, sf_dir)
    p = written(superpixels.untrained_probabilities(_edges(spark, sf_dir)), "edges")
    return sp, p, written(superpixels.merge_superpixels(sp.select("image_id", F.col("v").alias("sp")).distinct(), p, 0.4), "segments")


@query("w08_naive_segmentation", _with(PX_FRAMES, TILES, FACES, EDGES, SCALED, MERGED) + "select * from seg")
def w08(spark, sf_dir):
    return _segments(spark, sf_dir)[2]


@query("w09_multicut_weights", _with(PX_FRAMES, TILES, FACES, EDGES, SCALED, "q as (select *, least(greatest(p, 0.001), 0.999) as k from pr), s as (select *, case when k <= 0.4 then k * 0.5 / 0.4 else 1 - (1 - k) * 0.5 / 0.6 end as q from q)") + "select image_id, sp1, sp2, round(ln(1 / q - 1) + ln(1 / 0.45 - 1), 5) + 0.0 as weight from s")
def w09(spark, sf_dir):
    p = superpixels.untrained_probabilities(_edges(spark, sf_dir))
    return p.select(*superpixels.EDGE, (F.round(superpixels.multicut_weights(F.col("p"), 0.45, 0.4), 5) + 0.0).alias("weight"))


@query("w10_agglomerate")
def w10(spark, sf_dir):
    p = superpixels.untrained_probabilities(_edges(spark, sf_dir))
    return superpixels.agglomerate(p.select(*superpixels.EDGE, superpixels.multicut_weights(F.col("p"), 0.5, 0.3).alias("weight")))


@query("w11_project_node_labels", _with(PX_FRAMES, TILES, FACES, EDGES, SCALED, MERGED) + f"select {P}, c, segment as v from sp join seg on seg.image_id = sp.image_id and seg.sp = sp.v".replace("select image_id", "select sp.image_id"))
def w11(spark, sf_dir):
    sp, _, nodes = _segments(spark, sf_dir)
    return superpixels.project_node_labels(sp, nodes)


@query("w12_edge_disagreement", _with(PX_FRAMES, TILES, FACES, EDGES, SCALED, MERGED) + "select pr.image_id, sp1, sp2, round(p, 6) as p from pr join seg a on a.image_id = pr.image_id and a.sp = sp1 join seg b on b.image_id = pr.image_id and b.sp = sp2 where (a.segment <> b.segment) <> (p > 0.5)")
def w12(spark, sf_dir):
    _, p, nodes = _segments(spark, sf_dir)
    return rounded(superpixels.edge_disagreement(nodes, p), "p")


# missing data, along time


@query("m01_detect_missing", _with(PX_TIME) + "select image_id, t, z, c, cast(y // 8 as int) as py, cast(x // 8 as int) as px, count(*) as pixels, max(greatest(least(floor(v * 30 / 900.0), 29), 0)) = 0 as missing from px group by 1, 2, 3, 4, 5, 6")
def m01(spark, sf_dir):
    return missing.detect_missing(px_time(spark, sf_dir), 8, 30, (0.0, 900.0))


@query("m02_interpolate_missing", _with(PX_TIME, "g as (select *, v < 20 as missing from px)", "h as (select *, last_value(case when not missing then t end ignore nulls) over b as bt, last_value(case when not missing then v end ignore nulls) over b as bv, first_value(case when not missing then t end ignore nulls) over a as att, first_value(case when not missing then v end ignore nulls) over a as av from g window b as (partition by image_id, z, y, x, c order by t rows between unbounded preceding and 1 preceding), a as (partition by image_id, z, y, x, c order by t rows between 1 following and unbounded following))") + f"select {P}, c, round(case when missing then coalesce(bv + (av - bv) * ((t - bt)::double / (att - bt)), bv, av, 0.0) else v end, 6) as v from h")
def m02(spark, sf_dir):
    return rounded(missing.interpolate_missing(px_time(spark, sf_dir).withColumn("missing", F.col("v") < 20), "t"), "v")


# tracking

LINKS = "l0 as (select a.image_id, a.t, a.object_id as src, b.object_id as dst, sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) as dist from f a join f b on b.image_id = a.image_id and b.t = a.t + 1), links as (select * from (select *, row_number() over (partition by image_id, t, src order by dist, dst) as rank from l0 where dist <= 6) where rank <= 3)"


def _links(spark, sf_dir):
    f = written(features_of_sales(spark, sf_dir), "features")
    return f, tracking.candidate_links(f, 3, 6.0)


@query("t01_filter_detections", _with(LABELS, FEATURES) + "select image_id, t, object_id, count from f where count >= 2 and count < 9 and max_y > 8 and min_y < 40 and max_x > 8 and min_x < 40")
def t01(spark, sf_dir):
    return tracking.filter_detections(features_of_sales(spark, sf_dir), (2, 9), {"y": (8, 40), "x": (8, 40)}).select(*objects.OBJECT, "count")


@query("t03_candidate_links", _with(LABELS, FEATURES, LINKS) + "select image_id, t, src, dst, round(dist, 6) as dist, rank from links")
def t03(spark, sf_dir):
    return rounded(_links(spark, sf_dir)[1], "dist")


@query("t04_division_features", _with(LABELS, FEATURES, LINKS, "k as (select links.image_id, links.t, src, rank, dist, f.mean as m from links join f on f.image_id = links.image_id and f.t = links.t + 1 and f.object_id = dst)") + "select k.image_id, k.t, src as object_id, " + ", ".join(f"round(coalesce(max(case when rank = {i + 1} then dist end), 9999.0), 6) as dist_{i}" for i in range(3)) + ", round(least(max(case when rank = 1 then m end) / max(case when rank = 2 then m end), max(case when rank = 2 then m end) / max(case when rank = 1 then m end)), 6) as children_ratio from k group by 1, 2, 3")
def t04(spark, sf_dir):
    d = tracking.division_features(*_links(spark, sf_dir)).select(*objects.OBJECT, "dist_0", "dist_1", "dist_2", "children_ratio")
    return rounded(d, "dist_0", "dist_1", "dist_2", "children_ratio")


WINDOWS = (
    "w0 as (select distinct a.image_id, a.t, a.object_id as src, b.v as dst from f a join lab b on b.image_id = a.image_id and b.t = a.t + 1 and b.y >= round_even(a.cy, 0) - 6 and b.y < round_even(a.cy, 0) + 6 and b.x >= round_even(a.cx, 0) - 6 and b.x < round_even(a.cx, 0) + 6), "
    "w1 as (select w0.*, a.cy, a.cx, a.mean as pm, a.count as pc, b.cy - a.cy as dy, b.cx - a.cx as dx, b.mean as m, b.count as n, sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) as dist from w0 join f a on a.image_id = w0.image_id and a.t = w0.t and a.object_id = src join f b on b.image_id = w0.image_id and b.t = w0.t + 1 and b.object_id = dst where b.count >= 2), "
    "w2 as (select * from (select *, row_number() over (partition by image_id, t, src order by dist, dst) as rank from w1) where rank <= 3), "
    "w3 as (select image_id, t, src, any_value(pm) as pm, any_value(pc) as pc, count(*) as k, " + ", ".join(f"max(case when rank = {i + 1} then {c} end) as {c}{i}" for i in range(3) for c in ("dist", "dy", "dx", "m", "n")) + " from w2 group by image_id, t, src), "
    "divs as (select image_id, t, src as object_id, " + ", ".join(f"coalesce(dist{i}, 9999.0) as dist_{i}" for i in range(3)) + ", "
    "least(m0 / m1, m1 / m0) as children_ratio, pm / (m0 + m1) as parent_children_ratio, least(n0 / n1, n1 / n0) as children_ratio_count, pc / (n0 + n1) as parent_children_ratio_count, "
    "greatest(" + ", ".join(f"case when k > {j} then case when dist{i} * dist{j} = 0 then 0.0 else degrees(acos(greatest(least((dy{i} * dy{j} + dx{i} * dx{j}) / (dist{i} * dist{j}), 1.0), -1.0))) end end" for i, j in ((0, 1), (0, 2), (1, 2))) + ") as angle from w3)"
)
DIVISION_COLUMNS = ["dist_0", "dist_1", "dist_2", "children_ratio", "parent_children_ratio", "children_ratio_count", "parent_children_ratio_count", "angle"]


def window_divisions(spark, sf_dir):
    """Objects with the features of their divisions, candidates found by windows of 12 pixels."""
    bright = bright_pixels(spark, sf_dir)
    labels = written(regions.labeled_threshold(bright, LEVEL), "labels")
    f = written(objects.region_features(bright, labels), "features")
    return f, tracking.division_features(f, tracking.window_links(f, labels, 12, 2))


@query("t04_window_divisions", _with(LABELS, FEATURES, WINDOWS) + "select image_id, t, object_id, " + ", ".join(f"round({c} + 1e-9, 5) as {c}" for c in DIVISION_COLUMNS) + " from divs")
def t04_windows(spark, sf_dir):
    d = window_divisions(spark, sf_dir)[1]
    # ratios of small numbers often lie half way between two rounded values
    return d.select(*objects.OBJECT, *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in DIVISION_COLUMNS))


@query("t07_link_tracks")
def t07(spark, sf_dir):
    return tracking.link_tracks(tracking.link_costs(_links(spark, sf_dir)[1]))


@query("t08_lineages")
def t08(spark, sf_dir):
    f, links = _links(spark, sf_dir)
    return tracking.lineages(f, tracking.link_tracks(tracking.link_costs(links)))


@query("t15_tracking_flat", _with(LABELS, FEATURES, LINKS, "k as (select distinct image_id, t, src as object_id, dst as track_id from links), s as (select image_id, t, object_id, list_sort(list(track_id)) as k from k group by all)") + "select image_id, t, object_id, coalesce(k[1], 0) as track1, coalesce(k[2], 0) as track2 from s")
def t15(spark, sf_dir):
    links = _links(spark, sf_dir)[1].select("image_id", "t", F.col("src").alias("object_id"), F.col("dst").alias("track_id"))
    return tracking.tracking_flat(links, 2)


@query("s16_tracking_table")
def s16(spark, sf_dir):
    f, links = _links(spark, sf_dir)
    return tracking.tracking_table(f, tracking.lineages(f, tracking.link_tracks(tracking.link_costs(links))))


# counting

ANNOTATED = "ann as (select image_id, t, z, y, x, c, case when v >= 100 then 1 when v < 5 then 2 end as v from px), dots as (select image_id, t, z, y, x, c, 1.0::double as v from ann where v = 1)"


def _annotation(spark, sf_dir):
    return px_sales(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 100, 1).when(F.col("v") < 5, 2))


DENSITY = f"den as (select g.image_id, g.t, g.z, g.y, g.x, g.c, case when ann.v = 2 then 0.0 else g.v end as v from g left join ann using ({P}, c))"


@query("d01_density_labels", _with(PX_SALES, ANNOTATED, *_smooth_sql("dots", 1.2, "g"), DENSITY) + f"select {P}, c, round(v, 6) + 0.0 as v from den")
def d01(spark, sf_dir):
    return rounded(counting.density_labels(_annotation(spark, sf_dir), 1.2, SHAPE), "v")


@query("d02_density_samples", _with(PX_SALES, ANNOTATED, *_smooth_sql("dots", 1.2, "g"), DENSITY) + f"select {P}, c, round(v, 6) + 0.0 as v from (select {P}, c, v from den where v > 1e-4 union all select {P}, c, 0.0 as v from ann where v = 2)")
def d02(spark, sf_dir):
    a = _annotation(spark, sf_dir)
    return rounded(counting.density_samples(counting.density_labels(a, 1.2, SHAPE), a), "v")


@query("d06_count_objects", _with(PX_SALES, ANNOTATED, *_smooth_sql("dots", 1.2, "g"), DENSITY) + "select image_id, round(sum(v), 5) as total from den group by all")
def d06(spark, sf_dir):
    total = counting.count_objects(counting.density_labels(_annotation(spark, sf_dir), 1.2, SHAPE))
    return total.select("image_id", F.round("total", 5).alias("total"))
