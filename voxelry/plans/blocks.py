"""Registered queries of neighbourhoods, blocks, volumes, the trained detector of missing data, outlines and cubic resizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import blockwise, geometry, learning, missing, tracking
from voxelry.plans.queries import FEATURES, LABELS, SHAPE, P, _with, features_of_sales, labels_of_sales, query, rounded
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES, PX_SALES, PX_TIME, px_sales, px_time

# neighbourhoods and blocks

WINDOWS = "win as (select a.image_id, a.t, a.z, a.y, a.x, a.c, k.i as k, coalesce(b.v, 0.0) as v from px a cross join (select unnest(range(9))::int as i) k left join px b on b.image_id = a.image_id and b.t = a.t and b.z = a.z and b.c = a.c and b.y = a.y + k.i // 3 - 1 and b.x = a.x + k.i % 3 - 1)"


@query("c07_neighbourhoods", _with(PX_SALES, WINDOWS) + f"select {P}, c, k, v from win")
def c07(spark, sf_dir):
    return blockwise.neighbourhood_vectors(px_sales(spark, sf_dir), 1).select(*COORDINATES, F.posexplode("f").alias("k", "v"))


@query("c07_neighbourhood_classes")
def c07_classes(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    vectors = written(blockwise.neighbourhood_vectors(px, 1), "windows")
    marks = px.where((F.col("y") + F.col("x")) % 5 == 0).select(*COORDINATES, F.when(F.col("v") >= 30, 2).otherwise(1).alias("label"))
    model = learning.train(written(learning.label_feature_matrix(vectors, marks, COORDINATES).select("label", "f"), "matrix"), trees=10)
    return learning.argmax_channel(learning.probability_image(learning.predict(vectors, model, 2)))


@query("o20_blockwise_objects", _with(LABELS, FEATURES) + f"select lab.image_id, lab.t, lab.z, lab.y, lab.x, lab.c, case when f.count >= 4 then 2 else 1 end as v from lab join f on f.image_id = lab.image_id and f.t = lab.t and f.object_id = lab.v")
def o20(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    by_size = lambda f: f.withColumn("class", F.when(F.col("count") >= 4, 2).otherwise(1))
    return blockwise.blockwise_object_classification(px, px.where("v >= 60"), by_size, 24, 16)


@query("f09_volume_features")
def f09_volume(spark, sf_dir):
    frames = px_sales(spark, sf_dir).withColumn("z", F.col("t")).withColumn("t", F.lit(0))  # years as depth
    return blockwise.volume_feature_bank(frames, [0.7], block=16)


@query("o09_volume_hulls")
def o09(spark, sf_dir):
    return blockwise.volume_hull_features(labels_of_sales(spark, sf_dir))


# missing data

SHARES = "shares as (select image_id, t, z, c, cast(y // 8 as int) as py, cast(x // 8 as int) as px, [" + ", ".join(f"sum(case when greatest(least(floor(v * 10 / 300.0), 9), 0) = {i} then 1.0 else 0.0 end)::double / count(*)" for i in range(10)) + "] as h from px group by 1, 2, 3, 4, 5, 6)"


@query("m01_patch_histograms", _with(PX_TIME, SHARES) + "select image_id, t, z, c, py, px, k, round(h[k + 1], 6) as share from shares, (select unnest(range(10))::int as k)")
def m01_histograms(spark, sf_dir):
    h = missing.patch_histograms(px_time(spark, sf_dir), 8, 10, (0.0, 300.0))
    return rounded(h.select("image_id", "t", "z", "c", "py", "px", F.posexplode("h").alias("k", "share")), "share")


@query("m01_trained_detector")
def m01_trained(spark, sf_dir):
    px = px_time(spark, sf_dir)
    patches = missing.patch_histograms(px, 8, 10, (0.0, 300.0)).withColumn("label", (F.get("h", F.lit(0)) > 0.5).cast("int"))
    return missing.detect_missing_trained(px, missing.train_missing_detector(patches), 8, 10, (0.0, 300.0))


GAPS = (
    "g as (select *, v < 20 as missing, case when v >= 20 then v end as k from px), line as (select *, "
    + ", ".join(f"case when {f}(t, {n}) over w = t {sign} {n} then {f}(k, {n}) over w end as {name}" for f, n, sign, name in (("lag", 2, "-", "b2"), ("lag", 1, "-", "b1"), ("lead", 1, "+", "a1"), ("lead", 2, "+", "a2")))
    + ", last_value(case when not missing then t end ignore nulls) over b as bt, last_value(k ignore nulls) over b as bv, first_value(case when not missing then t end ignore nulls) over a as att, first_value(k ignore nulls) over a as av from g "
    "window w as (partition by image_id, z, y, x, c order by t), b as (partition by image_id, z, y, x, c order by t rows between unbounded preceding and 1 preceding), a as (partition by image_id, z, y, x, c order by t rows between 1 following and unbounded following))"
)


@query("m02_interpolate_cubic", _with(PX_TIME, GAPS) + f"select {P}, c, round(case when missing then coalesce((b1 + a1) * (2.0::double / 3) - (b2 + a2) / 6, bv + (av - bv) * ((t - bt)::double / (att - bt)), bv, av, 0.0) else v end, 6) + 0.0 as v from line")
def m02_cubic(spark, sf_dir):
    return rounded(missing.interpolate_missing(px_time(spark, sf_dir).withColumn("missing", F.col("v") < 20), "t", method="cubic"), "v")


# outlines and statistics of frames

OUTLINE = "rim as (select a.* from lab a left join lab b on b.image_id = a.image_id and b.t = a.t and b.v = a.v and abs(a.y - b.y) + abs(a.x - b.x) = 1 group by all having count(b.v) < 4), mid as (select image_id, t, v, avg(y) as cy, avg(x) as cx from lab group by all), turn as (select rim.image_id, rim.t, rim.v as object_id, y, x, round(atan2(y - cy, x - cx), 6) as a, round((y - cy) * (y - cy) + (x - cx) * (x - cx), 6) as d from rim join mid using (image_id, t, v))"


@query("t16_outlines", _with(LABELS, OUTLINE) + "select image_id, t, object_id, cast(row_number() over (partition by image_id, t, object_id order by a, d, y, x) - 1 as int) as position, y, x from turn")
def t16(spark, sf_dir):
    return tracking.outline_records(labels_of_sales(spark, sf_dir))


@query("t17_frame_statistics", _with(LABELS, FEATURES) + "select image_id, t, count(*) as objects, round(avg(count), 6) as mean_size, round(stddev_pop(count), 6) + 0.0 as size_spread, cast(sum(count) as bigint) as pixels, round(avg(mean), 6) as mean_intensity from f group by all")
def t17(spark, sf_dir):
    return rounded(tracking.frame_statistics(features_of_sales(spark, sf_dir)), "mean_size", "size_spread", "mean_intensity")


# resizing


def _cubic_sql(source: str, axis: str, m: int, n: int, name: str) -> str:
    other = "x" if axis == "y" else "y"
    at = f"(i * {m - 1}::double / {n - 1})"
    weight = "case when d < 1 then (1.5 * d - 2.5) * d * d + 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 end"
    plan = f"{name}_plan as (select i, case when j < 0 then -j when j > {m - 1} then {2 * (m - 1)} - j else j end as j, {weight} as w from (select i::int as i, (floor({at}) + k)::int as j, abs({at} - floor({at}) - k) as d from (select unnest(range({n})) as i), (select unnest([-1, 0, 1, 2]) as k)))"
    return f"{plan}, {name} as (select image_id, t, z, {other}, c, i as {axis}, sum(v * w) as v from {source} join {name}_plan on j = {source}.{axis} group by image_id, t, z, {other}, c, i)"


@query("g11_resize_cubic", _with(PX_SALES, _cubic_sql("px", "y", 48, 60, "a"), _cubic_sql("a", "x", 48, 70, "b")) + f"select {P}, c, round(v, 5) + 0.0 as v from b where abs(v) > 1e-4")
def g11_cubic(spark, sf_dir):
    px = geometry.resize(px_sales(spark, sf_dir), SHAPE, {"y": 60, "x": 70}, 3)
    return px.where("abs(v) > 1e-4").withColumn("v", F.round("v", 5) + F.lit(0.0))
