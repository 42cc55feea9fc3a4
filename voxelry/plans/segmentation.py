"""Registered queries that grow regions: watersheds, carving, superpixels, distances, split objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import growing, regions
from voxelry.plans.queries import LEVEL, PX_FRAMES, SHAPE, P, _edges, _superpixels, _with, labels_of_sales, query, rounded
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES, PX_SALES, px_sales

FRAMES = ["image_id", "t", "z", "c"]


@query("w01_distance_transform", _with(PX_SALES) + "select f.image_id, f.t, f.z, g.y, h.x, f.c, round(sqrt(min((b.y - g.y) ** 2 + (b.x - h.x) ** 2)), 6) as v from (select distinct image_id, t, z, c from px) f, (select unnest(range(48))::int as y) g, (select unnest(range(48))::int as x) h left join (select * from px where v >= 90) b on b.image_id = f.image_id and b.t = f.t group by all")
def w01(spark, sf_dir):
    px = written(px_sales(spark, sf_dir), "pixels")
    return rounded(growing.distance_transform(px.where("v >= 90"), px.select(*FRAMES).distinct(), 48, 48), "v")


@query("w01_dt_watershed")
def w01b(spark, sf_dir):
    px = written(px_sales(spark, sf_dir), "pixels")
    top = px.groupBy("image_id").agg(F.max("v").alias("top"))
    scaled = px.join(top, "image_id").select(*COORDINATES, (F.col("v") / F.col("top")).alias("v"))
    return growing.dt_watershed(scaled, 0.4, 1.0, 6, 0.9, 48, 48)


@query("w02_seeded_watershed")
def w02(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    return growing.seeded_watershed(px, regions.labeled_threshold(px, 90.0))


@query("w03_unseeded_watershed")
def w03(spark, sf_dir):
    return growing.unseeded_watershed(px_sales(spark, sf_dir))


MINIMA = (
    "near as (select a.image_id, a.t, a.y * 48 + a.x as p, b.y * 48 + b.x as q from px a join px b on a.image_id = b.image_id and a.t = b.t and a.v = b.v and abs(a.y - b.y) + abs(a.x - b.x) = 1), "
    "reach as (select image_id, t, y * 48 + x as p, y * 48 + x as q from px union select r.image_id, r.t, r.p, n.q from reach r join near n on r.image_id = n.image_id and r.t = n.t and r.q = n.p), "
    "root as (select image_id, t, p, min(q) as r from reach group by all), "
    "low as (select a.image_id, a.t, a.y * 48 + a.x as p from px a join px b on a.image_id = b.image_id and a.t = b.t and b.v < a.v and abs(a.y - b.y) + abs(a.x - b.x) = 1), "
    "bad as (select distinct root.image_id, root.t, r from root join low using (image_id, t, p))"
)


@query("w03_local_minima", _with(PX_SALES, MINIMA) + "select image_id, t, 0 as z, cast(p // 48 as int) as y, cast(p % 48 as int) as x, 0 as c from root anti join bad using (image_id, t, r)")
def w03b(spark, sf_dir):
    return growing.local_minima(px_sales(spark, sf_dir)).select(*COORDINATES)


@query("r07_cores_grown")
def r07(spark, sf_dir):
    px = px_sales(spark, sf_dir)
    return growing.labeled_threshold_cores(px, 60.0, regions.labeled_threshold(px, 100.0))


@query("w14_boundary_superpixels")
def w14(spark, sf_dir):
    return growing.boundary_superpixels(px_sales(spark, sf_dir), "gradient", 1.6, SHAPE)[1]


@query("w14_reduced_superpixels")
def w14_reduced(spark, sf_dir):
    """Basins of bright lines, merged until a quarter of each frame's basins is left."""
    px = px_sales(spark, sf_dir).withColumns({"image_id": F.concat_ws("/", "image_id", "t"), "t": F.lit(0)})
    basins, edges = growing.boundary_superpixels(px, "bright", 1.0, SHAPE, 0.25)
    sizes = basins.groupBy("image_id", F.col("v").alias("sp")).agg(F.count(F.lit(1)).alias("pixels"))
    degree = edges.select("image_id", F.explode(F.array("sp1", "sp2")).alias("sp")).groupBy("image_id", "sp").agg(F.count(F.lit(1)).alias("neighbours"))
    return sizes.join(degree, ["image_id", "sp"], "left").select("image_id", "sp", "pixels", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


@query("w15_carve")
def w15(spark, sf_dir):
    edges = written(_edges(spark, sf_dir).select("image_id", "sp1", "sp2", F.col("mean").alias("w")), "edges")
    seeds = edges.select("image_id").distinct().select("image_id", F.explode(F.array(F.struct(F.lit(1).alias("sp"), F.lit(1).alias("label")), F.struct(F.lit(28).alias("sp"), F.lit(2).alias("label")))).alias("s")).select("image_id", "s.sp", "s.label")
    return growing.carve(edges, seeds, 1, 0.95, 20.0)


@query("w16_done_objects", _with(PX_FRAMES) + f"select {P}, c, case when y // 6 * 8 + x // 6 + 1 <= 20 then 'b' else 'a' end as name from px where y // 6 * 8 + x // 6 + 1 <= 20 or (y // 6 * 8 + x // 6 + 1) % 3 = 0")
def w16(spark, sf_dir):
    sp = _superpixels(spark, sf_dir)
    nodes = sp.select("image_id", F.col("v").alias("sp")).distinct()
    store = nodes.where("sp % 3 = 0").select(F.lit("a").alias("name"), "image_id", "sp")
    carved = nodes.select("image_id", "sp", F.when(F.col("sp") <= 20, 2).otherwise(1).alias("label"))
    return growing.done_image(growing.carved_object(store, "b", carved), sp)


S = 9  # int(sqrt(48 * 48 / 24))
_ROUND = (
    "m{i} as (select image_id, t, k, avg(y) as my, avg(x) as mx, avg(v) as mv from a{j} group by all), "
    "d{i} as (select o.image_id, o.t, o.y, o.x, o.v, o.k, (o.v - mv) * (o.v - mv) + {w!r}::double * ((o.y - my) * (o.y - my) + (o.x - mx) * (o.x - mx)) as far from o join m{i} using (image_id, t, k)), "
    "a{i} as (select image_id, t, y, x, any_value(v) as v, min((far, k))[2] as k from d{i} group by image_id, t, y, x)"
)
SLIC = (
    f"a0 as (select image_id, t, y, x, v, y // {S} * 6 + x // {S} + 1 as k from px), "
    f"o as (select image_id, t, y, x, v, (y // {S} + dy) * 6 + x // {S} + dx + 1 as k from px, (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx) where y // {S} + dy between 0 and 5 and x // {S} + dx between 0 and 5), "
    + ", ".join(_ROUND.format(i=i, j=i - 1, w=100.0 / (S * S)) for i in (1, 2, 3))
)


@query("w17_slic_superpixels", _with(PX_SALES, SLIC) + "select image_id, t, 0 as z, y, x, 0 as c, cast(k as bigint) as v from a3")
def w17(spark, sf_dir):
    return growing.slic_superpixels(px_sales(spark, sf_dir), 48, 48, 24, 10.0, 3)


@query("t10_split_mergers")
def t10(spark, sf_dir):
    lab = written(labels_of_sales(spark, sf_dir, LEVEL), "labels")
    counts = lab.groupBy("image_id", "t", F.col("v").alias("object_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 6").select("image_id", "t", "object_id", F.lit(2).alias("k"))
    return growing.split_mergers(lab, counts, 5)
