"""Annotation tables: brush strokes and label images. Strokes have seq, coordinates and value; labels are pixel tables with v > 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.operators.components import connected_components as components_of_edges
from voxelry.operators.regions import connected_components
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES

ERASER = 255


def paint(strokes: DataFrame, eraser: int = ERASER) -> DataFrame:
    """The label image after all strokes: value 0 changes nothing, the eraser clears, else the latest stroke wins."""
    last = strokes.where(F.col("value") != 0).groupBy(*COORDINATES).agg(F.max_by("value", "seq").alias("v"))
    return last.where(F.col("v") != eraser)


def ingest_labels(labels: DataFrame, strokes: DataFrame, eraser: int = ERASER) -> DataFrame:
    """Existing labels, then strokes on top of them."""
    old = labels.select(F.lit(-1).cast("long").alias("seq"), *COORDINATES, F.col("v").alias("value"))
    return paint(old.unionByName(strokes.select("seq", *COORDINATES, "value")), eraser)


def max_label(labels: DataFrame) -> DataFrame:
    return labels.agg(F.coalesce(F.max("v"), F.lit(0)).alias("max_label"))


def delete_label(labels: DataFrame, label: int) -> DataFrame:
    """Removes a label; larger ones move down by one."""
    return labels.where(F.col("v") != label).withColumn("v", F.when(F.col("v") > label, F.col("v") - 1).otherwise(F.col("v")))


def clear_label(labels: DataFrame, label: int) -> DataFrame:
    return labels.where(F.col("v") != label)


def merge_labels(labels: DataFrame, old: int, new: int) -> DataFrame:
    return labels.withColumn("v", F.when(F.col("v") == old, F.lit(new)).otherwise(F.col("v")))


def nonzero_blocks(labels: DataFrame, block: dict[str, int]) -> DataFrame:
    """The blocks that hold labels."""
    return labels.where("v <> 0").select("image_id", "t", *(F.floor(F.col(a) / n).cast("int").alias(f"b{a}") for a, n in block.items())).distinct()


def label_pipeline(strokes: DataFrame, block: dict[str, int], eraser: int = ERASER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strokes on several images to their label image, the blocks that hold labels, and the counts of labels."""
    painted = paint(strokes, eraser)
    return painted, nonzero_blocks(painted, block), label_counts(painted)


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def transfer_object_labels(old: DataFrame, new: DataFrame, cell: int = 32) -> DataFrame:
    """Labels of old objects for the new ones their boxes overlap most.

    Both have ``image_id, t, object_id, y0, y1, x0, x1`` (half open), ``old`` also ``label``. Returns for each old object
    ``new_id, label, overlap, state``: kept, or conflict when several old objects of different labels claim a new one.
    Old objects without any overlap are ``lost``. Boxes meet through a grid of cells.
    """

    def cells(boxes: DataFrame, mark: str) -> DataFrame:
        boxes = boxes.select("*", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor((F.col("y1") - 1) / cell))).alias("cy"))
        boxes = boxes.select("*", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell))).alias("cx"))
        return boxes.select("image_id", "t", "cy", "cx", F.struct(*(c for c in boxes.columns if c not in ("image_id", "t", "cy", "cx"))).alias(mark))

    def side(a: str) -> Column:
        return F.least(F.col(f"o.{a}1"), F.col(f"n.{a}1")) - F.greatest(F.col(f"o.{a}0"), F.col(f"n.{a}0"))

    pairs = cells(old, "o").join(cells(new, "n"), ["image_id", "t", "cy", "cx"]).select("image_id", "t", "o", "n").distinct()
    pairs = pairs.where((side("y") > 0) & (side("x") > 0)).select("image_id", "t", F.col("o.object_id").alias("object_id"), F.col("n.object_id").alias("new_id"), (side("y") * side("x")).alias("overlap"))
    best = pairs.groupBy("image_id", "t", "object_id").agg(F.max(F.struct("overlap", (-F.col("new_id")).alias("k"))).alias("b"))
    claimed = old.join(best, ["image_id", "t", "object_id"], "left").select("image_id", "t", "object_id", (-F.col("b.k")).alias("new_id"), "label", F.col("b.overlap").alias("overlap"))
    rivals = claimed.where("new_id is not null").groupBy("image_id", "t", "new_id").agg((F.min("label") != F.max("label")).alias("conflict"))
    state = F.when(F.col("new_id").isNull(), "lost").when(F.col("conflict"), "conflict").otherwise("kept")
    return claimed.join(rivals, ["image_id", "t", "new_id"], "left").select("image_id", "t", "object_id", "new_id", "label", "overlap", state.alias("state"))


def annotation_regions(labels: DataFrame) -> DataFrame:
    """Same-label pixels that touch, also diagonally: label, box, number of pixels and, as anchor, the middle pixel in raster order."""
    found = written(connected_components(labels.withColumn("v", F.col("v").cast("double")), full=True).withColumnRenamed("v", "region"), "annotated")
    rows = found.join(labels.select(*COORDINATES, F.col("v").cast("long").alias("label")), COORDINATES)
    key = ["image_id", "t", "c", "region"]
    order = Window.partitionBy(*key).orderBy("z", "y", "x")
    boxes = rows.groupBy(*key).agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("pixels"), *(F.min(a).alias(f"{a}0") for a in "zyx"), *((F.max(a) + 1).alias(f"{a}1") for a in "zyx"))
    ranked = rows.select(*key, "z", "y", "x", F.row_number().over(order).alias("i"))
    anchor = ranked.join(boxes.select(*key, (F.floor(F.col("pixels") / 2) + 1).alias("i")), [*key, "i"]).select(*key, F.col("z").alias("anchor_z"), F.col("y").alias("anchor_y"), F.col("x").alias("anchor_x"))
    return boxes.join(anchor, key)


def connect_regions(regions: DataFrame) -> DataFrame:
    """``region, whole``: regions of blocks joined across block faces; whole is the smallest name.

    ``regions(region STRING, image_id, t, bz, by, bx, label, z0, z1, y0, y1, x0, x1)``: two regions of neighbouring blocks
    belong together if their labels are equal and their half-open boxes touch along the block axis and overlap along the others.
    """
    a = regions.select(*(F.col(c).alias(f"{c}_a") if c not in ("image_id", "t", "label") else F.col(c) for c in regions.columns))
    links = None
    for axis in "zyx":
        nearby = a.select("*", *((F.col(f"b{o}_a") + int(o == axis)).alias(f"b{o}") for o in "zyx"))
        touch = F.col(f"{axis}1_a") == F.col(f"{axis}0")
        for o in "zyx".replace(axis, ""):
            touch = touch & (F.col(f"{o}0_a") < F.col(f"{o}1")) & (F.col(f"{o}0") < F.col(f"{o}1_a"))
        found = nearby.join(regions, ["image_id", "t", "label", "bz", "by", "bx"]).where(touch).select(F.col("region_a").alias("src"), F.col("region").alias("dst"))
        links = found if links is None else links.unionByName(found)
    merged = components_of_edges(links).withColumnRenamed("node", "region")
    return regions.select("region").join(merged, "region", "left").select("region", F.coalesce("component", "region").alias("whole"))
