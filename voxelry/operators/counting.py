"""Counting by density: smoothed dots, sums over images and boxes."""

from __future__ import annotations

import math

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.filters import gaussian_smoothing
from voxelry.operators.learning import ensemble_margin
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES

BACKGROUND = 2


def density_labels(annotation: DataFrame, sigma: float, shape: dict[str, int]) -> DataFrame:
    """Dots (value 1) smoothed by a Gaussian; places with background strokes (value 2) are forced to 0."""
    dots = annotation.where("v = 1").withColumn("v", F.lit(1.0))
    smooth = gaussian_smoothing(dots, sigma, "yx", shape)
    background = annotation.where(F.col("v") == BACKGROUND).select(*COORDINATES).withColumn("_b", F.lit(True))
    return smooth.join(background, COORDINATES, "left").select(*COORDINATES, F.when(F.col("_b"), 0.0).otherwise(F.col("v")).alias("v"))


def density_samples(density: DataFrame, annotation: DataFrame, least: float = 1e-4) -> DataFrame:
    """Places to train on: density above a floor, and all background strokes."""
    background = annotation.where(F.col("v") == BACKGROUND).select(*COORDINATES, F.lit(0.0).alias("v"))
    return density.where(F.col("v") > least).unionByName(background)


def count_objects(density: DataFrame) -> DataFrame:
    return density.groupBy("image_id").agg(F.sum("v").alias("total"))


def display_bound(sigma: float) -> float:
    return 3 / (2 * math.pi * sigma * sigma)


def box_residuals(density: DataFrame, boxes: DataFrame) -> DataFrame:
    """For ``boxes(box, image_id, t, y0, y1, x0, x1, count)`` the density inside and what is missing from the given count."""
    inside = density.join(boxes, ["image_id", "t"]).where("y >= y0 and y < y1 and x >= x0 and x < x1")
    return inside.groupBy("box").agg(F.sum("v").alias("density"), (F.first("count") - F.sum("v")).alias("residual"))


def train_density(samples: DataFrame, count: int = 4, trees: int = 10, depth: int = 8) -> list[Model]:
    """``count`` forests of different seeds on ``samples(f ARRAY, v)``; none without samples."""
    rows = samples.select(F.col("v").cast("double").alias("label"), array_to_vector(F.col("f").cast("array<double>")).alias("features"))
    rows = written(rows, "samples")
    if rows.isEmpty():
        return []
    return [RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=i).fit(rows) for i in range(count)]


def predict_density(rows: DataFrame, models: list[Model]) -> DataFrame:
    """The density each model finds, not below 0, as one channel for each model; one channel of zeros without models."""
    place = COORDINATES[:-1]
    if not models:
        return rows.select(*place, F.lit(0).alias("c"), F.lit(0.0).alias("v"))
    scored = rows.withColumn("features", array_to_vector(F.col("f").cast("array<double>")))
    for i, m in enumerate(models):
        scored = m.transform(scored).withColumnRenamed("prediction", f"m{i}")
    found = F.array(*(F.greatest(f"m{i}", F.lit(0.0)) for i in range(len(models))))
    return scored.select(*place, F.posexplode(found).alias("c", "v"))


def density_margin(densities: DataFrame) -> DataFrame:
    """How far the models agree on each pixel: 1 less the gap between their two largest densities; 0 for a single model."""
    return ensemble_margin(densities)


def fit_to_boxes(density: DataFrame, boxes: DataFrame) -> DataFrame:
    """Density inside boxes rescaled so that each box sums to its given count; a pixel in several boxes takes their mean factor.

    Boxes without any density are left as they are: no factor can give them a count.
    """
    sums = box_residuals(density, boxes).where("density > 0").select("box", ((F.col("density") + F.col("residual")) / F.col("density")).alias("factor"))
    inside = density.join(boxes.join(sums, "box"), ["image_id", "t"]).where("y >= y0 and y < y1 and x >= x0 and x < x1").groupBy(*COORDINATES).agg(F.avg("factor").alias("factor"))
    return density.join(inside, COORDINATES, "left").select(*COORDINATES, (F.col("v") * F.coalesce("factor", F.lit(1.0))).alias("v"))


def count_table(density: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``nickname, total`` of ``nicknames(image_id, nickname)``; images without density count 0."""
    return nicknames.join(count_objects(density), "image_id", "left").select("nickname", F.coalesce("total", F.lit(0.0)).alias("total"))
