"""Training and prediction on pixels or objects with Spark ML, and decisions on probability images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.geometry import PIXEL
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES

#: Makes an untrained model from a seed: any classifier of Spark ML with columns label, features and probability.
Learner = Callable[[int], Estimator]
#: Rows of a partition of training rows.
FITTED_AT_ONCE = 65_536


def ensemble_margin(probabilities: DataFrame) -> DataFrame:
    """``1 - (largest - second)`` over the channels of each pixel; 0 for a single channel."""
    top = F.sort_array(F.collect_list("v"), asc=False)
    rows = probabilities.groupBy(*PIXEL).agg(top.alias("k"))
    return rows.select(*PIXEL, F.lit(0).alias("c"), F.when(F.size("k") > 1, 1 - (F.get("k", F.lit(0)) - F.get("k", F.lit(1)))).otherwise(0.0).alias("v"))


def argmax_channel(probabilities: DataFrame) -> DataFrame:
    """The class (channel + 1) of the largest value; the lowest channel on ties."""
    best = F.max(F.struct(F.col("v").alias("p"), (-F.col("c")).alias("k")))
    return probabilities.groupBy(*PIXEL).agg(best.alias("b")).select(*PIXEL, F.lit(0).alias("c"), (1 - F.col("b.k")).alias("v"))


def label_feature_matrix(features: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Feature rows with their label, for labelled places only."""
    return features.join(labels.where("label > 0").select(*keys, "label"), keys)


def concat_matrices(matrices: list[DataFrame]) -> DataFrame:
    """The labelled rows of several images as one matrix; all need the same number of features."""
    if not matrices:
        raise ValueError("no matrices")
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out


def train(matrix: DataFrame, features: str = "f", trees: int = 100, depth: int = 8, seed: int = 0, learner: Learner | None = None, lies: bool = False) -> Model | None:
    """A random forest, or what ``learner`` makes, on an array column; None with fewer rows than the largest label.

    Rows are dealt by their hash and sorted before the fit, so that the model depends on the rows and the seed alone, not on
    how the rows came to lie in partitions. With ``lies`` the rows, enough of them, have been dealt before and are taken as they lie.
    """
    rows = matrix.select(F.col("label").cast("double").alias("label"), F.col(features).cast("array<double>").alias("features"))
    if not lies:
        size = matrix.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("m")).first()
        if not size["n"] or size["n"] < size["m"]:
            return None
        rows = dealt(rows, size["n"])
    rows = rows.select("label", array_to_vector("features").alias("features"))
    return (learner(seed) if learner else RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)).fit(rows)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows ``label, features`` in partitions by their hash, sorted in each."""
    return rows.withColumn("_at", F.xxhash64("label", "features")).repartition(max(1, -(-n // FITTED_AT_ONCE)), "_at").sortWithinPartitions("label", "features").drop("_at")


def held_out_error(matrix: DataFrame, features: str = "f", trees: int = 100, seed: int = 0, learner: Learner | None = None) -> float | None:
    """The share of wrong classes among a third of the rows, drawn by hash, for a model of the others."""
    rows = matrix.withColumn("_held", F.pmod(F.xxhash64(features, "label"), F.lit(3)) == 0)
    model = train(rows.where("not _held"), features, trees, seed=seed, learner=learner)
    if model is None:
        return None
    scored = predict(rows.where("_held"), model, model.numClasses - 1, features)
    return scored.agg(F.avg((F.array_position("p", F.array_max("p")) != F.col("label")).cast("double"))).first()[0]


def predict(rows: DataFrame, model: Model | None, classes: int, features: str = "f", mask: DataFrame | None = None) -> DataFrame:
    """Adds ``p ARRAY<DOUBLE>`` with a probability for each class from 1 on; classes not seen in training get 0, as do all without a model.

    With a ``mask(image_id, t, z, y, x, v)`` only pixels where it is not 0 are predicted, others get 0.
    """
    if mask is not None:
        inside = mask.where("v <> 0").select(*PIXEL).distinct().withColumn("_in", F.lit(True))
        marked = rows.join(inside, PIXEL, "left")
        scored = predict(marked.where("_in"), model, classes, features)
        return scored.unionByName(predict(marked.where("_in is null"), None, classes, features)).drop("_in")
    if model is None:
        return rows.withColumn("p", F.array_repeat(F.lit(0.0), classes))
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(features).cast("array<double>"))))
    p = vector_to_array("probability")
    padded = F.concat(F.slice(p, 2, classes), F.array_repeat(F.lit(0.0), classes))
    return scored.withColumn("p", F.slice(padded, 1, classes)).drop("features", "rawPrediction", "probability", "prediction")


def probability_image(rows: DataFrame) -> DataFrame:
    """Predictions as a pixel table, one channel for each class."""
    return rows.select(*COORDINATES[:-1], F.posexplode("p").alias("c", "v"))


def pixel_classification(bank: DataFrame, labels: DataFrame, classes: int, trees: int = 20) -> DataFrame:
    """Features and labels to class probabilities for all pixels: ``image_id, t, z, y, x, c, p``."""
    matrix = written(label_feature_matrix(bank, labels, COORDINATES).select("label", "f"), "matrix")
    return predict(bank, train(matrix, trees=trees), classes)


def predictions_to_segmentation(stored: DataFrame) -> DataFrame:
    """Classes of probabilities read back from a stored table of pixels."""
    return argmax_channel(stored)


def predictions_to_uncertainty(stored: DataFrame) -> DataFrame:
    """The margin between the two most probable classes of probabilities read back from a stored table of pixels."""
    return ensemble_margin(stored)


def feature_importances(model: Model, names: list[str]) -> list[tuple[str, float]]:
    """Names and importances, most important first."""
    return sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))


def gini_feature_selection(matrix: DataFrame, names: list[str], count: int, features: str = "f") -> list[str]:
    model = train(matrix, features)
    return [n for n, _ in feature_importances(model, names)[:count]] if model else []
