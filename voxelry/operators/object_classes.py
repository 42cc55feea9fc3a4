"""Classification of objects: matrices of their features, training, prediction, and the whole way from pixels to classes."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.learning import Learner, predict, train
from voxelry.operators.objects import OBJECT, region_features, replace_missing
from voxelry.operators.regions import relabel_by_map
from voxelry.plans.stored import written

#: Columns of object tables that tell where an object is, not what it looks like.
PLACES = frozenset([*OBJECT, "cz", "cy", "cx", "min_z", "max_z", "min_y", "max_y", "min_x", "max_x", "bad"])


def selected_features(objects: DataFrame, selected: list[str] | None = None) -> list[str]:
    """The feature columns in alphabetical order: the selected ones, or all numbers but ids and places."""
    numbers = [c for c, kind in objects.dtypes if kind in ("double", "float", "int", "bigint", "smallint") and c not in PLACES]
    unknown = sorted(set(selected or []) - set(objects.columns))
    if unknown:
        raise ValueError(f"no such features: {unknown}")
    return sorted(selected or numbers)


def feature_array(objects: DataFrame, labels: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """``image_id, t, object_id, label, f ARRAY<DOUBLE>`` for labelled objects: features in alphabetical order, missing ones 0.

    ``labels(image_id, t, object_id, label)``; label 0 or null is no label.
    """
    names = selected_features(objects, selected)
    whole = replace_missing(objects.select(*OBJECT, *(F.col(c).cast("double").alias(c) for c in names)), names)
    return whole.join(labels.where("label > 0").select(*OBJECT, "label"), OBJECT).select(*OBJECT, "label", F.array(*names).alias("f"))


def object_train(objects: DataFrame, labels: DataFrame, selected: list[str] | None = None, trees: int = 100, learner: Learner | None = None) -> Model | None:
    """A model of labelled objects, a forest unless another learner is given; None with fewer labelled objects than classes."""
    return train(written(feature_array(objects, labels, selected), "objects"), trees=trees, learner=learner)


def object_predict(objects: DataFrame, model: Model | None, classes: int, selected: list[str] | None = None) -> DataFrame:
    """``image_id, t, object_id, predicted, p, uncertainty, bad`` for each object.

    ``p`` holds a probability for each class from 1 on, ``predicted`` the most probable class (the first on ties, 0 without
    a model), ``uncertainty`` is 1 - (largest - second), ``bad`` names the features that were missing or not finite.
    """
    names = selected_features(objects, selected)
    whole = replace_missing(objects.select(*OBJECT, *(F.col(c).cast("double").alias(c) for c in names)), names)
    scored = predict(whole.select(*OBJECT, "bad", F.array(*names).alias("f")), model, classes)
    top = F.sort_array("p", asc=False)
    predicted = F.when(F.get(top, F.lit(0)) > 0, F.array_position("p", F.get(top, F.lit(0)))).otherwise(0).cast("int")
    uncertainty = F.when(F.size("p") > 1, 1 - (F.get(top, F.lit(0)) - F.get(top, F.lit(1)))).otherwise(0.0)
    return scored.select(*OBJECT, predicted.alias("predicted"), "p", uncertainty.alias("uncertainty"), "bad")


def class_image(labels: DataFrame, predictions: DataFrame, column: str = "predicted") -> DataFrame:
    """The label image with each object's class; background and objects without prediction are 0."""
    return relabel_by_map(labels, predictions.select("image_id", "t", F.col("object_id").alias("old"), F.col(column).alias("new")))


def probability_images(labels: DataFrame, predictions: DataFrame, classes: int) -> DataFrame:
    """The label image with one channel for each class: the probability of the object a pixel lies in."""
    channels = predictions.select("image_id", "t", F.col("object_id").alias("v"), F.posexplode(F.slice("p", 1, classes)).alias("k", "share"))
    return labels.join(channels, ["image_id", "t", "v"]).select("image_id", "t", "z", "y", "x", F.col("k").alias("c"), F.col("share").alias("v"))


def bad_objects(predictions: DataFrame) -> DataFrame:
    """A warning for each image and frame: objects with missing features, and which features these are."""
    return predictions.where(F.size("bad") > 0).groupBy("image_id", "t").agg(F.count(F.lit(1)).alias("objects"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("bad")))).alias("features"))


def object_classification(raw: DataFrame, labels: DataFrame, annotated: DataFrame, classes: int, selected: list[str] | None = None, trees: int = 100) -> tuple[DataFrame, DataFrame]:
    """From raw pixels, a label image and labels of some objects to predictions of all objects and the image of their classes."""
    objects = written(region_features(raw, labels), "objects")
    model = object_train(objects, annotated, selected, trees)
    predictions = written(object_predict(objects, model, classes, selected), "predictions")
    return predictions, class_image(labels, predictions)
