"""User functions by name: pixel functions, object features, table functions and estimators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_pixel: dict[str, Callable[[Column], Column]] = {}
_feature: dict[str, Callable[[], Column]] = {}
_table: dict[str, Callable[..., DataFrame]] = {}


def pixel_function(name: str):
    """Registers a pointwise function: a Column expression or a pandas UDF of the value."""
    return lambda f: _pixel.setdefault(name, f)


def object_feature(name: str):
    """Registers an aggregate over the pixels of an object (columns v, z, y, x): an expression or a grouped pandas UDF."""
    return lambda f: _feature.setdefault(name, f)


def table_function(name: str):
    """Registers a function from tables to a table, for exports."""
    return lambda f: _table.setdefault(name, f)


def apply_pixel(px: DataFrame, name: str) -> DataFrame:
    return px.withColumn("v", _pixel[name](F.col("v")))


def apply_features(values: DataFrame, names: list[str]) -> DataFrame:
    """Registered features of each object of ``values(image_id, t, object_id, z, y, x, v)``, in one grouped pass."""
    return values.groupBy("image_id", "t", "object_id").agg(*(_feature[n]().alias(n) for n in names))


def apply_table(name: str, *tables: DataFrame) -> DataFrame:
    return _table[name](*tables)


@pixel_function("sqrt")
def _sqrt(v: Column) -> Column:
    return F.sqrt(F.greatest(v, F.lit(0.0)))


@object_feature("spread")
def _spread() -> Column:
    return F.max("v") - F.min("v")


@object_feature("weighted_y")
def _weighted_y() -> Column:
    return F.sum(F.col("v") * F.col("y")) / F.nullif(F.sum("v"), F.lit(0.0))


@table_function("frame_counts")
def _frame_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("image_id", "t").agg(F.count(F.lit(1)).alias("objects"))
