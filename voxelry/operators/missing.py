"""Detection and repair of missing slices along z (or frames along t)."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES


def detect_missing(px: DataFrame, patch: int, bins: int = 30, value_range: tuple[float, float] = (0.0, 255.0)) -> DataFrame:
    """Patches of each slice whose pixels all lie in the first histogram bin: ``image_id, t, z, c, py, px, pixels, missing``."""
    low, high = value_range
    place = F.greatest(F.least(F.floor((F.col("v") - low) * bins / (high - low)), F.lit(bins - 1)), F.lit(0))
    keys = ["image_id", "t", "z", "c", F.floor(F.col("y") / patch).cast("int").alias("py"), F.floor(F.col("x") / patch).cast("int").alias("px")]
    return px.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), (F.max(place) == 0).alias("missing"))


def missing_windows(px: DataFrame, shape: dict[str, int], patch: int = 128, halo: int = 30, bins: int = 30, value_range: tuple[float, float] = (0.0, 255.0)) -> DataFrame:
    """Patches judged together with what surrounds them: ``image_id, t, z, c, y0, x0, pixels, missing``.

    Patches are ``patch`` wide and start at its multiples; the last one of a row or column that would leave the image is moved
    inwards, an image smaller than a patch has one. A patch is missing if all pixels of it and of the ``halo`` around it
    lie in the first bin of the histogram. Each pixel is counted for the few patches it touches, before the shuffle.
    """
    low, high = value_range
    place = F.greatest(F.least(F.floor((F.col("v") - low) * bins / (high - low)), F.lit(bins - 1)), F.lit(0))

    def starts(axis: str) -> Column:
        n = shape[axis]
        count, last = -(-n // patch), max(0, n - patch)
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - halo - patch) / patch) + 1)
        near = F.transform(F.sequence(F.least(first, F.lit(count - 1).cast("long")), F.least(F.floor((F.col(axis) + halo) / patch), F.lit(count - 1).cast("long"))), lambda k: F.least(k * patch, F.lit(last).cast("long")))
        return F.filter(F.array_union(near, F.array(F.lit(last).cast("long"))), lambda s: (F.col(axis) >= s - halo) & (F.col(axis) < s + patch + halo))

    rows = px.select("image_id", "t", "z", "c", place.alias("bin"), F.explode(starts("y")).alias("y0"), "x")
    rows = rows.select("image_id", "t", "z", "c", "bin", F.col("y0").cast("int").alias("y0"), F.explode(starts("x")).alias("x0")).withColumn("x0", F.col("x0").cast("int"))
    return rows.groupBy("image_id", "t", "z", "c", "y0", "x0").agg(F.count(F.lit(1)).alias("pixels"), (F.max("bin") == 0).alias("missing"))


def patch_histograms(px: DataFrame, patch: int, bins: int = 30, value_range: tuple[float, float] = (0.0, 255.0)) -> DataFrame:
    """Shares of the pixels of each patch in equal bins: ``image_id, t, z, c, py, px, h ARRAY<DOUBLE>``; values outside the range count at its ends."""
    low, high = value_range
    place = F.greatest(F.least(F.floor((F.col("v") - low) * bins / (high - low)), F.lit(bins - 1)), F.lit(0))
    keys = ["image_id", "t", "z", "c", F.floor(F.col("y") / patch).cast("int").alias("py"), F.floor(F.col("x") / patch).cast("int").alias("px")]
    counts = [F.sum((place == i).cast("int")).cast("double") for i in range(bins)]
    return px.groupBy(*keys).agg(F.array(*(n / F.count(F.lit(1)) for n in counts)).alias("h"))


def train_missing_detector(patches: DataFrame, rounds: int = 4, start: float = 0.1, seed: int = 0) -> Model | None:
    """A linear detector of missing patches from ``patches(h, label)`` with label 0 or 1; None unless both occur.

    Patches without damage are many and mostly alike: training starts from the damaged ones and a share ``start`` of the
    others, and each round adds those that the model of the round before got wrong (hard examples), until there are none.
    """
    first = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1000)) < round(1000 * start)
    rows = written(patches.select(array_to_vector("h").alias("features"), F.col("label").cast("double").alias("label"), ((F.col("label") == 1) | first).alias("used")), "patches")
    if rows.select("label").distinct().count() < 2:
        return None
    if rows.where("used and label = 0").isEmpty():
        rows = rows.withColumn("used", F.lit(True))
    model = None
    for _ in range(rounds):
        model = LogisticRegression(maxIter=50, regParam=1e-4).fit(rows.where("used"))
        scored = model.transform(rows).select("features", "label", "used", (F.col("prediction") != F.col("label")).alias("wrong"))
        rows = written(scored, "patches")
        if rows.where("wrong and not used").isEmpty():
            break
        rows = rows.select("features", "label", (F.col("used") | F.col("wrong")).alias("used"))
    return model


def detect_missing_trained(px: DataFrame, model: Model | None, patch: int, bins: int = 30, value_range: tuple[float, float] = (0.0, 255.0)) -> DataFrame:
    """Like detect_missing, with the verdict of a trained detector: ``image_id, t, z, c, py, px, missing``.

    Without a model, as training gives it where only one class is known, patches are judged by detect_missing.
    """
    if model is None:
        return detect_missing(px, patch, bins, value_range).drop("pixels")
    patches = patch_histograms(px, patch, bins, value_range)
    scored = model.transform(patches.withColumn("features", array_to_vector("h")))
    return scored.select("image_id", "t", "z", "c", "py", "px", (F.col("prediction") == 1).alias("missing"))


def _around(axis: str) -> tuple:
    line = Window.partitionBy(*(c for c in COORDINATES if c != axis)).orderBy(axis)
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    good = F.when(~F.col("missing"), F.struct(F.col(axis).alias("at"), F.col("v").alias("v")))
    return F.last(good, True).over(before), F.first(good, True).over(after)


def _cubic(axis: str) -> Column:
    """The cubic through the two good pixels on either side; null unless all four are there and next to a single missing one."""
    line = Window.partitionBy(*(c for c in COORDINATES if c != axis)).orderBy(axis)
    good = F.when(~F.col("missing"), F.struct(F.col(axis).alias("at"), F.col("v").alias("v")))
    at = lambda k: F.lag(good, -k).over(line)
    value = lambda k: F.when(at(k)["at"] == F.col(axis) + k, at(k)["v"])
    return (value(-1) + value(1)) * (2 / 3) - (value(-2) + value(2)) / 6


def interpolate_missing(px: DataFrame, axis: str = "z", value_range: tuple[float, float] | None = None, method: str = "linear") -> DataFrame:
    """Replaces pixels whose ``missing`` is true by interpolation along an axis between the nearest good ones.

    Method ``cubic`` holds for single missing pixels with two good ones next to them on either side; all others, and those
    of method ``linear``, are interpolated linearly. With a good pixel on one side only its value is taken; with none the value becomes 0. Partitions are single lines of
    pixels along the axis, so that they are as small as the image is deep.
    """
    before, after = _around(axis)
    rows = px.withColumn("_b", before).withColumn("_a", after)
    share = (F.col(axis) - F.col("_b.at")) / F.nullif(F.col("_a.at") - F.col("_b.at"), F.lit(0))
    between = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share
    if method not in ("linear", "cubic"):
        raise ValueError("method linear or cubic")
    if method == "cubic":
        rows = rows.withColumn("_c", _cubic(axis))
    value: Column = F.coalesce(*([F.col("_c")] if method == "cubic" else []), between, F.col("_b.v"), F.col("_a.v"), F.lit(0.0))
    if value_range:
        value = F.greatest(F.least(value, F.lit(value_range[1])), F.lit(value_range[0]))
    return rows.select(*COORDINATES, F.when(F.col("missing"), value).otherwise(F.col("v")).alias("v"))


def fill_missing_slices(px: DataFrame, patch: int, bins: int = 30, value_range: tuple[float, float] = (0.0, 255.0), axis: str = "z") -> DataFrame:
    """Detection and interpolation in one: the pixels of missing patches are rewritten."""
    found = detect_missing(px, patch, bins, value_range).select("image_id", "t", "z", "c", F.col("py").alias("_py"), F.col("px").alias("_px"), "missing")
    rows = px.withColumn("_py", F.floor(F.col("y") / patch).cast("int")).withColumn("_px", F.floor(F.col("x") / patch).cast("int"))
    return interpolate_missing(rows.join(found, ["image_id", "t", "z", "c", "_py", "_px"]).drop("_py", "_px"), axis, value_range)
