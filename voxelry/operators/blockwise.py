"""Work on blocks with a halo and on neighbourhoods: window vectors, objects block by block, features of volumes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.filters import WINDOW, _smoothed, at_pixels, correlate, gaussian_kernel
from voxelry.operators.objects import OBJECT, region_features
from voxelry.operators.regions import connected_components
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES


def neighbourhood_vectors(px: DataFrame, radius: int = 1) -> DataFrame:
    """The square window around every present pixel, row by row: ``image_id, t, z, y, x, c, f ARRAY<DOUBLE>``.

    Absent pixels count as 0. Each pixel is sent to the windows that hold it; there is one shuffle. The result trains
    classifiers that look at a neighbourhood (``learning.label_feature_matrix``, ``train``, ``predict``).
    """
    side = 2 * radius + 1
    offsets = [(i, i // side - radius, i % side - radius) for i in range(side * side)]
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, dy, dx in offsets)))
    sent = px.select(*COORDINATES, "v", steps.alias("d")).withColumns({"y": F.col("y") - F.col("d.dy"), "x": F.col("x") - F.col("d.dx")})
    found = sent.groupBy(*COORDINATES).agg(F.map_from_entries(F.collect_list(F.struct("d.i", "v"))).alias("m"))
    present = found.where(F.map_contains_key("m", F.lit(side * side // 2)))
    values = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return present.select(*COORDINATES, values.alias("f"))


def in_blocks(px: DataFrame, block: int, halo: int) -> DataFrame:
    """Every block of y and x with its halo as an image of its own, named ``by/bx/image_id``."""
    span = lambda a: F.explode(F.sequence(F.floor((F.col(a) - halo) / block), F.floor((F.col(a) + halo) / block)))
    rows = px.select("*", span("y").alias("_by")).select("*", span("x").alias("_bx"))
    return rows.withColumn("image_id", F.concat_ws("/", F.col("_by").cast("string"), F.col("_bx").cast("string"), "image_id")).drop("_by", "_bx")


def out_of_blocks(px: DataFrame, block: int) -> DataFrame:
    """Undoes in_blocks: pixels outside the core of their block are left out, image names restored."""
    parts = F.split("image_id", "/", 3)
    rows = px.withColumn("_p", parts)
    core = (F.floor(F.col("y") / block) == F.get("_p", F.lit(0)).cast("long")) & (F.floor(F.col("x") / block) == F.get("_p", F.lit(1)).cast("long"))
    return rows.where(core).withColumn("image_id", F.get("_p", F.lit(2))).drop("_p")


def blockwise_object_classification(raw: DataFrame, mask: DataFrame, classify: Callable[[DataFrame], DataFrame], block: int = 512, halo: int = 64) -> DataFrame:
    """Class images made block by block: objects are found in a block with its halo, classified there, and the core is kept.

    ``mask`` holds the foreground pixels; ``classify`` turns rows of ``region_features`` into ``image_id, t, object_id,
    class``. An object that reaches over the halo is judged by the part within it. Returns pixels with the class as v.
    """
    labels = written(connected_components(in_blocks(mask.select(*COORDINATES, F.lit(1.0).alias("v")), block, halo)), "blocks")
    judged = classify(region_features(in_blocks(raw.select(*COORDINATES, "v"), block, halo), labels)).select(*OBJECT, F.col("class").alias("_class"))
    pixels = labels.withColumnRenamed("v", "object_id").join(judged, OBJECT)
    return out_of_blocks(pixels.select(*COORDINATES, F.col("_class").alias("v")), block)


VOLUME_FEATURES = ["gaussian", "laplacian", "gradient", "dog", "hessian_0", "hessian_1", "hessian_2", "tensor_0", "tensor_1", "tensor_2"]
_UPPER = [(i, j) for i in range(3) for j in range(i, 3)]


def _eigenvalues(entries: list[np.ndarray]) -> np.ndarray:
    """Of symmetric matrices given by their upper triangles, largest first, along the last axis."""
    m = np.empty((*entries[0].shape, 3, 3))
    for (i, j), e in zip(_UPPER, entries):
        m[..., i, j] = m[..., j, i] = e
    return np.linalg.eigvalsh(m)[..., ::-1]


def volume_features(volume: np.ndarray, sigma: float, at: tuple = (...,)) -> dict[str, np.ndarray]:
    """All features of one dense block z, y, x at one scale, at the places ``at`` of the block or at all."""
    kernels = [gaussian_kernel(sigma, o) for o in range(3)]
    small, outer = gaussian_kernel(0.66 * sigma), gaussian_kernel(0.5 * sigma)
    known: dict[tuple, np.ndarray] = {(): volume}

    def derived(*axes: int) -> np.ndarray:
        orders = tuple(axes.count(a) for a in range(3))
        for a in range(3):
            if orders[: a + 1] not in known:
                known[orders[: a + 1]] = correlate(known[orders[:a]], kernels[orders[a]], a)
        return known[orders]

    smooth, slopes, second = derived(), [derived(a) for a in range(3)], [derived(i, j)[at] for i, j in _UPPER]
    hessian = _eigenvalues(second)
    tensor = _eigenvalues([_smoothed(slopes[i] * slopes[j], outer)[at] for i, j in _UPPER])
    found = {"gaussian": smooth[at], "laplacian": second[0] + second[3] + second[5], "gradient": np.sqrt(sum(s[at] * s[at] for s in slopes)), "dog": smooth[at] - _smoothed(volume, small)[at]}
    return found | {f"hessian_{i}": hessian[..., i] for i in range(3)} | {f"tensor_{i}": tensor[..., i] for i in range(3)}


def volume_feature_bank(px: DataFrame, sigmas: list[float], features: list[str] | None = None, block: int = 32) -> DataFrame:
    """Features of volumes at several scales for every present pixel: ``image_id, t, z, y, x, c, f ARRAY<FLOAT>``.

    Blocks of z, y and x are computed with a halo as wide as the kernels reach, so that the result does not
    depend on them and memory is bounded by block, halo and scales. Absent pixels count as 0.
    """
    features = features or VOLUME_FEATURES
    halo = math.ceil(WINDOW * max(sigmas)) + math.ceil(WINDOW * max(sigmas) * 0.66) + 1

    def compute(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = [volume_features(values, s, tuple(at)) for s in sigmas]
        return np.stack([f[name] for f in found for name in features], axis=1)

    return at_pixels(px, compute, halo, block, "zyx")


def _hull_volume(points: np.ndarray) -> float:
    """Volume of the convex hull of integer points in space that do not lie in one plane; exact up to the division by 6."""
    points = np.unique(points, axis=0).astype(np.int64)
    points -= points[0]
    corner = [0]  # a first tetrahedron: far points first
    far = int(np.argmax((points**2).sum(axis=1)))
    corner.append(far)
    cross = np.cross(points, points[far])
    corner.append(int(np.argmax((cross.astype(float) ** 2).sum(axis=1))))
    normal = np.cross(points[corner[1]], points[corner[2]])
    corner.append(int(np.argmax(np.abs(points @ normal))))
    if points[corner[3]] @ normal > 0:
        corner[1], corner[2] = corner[2], corner[1]
    a, b, c, d = corner
    faces = np.array([(a, b, c), (a, d, b), (b, d, c), (c, d, a)])
    normals = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
    order = np.argsort(-((points - points.mean(axis=0)) ** 2).sum(axis=1), kind="stable")
    for p in order:
        seen = ((points[p] - points[faces[:, 0]]) * normals).sum(axis=1) > 0
        if not seen.any():
            continue
        edges = {(int(f[i]), int(f[(i + 1) % 3])) for f in faces[seen] for i in range(3)}
        new = np.array([(u, v, p) for u, v in edges if (v, u) not in edges])
        faces = np.vstack([faces[~seen], new])
        normals = np.vstack([normals[~seen], np.cross(points[new[:, 1]] - points[new[:, 0]], points[new[:, 2]] - points[new[:, 0]])])
    return float((points[faces[:, 0]] * normals).sum()) / 6.0


def _hull_area(points: set[tuple[int, int]]) -> float:
    """Area of the convex hull of integer points in the plane."""
    ordered, twice = sorted(points), 0
    for way in (ordered, ordered[::-1]):
        chain: list[tuple[int, int]] = []
        for p in way:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        twice += sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(chain, chain[1:]))
    return abs(twice) / 2


def _hull_of_lines(z: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> float:
    """Volume of the hull of lines of voxels along x, from ``lo`` up to ``hi``. Objects one voxel thick along an axis are prisms."""
    pairs = None
    if (z == z[0]).all():
        pairs = ((y, lo), (y, hi), (y + 1, lo), (y + 1, hi))
    elif (y == y[0]).all():
        pairs = ((z, lo), (z, hi), (z + 1, lo), (z + 1, hi))
    elif (lo == lo[0]).all() and (hi == lo[0] + 1).all():
        pairs = ((z, y), (z, y + 1), (z + 1, y), (z + 1, y + 1))
    if pairs:
        return _hull_area({p for a, b in pairs for p in zip(a.tolist(), b.tolist())})
    return _hull_volume(np.concatenate([np.stack([z + dz, y + dy, x], axis=1) for dz in (0, 1) for dy in (0, 1) for x in (lo, hi)]))


def volume_hull_features(labels: DataFrame) -> DataFrame:
    """Voxels, volume of the convex hull and convexity of each object in space: ``image_id, t, object_id, count, hull_volume, convexity``.

    A voxel is a cube of side 1 and the hull is that of all cubes, so that flat objects need no rule and convexity is at
    most 1. Lines of voxels along x are reduced to their two ends before objects are gathered. Objects that fill their box
    are their own hull and are not looked at one by one.
    """
    own = labels.where("v <> 0").select("image_id", "t", F.col("v").alias("object_id"), "z", "y", "x")
    lines = own.groupBy(*OBJECT, "z", "y").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), (F.max("x") + 1).alias("hi"))
    lines = lines.selectExpr(*OBJECT, "cast(z as long) z", "cast(y as long) y", "n", "cast(lo as long) lo", "cast(hi as long) hi")

    @F.pandas_udf("double")
    def hull_volume(ends: pd.Series) -> pd.Series:
        return ends.map(lambda flat: np.nan if flat is None else _hull_of_lines(*flat.reshape(-1, 4).T))

    box = (F.max("z") - F.min("z") + 1) * (F.max("y") - F.min("y") + 1) * (F.max("hi") - F.min("lo"))
    whole = lines.groupBy(*OBJECT).agg(F.sum("n").alias("count"), box.alias("box"), F.flatten(F.collect_list(F.array("z", "y", "lo", "hi"))).alias("ends"))
    hull = hull_volume(F.when(F.col("count") < F.col("box"), F.col("ends")))
    volume = F.when(F.col("count") < F.col("box"), hull).otherwise(F.col("box").cast("double"))
    return whole.select(*OBJECT, "count", volume.alias("hull_volume")).withColumn("convexity", F.col("count") / F.col("hull_volume"))
