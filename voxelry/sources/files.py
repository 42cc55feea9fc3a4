"""Reading and writing of images as files: numpy and raw arrays, tiles and blocks, point clouds, pyramids."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelry.operators.geometry import downscale, renormalize, reorder_axes, subregion
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES

PIXELS = "image_id string, t int, z int, y int, x int, c int, v double"


def _rows(name: str, a: np.ndarray, axes: str) -> pd.DataFrame:
    """Pixels of an array whose axes are named; missing axes are 0."""
    index = np.indices(a.shape).reshape(a.ndim, -1)
    at = {k: index[axes.index(k)] if k in axes else np.zeros(a.size, dtype=np.int64) for k in "tzyxc"}
    return pd.DataFrame({"image_id": name, **{k: at[k].astype(np.int32) for k in "tzyxc"}, "v": a.reshape(-1).astype(np.float64)})


def _decoded(spark: SparkSession, path: str, decode, axes: str) -> DataFrame:
    """One image for each binary file; files are decoded in parallel and one by one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield _rows(name.rsplit("/", 1)[-1], decode(content), axes)

    return files.mapInPandas(run, PIXELS)


def read_npy(spark: SparkSession, path: str, axes: str = "yx") -> DataFrame:
    return _decoded(spark, path, lambda b: np.load(io.BytesIO(b), allow_pickle=False), axes)


def read_raw(spark: SparkSession, path: str, shape: tuple[int, ...], dtype: str, axes: str) -> DataFrame:
    return _decoded(spark, path, lambda b: np.frombuffer(b, dtype=dtype).reshape(shape), axes)


def read_images(spark: SparkSession, path: str, axes: str = "yx") -> DataFrame:
    """By extension and content: .npy arrays, CSV with a header, Parquet tables of pixels, blocks or arrays, as write_volume makes them."""
    if path.rstrip("*").endswith(".npy"):
        return read_npy(spark, path, axes)
    if path.rstrip("*").endswith(".csv"):
        return spark.read.csv(path, header=True, schema=PIXELS)
    columns = spark.read.parquet(path).columns
    if "npy" in columns:
        return read_arrays(spark, path)
    return (read_blocks(spark, path) if "image" in columns else spark.read.schema(PIXELS).parquet(path)).select(*COORDINATES, "v")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of a table of arrays as by block_arrays, zeros included; arrays are decoded one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a = np.load(io.BytesIO(r.npy), allow_pickle=False)
                rows = _rows(r.image_id, a, "zyx")
                rows["t"], rows["c"] = np.int32(r.t), np.int32(r.c)
                for axis, b, n in zip("zyx", (r.bz, r.by, r.bx), (a.shape[1] if a.shape[0] > 1 else 1, a.shape[1], a.shape[2])):
                    rows[axis] += np.int32(b * n)
                yield rows

    return spark.read.parquet(path).mapInPandas(run, PIXELS)


def read_stack(spark: SparkSession, path: str, axis: str = "z", axes: str = "yx", name: str = "stack") -> DataFrame:
    """Files in the order of their names become the slices of one image; files of different shapes raise an error."""
    slices = read_images(spark, path, axes)
    shapes = slices.groupBy("image_id").agg(*(F.max(a).alias(a) for a in axes))
    found = [tuple(r) for r in shapes.select(*axes).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"slices of different shapes: {found}")
    # one short row for each file
    places = shapes.select("image_id").withColumn("_place", F.row_number().over(Window.orderBy("image_id")) - 1)
    return slices.join(places, "image_id").withColumn(axis, F.col("_place").cast("int")).select(F.lit(name).alias("image_id"), *COORDINATES[1:], "v")


def read_pointcloud(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated points with ten named columns; a file without them raises an error."""
    names = [f"{a}_px" for a in ("x", "y", "z", "size", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")]
    return spark.read.option("enforceSchema", "false").csv(path, sep="\t", header=True, schema=", ".join(f"{n} double" for n in names))


def write_blocks(px: DataFrame, path: str, block: int) -> None:
    """One folder for each image and block, so that blocks are read by partition pruning."""
    rows = px.withColumns({f"b{a}": F.floor(F.col(a) / block).cast("int") for a in "zyx"}).withColumnRenamed("image_id", "image")
    rows.repartition("image", "bz", "by", "bx").write.partitionBy("image", "bz", "by", "bx").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of blocks as write_blocks and replace_blocks store them."""
    return spark.read.parquet(path).where("v is not null").withColumn("image_id", F.col("image").cast("string"))


def replace_blocks(px: DataFrame, blocks: DataFrame, path: str, block: int) -> None:
    """Writes the pixels of ``blocks(image_id, bz, by, bx)``; other stored blocks stay, and blocks without pixels become empty.

    Folders of blocks are replaced as a whole, so that writing the same blocks twice does no harm. An empty block keeps a
    row without a value.
    """
    rows = px.select(*COORDINATES, F.col("v").cast("double").alias("v")).withColumns({f"b{a}": F.floor(F.col(a) / block).cast("int") for a in "zyx"})
    rows = rows.join(blocks, ["image_id", "bz", "by", "bx"], "left_semi")
    marks = blocks.select("image_id", *(F.lit(0).alias(c) for c in COORDINATES[1:]), F.lit(None).cast("double").alias("v"), "bz", "by", "bx")
    both = rows.select(*COORDINATES, "v", "bz", "by", "bx").unionByName(marks).withColumnRenamed("image_id", "image")
    both.repartition("image", "bz", "by", "bx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image", "bz", "by", "bx").parquet(path)


def write_missing_blocks(grid: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, block: int, at_once: int = 1000) -> int:
    """Computes and writes the blocks of ``grid(image_id, bz, by, bx)`` that ``path`` lacks, up to ``at_once`` in one go.

    A run that was stopped goes on where it was: what is stored is the list of what is done, and a block is stored as a whole.
    Returns the number of goes.
    """
    spark, goes = grid.sparkSession, 0
    order = ["image_id", "bz", "by", "bx"]
    while True:
        try:
            done = spark.read.parquet(path).select(F.col("image").cast("string").alias("image_id"), "bz", "by", "bx").distinct()
            left = missing_blocks(done, grid)
        except AnalysisException:  # nothing is stored yet
            left = grid
        todo = written(left.select(*order).distinct().orderBy(*order).limit(at_once), "todo")
        if todo.isEmpty():
            return goes
        replace_blocks(compute(todo), todo, path, block)
        goes += 1


def missing_blocks(blocks: DataFrame, grid: DataFrame) -> DataFrame:
    """Blocks of ``grid(image_id, bz, by, bx)`` that have not been written: what a resumed run still has to do."""
    return grid.join(blocks.select("image_id", "bz", "by", "bx").distinct(), ["image_id", "bz", "by", "bx"], "left_anti")


def assemble_tiles(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of 2D tiles (``tile_y, tile_x`` and y, x inside) at their places in the volume."""
    return tiles.withColumn("y", F.col("tile_y") * height + F.col("y")).withColumn("x", F.col("tile_x") * width + F.col("x")).select(*COORDINATES, "v")


def block_arrays(px: DataFrame, block: int) -> DataFrame:
    """Each block as one array in numpy's format: ``image_id, t, c, bz, by, bx, npy BINARY``; absent pixels are 0."""
    key = ["image_id", "t", "c", "bz", "by", "bx"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((block, block, block) if pdf["bz"].iloc[0] or pdf["z"].max() else (1, block, block))
        a[pdf["z"] % block if len(a) > 1 else 0, pdf["y"] % block, pdf["x"] % block] = pdf["v"]
        out = io.BytesIO()
        np.save(out, a)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in key}, "npy": [out.getvalue()]})

    rows = px.withColumns({f"b{a}": F.floor(F.col(a) / block).cast("int") for a in "zyx"})
    return rows.groupBy(*key).applyInPandas(pack, "image_id string, t int, c int, bz int, by int, bx int, npy binary")


def write_volume(px: DataFrame, path: str, kind: str = "parquet", block: int = 64) -> None:
    """Writes a pixel table as Parquet blocks, as CSV with a header, or as a table of arrays in numpy's format."""
    if kind == "parquet":
        write_blocks(px, path, block)
    elif kind == "csv":
        px.select(*COORDINATES, "v").write.csv(path, header=True)
    elif kind == "npy":
        block_arrays(px, block).write.parquet(path)
    else:
        raise ValueError(f"no such format: {kind}")


def export_selected(results: dict[str, DataFrame], choice: str, path: str, lane: dict[str, str], kind: str = "parquet", **formatting) -> str:
    """Writes the chosen one of several result images; ``path`` may name ``{choice}`` and the fields of the lane. Returns the path.

    With ``formatting`` (the arguments of ``formatted``) the result is cut, renormalized and cast before.
    """
    if choice not in results:
        raise ValueError(f"no result {choice!r}; there are {sorted(results)}")
    at = path.format(choice=choice.lower().replace(" ", "-"), **lane)
    write_volume(formatted(results[choice], **formatting) if formatting else results[choice], at, kind)
    return at


def dataset_catalog(roles: dict[str, DataFrame]) -> DataFrame:
    """``image_id, role, n_t, n_z, n_y, n_x, n_c, pixels``: the images of each role with their extents."""
    tables = [
        px.groupBy("image_id").agg(*((F.max(a) + 1).alias(f"n_{a}") for a in "tzyxc"), F.count(F.lit(1)).alias("pixels")).select("image_id", F.lit(role).alias("role"), *(f"n_{a}" for a in "tzyxc"), "pixels")
        for role, px in roles.items()
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def catalog_mismatches(catalog: DataFrame, role: str, axes: str = "tzyx") -> DataFrame:
    """Images of other roles that lack an image of ``role`` or differ from it in an extent: ``image_id, role, missing, differs ARRAY``."""
    base = catalog.where(F.col("role") == role).select("image_id", *(F.col(f"n_{a}").alias(f"b_{a}") for a in axes), F.lit(True).alias("_there"))
    both = catalog.where(F.col("role") != role).join(base, "image_id", "left")
    differs = F.array_compact(F.array(*(F.when(F.col(f"n_{a}") != F.col(f"b_{a}"), F.lit(a)) for a in axes)))
    return both.select("image_id", "role", F.col("_there").isNull().alias("missing"), differs.alias("differs")).where(F.col("missing") | (F.size("differs") > 0))


def check_catalog(catalog: DataFrame, role: str, axes: str = "tzyx") -> DataFrame:
    """The catalog, or an error that names some images whose roles do not fit together."""
    bad = catalog_mismatches(catalog, role, axes).orderBy("image_id", "role").limit(5).collect()
    if bad:
        raise ValueError(f"images do not fit those of role {role!r}: {[(r['image_id'], r['role'], r['differs']) for r in bad]}")
    return catalog


def write_sequence(px: DataFrame, path: str, axis: str) -> None:
    px.repartition(axis).write.partitionBy(axis).parquet(path)


def write_pyramid(px: DataFrame, path: str, size: int, smallest: int = 64, axes: str = "yx") -> int:
    """Halves the named axes until an image of ``size`` fits into ``smallest``; one partition for each scale. Returns the number of scales."""
    scales = max(1, math.ceil(math.log2(max(1, size / smallest))) + 1)
    level = px
    for s in range(scales):
        level.withColumn("scale", F.lit(s)).write.mode("append").partitionBy("scale").parquet(path)
        level = downscale(level, dict.fromkeys(axes, 2))
    return scales


def read_scale(spark: SparkSession, path: str, scale: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("scale") == scale).drop("scale")


def formatted(px: DataFrame, start: dict[str, int], stop: dict[str, int], in_range: tuple[float, float], top: float, kind: str, axes: str | None = None) -> DataFrame:
    """Subregion, renormalized from a data range to [0, top], and cast; with ``axes`` only these are kept, in this order.

    The region is clipped to the images: it starts at 0 at the least, and what lies beyond their ends holds no pixels.
    """
    low = {a: max(0, n) for a, n in start.items()}
    out = renormalize(subregion(px, low, {a: max(low[a], n) for a, n in stop.items()}), *in_range)
    out = out.withColumn("v", F.round(F.col("v") * top).cast(kind))
    return out if axes is None else reorder_axes(out, axes)
