"""Files, streams and the registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.functions import registry
from voxelry.operators import geometry, labels
from voxelry.sources import files, tables
from voxelry.streaming import strokes as streams


def dense(px, shape):
    a = np.zeros(shape)
    for r in px.collect():
        a[r["z"], r["y"], r["x"]] = r["v"]
    return a


def test_npy_stack_and_raw(spark, tmp_path):
    rng = np.random.default_rng(0)
    volume = rng.integers(1, 100, (3, 4, 5))
    for z in range(3):
        np.save(tmp_path / f"slice{z}.npy", volume[z])
    (tmp_path / "raw.bin").write_bytes(volume.astype("<i2").tobytes())
    assert (dense(files.read_stack(spark, str(tmp_path / "*.npy"), "z"), volume.shape) == volume).all()
    assert (dense(files.read_raw(spark, str(tmp_path / "raw.bin"), (3, 4, 5), "<i2", "zyx"), volume.shape) == volume).all()
    np.save(tmp_path / "slice9.npy", np.zeros((2, 2)))
    with pytest.raises(ValueError):
        files.read_stack(spark, str(tmp_path / "*.npy"), "z")


def test_blocks_and_pyramid(spark, small, tmp_path):
    px = tables.px_sales(spark, small).cache()
    files.write_blocks(px, str(tmp_path / "blocks"), 16)
    back = files.read_blocks(spark, str(tmp_path / "blocks"))
    assert back.select(*px.columns).exceptAll(px).count() == 0 and back.count() == px.count()
    image = px.agg(F.min("image_id")).first()[0]
    grid = spark.createDataFrame([(image, 0, 0, 0), (image, 9, 9, 9)], "image_id string, bz int, by int, bx int")
    assert [r["bz"] for r in files.missing_blocks(back, grid).collect()] == [9]
    assert files.write_pyramid(px, str(tmp_path / "pyramid"), 48, 16) == 3
    half = files.read_scale(spark, str(tmp_path / "pyramid"), 1)
    assert half.count() == geometry.downscale(px, {"y": 2, "x": 2}).count()


def test_strokes_as_a_stream_agree_with_the_table(spark, small, tmp_path):
    all_ = tables.strokes(spark, small)
    for part in range(2):
        all_.where(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.painted(streams.stroke_stream(spark, str(tmp_path / "in"), all_.schema))
    seen = []
    query = streams.on_changed_blocks(stream, 8, lambda blocks, number: seen.append(blocks.count()), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) >= labels.nonzero_blocks(labels.paint(all_), {"y": 8, "x": 8}).count()


def test_axes_with_several_indexes_are_not_dropped(spark, small):
    with pytest.raises(Exception, match="several indexes"):
        geometry.reorder_axes(tables.px_sales(spark, small), "xy").collect()


def test_table_functions(spark):
    objects = spark.createDataFrame([("a", 0, 1), ("a", 0, 2)], "image_id string, t int, object_id long")
    assert registry.apply_table("frame_counts", objects).first()["objects"] == 2


def test_every_written_volume_is_read_back(spark, small, tmp_path):
    px = tables.px_sales(spark, small).where("image_id = 'A0'").cache()
    want = {tuple(r) for r in px.select(*tables.COORDINATES, "v").collect()}
    for kind in ("parquet", "csv", "npy"):
        files.write_volume(px, str(tmp_path / f"volume.{kind}"), kind, 16)
        where = str(tmp_path / f"volume.{kind}")
        back = (files.read_arrays if kind == "npy" else files.read_images)(spark, where).where("v <> 0")
        assert {tuple(r) for r in back.select(*tables.COORDINATES, "v").collect()} == want
    files.write_volume(px, str(tmp_path / "arrays"), "npy", 16)
    assert files.read_images(spark, str(tmp_path / "arrays")).where("v <> 0").count() == len(want)


def test_tiles_sequences_and_clouds(spark, tmp_path):
    tiles = spark.createDataFrame([("a", 0, 0, 1, 2, 0, 5.0, 1, 3)], files.PIXELS + ", tile_y int, tile_x int")
    assert tuple(files.assemble_tiles(tiles, 10, 20).first()) == ("a", 0, 0, 11, 62, 0, 5.0)
    files.write_sequence(spark.createDataFrame([("a", 0, z, 0, 0, 0, float(z)) for z in range(3)], files.PIXELS), str(tmp_path / "sequence"), "z")
    assert sorted(p.name for p in (tmp_path / "sequence").iterdir() if p.is_dir()) == ["z=0", "z=1", "z=2"]
    names = [f"{a}_px" for a in ("x", "y", "z", "size", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")]
    (tmp_path / "cloud.csv").write_text("\t".join(names) + "\n" + "\t".join(str(float(k)) for k in range(10)) + "\n")
    assert list(files.read_pointcloud(spark, str(tmp_path / "cloud.csv")).first()) == [float(k) for k in range(10)]
    px = spark.createDataFrame([("a", 0, z, y, x, 0, 1.0) for z in range(4) for y in range(4) for x in range(4)], files.PIXELS)
    assert files.write_pyramid(px, str(tmp_path / "scales"), 4, 2, "zyx") == 2 and files.read_scale(spark, str(tmp_path / "scales"), 1).count() == 8


BLOCK_GRID = "image_id string, bz int, by int, bx int"


def test_a_stopped_run_goes_on_and_gives_the_same_blocks(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, 0, y, x, 0, float(y * 8 + x)) for y in range(8) for x in range(8) if (y, x) != (7, 7)], files.PIXELS)
    grid = spark.createDataFrame([("a", 0, y, x) for y in range(3) for x in range(2)], BLOCK_GRID)  # the last row of blocks is empty
    calls = []

    def compute(todo):
        calls.append(todo.count())
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return px.withColumn("v", F.col("v") * 2)

    path = str(tmp_path / "blocks")
    with pytest.raises(RuntimeError):
        files.write_missing_blocks(grid, compute, path, 4, at_once=2)
    assert files.read_blocks(spark, path).count() == 32
    assert files.write_missing_blocks(grid, compute, path, 4, at_once=2) == 2 and calls == [2, 2, 2, 2]
    got = {(r["y"], r["x"]): r["v"] for r in files.read_blocks(spark, path).collect()}
    assert got == {(r["y"], r["x"]): 2 * r["v"] for r in px.collect()}
    assert files.write_missing_blocks(grid, compute, path, 4) == 0


def test_changed_blocks_alone_are_recomputed_and_twice_is_once(spark, tmp_path):
    path, inbox, checkpoint = str(tmp_path / "blocks"), str(tmp_path / "in"), str(tmp_path / "check")
    grid = spark.createDataFrame([("a", 0, y, x) for y in range(2) for x in range(2)], BLOCK_GRID)
    px = spark.createDataFrame([("a", 0, 0, y, x, 0, 1.0) for y in range(8) for x in range(8)], files.PIXELS)
    files.replace_blocks(px, grid, path, 4)
    strokes = "seq long, image_id string, t int, z int, y int, x int, c int, value int"
    spark.createDataFrame([(1, "a", 0, 0, 1, 6, 0, 2)], strokes).write.parquet(inbox)
    seen, fail = [], [True]

    def compute(blocks):
        seen.append(sorted((r["by"], r["bx"]) for r in blocks.collect()))
        if fail.pop() if fail else False:
            raise RuntimeError("stopped")
        return px.withColumn("v", F.lit(7.0))

    stream = streams.painted(streams.stroke_stream(spark, inbox, strokes))
    for _ in range(2):
        query = streams.keep_updated(stream, 4, compute, path, checkpoint)
        try:
            query.processAllAvailable()
        except Exception as e:  # the first attempt is stopped within its batch
            assert "stopped" in str(e)
        query.stop()
    assert seen == [[(0, 1)], [(0, 1)]]
    got = {(r["y"], r["x"]): r["v"] for r in files.read_blocks(spark, path).collect()}
    assert got == {(y, x): 7.0 if y < 4 <= x else 1.0 for y in range(8) for x in range(8)}
