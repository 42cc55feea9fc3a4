"""Annotation strokes and images as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from voxelry.operators.labels import ERASER
from voxelry.sources.files import replace_blocks
from voxelry.sources.tables import COORDINATES


def stroke_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Strokes that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def painted(strokes: DataFrame) -> DataFrame:
    """The last stroke of each pixel; in update mode only pixels that have changed are handed on. Erased pixels have value 0.

    The state holds one row for each painted pixel. It cannot be dropped by time, since old pixels may be edited again;
    strokes that arrive late or twice change nothing, because the greatest seq wins.
    """
    last = strokes.where(F.col("value") != 0).groupBy(*COORDINATES).agg(F.max(F.struct("seq", "value")).alias("s"))
    return last.select(*COORDINATES, F.when(F.col("s.value") == ERASER, 0).otherwise(F.col("s.value")).alias("v"), F.col("s.seq").alias("seq"))


def on_changed_blocks(changes: DataFrame, block: int, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``act(blocks, batch)`` with the distinct blocks that each batch of changed pixels touches."""

    def each(batch: DataFrame, number: int) -> None:
        blocks = batch.select("image_id", "t", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx")).distinct()
        act(blocks, number)

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).start()


def keep_updated(changes: DataFrame, block: int, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Recomputes the blocks that changed pixels touch and replaces them, and only them, in the blocks stored at ``path``.

    ``compute(blocks)`` gets ``image_id, bz, by, bx`` and returns the pixels of these blocks. A batch that is repeated after a
    crash writes the same blocks again.
    """

    def act(blocks: DataFrame, number: int) -> None:
        touched = blocks.select("image_id", F.lit(0).alias("bz"), "by", "bx").distinct()
        if not touched.isEmpty():
            replace_blocks(compute(touched), touched, path, block)

    return on_changed_blocks(changes, block, act, checkpoint)
