"""Scoring of new images as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxelry.sources.files import PIXELS


def score_new_images(spark: SparkSession, source: str, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], files_at_once: int = 100) -> StreamingQuery:
    """Applies ``score`` to the pixel tables that are new in the folder ``source`` and appends the results to ``target``.

    Each file is scored once: what has been done is kept in ``checkpoint``, so that a stopped run goes on where it ended.
    Results are partitioned by batch, so that a batch that is repeated after a failure replaces its own rows. An image must
    lie in one file. The query ends when no file is left; call it again, or on a schedule, for later ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    images = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return images.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
