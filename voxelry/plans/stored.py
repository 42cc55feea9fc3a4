"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FACTOR = "spark.sql.sources.fileCompressionFactor"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Pixel tables take two to five bytes a row in a file and over a hundred in a broadcast.
EXPANSION = 32


def expect_packed_files(spark: SparkSession) -> None:
    """Lets the planner count ``EXPANSION`` bytes for each byte of a table's file when it looks for small sides of joins.

    Coordinates and labels are packed so well that a file below the limit for broadcasts may hold millions of rows, more than
    the driver can build. Sides that turn out small are still broadcast by adaptive execution, which knows the rows themselves.
    A larger factor that the session has already is kept.
    """
    if float(spark.conf.get(_FACTOR, "1.0")) < EXPANSION:
        spark.conf.set(_FACTOR, str(float(EXPANSION)))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session, as in tests, may leave the setting out: it then gets a temporary folder. On a cluster a
    missing setting is an error, because a machine-local folder would not be seen by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="voxelry-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs at most the stage at hand, and an expensive pass runs once however many
    later steps read its result. The table lives as long as the shared folder does. What was shuffled for it goes as soon as
    it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voxelry/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
