"""Helpers that several operators of this package use: written intermediate tables, connected components, joins with hot keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.components import connected_components
from voxelry.plans.stored import shared_folder, written

__all__ = ["connected_components", "salted_join", "shared_folder", "written"]

#: Keys are counted in so many buckets.
BUCKETS = 65_536
#: A bucket is dealt in parts if it holds more rows than this and than eight times the mean.
LEAST_HOT = 2_048


def salted_join(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row for each key; hot keys of ``many`` are dealt in parts.

    Both frames are read twice and should be stored. Rows are counted in BUCKETS buckets of keys; the hot ones, at most
    BUCKETS short rows, are sent to every task, and only the rows of ``one`` in hot buckets are repeated.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")
    counts = written(many.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), "buckets")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(LEAST_HOT, 8 * rows // BUCKETS)
    hot = F.broadcast(counts.where(F.col("n") > limit).select("_bucket", F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.select("*", bucket).join(hot, "_bucket", "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), parts).cast("int"))
    right = one.select("*", bucket).join(hot, "_bucket", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_bucket", "_parts").join(right.drop("_bucket", "_parts"), [*keys, "_salt"]).drop("_salt")
