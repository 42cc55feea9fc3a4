"""Written tables and what the planner makes of them."""

from pyspark.sql import functions as F

from voxelry.plans import queries as plans
from voxelry.plans.stored import written


def test_packed_tables_are_not_taken_for_small(spark, small):
    plans.queries()["g01_subregion"](spark, small)
    place = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)).cast("int")
    pixels = written(spark.range(500_000, numPartitions=1).select(F.lit("a").alias("image_id"), place(1).alias("y"), place(2).alias("x")), "packed")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        joined = pixels.join(pixels.withColumn("z", F.lit(1)), ["image_id", "y", "x"])
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
