"""Rasters, points and strokes derived from relational tables by grouping, and their definitions in SQL.

A pixel table has the columns ``image_id STRING, t, z, y, x, c INT, v DOUBLE``; absent pixels are background. The number
of images grows with the tables, by blocks of ``ORDERS`` orders or ``EVENTS`` events, while each image stays as dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = 15_000
EVENTS = 10_000
COORDINATES = ["image_id", "t", "z", "y", "x", "c"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(column):
    return column.cast("int")


def _block(key: str, size: int):
    return F.floor(F.col(key) / size).cast("string")


def px_sales(spark: SparkSession, sf_dir: str, channels: bool = False) -> DataFrame:
    """Quantities sold as images of 48 x 48 pixels, one image for each return flag and block of orders, a frame for each year."""
    c = _int((F.col("l_linenumber") - 1) % 3) if channels else F.lit(0)
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", _block("l_orderkey", ORDERS)).alias("image_id"), _int(F.year("l_shipdate") - 1995).alias("t"), F.lit(0).alias("z"),
        _int(F.col("l_suppkey") % 48).alias("y"), _int(F.col("l_partkey") % 48).alias("x"), c.alias("c"), F.col("l_quantity").alias("v"),
    )
    return rows.groupBy(*COORDINATES).agg(F.sum("v").alias("v"))


def px_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of 8 x 8 pixels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("image_id", F.lit(0).alias("t"), F.lit(0).alias("z"), _int(F.floor(F.col("i") / 8)).alias("y"), _int(F.col("i") % 8).alias("x"), F.lit(0).alias("c"), F.col("v").cast("double").alias("v"))


def px_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as images of 24 x 24 pixels, one for each block of events, a frame for each day."""
    rows = table(spark, sf_dir, "events").select(
        _block("event_id", EVENTS).alias("image_id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t"), F.lit(0).alias("z"),
        F.hour("ts").alias("y"), _int(F.col("user_id") % 24).alias("x"), F.lit(0).alias("c"), F.col("value").alias("v"),
    )
    return rows.groupBy(*COORDINATES).agg(F.sum("v").alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points in space with a size."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("double").alias("x_px"), F.hour("ts").cast("double").alias("y_px"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("double").alias("z_px"), F.col("value").alias("size_px"))


STROKE_VALUES = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 255}


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as brush strokes on images of 32 x 32 pixels, one for each block of events; value 255 erases, 0 changes nothing."""
    value = F.create_map(*(x for k, v in STROKE_VALUES.items() for x in (F.lit(k), F.lit(v))))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), _block("event_id", EVENTS).alias("image_id"), F.lit(0).alias("t"), F.lit(0).alias("z"), _int(F.minute("ts") % 32).alias("y"),
        _int(F.col("user_id") % 32).alias("x"), F.lit(0).alias("c"), F.coalesce(F.try_element_at(value, F.col("event_type")), F.lit(0)).alias("value"),
    )


_SALES = f"select l_returnflag || cast(l_orderkey // {ORDERS} as varchar) as image_id, cast(year(l_shipdate) - 1995 as int) as t, 0 as z, cast(l_suppkey % 48 as int) as y, cast(l_partkey % 48 as int) as x, {{c}} as c, sum(l_quantity) as v from lineitem group by all"
PX_SALES = f"px as ({_SALES.format(c='0')})"
PX_CHANNELS = f"px as ({_SALES.format(c='cast((l_linenumber - 1) % 3 as int)')})"
PX_PATCH = "px as (select cast(vec_id as varchar) as image_id, 0 as t, 0 as z, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x, 0 as c, cast(embedding[i] as double) as v from embeddings, (select unnest(range(1, 65)) as i))"
PX_TIME = f"px as (select cast(event_id // {EVENTS} as varchar) as image_id, cast(datediff('day', date '2024-01-01', cast(ts as date)) as int) as t, 0 as z, cast(hour(ts) as int) as y, cast(user_id % 24 as int) as x, 0 as c, sum(value) as v from events group by all)"
POINTS = "points as (select cast(user_id as double) as x_px, cast(hour(ts) as double) as y_px, cast(datediff('day', date '2024-01-01', cast(ts as date)) as double) as z_px, value as size_px from events)"
STROKES = f"strokes as (select event_id as seq, cast(event_id // {EVENTS} as varchar) as image_id, 0 as t, 0 as z, cast(minute(ts) % 32 as int) as y, cast(user_id % 32 as int) as x, 0 as c, " + "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in STROKE_VALUES.items()) + " else 0 end as value from events)"
