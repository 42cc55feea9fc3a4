"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.plans.stored import written

#: Ids of a group that are numbered in one task.
NUMBERED_AT_ONCE = 65_536


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(src, dst)`` as rows ``(node, component)``; component is the smallest node.

    Rounds of large-star and small-star contraction; each round is written to the shared folder. Minima are combined
    before they are shuffled, and the joins are plain equi-joins, so that a hub with very many edges is split by
    adaptive execution. Loops and null ends are ignored, repeated edges count once, no edges give no rows. A graph that
    has not settled after ``max_rounds`` raises an error instead of returning a wrong answer.
    """
    now = written(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges",
    )
    before = _signature(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "edges")
        after = _signature(now)
        if after == before:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return leaves.unionByName(roots)
        before = after
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest node among u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return edges.join(low, "u").select(tied.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def numbered(rows: DataFrame, keys: list[str], order: str, chunk: Column, start: int = 1) -> DataFrame:
    """Adds ``number``: the place of each row among those of its ``keys`` in ascending ``order``, counted from ``start``.

    ``chunk`` must not fall as ``order`` rises. Rows are counted within chunks, and chunks by the sums of those before, so
    that no task meets more than a chunk of one group.
    """
    rows = rows.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    placed = rows.withColumn("_within", within).join(ahead, [*keys, "_chunk"])
    return placed.withColumn("number", (F.col("_within") + F.col("_ahead") + (start - 1)).cast("long")).drop("_chunk", "_within", "_ahead")
