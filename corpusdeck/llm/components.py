"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_path, stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each node. The grouping column _spread keeps the aggregate's partitioning
    apart from the joins', so these have exchanges of their own and adaptive execution can split a hub's edges."""
    return edges.groupBy("u", F.pmod("u", F.lit(1024)).alias("_spread")).agg(F.min("v").alias("m")).select("u", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node it can reach.

    Each round is two equi-joins with a map-side combined minimum, whose hub side adaptive execution can
    split, and ends in a table of the shared folder: lost executors cost one round. The rounds stop when
    neither the number of edges nor the sum of their hashes changes. Self-loops and nulls are ignored; no
    edges give no rows.
    """
    spark, edge = edges.sparkSession, (F.col(a).cast("long"), F.col(b).cast("long"))
    start = edges.where(edge[0].isNotNull() & edge[1].isNotNull() & (edge[0] != edge[1]))
    path = shared_path(spark, "edges")
    now = stored(start.select(F.greatest(*edge).alias("u"), F.least(*edge).alias("v")).distinct(), path)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            break
        seen, last, path = (mark["n"], mark["h"]), path, shared_path(spark, "edges")
        now = stored(_small_star(_large_star(now)), path)
        remove(spark, last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
