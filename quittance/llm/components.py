"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay a table throughout; every step is an aggregate with map-side minima and
a join on the same key, written to the shared folder, so neither a hub nor a long
chain is gathered anywhere.  Chains shrink by a constant factor a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import drop, save


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    two = _both(edges)
    least = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return two.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (node, component) for every node that has an edge; component is the smallest node reachable."""
    now = save(edges.filter("u is not null and v is not null and u <> v").distinct(), "edges")
    was = None
    while (mark := _print(now)) != was:
        was, old = mark, now
        now = save(_small_star(_large_star(now)), "edges")
        drop(now.sparkSession, old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
