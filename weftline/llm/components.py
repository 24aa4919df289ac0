"""Connected components by alternating star steps, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node with smaller neighbours joins them to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    best = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(best, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(best.select("u", F.col("m").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to the smallest among itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    best = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(best, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges(u, v) of long ids -> (node, component): the smallest node that links reach.

    Null ends and loops are left out; a node without edges has no row. Each round writes
    its edges to the shared folder; the number of edges never grows, and rounds end when
    every edge leads from a node to the smallest of its component. The test for that end
    is whether the sum over hashed edges stays the same.
    """
    def tidy(some):
        return some.filter("u <> v").select("u", "v").distinct()

    def mark(some):
        row = some.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = materialise(tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), name)
    before = mark(now)
    while before[0]:
        now = materialise(tidy(_small_star(_large_star(now))), name)
        after = mark(now)
        if after == before:
            break
        before = after
    ends = now.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
