"""One equation x(target) - x(query) = offset per consistent overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.report import Report, watched


def oriented_overlaps(overlaps: DataFrame, orient: DataFrame) -> DataFrame:
    """Overlaps with the directions of both reads, inside one component."""
    has_visit = "visit" in orient.columns
    visit = F.col("visit") if has_visit else F.lit(None).cast("long")
    side = orient.withColumn("visit", visit)
    a = side.select(F.col("read_id").alias("a"), F.col("component").alias("component"), F.col("dir").alias("da"), F.col("visit").alias("va"))
    b = side.select(F.col("read_id").alias("b"), F.col("component").alias("cb"), F.col("dir").alias("db"), F.col("visit").alias("vb"))
    return overlaps.join(a, "a").join(b, "b").filter("component = cb").drop("cb")


def consistent():
    return (F.col("b_orient") == 0) == (F.col("da") == F.col("db"))


def equations(overlaps: DataFrame, orient: DataFrame, edge_use: str = "both", kind: str = "plain",
              indel_ratio: float = 0.006875, report: Report | None = None) -> DataFrame:
    """(component, i, j, y, scale, line_no) with kind "plain", "weighted" or "indel".

    `edge_use` "visit_order" keeps only overlaps whose query was visited first.
    """
    every = watched(report, oriented_overlaps(overlaps, orient), oriented=F.count(F.lit(1)), inconsistent=F.sum(F.when(consistent(), 0).otherwise(1)))
    rows = every.filter(consistent())
    if edge_use == "visit_order":
        rows = rows.filter("va < vb")
    y = G.read_offset("da", "db")
    if kind == "indel":
        y = G.shrunk_offset(y, indel_ratio)
    scale = F.sqrt("w") if kind == "weighted" else F.lit(1.0)
    return rows.select(
        "component", F.col("a").alias("i"), F.col("b").alias("j"), y.cast("double").alias("y"), scale.alias("scale"), "line_no"
    )


def inconsistent_overlaps(overlaps: DataFrame, orient: DataFrame) -> DataFrame:
    return oriented_overlaps(overlaps, orient).filter(~consistent())
