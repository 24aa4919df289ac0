"""Assembly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranks import global_rank, running


def assembly_stats(lengths: DataFrame, reference_length: int | None = None) -> DataFrame:
    """lengths(contig_no, length) -> one row of counts, N50, L50, N90, L90 and auN.

    With a reference length the thresholds become those of NG50 and NG90.
    """
    ranked = global_rank(lengths.withColumn("_minus", -F.col("length")), ["_minus", "contig_no"], "place").withColumn("all", F.lit(0))
    summed = running(ranked, ["all"], "place", {"upto": ("sum", "length", "up")})
    goal = F.lit(reference_length or lengths.agg(F.sum("length")).first()[0]).cast("long")  # small totals would be 32-bit literals
    reach = lambda share: F.when(F.col("upto") * 100 >= goal * share, F.struct(F.col("place"), F.col("length")))
    at = lambda share: F.min(reach(share))
    return summed.agg(
        F.count("*").alias("n_contigs"), F.sum("length").cast("long").alias("total_length"), F.max("length").alias("largest"),
        at(50).alias("a50"), at(90).alias("a90"),
        F.floor(F.sum(F.col("length").cast("double") * F.col("length")) / F.sum("length")).cast("long").alias("aun"),
    ).select(
        "n_contigs", "total_length", "largest", F.col("a50.length").alias("n50"), (F.col("a50.place") + 1).alias("l50"),
        F.col("a90.length").alias("n90"), (F.col("a90.place") + 1).alias("l90"), "aun",
    )
