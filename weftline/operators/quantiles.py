"""Exact interpolated percentiles per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranks import rank_in_group, running
from weftline.session import materialise


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, share, value): linear interpolation between neighbouring order statistics.

    Equal values are counted first, distinct values are numbered by a range sort and
    counts are summed along them, so neither a hot group nor a hot value meets in one task.
    """
    counted = df.groupBy(group, value).agg(F.count("*").alias("_k"))
    ranked = materialise(rank_in_group(counted, group, [value], "_at"), "distinct-values")
    summed = running(ranked, [group], "_at", {"_upto": ("sum", "_k", "up")})
    totals = counted.groupBy(group).agg(F.sum("_k").alias("_n"))
    spot = lambda p: (F.col("_n") - 1) * p
    inside = lambda k: (k >= F.col("_upto") - F.col("_k")) & (k < F.col("_upto"))
    upper = lambda p: F.least(F.floor(spot(p)) + 1, F.col("_n") - 1)
    touched = F.filter(F.array(*[F.lit(s) for s in shares]), lambda p: inside(F.floor(spot(p))) | inside(upper(p)))
    hits = summed.join(totals, group).withColumn("share", F.explode(touched))
    p = F.col("share")
    ends = hits.groupBy(group, "share").agg(
        F.max(F.when(inside(F.floor(spot(p))), F.col(value))).alias("_lo"),
        F.max(F.when(inside(upper(p)), F.col(value))).alias("_hi"),
        F.max("_n").alias("_n"),
    )
    part = spot(p) - F.floor(spot(p))
    return ends.select(group, "share", (F.col("_lo") + part * (F.col("_hi") - F.col("_lo"))).alias(value))
