"""Dense numbering and running values without funnelling a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialise

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Add a dense 0-based `name` following `keys`, which should be unique together.

    One range shuffle and a sort inside each partition; partition offsets come from
    one count per partition, a table bounded by the number of shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ranked",
    )
    slot = F.shiftright("_mid", _LOCAL_BITS)
    # at most one row per shuffle partition, so the offsets are safe on the driver
    counts = sorted(placed.groupBy(slot.alias("slot")).count().collect())
    rows, before = [], 0
    for slot_no, count in counts:
        rows.append((slot_no, before))
        before += count
    offsets = df.sparkSession.createDataFrame(rows, "_slot long, _before long")
    local = F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return (
        placed.withColumn("_slot", slot)
        .join(F.broadcast(offsets), "_slot")
        .withColumn(name, F.col("_before") + local)
        .drop("_slot", "_mid", "_before")
    )


def rank_in_group(df: DataFrame, group: str, keys: list[str], name: str = "rank", size: str | None = None) -> DataFrame:
    """0-based position inside `group` along `keys`, optionally with the group's size."""
    ranked = global_rank(df, [group, *keys], "_rank")
    first = ranked.groupBy(group).agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    out = ranked.join(first, group).withColumn(name, F.col("_rank") - F.col("_first"))
    if size:
        out = out.withColumn(size, F.col("_n"))
    return out.drop("_rank", "_first", "_n")


def running(df: DataFrame, group: list[str], index: str, values: dict, chunk: int = 4096) -> DataFrame:
    """Inclusive running aggregates along a dense integer `index`, in two levels.

    `values` maps a new column to (kind, column, direction) with kind "sum", "min" or
    "max" and direction "up" or "down". Rows are scanned in chunks of the index, chunk
    totals are scanned once, and both are combined, so no window sees a whole group.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    chunked = df.withColumn("_chunk", F.floor(F.col(index) / chunk))
    inner = Window.partitionBy(*group, "_chunk")
    outer = Window.partitionBy(*group)
    local, totals, carried = {}, [], []
    for name, (kind, source, direction) in values.items():
        order = F.col(index) if direction == "up" else F.col(index).desc()
        local["_l_" + name] = kinds[kind](source).over(
            inner.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        )
        totals.append(kinds[kind](source).alias("_t_" + name))
        chunk_order = F.col("_chunk") if direction == "up" else F.col("_chunk").desc()
        carried.append(
            kinds[kind]("_t_" + name)
            .over(outer.orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1))
            .alias("_c_" + name)
        )
    sums = chunked.groupBy(*group, "_chunk").agg(*totals)
    carry = sums.select(*group, "_chunk", *carried)
    out = chunked.withColumns(local).join(carry, [*group, "_chunk"])
    joined = {}
    for name, (kind, _, _) in values.items():
        here, above = F.col("_l_" + name), F.col("_c_" + name)
        if kind == "sum":
            joined[name] = here + F.coalesce(above, F.lit(0))
        else:
            joined[name] = (F.least if kind == "min" else F.greatest)(here, above)
    out = out.withColumns(joined)
    return out.drop("_chunk", *local, *["_c_" + n for n in values])
