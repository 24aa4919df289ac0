"""Contiguous byte-balanced shards from global prefix sums, in DataFrame functions only.

Rows are put in one global order by a range sort. Each partition's bytes and rows are
totalled, a running sum over that small table gives what lies before each partition, and
a running sum inside partitions gives what lies before each row. Shards are cut at equal
targets of the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialise

OVERHEAD = 16
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition there


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """rows with `before` (sum of sizes ahead of the row), `rank` (rows ahead) and `total`.

    The order is made strict by the row's place in the input, which only decides between
    rows equal in all of `order`. Those differ in nothing that is numbered, if `order`
    names all columns. Names of added columns must be free.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_ = materialise(
        tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
        .withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", _ROW_BITS)),
        "sorted",
    )
    totals = sorted_.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_b"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_r"),
        F.sum("_bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = sorted_.withColumn("_run", F.sum(size).over(inside))
    placed = local.join(F.broadcast(offsets), "_part")  # one row per partition
    return placed.withColumns({
        "before": F.col("_b") + F.col("_run") - F.col(size),
        "rank": F.col("_r") + F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1),
    }).drop("_part", "_mid", "_run", "_b", "_r")


def balanced_shards(rows: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in the shard).

    A row goes where the middle of its bytes falls, so a shard misses its target by half a
    row at each end at most and shards are contiguous in `order`.
    """
    placed = prefix_sums(rows, order, size)
    cut = F.expr(f"(2 * before + `{size}`) * {shards} div (2 * greatest(total, 1))")  # whole numbers
    placed = placed.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("rank") - F.col("_start")).drop("_start", "before", "rank", "total")


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Order: key (null first), checksum, size. A null text counts as empty: OVERHEAD bytes,
    checksum 0. Rows that repeat key and text take neighbouring slots in any order. Extra
    columns are ignored.
    """
    text_col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = materialise(docs.select(F.col(key).alias("doc_id"), (F.octet_length(text_col) + F.lit(OVERHEAD).cast("long")).alias("size"), F.crc32(text_col).alias("text_crc32")), "sizes")
    out = balanced_shards(slim, ["doc_id", "text_crc32", "size"], "size", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
