"""From parsed records to normalised overlaps, edges, links and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.report import Report, watched


def with_ids(paf: DataFrame, delimiter: str = "_") -> DataFrame:
    return paf.withColumn("a", G.read_id("q_name", delimiter).cast("long")).withColumn(
        "b", G.read_id("t_name", delimiter).cast("long")
    )


def normalise(paf: DataFrame, delimiter: str = "_") -> DataFrame:
    """Ids, orientation code, weight, and target coordinates in the query's frame."""
    rows = with_ids(paf, delimiter).withColumn("b_orient", G.orientation_code("strand"))
    flipped = F.col("b_orient") == 1
    return rows.select(
        "line_no", "a", "b",
        F.col("q_start").alias("a_start"), F.col("q_end").alias("a_end"), F.col("q_len").alias("a_len"),
        "b_orient",
        F.when(flipped, F.col("t_len") - F.col("t_end")).otherwise(F.col("t_start")).alias("b_start"),
        F.when(flipped, F.col("t_len") - F.col("t_start")).otherwise(F.col("t_end")).alias("b_end"),
        F.col("t_len").alias("b_len"),
        G.overlap_weight("n_match").alias("w"),
    )


def drop_self(overlaps: DataFrame) -> DataFrame:
    return overlaps.filter(F.col("a") != F.col("b"))


def drop_dangling(overlaps: DataFrame, hanging_out: int) -> DataFrame:
    return overlaps.filter(G.dangling_length() < hanging_out)


def drop_reads(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps touching none of `reads(read_id)`; the join strategy follows its size."""
    hit = reads.select("read_id")
    return overlaps.join(hit.withColumnRenamed("read_id", "a"), "a", "left_anti").join(
        hit.withColumnRenamed("read_id", "b"), "b", "left_anti"
    )


def filter_counts(hanging_out: int) -> dict:
    """What the filters of `usable` keep and drop, as aggregates over normalised overlaps."""
    own = F.col("a") == F.col("b")
    dangling = ~own & (G.dangling_length() >= hanging_out)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return {"records": F.count(F.lit(1)), "self": count(own), "dangling": count(dangling), "usable": count(~own & ~dangling)}


def usable(paf: DataFrame, hanging_out: int, delimiter: str = "_", excluded: DataFrame | None = None, report: Report | None = None) -> DataFrame:
    """The overlaps that enter the graph."""
    every = watched(report, normalise(paf, delimiter), **filter_counts(hanging_out))
    rows = drop_dangling(drop_self(every), hanging_out)
    return rows if excluded is None else drop_reads(rows, excluded)


def read_lengths(paf: DataFrame, delimiter: str = "_", keep_self: bool = True) -> DataFrame:
    """Length per read; the last line that mentions a read wins, target after query."""
    rows = with_ids(paf, delimiter)
    if not keep_self:
        rows = drop_self(rows)
    sides = F.array(
        F.struct(F.col("a").alias("read_id"), F.col("q_len").alias("len"), F.lit(0).alias("side")),
        F.struct(F.col("b").alias("read_id"), F.col("t_len").alias("len"), F.lit(1).alias("side")),
    )
    return (
        rows.select("line_no", F.explode(sides).alias("s"))
        .groupBy(F.col("s.read_id").alias("read_id"))
        .agg(F.max_by("s.len", F.struct("line_no", "s.side")).alias("len"))
    )


def pair_columns() -> list:
    return [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]


def orientation_edges(overlaps: DataFrame) -> DataFrame:
    """One edge per unordered pair; the last record's signed weight wins."""
    return (
        overlaps.withColumn("sw", G.signed_weight())
        .groupBy(*pair_columns())
        .agg(F.max_by("sw", "line_no").alias("sw"), F.min("line_no").alias("first_line"))
    )


def orientation_votes(overlaps: DataFrame) -> DataFrame:
    """Support for either relative direction of each unordered pair."""
    return vote_sums(overlaps.withColumn("sw", G.signed_weight()).select(*pair_columns(), "sw"), ["u", "v"])


def vote_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pos/neg/strength/sign from signed weights `sw` per key."""
    s, d = F.sum(F.abs("sw")), F.sum("sw")
    sums = rows.groupBy(*keys).agg(d.alias("d"), s.alias("s"), F.count("*").alias("n"))
    pos, neg = (F.col("s") + F.col("d")) / 2, (F.col("s") - F.col("d")) / 2
    return sums.select(
        *keys, "n",
        pos.cast("long").alias("pos"), neg.cast("long").alias("neg"),
        F.greatest(pos, neg).cast("long").alias("strength"),
        F.signum("d").cast("int").alias("sgn"),
    )


def first_links(overlaps: DataFrame) -> DataFrame:
    """First signed weight per unordered pair and first line in either listing order."""
    forward = F.col("a") < F.col("b")
    return (
        overlaps.withColumn("sw", G.signed_weight())
        .groupBy(*pair_columns())
        .agg(
            F.min_by("sw", "line_no").alias("sw"),
            F.min(F.when(forward, F.col("line_no"))).alias("uv_line"),
            F.min(F.when(~forward, F.col("line_no"))).alias("vu_line"),
            F.count("*").alias("n"),
        )
    )


def overlaps_per_pair(overlaps: DataFrame) -> DataFrame:
    """Count and line span per ordered pair (the directed multimap, summarised)."""
    return overlaps.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )
