"""Chimera detection from how far overlaps reach in from either end of a read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.overlaps import with_ids


def _ends(rows: DataFrame, plus, minus_heads, minus_tails, from_b_heads, from_b_tails, hanging_out: int) -> DataFrame:
    """One row per read: last length and longest reach inward from either end.

    The first matching of four end-to-end configurations decides what a record says
    about its two reads. Lengths and reaches share one pass and one shuffle.
    """
    a_head, a_tail = F.col("a_start") < hanging_out, F.col("a_len") - F.col("a_end") < hanging_out
    b_head, b_tail = F.col("b_start") < hanging_out, F.col("b_len") - F.col("b_end") < hanging_out
    from_a_tail, from_b_tail = F.col("a_len") - F.col("a_start"), F.col("b_len") - F.col("b_start")
    case = (
        F.when(plus & b_tail & a_head, 1).when(plus & a_tail & b_head, 2)
        .when(~plus & minus_heads(a_head, b_head, b_tail), 3).when(~plus & minus_tails(a_tail, b_head, b_tail), 4)
    )
    is_case = lambda *n: F.col("case").isin(*n)
    side = lambda read, turn, front, back: F.struct(
        F.col(read).alias("read_id"), F.col(read + "_len").alias("len"), (F.col("line_no") * 2 + turn).alias("seen"),
        front.alias("front"), back.alias("back"),
    )
    a = side("a", 0, F.when(is_case(1, 3), F.col("a_end")), F.when(is_case(2, 4), from_a_tail))
    b = side(
        "b", 1, F.when(is_case(2), F.col("b_end")).when(is_case(3), from_b_heads),
        F.when(is_case(1), from_b_tail).when(is_case(4), from_b_tails),
    )
    return (
        rows.filter("a <> b").withColumn("case", case).select(F.explode(F.array(a, b)).alias("s"))
        .groupBy(F.col("s.read_id").alias("read_id"))
        .agg(F.max_by("s.len", "s.seen").alias("len"), F.max("s.front").alias("front"), F.max("s.back").alias("back"))
    )


def paf_ends(paf: DataFrame, hanging_out: int = 150, delimiter: str = "_") -> DataFrame:
    """(read_id, len, front, back) from original strand coordinates."""
    rows = with_ids(paf, delimiter).select(
        "line_no", "a", "b", "strand",
        F.col("q_start").alias("a_start"), F.col("q_end").alias("a_end"), F.col("q_len").alias("a_len"),
        F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"), F.col("t_len").alias("b_len"),
    )
    return _ends(
        rows, F.col("strand") == "+",
        lambda a_head, b_head, b_tail: b_head & a_head, lambda a_tail, b_head, b_tail: a_tail & b_tail,
        F.col("b_end"), F.col("b_len") - F.col("b_start"), hanging_out,
    )


def framed_ends(rows: DataFrame, hanging_out: int = 50) -> DataFrame:
    """The same for formats whose target coordinates are in the query's frame."""
    return _ends(
        rows, F.col("b_orient") == 0,
        lambda a_head, b_head, b_tail: b_tail & a_head, lambda a_tail, b_head, b_tail: a_tail & b_head,
        F.col("b_len") - F.col("b_start"), F.col("b_end"), hanging_out,
    )


def low_coverage(ends: DataFrame, slack: int = 300) -> DataFrame:
    """Reads whose two reaches together do not cover the read."""
    covered = F.coalesce("front", F.lit(0)) + F.coalesce("back", F.lit(0))
    return ends.select("read_id", "len", covered.alias("covered")).filter(F.col("covered") < F.col("len") + slack)


def paf_candidates(paf: DataFrame, hanging_out: int = 150, delimiter: str = "_", slack: int = 300) -> DataFrame:
    return low_coverage(paf_ends(paf, hanging_out, delimiter), slack)


def numbered_candidates(rows: DataFrame, n_reads: int, hanging_out: int = 50, slack: int = 0) -> DataFrame:
    """Candidates among ids 1..n; a read lacking either side is one too."""
    ids = rows.sparkSession.range(1, n_reads + 1).select(F.col("id").cast("string").alias("read_id"))
    covered = F.col("front") + F.col("back")
    return (
        ids.join(framed_ends(rows, hanging_out), "read_id", "left")
        .filter(covered.isNull() | (covered < F.col("len") + slack))
        .select(F.col("read_id").cast("long").alias("read_id"))
    )


def low_quality_counts(paf: DataFrame, delimiter: str = "_", min_bases: int = 300, min_ratio: float = 0.6) -> DataFrame:
    """Short or fragmentary records per read, self overlaps included."""
    poor = (F.col("n_match") < min_bases) | (F.col("n_match") / F.col("aln_len") < min_ratio)
    return (
        with_ids(paf, delimiter).filter(poor)
        .select(F.explode(F.array("a", "b")).alias("read_id"))
        .groupBy("read_id").agg(F.count("*").alias("n_low"))
    )
