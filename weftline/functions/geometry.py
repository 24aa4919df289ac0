"""Column expressions on overlap coordinates.

An overlap row carries `a, b, a_start, a_end, a_len, b_orient, b_start, b_end, b_len, w`
with the target already expressed in the frame the query sees it in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORWARD, REVERSE = 1, -1


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def read_id(name, delimiter: str) -> Column:
    """Second token of a read name."""
    return F.element_at(F.split(col(name), "\\Q" + delimiter + "\\E"), 2)


def orientation_code(strand) -> Column:
    return F.when(col(strand) == "+", 0).otherwise(1)


def overlap_weight(n_match) -> Column:
    return F.round(F.sqrt(col(n_match))).cast("long")


def signed_weight(b_orient="b_orient", w="w") -> Column:
    return F.when(col(b_orient) == 0, col(w)).otherwise(-col(w))


def dangling_length() -> Column:
    """Longest unaligned overhang that a true end-to-end overlap would not have."""
    head = F.least("a_start", "b_start")
    tail = F.least(F.col("a_len") - F.col("a_end"), F.col("b_len") - F.col("b_end"))
    return F.greatest(head, tail)


def read_offset(da, db, prefix: str = "") -> Column:
    """5' position of the target minus that of the query; NULL when directions disagree."""
    da, db = col(da), col(db)
    c = lambda n: F.col(prefix + n)
    same = (c("b_orient") == 0) & (da == db)
    opposite = (c("b_orient") == 1) & (da == -db)
    return F.when(same, da * (c("a_start") - c("b_start"))).when(
        opposite, da * (c("a_end") + c("b_len") - c("b_end"))
    )


def start_offset(da, db, prefix: str = "") -> Column:
    """Leftmost position of the target minus that of the query."""
    da, db = col(da), col(db)
    return (
        read_offset(da, db, prefix)
        + F.when(da == REVERSE, F.col(prefix + "a_len")).otherwise(0)
        - F.when(db == REVERSE, F.col(prefix + "b_len")).otherwise(0)
    )


def contig_offset(da, db, flip, pos_a, pos_b, len_a, len_b, compat: bool = False) -> Column:
    """Origin of the target's contig minus that of the query's contig.

    `flip` is +1 when both contigs run the same way and -1 otherwise; `da`, `db` are the
    read directions inside their own contigs. In compat mode the reversed query of a
    flipped pair enters with the opposite sign.
    """
    da, db, flip, pos_a, pos_b = map(col, (da, db, flip, pos_a, pos_b))
    step = read_offset(da, db * flip)
    if compat:
        step = F.when((flip == -1) & (da == REVERSE), -step).otherwise(step)
    left = pos_a + F.when(da == REVERSE, col(len_a)).otherwise(0)
    right = pos_b + F.when(db == REVERSE, col(len_b)).otherwise(0)
    return step + left - flip * right


def shrunk_offset(y, ratio: float = 0.006875) -> Column:
    """Offset corrected for the insertion surplus, truncated toward zero."""
    return (col(y) * F.lit(1.0 - ratio)).cast("long")


def huber_weight(residual, threshold: float) -> Column:
    r = F.abs(col(residual))
    return F.when(r <= threshold, F.lit(1.0)).otherwise(F.lit(threshold) / r)


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))
