"""Text outputs, written in parallel and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _ordered_text(lines: DataFrame, keys: list[str], column: str, path: str) -> None:
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(column).write.text(path)


def write_fasta(lines: DataFrame, path: str) -> None:
    """lines(contig_no, line_no, text); part files follow contig order."""
    _ordered_text(lines, ["contig_no", "line_no"], "text", path)


def write_layout(lines: DataFrame, path: str) -> None:
    """lines(contig_id, block, rank, line)."""
    _ordered_text(lines, ["contig_id", "block", "rank"], "line", path)
