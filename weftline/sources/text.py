"""Readers for overlap and read files.

All parsing is built-in string functions over `spark.read.text`, so files are split,
pruned and scanned like any other source. `line_no` only has to follow file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.geometry import read_id

# Positions of the fields in each whitespace-separated format.
PAF_FIELDS = [
    ("q_name", "string"), ("q_len", "long"), ("q_start", "long"), ("q_end", "long"),
    ("strand", "string"), ("t_name", "string"), ("t_len", "long"), ("t_start", "long"),
    ("t_end", "long"), ("n_match", "long"), ("aln_len", "long"),
]
BLASR_FIELDS = [
    ("a_name", "string"), ("b_name", "string"), ("a_orient", "int"), ("b_orient", "int"),
    ("score", "long"), (None, None), ("b_start", "long"), ("b_end", "long"), ("b_len", "long"),
    ("a_start", "long"), ("a_end", "long"), ("a_len", "long"),
]
MHAP_FIELDS = [
    ("a_name", "string"), ("b_name", "string"), (None, None), (None, None),
    ("a_orient", "int"), ("a_start", "long"), ("a_end", "long"), ("a_len", "long"),
    ("b_orient", "int"), ("b_start", "long"), ("b_end", "long"), ("b_len", "long"),
]


def fields_of(lines: DataFrame, layout, keep=("line_no",)) -> DataFrame:
    """Split the `value` column into typed fields; further fields are ignored."""
    bare = F.trim("value", F.lit(" \t\r"))
    # the limit leaves trailing tags, which can be long, unsplit
    row = lines.filter(bare != "").withColumn("_f", F.split(bare, "\\s+", len(layout) + 1))
    columns = [
        F.get("_f", F.lit(i)).cast(kind).alias(name)
        for i, (name, kind) in enumerate(layout)
        if name is not None
    ]
    return row.select(*keep, *columns)


_FILE_BITS, _ROW_BITS = 43, 33  # bytes of a file; rows of a partition in monotonically_increasing_id


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a number that increases in file order, without a shuffle.

    The number is the file's place among the sorted names, the byte at which the line's
    split begins and its row number in the task. A split with another one after it fills a
    task alone, and a line has a byte at least, so numbers of a split end before the next.
    """
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    if len(files) <= 1:
        return lines.select(F.monotonically_increasing_id().alias("line_no"), "value")
    places = spark.createDataFrame(list(enumerate(files)), "_place long, _file string")  # the list the driver has read
    located = lines.select(
        "value", F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"),
    )
    number = F.shiftleft("_place", _FILE_BITS) + F.col("_start") + F.col("_row")
    return located.join(F.broadcast(places), "_file").select(number.alias("line_no"), "value")


def parse_paf(lines: DataFrame) -> DataFrame:
    return fields_of(lines, PAF_FIELDS)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse_paf(numbered_lines(spark, path))


def parse_blasr(lines: DataFrame) -> DataFrame:
    """BLASR-style records; ids are the second token split at a dot."""
    rows = fields_of(lines, BLASR_FIELDS)
    return rows.withColumn("a", read_id("a_name", ".")).withColumn("b", read_id("b_name", "."))


def read_blasr(spark: SparkSession, path: str) -> DataFrame:
    return parse_blasr(numbered_lines(spark, path))


def parse_mhap(lines: DataFrame) -> DataFrame:
    """MHAP records; names are ids, a reversed target is flipped to the query's frame."""
    rows = fields_of(lines, MHAP_FIELDS)
    flipped = F.col("b_orient") == 1
    return rows.select(
        "line_no", F.col("a_name").alias("a"), F.col("b_name").alias("b"),
        "a_orient", "a_start", "a_end", "a_len", "b_orient",
        F.when(flipped, F.col("b_len") - F.col("b_end")).otherwise(F.col("b_start")).alias("b_start"),
        F.when(flipped, F.col("b_len") - F.col("b_start")).otherwise(F.col("b_end")).alias("b_end"),
        "b_len",
    )


def read_mhap(spark: SparkSession, path: str) -> DataFrame:
    return parse_mhap(numbered_lines(spark, path))


def parse_fasta(records: DataFrame, delimiter: str = "_") -> DataFrame:
    """Records as split at "\\n>" -> (read_id, seq); header ends at the first newline."""
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    header = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, text.substr(F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    name = F.substring_index(F.substring_index(header, " ", 1), "\t", 1)
    return (
        records.filter(F.trim("value") != "")
        .select(
            read_id(name, delimiter).cast("long").alias("read_id"),
            F.upper(F.regexp_replace(body, "\\s", "")).alias("seq"),
        )
    )


def read_fasta(spark: SparkSession, path: str, delimiter: str = "_") -> DataFrame:
    return parse_fasta(spark.read.text(path, lineSep="\n>"), delimiter)
