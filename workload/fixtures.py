"""Deterministic reads and overlaps derived from the `part` table.

Every part is a read with known position and strand, so layouts can be checked in
closed form. See FIXTURES.md for the definitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from typing import Tuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import materialise, spread

NEIGHBOURS = 12
MIN_OVERLAP = 1000


def sim_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    # a file that few tasks read becomes many rows further on, so it is spread first
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey").select(
        k.alias("read_id"),
        (k * 900 + (k * 104729) % 400).alias("g_start"),
        (F.lit(5000) + (k * 7919) % 4000).alias("read_len"),
        F.when((k * 31) % 7 < 3, -1).otherwise(1).alias("strand"),
    ).withColumn("g_end", F.col("g_start") + F.col("read_len"))


def _pairs(reads: DataFrame) -> DataFrame:
    q = reads.select(*[F.col(c).alias("a_" + c) for c in reads.columns]).withColumn(
        "b_read_id", F.explode(F.sequence(F.col("a_read_id") + 1, F.col("a_read_id") + NEIGHBOURS))
    )
    t = reads.select(*[F.col(c).alias("b_" + c) for c in reads.columns])
    lo, hi = F.greatest("a_g_start", "b_g_start"), F.least("a_g_end", "b_g_end")
    return (
        q.join(t, "b_read_id")
        .withColumn("lo", lo).withColumn("hi", hi)
        .filter(F.col("hi") - F.col("lo") >= MIN_OVERLAP)
    )


def paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-way overlaps, lower id as query.

    Written once, like a file of overlaps: otherwise what later steps ask of a row is worked
    out from the two reads, again for every column and inside the join.
    """
    p = _pairs(sim_reads(spark, sf_dir))

    def span(side, left):
        s, e, forward = F.col(side + "_g_start"), F.col(side + "_g_end"), F.col(side + "_strand") == 1
        if left:
            return F.when(forward, F.col("lo") - s).otherwise(e - F.col("hi"))
        return F.when(forward, F.col("hi") - s).otherwise(e - F.col("lo"))

    name = lambda side: F.concat(F.lit("read_"), F.col(side + "_read_id").cast("string"))
    aln = F.col("hi") - F.col("lo")
    rows = p.select(
        (F.col("a_read_id") * 16 + F.col("b_read_id") - F.col("a_read_id")).alias("line_no"),
        name("a").alias("q_name"), F.col("a_read_len").alias("q_len"),
        span("a", True).alias("q_start"), span("a", False).alias("q_end"),
        F.when(F.col("a_strand") == F.col("b_strand"), "+").otherwise("-").alias("strand"),
        name("b").alias("t_name"), F.col("b_read_len").alias("t_len"),
        span("b", True).alias("t_start"), span("b", False).alias("t_end"),
        F.expr("(9 * (hi - lo)) div 10").alias("n_match"), aln.alias("aln_len"),
    )
    return materialise(rows, "paf")


def swapped(rows: DataFrame) -> DataFrame:
    """Query and target exchanged."""
    return rows.select(
        "line_no",
        F.col("t_name").alias("q_name"), F.col("t_len").alias("q_len"),
        F.col("t_start").alias("q_start"), F.col("t_end").alias("q_end"), "strand",
        F.col("q_name").alias("t_name"), F.col("q_len").alias("t_len"),
        F.col("q_start").alias("t_start"), F.col("q_end").alias("t_end"), "n_match", "aln_len",
    )


def paf_dual(rows: DataFrame) -> DataFrame:
    twice = F.col("line_no") * 2
    return rows.withColumn("line_no", twice).unionByName(swapped(rows).withColumn("line_no", twice + 1))


def _ids(rows: DataFrame):
    number = lambda c: F.substring_index(c, "_", -1).cast("long")
    return number("q_name"), number("t_name")


def paf_mixed(rows: DataFrame) -> DataFrame:
    """About 40 % of the rows with query and target exchanged."""
    a, b = _ids(rows)
    turn = (a * 31 + b * 17) % 5 < 2
    return rows.filter(~turn).unionByName(swapped(rows.filter(turn)))


def paf_noisy(rows: DataFrame) -> DataFrame:
    """Overhanging ends and reads covered from one side only."""
    a, b = _ids(rows)
    cut = ((a % 50 == 17) | (b % 50 == 17)) & (F.col("aln_len") >= 2500)
    shift = F.when((a * 7 + b * 13) % 29 == 0, 400).otherwise(0)
    kept = rows.filter(~cut).withColumn("_s", shift)
    return kept.select(
        "line_no", "q_name", "q_len", (F.col("q_start") + F.col("_s")).alias("q_start"),
        (F.col("q_end") - F.col("_s")).alias("q_end"), "strand", "t_name", "t_len",
        (F.col("t_start") + F.col("_s")).alias("t_start"), (F.col("t_end") - F.col("_s")).alias("t_end"),
        "n_match", "aln_len",
    )


def with_self_rows(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds a whole-read self overlap for every tenth read."""
    name = F.concat(F.lit("read_"), F.col("read_id").cast("string"))
    own = reads.filter(F.col("read_id") % 10 == 0).select(
        (F.col("read_id") * 16).alias("line_no"), name.alias("q_name"), F.col("read_len").alias("q_len"),
        F.lit(0).cast("long").alias("q_start"), F.col("read_len").alias("q_end"), F.lit("+").alias("strand"),
        name.alias("t_name"), F.col("read_len").alias("t_len"), F.lit(0).cast("long").alias("t_start"),
        F.col("read_len").alias("t_end"), F.col("read_len").alias("n_match"), F.col("read_len").alias("aln_len"),
    )
    return rows.unionByName(own)


def paf_lines(rows: DataFrame) -> DataFrame:
    """Text lines as a file would hold them."""
    fields = ["q_name", "q_len", "q_start", "q_end", "strand", "t_name", "t_len", "t_start", "t_end", "n_match", "aln_len"]
    return rows.select(
        "line_no",
        F.concat_ws("\t", *[F.col(c).cast("string") for c in fields], F.lit("255"), F.lit("tp:A:S")).alias("value"),
    )


def blasr_lines(rows: DataFrame) -> DataFrame:
    """The same overlaps as BLASR-style text; names use a dot, targets are in the query's frame."""
    a, b = _ids(rows)
    flip = F.col("strand") == "-"
    t_start = F.when(flip, F.col("t_len") - F.col("t_end")).otherwise(F.col("t_start"))
    t_end = F.when(flip, F.col("t_len") - F.col("t_start")).otherwise(F.col("t_end"))
    dotted = lambda i: F.concat(F.lit("read."), i.cast("string"))
    values = [
        dotted(a), dotted(b), F.lit("0"), F.when(flip, "1").otherwise("0"), -F.col("n_match"), F.lit("90.0"),
        t_start, t_end, F.col("t_len"), F.col("q_start"), F.col("q_end"), F.col("q_len"),
    ]
    return rows.select("line_no", F.concat_ws(" ", *[v.cast("string") for v in values]).alias("value"))


def mhap_lines(rows: DataFrame) -> DataFrame:
    """The same overlaps as MHAP text, target on its own strand."""
    a, b = _ids(rows)
    values = [
        a, b, F.lit("0.1"), F.lit("50"), F.lit("0"), F.col("q_start"), F.col("q_end"), F.col("q_len"),
        F.when(F.col("strand") == "-", "1").otherwise("0"), F.col("t_start"), F.col("t_end"), F.col("t_len"),
    ]
    return rows.select("line_no", F.concat_ws(" ", *[v.cast("string") for v in values]).alias("value"))


TILE = 32
_CHUNK = 64        # tiles made and remembered together
_CHUNKS = 4096     # remembered in a task
_ROWS = 1024       # of sequences handed on at once
_NEIGHBOURS_TOGETHER = 256


def genome_slice(start, end):
    """Bases [start, end) of the synthetic genome: md5 text of the tile number, digit by digit."""
    first, last = F.floor(start / TILE), F.floor((end - 1) / TILE)
    tiles = F.transform(
        F.sequence(first, last),
        lambda j: F.translate(F.md5(j.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"),
    )
    return F.concat_ws("", tiles).substr((start - first * TILE + 1).cast("int"), (end - start).cast("int"))


def _tiles(first: int, last: int) -> bytes:
    """Tiles first to last of the genome that `genome_slice` defines."""
    digits = "".join([md5(b"%d" % j).hexdigest() for j in range(first, last + 1)])
    return digits.encode().translate(bytes.maketrans(b"0123456789abcdef", b"ACGTACGTACGTACGT"))


def _sequences(finish):
    """(read_id, g_start, g_end, strand) batches -> (read_id, finish(read_id, bases)); no place, no bases."""
    back = bytes.maketrans(b"ACGT", b"TGCA")

    def run(batches):
        chunk = lru_cache(_CHUNKS)(lambda n: _tiles(n * _CHUNK, (n + 1) * _CHUNK - 1))
        size = _CHUNK * TILE

        def bases(start, end, strand):
            if start is None or end is None:
                return None
            first = start // size
            whole = b"".join([chunk(n) for n in range(first, (end - 1) // size + 1)])[start - first * size:end - first * size]
            return (whole if strand == 1 else whole.translate(back)[::-1]).decode()

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = zip(*[part.column(c).to_pylist() for c in ("read_id", "g_start", "g_end", "strand")])
                made = [finish(r, bases(start, end, strand)) for r, start, end, strand in rows]
                yield pa.RecordBatch.from_arrays([part.column("read_id"), pa.array(made, pa.string())], names=["read_id", "made"])

    return run


def _made(spark: SparkSession, sf_dir: str, finish, name: str) -> DataFrame:
    # making the bases is the costly part; neighbours share most of theirs
    places = sim_reads(spark, sf_dir).select("read_id", "g_start", "g_end", "strand").withColumn("_near", F.floor(F.col("read_id") / _NEIGHBOURS_TOGETHER))
    near = spread(places, "_near").sortWithinPartitions("read_id").drop("_near")
    return near.mapInArrow(_sequences(finish), "read_id long, made string").withColumnRenamed("made", name)


def sim_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, lambda read, bases: bases, "seq")


def true_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known directions as one component."""
    return sim_reads(spark, sf_dir).select(
        F.lit(0).cast("long").alias("component"), "read_id", F.col("strand").alias("dir")
    )


def true_layout(spark: SparkSession, sf_dir: str, bin_size: int = 50, turned: bool = True) -> DataFrame:
    """Reads binned into contigs by id; odd contigs are turned round if wanted."""
    contig = F.floor(F.col("read_id") / bin_size)
    r = sim_reads(spark, sf_dir).withColumn("contig_id", contig)
    # bins hold at most `bin_size` reads, so these per-contig totals stay small
    box = r.groupBy("contig_id").agg(
        F.min("g_start").alias("lo"), F.max("g_end").alias("hi"), F.count("*").alias("n")
    )
    odd = (F.col("contig_id") % 2 == 1) & F.lit(turned)
    placed = r.join(box, "contig_id").select(
        "contig_id", "read_id",
        F.when(odd, F.col("hi") - F.col("g_end")).otherwise(F.col("g_start") - F.col("lo")).alias("start"),
        F.when(odd, -F.col("strand")).otherwise(F.col("strand")).alias("dir"),
        F.col("read_len").alias("len"), "n",
    )
    from weftline.operators.ranks import rank_in_group

    return rank_in_group(placed, "contig_id", ["start", "read_id"])


def whole_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads at their true places as one contig."""
    from weftline.operators.ranks import rank_in_group

    rows = sim_reads(spark, sf_dir).select(
        F.lit(0).cast("long").alias("contig_id"), "read_id", F.col("g_start").alias("start"),
        F.col("strand").alias("dir"), F.col("read_len").alias("len"),
    )
    return rank_in_group(rows, "contig_id", ["start", "read_id"], size="n")


def sequence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA records as the text reader hands them over, wrapped at 80 columns."""
    def record(read, bases):
        if read is None or bases is None:
            return None
        lines = [bases[at:at + 80] for at in range(0, len(bases), 80)]
        return f">read_{read}_x simulated read\n" + "\n".join(lines).lower() + "\n"

    return _made(spark, sf_dir, record, "value").select("value")


# Noisy slices, built of whole tiles so that what they should give stays a closed form

TILES_APART, TILES_WIDE = 75, 94  # of a block
CALM = 200                        # tiles without errors at either end of the genome


def _noisy_pieces(columns: Iterator[Tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """read_id, lo, hi, last_tile -> the piece of tiles lo to hi as the read shows them."""
    chunk = lru_cache(_CHUNKS)(lambda n: _tiles(n * _CHUNK, (n + 1) * _CHUNK - 1).decode())
    turned = [str.maketrans("ACGT", to) for to in ("CGTA", "GTAC", "TACG")]

    @lru_cache(1 << 16)
    def shown(j, wrong, turn, even):
        at = j % _CHUNK * TILE
        tile = chunk(j // _CHUNK)[at:at + TILE]
        if j % 10 == 7:
            return "AC" * ((7 if even else 9) if wrong else 8) + tile[:16]
        if not wrong:
            return tile
        other, kind = tile[15].translate(turned[turn]), j // 5 % 3
        return tile[:15] + ("" if kind == 1 else other) + tile[16:] if kind < 2 else tile[:16] + other + tile[16:]

    def piece(r, lo, hi, end):
        turn, even = (r // 3 % 3 if r >= 0 or r // 3 % 3 == 0 else 2), r % 2 == 0
        return "".join([
            shown(j, True, turn, even) if j % 5 == 2 and (j + r) % 3 == 0 and CALM <= j <= end - CALM else shown(j, False, 0, True)
            for j in range(lo, hi + 1)
        ])

    for given in columns:
        yield pa.array([piece(*row) for row in zip(*[c.to_pylist() for c in given])], pa.string())


def noisy_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig_id, block, rank, read_id, piece): slices of which one in three is wrong at a site.

    Every fifth tile is a site. There a third of the reads have another base, lack one or
    have one more; every tenth tile opens with a tandem repeat of eight copies, of which
    they have seven or nine.
    """
    reads = sim_reads(spark, sf_dir).withColumn("_near", F.floor(F.col("read_id") / _NEIGHBOURS_TOGETHER))
    reads = spread(reads, "_near").sortWithinPartitions("read_id").withColumn("t0", F.ceil(F.col("g_start") / TILE)).withColumn("t1", F.floor(F.col("g_end") / TILE) - 1)
    last = sim_reads(spark, sf_dir).agg((F.floor(F.max("g_end") / TILE) - 1).alias("last_tile"))
    first_block, last_block = F.greatest(F.ceil((F.col("t0") - TILES_WIDE + 1) / TILES_APART), F.lit(0)), F.floor(F.col("t1") / TILES_APART)
    cut = (
        reads.crossJoin(F.broadcast(last))  # one row
        .withColumn("block", F.explode(F.sequence(first_block, last_block)))
        .withColumn("lo", F.greatest("t0", F.col("block") * TILES_APART))
        .withColumn("hi", F.least("t1", F.col("block") * TILES_APART + TILES_WIDE - 1))
    )
    # a column of its own: whoever asks for the keys alone makes no pieces
    piece = F.arrow_udf(_noisy_pieces, T.StringType())("read_id", "lo", "hi", "last_tile").alias("piece")
    return cut.filter("hi >= lo").select(F.lit(0).cast("long").alias("contig_id"), "block", F.col("g_start").alias("rank"), "read_id", piece)
