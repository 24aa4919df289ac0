"""Command line: spark-submit or python -m weftline -r reads.fa -m overlaps.paf -o folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.config import AssemblyConfig
from weftline.operators.stitch import fasta_lines
from weftline.plans import assemble
from weftline.report import Report
from weftline.rounds import Rounds, fingerprint
from weftline.session import drop_tables, materialise
from weftline.sources import sinks, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description="Assemble long reads from their overlaps on Spark.")
    p.add_argument("-r", required=True, help="reads, FASTA")
    p.add_argument("-m", required=True, help="overlaps, PAF")
    p.add_argument("-o", default="output.fa", help="folder for the FASTA part files [output.fa]")
    p.add_argument("-p", default="_", help="delimiter in read names [_]")
    p.add_argument("-t", type=int, default=None, help="shuffle partitions [the session's setting]")
    p.add_argument("-HO", type=int, default=80, help="longest overhang of a usable overlap [80]")
    p.add_argument("-c", action="store_true", help="circular genome; accepted, has no effect")
    p.add_argument("-C", action="store_true", help="leave out suspected chimeric reads")
    p.add_argument("-i", type=int, default=3, help="contig rounds end before this number [3]")
    p.add_argument("-sd", type=int, default=1000, help="position tolerance when splitting [1000]")
    p.add_argument("-ms", type=int, default=None, help="largest component; accepted, has no effect")
    p.add_argument("-bw", type=int, default=12000, help="width of a consensus block [12000]")
    p.add_argument("--mode", choices=("intended", "compat"), default="intended", help="see README [intended]")
    p.add_argument("--keep", metavar="FOLDER", default=None, help="shared folder of finished rounds; a run that was ended goes on from there")
    return p


def config_from(args: argparse.Namespace) -> AssemblyConfig:
    return AssemblyConfig(
        mode=args.mode, delimiter=args.p, hanging_out=args.HO, filter_chimeras=args.C,
        rounds=args.i, split_sd=args.sd, block_width=args.bw,
    )


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if args.t:
        spark.conf.set("spark.sql.shuffle.partitions", str(args.t))
    if args.c:
        print("weftline: -c has no effect", file=sys.stderr)
    if args.ms is not None:
        print("weftline: -ms has no effect, components of every size are treated alike", file=sys.stderr)
    config = config_from(args)
    paf = text.read_paf(spark, args.m)
    report = Report()
    rounds = Rounds(spark, args.keep, config, fingerprint(paf)) if args.keep else None
    pieces = assemble.assemble(paf, text.read_fasta(spark, args.r, config.delimiter), config, report, rounds)
    done = report.watch(pieces, output_contigs=F.max("contig_no"), output_bases=F.sum(F.length("seq")))
    sinks.write_fasta(fasta_lines(materialise(done, "pieces")), args.o)
    for name, value in sorted(report.values().items()):
        print(f"{name}\t{value:g}", file=sys.stderr)
    drop_tables(spark)


if __name__ == "__main__":
    main()
