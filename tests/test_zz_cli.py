"""The command line end to end on files."""

import glob

from weftline import __main__ as cli
from workload import fixtures as fx
from weftline.functions.sequences import wrapped
from pyspark.sql import functions as F


def test_defaults():
    config = cli.config_from(cli.parser().parse_args(["-r", "a", "-m", "b"]))
    assert (config.hanging_out, config.rounds, config.split_sd, config.block_width) == (80, 3, 1000, 12000)
    assert not config.filter_chimeras and config.delimiter == "_"


def test_files_to_contigs(spark, sf, clean, tmp_path, capsys):
    paf = fx.paf_lines(clean).filter("line_no < 640").orderBy("line_no").select("value").collect()
    (tmp_path / "in.paf").write_text("".join(r.value + "\n" for r in paf))
    reads = fx.sim_sequences(spark, sf).filter("read_id < 60").select(
        F.concat(F.lit(">read_"), F.col("read_id").cast("string"), F.lit("\n"), wrapped("seq", 70)).alias("r")
    ).collect()
    (tmp_path / "in.fa").write_text("".join(r.r + "\n" for r in reads))
    out = str(tmp_path / "contigs")
    cli.main(["-r", str(tmp_path / "in.fa"), "-m", str(tmp_path / "in.paf"), "-o", out, "-bw", "3000", "-C", "-i", "2"])
    text = "".join(open(f).read() for f in sorted(glob.glob(out + "/part*"))).split("\n")
    seq = "".join(text[1:])
    assert text[0] == ">contig1" and not any(line.startswith(">") for line in text[1:])
    genome = spark.range(1).select(fx.genome_slice(F.lit(0), F.lit(70000)).alias("g")).first().g
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert len(seq) > 30000 and (seq in genome or back in genome)
    assert "contigs\t1" in capsys.readouterr().err
