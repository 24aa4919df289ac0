"""Text sources and sinks on real files."""

import glob
import random

from pyspark.sql import functions as F

from tests.conftest import whole_sequences
from workload import fixtures
from weftline.functions import geometry as G
from weftline.functions import sequences as S
from weftline.operators import stitch
from weftline.sources import sinks, text


def _write(path, content):
    path.write_text(content)
    return str(path)


def test_paf_file_keeps_order_and_ignores_tags(spark, tmp_path):
    line = "read_{i}_x\t100\t0\t90\t-\tread_{j}\t200\t5\t95\t81\t90\t255\ttp:A:S\tcm:i:9\n"
    path = _write(tmp_path / "a.paf", "".join(line.format(i=i, j=i + 1) for i in range(50)) + "\n")
    rows = text.read_paf(spark, path).orderBy("line_no").collect()
    assert [r.q_name for r in rows] == [f"read_{i}_x" for i in range(50)]
    assert rows[3].t_end == 95 and rows[3].n_match == 81 and rows[3].strand == "-"


def test_several_files_follow_their_names(spark, tmp_path):
    for k in range(3):
        _write(tmp_path / f"{k}.paf", "".join(f"r_{k * 10 + i} 9 0 9 + r_1 9 0 9 9 9\n" for i in range(10 - k)))
    rows = text.read_paf(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.q_name for r in rows] == [f"r_{k * 10 + i}" for k in range(3) for i in range(10 - k)]
    assert len({r.line_no for r in rows}) == 27  # the number only follows the files


def test_fasta_file(spark, tmp_path):
    path = _write(tmp_path / "a.fa", ">run.007 first one\nacgt\nNNac\n>run.12\r\nTTTT\r\n>run.13\n")
    rows = {r.read_id: r.seq for r in text.read_fasta(spark, path, ".").collect()}
    assert rows == {7: "ACGTNNAC", 12: "TTTT", 13: ""}


def test_delimiter_is_literal(spark):
    rows = spark.createDataFrame([("a.5.x",)], "n string").select(G.read_id("n", ".").alias("i")).collect()
    assert rows[0].i == "5"


def test_reverse_complement_twice_is_identity(spark):
    rows = spark.createDataFrame([("ACGTRYMKSWBDVHN",), ("",), ("U",)], "s string")
    out = rows.select("s", S.reverse_complement("s").alias("r"), S.reverse_complement(S.reverse_complement("s")).alias("rr")).collect()
    assert out[0].rr == out[0].s and out[1].r == "" and out[2].r == "A"


def test_fasta_sink_wraps_across_pieces(spark, tmp_path):
    seq = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(1234))
    cuts = [0, 30, 100, 101, 450, 1199, 1234]
    rows = [(2, a, k, seq[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(1, 0, 0, seq[:200])]
    pieces = spark.createDataFrame(rows, "contig_no long, offset long, block long, seq string")
    sinks.write_fasta(stitch.fasta_lines(pieces), str(tmp_path / "out"))
    got = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "out" / "part*"))))
    want = "".join(f">contig{n}\n" + "".join(s[i:i + 100] + "\n" for i in range(0, len(s), 100)) for n, s in ((1, seq[:200]), (2, seq)))
    assert got == want


def test_whole_sequences(spark):
    pieces = spark.createDataFrame([(1, 3, 1, "TT"), (1, 0, 0, "ACG")], "contig_no long, offset long, block long, seq string")
    assert whole_sequences(pieces, ["contig_no"]).first().seq == "ACGTT"


def test_offset_is_antisymmetric(spark, sf):
    """Exchanging query and target negates the offset."""
    from weftline.operators import equations, overlaps

    rows = fixtures.paf(spark, sf)
    facing = fixtures.true_orientation(spark, sf)

    def steps(paf, a, b):
        used = equations.oriented_overlaps(overlaps.usable(paf, 80), facing)
        return used.select("line_no", G.read_offset("da", "db").alias(a), G.start_offset("da", "db").alias(b))

    both = steps(rows, "x", "y").join(steps(fixtures.swapped(rows), "p", "q"), "line_no")
    assert both.filter((F.col("x") != -F.col("p")) | (F.col("y") != -F.col("q"))).count() == 0
    assert both.count() == rows.count()


def test_lines_of_many_files_are_numbered_without_a_shuffle(spark, tmp_path):
    rng = random.Random(7)
    want = []
    for name in ("b", "a", "c d", "e%20f"):
        rows = [f"{name}-{k} " + "x" * rng.randint(0, 60) for k in range(rng.choice((3, 400)))]
        (tmp_path / f"{name}.txt").write_text("\n".join(rows) + "\n")
    for file in sorted(tmp_path.iterdir(), key=lambda f: f.as_uri()):
        want += file.read_text().splitlines()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "7k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = text.numbered_lines(spark, str(tmp_path))
            got = lines.orderBy("line_no").collect()
            assert [r.value for r in got] == want and len({r.line_no for r in got}) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
