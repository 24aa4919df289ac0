"""From overlaps and reads to contigs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import AssemblyConfig
from weftline.functions.sequences import reverse_complement
from weftline.operators import blocks, chains, chimera, consensus, contigs, equations, orient, overlaps, robust, stitch
from weftline.operators import layout as placing
from weftline.operators.forest import spanning_orientation
from weftline.report import Report, watched
from weftline.rounds import Rounds
from weftline.session import materialise


@dataclass
class Graph:
    """What the layout steps share."""

    overlaps: DataFrame
    edges: DataFrame
    lengths: DataFrame


def load_graph(paf: DataFrame, config: AssemblyConfig, report: Report | None = None) -> Graph:
    """Usable overlaps, orientation edges and lengths, each written once."""
    excluded = None
    if config.filter_chimeras:
        # one pass over the file gives lengths and candidates alike
        ends = materialise(chimera.paf_ends(paf, config.hanging_out, config.delimiter), "read-ends")
        lengths = ends.select("read_id", "len")
        if not config.compat:
            excluded = chimera.low_coverage(ends, config.chimera_slack)
    else:
        lengths = materialise(overlaps.read_lengths(paf, config.delimiter), "lengths")
    used = materialise(overlaps.usable(paf, config.hanging_out, config.delimiter, excluded, report), "overlaps")
    return Graph(used, materialise(overlaps.orientation_edges(used), "orientation-edges"), lengths)


def _split(rows: DataFrame, graph: Graph, config: AssemblyConfig, sd: float, report: Report | None = None) -> DataFrame:
    """Chains of a layout as contigs: (contig_id, read_id, start, dir, len, rank, n)."""
    cut = chains.split_chains(rows, graph.overlaps, sd, config.back_window, config.compat, config.scale.chain_reads)
    ordered = placing.ordered(cut.drop("layout"), "contig_id")
    return materialise(watched(report, ordered, placed_reads=F.count(F.lit(1)), contigs=F.sum(F.when(F.col("rank") == 0, 1).otherwise(0))), "contigs")


def read_positions(graph: Graph, config: AssemblyConfig, report: Report | None = None) -> DataFrame:
    """Layouts before splitting: (layout, read_id, start, dir, len)."""
    facing = orient.orient_reads(graph.overlaps, graph.edges, config, report)
    eq = materialise(equations.equations(graph.overlaps, facing, config.equations_from, report=report), "equations")
    fitted = robust.robust_fit(eq, *config.read_thresholds, gate="p99", bounds=config.scale, report=report, name="reads")
    return placing.left_starts(fitted, facing, graph.lengths)


def read_level(graph: Graph, config: AssemblyConfig, report: Report | None = None) -> DataFrame:
    """Contigs from the read-level regression."""
    return _split(materialise(read_positions(graph, config, report), "layout"), graph, config, config.split_sd, report)


def contig_round(current: DataFrame, graph: Graph, config: AssemblyConfig, report: Report | None = None, name: str = "contigs") -> DataFrame:
    """Join contigs through the reads at their ends and split the result again."""
    ends = materialise(contigs.end_overlaps(graph.overlaps, current, config.end_window), "contig-ends")
    facing = materialise(
        spanning_orientation(contigs.contig_votes(ends), config.link_strength, config.scale.finish_edges), "contig-facing"
    )
    steps = materialise(contigs.median_equations(contigs.contig_offsets(ends, facing, config.compat), config.min_links), "contig-equations")
    if steps.isEmpty() and not config.compat:
        return current
    placed = robust.robust_fit(steps, *config.contig_thresholds, gate="p95", bounds=config.scale, report=report, name=name).select("layout", "node", "x")
    facing = facing.select("node", "root", "dir")
    if config.compat:
        # contigs survive only in a component with equations; those outside the fit stay single
        fitted = steps.select(F.col("component").alias("root")).distinct()
        alone = facing.join(fitted, "root", "left_semi").join(placed, "node", "left_anti")
        placed = placed.unionByName(alone.select(F.col("node").alias("layout"), "node", F.lit(0).cast("long").alias("x")))
    merged = materialise(contigs.merge_contigs(current, placed, facing.select("node", "dir")), "merged")
    split = _split(merged, graph, config, config.split_sd * 2, report if config.compat else None)
    if config.compat:
        return split
    # a contig that joined nothing is one chain already and stays as it is
    untouched = current.join(placed.select(F.col("node").alias("contig_id")), "contig_id", "left_anti")
    whole = split.unionByName(untouched.select(*split.columns))
    return materialise(watched(report, whole, placed_reads=F.count(F.lit(1)), contigs=F.sum(F.when(F.col("rank") == 0, 1).otherwise(0))), "contigs")


def layout_contigs(paf: DataFrame, config: AssemblyConfig = AssemblyConfig(), report: Report | None = None, rounds: Rounds | None = None) -> DataFrame:
    """Oriented and positioned contigs: (contig_id, read_id, start, dir, len, rank, n).

    With `rounds` every finished round is kept, and rounds that an earlier driver has
    finished are read instead of run; a round's contigs are released once the next is kept.
    """
    keep = rounds.step if rounds else lambda name, make, supersedes=None: make()
    graph = Graph(**keep("graph", lambda: vars(load_graph(paf, config, report))))
    current = keep("round1", lambda: {"contigs": read_level(graph, config, report)})
    for n in range(1, config.rounds):
        before = current.get("contigs")  # released if a later round is finished

        def joined() -> dict[str, DataFrame]:
            after = contig_round(before, graph, config, report, f"contigs{n}")
            return {"contigs": after, **({"same": after.limit(0)} if after is before else {})}

        current = keep(f"round{n + 1}", joined, f"round{n}")
        if "same" in current:
            break
    return current["contigs"]


def merge_unturned(current: DataFrame, graph: Graph, thr1: float, thr2: float, config: AssemblyConfig) -> DataFrame:
    """Second regression that keeps contig directions: one equation per overlap."""
    eq = contigs.plain_offsets(graph.overlaps, current, config.compat).select(
        "component", "i", "j", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("scale"), "line_no"
    )
    placed = robust.robust_fit(materialise(eq, "plain-equations"), thr1, thr2, 100, "p95", config.scale).select("layout", "node", "x")
    everyone = current.filter("rank = 0").select(F.col("contig_id").alias("node"))
    alone = everyone.join(placed, "node", "left_anti").select(F.col("node").alias("layout"), "node", F.lit(0).cast("long").alias("x"))
    return contigs.merge_contigs(current, placed.unionByName(alone))


def assemble_component(paf: DataFrame, config: AssemblyConfig = AssemblyConfig(read_thresholds=(200.0, 600.0, 100))) -> DataFrame:
    """Read-level pass followed by one merge without turning contigs."""
    graph = load_graph(paf, config)
    return merge_unturned(read_level(graph, config), graph, 200.0, 600.0, config)


def iterate_contigs(rows: DataFrame, graph: Graph, config: AssemblyConfig = AssemblyConfig()) -> DataFrame:
    """Split given positions (layout, read_id, start, dir, len) and merge once more."""
    return merge_unturned(_split(rows, graph, config, 1000), graph, 200.0, 1000.0, config)


def consensus_pieces(layout: DataFrame, reads: DataFrame, config: AssemblyConfig = AssemblyConfig(), report: Report | None = None) -> DataFrame:
    """Numbered contig pieces from laid-out reads and their sequences.

    A report learns how many blocks there are and how many slices fitted nowhere in theirs.
    """
    width, overlap = config.block_width, config.block_overlap
    placed = placing.rezeroed(layout.filter(F.col("n") >= config.min_layout_reads), "contig_id")
    cut = blocks.slices(placed, reads, width, overlap)
    laid = consensus.block_profiles(cut, config.scale.poa_depth)
    made = watched(report, laid, blocks=F.count(F.lit(1)), consensus_bases=F.sum(F.length("cns")), unaligned_slices=F.sum("unaligned")).select("contig_id", "block", "cns")
    if config.compat:
        # the first read opens the contig: whole when forward, its first bases when reversed
        first = blocks.with_sequences(placed.filter("rank = 0"), reads)
        opening = F.when(F.col("dir") == 1, F.col("seq")).otherwise(
            reverse_complement("seq").substr(F.lit(1), F.lit(overlap))
        )
        made = made.unionByName(first.select("contig_id", F.lit(-1).cast("long").alias("block"), opening.alias("cns")))
    return stitch.number_contigs(stitch.contig_pieces(made, width, overlap, config.join_min_score, stored=not config.compat))


def assemble(paf: DataFrame, reads: DataFrame, config: AssemblyConfig = AssemblyConfig(), report: Report | None = None, rounds: Rounds | None = None) -> DataFrame:
    """Contig pieces (contig_no, contig_id, segment, block, offset, seq)."""
    return consensus_pieces(layout_contigs(paf, config, report, rounds), reads, config, report)


def overlap_counts(paf: DataFrame, config: AssemblyConfig = AssemblyConfig()) -> DataFrame:
    """(metric, value): what the overlap filters keep and drop, in one pass."""
    rows = overlaps.normalise(paf, config.delimiter)
    sums = rows.agg(*[c.alias(name) for name, c in overlaps.filter_counts(config.hanging_out).items()])
    return sums.unpivot([], ["records", "self", "dangling", "usable"], "metric", "value")
