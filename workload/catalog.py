"""Named queries over reads and overlaps derived from the `part` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload import fixtures as fx
from weftline.config import AssemblyConfig
from weftline.functions import geometry as G
from weftline.functions import sequences as seqs
from weftline.operators import (
    blocks, chains, chimera, consensus, contigs, equations, forest, layout, orient, overlaps, quantiles, robust, stats, stitch, tree_walk,
)
from weftline.plans import assemble as plan
from weftline.report import Report
from weftline.session import materialise
from weftline.sources import text

HANGING_OUT = 80
SHARES = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99]
BLOCK_WIDTH, BLOCK_OVERLAP = 3000, 600


def _long(df: DataFrame) -> DataFrame:
    """Every integer column as a long."""
    return df.select(*[F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])


def _noisy(spark, sf):
    return fx.paf_noisy(fx.paf(spark, sf))


def _clean(spark, sf):
    return overlaps.usable(fx.paf(spark, sf), HANGING_OUT)


def _used(spark, sf):
    return overlaps.usable(_noisy(spark, sf), HANGING_OUT)


# Sources and projections

def paf_parse(spark, sf):
    rows = text.parse_paf(fx.paf_lines(_noisy(spark, sf)))
    return _long(overlaps.with_ids(rows).withColumn("b_orient", G.orientation_code("strand")))


def blasr_parse(spark, sf):
    rows = text.parse_blasr(fx.blasr_lines(_noisy(spark, sf)))
    return _long(rows.select("line_no", "a", "b", "a_orient", "b_orient", "score", "a_start", "a_end", "a_len", "b_start", "b_end", "b_len"))


def mhap_parse(spark, sf):
    return _long(text.parse_mhap(fx.mhap_lines(_noisy(spark, sf))))


def fasta_parse(spark, sf):
    rows = text.parse_fasta(fx.sequence_lines(spark, sf))
    return rows.select("read_id", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("digest"))


def overlap_normalise(spark, sf):
    return _long(overlaps.normalise(_noisy(spark, sf)))


def overlap_weight(spark, sf):
    rows = overlaps.normalise(_noisy(spark, sf))
    return rows.select("line_no", "a", "b", G.signed_weight().alias("sw"))


# Filters

def self_overlap_filter(spark, sf):
    rows = fx.with_self_rows(_noisy(spark, sf), fx.sim_reads(spark, sf))
    return overlaps.drop_self(overlaps.normalise(rows)).select("line_no", "a", "b", "w")


def dangling_lengths(spark, sf):
    rows = overlaps.normalise(_noisy(spark, sf))
    return rows.select("line_no", G.dangling_length().alias("dangling"))


def dangling_filter(spark, sf):
    return _used(spark, sf).select("line_no", "a", "b", "w")


def inconsistent_overlaps(spark, sf):
    """Overlaps against directions in which every eleventh read is turned."""
    facing = fx.true_orientation(spark, sf).withColumn("dir", F.when(F.col("read_id") % 11 == 0, -F.col("dir")).otherwise(F.col("dir")))
    return equations.inconsistent_overlaps(_used(spark, sf), facing).select("line_no", "a", "b")


def overlap_counts(spark, sf):
    """Records kept and dropped by the overlap filters."""
    return plan.overlap_counts(fx.with_self_rows(_noisy(spark, sf), fx.sim_reads(spark, sf)))


# Chimera detection

def reach_by_end(spark, sf):
    ends = chimera.paf_ends(_noisy(spark, sf)).filter("front is not null or back is not null")
    return ends.select("read_id", "front", "back").fillna(0)


def chimera_candidates(spark, sf):
    return chimera.paf_candidates(_noisy(spark, sf))


def chimera_filtered_overlaps(spark, sf):
    paf = _noisy(spark, sf)
    hit = chimera.paf_candidates(paf)
    return overlaps.usable(paf, HANGING_OUT, excluded=hit).select("line_no", "a", "b", "w")


def low_quality_counts(spark, sf):
    """With thresholds that the fixture's lengths straddle."""
    rows = fx.with_self_rows(_noisy(spark, sf), fx.sim_reads(spark, sf))
    return chimera.low_quality_counts(rows, min_bases=2000)


def blasr_chimera(spark, sf):
    rows = text.parse_blasr(fx.blasr_lines(_noisy(spark, sf)))
    return chimera.numbered_candidates(rows, fx.sim_reads(spark, sf).count())


def mhap_chimera(spark, sf):
    rows = text.parse_mhap(fx.mhap_lines(_noisy(spark, sf)))
    return chimera.numbered_candidates(rows, fx.sim_reads(spark, sf).count())


# Links and votes

def read_lengths(spark, sf):
    return overlaps.read_lengths(fx.with_self_rows(_noisy(spark, sf), fx.sim_reads(spark, sf)))


def overlaps_per_pair(spark, sf):
    return overlaps.overlaps_per_pair(overlaps.usable(fx.paf_dual(_noisy(spark, sf)), HANGING_OUT))


def edge_weight_last(spark, sf):
    return overlaps.orientation_edges(overlaps.usable(fx.paf_dual(_noisy(spark, sf)), HANGING_OUT))


def edge_links_first(spark, sf):
    return overlaps.first_links(overlaps.usable(fx.paf_mixed(_noisy(spark, sf)), HANGING_OUT)).fillna(-1)


def orientation_votes(spark, sf):
    return _long(overlaps.orientation_votes(overlaps.usable(fx.paf_dual(_noisy(spark, sf)), HANGING_OUT)))


def vote_probability(spark, sf):
    """Votes squashed to a probability in millionths."""
    votes = overlaps.orientation_votes(_used(spark, sf))
    p = G.logistic((F.col("pos") - F.col("neg")) / 100)
    return votes.select("u", "v", F.round(p * 1000000).cast("long").alias("p"))


# Offsets and equations

def _offsets(spark, sf, make, name):
    rows = equations.oriented_overlaps(_used(spark, sf), fx.true_orientation(spark, sf))
    return rows.select("line_no", "a", "b", make("da", "db").cast("long").alias(name))


def read_offset(spark, sf):
    return _offsets(spark, sf, G.read_offset, "step")


def start_offset(spark, sf):
    return _offsets(spark, sf, G.start_offset, "step")


def _equations(spark, sf, kind):
    rows = equations.equations(_used(spark, sf), fx.true_orientation(spark, sf), kind=kind)
    scale = F.round(F.col("scale") * 1000000).cast("long").alias("scale")
    return rows.select("i", "j", F.col("y").cast("long").alias("y"), scale)


def equations_plain(spark, sf):
    return _equations(spark, sf, "plain")


def equations_weighted(spark, sf):
    return _equations(spark, sf, "weighted")


def equations_visit_order(spark, sf):
    """Compat equations when both directions are listed: each pair once, whichever way it is used."""
    used = materialise(overlaps.usable(fx.paf_dual(fx.paf(spark, sf)), HANGING_OUT), "overlaps")
    facing = orient.orient_reads(used, overlaps.orientation_edges(used), AssemblyConfig(mode="compat"))
    eq = equations.equations(used, facing, "visit_order")
    return eq.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.abs("y").cast("long").alias("gap"))


def equations_indel(spark, sf):
    return _equations(spark, sf, "indel")


# Graph

def components(spark, sf):
    """Reads linked by any usable overlap."""
    edges = overlaps.orientation_edges(_clean(spark, sf))
    return forest.connected_components(edges).select(F.col("node").alias("read_id"), F.col("root").alias("component"))


def components_binned(spark, sf):
    """Reads linked inside bins of 37 ids."""
    edges = overlaps.orientation_edges(_clean(spark, sf))
    inside = edges.filter(F.expr("u div 37 = v div 37"))
    return forest.connected_components(inside).select(F.col("node").alias("read_id"), F.col("root").alias("component"))


def spanning_orientation(spark, sf):
    votes = overlaps.orientation_votes(_used(spark, sf))
    return _long(forest.spanning_orientation(votes, 0).select(F.col("node").alias("read_id"), F.col("root").alias("component"), "dir"))


def spanning_orientation_rooted(spark, sf):
    """Directions of one component relative to a chosen read."""
    votes = overlaps.orientation_votes(_used(spark, sf))
    return _long(forest.oriented_from(forest.spanning_orientation(votes, 0), 7).select(F.col("node").alias("read_id"), "dir"))


def greedy_orientation(spark, sf):
    used = materialise(_used(spark, sf), "overlaps")
    return _long(orient.orient_reads(used, overlaps.orientation_edges(used)).select("component", "read_id", "dir"))


def orientation_conflicts(spark, sf):
    """Directions from edges of which some have the wrong sign."""
    used = materialise(_flipped_votes(_used(spark, sf)), "overlaps")
    return _long(orient.orient_reads(used, overlaps.orientation_edges(used)).select("component", "read_id", "dir"))


def _flipped_votes(used):
    wrong = (F.col("a") * 13 + F.col("b") * 7) % 41 == 0
    return used.withColumn("b_orient", F.when(wrong, 1 - F.col("b_orient")).otherwise(F.col("b_orient")))


def suspicious_reads(spark, sf):
    """Reads of which one half is turned, found by their divided links.

    Every read has links to the twelve before and after it, so that no other set of turned
    reads explains the contradictions as well.
    """
    reads = fx.sim_reads(spark, sf).select(F.col("read_id").alias("u"))
    links = reads.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("v", F.col("u") + F.col("d")).join(reads.withColumnRenamed("u", "v"), "v")
    weight = (20 - F.col("d")) * F.when(F.col("u") % 40 == 20, -1).otherwise(1)
    edges = materialise(links.select("u", "v", weight.cast("long").alias("sw")), "edges")
    return _long(orient.set_aside(edges, 0.25)[1].select(F.col("node").alias("read_id"), "against", "weight"))


def _parent_links(spark, sf):
    """The heaviest link of each read to an earlier one, as a tree of reads."""
    used = _clean(spark, sf).select("a", "b", F.col("w").cast("double").alias("w"))
    return used.groupBy(F.col("b").alias("v")).agg(F.max(F.struct("w", (-F.col("a")).alias("k"))).alias("c")).select((-F.col("c.k")).alias("u"), "v", F.col("c.w").alias("w"))


def _walk(spark, sf):
    links = materialise(_parent_links(spark, sf), "links")
    roots = links.select(F.col("u").alias("node")).distinct().join(links.select(F.col("v").alias("node")), "node", "left_anti")
    return tree_walk.walk_order(links, roots)


def tree_walk_order(spark, sf):
    return _walk(spark, sf).select(F.col("node").alias("read_id"), "visit")


def equations_walk_order(spark, sf):
    """Equations of overlaps whose query stands before the target on the walk."""
    facing = fx.true_orientation(spark, sf).join(_walk(spark, sf).withColumnRenamed("node", "read_id"), "read_id")
    eq = equations.equations(_mixed(spark, sf), facing, "visit_order")
    return eq.select("i", "j", F.col("y").cast("long").alias("y"))


def _mixed(spark, sf):
    return overlaps.usable(fx.paf_mixed(fx.paf(spark, sf)), HANGING_OUT)


# Regression and layout

def _positions(spark, sf, paf, **settings):
    config = AssemblyConfig(**settings)
    rows = plan.read_positions(plan.load_graph(paf, config), config)
    return _long(rows.select("read_id", "start", "dir", "len"))


def layout_positions(spark, sf):
    return _positions(spark, sf, fx.paf(spark, sf))


def layout_positions_mixed(spark, sf):
    return _positions(spark, sf, fx.paf_mixed(fx.paf(spark, sf)))


def layout_positions_noisy(spark, sf):
    return _positions(spark, sf, _noisy(spark, sf))


def _false_equations(spark, sf, kind="plain"):
    """The equations of the clean overlaps, some of them 1500 off."""
    eq = equations.equations(_clean(spark, sf), fx.true_orientation(spark, sf), kind=kind)
    off = (F.col("i") * 17 + F.col("j") * 5) % 97 == 0
    return materialise(eq.withColumn("y", F.col("y") + F.when(off, 1500.0).otherwise(0.0)), "false-equations")


def robust_positions(spark, sf):
    fit = robust.robust_fit(_false_equations(spark, sf), 200.0, 800.0, 50)
    return fit.select(F.col("node").alias("read_id"), "x")


def robust_positions_weighted(spark, sf):
    fit = robust.robust_fit(_false_equations(spark, sf, "weighted"), 200.0, 800.0, 50)
    return fit.select(F.col("node").alias("read_id"), "x")


def residual_percentiles(spark, sf):
    """Percentiles and mean Huber weight of what the fit leaves of the false equations."""
    eq = _false_equations(spark, sf)
    fit = robust.robust_fit(eq, 200.0, 800.0, 50)
    side = lambda c, x: fit.select(F.col("node").alias(c), F.col("x").alias(x))
    left = F.abs(F.col("y") - (F.col("xj") - F.col("xi")))
    rows = materialise(eq.join(side("i", "xi"), "i").join(side("j", "xj"), "j").select("component", left.alias("r")), "residuals-left")
    spread = quantiles.quantiles(rows, "component", "r", SHARES)
    weight = rows.groupBy("component").agg(F.round(F.avg(G.huber_weight("r", 200.0)) * 1000).cast("long").alias("mean_weight"))
    return spread.join(weight, "component").select(
        F.round(F.col("share") * 100).cast("long").alias("percent"), F.round(F.col("r") * 1000).cast("long").alias("milli"), "mean_weight"
    )


def _true_rows(spark, sf):
    return fx.whole_layout(spark, sf).select(F.col("contig_id").alias("layout"), "read_id", "start", "dir", "len")


def layout_split(spark, sf):
    rows = chains.split_chains(_true_rows(spark, sf), _clean(spark, sf), 1000)
    return rows.select("read_id", "contig_id", "start")


def layout_split_noisy(spark, sf):
    rows = chains.split_chains(_true_rows(spark, sf), _used(spark, sf), 1000)
    return rows.groupBy("contig_id").agg(F.count("*").alias("n_reads"))


def layout_index(spark, sf):
    """Place of every read counted from either end of its contig."""
    rows = fx.true_layout(spark, sf)
    return rows.select("contig_id", "read_id", "start", "rank", (F.col("n") - F.col("rank")).alias("from_back"))


def layout_spans(spark, sf):
    return layout.spans(fx.true_layout(spark, sf))


# Contig level

def _ends(spark, sf):
    return contigs.end_overlaps(_clean(spark, sf), materialise(fx.true_layout(spark, sf), "true-layout"))


def contig_end_overlaps(spark, sf):
    return _ends(spark, sf).select("line_no", "a", "b", "ca", "cb")


def contig_votes(spark, sf):
    return _long(contigs.contig_votes(_ends(spark, sf)))


def contig_orientation(spark, sf):
    rows = forest.spanning_orientation(contigs.contig_votes(_ends(spark, sf)), 10)
    return _long(rows.select(F.col("node").alias("contig_id"), F.col("root").alias("component"), "dir"))


def _contig_steps(spark, sf):
    ends = materialise(_ends(spark, sf), "ends")
    facing = materialise(forest.spanning_orientation(contigs.contig_votes(ends), 10), "facing")
    return facing, contigs.median_equations(contigs.contig_offsets(ends, facing))


def contig_offset_median(spark, sf):
    _, steps = _contig_steps(spark, sf)
    return steps.select("i", "j", F.round("y").cast("long").alias("y"), "n_links")


def contig_positions(spark, sf):
    _, steps = _contig_steps(spark, sf)
    fit = robust.robust_fit(materialise(steps, "steps"), 500.0, 2000.0, 100, "p95")
    return fit.select(F.col("node").alias("contig_id"), "layout", "x")


def contig_merge(spark, sf):
    facing, steps = _contig_steps(spark, sf)
    fit = robust.robust_fit(materialise(steps, "steps"), 500.0, 2000.0, 100, "p95")
    rows = contigs.merge_contigs(fx.true_layout(spark, sf), fit, facing)
    return _long(rows.select("layout", "read_id", "start", "dir"))


def _unturned(spark, sf):
    return materialise(fx.true_layout(spark, sf, turned=False), "true-layout")


def contig_offsets_plain(spark, sf):
    rows = contigs.plain_offsets(_clean(spark, sf), _unturned(spark, sf))
    return rows.select("line_no", "i", "j", F.col("y").cast("long").alias("y"))


def contig_offsets_plain_median(spark, sf):
    rows = contigs.median_equations(contigs.plain_offsets(_clean(spark, sf), _unturned(spark, sf)), min_links=1)
    return rows.select("i", "j", F.round("y").cast("long").alias("y"), "n_links")


def contig_round(spark, sf):
    """One whole round on the binned contigs."""
    config = AssemblyConfig()
    graph = plan.load_graph(fx.paf(spark, sf), config)
    rows = plan.contig_round(materialise(fx.true_layout(spark, sf), "true-layout"), graph, config)
    return _long(rows.select("contig_id", "read_id", "start", "dir", "rank"))


def layout_contigs(spark, sf):
    """Read level and all contig rounds."""
    return _long(plan.layout_contigs(fx.paf(spark, sf)).select("contig_id", "read_id", "start", "dir", "rank"))


def layout_contigs_noisy(spark, sf):
    return layout.spans(plan.layout_contigs(_noisy(spark, sf)))


def component_assembly(spark, sf):
    """Read-level pass and one merge that keeps directions."""
    return _long(plan.assemble_component(fx.paf(spark, sf)).select("layout", "read_id", "start", "dir"))


def contig_iteration(spark, sf):
    """Split and merge, starting from true positions."""
    config = AssemblyConfig()
    rows = plan.iterate_contigs(_true_rows(spark, sf), plan.load_graph(fx.paf(spark, sf), config), config)
    return _long(rows.select("layout", "read_id", "start", "dir"))


# Sequences, blocks and consensus

def reverse_complements(spark, sf):
    return fx.sim_sequences(spark, sf).select("read_id", F.md5(seqs.reverse_complement("seq")).alias("digest"))


def wrapped_sequences(spark, sf):
    rows = fx.sim_sequences(spark, sf).withColumn("text", seqs.wrapped("seq"))
    return rows.select("read_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("size"))


def gc_content(spark, sf):
    return fx.sim_sequences(spark, sf).select("read_id", seqs.gc_count("seq").alias("gc"))


def block_coverage(spark, sf):
    return blocks.block_coverage(fx.whole_layout(spark, sf), BLOCK_WIDTH, BLOCK_OVERLAP).select("block", "n_slices", "bases")


def _slices(spark, sf):
    return blocks.slices(fx.whole_layout(spark, sf), fx.sim_sequences(spark, sf), BLOCK_WIDTH, BLOCK_OVERLAP)


def block_slices(spark, sf):
    return _slices(spark, sf).select("block", "read_id", "offset", "bases", F.md5("piece").alias("digest"))


def block_consensus(spark, sf):
    rows = consensus.block_consensus(_slices(spark, sf))
    return rows.select("block", F.length("cns").cast("long").alias("bases"), F.md5("cns").alias("digest"))


def block_consensus_noisy(spark, sf):
    """Blocks whose slices are wrong at many sites, a third of them at each."""
    rows = consensus.block_consensus(fx.noisy_slices(spark, sf))
    return rows.select("block", F.length("cns").cast("long").alias("bases"), F.md5("cns").alias("digest"))


def block_joins(spark, sf):
    made = consensus.block_consensus(_slices(spark, sf))
    return _long(stitch.block_joins(made, BLOCK_WIDTH, BLOCK_OVERLAP).select("block", "tail", "score", "left_end", "right_end"))


def _pieces(spark, sf):
    config = AssemblyConfig(block_width=BLOCK_WIDTH, block_overlap=BLOCK_OVERLAP)
    return plan.consensus_pieces(fx.whole_layout(spark, sf), fx.sim_sequences(spark, sf), config)


def stitched_pieces(spark, sf):
    """Surviving stretch of every block and its place in the contig."""
    rows = _pieces(spark, sf)
    return rows.select("contig_no", "block", "offset", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("digest"))


def contig_fasta(spark, sf):
    """Output lines; runs of complete lines stay together."""
    lines = stitch.fasta_lines(_pieces(spark, sf))
    single = lines.select("contig_no", F.posexplode(F.split("text", "\n")).alias("at", "text"), "line_no")
    return single.select("contig_no", (F.col("line_no") + F.col("at")).alias("line_no"), "text")


def layout_export(spark, sf):
    rows = blocks.layout_lines(fx.true_layout(spark, sf), fx.sim_sequences(spark, sf))
    return rows.select("contig_id", "block", "rank", F.md5("line").alias("digest"))


def assembly_stats(spark, sf):
    rows = layout.spans(fx.true_layout(spark, sf)).select(F.col("contig_id").alias("contig_no"), F.col("span").alias("length"))
    return _long(stats.assembly_stats(rows))


def run_report(spark, sf):
    """What a whole run on noisy overlaps tells of itself."""
    report, config = Report(), AssemblyConfig(block_width=BLOCK_WIDTH)
    used = fx.with_self_rows(_noisy(spark, sf), fx.sim_reads(spark, sf))
    graph = plan.load_graph(used, config, report)
    placed = materialise(plan.read_positions(graph, config, report), "layout")
    laid = materialise(layout.ordered(placed).withColumnRenamed("layout", "contig_id"), "ordered")
    materialise(plan.consensus_pieces(laid, fx.sim_sequences(spark, sf), config, report), "pieces", letters=True)
    return report.rows(spark).withColumn("value", F.rint("value").cast("long"))


def assemble(spark, sf):
    """Everything: overlaps and reads in, contigs out, reported strand-independently."""
    config = AssemblyConfig(block_width=BLOCK_WIDTH)
    pieces = materialise(plan.assemble(fx.paf(spark, sf), fx.sim_sequences(spark, sf), config), "pieces", letters=True)
    rows = pieces.groupBy("contig_no").agg(F.sum(F.length("seq")).alias("bases"), F.sum(seqs.gc_count("seq")).alias("gc"))
    return _long(rows)


QUERIES = {
    f.__name__: f
    for f in (
        paf_parse, blasr_parse, mhap_parse, fasta_parse, overlap_normalise, overlap_weight, self_overlap_filter,
        dangling_lengths, dangling_filter, overlap_counts, inconsistent_overlaps, reach_by_end, chimera_candidates,
        chimera_filtered_overlaps, low_quality_counts, blasr_chimera, mhap_chimera, read_lengths, overlaps_per_pair,
        edge_weight_last, edge_links_first, orientation_votes, vote_probability, read_offset, start_offset,
        equations_plain, equations_weighted, equations_indel, equations_visit_order, components, components_binned, spanning_orientation, spanning_orientation_rooted, greedy_orientation,
        orientation_conflicts, suspicious_reads, tree_walk_order, equations_walk_order, layout_positions, layout_positions_mixed, layout_positions_noisy, robust_positions,
        robust_positions_weighted, residual_percentiles, layout_split, layout_split_noisy, layout_index, layout_spans,
        contig_end_overlaps, contig_votes, contig_orientation, contig_offset_median, contig_positions, contig_merge,
        contig_offsets_plain, contig_offsets_plain_median, contig_round, layout_contigs, layout_contigs_noisy,
        component_assembly, contig_iteration, reverse_complements, wrapped_sequences, gc_content, block_coverage,
        block_slices, block_consensus, block_consensus_noisy, block_joins, stitched_pieces, contig_fasta, layout_export, assembly_stats, run_report, assemble,
    )
}
