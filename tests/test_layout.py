"""Chains, ranks, contig offsets and the whole layout."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from workload import catalog
from workload import fixtures as fx
from weftline.config import AssemblyConfig, ScaleBounds
from weftline.functions import geometry as G
from weftline.operators import chains, chimera, equations, layout, orient, overlaps, ranks, robust
from weftline.plans import assemble as plan
from weftline.report import Report
from weftline.rounds import Rounds, fingerprint
from weftline.session import materialise


def _plain_chains(reads, links, sd, back, exclude_last):
    """Chains one after another from the list of remaining reads.

    reads: [(id, start, dir, len)] in order; links(x, y) -> None or (sign, offset).
    """
    left, out = list(range(len(reads))), []
    while left:
        chain = [left[0]]
        for k in left[1:]:
            cur = reads[chain[-1]]
            if reads[k][1] >= cur[1] + cur[3] + sd:
                break
            if exclude_last and k == left[-1]:
                break
            found = None
            for m in reversed(chain[-(back + 1):]):
                found = links(reads[m], reads[k])
                if found:
                    break
            if found and found[1] is not None and abs(found[1] - (reads[k][1] - reads[m][1])) < sd and (found[0] > 0) == (reads[m][2] == reads[k][2]):
                chain.append(k)
        out.append([reads[k][0] for k in chain])
        left = [k for k in left if k not in chain]
    return out


def _shaken(used):
    """Links with wrong offsets, wrong signs and gaps, so that chains interleave."""
    a, b = F.col("a"), F.col("b")
    rows = used.filter((a * 5 + b * 3) % 4 != 0)
    rows = rows.withColumn("a_start", F.when((a * 3 + b) % 7 == 0, F.col("a_start") + 3000).otherwise(F.col("a_start")))
    return rows.withColumn("b_orient", F.when((a + b * 2) % 11 == 0, 1 - F.col("b_orient")).otherwise(F.col("b_orient")))


@pytest.mark.parametrize("exclude_last", [False, True])
@pytest.mark.parametrize("size", [9, 60, 20_000])
def test_chains_match_the_plain_walk(spark, sf, clean, size, exclude_last):
    used = materialise(_shaken(overlaps.usable(fx.paf_mixed(clean), 80)), "shaken")
    whole = fx.sim_reads(spark, sf).select(
        F.expr("read_id div 70").alias("layout"), "read_id", F.col("g_start").alias("start"), F.col("strand").alias("dir"), F.col("read_len").alias("len")
    )
    rows = used.collect()
    first_sign, first_row = {}, {}
    for r in sorted(rows, key=lambda r: r.line_no):
        first_sign.setdefault(frozenset((r.a, r.b)), r.w if r.b_orient == 0 else -r.w)
        first_row.setdefault((r.a, r.b), r)

    def offset(r, da, db):
        if r.b_orient == 0 and da == db:
            step = da * (r.a_start - r.b_start)
        elif r.b_orient == 1 and da != db:
            step = da * (r.a_end + r.b_len - r.b_end)
        else:
            return None
        return step + (r.a_len if da == -1 else 0) - (r.b_len if db == -1 else 0)

    def links(x, y):
        sign = first_sign.get(frozenset((x[0], y[0])))
        if not sign:
            return None
        if (x[0], y[0]) in first_row:
            return sign, offset(first_row[x[0], y[0]], x[2], y[2])
        step = offset(first_row[y[0], x[0]], y[2], x[2])
        return sign, None if step is None else -step

    want = {}
    for key, group in itertools.groupby(sorted(whole.collect(), key=lambda r: (r.layout, r.start, r.read_id)), key=lambda r: r.layout):
        reads = [(r.read_id, r.start, r.dir, r.len) for r in group]
        for chain in _plain_chains(reads, links, 1000, 4, exclude_last):
            want.update({n: chain[0] for n in chain})
    got = chains.split_chains(whole, used, 1000, 4, exclude_last, size).collect()
    assert {r.read_id: r.contig_id for r in got} == want
    assert len(set(want.values())) > 6


def test_chain_counts_of_the_fixture(spark):
    sf = "/root/testdata/sf0.01"
    from workload import catalog

    counts = sorted((r.n_reads for r in catalog.layout_split_noisy(spark, sf).collect()), reverse=True)
    assert counts == [1978] + [1] * 22


def test_ranks_and_running_values(spark):
    rng = random.Random(4)
    data = [(g, i, rng.randint(-9, 9)) for g in range(3) for i in range(100)]
    df = spark.createDataFrame(data, "g long, i long, v long")
    ranked = ranks.rank_in_group(df, "g", ["v", "i"], "at", "n").collect()
    for g in range(3):
        rows = sorted((r for r in ranked if r.g == g), key=lambda r: r["at"])
        assert [r["at"] for r in rows] == list(range(100)) and rows[0].n == 100
        assert [(r.v, r.i) for r in rows] == sorted((r.v, r.i) for r in rows)
    out = ranks.running(df, ["g"], "i", {"s": ("sum", "v", "up"), "lo": ("min", "v", "up"), "hi": ("max", "v", "down")}, chunk=7).collect()
    for r in out:
        vals = [v for g, i, v in data if g == r.g]
        assert (r.s, r.lo, r.hi) == (sum(vals[: r.i + 1]), min(vals[: r.i + 1]), max(vals[r.i:]))


def test_contig_offsets_of_random_placements(spark):
    """Offsets between contigs turned at random equal the truth; compat errs only where stated."""
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        la, lb = rng.randint(50, 90), rng.randint(50, 90)
        pa, pb = rng.randint(0, 40), rng.randint(0, 40)
        ga, gb = rng.choice((1, -1)), rng.choice((1, -1))       # strands on the genome
        fb = rng.choice((1, -1))                                 # contig of b: same way or turned
        oa, ob = rng.randint(-30, 30), rng.randint(-30, 30)     # genome place of the contig origins
        sa, sb = oa + pa, (ob + pb if fb == 1 else ob - pb - lb)
        lo, hi = max(sa, sb), min(sa + la, sb + lb)
        if hi - lo < 5:
            continue
        span = lambda s, n, g: (lo - s, hi - s) if g == 1 else (s + n - hi, s + n - lo)
        a0, a1 = span(sa, la, ga)
        b0, b1 = span(sb, lb, ga)   # the target as the query sees it
        rows.append((a0, a1, la, 0 if ga == gb else 1, b0, b1, lb, ga, gb * fb, fb, pa, pb, ob - oa))
    df = spark.createDataFrame(rows, "a_start long, a_end long, a_len long, b_orient int, b_start long, b_end long, b_len long, da int, db int, flip int, pa long, pb long, truth long")
    for compat in (False, True):
        off = G.contig_offset("da", "db", "flip", "pa", "pb", "a_len", "b_len", compat)
        wrong = df.withColumn("y", off).filter("y is null or y <> truth").select("flip", "da").distinct().collect()
        assert [tuple(r) for r in wrong] == ([(-1, -1)] if compat else [])


def test_visit_order_drops_equations(spark, sf, clean):
    """Rows whose target is visited first are unused unless both directions are listed."""
    counts = {}
    for name, rows in (("one_way", clean), ("dual", fx.paf_dual(clean)), ("mixed", fx.paf_mixed(clean))):
        used = materialise(overlaps.usable(rows, 80), "used")
        facing = orient.orient_reads(used, overlaps.orientation_edges(used), AssemblyConfig(mode="compat"))
        counts[name] = equations.equations(used, facing, "visit_order").count()
    total = clean.count()
    assert counts["one_way"] == 0 and counts["dual"] == total and 0 < counts["mixed"] < total


def test_modes_treat_chimeras_and_lone_contigs_differently(spark, noisy):
    dual = materialise(fx.paf_dual(noisy), "dual")
    strict = plan.load_graph(dual, AssemblyConfig(filter_chimeras=True))
    loose = plan.load_graph(dual, AssemblyConfig(filter_chimeras=True, mode="compat"))
    candidates = chimera.paf_candidates(dual, 80)
    hit = {r.read_id for r in candidates.collect()}
    assert hit and not hit & {r.a for r in strict.overlaps.collect()}
    assert hit & {r.a for r in loose.overlaps.collect()}
    kept = layout.spans(plan.layout_contigs(dual, AssemblyConfig(rounds=2))).agg(F.sum("n_reads")).first()[0]
    lost = layout.spans(plan.layout_contigs(dual, AssemblyConfig(rounds=2, mode="compat"))).agg(F.sum("n_reads")).first()[0]
    assert kept == 200 and lost < 200


def test_bounds_do_not_change_the_layout(spark, sf, noisy):
    """The distributed routes give what the bounded kernels give."""
    tight = AssemblyConfig(rounds=1, scale=ScaleBounds(finish_edges=200, slice_nodes=64, chain_reads=45, poa_depth=3))
    pick = lambda config: sorted(plan.layout_contigs(noisy, config).select("contig_id", "read_id", "start", "dir", "rank").collect())
    assert pick(tight) == pick(AssemblyConfig(rounds=1))


def test_broken_contigs_are_joined_again(spark, sf, clean):
    """A genome cut into turned bins comes back as one contig in its true order."""
    from workload import catalog

    rows = catalog.contig_round(spark, sf).orderBy("rank").collect()
    truth = [r.read_id for r in fx.sim_reads(spark, sf).orderBy("g_start", "read_id").collect()]
    assert [r.read_id for r in rows] == truth


def test_a_restarted_run_goes_on_after_the_last_finished_round(spark, sf, clean, tmp_path, monkeypatch):
    config = AssemblyConfig(rounds=3)
    paf = clean.filter("line_no < 1600")
    rows = lambda df: sorted(map(tuple, df.select("contig_id", "read_id", "start", "dir", "rank").collect()))
    want = rows(plan.layout_contigs(paf, config))
    start = lambda: Rounds(spark, str(tmp_path / "kept"), config, fingerprint(paf))
    with monkeypatch.context() as broken:
        broken.setattr(plan, "contig_round", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            plan.layout_contigs(paf, config, rounds=start())
    assert sorted(start().steps) == ["graph", "round1"]
    with monkeypatch.context() as later:
        later.setattr(plan, "load_graph", lambda *_: 1 / 0)
        later.setattr(plan, "read_level", lambda *_: 1 / 0)
        assert rows(plan.layout_contigs(paf, config, rounds=start())) == want
        later.setattr(plan, "contig_round", lambda *_: 1 / 0)
        assert rows(plan.layout_contigs(paf, config, rounds=start())) == want  # nothing is left to run
    assert not start().steps["round1"] and start().steps["round2"] != {}
    assert not [p for p in (tmp_path / "kept").rglob("round1-*")]
    other = Rounds(spark, str(tmp_path / "kept"), AssemblyConfig(rounds=2), fingerprint(paf))
    assert not other.steps and fingerprint(paf) != fingerprint(paf.limit(5))


def test_a_report_costs_no_jobs(spark, clean, monkeypatch):
    """The same writes happen with and without a report."""
    made = []
    keep = plan.materialise
    for module in (plan, orient, robust):
        monkeypatch.setattr(module, "materialise", lambda df, name: made.append(name) or keep(df, name))
    config, counts = AssemblyConfig(), []
    for report in (None, Report()):
        made.clear()
        plan.read_positions(plan.load_graph(clean, config, report), config, report).count()
        counts.append(list(made))
    assert counts[0] == counts[1]
    values = report.values()
    assert values["records"] == values["usable"] == values["reads_equations"] == clean.count() and values["reads_residual_max"] < 1


def test_the_report_of_a_run_is_about_the_reads_it_has_placed(spark, sf, monkeypatch):
    """Blocks are cut from the positions that the fit has found, not from known ones."""
    some = fx.sim_reads(spark, sf).filter("read_id between 40 and 79")
    placed = some.select(F.lit(40).cast("long").alias("layout"), "read_id", F.col("g_start").alias("start"), F.col("strand").alias("dir"), F.col("read_len").alias("len"))
    monkeypatch.setattr(plan, "load_graph", lambda *_: None)
    monkeypatch.setattr(plan, "read_positions", lambda *_: placed)
    got = {r.metric: r.value for r in catalog.run_report(spark, sf).collect()}
    span = some.agg(F.max("g_end") - F.min("g_start")).first()[0]
    ends = [min(2400 * k + 3000, span) - 2400 * k for k in range(span // 2400 + 1)]
    assert got == {"blocks": len(ends), "consensus_bases": sum(ends), "unaligned_slices": 0}
