"""What larger tables need: sums beyond 32 bits, work spread over tasks, text made once."""

import random
import re
from hashlib import md5

import pyarrow as pa

from weftline.functions import packed
from weftline.operators import blocks, consensus, overlaps, poa, stats, stitch
from workload import fixtures


def test_stats_of_totals_near_32_bits(spark):
    rows = [(i, 20_000_000 + i) for i in range(8)]
    row = stats.assembly_stats(spark.createDataFrame(rows, "contig_no long, length long")).first()
    assert row.total_length == sum(n for _, n in rows) and (row.n50, row.l50) == (20_000_004, 4) and (row.n90, row.l90) == (20_000_000, 8)


def _parts(spark, folder, keys):
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_reads_of_one_file_are_spread(spark, tmp_path):
    sf = _parts(spark, tmp_path, range(200))
    assert fixtures.sim_reads(spark, sf).rdd.getNumPartitions() == 3
    assert fixtures.sim_reads(spark, sf).count() == 200


def test_sequences_follow_the_genome(spark, tmp_path):
    sf = _parts(spark, tmp_path, [1, 2, 2, 300, None])
    tile = lambda j: md5(str(j).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))
    want = {}
    for r in fixtures.sim_reads(spark, sf).filter("read_id is not null").collect():
        first = r.g_start // 32
        bases = "".join(tile(j) for j in range(first, r.g_end // 32 + 1))[r.g_start - first * 32:r.g_end - first * 32]
        want[r.read_id] = bases if r.strand == 1 else bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
    got = fixtures.sim_sequences(spark, sf).collect()
    assert sorted((r.read_id is None, r.read_id or 0, r.seq or "") for r in got) == sorted(
        (k is None, k or 0, want.get(k, "")) for k in [1, 2, 2, 300, None]
    )
    lines = fixtures.sequence_lines(spark, sf)
    assert lines.count() == 5 and lines.filter("value is null").count() == 1
    assert all(max(map(len, r.value.split("\n"))) <= 80 for r in lines.filter("value is not null").collect())


def _path_by_edges(graph):
    """The heaviest path, edge by edge."""
    rank, source, target, by = graph._edges()
    n, weight = len(graph.base), graph.weight[by].tolist()
    score, best, heaviest, onward, most = [0] * n, [-1] * n, [0] * n, [-1] * n, [0] * n
    for u, v, w in zip(source.tolist(), target.tolist(), weight):
        if best[v] < 0 or (w, score[u]) > (heaviest[v], score[best[v]]):
            best[v], heaviest[v], score[v] = u, w, score[u] + w
        if w > most[u]:
            onward[u], most[u] = v, w
    v = max(range(n), key=lambda x: (score[x], -int(rank[x])))
    back, ahead, u = [], [], v
    while onward[u] >= 0:
        u = onward[u]
        ahead.append(u)
    while v >= 0:
        back.append(v)
        v = best[v]
    return back[::-1] + ahead


def test_heaviest_path_by_runs():
    rng = random.Random(5)
    for _ in range(60):
        whole = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 160)))
        graph = poa.Graph.of(whole, rng.randrange(1, 4))
        for _ in range(rng.randrange(8)):
            a, b = sorted(rng.randrange(len(whole) + 1) for _ in range(2))
            piece = "".join(rng.choice(["", c + rng.choice("ACGT"), rng.choice("ACGT")]) if rng.random() < 0.08 else c for c in whole[a:b])
            if piece:
                graph.add(piece, rng.randrange(1, 4))
        assert graph._heaviest().tolist() == _path_by_edges(graph)


def test_a_whole_block_hands_on_letters_only():
    rows = {"contig_id": [0] * 3, "block": [1] * 3, "rank": [0, 1, 2], "read_id": [5, 6, 7], "piece": ["ACGTACGGTTCA", "ACGTACGGTTCA", "CGTACGGTT"], "batch": [0] * 3}
    whole = consensus._slices_batch(pa.table({**rows, "whole": [True] * 3})).to_pylist()[0]
    part = consensus._slices_batch(pa.table({**rows, "whole": [False] * 3})).to_pylist()[0]
    assert whole["cns"] == "ACGTACGGTTCA" and not whole["base"] and not whole["source"]
    assert part["cns"] is None and len(part["base"]) == 12


def test_overlaps_are_read_and_not_worked_out_again(spark, sf):
    """What later steps ask of an overlap must not reach into the join of the two reads."""
    used = overlaps.usable(fixtures.paf_noisy(fixtures.paf(spark, sf)), 80)
    assert "Join" not in used._jdf.queryExecution().executedPlan().toString()


def test_packed_letters():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 30, 301] * 4:
        for letters in ("ACGT", "ACGTN", "acgtÄ"):
            text = "".join(rng.choice(letters) for _ in range(n))
            held = packed.pack(text)
            assert packed.unpack(held) == text
            start, length = rng.randint(0, n + 3), rng.randint(0, n + 3)
            right = n - start
            left = max(right - length, 0)
            turned = text[left:left + max(right - left, 0)].upper().translate(str.maketrans("ACGT", "TGCA"))[::-1]
            assert packed.cut(held, True, start, length) == text[start:start + length]
            assert packed.cut(held, False, start, length) == turned
    assert len(packed.pack("ACGT" * 100)) == 101


def test_sequences_and_slices_are_shuffled_packed(spark, monkeypatch):
    """Reads meet their places, and slices their blocks, in two bits a letter."""
    layout = spark.createDataFrame([(0, 1, 0, 1, 40, 0), (0, 2, 5, -1, 40, 1)], "contig_id long, read_id long, start long, dir int, len long, rank long")
    reads = spark.createDataFrame([(1, "ACGTC" * 8), (2, "GGTCA" * 8)], "read_id long, seq string")
    rows = blocks.slices(layout, reads, 30, 6)
    assert "packed(" in rows._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    sent, spread = [], consensus.spread
    monkeypatch.setattr(consensus, "spread", lambda df, *keys: sent.append(dict(df.dtypes)) or spread(df, *keys))
    consensus.block_profiles(rows).collect()
    assert [x["piece"] for x in sent] == ["binary"]


def test_stored_blocks_are_not_written_again_and_meet_by_their_ends(spark, monkeypatch):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(700))
    df = spark.createDataFrame([(0, k, genome[200 * k:200 * k + 300]) for k in range(3)], "contig_id long, block long, cns string")
    written, keep, sent, spread = [], stitch.materialise, [], stitch.spread
    monkeypatch.setattr(stitch, "materialise", lambda df, name, *more, **given: written.append(name) or keep(df, name, *more, **given))
    monkeypatch.setattr(stitch, "spread", lambda df, *keys: sent.append(df) or spread(df, *keys))
    pieces = sorted((r.offset, r.seq) for r in stitch.contig_pieces(df, 300, 100, 40, stored=True).collect())
    assert "".join(seq for _, seq in pieces) == genome and "blocks" not in written
    below = sent[0]._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "AS after" in below and not re.search(r"cns#\d+ AS left", below)


def _plain_chain(seq, template, size):
    """Words found one after another in a table of all words, the longest series by trying every end."""
    words = [template[j:j + size] for j in range(len(template) - size + 1)]
    hits, i = [], 0
    while i <= len(seq) - size:
        if words.count(seq[i:i + size]) == 1:
            hits.append((i, words.index(seq[i:i + size])))
            i += size
        else:
            i += 1
    best = [1] * len(hits)
    for k, (_, j) in enumerate(hits):
        best[k] = 1 + max((best[x] for x in range(k) if hits[x][1] < j), default=0)
    return hits, max(best, default=0)


def test_words_are_found_in_runs():
    rng = random.Random(9)
    for _ in range(150):
        genome = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 8, 15, 200])))
        if genome and rng.random() < 0.4:
            genome = genome[:90] + "AC" * 9 + genome[90:]
        seq = list(genome[rng.randrange(len(genome) + 1):] + genome[:rng.choice([0, 0, 40])])
        for _ in range(rng.choice([0, 1, 4])):
            if seq:
                k = rng.randrange(len(seq))
                seq[k:k + rng.choice([0, 1])] = rng.choice(["", "A", "CG", "n", "T"])
        seq = "".join(seq)
        for size in (15, 9):
            chain = poa.word_chain(seq, genome, size)
            hits, longest = _plain_chain(seq, genome, size)
            assert set(chain) <= set(hits) and (len(chain) == longest or any(b[1] - a[1] < size for a in hits for b in hits if a[1] < b[1]))
            assert all(a[0] + size <= b[0] and a[1] + size <= b[1] for a, b in zip(chain, chain[1:]))
            known = poa.Words(genome, size)
            runs = poa.word_runs(poa._bytes(seq), known)
            assert [(i + k, j + k) for i, j, n, _ in runs for k in range(0, n * size, size)] == chain
            assert all(seq[i:stop] == genome[j:j + stop - i] and n * size <= stop - i for i, j, n, stop in runs)


def test_small_tables_are_those_of_arrays(monkeypatch):
    rng = random.Random(10)
    for _ in range(120):
        genome = "".join(rng.choice("ACGT") for _ in range(60))
        copies = [genome[:k] + rng.choice(["", "A", "GT", "C"]) + genome[k + rng.choice([0, 1, 2]):] for k in rng.sample(range(5, 55), 5)]
        made = []
        for few in (poa._FEW, -1):
            monkeypatch.setattr(poa, "_FEW", few)
            made.append(consensus.laid(copies, [1] * 5))
            monkeypatch.undo()
        assert made[0][1] == made[1][1] and all((x == y).all() for x, y in zip(made[0][0].arrays(), made[1][0].arrays(), strict=True))


def test_keys_of_noisy_slices_make_no_pieces(spark, tmp_path):
    rows = fixtures.noisy_slices(spark, _parts(spark, tmp_path, range(20)))
    keys = rows.select("contig_id", "block", "rank", "read_id")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert keys.count() == rows.filter("length(piece) > 0").count() > 20
