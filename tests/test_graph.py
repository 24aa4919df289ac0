"""Spanning forest, orientation and the regression against plain re-computations."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.config import AssemblyConfig, ScaleBounds
from weftline.operators import elimination, forest, orient, overlaps, quantiles, robust, tree_walk


def _random_graph(seed, n=60, m=90):
    rng = random.Random(seed)
    truth = {v: (rng.choice((-1, 1)), rng.randint(0, 999)) for v in range(n)}
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return truth, [(u, v, float(w)) for w, (u, v) in enumerate(rng.sample(sorted(pairs), len(pairs)))]


@pytest.mark.parametrize("bound", [0, 100_000])
def test_forest_matches_kruskal(spark, bound):
    truth, pairs = _random_graph(bound)
    rng = random.Random(5)
    rows = [(u, v, w, rng.choice((-1, 1)), float(rng.randint(-50, 50))) for u, v, w in pairs]
    got = {r.node: r for r in forest.spanning_forest(spark.createDataFrame(rows, "u long, v long, w double, sgn int, shift double"), bound).collect()}
    # Kruskal with whole label maps
    group = {v: {v} for u, v, *_ in rows} | {u: {u} for u, *_ in rows}
    near = defaultdict(list)
    for u, v, w, s, d in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if group[u] is not group[v]:
            joined = group[u] | group[v]
            for x in joined:
                group[x] = joined
            near[u].append((v, s))
            near[v].append((u, s))
    want = {}
    for node in group:
        root = min(group[node])
        if node == root:
            stack, want[root] = [root], 1
            while stack:
                x = stack.pop()
                for y, s in near[x]:
                    if y not in want:
                        want[y] = want[x] * s
                        stack.append(y)
    assert {n: (r.root, r.sgn) for n, r in got.items()} == {n: (min(group[n]), want[n]) for n in group}


@pytest.mark.parametrize("bound", [0, 100_000])
def test_forest_shifts_follow_true_positions(spark, bound):
    truth, pairs = _random_graph(3)
    rows = [(u, v, w, 1, float(truth[v][1] - truth[u][1])) for u, v, w in pairs]
    got = forest.spanning_forest(spark.createDataFrame(rows, "u long, v long, w double, sgn int, shift double"), bound).collect()
    for r in got:
        assert r.shift == truth[r.node][1] - truth[r.root][1]


def test_orientation_outvotes_wrong_signs(spark, sf):
    """Every read ends in its true direction, and no read's links contradict it."""
    from workload import fixtures as fx
    from workload import catalog

    used = catalog._flipped_votes(catalog._used(spark, sf))
    edges = overlaps.orientation_edges(used)
    facing = orient.orient_reads(used, edges).collect()
    strand = {r.read_id: r.dir for r in fx.true_orientation(spark, sf).collect()}
    entry = {r.node: r.seen for r in orient.first_seen(used).collect()}
    assert {r.component for r in facing} == {max(entry, key=entry.get)} and len(facing) == len(entry)
    seed = facing[0].component
    assert {r.read_id: r.dir for r in facing} == {n: strand[n] * strand[seed] for n in entry}
    plain = {(r.u, r.v): r.sw for r in edges.collect()}
    facing, support = {r.read_id: r.dir for r in facing}, defaultdict(int)
    for (u, v), w in plain.items():
        support[u] += w * facing[u] * facing[v]
        support[v] += w * facing[u] * facing[v]
    assert min(support.values()) >= 0


@pytest.mark.parametrize("seed", range(3))
def test_turning_ends_without_contradiction(spark, seed):
    """On graphs without any truth no read may want to turn at the end; a tie has support 0."""
    rng = random.Random(seed)
    rows = [(u, v, rng.choice((-1, 1)) * rng.randint(1, 4)) for u in range(25) for v in range(u) if rng.random() < 0.3] + [(100, 101, 5), (200, 201, 3), (200, 202, 2), (201, 202, -2)]
    edges = spark.createDataFrame(rows, "u long, v long, sw long")
    got = {r.node: r for r in orient.settled(orient.voted_signs(edges), edges).collect()}
    support = defaultdict(int)
    for u, v, w in rows:
        for n in (u, v):
            support[n] += w * got[u].sgn * got[v].sgn
    assert {n: r.support for n, r in got.items()} == dict(support) and min(support.values()) >= 0 and support[202] == 0


def test_vote_ties_leave_no_direction(spark):
    rows = spark.createDataFrame([(1, 2, 5), (1, 2, -5), (2, 3, 4)], "u long, v long, sw long")
    votes = overlaps.vote_sums(rows, ["u", "v"])
    got = {r.node for r in forest.spanning_orientation(votes, 0).collect()}
    assert got == {2, 3}


def _line_system(seed=1, n=150):
    """Noisy positions along a line plus long-range false equations, in two components."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for c in (0, 1):
        base = c * 1000
        for k in range(n):
            truth[base + k] = 100 * k + rng.randint(0, 40)
        for k in range(n):
            for d in range(1, 6):
                if k + d < n:
                    y = truth[base + k + d] - truth[base + k] + rng.randint(-3, 3)
                    rows.append((c, base + k, base + k + d, float(y), 1.0, len(rows)))
        for _ in range(n // 12):
            i, j = sorted(rng.sample(range(n), 2))
            rows.append((c, base + i, base + j, float(truth[base + j] - truth[base + i] + 4000), 1.0, len(rows)))
    return truth, rows


SCHEMA = "component long, i long, j long, y double, scale double, line_no long"


def _lstsq(rows, weights=None):
    nodes = sorted({r[1] for r in rows} | {r[2] for r in rows})
    at = {v: k for k, v in enumerate(nodes)}
    a = np.zeros((len(rows), len(nodes)))
    for k, r in enumerate(rows):
        a[k, at[r[2]]], a[k, at[r[1]]] = 1, -1
    y = np.array([r[3] for r in rows])
    w = np.sqrt(np.ones(len(rows)) if weights is None else weights)
    x = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
    return nodes, x, np.abs(a @ x - y)


@pytest.mark.parametrize("size,finish", [(32, 200_000), (32, 0), (64, 300), (5000, 0)])
def test_slices_solve_exactly(spark, size, finish):
    _, rows = _line_system()
    eq = spark.createDataFrame(rows, SCHEMA)
    order = eq.select(F.explode(F.array("i", "j")).alias("node")).distinct().select(
        "node", F.when(F.col("node") < 1000, 0).otherwise(1000).cast("long").alias("part"), F.col("node").cast("double").alias("pos")
    )
    solver = elimination.SliceSolver(order, size, finish)
    for weights in (lambda r: 1.0, lambda r: 1.0 + r[5] % 3):
        frame = spark.createDataFrame([(r[1], r[2], r[3], weights(r)) for r in rows], "i long, j long, y double, w double")
        got = {r.node: r.x for r in solver.solve(frame).collect()}
        for c in (0, 1):
            part = [r for r in rows if r[0] == c]
            nodes, x, _ = _lstsq(part, [weights(r) for r in part])
            assert np.allclose([got[v] for v in nodes], x - x[0], atol=1e-6)


@pytest.mark.parametrize("reach", [3, 400])
def test_a_bounded_system_is_solved_box_by_box(reach):
    """Narrow systems go by boxes, wide ones have none and are iterated; both match dense least squares."""
    rng = np.random.default_rng(reach)
    n = 900
    u = np.concatenate([np.arange(n - 1), rng.integers(0, n, 4 * n)])
    v = np.concatenate([np.arange(1, n), np.minimum(n - 1, u[n - 1:] + rng.integers(1, reach + 1, 4 * n))])
    u, v = u[u != v], v[u != v]
    w, rhs, fixed = rng.random(len(u)) + 0.1, rng.standard_normal(n), np.zeros(n, bool)
    fixed[[0, 450]] = True
    full = elimination.dense_laplacian(n, u, v, w)[np.ix_(~fixed, ~fixed)]
    for width, widest in ((32, 64), (256, 4096)):
        x = elimination.solve_along(u, v, w, rhs, fixed, width, widest)
        assert np.allclose(x[~fixed], np.linalg.solve(full, rhs[~fixed]), atol=1e-7) and not x[fixed].any()


def test_conjugate_gradient_agrees(spark):
    _, rows = _line_system(n=12)
    frame = spark.createDataFrame([(r[1], r[2], r[3], 1.0) for r in rows], "i long, j long, y double, w double")
    edges, rhs = elimination.normal_form(frame)
    parts = rhs.select("node", F.when(F.col("node") < 1000, 0).otherwise(1000).cast("long").alias("part"))
    got = {r.node: r.x for r in elimination.conjugate_gradient(edges, rhs, parts, tolerance=1e-9).collect()}
    for c in (0, 1):
        nodes, x, _ = _lstsq([r for r in rows if r[0] == c])
        assert np.allclose([got[v] for v in nodes], x - x[0], atol=1e-3)


def _plain_huber(rows, thr1, thr2, rounds, gate):
    nodes, x, r = _lstsq(rows)
    share = {"p99": 99, "p95": 95}[gate]
    level = thr2 + 10 if gate == "p99" else np.percentile(r, share)
    n = 0
    while n < rounds and level > thr2:
        if gate == "p95":
            level = np.percentile(r, share)
        w = np.where(r > thr1, thr1 / r, 1)
        _, x2, r = _lstsq(rows, w)
        if gate == "p99":
            level = np.percentile(r, share)
        moved = np.percentile(np.abs(x2 - x), 95)
        x = x2
        if moved < 10:
            break
        n += 1
    good = [row for row, e in zip(rows, r) if e <= thr2]
    nodes, x, _ = _lstsq(good)
    return {v: p - x[0] for v, p in zip(nodes, x)}, len(good)


@pytest.mark.parametrize(
    "gate,thr1,thr2,bounds",
    [
        ("p99", 20.0, 80.0, ScaleBounds()),
        ("p95", 20.0, 60.0, ScaleBounds()),
        ("p99", 20.0, 80.0, ScaleBounds(slice_nodes=64, finish_edges=50)),
        ("p99", 20.0, 80.0, ScaleBounds(slice_nodes=64, finish_edges=50, finish_rows=0)),
    ],
)
def test_robust_fit(spark, gate, thr1, thr2, bounds):
    """Few and many slices both follow the plain iteration."""
    _, rows = _line_system(7, 50)
    got = {r.node: r.x for r in robust.robust_fit(spark.createDataFrame(rows, SCHEMA), thr1, thr2, 50, gate, bounds).collect()}
    for c in (0, 1):
        want, _ = _plain_huber([r for r in rows if r[0] == c], thr1, thr2, 50, gate)
        assert max(abs(got[v] - want[v]) for v in want) <= 1


def test_fit_is_translation_free_and_splits_parts(spark):
    rows = [(5, 1, 2, 10.0, 1.0, 0), (5, 2, 3, 5.0, 1.0, 1), (5, 8, 9, -4.0, 1.0, 2)]
    got = {(r.layout, r.node): r.x for r in robust.robust_fit(spark.createDataFrame(rows, SCHEMA), 200.0, 800.0, 5).collect()}
    assert got == {(1, 1): 0, (1, 2): 10, (1, 3): 15, (8, 8): 0, (8, 9): -4}


@pytest.mark.parametrize("limit", [10.0, 40.0, 49.4, 49.5, 49.6, 70.0])
@pytest.mark.parametrize("strict", [True, False])
def test_percentile_comparison(spark, limit, strict):
    for values in ([float(v) for v in range(100)], [10.0] * 60 + [70.0] * 40, [3.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for share in (0.5, 0.95, 0.99):
            got = df.agg(robust.exceeds(F.col("v"), share, limit, strict)).first()[0]
            exact = np.percentile(values, share * 100)
            assert got == (exact > limit if strict else exact >= limit)


def test_quantiles_with_heavy_ties(spark):
    rng = random.Random(2)
    rows = [(g, float(0 if rng.random() < 0.4 else rng.randint(0, 50))) for g in (1, 2) for _ in range(301)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "g int, v double"), "g", "v", [0.5, 0.9, 0.95, 0.99]).collect()
    assert len(got) == 8
    for r in got:
        assert abs(r.v - np.percentile([v for g, v in rows if g == r.g], r.share * 100)) < 1e-9


def _links(kind, n=240):
    if kind == "star":
        return [(0, k, 5 + k % 3) for k in range(1, n)]
    if kind == "rising path":
        return [(k, k + 1, k + 1) for k in range(n - 1)]
    return [(k, k + d, 13 - d) for k in range(n) for d in range(1, 13) if k + d < n]


@pytest.mark.parametrize("kind", ["star", "rising path", "overlap chain"])
def test_votes_merge_in_logarithmic_rounds(spark, monkeypatch, kind):
    n, rng = 240, random.Random(4)
    truth = [rng.choice((-1, 1)) for _ in range(n)]
    rows = [(u, v, w * truth[u] * truth[v]) for u, v, w in _links(kind, n)]
    u, v, sw = (np.array(x) for x in zip(*rows))
    nodes, sets, sign, rounds = orient.merge_all(u, v, sw.astype(float))
    assert len(set(sets.tolist())) == 1 and [sign[0] * s for s in sign] == [truth[0] * t for t in truth]
    assert rounds <= 30
    big = _links(kind, 20 * n)
    assert orient.merge_all(*(np.array(x) for x in zip(*[(a, b, float(c)) for a, b, c in big])))[3] <= rounds + 20
    made = []
    keep = orient.materialise
    monkeypatch.setattr(orient, "materialise", lambda df, name: made.append(name) or keep(df, name))
    got = {r.node: r.sgn for r in orient.voted_signs(spark.createDataFrame(rows, "u long, v long, sw long"), 150).collect()}
    assert got == {k: truth[0] * truth[k] for k in range(n)}
    assert made.count("vote-pairs") <= rounds


@pytest.mark.parametrize("seed", range(3))
def test_divided_reads_match_a_greedy_choice(spark, seed):
    rng = random.Random(seed)
    rows = [(u, v, rng.choice((-1, 1, 1)) * rng.randint(1, 5)) for u in range(30) for v in range(u) if rng.random() < 0.3]
    edges = spark.createDataFrame(rows, "u long, v long, sw long")
    signs = orient.settled(orient.voted_signs(edges), edges).collect()
    sgn = {r.node: r.sgn for r in signs}
    left, want, weight = list(rows), [], defaultdict(int)
    for u, v, w in rows:
        weight[u] += abs(w)
        weight[v] += abs(w)
    while True:
        against = defaultdict(int)
        for u, v, w in left:
            for n in (u, v):
                against[n] += abs(w) * (w * sgn[u] * sgn[v] < 0)
        stand = [(-against[n], n) for n in weight if against[n] and against[n] >= 0.3 * weight[n]]
        if not stand:
            break
        a, n = min(stand)
        want.append((n, -a, weight[n]))
        left = [r for r in left if n not in r[:2]]
    got = orient.divided(spark.createDataFrame(signs), edges, 0.3).collect()
    assert want and sorted((r.node, r.against, r.weight) for r in got) == sorted(want)


def test_a_read_set_aside_has_no_direction(spark):
    """Read 50 is turned half-way: its links to the right contradict those to the left."""
    rows = [(k, k + d, 10 * (-1 if 50 == k else 1)) for k in range(100) for d in range(1, 6) if k + d < 100]
    edges = spark.createDataFrame(rows, "u long, v long, sw long")
    over = spark.createDataFrame([(i, u, v) for i, (u, v, _) in enumerate(rows)], "line_no long, a long, b long")
    for share, want in ((0.25, set(range(100)) - {50}), (None, set(range(100)))):
        got = {r.read_id: r.dir for r in orient.orient_reads(over, edges, AssemblyConfig(divided_share=share)).collect()}
        assert set(got) == want and {d for k, d in got.items() if k != 50} == {1}


@pytest.mark.parametrize("bound", [0, 10_000])
def test_walk_order(spark, bound):
    rng = random.Random(9)
    rows = [(v, rng.randrange(max(0, v - 40), v), float(rng.randint(1, 4))) for v in range(1, 120)]
    rows += [(1000 + v, 1000, 2.0) for v in range(1, 40)] + [(3000, 3001, 1.0)] + [(5000 + k, 5000 + (k + 1) % 5, 1.0 + k) for k in range(5)]
    near = defaultdict(list)
    for u, v, w in rows:
        if (u, v) != (5000, 5001):  # the lightest of the circle is not in the tree
            near[u].append((-w, v))
            near[v].append((-w, u))
    want = {9999: 0}
    for root in (17, 1003, 3001, 5002):
        stack, met, at = [root], {root}, 0
        while stack:
            node = stack.pop()
            want[node], at = at, at + 1
            for _, other in sorted(near[node]):
                if other not in met:
                    met.add(other)
                    stack.append(other)
    edges = spark.createDataFrame(rows, "u long, v long, w double")
    roots = spark.createDataFrame([(r,) for r in (17, 1003, 3001, 5002, 9999)], "node long")
    got = {r.node: r.visit for r in tree_walk.walk_order(edges, roots, bound).collect()}
    assert got == want


@pytest.mark.parametrize("width", [1, 7, 60, 400])
def test_ordered_blocks_solve_like_the_whole_matrix(monkeypatch, width):
    rng, n = np.random.default_rng(width), 700
    u = np.concatenate([np.arange(n - 1), rng.integers(0, n - width, 2000)])
    v = np.concatenate([np.arange(1, n), u[n - 1:] + rng.integers(1, width + 1, 2000)])
    matrix = elimination.dense_laplacian(n, u, v, rng.random(len(u)) + 0.1)[1:, 1:]
    sides = rng.normal(size=(n - 1, 5))
    true, solve, sizes = np.linalg.solve(matrix, sides), np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: sizes.append(len(a)) or solve(a, b))
    assert np.allclose(elimination.solve_ordered(matrix, sides), true, rtol=1e-8, atol=1e-8)
    assert np.allclose(elimination.solve_ordered(matrix, sides[:, 0]), true[:, 0], rtol=1e-8, atol=1e-8)
    assert max(sizes) == (n - 1 if width == 400 else max(width, 32))


def test_slices_stand_in_genome_order(monkeypatch):
    """Ids that say nothing of the place still give narrow matrices."""
    rng, n, reach = np.random.default_rng(3), 600, 6
    ids = rng.permutation(10**6)[:n]
    i = np.repeat(np.arange(n - reach), reach)
    j = i + np.tile(np.arange(1, reach + 1), n - reach)
    edges = pd.DataFrame({"kind": 0, "i": ids[i], "j": ids[j], "w": 1.0, "y": 10.0 * (j - i)})
    nodes = pd.DataFrame({"kind": 1, "i": ids, "j": (np.arange(n) == 0).astype(int), "w": float(ids[0]), "y": 10.0 * np.arange(n)})
    known = pd.DataFrame({"kind": 2, "i": ids[:1], "j": 1, "w": np.nan, "y": [5.0]})
    solve, sizes = np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: sizes.append(len(a)) or solve(a, b))
    rows = pd.concat([edges, nodes]).sample(frac=1, random_state=1)
    got = elimination._fill_slice(pd.concat([rows, known])).set_index("node").x
    held = got[ids[:n - reach]].to_numpy()
    assert np.allclose(held, 5 + 10.0 * np.arange(n - reach))
    assert max(sizes) <= 32
    left = elimination._condense_slice(rows)
    assert left[left.kind == 1].i.tolist() == [ids[0]] and not (left.kind == 0).any()
