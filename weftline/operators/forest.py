"""Maximum spanning forest that carries relative signs and shifts.

One operator serves three needs: connected components, spanning-tree orientation
(signs multiply along the tree) and starting coordinates (shifts add along it). Each
round every tree picks its best outgoing edge, trees merge, and edges are rewritten
onto the merged roots, so the edge list shrinks geometrically. Once the rest is known
to be small one task finishes it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise

_MAP = "node long, parent long, sgn int, shift double"


def _heaviest_key():
    """Strict order on edges: heavier wins; among equals a hash keeps trees shallow."""
    return [F.col("w"), F.xxhash64("eu", "ev"), -F.col("eu"), -F.col("ev")]


def _one_per_pair(edges: DataFrame) -> DataFrame:
    best = F.max(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_heaviest_key())], "sgn", "shift"))
    return edges.groupBy("u", "v").agg(best.alias("m")).select(
        "u", "v", F.col("m.k0").alias("w"), (-F.col("m.k2")).alias("eu"), (-F.col("m.k3")).alias("ev"),
        "m.sgn", "m.shift",
    )


def _canonical(edges: DataFrame) -> DataFrame:
    """u < v; turning an edge keeps its sign and negates its shift."""
    turn = F.col("u") > F.col("v")
    return edges.select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w", "eu", "ev", "sgn",
        F.when(turn, -F.col("shift")).otherwise(F.col("shift")).alias("shift"),
    )


def best_choice(edges: DataFrame) -> DataFrame:
    """Per root its best edge, from partial aggregates over both directions."""
    key = [c.alias(f"k{i}") for i, c in enumerate(_heaviest_key())]
    there = edges.select(F.col("u").alias("node"), F.struct(*key, F.col("v").alias("to"), "sgn", "shift").alias("c"))
    back = edges.select(
        F.col("v").alias("node"),
        F.struct(*key, F.col("u").alias("to"), "sgn", (-F.col("shift")).alias("shift")).alias("c"),
    )
    return there.unionByName(back).groupBy("node").agg(F.max("c").alias("c")).select(
        "node", F.col("c.to").alias("to"), F.col("c.k2").alias("k1"), F.col("c.k3").alias("k2"),
        F.col("c.sgn").alias("sgn"), F.col("c.shift").alias("shift"),
    )


def hook(choice: DataFrame) -> DataFrame:
    """Parents: the chosen neighbour, except that of two mutual choices the smaller is root."""
    other = choice.select(
        F.col("node").alias("to"), F.col("to").alias("back"), F.col("k1").alias("o1"), F.col("k2").alias("o2")
    )
    is_root = (
        (F.col("back") == F.col("node")) & (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2"))
        & (F.col("node") < F.col("to"))
    )
    return choice.join(other, "to").select(
        "node",
        F.when(is_root, F.col("node")).otherwise(F.col("to")).alias("parent"),
        F.when(is_root, 1).otherwise(F.col("sgn")).cast("int").alias("sgn"),
        F.when(is_root, 0.0).otherwise(-F.col("shift")).alias("shift"),
    )


def follow(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Compose child->parent with parent->grandparent; a parent without entry stays."""
    up = parents.select(
        F.col("node").alias("parent"), F.col("parent").alias("_p"), F.col("sgn").alias("_s"), F.col("shift").alias("_d")
    )
    return children.join(up, "parent", "left").select(
        "node",
        F.coalesce("_p", "parent").alias("parent"),
        (F.col("sgn") * F.coalesce("_s", F.lit(1))).cast("int").alias("sgn"),
        (F.col("shift") + F.coalesce("_d", F.lit(0.0))).alias("shift"),
        (F.coalesce("_p", "parent") != F.col("parent")).alias("moved"),
    )


def flatten(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at its root."""
    while True:
        jumped = materialise(follow(parents, parents), "forest-jump")
        parents = jumped.drop("moved")
        if not jumped.filter("moved").limit(1).count():
            return parents


def _rewrite(edges: DataFrame, parents: DataFrame) -> DataFrame:
    pu = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"), F.col("sgn").alias("su"), F.col("shift").alias("du"))
    pv = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"), F.col("sgn").alias("sv"), F.col("shift").alias("dv"))
    moved = edges.join(pu, "u").join(pv, "v").filter("pu <> pv").select(
        F.col("pu").alias("u"), F.col("pv").alias("v"), "w", "eu", "ev",
        (F.col("sgn") * F.col("su") * F.col("sv")).cast("int").alias("sgn"),
        (F.col("shift") + F.col("du") - F.col("dv")).alias("shift"),
    )
    return _one_per_pair(_canonical(moved))


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge the remaining, bounded edge list, best edge first."""
    pdf = pdf.sort_values(["w", "h", "eu", "ev"], ascending=[False, False, True, True])
    up: dict[int, tuple[int, int, float]] = {}

    def find(n):
        path, sgn, shift = [], 1, 0.0
        while up.setdefault(n, (n, 1, 0.0))[0] != n:
            path.append(n)
            n = up[n][0]
        for node in reversed(path):
            parent, s, d = up[node]
            if parent != n:
                s, d = s * up[parent][1], d + up[parent][2]
                up[node] = (n, s, d)
        return n

    for u, v, sgn, shift in zip(pdf.u.tolist(), pdf.v.tolist(), pdf.sgn.tolist(), pdf["shift"].tolist()):
        ru, rv = find(u), find(v)
        if ru != rv:
            up[rv] = (ru, up[u][1] * up[v][1] * sgn, up[u][2] + shift - up[v][2])
    rows = []
    for node in list(up):
        root = find(node)
        rows.append((node, root, up[node][1], up[node][2]))
    return pd.DataFrame(rows, columns=["node", "parent", "sgn", "shift"])


def spanning_forest(edges: DataFrame, finish_edges: int = 50_000) -> DataFrame:
    """edges(u, v, w, sgn, shift) -> (node, root, sgn, shift).

    An edge states sign(v) = sgn * sign(u) and x(v) = x(u) + shift. The result is
    relative to `root`, the smallest node of each component. Shifts are meaningful only
    where all signs are +1.
    """
    start = edges.filter("u <> v").select(
        "u", "v", "w", F.least("u", "v").alias("eu"), F.greatest("u", "v").alias("ev"),
        F.col("sgn").cast("int").alias("sgn"), F.col("shift").cast("double").alias("shift"),
    )
    rest = materialise(_one_per_pair(_canonical(start)), "forest-edges")
    left, maps = rest.count(), []
    while left > finish_edges:
        parents = flatten(materialise(hook(materialise(best_choice(rest), "forest-choice")), "forest-hook"))
        maps.append(parents)
        rest = materialise(_rewrite(rest, parents), "forest-edges")
        left = rest.count()
    if left or not maps:
        maps.append(rest.withColumn("h", F.xxhash64("eu", "ev")).groupBy().applyInPandas(_finish, _MAP))
    final = maps.pop()
    while maps:
        final = follow(maps.pop(), final).drop("moved")
    final = materialise(final, "forest")
    anchor = final.groupBy("parent").agg(F.min(F.struct("node", "sgn", "shift")).alias("a"))
    return final.join(anchor, "parent").select(
        "node", F.col("a.node").alias("root"),
        (F.col("sgn") * F.col("a.sgn")).cast("int").alias("sgn"),
        (F.col("shift") - F.col("a.shift")).alias("shift"),
    )


def _finish_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the remaining, bounded edge list that join two trees, best edge first."""
    pdf = pdf.sort_values(["w", "h", "eu", "ev"], ascending=[False, False, True, True])
    up: dict[int, int] = {}
    rows = []
    for u, v, eu, ev in zip(pdf.u.tolist(), pdf.v.tolist(), pdf.eu.tolist(), pdf.ev.tolist()):
        while up.setdefault(u, u) != u:
            up[u] = up[up[u]]
            u = up[u]
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        if u != v:
            up[v] = u
            rows.append((eu, ev))
    return pd.DataFrame(rows, columns=["u", "v"], dtype="int64")


def spanning_links(edges: DataFrame, finish_edges: int = 50_000) -> DataFrame:
    """edges(u, v, w) -> the links (u, v, w) of the heaviest spanning forest, u < v, each once.

    The same forest as `spanning_forest` goes along; a pair that occurs more than once has
    its heaviest link.
    """
    start = edges.filter("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w", F.least("u", "v").alias("eu"), F.greatest("u", "v").alias("ev"),
        F.lit(1).alias("sgn"), F.lit(0.0).alias("shift"),
    )
    whole = rest = materialise(_one_per_pair(start), "forest-edges")
    left, chosen = rest.count(), []
    while left > finish_edges:
        choice = materialise(best_choice(rest), "forest-choice")
        chosen.append(choice.select((-F.col("k1")).alias("u"), (-F.col("k2")).alias("v")))
        rest = materialise(_rewrite(rest, flatten(materialise(hook(choice), "forest-hook"))), "forest-edges")
        left = rest.count()
    if left or not chosen:
        chosen.append(rest.withColumn("h", F.xxhash64("eu", "ev")).groupBy().applyInPandas(_finish_links, "u long, v long"))
    links = chosen[0]
    for more in chosen[1:]:
        links = links.unionByName(more)
    return links.distinct().join(whole.select("u", "v", "w"), ["u", "v"]).select("u", "v", "w")


def connected_components(edges: DataFrame, finish_edges: int = 50_000) -> DataFrame:
    """edges(u, v) -> (node, root) with the smallest node as root."""
    plain = edges.select("u", "v", F.lit(1.0).alias("w"), F.lit(1).alias("sgn"), F.lit(0.0).alias("shift"))
    return spanning_forest(plain, finish_edges).select("node", "root")


def oriented_from(facing: DataFrame, node: int) -> DataFrame:
    """The component of `node` only, turned so that `node` has direction +1."""
    start = facing.filter(F.col("node") == node).select("root", F.col("dir").alias("_turn"))
    return facing.join(start, "root").withColumn("dir", (F.col("dir") * F.col("_turn")).cast("int")).drop("_turn")


def spanning_orientation(links: DataFrame, min_strength: float, finish_edges: int = 50_000) -> DataFrame:
    """links(u, v, strength, sgn) -> (node, root, dir) along the strongest tree.

    Links whose votes cancel say nothing about direction and are left out.
    """
    strong = links.filter((F.col("strength") > min_strength) & (F.col("sgn") != 0)).select(
        "u", "v", F.col("strength").cast("double").alias("w"), "sgn", F.lit(0.0).alias("shift")
    )
    return spanning_forest(strong, finish_edges).select("node", "root", F.col("sgn").alias("dir"))
