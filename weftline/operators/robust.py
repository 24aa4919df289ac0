"""Robust positions by iteratively reweighted least squares with Huber weights.

All components are fitted together as Spark jobs on the slice solver: small ones share
slices, large ones spread over many. Each component stops by its own rounds and tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import ScaleBounds
from weftline.operators.elimination import SliceSolver
from weftline.operators.forest import spanning_forest
from weftline.report import Report, watched
from weftline.session import materialise

_STILL = 10.0  # fixed value: estimates moving less than this have settled
_GATES = {"p99": 0.99, "p95": 0.95}


def exceeds(value, share: float, limit, strict: bool = True):
    """Whether the interpolated percentile is above `limit`, from counts and two extremes.

    Only the order statistics next to the limit matter, so no group is sorted or held.
    """
    below = value <= limit if strict else value < limit
    n, c = F.count(value), F.sum(F.when(below, 1).otherwise(0))
    low, high = F.max(F.when(below, value)), F.min(F.when(~below, value))
    spot = (n - 1) * F.lit(share)
    k = F.floor(spot)
    between = low + (spot - k) * (high - low)
    over = between > limit if strict else between >= limit
    return F.when(c <= k, True).when((c >= k + 2) | (spot == k) | high.isNull(), False).otherwise(over)


def _tree(eq: DataFrame, bounds: ScaleBounds) -> DataFrame:
    """Parts of the equation graph and coordinates along a spanning tree of each."""
    edges = eq.select(F.col("i").alias("u"), F.col("j").alias("v"), F.lit(1.0).alias("w"), F.lit(1).alias("sgn"), F.col("y").alias("shift"))
    return materialise(spanning_forest(edges, bounds.finish_edges), "fit-tree")


class _System:
    """Equations with their tree coordinates, and the slices that solve them."""

    def __init__(self, eq: DataFrame, bounds: ScaleBounds, tree: DataFrame):
        self.places = tree
        a = tree.select(F.col("node").alias("i"), F.col("root").alias("part"), F.col("shift").alias("xi"))
        b = tree.select(F.col("node").alias("j"), F.col("shift").alias("xj"))
        self.solver = SliceSolver(
            tree.select("node", F.col("root").alias("part"), F.col("shift").alias("pos")), bounds.slice_nodes, bounds.finish_rows
        )
        rest = eq.join(a, "i").join(b, "j").withColumn("rest", F.col("y") - (F.col("xj") - F.col("xi"))).drop("xi", "xj")
        # equations learn their slice once and carry it; only weights change between rounds
        self.eq = materialise(self.solver.slices(rest), "fit-equations")
        self.nodes = materialise(
            self.eq.select("component", "part", F.explode(F.array("i", "j")).alias("node")).distinct(), "fit-nodes"
        )

    def solve(self, weighted: DataFrame) -> DataFrame:
        """Corrections to the tree coordinates."""
        return self.solver.solve(weighted.select("slice", "i", "j", F.col("rest").alias("y"), "w"))

    def residuals(self, rows: DataFrame, x: DataFrame) -> DataFrame:
        a = x.select(F.col("node").alias("i"), F.col("x").alias("xi"))
        b = x.select(F.col("node").alias("j"), F.col("x").alias("xj"))
        r = F.col("scale") * F.abs(F.col("rest") - (F.col("xj") - F.col("xi")))
        return rows.drop("r").join(a, "i").join(b, "j").withColumn("r", r).drop("xi", "xj")

    def settled(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """component -> whether 95 % of its estimates moved less than the limit."""
        change = self.nodes.join(before.withColumnRenamed("x", "x0"), "node").join(after, "node").withColumn("d", F.col("x") - F.col("x0"))
        mean = change.groupBy("part").agg(F.avg("d").alias("m"))
        drift = F.abs(F.col("d") - F.col("m"))
        return change.join(mean, "part").groupBy("component").agg(
            exceeds(drift, 0.95, _STILL, strict=False).alias("moving")
        )


def _spread_of(name: str, thr1: float, thr2: float) -> dict:
    """What a report tells of residuals; percentiles are exact up to ten thousand of them."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    shares = {f"{name}_residual_p{int(100 * s)}": F.percentile_approx("r", s, 10_000) for s in (0.5, 0.9, 0.99)}
    return {f"{name}_equations": F.count(F.lit(1)), f"{name}_reweighted": count(F.col("r") > thr1), f"{name}_dropped": count(F.col("r") > thr2), f"{name}_residual_max": F.max("r"), **shares}


def _fit(eq: DataFrame, thr1, thr2, rounds, gate, bounds: ScaleBounds, report: Report | None, name: str) -> DataFrame:
    fit = _System(eq, bounds, _tree(eq, bounds))
    share = _GATES[gate]
    over = exceeds(F.col("r"), share, thr2)
    base = F.col("scale") * F.col("scale")
    x = fit.solve(fit.eq.withColumn("w", base))
    rows = materialise(watched(report, fit.residuals(fit.eq, x), **_spread_of(name, thr1, thr2)), "residuals")
    finished, done = [], 0
    state = rows.groupBy("component").agg(over.alias("over"))
    if gate == "p99":
        state = state.withColumn("over", F.lit(True))  # the read gate always runs one round
    state = materialise(state, "fit-state")
    while True:
        finished.append(rows.join(state.filter("not over"), "component", "left_semi"))
        if done >= rounds or not state.filter("over").limit(1).count():
            finished.append(rows.join(state.filter("over"), "component", "left_semi"))
            break
        rows = rows.join(state.filter("over"), "component", "left_semi")
        weight = F.when(F.col("r") <= thr1, F.lit(1.0)).otherwise(F.lit(thr1) / F.col("r"))
        # components that have finished keep their old equations in the system but are not read again
        idle = fit.eq.join(state.filter("over"), "component", "left_anti").select("slice", "i", "j", "rest", base.alias("w"))
        moved = fit.solve(rows.withColumn("w", weight * base).select("slice", "i", "j", "rest", "w").unionByName(idle))
        fresh = materialise(watched(report, fit.residuals(rows, moved), **_spread_of(name, thr1, thr2)), "residuals")
        judged = rows if gate == "p95" else fresh
        state = materialise(
            judged.groupBy("component").agg(over.alias("above")).join(fit.settled(x, moved), "component")
            .select("component", (F.col("above") & F.col("moving")).alias("over")),
            "fit-state",
        )
        rows, x, done = fresh, moved, done + 1
    if report is not None:
        report.note(**{f"{name}_rounds": done})
    kept = finished[0]
    for more in finished[1:]:
        kept = kept.unionByName(more)
    kept = materialise(kept.filter(F.col("r") <= thr2).select("component", "i", "j", "y", "rest", "scale", "line_no", "slice"), "kept")
    refit = fit
    if kept.count() < fit.eq.count():
        tree = _tree(kept, bounds)
        same = [t.agg(F.count("*"), F.countDistinct("root")).first() for t in (tree, fit.places)]
        # with the parts unchanged the slices still serve; otherwise they are drawn anew
        refit = fit if same[0] == same[1] else _System(kept.drop("rest", "slice"), bounds, tree)
    source = kept if refit is fit else refit.eq
    dx = refit.solve(source.withColumn("w", F.lit(1.0)))
    return refit.places.join(dx, "node").join(refit.nodes.select("component", "node"), "node").select(
        "component", F.col("root").alias("layout"), "node", F.rint(F.col("shift") + F.col("x")).cast("long").alias("x")
    )


def robust_fit(eq: DataFrame, thr1: float, thr2: float, rounds: int, gate: str = "p99", bounds: ScaleBounds = ScaleBounds(),
               report: Report | None = None, name: str = "fit") -> DataFrame:
    """equations(component, i, j, y, scale, line_no) -> (component, layout, node, x).

    `layout` is the smallest node of each part that stays connected once equations with
    residuals above `thr2` are gone; it sits at x = 0. Nodes left without an equation
    do not appear. Scales other than 1 are divided by their component mean. A report learns
    rounds, residuals of the last round and how many nodes were placed, under `name`.
    """
    means = eq.groupBy("component").agg(F.avg("scale").alias("mean_scale"))
    rows = eq.join(means, "component").withColumn("scale", F.col("scale") / F.col("mean_scale"))
    rows = materialise(rows.select("component", "i", "j", "y", "scale", "line_no"), "fit-rows")
    if rows.isEmpty():
        return rows.select("component", F.col("i").alias("layout"), F.col("i").alias("node"), F.col("i").alias("x"))
    return materialise(watched(report, _fit(rows, thr1, thr2, rounds, gate, bounds, report, name), **{f"{name}_placed": F.count(F.lit(1))}), "positions")
