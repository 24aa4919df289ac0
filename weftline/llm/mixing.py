"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Documents hang in a tree domain > language > source. Weights are whole numbers per node,
relative to its siblings. The token budget is divided from the root down: siblings share
in proportion to their weights, none beyond what its subtree can give (its tokens times
`max_epochs`), and what a full one leaves is shared among the others. As a subtree is
only short when all its leaves are full, shortages are made up by siblings first and reach
the next ancestor only then.

A leaf takes its budget from consecutive epochs. Every epoch orders the leaf's documents
by a seeded hash; full epochs give every document once, and the last one gives the prefix
that fits the rest of the budget. Where that prefix ends is found by counting tokens in
bins of the hash's leading digits, level by level, so a leaf of any size is never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.session import materialise

LEVELS = ("domain", "lang", "source")
DIGITS = (2, 2, 2)          # hexadecimal digits fixed per search level
BROADCAST_LEAVES = 100_000  # a leaf table up to this size travels to every task


def token_count(text):
    """Words between ASCII white space."""
    spaced = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D\x20]+", " ")
    trimmed = F.trim(spaced)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) + 1).cast("long")


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes(parent..., weight, capacity, given) -> with `budget`, whole tokens.

    `given` is the parent's budget, equal for siblings. The fullest siblings (capacity by
    weight) are served first: a node whose capacity is at most its share of what is left
    is full. A node of weight 0 gets nothing. Fractions of tokens are not given out.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc(), *[F.col(c).asc_nulls_first() for c in nodes.columns if c.startswith("node_")])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    live = nodes.filter("weight > 0").withColumns({
        "_left": F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "_weights": F.sum("weight").over(after),
    })
    full = live.withColumn("_full", F.col("capacity") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    numbered = full.withColumn("_at", F.row_number().over(order))
    rate = F.min(F.when(~F.col("_full"), F.struct("_at", "_left", "_weights"))).over(Window.partitionBy(*parent))
    rated = numbered.withColumn("_rate", rate)
    part = F.expr("_rate._left * weight div _rate._weights")
    budget = F.when(F.col("_rate").isNull() | (F.col("_at") < F.col("_rate._at")), F.col("capacity")).otherwise(part)
    return rated.withColumn("budget", budget.cast("long")).drop("_left", "_weights", "_full", "_at", "_rate")


def leaf_budgets(leaves: DataFrame, weights: dict, budget: int, max_epochs: int, levels=LEVELS) -> DataFrame:
    """leaves(levels..., tokens) -> with `budget`, at most max_epochs * tokens each.

    `weights` maps a level to {value: weight}; values not listed weigh `default` of the
    level's map (key None) or 1.
    """
    nodes = [F.col(c).alias("node_" + c) for c in levels]
    tree = leaves.select(*nodes, "tokens", (F.col("tokens") * max_epochs).alias("capacity"))
    given = None
    for depth, level in enumerate(levels):
        path, above = ["node_" + c for c in levels[:depth + 1]], ["node_" + c for c in levels[:depth]]
        here = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        known = weights.get(level, {})
        weight = F.lit(int(known.get(None, 1)))
        for value, number in known.items():
            if value is not None:
                weight = F.when(F.col(path[-1]) == value, int(number)).otherwise(weight)
        here = here.withColumn("weight", weight)
        if given is None:
            here = here.withColumn("given", F.lit(int(budget)))
        else:
            on = [here[c].eqNullSafe(given["up_" + c]) for c in above]
            here = here.join(given, on).drop(*["up_" + c for c in above])
        shared = share_out(here, above or ["given"])
        given = shared.select(*[F.col(c).alias("up_" + c) for c in path], F.col("budget").alias("given"))
    tokens = tree.select(*["node_" + c for c in levels], "tokens")
    on = [tokens["node_" + c].eqNullSafe(given["up_node_" + c]) for c in levels]
    return tokens.join(given, on, "left").select(*[F.col("node_" + c).alias(c) for c in levels], "tokens", F.coalesce("given", F.lit(0)).cast("long").alias("budget"))


def _prefix_ends(rows: DataFrame, leaves: DataFrame, max_digits=DIGITS) -> DataFrame:
    """rows(leaf, h, tokens), leaves(leaf, rest) -> (leaf, last): greatest hash that still fits.

    Hashes up to `last` hold at most `rest` tokens and the next document would exceed it.
    Each level totals bins of a few digits inside the bin where the prefix ends.
    """
    front, length = leaves.select("leaf", "rest", F.lit("").alias("path"), F.lit(0).cast("long").alias("done")), 0
    for digits in max_digits:
        inside = rows.join(_small(front), "leaf").filter(F.substring("h", 1, length) == F.col("path") if length else F.lit(True))
        length += digits
        bins = inside.groupBy("leaf", "rest", "done", F.substring("h", 1, length).alias("path")).agg(F.sum("tokens").alias("n"))
        upto = Window.partitionBy("leaf").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
        ran = bins.withColumn("run", F.col("done") + F.sum("n").over(upto))
        front = materialise(
            ran.filter("run > rest").groupBy("leaf").agg(F.min_by(F.struct("path", "rest", (F.col("run") - F.col("n")).alias("done")), "path").alias("x"))
            .select("leaf", "x.rest", "x.path", "x.done"), "mix-front"
        )
    inside = rows.join(_small(front), "leaf").filter(F.substring("h", 1, length) == F.col("path"))
    upto = Window.partitionBy("leaf").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("run", F.col("done") + F.sum("tokens").over(upto)).filter("run <= rest")
    last = fits.groupBy("leaf").agg(F.max("h").alias("last"))
    ends = front.join(last, "leaf", "left").select("leaf", F.coalesce("last", "path").alias("last"))  # the bare path precedes every hash in it
    return leaves.join(ends, "leaf", "left").select("leaf", F.coalesce("last", F.lit("g")).alias("last"))  # no end: all fits


def _small(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def chosen(docs: DataFrame, weights: dict, share: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: int = 9, key: str = "doc_id", text: str = "text", domain=None, levels=LEVELS) -> tuple[DataFrame, str]:
    """docs with a column of how often each row is taken (0 to max_epochs), and its name.

    `share` (numerator, denominator) times all tokens is the budget. `domain` is an
    expression for the first level, which documents do not carry; by default the first
    four characters of the source. Nulls are tree values of their own. A document's hash
    covers seed, epoch, key and text, so rows that repeat both are taken or left together.
    """
    domain = F.substring("source", 1, 4) if domain is None else domain
    path = {"domain": domain}
    parts = [path.get(level, F.col(level)).cast("string") for level in levels]
    leaf = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts])
    name, tokens = common.free_name(docs, "_taken"), token_count(F.col(text))
    mark = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    slim = materialise(docs.select(*[p.alias(level) for p, level in zip(parts, levels)], leaf.alias("leaf"), F.col(key), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("digest"), tokens.alias("tokens")), "mix-rows")
    leaves = materialise(slim.groupBy("leaf", *levels).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    planned = leaf_budgets(leaves.select(*levels, "tokens"), weights, total * share[0] // share[1], max_epochs, levels)
    on = [leaves[c].eqNullSafe(planned[c]) for c in levels]
    whole = F.expr("budget div greatest(n, 1)")
    planned = materialise(
        leaves.join(planned.withColumnRenamed("tokens", "n"), on)
        .select("leaf", F.when(F.col("n") == 0, F.lit(1)).otherwise(whole).cast("int").alias("whole"), "n", "budget")
        .withColumn("rest", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("budget") - F.col("whole") * F.col("n"))),
        "mix-plan",
    )
    open_ = planned.filter("rest > 0").select("leaf", "rest", "whole")
    keyed = slim.join(_small(open_.select("leaf", "whole")), "leaf").select(
        "leaf", "tokens", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), "digest")).alias("h"),
    )
    ends = _prefix_ends(materialise(keyed, "mix-keys"), open_.select("leaf", "rest"))
    plan = planned.select(F.col("leaf").alias("_leaf"), F.col("whole").alias("_whole")).join(ends.select(F.col("leaf").alias("_l2"), F.col("last").alias("_last")), F.col("_leaf") == F.col("_l2"), "left").drop("_l2")
    plan = materialise(plan, "mix-ends")
    lf, wh, la = (common.free_name(docs, c) for c in ("_leaf", "_whole", "_last"))
    plan = plan.toDF(lf, wh, la)
    found = docs.join(_small(plan), leaf == F.col(lf))
    more = F.coalesce(mark(F.col(wh)) <= F.col(la), F.lit(False))
    return found.withColumn(name, F.col(wh) + more.cast("int")).select(*[docs[c] for c in docs.columns], name), name


def mix(docs: DataFrame, weights: dict, **options) -> DataFrame:
    """The mixture: each row as often as its leaf's budget takes it, all columns as they were.

    Documents without tokens cost nothing and are taken once. An empty table gives an
    empty mixture. Of a leaf whose first document exceeds the rest of its budget that
    epoch gives none.
    """
    found, name = chosen(docs, weights, **options)
    copies = F.when(F.col(name) > 0, F.sequence(F.lit(1), F.greatest(F.col(name), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    once = common.free_name(docs, "_copy")
    return found.withColumn(once, F.explode(copies)).select(*[found[c] for c in docs.columns])
