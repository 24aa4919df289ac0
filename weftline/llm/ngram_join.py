"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles ("tokens"). Two sets link when
100 * intersection >= 75 * union. A set of n tokens may then miss at most
n - ceil(0.75 n) of them in a partner, so in any common order of tokens the first few
must share something. Tokens are ordered from rare to frequent. Rare ones are indexed
singly. Frequent ones fall into hashed groups; of a group of class k only combinations
of k tokens are indexed, and the prefix is extended until more tokens would have to be
missing than may be: with m tokens of a group in the prefix, sharing no combination means
that m - k + 1 of them are missing.

Groups must be the same for both partners, so they depend on a size level (power of two):
a set signs for its own level and, if a partner could be on the next one, also for that.
Below level 5 all tokens are signed singly.

Frequencies come from one table of hashed counters over all documents. They steer cost
only: any fixed order and classes give the same links.

Equal sets are joined first. Two sets are compared only if the number of signatures they
share leaves room for the overlap that their sizes ask for. Sets that share a signature are then linked to a pivot, one
comparison per set, which turns groups of near copies into stars. Between stars only the
pivots are compared; since Jaccard distance is a metric, distance(pivots) minus both radii
bounds every pair between two stars. Members of stars that stay open meet by what they
differ in from the pivot of the larger one. In a large group of near copies, sets whose own
tokens keep them from linking with anything crowded are found by exact counts beforehand.
Pairs of stars still come from shared signatures, so their rows can grow with the square of
the sets of a group that are alike, not linked and not told apart so; no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.components import components
from weftline.session import materialise

SINGLE_BELOW = 5        # size levels under this one have no combinations
GROUP_TOKENS = 16       # tokens of a level's size per hashed group
FREQUENT, STEP = 64, 32  # class 2 from this count above four mean loads, class 3 from STEP times that


def shingle_sets(text, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text (whole text if shorter)."""
    offsets, flat = common.words(text)
    hashes = common.word_hashes(flat)
    every = common.grams(hashes, n)
    out = []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if stop - start >= n:
            out.append(np.unique(every[start:stop - n + 1]))
        elif stop > start:
            out.append(common.grams(hashes[start:stop], stop - start) ^ np.uint64(stop - start))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _levels(n: int) -> list[int]:
    own = n.bit_length() - 1
    return [own, own + 1] if 4 * n >= 3 << (own + 1) else [own]


def signatures(tokens: np.ndarray, counts: np.ndarray, limits: tuple[float, float], num: int, den: int) -> tuple[np.ndarray, int]:
    """Signatures of one token set under the order (count, token), and the tokens beyond them.

    The second value bounds what a partner can share besides shared signatures: what
    follows a prefix of single tokens, or all tokens if there are combinations.
    """
    n = len(tokens)
    if not n:
        return tokens, 0
    need = n - -(-n * num // den) + 1
    order = np.lexsort((tokens, counts))
    if counts[order[need - 1]] <= limits[0]:  # the whole prefix is rare
        return tokens[order[:need]], n - need
    ranked, seen = tokens[order], counts[order]
    rare = int(np.searchsorted(seen, limits[0], side="right"))
    found = [ranked[:rare]]
    for level in _levels(n):
        if level < SINGLE_BELOW:
            found.append(ranked[:need])
            continue
        groups, gained, members = max(1, (1 << level) // GROUP_TOKENS), rare, {}
        slot = (common.mixed(ranked[rare:] ^ np.uint64(level)) % np.uint64(groups)).tolist()
        for token, count, group in zip(ranked[rare:].tolist(), seen[rare:].tolist(), slot):
            k = 2 if count <= limits[1] else 3
            held = members.setdefault((k, group), [])
            held.append(token)
            gained += len(held) >= k
            if gained >= need:
                break
        for (k, _), held in members.items():
            if len(held) >= k:
                parts = np.array(list(combinations(sorted(held), k)), np.uint64)
                total = np.full(len(parts), (level << 2) + k, np.uint64)
                with np.errstate(over="ignore"):
                    for column in parts.T:
                        total = common.mixed(total + column + common.MIX)
                found.append(total)
    return np.unique(np.concatenate(found)), n


def _counting(column: str, n: int):
    def run(batches):
        counts = np.zeros(1 << common.COUNTER_BITS, np.int64)
        for part in common.slices(batches, column):
            sets = shingle_sets(part.column(column), n)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((flat >> np.uint64(64 - common.COUNTER_BITS)).astype(np.int64), minlength=len(counts))
        yield common.counter_batch(common.counter_rows(counts, 0))

    return run


def _signing(n: int, table, limits, num: int, den: int):
    """(doc_id, th, text) -> (doc_id, th, n_shingles, slack, hi, lo, sigs)"""
    def run(batches):
        counts = table.value
        for part in common.slices(batches, "text"):
            sets = shingle_sets(part.column("text"), n)
            marks = np.array([(int(h := xxhash.xxh3_128_intdigest(s.tobytes())) >> 64, h & (2**64 - 1)) for s in sets], np.uint64).reshape(-1, 2)
            signed = [signatures(s, counts[(s >> np.uint64(64 - common.COUNTER_BITS)).astype(np.int64)], limits, num, den) for s in sets]
            signed, slack = [x for x, _ in signed], [x for _, x in signed]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in signed])]).astype(np.int32)
            flat = np.concatenate(signed).view(np.int64) if signed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(slack, pa.int64()),
                 pa.array(marks[:, 0].view(np.int64) if len(marks) else [], pa.int64()), pa.array(marks[:, 1].copy().view(np.int64) if len(marks) else [], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "th", "n_shingles", "slack", "hi", "lo", "sigs"],
            )

    return run


def _token_rows(n: int):
    """(sid, text) -> (sid, tokens)"""
    def run(batches):
        for part in common.slices(batches, "text"):
            sets = shingle_sets(part.column("text"), n)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("sid"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["sid", "tokens"],
            )

    return run


def _measured(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs with token arrays x and y -> link flag and Jaccard distance."""
    both = F.size(F.array_intersect("x", "y"))
    return pairs.withColumn("_both", both).withColumn("_all", F.size("x") + F.size("y") - F.col("_both")).select(
        *[c for c in pairs.columns if c not in ("x", "y")],
        (den * F.col("_both").cast("long") >= num * F.col("_all").cast("long")).alias("linked"),
        (1 - F.col("_both") / F.col("_all")).alias("distance"),
    )


def _compare(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b, ...) measured on their whole token sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    return _measured(pairs.join(left, "a").join(right, "b"), num, den)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, group_id, th, rid).

    Link: den * intersection >= num * union, num / den at least one half. component_id is
    the smallest non-null key that links reach, the row's own key included. Rows that
    repeat a key or a text are separate members; a null key never becomes a component id
    unless all of its component are null. Null, empty and blank texts have no shingles and
    are linked with nothing: their component is their own key. Extra columns are ignored.
    group_id numbers the components, th hashes the text and rid numbers the rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = common.total_counters(base.select("text").mapInArrow(_counting("text", n), common.COUNTERS), 1)[0]
    low = FREQUENT + 4 * counts.mean()
    table = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # fixed size
    keyed = base.withColumn("th", F.xxhash64("text"))
    signed = materialise(
        keyed.select("doc_id", "th", "text")
        .mapInArrow(_signing(n, table, (low, low * STEP), num, den), "doc_id long, th long, n_shingles long, slack long, hi long, lo long, sigs array<bigint>")
        .withColumn("rid", F.monotonically_increasing_id()),
        "ngram-signed",
    )
    filled = signed.filter("n_shingles > 0")
    heads = filled.groupBy("hi", "lo").agg(F.min("rid").alias("sid"))
    same = Window.partitionBy("sig")
    buckets = materialise(
        filled.select("rid", "n_shingles", "slack", "sigs").join(heads.select(F.col("sid").alias("rid")), "rid", "left_semi")
        .select(F.explode("sigs").alias("sig"), F.col("rid").alias("sid"), F.col("n_shingles").alias("n"), "slack")
        .withColumns({"first": F.min(F.struct("sid", "n", "slack")).over(same), "last": F.max("sid").over(same)})
        .filter("first.sid < last").drop("last"),
        "ngram-buckets",
    )
    shared = buckets.filter("sid > first.sid").groupBy("sid", "first").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("slack").alias("slack"))
    room = _room(F.col("n"), F.col("slack"), F.col("first.n"), F.col("first.slack"), F.col("k"))
    pivots = materialise(
        shared.filter(room >= _asked(F.col("n") + F.col("first.n"), num, den))
        .groupBy("sid").agg(F.max_by("first.sid", F.struct("k", -F.col("first.sid"))).alias("pivot")),
        "ngram-pivots",
    )
    place = filled.select(F.col("rid").alias("sid"), "doc_id", "th")
    fetch = lambda wanted: _fetch(keyed, place, wanted, n)
    sets = fetch(pivots.select("sid").unionByName(pivots.select(F.col("pivot").alias("sid"))).distinct())
    stars = materialise(_compare(pivots.select(F.col("sid").alias("a"), F.col("pivot").alias("b")), sets, num, den).filter("linked"), "ngram-stars")
    stars = stars.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "distance")
    edges = stars.select(F.col("sid").alias("u"), F.col("pivot").alias("v"))
    joined = components(edges, "ngram-components")
    stars, joined = _more_pivots(buckets, stars, joined, fetch, num, den, lambda turn: F.xxhash64("sid", F.lit(turn)))
    final = _between_stars(buckets, stars, joined, fetch, num, den)
    rows = signed.select("doc_id", "n_shingles", "hi", "lo", "rid", "th")
    sid_of = heads.join(final.withColumnRenamed("node", "sid"), "sid", "left").select("hi", "lo", "sid", F.coalesce("component", "sid").alias("group"))
    placed = rows.filter("n_shingles > 0").join(sid_of, ["hi", "lo"])
    smallest = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "group").select("doc_id", "n_shingles", "component_id", F.col("group").alias("group_id"), "th", "rid").unionByName(
        rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("rid").alias("group_id"), "th", "rid")
    )


def _room(n, slack, other, beyond, k):
    """Upper bound of the overlap of two sets that share k signatures.

    Whichever prefix ends first in the common order shares nothing else inside itself.
    """
    return F.greatest(F.least(slack + k, other), F.least(beyond + k, n))


def _asked(total, num: int, den: int):
    """Least overlap of linked sets whose sizes add up to `total`."""
    return F.ceil(num * total / (num + den) - 1e-6)


PIVOT_ROUNDS = 3          # further pivots tried before stars are compared; steers cost only
CROWDED = 2000            # meetings of a set from which its tokens are counted exactly; steers cost only
BROADCAST_ROWS = 200_000  # up to so many document keys travel to every task


def _fetch(keyed: DataFrame, place: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, tokens) of the wanted sets, taken again from their texts."""
    where = materialise(place.join(wanted, "sid").select("sid", F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "ngram-wanted")
    few = where.count() <= BROADCAST_ROWS
    texts = keyed.join(F.broadcast(where) if few else where, keyed["doc_id"].eqNullSafe(where["_id"]) & (keyed["th"] == where["_th"]))
    return materialise(texts.select("sid", "text").mapInArrow(_token_rows(n), "sid long, tokens array<bigint>"), "ngram-sets").dropDuplicates(["sid"])


def _extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links(u, v); known ones enter as stars and are not found again."""
    links = materialise(links, "ngram-links")
    if not links.limit(1).count():
        return joined
    return components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links), "ngram-components")


def _more_pivots(buckets: DataFrame, stars: DataFrame, joined: DataFrame, fetch, num: int, den: int, order) -> tuple[DataFrame, DataFrame]:
    """Stars and components after PIVOT_ROUNDS further tries with other pivots.

    In a bucket that still holds several components every set meets one more member,
    the first by `order` of the round, and keeps the pivot with which it shares most. Sets that link join
    that component, so that few stars are left to be compared with each other.
    """
    for turn in range(PIVOT_ROUNDS):
        placed = (
            buckets.join(joined.withColumnRenamed("node", "sid"), "sid", "left")
            .withColumn("component", F.coalesce("component", "sid"))
        )
        lead = F.min_by(F.struct("sid", "n", "slack", "component"), order(turn))
        mixed = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), lead.alias("lead")).filter("c0 < c1").select("sig", "lead")
        met = placed.join(mixed, "sig").filter("component <> lead.component").groupBy("sid", "lead").agg(
            F.count("*").alias("k"), F.first("n").alias("n"), F.first("slack").alias("slack")
        )
        room = _room(F.col("n"), F.col("slack"), F.col("lead.n"), F.col("lead.slack"), F.col("k"))
        pivots = materialise(
            met.filter(room >= _asked(F.col("n") + F.col("lead.n"), num, den))
            .groupBy("sid").agg(F.max_by("lead.sid", F.struct("k", -F.col("lead.sid"))).alias("pivot")),
            "ngram-pivots",
        )
        if not pivots.limit(1).count():
            break
        sets = fetch(pivots.select("sid").unionByName(pivots.select(F.col("pivot").alias("sid"))).distinct())
        linked = materialise(_compare(pivots.select(F.col("sid").alias("a"), F.col("pivot").alias("b")), sets, num, den).filter("linked"), "ngram-stars")
        linked = linked.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "distance")
        stars = materialise(stars.unionByName(linked.join(stars.select("sid"), "sid", "left_anti")), "ngram-stars")
        joined = _extended(joined, linked.select(F.col("sid").alias("u"), F.col("pivot").alias("v")))
    return stars, joined


def _mixed(placed: DataFrame) -> DataFrame:
    """Rows of signatures that sets of different components hold."""
    mixed = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("sig")
    return placed.join(mixed, "sig")


def _judged_sets(apart: DataFrame, fetch, num: int, den: int) -> DataFrame:
    """`apart` with `crowded`, `own` and `alone` per set.

    A crowded set meets more than CROWDED others over its signatures; the rest make few pairs.
    `own` of its tokens are held by no other crowded set, counted exactly. If they are so
    many that it cannot link with any crowded set, it stands `alone` among them. In a large group
    of near copies those that differ most from the others go this way before pairs are made.
    """
    sizes = apart.groupBy("sig").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    met = apart.select("sig", "sid", "n").join(sizes, "sig").groupBy("sid").agg(F.first("n").alias("n"), F.min("least").alias("least"), F.sum(F.col("size") - 1).alias("met"))
    crowd = materialise(met.filter(F.col("met") > CROWDED).select("sid", "n", "least"), "ngram-crowded")
    lone = (
        fetch(crowd.select("sid")).select("sid", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("sid").alias("sid"), F.count("*").alias("k"))
        .filter("k = 1").groupBy("sid").agg(F.count("*").alias("own"))
    )
    least = F.greatest(F.col("least"), F.ceil(num * F.col("n") / den - 1e-6))  # smaller partners link with nothing of this size
    judged = crowd.join(lone, "sid", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    judged = judged.select("sid", F.lit(True).alias("crowded"), "own", (F.col("n") - F.col("own") < _asked(F.col("n") + least, num, den)).alias("alone"))
    return materialise(apart.join(judged, "sid", "left").fillna(False, ["crowded", "alone"]).fillna(0, ["own"]), "ngram-apart")


def _may_meet(a: str, b: str):
    """Whether neither of two sets stands alone among crowded ones while the other is crowded."""
    return ~((F.col(f"{a}alone") & F.col(f"{b}crowded")) | (F.col(f"{b}alone") & F.col(f"{a}crowded")))


def _between_stars(buckets: DataFrame, stars: DataFrame, joined: DataFrame, fetch, num: int, den: int) -> DataFrame:
    """Components (node, component) after the links between members of different ones that share signatures."""
    slack = 1 - num / den + 1e-9
    known = buckets.select("sig", "sid", "n", "slack").join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    able = _judged_sets(materialise(_mixed(known), "ngram-apart"), fetch, num, den).drop("component")
    # sets with few tokens of their own lie in the middle of their group, so most others link with them
    middle = lambda turn: F.struct(F.floor(16 * F.col("own") / F.col("n")), F.xxhash64("sid", F.lit(turn)))
    stars, joined = _more_pivots(able.filter("crowded"), stars, joined, fetch, num, den, middle)
    placed = (
        able.join(stars.select("sid", F.col("pivot").alias("star"), F.col("distance").alias("away")), "sid", "left")
        .withColumns({"star": F.coalesce("star", "sid"), "away": F.coalesce("away", F.lit(0.0))})
        .join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    )
    apart = materialise(_mixed(placed), "ngram-apart")
    spans = apart.groupBy("star").agg(F.max("away").alias("radius"))
    size = apart.groupBy("star").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("slack").alias("slack"))
    seen = apart.select("sig", "star", "component", "crowded", "alone").distinct()
    one = seen.toDF("sig", "a", "ca", "a_crowded", "a_alone")
    two = seen.toDF("sig", "b", "cb", "b_crowded", "b_alone")
    met = one.join(two, "sig").filter(F.expr("a < b and ca <> cb") & _may_meet("a_", "b_")).groupBy("a", "b").agg(F.count("*").alias("k"))
    near = met.join(size.select(F.col("star").alias("a"), *[F.col(c).alias("a_" + c) for c in ("least", "most", "slack")]), "a")
    near = near.join(size.select(F.col("star").alias("b"), *[F.col(c).alias("b_" + c) for c in ("least", "most", "slack")]), "b")
    room = _room(F.col("a_most"), F.col("a_slack"), F.col("b_most"), F.col("b_slack"), F.col("k"))
    pairs = materialise(near.filter(room >= _asked(F.col("a_least") + F.col("b_least"), num, den)).select("a", "b"), "ngram-star-pairs")
    centres = fetch(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct())
    around = spans.select(F.col("star").alias("a"), F.col("radius").alias("ra"))
    about = spans.select(F.col("star").alias("b"), F.col("radius").alias("rb"))
    judged = materialise(
        _compare(pairs, centres, num, den).join(around, "a", "left").join(about, "b", "left").fillna(0.0, ["ra", "rb"]), "ngram-judged"
    )
    links = judged.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # links between pivots may have joined the stars of an open pair by another way
    now = _extended(joined, links)
    at = lambda side: now.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    open_ = materialise(
        judged.filter(~F.col("linked") & (F.col("ra") + F.col("rb") > 0) & (F.col("distance") - F.col("ra") - F.col("rb") <= slack)).select("a", "b")
        .join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"),
        "ngram-open",
    )
    if not open_.limit(1).count():
        return now
    pairs, sets = _open_members(open_, apart, fetch, num, den)
    return _extended(now, _compare(pairs, sets, num, den).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))


def _open_members(open_: DataFrame, apart: DataFrame, fetch, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members of open stars that may link, and the sets to compare.

    Sets x and y link when they differ in at most (|x| + |y|) (den - num) / (den + num) tokens.
    Both are seen by what they differ in from the pivot of the larger star, dx and dy: they
    differ in |dx| + |dy| less twice what dx and dy share. Near copies have little of that,
    so pairs come from shared differences, rare ones first, and only where enough may follow.
    Where nothing need be shared the pair links, and as a star is one component already, its
    member with most room speaks for all of them.
    """
    share = (den - num) / (den + num)
    who = materialise(apart.select("sid", "star", "n", "crowded", "alone").distinct(), "ngram-who")
    held = who.groupBy("star").agg(F.count("*").alias("held"))
    at = lambda side: held.select(F.col("star").alias(side), F.col("held").alias("held_" + side))
    first = F.col("held_a") >= F.col("held_b")
    asks = open_.join(at("a"), "a").join(at("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("star"))
    own = who.withColumn("big", F.col("star")).join(asks.select("big").distinct(), "big", "left_semi").select("big", "sid", "n", "crowded", "alone", F.lit(0).alias("side"))
    rows = materialise(own.unionByName(asks.join(who, "star").select("big", "sid", "n", "crowded", "alone", F.lit(1).alias("side"))), "ngram-open-members")
    sets = fetch(rows.select("sid").unionByName(rows.select(F.col("big").alias("sid"))).distinct())
    pivot = sets.select(F.col("sid").alias("big"), F.col("tokens").alias("centre"))
    apart_by = F.concat(F.array_except("tokens", "centre"), F.array_except("centre", "tokens"))
    seen = materialise(rows.join(sets, "sid").join(pivot, "big").select("big", "sid", "n", "crowded", "alone", "side", apart_by.alias("parts")), "ngram-parts").withColumn("d", F.size("parts"))
    room = lambda d, n: d - share * n
    nearest = seen.filter("side = 0").groupBy("big").agg(F.min_by(F.struct("sid", "d", "n"), room(F.col("d"), F.col("n"))).alias("y"))
    sure = seen.filter("side = 1").join(nearest, "big").filter(room(F.col("d") + F.col("y.d"), F.col("n") + F.col("y.n")) <= 1e-6).select(F.col("sid").alias("a"), F.col("y.sid").alias("b"))
    parts = seen.select("big", "sid", "n", "crowded", "alone", "side", "d", F.explode("parts").alias("part"))
    both = parts.groupBy("big", "part").agg(F.count("*").alias("f"), F.sum("side").alias("f1")).filter("f1 > 0 and f1 < f").select("big", "part", "f")
    order = Window.partitionBy("big", "sid").orderBy(F.col("f").desc(), F.col("part").desc())
    ranked = materialise(parts.join(both, ["big", "part"]).withColumn("upto", F.row_number().over(order)).drop("f"), "ngram-ranked")  # this part and those after it, rare first
    side = lambda k, name: ranked.filter(F.col("side") == k).select("big", "part", F.struct("sid", "n", "crowded", "alone", "d", "upto").alias(name))
    met = side(1, "x").join(side(0, "y"), ["big", "part"])
    both_n, spare = F.col("x.n") + F.col("y.n"), room(F.col("x.d") + F.col("y.d"), F.col("x.n") + F.col("y.n"))
    enough = (2 * F.least("x.upto", "y.upto") >= spare - 1e-6) & (F.abs(F.col("x.d") - F.col("y.d")) <= share * both_n + 1e-6) & _may_meet("x.", "y.")
    pairs = sure.unionByName(met.filter(enough & (spare > 0)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))).distinct()
    return materialise(pairs, "ngram-members"), sets


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the row of the smallest key, all columns as they were.

    Rows without a key give way to rows with one. Of rows that repeat a key and a text one
    stays. Rows without words are linked with nothing and all stay. Only the keys of rows
    that go travel; up to BROADCAST_ROWS of them are sent to every task.
    """
    rows = materialise(jaccard_join(docs, key, text).filter("n_shingles > 0"), "ngram-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    heads = rows.groupBy("group_id").agg(F.min_by("rid", order).alias("rid")).select("rid", F.lit(True).alias("head"))
    marked = rows.join(heads, "rid", "left").groupBy("doc_id", "th").agg(F.max(F.coalesce("head", F.lit(False))).alias("head"), F.count("*").alias("n"))
    odd = materialise(marked.filter("not head or n > 1").select("doc_id", "th", "head"), "ngram-odd")
    k, t, again = (common.free_name(docs, c) for c in ("_key", "_th", "_again"))
    few, repeated = odd.count() <= BROADCAST_ROWS, odd.filter("head").limit(1).count()
    odd = odd.toDF(k, t, again)
    match = docs[key].cast("long").eqNullSafe(F.col(k)) & (F.xxhash64(docs[text].cast("string")) == F.col(t))
    found = docs.join(F.broadcast(odd) if few else odd, match, "left")
    kept = found.filter(F.col(again).isNull())
    if repeated:
        kept = kept.unionByName(found.filter(F.col(again)).dropDuplicates([k, t]))
    return kept.select(*[kept[c] for c in docs.columns])
