"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed hashes the words that a fixed mask selects out of a span; the masked-out words may
differ. Seeds of the benchmark meet seeds at every position of every document. Around a
hit the document is laid beside the item on the hit's diagonal, and the best stretch is
scored: +1 for an equal word, -`penalty` for a substituted one. A stretch that reaches
`least` (or covers a shorter item wholly) is contamination.

Documents are scanned where they lie: positions are generated, hashed and looked up in a
broadcast table of benchmark seeds, and only hits leave the stage. The table's size is
counted first; beyond SEEDS_AT_ONCE it is cut by seed hash into blocks that are searched
one after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.session import materialise

MASKS = ("110101101011", "111001011101")  # 1: word counts
LEAST, PENALTY = 10, 2
SHORTEST = 5            # items of fewer words identify nothing and are not searched
SEEDS_AT_ONCE = 400_000
BROADCAST_ROWS = 500_000  # keys of contaminated documents that may travel to every task


def _words(text):
    """Lowered words between ASCII white space."""
    trimmed = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x09-\x0D\x20]+"))


def _seed(words, at, kind: int, offsets):
    """Hash of the words at 0-based position `at` plus offsets, tagged by mask."""
    return F.xxhash64(F.lit(kind), *[F.get(words, at + o) for o in offsets])


def _shapes(lengths: list[int], masks) -> list[tuple[int, list[int]]]:
    """(span, offsets) of every mask, then of each short item length taken whole."""
    long = [(len(m), [i for i, bit in enumerate(m) if bit == "1"]) for m in masks]
    return long + [(n, list(range(n))) for n in lengths]


def _seeds(frame: DataFrame, words: str, kind: int, span: int, offsets) -> DataFrame:
    """One row per position of `span` words: all columns, position `at`, `seed`."""
    last = F.size(words) - span
    positions = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return frame.withColumn("at", F.explode(positions)).withColumn("seed", _seed(F.col(words), F.col("at"), kind, offsets))


def _score(equal, penalty: int):
    """Best stretch of an array of booleans, +1 for true and -penalty for false."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(held, same):
        now = F.greatest(held["now"] + F.when(same, 1).otherwise(-penalty), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(held["best"], now).alias("best"))

    return F.aggregate(equal, start, step)["best"]


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", masks=MASKS, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """(doc_id, th, item_id, words): verified overlaps, `words` the best score on any diagonal.

    `th` hashes the document's text. Null, empty and short texts have no seeds and overlap
    with nothing. Rows that repeat key and text, and items that repeat key and text, count
    once; items of one key with different texts are searched each. Extra columns are ignored.
    """
    longest = max(len(m) for m in masks)
    bank = materialise(
        items.select(F.col(item_key).alias("item_id"), F.transform(_words(F.col(item_text)), lambda w: F.xxhash64(w)).alias("iw"))
        .filter(F.size("iw") >= SHORTEST).distinct().withColumn("item", F.monotonically_increasing_id()),
        "benchmark",
    )
    short = sorted(r[0] for r in bank.filter(F.size("iw") < longest).select(F.size("iw")).distinct().collect())  # lengths below a mask's span
    shapes = _shapes(short, masks)
    parts = []
    for kind, (span, offsets) in enumerate(shapes):
        fit = bank.filter(F.size("iw") >= longest) if kind < len(masks) else bank.filter(F.size("iw") == span)
        parts.append(_seeds(fit, "iw", kind, span, offsets).select("seed", "item", F.col("at").alias("start"), F.size("iw").alias("length")))
    seeds = materialise(reduce(DataFrame.unionByName, parts).distinct(), "benchmark-seeds")
    blocks = -(-seeds.count() // SEEDS_AT_ONCE) or 1
    base = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)).alias("dw"))
    last = F.size("dw") - min(s for s, _ in shapes)
    positions = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    placed = base.withColumn("at", F.explode(positions))
    choices = F.array(*[_seed(F.col("dw"), F.col("at"), kind, offsets) for kind, (_, offsets) in enumerate(shapes)])
    keyed = placed.withColumn("seed", F.explode(choices))
    hits = []
    for block in range(blocks):
        table = F.broadcast(seeds.filter(F.pmod("seed", F.lit(blocks)) == block))  # size counted above
        found = keyed.join(table, "seed")
        diagonal = F.col("at") - F.col("start")
        first = F.greatest(diagonal, F.lit(0))
        stop = F.least(diagonal + F.col("length"), F.size("dw"))
        hits.append(found.select(
            "doc_id", "th", "item", (first - diagonal).alias("skip"), F.slice("dw", first + 1, stop - first).alias("window"),
        ))
    near = reduce(DataFrame.unionByName, hits).join(bank, "item")
    beside = F.zip_with("window", F.slice("iw", F.col("skip") + 1, F.size("window")), lambda a, b: a == b)
    scored = near.select("doc_id", "th", "item_id", _score(beside, penalty).alias("words"), F.size("iw").alias("length"))
    return scored.filter(F.col("words") >= F.least(F.lit(least), F.col("length"))).groupBy("doc_id", "th", "item_id").agg(F.max("words").alias("words"))


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without verified overlap, all columns as they were.

    Rows whose text is null, empty or too short for a seed stay.
    """
    k, t = common.free_name(docs, "_key"), common.free_name(docs, "_th")
    found = materialise(overlaps(docs, items, key, text, **options).select("doc_id", "th").distinct(), "contaminated").toDF(k, t)
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(found, docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text].cast("string")) == F.col(t)), "left_anti")
