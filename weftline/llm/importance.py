"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams are counted: one of target text (documents
labelled good) and one of all raw text. The weight of an n-gram is the log ratio of its
two probabilities. The target probability is shrunk towards the raw one, so n-grams seen
too rarely to tell weigh nothing. Raw text holds target text itself, so the ratio of an
n-gram typical of the target lies above one; the target's weighted median is taken off,
which makes the weight the log share of target text among the text that shows the n-gram.
Only weights below `cut` count as evidence. A document's log weight is the sum of its
evidence over the square root of the number of its distinct n-grams.

Resampling is Gumbel top-k: k documents with the largest log weight / temperature plus
Gumbel noise are kept. The noise is a hash of seed, key and text, so runs repeat. k is the
number of documents whose log weight reaches a level that a share `spare` of held-out good
documents misses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.session import materialise

LABELLED = 40_000   # at most so many labelled good documents are used: half as target, half held out
SHRINK = (5.0, 10.0)  # prior counts: a hundredth of the target documents, within these limits
CUT = 0.7
SPARE = 0.002
TEMPERATURE = 0.002
ORDERS = (1,)       # n-gram lengths of the models


def _buckets(text, orders, shift):
    """Per order the distinct hashed n-grams of each text of a piece, and its row.

    A text counts an n-gram once, so no single long or repetitive text shapes the models.
    """
    offsets, flat = common.words(text)
    hashes, sizes = common.word_hashes(flat), np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for n in orders:
        grams = common.grams(hashes, n)
        inside = row[n - 1:] == row[:len(grams)]
        keyed = np.unique((row[:len(grams)][inside] << (64 - shift)) | (grams[inside] >> np.uint64(shift)).astype(np.int64))
        yield keyed & ((1 << (64 - shift)) - 1), keyed >> (64 - shift)


def _counting(orders, bits):
    def run(batches):
        counts = np.zeros((2, 1 << bits), np.int64)
        for part in common.slices(batches, "text"):
            target = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for bucket, row in _buckets(part.column("text"), orders, 64 - bits):
                counts[0] += np.bincount(bucket, minlength=1 << bits)
                counts[1] += np.bincount(bucket[target[row]], minlength=1 << bits)
        yield common.counter_batch(r for kind in (0, 1) for r in common.counter_rows(counts[kind], kind))

    return run


def evidence(raw: np.ndarray, target: np.ndarray, shrink: float, cut: float = CUT) -> np.ndarray:
    """Weight of every bucket, zero unless it speaks clearly against target text."""
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + shrink) / (expected + shrink))
    order = np.argsort(ratio, kind="stable")
    upto = np.cumsum(target[order])
    typical = ratio[order][np.searchsorted(upto, upto[-1] / 2)]
    weight = ratio - typical
    return np.where(weight < -cut, weight, 0).astype(np.float32)


def _weighing(orders, bits, model):
    def run(text: pa.Array) -> pa.Array:
        weights, out = model.value, []
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        for part in common.slices([batch], "text"):
            total, size = np.zeros(part.num_rows), np.zeros(part.num_rows)
            for bucket, row in _buckets(part.column("text"), orders, 64 - bits):
                total += np.bincount(row, weights[bucket], part.num_rows)
                size += np.bincount(row, minlength=part.num_rows)
            out.append(total / np.sqrt(np.maximum(size, 1)))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run


def labelled_good(labels: DataFrame, key: str = "doc_id", limit: int = LABELLED) -> DataFrame:
    """(key, target): at most `limit` keys whose every label says good, halved by a hash bit."""
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_lkey")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    )
    ranked = known.filter("good = 1").select("_lkey", F.xxhash64("_lkey", F.lit(8)).alias("h"))
    return ranked.orderBy("h", "_lkey").limit(limit).select("_lkey", (F.pmod("h", F.lit(2)) == 0).alias("_target"))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value by repeated counting in equal bins; only bin counts travel.

    -inf if there are fewer than k values.
    """
    bins = 1024
    rest, low, high = k, *values.agg(F.min(column), F.max(column)).first()
    if low is None or k > values.count():
        return float("-inf")
    while high > low:
        width = (high - low) / bins
        if not width or low + width == low:
            return low
        inside = values.filter((F.col(column) >= low) & (F.col(column) <= high))
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counted = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()  # at most 1024 rows
        for row in sorted(counted, key=lambda r: -r["bin"]):
            if rest <= row["n"]:
                low, high = row["lo"], row["hi"]
                break
            rest -= row["n"]
    return low


def weighted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", orders=ORDERS, bits: int = common.COUNTER_BITS, seed: int = 8, temperature: float = TEMPERATURE, spare: float = SPARE):
    """(docs with _weight and _draw columns, least draw kept).

    Column names are varied if docs bears them; they are returned with the frame.
    """
    spark = docs.sparkSession
    chosen = materialise(labelled_good(labels, key), "importance-labels")
    n_target = chosen.filter("_target").count()
    chosen = F.broadcast(chosen)  # at most LABELLED rows
    base = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text"))
    flagged = base.join(chosen, base["_key"] == chosen["_lkey"], "left")
    raw, target = common.total_counters(
        flagged.select("text", F.coalesce("_target", F.lit(False)).alias("target")).mapInArrow(_counting(orders, bits), common.COUNTERS), 2, bits
    )
    shrink = min(max(SHRINK[0], n_target / 100), SHRINK[1])
    model = spark.sparkContext.broadcast(evidence(raw, target, shrink))  # fixed size
    weigh = F.arrow_udf(_weighing(orders, bits, model), "double")
    weight, draw = common.free_name(docs, "_weight"), common.free_name(docs, "_draw")
    share = (F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    out = docs.withColumn(weight, weigh(F.col(text).cast("string"))).withColumn(draw, F.col(weight) / temperature - F.log(-F.log(share)))
    slim = materialise(out.select(F.col(key).cast("long").alias("_key"), F.col(weight).alias("_weight"), F.col(draw).alias("_draw")), "importance")
    held = slim.join(chosen, slim["_key"] == chosen["_lkey"]).filter(~F.col("_target"))
    n = held.count()
    missed = int(spare * n)  # so many held-out good documents may fall below the level
    level = -kth_largest(held.select((-F.col("_weight")).alias("w")), "w", missed + 1) if n else float("-inf")
    k = slim.filter(F.col("_weight") >= level).count()
    least = kth_largest(slim, "_draw", k) if k else float("inf")
    return out, weight, draw, least


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that the resampling keeps, all columns as they were.

    Null, empty and blank texts have no evidence against them, weigh 0 and stay like good
    text. Rows that repeat key and text share one draw and stay or go together. Without
    good labels nothing is known and everything stays. Labels that contradict each other
    and labels without a key are not used.
    """
    out, _, draw, least = weighted(docs, labels, key, text, **options)
    return out.filter(F.col(draw) >= least).select(*[out[c] for c in docs.columns])


def kept_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, log_weight, draw, kept) of the documents that stay."""
    out, weight, draw, least = weighted(docs, labels, **options)
    return out.filter(F.col(draw) >= least).select("doc_id", F.col(weight).alias("log_weight"), F.col(draw).alias("draw"), F.lit(True).alias("kept"))
