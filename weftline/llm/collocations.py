"""Phrase collocations of each language by Toivonen's sampling method.

Phrases of two and three words that occur at least LEAST times are wanted with exact
counts; whatever is frequent has only frequent parts. A sample of the documents, taken by
the hash of their text, proposes words and pairs at a lowered threshold. One pass over all
documents then counts, exactly, every word and every phrase whose parts were all proposed:
the proposed ones that the corpus holds and, with them, the negative border, the smallest
phrases that were not proposed. A frequent member of the border is a failure of the sample:
it is proposed after all, and a second pass counts only the phrases that have become
eligible by that. A pair that this pass counts for the first time, for a word that had not
been proposed, may be a failure in its turn; the pass takes it as proposed and counts the
triples with it at once. So two passes always end: every frequent phrase has been counted.

What is proposed travels as a bit table of at most MAX_BITS bits. It answers yes for all
that was proposed and, rarely, for more; such phrases are counted too, so the size of the
table decides the work and never a count. Counts are added per task before they are
shuffled, and no list of phrases visits the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.session import materialise

LEAST = 10               # occurrences of a wanted phrase
COVER = (1, 2)           # a phrase is dropped for a longer one with this share of its count
TOP = 2000               # phrases reported for a language
SAMPLE = 8               # one document in so many proposes
LOWERED = 2              # occurrences in the sample that propose
MAX_BITS = 1 << 28       # of a bit table
SLICE_BYTES = 1 << 20    # text counted at once inside a task
_BLOCK_BITS = 1 << 15    # of a bit table in one row
_SALTS = 64
_COUNTS = "lang string, k int, phrase string, n bigint"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row of each word, whether the next word follows in the same piece); null has no words."""
    clean = pc.fill_null(text, "")
    _, offsets, data = clean.buffers()
    ends = np.frombuffer(offsets, np.int32)[clean.offset:clean.offset + len(clean) + 1].astype(np.int64)
    size = int(ends[-1] - ends[0])
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _KIND[raw]
    inside = kind == 0
    fresh = np.zeros(size + 1, bool)  # no word reaches from one row into the next
    fresh[ends] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | fresh[1:-1]
    closes[:-1] &= ~inside[1:] | fresh[1:-1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    cuts = np.stack([starts, stops], 1).ravel().astype(np.int32)
    every = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(_LOWER[raw]))
    row = np.searchsorted(ends, starts, side="right") - 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)[starts]
    onward = np.zeros(len(starts), bool)
    onward[:-1] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
    return every.take(pa.array(np.arange(0, len(cuts), 2))), row, onward


def _named(lang: str, words: list[str]) -> np.ndarray:
    """64-bit hashes of words of one language."""
    seed = xxhash.xxh64_intdigest(lang) & 0x7FFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mixed(common.mixed(a + common.MIX) + b)


def _holds(table: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both bits set; no table holds everything."""
    if table is None:
        return np.ones(len(hashes), bool)
    out = np.ones(len(hashes), bool)
    for bits in _bits(hashes, len(table) * 8):
        out &= (table[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _bits(hashes: np.ndarray, size: int):
    return hashes & np.uint64(size - 1), (hashes >> np.uint64(36)) & np.uint64(size - 1)


def _count_slice(lang: pa.Array, text: pa.Array, now, before, sampling: bool):
    """(lang, k, phrase, n) batches of one slice: what tables `now` admit and `before` did not.

    In a second pass (`before` given) pairs of words that `before` did not hold count as held by `now`.
    """
    words, row, onward = tokens(text)
    if not len(words):
        return
    coded, langs = words.dictionary_encode(), pc.fill_null(lang, "und").dictionary_encode()
    names, tongues = coded.dictionary, langs.dictionary.to_pylist()
    v = len(names)
    ids = coded.indices.to_numpy().astype(np.int64)
    key = langs.indices.to_numpy().astype(np.int64)[row] * v + ids
    present, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    of, which = present // v, present % v
    hashes = np.zeros(len(present), np.uint64)
    spelled = names.to_pylist()
    for i, tongue in enumerate(tongues):
        mine = np.flatnonzero(of == i)
        hashes[mine] = _named(tongue, [spelled[w] for w in which[mine]])

    def batch(of_rows, k, phrase, n):
        return pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(of_rows)), pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "k", "phrase", "n"]
        )

    def joined(*parts):
        return pc.binary_join_element_wise(*[names.take(pa.array(p)) for p in parts], " ")

    if before is None:  # the first pass over these rows: all words, and how many there are
        yield batch(of, 1, names.take(pa.array(which)), counts)
        totals = np.bincount(of, weights=counts, minlength=len(tongues)).astype(np.int64)
        yield batch(np.arange(len(tongues)), 0, pa.array([""] * len(tongues)), totals)
    old = before or ("none", "none")
    holds = lambda table, h: np.zeros(len(h), bool) if isinstance(table, str) else _holds(table, h)
    word_now, word_old = holds(now[0], hashes)[place], holds(old[0], hashes)[place]
    at = np.flatnonzero(onward[:-1] & word_now[:-1] & word_now[1:]) if len(onward) > 1 else np.zeros(0, np.int64)
    if not len(at):
        return
    pairs, seat, times = np.unique(place[at] * np.int64(v) + ids[at + 1], return_inverse=True, return_counts=True)
    one = np.zeros(len(pairs), np.int64)
    one[seat] = at  # a place where the pair stands
    new = ~(word_old[one] & word_old[one + 1])
    if new.any():
        some = one[new]
        yield batch(of[place[some]], 2, joined(ids[some], ids[some + 1]), times[new])
    if sampling:
        return
    pair_hash = _pair(hashes[place[one]], hashes[place[one + 1]])
    pair_now, pair_old = holds(now[1], pair_hash), holds(old[1], pair_hash) & ~new
    if before is not None:
        pair_now |= new
    seat_of = np.full(len(ids), -1, np.int64)
    seat_of[at] = seat
    first = at[seat_of[np.minimum(at + 1, len(ids) - 1)] >= 0]
    a, b = seat_of[first], seat_of[first + 1]
    wanted = pair_now[a] & pair_now[b] & ~(pair_old[a] & pair_old[b])
    first, a = first[wanted], a[wanted]
    if len(first):
        triples, stand, often = np.unique(a * np.int64(v) + ids[first + 2], return_index=True, return_counts=True)
        some = first[stand]
        yield batch(of[place[some]], 3, joined(ids[some], ids[some + 1], ids[some + 2]), often)


def _counts(docs: DataFrame, now, before=None, sampling: bool = False) -> DataFrame:
    """Exact counts of the phrases that `now` admits and `before` did not, over all rows of docs."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((now, before))

    def run(batches):
        tables, earlier = sent.value
        for piece in common.slices(batches, "text", SLICE_BYTES):
            yield from _count_slice(piece.column("lang"), piece.column("text"), tables, earlier, sampling)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, np.uint64)
    langs, parts = batch.column("lang").to_pylist(), [p.split(" ") for p in batch.column("phrase").to_pylist()]
    for lang in set(langs):
        mine = [i for i, one in enumerate(langs) if one == lang]
        head = _named(lang, [parts[i][0] for i in mine])
        out[mine] = _pair(head, _named(lang, [parts[i][1] for i in mine])) if len(parts[mine[0]]) == 2 else head
    return out


def _bit_table(phrases: DataFrame, base: np.ndarray | None = None, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bit table of phrases (lang, phrase) of one length, about twelve bits each, on top of `base`."""
    if base is None:
        size = _BLOCK_BITS
        wanted = 12 * phrases.count()
        while size < min(wanted, max_bits):
            size *= 2
        base = np.zeros(size // 8, np.uint8)
    size = len(base) * 8

    def places(batches):
        for batch in batches:
            bits = np.unique(np.concatenate(_bits(_phrase_hashes(batch), size))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits // _BLOCK_BITS), pa.array((bits % _BLOCK_BITS).astype(np.int32))], names=["block", "bit"])

    def blocks(batches):
        held = {}
        for batch in batches:
            block, bit = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            for b in np.unique(block):
                held.setdefault(b, np.zeros(_BLOCK_BITS, bool))[bit[block == b]] = True
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int64()), "bits": pa.array([np.packbits(h, bitorder="little").tobytes() for h in held.values()], pa.binary())})

    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = phrases.select("lang", "phrase").mapInArrow(places, "block bigint, bit int").repartition(parts, "block")
    out = base.copy()
    for block, bits in spread.mapInArrow(blocks, "block bigint, bits binary").collect():  # at most max_bits bits in all
        at = block * (_BLOCK_BITS // 8)
        out[at:at + _BLOCK_BITS // 8] |= np.frombuffer(bytes(bits), np.uint8)
    return out


def _missing(frequent: DataFrame, k: int, table: np.ndarray) -> DataFrame:
    """Frequent phrases of k words that the table does not hold: failures of the border."""
    sent = frequent.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_holds(sent.value, _phrase_hashes(batch))))

    return frequent.filter(F.col("k") == k).select("lang", "phrase").mapInArrow(run, "lang string, phrase string")


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, lowered: int = LOWERED, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, k, phrase, n): words and phrases of 2 and 3 words with n >= least, and k = 0 with all words of the language."""
    docs = docs.select("lang", "text")
    seen = materialise(
        _counts(docs.filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0), (None, None), sampling=True).filter((F.col("k") > 0) & (F.col("n") >= lowered)), "phrases-sample"
    )
    now = tuple(_bit_table(seen.filter(F.col("k") == k), max_bits=max_bits) for k in (1, 2))
    wanted = (F.col("n") >= least) | (F.col("k") == 0)
    first = materialise(_counts(docs, now).filter(wanted), "phrases-counted")
    failed = [materialise(_missing(first, k, table), "phrases-border") for k, table in zip((1, 2), now)]
    if all(f.isEmpty() for f in failed):
        return first
    wider = tuple(_bit_table(f, table) for f, table in zip(failed, now))
    return first.unionByName(materialise(_counts(docs, wider, now).filter(wanted), "phrases-counted"))


def collocations(docs: DataFrame, least: int = LEAST, cover: tuple = COVER, top: int = TOP, **proposing) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of characters other than space and tab, lower-cased in A-Z, inside
    pieces that end at . , ; : ! ? and at line ends (LF, VT, FF, CR). `a` counts the phrase,
    overlaps included; `l` and `r` count the two parts of the cut with the lowest score
    floor(10^6 a^2 / (l r)), the earlier cut on ties. Phrases inside a longer frequent phrase with at
    least the share `cover` of their count are left out. `n` counts all words of the language.

    A null text is empty; a null language is `und`, together with rows that say so. Repeated
    rows count as often as they stand; doc_id and other columns are not read. An empty table
    has no rows. Ties in score go by count, then by the phrase in UTF-8 byte order.
    """
    known = materialise(frequent_phrases(docs, least, **proposing), "phrases-frequent")
    words = F.split("phrase", " ")
    phrases = known.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"))
    inner = known.filter("k = 3").select("lang", "n", F.explode(F.array(F.concat_ws(" ", F.slice(words, 1, 2)), F.concat_ws(" ", F.slice(words, 2, 2)))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    free = phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (cover[1] * F.col("longer") < cover[0] * F.col("a"))).drop("longer")
    cuts = free.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, size(w) - cut), ' ')").alias("rest")
    )
    part = lambda name, count: known.filter("k > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr("cast(a as decimal(18, 0)) * cast(a as decimal(18, 0)) * cast(1000000 as decimal(7, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))  # first within shares of a language, then among their best
    short = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    totals = known.filter("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
