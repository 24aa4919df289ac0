"""Secret scan: fixed patterns plus a battery of randomness tests, in DataFrame functions only.

Fixed patterns give the base spans. Besides them, every run of at least LEAST characters of
the base64 and base64url alphabets is a candidate. Its encoding is the smallest alphabet that
covers it. Three tests follow: chi-squared for uniform use of the alphabet, runs about the
alphabet's middle, and lag-1 serial correlation. Runs and correlation must be those of a
random string. The chi-squared value is held against written text: text repeats its
symbols, so chi-squared of text is noncentral, growing with length, and the lower tail of
that law is the chance of finding text so even. As this null law knows the length, short
candidates need more evenness than they can show.

Over all candidates of the corpus the false discovery rate is held at RATE by the
step-up rule of Benjamini and Hochberg, in each band of lengths separately. Scores are counted in bins of
1/100, so only a table of fixed size decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialise

# fixed patterns
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")  # order of equal starts
LEAST = 20
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "random": "[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST}

# encodings from small to large: name, pattern, alphabet
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _LOWER.upper()),
    ("base32", "^[A-Z2-7]+$", _LOWER.upper() + "234567"),
    ("alnum", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("ALNUM", "^[A-Z0-9]+$", _DIGITS + _LOWER.upper()),
    ("base62", "^[A-Za-z0-9]+$", _DIGITS + _LOWER.upper() + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
    ("mixed", "", _LOWER.upper() + _LOWER + _DIGITS + "+/-_"),
)
TEXT_REPEAT = 0.0667  # chance that two letters of written text are equal
FAIR = 3.29           # runs and correlation beyond so many deviations are not random (p 0.001)
RATE = 0.01
BANDS = (24, 32, 48, 64, 128)  # upper ends of the length bands, the last is open


def _found(text, kind: str):
    """Array of (kind, i, gap, match): the i-th match and the characters since the last one."""
    pattern = PATTERNS[kind]
    has = text.rlike(pattern)
    matches = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(has, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    return F.transform(matches, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match")))


def _choose(values):
    """The value that belongs to the first encoding whose pattern fits."""
    return reduce(lambda rest, e: F.when(F.col("match_body").rlike(e[0][1]), F.lit(e[1])).otherwise(rest), reversed(list(zip(ENCODINGS[:-1], values[:-1]))), F.lit(values[-1]))


def battery(candidates: DataFrame) -> DataFrame:
    """candidates(match, ...) -> with encoding, n, chi, runs_z, serial_z, score and fair.

    `score` is in deviations below text of the same length; `fair` says that runs and
    correlation are those of a random string.
    """
    body = candidates.withColumn("match_body", F.regexp_replace("match", "=+$", ""))
    coded = body.withColumns({
        "encoding": _choose([e[0] for e in ENCODINGS]),
        "alphabet": _choose([e[2] for e in ENCODINGS]),
        "n": F.length("match_body").cast("double"),
    }).withColumn("m", F.length("alphabet").cast("double"))
    codes = coded.withColumn("x", F.expr("transform(filter(split(match_body, ''), c -> c <> ''), c -> cast(locate(c, alphabet) as double))"))
    squares = F.expr("aggregate(filter(split(alphabet, ''), c -> c <> ''), 0D, (s, c) -> s + pow(length(match_body) - length(replace(match_body, c, '')), 2))")
    mean = F.expr("aggregate(x, 0D, (s, v) -> s + v) / n")
    measured = codes.withColumns({"chi": F.col("m") / F.col("n") * squares - F.col("n"), "mean": mean}).withColumns({
        "upper": F.expr("cast(size(filter(x, v -> v > m / 2)) as double)"),
        "turns": F.expr("aggregate(sequence(1, size(x) - 1), 0D, (s, i) -> s + if((x[i] > m / 2) <> (x[i - 1] > m / 2), 1D, 0D))"),
        "spread": F.expr("aggregate(x, 0D, (s, v) -> s + (v - mean) * (v - mean))"),
        "lag": F.expr("aggregate(sequence(1, size(x) - 1), 0D, (s, i) -> s + (x[i] - mean) * (x[i - 1] - mean))"),
    })
    n, up = F.col("n"), F.col("upper")
    expected = 2 * up * (n - up) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(variance > 0, (F.col("turns") + 1 - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(-99.0)
    serial = F.when(F.col("spread") > 0, (F.col("lag") / F.greatest(F.col("spread"), F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(99.0)
    repeat = F.greatest(F.lit(TEXT_REPEAT), 1.6 / F.col("m"))  # small alphabets: as uneven as 26 letters are
    beyond = n * (F.col("m") * repeat - 1)
    free = F.col("m") - 1
    score = (free + beyond - F.col("chi")) / F.sqrt(2 * (free + 2 * beyond))
    return measured.withColumns({"runs_z": runs, "serial_z": serial, "score": score}).withColumn(
        "fair", (F.abs("runs_z") <= FAIR) & (F.abs("serial_z") <= FAIR)
    ).drop("match_body", "alphabet", "x", "mean", "upper", "turns", "spread", "lag", "m")


def _tail(z):
    """Upper tail of the normal law, by a logistic fit."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * F.pow(z, F.lit(3.0))))


def discovery_levels(scored: DataFrame) -> DataFrame:
    """(band, level): least score (in 1/100) that the step-up rule accepts in each length band."""
    bins = scored.groupBy("band", "bin").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("band").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumns({"rank": F.sum("k").over(upto), "of": F.sum("k").over(Window.partitionBy("band"))})
    return ranked.filter(_tail(F.col("bin") / 100.0) <= RATE * F.col("rank") / F.col("of")).groupBy("band").agg(F.min("bin").alias("level"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, kind, start, stop): code points, end exclusive; `th` hashes the text.

    A random span that overlaps a base span of its document is left to that.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("t"))
    found = base.select("doc_id", "th", F.concat(*[_found(F.col("t"), k) for k in KINDS]).alias("f")).filter(F.size("f") > 0)
    each = found.withColumn("rid", F.monotonically_increasing_id()).select("doc_id", "th", "rid", F.explode("f").alias("f")).select("doc_id", "th", "rid", "f.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.length("match")).over(upto).cast("int")).withColumn("start", F.col("stop") - F.length("match"))
    ok = (F.col("kind") != "assign") | (F.length(F.regexp_extract("match", ASSIGN, 1)) >= 6)
    placed = materialise(placed.filter(ok).select("doc_id", "th", "kind", "start", "stop", "match").distinct(), "secret-matches")
    band = reduce(lambda rest, i: F.when(F.col("n") < BANDS[i], F.lit(i)).otherwise(rest), reversed(range(len(BANDS))), F.lit(len(BANDS)))
    scored = materialise(
        battery(placed.filter("kind = 'random'")).withColumns({"band": band, "bin": F.greatest(F.lit(-1000), F.least(F.lit(4000), F.floor(F.col("score") * 100))).cast("int")})
        .withColumn("bin", F.when(F.col("fair"), F.col("bin")).otherwise(F.lit(-1000)))
        .select("doc_id", "th", "kind", "start", "stop", "band", "bin"),
        "secret-scores",
    )
    levels = F.broadcast(discovery_levels(scored))  # one row per band
    random = scored.join(levels, "band").filter("bin >= level").select("doc_id", "th", "kind", "start", "stop")
    return placed.filter("kind <> 'random'").select("doc_id", "th", "kind", "start", "stop").unionByName(random)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random).

    Null and empty texts have no spans: counts 0, the hash of an empty string, no spans.
    Rows that repeat key and text have equal results. Extra columns are ignored.
    """
    order = F.expr("array_position(array('assign', 'access', 'hex', 'random'), kind)")
    listed = spans(docs, key, text).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "stop", "kind"))).alias("s"))
    known = listed.select("doc_id", "th", F.filter("s", lambda x: x["kind"] != "random").alias("b"), "s").withColumn(
        "s", F.expr("filter(s, x -> x.kind <> 'random' or not exists(b, y -> y.start < x.stop and x.start < y.stop))")
    )
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_th"))
    joined = rows.join(known, rows["_key"].eqNullSafe(known["doc_id"]) & (rows["_th"] == known["th"]), "left")
    write = lambda c: F.coalesce(F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"]))), F.lit(""))
    count = lambda kind: F.coalesce(F.size(F.filter("s", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    number = lambda kind: F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(count(kind))
    return joined.select(
        F.col("_key").alias("doc_id"), *[number(k).alias("n_" + k) for k in KINDS[:3]],
        F.sha2(write(F.col("b")), 256).alias("base_sha256"), write(F.col("s")).alias("spans"), number("random").alias("n_random"),
    )
