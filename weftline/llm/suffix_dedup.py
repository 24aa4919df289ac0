"""Removal of repeated passages by suffix arrays from two-stage sorting.

Every byte covered by a SPAN-byte string that also starts somewhere else goes. Texts of any
number and length are brought into suffix arrays of bounded size like this:

1. Equal texts are one text with a number of copies (SHA-256 of the text).
2. Each SPAN-byte window has an anchor, the least hash among the GRAM-byte strings in it,
   which depends on nothing but its bytes. Equal windows therefore have equal anchors, and
   only windows whose anchor stands in two places are looked at further.
3. The windows of one anchor in a text are a run; runs with equal anchors meet in one task
   as pieces of text. The task lays its pieces end to end and sorts their suffixes in two
   stages: those smaller than their successor directly, the others by scans of the buckets
   of first bytes, each taking its place from its successor's. Neighbours in the order
   whose common prefix reaches SPAN bytes are repeats.
4. Anchors with more than `limit` places do not fit a task. Their pieces are counted as
   strings, and windows of pieces that stand alone by a 128-bit hash, in partial
   aggregates. That is the exact way for what the bounded suffix arrays leave.

Long repetitive stretches (one character, short periods) would make a run of almost every
byte; runs that occur more than twice in one text are settled where they are read and two
of them travel on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.session import materialise, spread

SPAN = 200          # bytes of a repeated string
GRAM = 48           # bytes that are hashed for an anchor
LIMIT = 8192        # places of an anchor that one task takes
ARRAY_BYTES = 1 << 20  # text in one suffix array, except that an anchor's pieces stay together
_CHUNK = 1 << 16    # window starts hashed at once
_LOW = np.uint64((1 << 20) - 1)
_WORDS = SPAN // 8
_TABLE = common.mixed(np.arange(1, 257, dtype=np.uint64) * common.MIX)
_BASE = 0x5851F42D4C957F2D

_SIGNED = "digest binary, doc_id bigint, n_bytes bigint, anchors array<bigint>, runs array<bigint>, sure array<bigint>"
_PIECES = "anchor bigint, id bigint, run bigint, places bigint, piece binary"
_COVERS = "id bigint, start bigint, end bigint"


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes starting at each place."""
    with np.errstate(over="ignore"):
        hashes, width, whole, covered = _TABLE[raw], 1, None, 0
        while True:
            if GRAM & width:
                whole = hashes if whole is None else hashes[: len(whole) - width] * _power(covered) + whole[width:] if len(whole) > width else whole[:0]
                covered += width
            if width * 2 > GRAM:
                break
            hashes = hashes[:-width] * _power(width) + hashes[width:]
            width *= 2
    n = len(raw) - GRAM + 1
    return common.mixed(whole[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` values from each place on."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchored_runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of all runs in texts laid end to end, text i at ends[i]:ends[i + 1]."""
    total = len(raw) - SPAN + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    across = np.zeros(len(raw) + 1, np.int32)  # windows that leave their text
    np.add.at(across, np.maximum(ends[:-1], ends[1:] - SPAN + 1), 1)
    np.add.at(across, ends[1:], -1)
    across = np.cumsum(across)[:total] > 0
    starts, counts, anchors = [], [], []
    for c in range(0, total, _CHUNK):
        stop = min(c + _CHUNK, total)
        hashes = _gram_hashes(raw[c:stop + SPAN - 1])
        placed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(placed, SPAN - GRAM + 1) & _LOW).astype(np.int64)
        out = across[c:stop]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (out[1:] != out[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(at)))
        inside = ~out[first]
        starts.append(first[inside] + c)
        counts.append(many[inside])
        anchors.append(hashes[at[first[inside]]])
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes laid end to end, offsets from 0) of a string or binary array without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _merged(spans) -> list[list[int]]:
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _sign(batches):
    """Texts -> (digest, n_bytes, anchors and runs of their windows, spans settled on the spot).

    A run is written first window * 256 + windows, a span as two numbers.
    """
    for piece in common.slices(batches, "text"):
        text = pc.fill_null(piece.column("text"), "").cast(pa.binary())
        raw, ends = _bytes_of(text)
        first, many, anchor = anchored_runs(raw, ends)
        row = np.searchsorted(ends, first, side="right") - 1
        sure = [[] for _ in range(len(text))]
        order = np.lexsort((anchor, row))
        same = np.zeros(len(order), bool)
        if len(order) > 2:
            a, r = anchor[order], row[order]
            three = (a[2:] == a[:-2]) & (r[2:] == r[:-2])
            for i in range(3):
                same[i:len(order) - 2 + i] |= three
        keep = np.ones(len(first), bool)
        seen, data = {}, raw.tobytes() if same.any() else b""
        for i in np.sort(order[same]).tolist():
            key = int(row[i]), data[first[i]:first[i] + many[i] - 1 + SPAN]
            seen[key] = seen.get(key, 0) + 1
            if seen[key] > 2:
                keep[i] = False
                at = int(first[i] - ends[row[i]])
                if sure[key[0]] and sure[key[0]][-1][1] >= at:
                    sure[key[0]][-1][1] = at + int(many[i]) - 1 + SPAN
                else:
                    sure[key[0]].append([at, at + int(many[i]) - 1 + SPAN])
        first, many, anchor, row = first[keep], many[keep], anchor[keep], row[keep]
        lists = pa.array(np.searchsorted(row, np.arange(len(text) + 1)).astype(np.int32))
        ids = piece.column("doc_id").cast(pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array([hashlib.sha256(t).digest() for t in text.to_pylist()], pa.binary()), ids, pa.array(np.diff(ends)),
            pa.ListArray.from_arrays(lists, pa.array(anchor.view(np.int64))), pa.ListArray.from_arrays(lists, pa.array((first - ends[row]) * 256 + many)),
            pa.array([[x for span in spans for x in span] for spans in sure], pa.list_(pa.int64())),
        ], names=["digest", "doc_id", "n_bytes", "anchors", "runs", "sure"])


def _pack(batches):
    """(doc_id, text) -> (digest, doc_id, packed text)."""
    for piece in common.slices(batches, "text"):
        text = pc.fill_null(piece.column("text"), "").cast(pa.binary()).to_pylist()
        press = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([
            pa.array([hashlib.sha256(t).digest() for t in text], pa.binary()), piece.column("doc_id").cast(pa.int64()), pa.array([press(t) for t in text], pa.binary())
        ], names=["digest", "doc_id", "packed"])


def _cut(batches):
    """(id, packed, runs with anchor and places) -> the text pieces of the runs."""
    for batch in batches:
        rows, held = [], 0
        for at in range(batch.num_rows):
            key, text = batch.column("id")[at].as_py(), zstandard.decompress(batch.column("packed")[at].as_py())
            found = batch.column("found")[at].values
            for anchor, run, places in zip(*(found.field(n).to_pylist() for n in ("anchor", "run", "places"))):
                start, many = run >> 8, run & 255
                rows.append((anchor, key, run, places, text[start:start + many - 1 + SPAN]))
                held += SPAN
                if held > common.SLICE_BYTES:
                    yield _piece_batch(rows)
                    rows, held = [], 0
        yield _piece_batch(rows)


def _piece_batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())], names=["anchor", "id", "run", "places", "piece"])


def _big_endian(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number; raw ends in 8 bytes of padding."""
    n = len(raw) - 8
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | raw[i:n + i]
    return out


def _sort_directly(places: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of the SPAN bytes that start there; names rank the 8-byte words."""
    order, live = places.copy(), np.arange(len(places))
    group, step = np.zeros(len(places), np.int64), 0
    while step < _WORDS and len(live):
        room = max(1, (63 - int(group[-1]).bit_length()) // bits)
        key, at = group, order[live]
        for _ in range(min(room, _WORDS - step)):
            key = key << bits | names[at + 8 * step]
            step += 1
        by = np.argsort(key)
        order[live], key = at[by], key[by]
        alike = key[1:] == key[:-1]
        tied = np.zeros(len(key), bool)
        tied[1:] |= alike
        tied[:-1] |= alike
        number = np.concatenate([[0], np.cumsum(~alike)])[tied]
        live = live[tied]
        group = np.unique(number, return_inverse=True)[1].astype(np.int64) if len(number) else number
    return order


def suffix_order(raw: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, names): the wanted suffixes of raw in the order of their first SPAN bytes, in two stages.

    A suffix smaller than its successor is sorted directly. Any other one begins with a byte
    that is at least its successor's, so a scan over buckets of first bytes, smallest first,
    meets the successor before it and puts the suffixes of a bucket in place one behind the
    other, before the bucket's directly sorted ones. Successors that wanted suffixes need,
    up to the next directly sorted one, are taken along.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.array([0, 255], np.uint8), np.zeros(SPAN + 8, np.uint8)])
    body = padded[:n + 2].astype(np.int16)
    change = np.sign(np.diff(body))  # place n has 0 before 255: directly sorted, ends every chain
    place = np.where(change != 0, np.arange(n + 1), n)
    small = change[np.minimum.accumulate(place[::-1])[::-1]] > 0
    need = np.zeros(n + 1, bool)
    need[:n] = wanted
    loose = np.flatnonzero(need[:-1] & ~small[:-1] & ~need[1:])  # larger ones whose successor is not wanted itself
    if len(loose):
        stops = np.flatnonzero(small)
        until = stops[np.searchsorted(stops, loose)]
        marks = np.zeros(n + 2, np.int32)
        np.add.at(marks, loose, 1)
        np.add.at(marks, until + 1, -1)
        need |= np.cumsum(marks)[:n + 1] > 0
    words = _big_endian(padded)
    known, names = np.unique(words, return_inverse=True)
    names = names.astype(np.int64)
    direct = _sort_directly(np.flatnonzero(need & small), names, max(1, len(known).bit_length()))
    opening = padded[direct]
    bounds = np.searchsorted(opening, np.arange(257))
    waiting, out = [[] for _ in range(256)], []

    def hand_on(settled, byte):
        """Larger predecessors of suffixes just settled go to their buckets; those of this one are returned."""
        before = settled[settled > 0] - 1
        before = before[need[before] & ~small[before]]
        heads = padded[before]
        here = heads == byte
        others, heads = before[~here], heads[~here]
        if len(others):
            by = np.argsort(heads, kind="stable")
            cuts = np.flatnonzero(np.diff(heads[by])) + 1
            for part in np.split(others[by], cuts):
                waiting[padded[part[0]]].append(part)
        return before[here]

    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(level):
            out.append(level)
            level = hand_on(level, byte)
        ready = direct[bounds[byte]:bounds[byte + 1]]
        if len(ready):
            out.append(ready)
            hand_on(ready, byte)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[(order < n) & np.append(wanted, False)[order]], words


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it, SPAN at most."""
    shared = np.zeros(max(0, len(order) - 1), np.int64)
    live = np.arange(len(shared))
    for step in range(_WORDS):
        if not len(live):
            break
        differ = words[order[live] + 8 * step] ^ words[order[live + 1] + 8 * step]
        same = differ == 0
        part = np.zeros(len(live), np.int64)
        for i in range(1, 8):
            part += (differ >> np.uint64(64 - 8 * i)) == 0
        shared[live] += np.where(same, 8, part)
        live = live[same]
    return shared


def repeated_windows(raw: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which wanted window starts of raw have the same SPAN bytes as another one."""
    order, words = suffix_order(raw, wanted)
    far = common_prefixes(words, order) >= SPAN
    out = np.zeros(len(raw), bool)
    out[order[1:][far]] = True
    out[order[:-1][far]] = True
    return out


def _arrays(batches):
    """Pieces sorted by anchor -> spans covered by repeated windows, one suffix array after the other."""
    held, size = [], 0

    def settle(table):
        ids, runs = table.column("id").to_numpy(), table.column("run").to_numpy()
        _, once = np.unique(np.stack([ids, runs], 1), axis=0, return_index=True)  # rows equal in doc_id and text bring a run twice
        table = table.take(pa.array(np.sort(once)))
        ids, runs = table.column("id").to_numpy(), table.column("run").to_numpy()
        raw, ends = _bytes_of(table.column("piece").combine_chunks() if isinstance(table.column("piece"), pa.ChunkedArray) else table.column("piece"))
        marks = np.zeros(len(raw) + 1, np.int32)
        marks[ends[:-1]] += 1
        marks[ends[:-1] + (runs & 255)] -= 1
        hit = repeated_windows(raw, np.cumsum(marks)[:-1] > 0)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(ends, start, side="right") - 1
        begin = (runs[of] >> 8) + start - ends[of]
        return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(begin), pa.array(begin + stop - start - 1 + SPAN)], names=["id", "start", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column("anchor").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and size > ARRAY_BYTES and anchors[a] != held[-1].column("anchor")[-1].as_py():
                yield settle(pa.Table.from_batches(held))
                held, size = [], 0
            part = batch.slice(a, b - a)
            held.append(part)
            size += (b - a) * SPAN
    if held:
        yield settle(pa.Table.from_batches(held))


def _windows(batches):
    """Distinct pieces of crowded anchors -> (window hash, id, run, place in the run, many)."""
    names = ["window", "id", "run", "at", "many"]
    for batch in batches:
        for piece in common.slices([batch], "piece", common.SLICE_BYTES // 4):
            rows = []
            for key, run, many, text in zip(*(piece.column(c).to_pylist() for c in ("id", "run", "many", "piece"))):
                rows += [(xxhash.xxh128_digest(text[i:i + SPAN]), key, run, i, many) for i in range(run & 255)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _crowded(pieces: DataFrame) -> DataFrame:
    """Spans of repeated windows among pieces of crowded anchors, by counting strings.

    A place is (id, run). Two different places of one string are seen by its smallest and
    largest place, so rows that bring a place twice do no harm.
    """
    place = F.struct("id", "run")
    distinct = materialise(
        pieces.groupBy("anchor", "piece").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .select("piece", "low.id", "low.run", (F.col("low") != F.col("high")).alias("many")), "suffix-crowded"
    )
    windows = materialise(distinct.mapInArrow(_windows, "window binary, id bigint, run bigint, at int, many boolean"), "suffix-windows")
    twice = windows.groupBy("window").agg(F.count("*").alias("n"), F.max("many").alias("any")).filter("n > 1 OR any").select("window")
    lone = windows.filter("NOT many").join(twice, "window", "left_semi")
    begin = F.shiftright("run", 8)
    alone = lone.select("id", (begin + F.col("at")).alias("start"), (begin + F.col("at") + SPAN).alias("end"))
    name = F.unhex(F.md5("piece"))
    repeated = distinct.filter("many").select(name.alias("name"))
    whole = pieces.select(name.alias("name"), "id", "run").join(repeated, "name", "left_semi")
    return alone.unionByName(whole.select("id", begin.alias("start"), (begin + F.col("run").bitwiseAND(255) - 1 + SPAN).alias("end"))).distinct()


def _removed(batches):
    """(digest, packed, spans) -> what is cut from each text."""
    names, rows = ["digest", "n_removed", "kept_sha256", "spans"], []
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def flush():
        columns = list(zip(*rows)) if rows else [[]] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        rows.clear()
        return batch

    last = None
    for batch in batches:
        for key, packed, found in zip(batch.column("digest"), batch.column("packed"), batch.column("covers")):
            if key.as_py() == last:
                continue
            last = key.as_py()
            spans, text, at, rest = _merged(zip(*(found.values.field(n).to_pylist() for n in ("start", "end")))), zstandard.decompress(packed.as_py()), 0, hashlib.sha256()
            for start, end in spans:
                rest.update(text[at:start])
                at = end
            rest.update(text[at:])
            rows.append((last, sum(b - a for a, b in spans), rest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        yield flush()


def repeats(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept_sha256 and spans (start, end in bytes) of every row of docs.

    Removed is each byte covered by a SPAN-byte string that starts at another place too, in
    the same text or any other. A null text is empty and keeps nothing. Rows with equal texts
    repeat each other whatever their doc_id, so texts of SPAN bytes or more that occur
    twice go whole. doc_id is carried and need not be unique or present; other columns are
    not read. An empty table has no rows. `limit` decides how a repeat is found, not which.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = materialise(
        docs.mapInArrow(_sign, _SIGNED).groupBy("digest").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_bytes", "anchors", "runs", "sure"))
        ).withColumn("id", F.monotonically_increasing_id()), "suffix-texts"  # numbers stay as they are written
    )
    anchored = texts.select("id", F.explode(F.arrays_zip("anchors", "runs")).alias("a")).select("id", F.col("a.anchors").alias("anchor"), F.col("a.runs").alias("run"))
    shared = materialise(texts.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("places")).filter("places > 1"), "suffix-anchors")
    found = anchored.join(shared, "anchor").groupBy("id").agg(F.collect_list(F.struct("anchor", "run", "places")).alias("found"))  # one text's runs
    wanted = found.join(texts.select("id", "digest", "doc_id"), "id").withColumnRenamed("doc_id", "holder")
    packed = docs.mapInArrow(_pack, "digest binary, doc_id bigint, packed binary")
    any_id = F.lit(-(1 << 63))
    held = materialise(
        packed.withColumn("holder", F.coalesce("doc_id", any_id)).drop("doc_id").join(wanted.withColumn("holder", F.coalesce("holder", any_id)), ["digest", "holder"]).drop("holder"), "suffix-held"
    )
    some = lambda crowd: held.withColumn("found", F.filter("found", lambda f: (f["places"] > limit) == F.lit(crowd))).filter(F.size("found") > 0)
    pieces = lambda crowd: some(crowd).select("id", "packed", "found").mapInArrow(_cut, _PIECES)
    covers = spread(pieces(False).drop("places"), "anchor").sortWithinPartitions("anchor").mapInArrow(_arrays, _COVERS)
    if not shared.filter(F.col("places") > limit).isEmpty():
        covers = covers.unionByName(_crowded(pieces(True)))
    sure = texts.filter(F.size("sure") > 0).select("id", F.explode(F.expr("transform(sequence(0, size(sure) - 2, 2), i -> struct(sure[i] AS start, sure[i + 1] AS end))")).alias("s")).select("id", "s.start", "s.end")
    spans = covers.unionByName(sure).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("covers"))
    once = spans.join(held.select("id", "digest", "packed"), "id").select("digest", "packed", "covers").mapInArrow(
        _removed, "digest binary, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    twice = texts.filter((F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)).select("digest", F.col("n_bytes").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"), whole.alias("spans"))
    changed = once.join(twice.select("digest"), "digest", "left_anti").unionByName(twice)
    body = F.coalesce("text", F.lit(""))
    every = docs.select("doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    out = every.join(changed.withColumn("sha", F.lower(F.hex("digest"))).drop("digest"), "sha", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", none).alias("spans")
    )
