"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20  # text handled at once inside a task
COUNTER_BITS = 18      # counters of a corpus-wide frequency table
_BLOCK = 4096          # counters that travel in one row


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Cut Arrow batches into pieces of at most `limit` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back


def words(text) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words) of whole texts: A-Z lowered, split at ASCII white space; null has none."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    ends, flat = split.offsets.to_numpy(), split.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    return before[ends - ends[0]].astype(np.int64), flat.filter(pa.array(filled))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of every word; each distinct word of the piece is hashed once."""
    coded = flat.dictionary_encode()
    known = coded.dictionary.to_pylist()
    table = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    return table[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words starting at each position, over a flat array of word hashes."""
    count = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(count, np.uint64)
        for i in range(n):
            total = mixed(total + hashes[i:i + count] + MIX)
    return total


def counter_rows(counts: np.ndarray, kind: int):
    """A task's counters as rows (kind, block, counts) of its non-empty blocks."""
    for block, part in enumerate(counts.reshape(-1, _BLOCK)):
        if part.any():
            yield kind, block, part


def counter_batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    flat = pa.array(np.concatenate([r[2] for r in rows]) if rows else np.zeros(0), pa.int64())
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * _BLOCK)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(offsets, flat)],
        names=["kind", "block", "counts"],
    )


COUNTERS = "kind int, block int, counts array<bigint>"


def total_counters(parts: DataFrame, kinds: int, bits: int = COUNTER_BITS) -> np.ndarray:
    """Sum counter rows of all tasks; the result has the fixed size kinds x 2**bits.

    Blocks meet in their reducer and are added there one row at a time, so memory does
    not depend on the number of tasks.
    """
    n = max(1, min((kinds << bits) // _BLOCK, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    added = (
        parts.repartition(n, "kind", "block")
        .select("kind", "block", F.posexplode("counts").alias("at", "n"))
        .groupBy("kind", "block", "at").agg(F.sum("n").alias("n")).filter("n <> 0")
    )
    out = np.zeros((kinds, (1 << bits) // _BLOCK, _BLOCK), np.int64)
    for kind, block, counts in added.mapInArrow(_packed, "kind int, block int, counts binary").collect():  # a row per block
        out[kind, block] = np.frombuffer(bytes(counts), np.int64)
    return out.reshape(kinds, -1)


def _packed(batches):
    """(kind, block, at, n) -> (kind, block, counts): a block is one row of bytes, so the driver makes no row per counter."""
    held = {}
    for batch in batches:
        kind, block, at, n = (batch.column(c).to_numpy() for c in ("kind", "block", "at", "n"))
        of = (kind.astype(np.int64) << 32) | block
        for one in np.unique(of).tolist():
            mine = of == one
            np.add.at(held.setdefault(one, np.zeros(_BLOCK, np.int64)), at[mine], n[mine])
    yield pa.RecordBatch.from_arrays(
        [pa.array([o >> 32 for o in held], pa.int32()), pa.array([o & 0xFFFFFFFF for o in held], pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())],
        names=["kind", "block", "counts"],
    )


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, or a variant of it that no column of `df` bears."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish
