"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of random signs and a fast
Hadamard transform. The nearest signed coordinate axis is its hash; `keys` such hashes of
independent rotations make a bucket, and there are `tables` of them. Besides its own bucket a
vector enters those reached by the next best axes of one rotation (multiprobe), cheapest
first. Vectors that share a bucket are compared by cosine in double precision.

Equal vectors are merged first. A crowded bucket is cut into blocks of about BLOCK rows by
a hash, and each pair of blocks is a task of its own, so its comparisons spread and no
bucket meets in one task. Blocks do not emit pairs: they count links and give one edge per
vector to the smallest linked vector of its connected part. A pair that shares
several buckets counts in the smallest of them only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.session import materialise

THRESHOLD = 0.95
TABLES, PROBES = 8, 4
BUCKET_ROWS = 64        # `keys` grows with the table until about so many vectors share a bucket
BLOCK = 512             # vectors of one side of a comparison
_CELLS = 1 << 18        # pairs checked for shared buckets at once


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of every row; the length is a power of two."""
    step, n = 1, x.shape[1]
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def bucket_codes(unit: np.ndarray, tables: int, keys: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables * probes) bucket numbers; the first of each table is the vector's own."""
    rows, dims = unit.shape
    size = 1 << max(1, (dims - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :dims] = unit
    signs = np.random.default_rng([seed, size]).choice([-1.0, 1.0], (tables, keys, 3, size))
    out = np.empty((rows, tables, probes), np.uint64)
    for t in range(tables):
        axes, costs = [], []
        for k in range(keys):
            x = padded
            for r in range(3):
                x = _hadamard(x * signs[t, k, r])
            both = np.concatenate([x, -x], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            best = np.take_along_axis(both, top, axis=1)
            axes.append(top)
            costs.append((best[:, :1] - best) ** 2)
        # changes of a single rotation, cheapest first; the vector's own bucket costs nothing
        step = np.concatenate([np.zeros((rows, 1))] + [c[:, 1:] for c in costs], axis=1)
        order = np.argsort(step, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            code = np.full(rows, t + 1, np.uint64)
            change = order[:, p]
            for k in range(keys):
                low = 1 + k * (probes - 1)
                mine = (change >= low) & (change < low + probes - 1)
                pick = np.where(mine, change - low + 1, 0)
                with np.errstate(over="ignore"):
                    code = code * np.uint64(2 * size + 1) + axes[k][np.arange(rows), pick].astype(np.uint64)
            out[:, t, p] = code
    return out.reshape(rows, tables * probes)


def _unit_rows(key: str, column: str):
    """(key, vector) -> usable vectors (vec_id, dims, digest, unit); the rest has a null digest."""
    def run(batches):
        for batch in batches:
            ids, vectors = batch.column("vec_id"), batch.column("vector")
            digest, units, dims = [], [], []
            for value in vectors:
                v = np.array(value.as_py() if value.is_valid else [], dtype=float)  # None turns to nan
                norm = np.sqrt(v @ v) if len(v) and np.isfinite(v).all() else 0.0
                if len(v) and norm == 0.0 and np.isfinite(v).all() and np.abs(v).max() > 0:  # tiny components
                    v = v / np.abs(v).max()
                    norm = np.sqrt(v @ v)
                if norm > 0 and not np.isfinite(norm):  # huge components
                    v = v / np.abs(v).max()
                    norm = np.sqrt(v @ v)
                unit = v / norm if norm > 0 else np.zeros(0)
                digest.append(xxhash.xxh3_128_hexdigest((unit + 0.0).tobytes()) if norm > 0 else None)
                units.append(unit)
                dims.append(len(unit))
            offsets = np.concatenate([[0], np.cumsum(dims)]).astype(np.int32)
            flat = np.concatenate(units) if units else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(dims, pa.int32()), pa.array(digest, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()))],
                names=["vec_id", "dims", "digest", "unit"],
            )

    return run


def _coding(tables: int, keys: int, probes: int, seed: int):
    """(rep, n, dims, unit) -> one row with its buckets `codes`."""
    def run(batches):
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dims))
                unit = part.column("unit").flatten().to_numpy().reshape(-1, dims)
                codes = np.concatenate([bucket_codes(unit[i:i + 2048], tables, keys, probes, seed) for i in range(0, len(unit), 2048)])
                with np.errstate(over="ignore"):
                    codes = (codes * np.uint64(4099) + np.uint64(dims)).view(np.int64)  # vectors of different length never meet
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("n"), part.column("dims"), part.column("unit"), lists], names=["rep", "n", "dims", "unit", "codes"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether `bucket` is the smallest code that each pair of rows of a and b shares."""
    out = np.empty(len(a), bool)
    step = max(1, _CELLS // (a.shape[1] * b.shape[1]))
    for i in range(0, len(a), step):
        equal = a[i:i + step, :, None] == b[i:i + step, None, :]
        shared = np.where(equal.any(axis=2), a[i:i + step], np.iinfo(np.int64).max)
        out[i:i + step] = shared.min(axis=1) == bucket
    return out


def _block_links(threshold: float):
    """A pair of blocks -> (rep, links, low): links counted here, smallest vector of its part."""
    def run(key, table):
        bucket, one, two = (k.as_py() for k in key)
        reps, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        weight = table.column("n").to_numpy()
        unit = table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(reps), -1)
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(reps), -1)
        if one == two:
            a = b = np.arange(len(reps))
        else:
            a, b = np.flatnonzero(side == one), np.flatnonzero(side == two)
        links = np.zeros(len(reps), np.int64)
        low = reps.copy()
        starts, ends = [], []
        for i in range(0, len(a), BLOCK):
            for j in range(i if one == two else 0, len(b), BLOCK):
                x, y = a[i:i + BLOCK], b[j:j + BLOCK]
                near = unit[x] @ unit[y].T >= threshold
                if one == two and i == j:
                    near = np.triu(near, 1)
                p, q = np.nonzero(near)
                if not len(p):
                    continue
                u, v = x[p], y[q]
                starts.append(u.astype(np.int32)), ends.append(v.astype(np.int32))
                counts = _first_shared(codes[u], codes[v], bucket)
                np.add.at(links, u[counts], weight[v[counts]])
                np.add.at(links, v[counts], weight[u[counts]])
        if starts:
            u, v = np.concatenate(starts), np.concatenate(ends)
            while True:
                least = np.minimum(low[u], low[v])
                before = low.copy()
                np.minimum.at(low, u, least)
                np.minimum.at(low, v, least)
                if (before == low).all():
                    break
        keep = (links > 0) | (low != reps)
        return pa.table({"rep": reps[keep], "links": links[keep], "low": low[keep]})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, seed: int = 4) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    Null, empty and zero vectors and those with a null or non-finite component link with
    nothing. Vectors of different length link with nothing. Rows that repeat a key are separate vectors
    that share it. A null key is never a component id unless its vector links with nothing.
    An exact check follows the hashing, so no pair below the threshold counts; pairs at it
    may be missed with the probability that no table brings them together.
    """
    spark = vectors.sparkSession
    rows = materialise(
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
        .mapInArrow(_unit_rows(key, column), "vec_id long, dims int, digest string, unit array<double>").withColumn("rid", F.monotonically_increasing_id()),
        "vectors",
    )
    usable = rows.filter("digest is not null")
    heads = usable.groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("n"))
    total = heads.count()
    dims = usable.agg(F.max("dims")).first()[0] or 2
    keys = 1
    while total / (2 * dims) ** keys > BUCKET_ROWS:
        keys += 1
    single = usable.select(F.col("rid").alias("rep"), "dims", "unit").join(heads.select("rep", "n"), "rep").select("rep", "n", "dims", "unit")
    coded = materialise(single.mapInArrow(_coding(tables, keys, probes, seed), "rep long, n long, dims int, unit array<double>, codes array<bigint>"), "vector-codes")
    placed = coded.select("rep", F.explode("codes").alias("bucket")).distinct()
    crowd = placed.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    sides = materialise(
        placed.join(crowd, "bucket").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .select("bucket", "rep", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("side")),
        "vector-buckets",
    )
    # a block meets itself and every other block of its bucket
    spread = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "rep", "side", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two")
    )
    met = spread.join(coded.drop("dims"), "rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(
        met.repartition(parts, "bucket", "one", "two").groupBy("bucket", "one", "two").applyInArrow(_block_links(threshold), "rep long, links long, low long"),
        "vector-links",
    )
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")), "vector-components")
    state = (
        heads.join(counted, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"))
    )
    live = usable.select("vec_id", "digest").join(state, "digest")
    least = live.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    linked = live.join(least, "group").select("vec_id", "n_links", "component_id")
    alone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
