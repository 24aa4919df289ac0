"""Deterministic sharded WARC archives: writer, reader and manifest.

Records are put in one global order and cut into shards of equal payload bytes by prefix
sums, so shard contents depend on the rows alone. A task writes its shards in order, each
record as a gzip member of its own, and rolls to the next file once a file has reached its
compressed size. Headers and digests are made anew from the rows. A file is written under
a temporary name of this attempt and renamed when complete; a repeated attempt writes the
same bytes to the same name. The manifest lists every file with its records, bytes and
digest, is written last, and a reader takes only the files it lists and checks them.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.sharding import prefix_sums
from weftline.session import checkpoint_folder, materialise

REVISIT_FROM = 1000      # smaller payloads are written in full each time
SHARD_BYTES = 16 << 20   # payload bytes of a shard
FILE_BYTES = 4 << 20     # compressed bytes after which the next file begins
LEVEL = 6
MEMO = 200_000           # texts that a task remembers as sent; forgetting one sends it again
DATE = "2020-01-01T00:00:00Z"  # records carry one fixed date, so that archives repeat byte for byte
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(row: dict, payload: bytes) -> bytes:
    """One WARC record; a revisit has no block."""
    kind = row["record_type"]
    name = lambda n: f"<urn:uuid:{uuid.UUID(hashlib.sha1(f'record:{n}'.encode()).hexdigest()[:32])}>"
    block = payload if kind == "response" else b""
    number = lambda x: "" if x is None else str(x)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(row['serial'])}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((row['url'] or '').split())}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Page-ID: {number(row['page_id'])}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {number(row['refers_to'])}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without time or name
    return packer.compress(data) + packer.flush()


class _File:
    """One archive file of an attempt: temporary until closed."""

    def __init__(self, system, folder: str, shard: int, part: int):
        self.system, self.name = system, f"part-{shard:06d}-{part:04d}.warc.gz"
        self.final, self.draft = posixpath.join(folder, self.name), posixpath.join(folder, f".{self.name}.{uuid.uuid4().hex}.tmp")
        self.out, self.bytes, self.records, self.digest, self.shard, self.part = system.open_output_stream(self.draft), 0, 0, hashlib.sha1(), shard, part

    def add(self, member: bytes):
        self.out.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.system.move(self.draft, self.final)
        return {"file": self.name, "shard": self.shard, "part": self.part, "records": self.records, "bytes": self.bytes, "sha1": self.digest.hexdigest()}


_MANIFEST = "file string, shard long, part int, records long, bytes long, sha1 string"


def _order(page_id, url, digest) -> tuple:
    """A record's key as Spark sorts it, nulls first."""
    return page_id is not None, page_id or 0, url is not None, (url or "").encode(), digest


def _packing(bounds: list):
    """(_p, _u, _d, size, html) -> (task, _p, _u, _d, packed): compressed texts for the tasks that may need them.

    `bounds` holds the first key of each writing task. A key's records may go on in later
    tasks; of larger payloads only the first one is a response. Texts that a task has seen
    with their key are not sent again.
    """
    tasks, firsts = [task for task, _ in bounds], [first for _, first in bounds]

    def run(batches):
        seen: set = set()
        for batch in common.slices(batches, "html"):
            out = []
            if len(seen) > MEMO:
                seen.clear()
            for p, u, d, size, html in zip(*[batch.column(c).to_pylist() for c in ("_p", "_u", "_d", "size", "html")]):
                key = _order(p, u, d)
                mark = hashlib.sha1(repr(key).encode()).digest()
                if mark in seen:
                    continue
                seen.add(mark)
                low, high = max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)
                packed = zlib.compress(html.encode(), LEVEL)
                out += [(task, p, u, d, packed) for task in tasks[low:high if size < REVISIT_FROM else min(high, low + 2)]]
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["task", "_p", "_u", "_d", "packed"])

    return run


def _writing(folder: str, file_bytes: int, level: int):
    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        file, done, key, packed = None, [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                mine = row["page_id"], row["url"], row["payload_digest"]
                if row["serial"] is None:  # a text stands before the records of its key
                    key, packed = mine, row["packed"]
                    continue
                text = b""
                if row["record_type"] == "response":
                    if mine != key:
                        raise ValueError(f"no text for page {row['page_id']}; the pages changed while they were written")
                    text = zlib.decompress(packed)
                if file and (file.shard != row["shard"] or file.bytes >= file_bytes):
                    part = file.part + 1 if file.shard == row["shard"] else 0
                    done.append(file.close())
                    file = _File(system, base, row["shard"], part)
                file = file or _File(system, base, row["shard"], 0)
                file.add(_member(_record(row, text), level))
        if file:
            done.append(file.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("shard", pa.int64()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    return run


def described(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> with payload_bytes, payload_digest, record_type, refers_to.

    Of payloads equal in digest and size of at least REVISIT_FROM bytes the row of the
    largest page_id is the response (null ids come last; of equal ids the first url), others revisit it.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumns(
        {"payload_bytes": F.octet_length(html).cast("long"), "payload_digest": F.sha1(F.encode(html, "UTF-8"))}
    )
    slim = materialise(rows.drop("html").withColumn("rid", F.monotonically_increasing_id()), "warc-rows")
    order = F.struct(F.col("page_id").isNotNull(), "page_id", (-F.col("rid")).alias("r"))
    heads = slim.filter(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest", "payload_bytes").agg(
        F.max_by(F.struct("rid", "page_id"), order).alias("head"), F.count("*").alias("copies")
    ).filter("copies > 1").select("payload_digest", "payload_bytes", F.col("head.rid").alias("head"), F.col("head.page_id").alias("head_page"))
    known = slim.join(heads, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("head").isNotNull() & (F.col("head") != F.col("rid"))
    return known.select(
        "page_id", "url", "payload_bytes", "payload_digest", "rid",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head_page")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archives of `pages` below `folder` (a URI all executors reach) and return the manifest.

    Order: page_id (null first), url, digest. Null html is an empty payload; null ids and
    urls are empty headers. White space in a url becomes single spaces, as headers are lines. Columns other
    than page_id, url and html are not written. An empty table gives an empty manifest.
    """
    rows = described(pages)
    cost = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0) + 512
    ordered = prefix_sums(rows.withColumn("cost", cost), ["page_id", "url", "payload_digest", "record_type"], "cost")
    placed = materialise(
        ordered.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("rank").alias("serial"), F.expr(f"before div {shard_bytes}").alias("shard")), "warc-plan"
    )
    spark = pages.sparkSession
    shards = (placed.agg(F.max("shard")).first()[0] or 0) + 1
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.withColumn("task", F.expr(f"shard * {tasks} div {shards}"))
    first = placed.groupBy("task").agg(F.min(F.struct("page_id", "url", "payload_digest")).alias("k"))
    bounds = sorted((r.task, _order(*r.k)) for r in first.collect())  # a row per task, so at most one per shuffle partition
    # texts travel once: to the tasks in whose range of keys they fall, where they meet their records by sorting
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    texts = pages.select(
        F.col("page_id").cast("long").alias("_p"), F.col("url").cast("string").alias("_u"), F.sha1(F.encode(html, "UTF-8")).alias("_d"), F.octet_length(html).alias("size"), html.alias("html")
    ).mapInArrow(_packing(bounds), "task long, _p long, _u string, _d string, packed binary")
    texts = texts.select("task", F.col("_p").alias("page_id"), F.col("_u").alias("url"), F.col("_d").alias("payload_digest"), "packed")
    mixed = placed.unionByName(texts, allowMissingColumns=True).repartition(tasks, "task").sortWithinPartitions("page_id", "url", "payload_digest", "serial")
    manifest = mixed.mapInArrow(_writing(f"{folder}/data", file_bytes, level), _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def records(data: bytes):
    """(headers, block) of each gzip member of an archive."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        text = unpacker.decompress(view[at:]) + unpacker.flush()
        at = len(data) - len(unpacker.unused_data)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield headers, rest[:size]


_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def _reading(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
    for batch in batches:
        for name, data, size, digest, listed in zip(*[batch.column(c) for c in ("file", "content", "bytes", "sha1", "records")]):
            data = data.as_py()
            if data is None:
                raise ValueError(f"{name} is in the manifest but not in the folder")
            if len(data) != size.as_py() or hashlib.sha1(data).hexdigest() != digest.as_py():
                raise ValueError(f"{name} is not the file of the manifest")
            rows, held, found = [], 0, 0
            for headers, block in records(data):
                found += 1
                digest_of, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                if hashlib.sha1(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha1:") or kind == "response" and hashlib.sha1(block).hexdigest() != digest_of:
                    raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
                number = lambda h: int(headers[h]) if headers.get(h) else None
                rows.append({"page_id": number("X-Page-ID"), "url": headers["WARC-Target-URI"], "payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": digest_of, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "html": block.decode() if kind == "response" else None})
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if found != listed.as_py():
                raise ValueError(f"{name} has {found} records, the manifest says {listed}")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the files that the manifest lists; html is null for revisits.

    Sizes, digests and numbers of records are checked; a difference is an error, and so is
    a file that the manifest lists and the folder lacks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    columns = ["file", "content", "bytes", "sha1", "records"]
    lacking = manifest.join(named.select("file"), "file", "left_anti").withColumn("content", F.lit(None).cast("binary"))  # apart, so that contents are not shuffled
    return named.join(manifest, "file").select(*columns).unionByName(lacking.select(*columns)).mapInArrow(_reading, _RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives of `pages` in the shared folder, read back."""
    spark = pages.sparkSession
    folder = checkpoint_folder(spark)
    local = folder.removeprefix("file:")
    folder = f"{'file://' + '/' + local.lstrip('/') if local.startswith('/') else folder}/warc-{uuid.uuid4().hex}"
    return read(spark, folder, write(pages, folder, **options)) if pages.limit(1).count() else spark.createDataFrame([], _RECORDS)
