"""Round trips, revisits, rolling and repeated bytes; damaged files are noticed."""

import glob
import hashlib
import os
import tempfile

import pytest

from weftline.llm import warc

SCHEMA = "page_id long, url string, html string, file string"


def pages():
    long, other = "<p>" + "ä" * 700 + "</p>", "<i>" + "b" * 3000 + "</i>"
    rows = [(i, f"http://h.example/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(60)]
    rows += [(100, "u", long), (7, "u2", long), (55, "x\r\ny: z", long), (101, "u", other), (101, "v", other), (102, None, None), (103, "", ""), (None, "n", other), (None, None, long)]
    rows += [rows[3], rows[3], (200, "same", other), (200, "same", other), (201, "t", "a" * 999), (202, "t", "a" * 999), (203, "nul\x00", "\x00\r\n\r\nWARC/1.1\r\n")]
    return rows


def expected(rows):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            groups[data] = max(page, groups.get(data, page))
    return groups


def test_round_trip(spark):
    rows = pages()
    frame = spark.createDataFrame([(*r, "f") for r in rows], SCHEMA)
    got = warc.round_trip(frame, shard_bytes=20_000, file_bytes=2_000).collect()
    assert len(got) == len(rows)
    want, heads = sorted(((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows), key=repr), expected(rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=repr) == want
    by_digest = {hashlib.sha1(k).hexdigest(): v for k, v in heads.items()}
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to == by_digest[r.payload_digest] and r.html is None
        else:
            assert r.refers_to is None and hashlib.sha1(r.html.encode()).hexdigest() == r.payload_digest
    for digest, head in by_digest.items():
        full = [r for r in got if r.payload_digest == digest and r.record_type == "response"]
        assert [r.page_id for r in full] == [head]


def test_same_bytes_again_and_manifest(spark):
    frame = spark.createDataFrame([(*r, "f") for r in pages()], SCHEMA)
    digests = []
    for parts in (1, 5):
        folder = "file://" + tempfile.mkdtemp(prefix="warc-")
        manifest = warc.write(frame.repartition(parts), folder, shard_bytes=20_000, file_bytes=2_000)
        digests.append(sorted(map(tuple, manifest.collect())))
        assert not glob.glob(folder[7:] + "/data/.*tmp")
    assert digests[0] == digests[1] and len(digests[0]) > 3
    assert len({d[0] for d in digests[0]}) == len(digests[0])
    victim = sorted(glob.glob(folder[7:] + "/data/*.gz"))[0]
    with open(victim, "ab") as out:
        out.write(b"x")
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, folder, manifest).count()
    assert os.path.getsize(victim)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_missing_files_and_records_are_errors(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    manifest = warc.write(spark.createDataFrame([(*r, "f") for r in pages()], SCHEMA), folder, shard_bytes=20_000, file_bytes=2_000)
    assert warc.read(spark, folder, manifest).count() == len(pages())
    with pytest.raises(Exception, match="records, the manifest says"):
        warc.read(spark, folder, manifest.withColumn("records", manifest["records"] + 1)).count()
    rows = manifest.collect()
    lost = spark.createDataFrame([*rows, rows[0].asDict() | {"file": "lost.warc.gz"}], manifest.schema)
    with pytest.raises(Exception, match="not in the folder"):
        warc.read(spark, folder, lost).count()


def test_repeated_rows_over_many_shards(spark, monkeypatch):
    """Records of one key may fill several tasks; each has its text there."""
    monkeypatch.setattr(warc, "MEMO", 3)
    rows = [(5, "small", "s" * 900)] * 300 + [(6, "large", "l" * 5000)] * 300 + [(7, "other", "o" * 5000), (None, None, "n" * 10), (None, "x", None)] * 20
    frame = spark.createDataFrame([(*r, "f") for r in rows], SCHEMA).repartition(6)
    got = warc.round_trip(frame, shard_bytes=20_000, file_bytes=8_000).collect()
    count = lambda page, kind: sum(r.page_id == page and r.record_type == kind for r in got)
    assert len(got) == len(rows) and all(r.html is not None for r in got if r.record_type == "response")
    assert [(count(p, "response"), count(p, "revisit")) for p in (5, 6, 7, None)] == [(300, 0), (1, 299), (1, 19), (40, 0)]
    assert {(r.page_id, r.html) for r in got if r.record_type == "response"} == {(p, h or "") for p, _, h in rows}
