"""Every stage against a plain version on the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from weftline.llm import decontaminate


@pytest.fixture(scope="module")
def stages(spark, sf):
    from weftline.session import materialise

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, sf), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_quality_keeps_good_and_rejects_bad(spark, sf, stages):
    before, after = stages[0]
    assert after.columns == before.columns and set(rows_of(after)) <= set(rows_of(before))
    kept = {r.doc_id for r in after.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and not r.toxic]
    assert len([d for d in good if d in kept]) >= 0.97 * len(good)
    written = [r.doc_id for r in before.collect() if not re.search(r"!!|[*]{3}|&&&|%%%|[$]{3}|###| [|] |idiot|moron|clown|scum|worthless|pathetic|stupid|disgusting", r.text)]
    assert len([d for d in written if d in kept]) >= 0.95 * len(written)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, _, c in groups if k == c)
    assert set(rows_of(after)) <= set(rows_of(before))


def words(text):
    return [w for w in re.split(r"[\x09-\x0D\x20]+", (text or "").lower()) if w]


def contaminated(text, items):
    mine = words(text)
    for item in items:
        for d in range(1 - len(item), len(mine)):
            best = now = hits = 0
            span = range(max(0, -d), min(len(item), len(mine) - d))
            same = [item[i] == mine[i + d] for i in span]
            if sum(same) < min(8, len(item)):
                continue
            for s in same:
                now = max(0, now + (1 if s else -decontaminate.PENALTY))
                best = max(best, now)
            if best >= decontaminate.LEAST:
                return True
    return False


def test_benchmark_passages_go(spark, sf, stages):
    before, after = stages[2]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    assert {r.doc_id for r in before.collect() if not contaminated(r.text, items)} == kept


def water(nodes, budget):
    """{name: (weight, capacity)} -> whole budgets."""
    open_, out, left = dict(nodes), {}, budget
    for name, (weight, capacity) in sorted(nodes.items(), key=lambda x: (x[1][1] / x[1][0], x[0])):
        total = sum(w for w, _ in open_.values())
        if capacity * total > left * weight:
            return out | {n: left * w // total for n, (w, _) in open_.items()}
        out[name], left = capacity, left - capacity
        del open_[name]
    return out


def test_mixture(stages):
    before, after = stages[3]
    docs = [(r.doc_id, r.source[:4], r.lang, r.source, len(words(r.text)), r.text) for r in before.collect()]
    leaf = defaultdict(int)
    for _, d, l, s, n, _ in docs:
        leaf[d, l, s] += n
    total = sum(leaf.values()) * 9 // 10
    sums = lambda depth: {p: sum(n for k, n in leaf.items() if k[:depth] == p) for p in {k[:depth] for k in leaf}}
    given = {(): total}
    for depth in (1, 2, 3):
        caps, nxt = sums(depth), {}
        for parent, budget in given.items():
            kids = {p: (corpus_pipeline.LANGUAGES["lang"].get(p[1], 1) if depth == 2 else 1, c) for p, c in caps.items() if p[:-1] == parent}
            nxt |= water(kids, budget)
        given = nxt
    want = []
    for path, budget in given.items():
        whole, rest, run = budget // leaf[path], budget % leaf[path], 0
        mine = [x for x in docs if x[1:4] == path]
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        for h, n, doc in sorted((md5(f"9:{whole}:{x[0]}:{md5(x[5] or '')}"), x[4], x[0]) for x in mine):
            run += n
            want += [doc] * (whole + (rest > 0 and run <= rest))
    assert sorted(r.doc_id for r in after.collect()) == sorted(want) and len(want) < len(docs)


def test_shards(stages):
    before, after = stages[4]
    rows = sorted((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in before.collect())
    total, ahead, seen, want = sum(r[2] for r in rows), 0, defaultdict(int), []
    for doc, crc, size in rows:
        shard = min(39, (2 * ahead + size) * 40 // (2 * total))
        want.append((doc, size, crc, "bytes", shard, seen[shard], None))
        seen[shard], ahead = seen[shard] + 1, ahead + size
    assert rows_of(after) == sorted(want, key=repr)


def test_run_gives_the_last_stage(spark, sf, stages):
    assert rows_of(corpus_pipeline.run(spark, sf)) == rows_of(stages[-1][1])


def folder_of(tmp_path, sf, docs):
    import os

    for name in ("labels", "benchmark"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_run_on_an_empty_table(spark, sf, stages, tmp_path):
    folder = folder_of(tmp_path, sf, stages[0][0].limit(0))
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and out.columns == stages[-1][1].columns


def test_run_with_nulls_repeats_and_clashing_columns(spark, sf, stages, tmp_path):
    """Null and empty texts, null keys and repeated rows pass all stages; extra columns change nothing."""
    from pyspark.sql import functions as F

    docs = stages[0][0]
    some = docs.orderBy("doc_id").limit(60)
    blank = lambda column: some.limit(3).withColumn(column, F.lit(None).cast(some.schema[column].dataType))
    more = [blank(c) for c in docs.columns] + [some.limit(3).withColumn("text", F.lit("")), some.limit(5), some.limit(5)]
    odd = some
    for part in more:
        odd = odd.unionByName(part)
    plain = tmp_path / "plain"
    plain.mkdir()
    clashing = tmp_path / "clashing"
    clashing.mkdir()
    extra = {c: F.lit("x") for c in ("component_id", "n_shingles", "sid", "sig", "size", "shard", "slot", "law", "rid", "th", "label", "quality", "weight", "budget", "_key", "_th", "_id", "item_id")}
    out = corpus_pipeline.run(spark, folder_of(plain, sf, odd.coalesce(1)))
    rows = rows_of(out)
    assert rows == rows_of(corpus_pipeline.run(spark, folder_of(clashing, sf, odd.withColumns(extra).coalesce(1))))
    given = {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    assert {(r.doc_id, r.text_crc32) for r in out.collect()} <= given and 0 < len(rows) < odd.count()
    assert out.columns == stages[-1][1].columns
