"""Byte shards and mixtures on rows with nulls, repeats and one dominant group."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from tests.llm.test_pipeline import water, words
from weftline.llm import mixing, sharding

DOC = "doc_id long, text string, lang string, source string, shard int, _taken int, domain string"


def rows():
    rng = random.Random(6)
    out = []
    for i in range(300):
        source = "s0" if i % 3 == 0 else rng.choice(["s1", "s12", None, "long-name", ""])
        text = rng.choice([None, "", "é " * rng.randint(1, 9), " ".join(["w"] * rng.randint(1, 80)), "x" * rng.randint(1, 400)])
        out.append((i, text, rng.choice(["en", "de", None]), source, 1, 2, "d"))
    return out + [out[5]] * 4 + [(None, "null key", "en", "s1", 1, 2, "d"), (None, None, None, None, 1, 2, "d"), (900, "w " * 30000, "en", "s1", 1, 2, "d")]


def test_shards(spark):
    docs = rows()
    got = sharding.shard_documents(spark.createDataFrame(docs, DOC), 7).collect()
    body = lambda t: (t or "").encode()
    order = sorted(((d[0], zlib.crc32(body(d[1])), len(body(d[1])) + 16) for d in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, ahead, seen, want = sum(r[2] for r in order), 0, Counter(), []
    for key, crc, size in order:
        shard = min(6, (2 * ahead + size) * 7 // (2 * total))
        want.append((key, size, crc, "bytes", shard, seen[shard], None))
        seen[shard] += 1
        ahead += size
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sharding.shard_documents(spark.createDataFrame([], DOC)).count() == 0


def plain_mixture(docs, weights, share, epochs):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    leaf, members = defaultdict(int), defaultdict(list)
    for d in docs:
        path = ((d[3] or "")[:4] if d[3] is not None else None, d[2], d[3])
        leaf[path] += len(words(d[1]))
        members[path].append(d)
    given = {(): sum(leaf.values()) * share[0] // share[1]}
    name = lambda p: tuple((x is not None, x or "") for x in p)
    for depth in (1, 2, 3):
        nxt = {}
        for parent, budget in given.items():
            kids = {p[:depth] for p in leaf if p[:depth - 1] == parent}
            nodes = {name(p): ((weights if depth == 2 else {}).get(p[-1], 1), epochs * sum(n for k, n in leaf.items() if k[:depth] == p)) for p in kids}
            back = {name(p): p for p in kids}
            nxt |= {back[n]: b for n, b in water(nodes, budget).items()}
        given = nxt
    taken = []
    for path, budget in given.items():
        n = leaf[path]
        whole, rest, run = (1, 0, 0) if n == 0 else (budget // n, budget % n, 0)
        mine = sorted((md5(f"9:{whole}:{'' if d[0] is None else d[0]}:{md5(d[1] or '')}"), d) for d in members[path]) if n else [("", d) for d in members[path]]
        by_hash = defaultdict(list)
        for h, d in mine:
            by_hash[h].append(d)
        for h in sorted(by_hash):
            run += sum(len(words(d[1])) for d in by_hash[h])
            taken += [(d[0], d[1], whole + (rest > 0 and run <= rest)) for d in by_hash[h]]
    return Counter(taken)


def test_mixture(spark):
    docs = rows()
    frame = spark.createDataFrame(docs, DOC)
    for share, epochs in (((1, 1), 4), ((1, 3), 1), ((9, 1), 3), ((0, 1), 2)):
        found, name = mixing.chosen(frame, {"lang": {"en": 3, "de": 2}}, share, epochs)
        assert name == "__taken"
        got = Counter((r.doc_id, r.text, r[name]) for r in found.collect())
        assert got == plain_mixture(docs, {"en": 3, "de": 2}, share, epochs)
    made = mixing.mix(frame, {"lang": {"en": 3, "de": 2}}, max_epochs=2)
    assert made.columns == frame.columns
    want = plain_mixture(docs, {"en": 3, "de": 2}, (1, 1), 2)
    assert Counter((r.doc_id, r.text) for r in made.collect()) == Counter({k: n for k in {w[:2] for w in want} if (n := sum(c * w[2] for w, c in want.items() if w[:2] == k))})
    assert mixing.mix(frame.limit(0), {}).count() == 0
