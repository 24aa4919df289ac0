"""The trie against a plain one, with bursts forced by small containers."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from weftline.llm import burst_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, path long, up string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def rows():
    rng, out = random.Random(3), []
    for conv in list(range(0, 60)) + list(range(300, 420)) + [-150, -100, 777]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é漢", "", None, "long " * 30]), "x", 1, "y"))
    for conv in range(1000, 1090):  # one conversation, again and again
        out += [(conv, turn, "user", f"same {turn}", "x", 1, "y") for turn in range(12)]
    out += [(500, None, "user", "first", "x", 1, "y"), (500, 0, "user", "second", "x", 1, "y"), (500, 0, "user", "second", "x", 1, "y"), (500, 0, "bot", "tie", "x", 1, "y")]
    out += [(None, 0, "user", "nobody's", "x", 1, "y"), (600, 0, None, None, None, None, None)]
    out += [(2000, turn, "user", f"deep {turn}", "x", 1, "y") for turn in range(300)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("cap", [1, 3, 50, burst_trie.CAP])
def test_trie(spark, cap):
    data = rows()
    trie = burst_trie.prefix_trie(spark.createDataFrame(data, SCHEMA), cap)
    assert got(trie) == plain(data)


def test_edges(spark):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert got(burst_trie.prefix_trie(frame([]))) == []
    single = [(100, None, None, None, None, None, None)]
    assert got(burst_trie.prefix_trie(frame(single))) == plain(single)
    absent = [(c, t, "u", "t", None, None, None) for c in (101, 102, 103, 104, 105) for t in range(2)]  # no conversation 100: some end up without turns
    assert got(burst_trie.prefix_trie(frame(absent), 1)) == plain(absent)
