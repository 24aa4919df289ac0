"""Suffix arrays against sorted slices, and removal against plain counting of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import suffix_dedup
from weftline.llm.suffix_dedup import SPAN

SCHEMA = "doc_id long, text string, digest string, id long, anchor long"


def plain(docs):
    texts = [(d[0], (d[1] or "").encode()) for d in docs]
    seen = Counter(t[i:i + SPAN] for _, t in texts for i in range(len(t) - SPAN + 1))
    out = []
    for key, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - SPAN + 1):
            if seen[t[i:i + SPAN]] > 1:
                gone[i:i + SPAN] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((key, len(t), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist()))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, [x for s in r.spans for x in s]) for r in frame.collect()), key=repr)


def prose(rng, n, words="the of and in to é 漢字 whereas notion lightning a".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))


def documents():
    rng = random.Random(13)
    shared, base = prose(rng, 60), prose(rng, 200)
    docs = [(i, prose(rng, rng.randint(0, 120)), "d", 1, 2) for i in range(60)]
    for i in range(60, 110):  # a passage in many contexts, cut at different ends
        a, b = rng.randint(0, 80), rng.randint(0, 80)
        docs.append((i, prose(rng, rng.randint(0, 30)) + shared[a:len(shared) - b] + prose(rng, rng.randint(0, 30)), "d", 1, 2))
    for i in range(110, 150):  # near copies
        words = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"edit{i}"
        docs.append((i, " ".join(words), "d", 1, 2))
    docs += [(150, "x" * 700, "d", 1, 2), (151, "x" * 200 + "y" * 199, "d", 1, 2), (152, "ab" * 400 + prose(rng, 5) + "ba" * 130, "d", 1, 2)]
    docs += [(153, "line one\n" * 200, "d", 1, 2), (154, shared[:100].encode()[:199].decode(errors="ignore"), "d", 1, 2), (155, None, None, None, None), (156, "", "d", 1, 2), (None, base, "d", 1, 2), (None, None, None, None, None)]
    docs += [docs[3]] * 2 + [docs[61]] * 3 + [(200 + i, docs[70][1], "d", 1, 2) for i in range(4)] + [(300, "short", "d", 1, 2)] * 2
    docs.append((400, prose(rng, 30000) + shared + prose(rng, 10), "d", 1, 2))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("limit", [suffix_dedup.LIMIT, 20, 1])
def test_repeats(spark, limit):
    docs = documents()
    assert got(suffix_dedup.repeats(spark.createDataFrame(docs, SCHEMA).repartition(5), limit)) == plain(docs)


def test_no_rows_and_no_repeats(spark):
    assert suffix_dedup.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = [(1, None, None, None, None), (2, "a" * 199, "", 0, 0), (3, prose(random.Random(1), 90), "", 0, 0)]
    assert got(suffix_dedup.repeats(spark.createDataFrame(docs, SCHEMA))) == plain(docs)


@pytest.mark.parametrize("alphabet", [1, 2, 4, 256])
def test_suffix_order(alphabet):
    rng = np.random.default_rng(alphabet)
    for size in (1, 2, 300, 3000):
        raw = rng.integers(0, alphabet, size).astype(np.uint8) + (97 if alphabet < 200 else 0)
        raw = np.concatenate([raw, raw[: size // 2]]).astype(np.uint8)
        wanted = rng.random(len(raw)) < (0.4 if size > 2 else 1.1)
        wanted[max(0, len(raw) - SPAN):] = False
        order, words = suffix_dedup.suffix_order(raw, wanted)
        whole = raw.tobytes()
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        strings = [whole[i:i + SPAN] for i in order.tolist()]
        assert strings == sorted(strings)
        plain_prefix = [next((k for k in range(SPAN) if a[k] != b[k]), SPAN) for a, b in zip(strings, strings[1:])]
        assert suffix_dedup.common_prefixes(words, order).tolist() == plain_prefix


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    block = rng.integers(97, 101, 1000).astype(np.uint8)
    raw = np.concatenate([rng.integers(97, 101, 500).astype(np.uint8), block, rng.integers(97, 101, 70000).astype(np.uint8), block])
    first, many, anchor = suffix_dedup.anchored_runs(raw, np.array([0, len(raw)]))
    of = np.repeat(anchor, many)
    start = np.concatenate([np.arange(f, f + m) for f, m in zip(first, many)])
    assert start.tolist() == list(range(len(raw) - SPAN + 1)) and many.max() < 256
    assert (of[500:500 + 801] == of[-801:]).all()
