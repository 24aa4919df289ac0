"""Seeds, tolerance and odd rows against a plain search over all diagonals."""

import random

from weftline.llm import decontaminate as d
from tests.llm.test_pipeline import words

ITEM, DOC = "item_id long, text string, th long", "doc_id long, text string, item_id string"


def plain(text, items):
    """{item: best score} over diagonals on which a mask or a short item meets."""
    mine, out = words(text), {}
    for key, raw in items:
        item = words(raw)
        if len(item) < d.SHORTEST:
            continue
        shapes = [[i for i, b in enumerate(m) if b == "1"] for m in d.MASKS]
        span = len(d.MASKS[0])
        if len(item) < span:
            shapes, span = [list(range(len(item)))], len(item)
        for at in range(len(mine) - span + 1):
            for start in range(len(item) - span + 1):
                if any(all(mine[at + o] == item[start + o] for o in s) for s in shapes):
                    diagonal, best, now = at - start, 0, 0
                    for i in range(max(0, -diagonal), min(len(item), len(mine) - diagonal)):
                        now = max(0, now + (1 if item[i] == mine[i + diagonal] else -d.PENALTY))
                        best = max(best, now)
                    if best >= min(d.LEAST, len(item)):
                        out[key] = max(best, out.get(key, 0))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(say(n))) for i, n in enumerate((40, 25, 15, 12, 11, 7, 5, 4, 1))] + [(9, None), (10, ""), (11, "a a a a a a a a a a a a a a"), (0, " ".join(say(20)))]
    items.append(items[2])
    docs = []
    for _, text in items[:9]:
        part = text.split()
        for changes in (0, 1, 2, 4):
            copy = list(part)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = "changed"
            docs.append(" ".join(say(rng.randint(0, 30)) + copy + say(rng.randint(0, 30))))
        docs.append(" ".join(part[: len(part) // 2]))
    docs += [None, "", " \n", "a " * 40, " ".join(say(3000)) + "\n" + items[1][1].upper() + "\t" + " ".join(say(3000)), items[12][1]]
    return [(i, t) for i, t in enumerate(docs)] + [(None, items[0][1]), (0, docs[0]), (0, "other words")], items


def test_matches_plain_search(spark, monkeypatch):
    docs, items = cases()
    rows, bank = spark.createDataFrame([(*r, "x") for r in docs], DOC), spark.createDataFrame([(*r, 1) for r in items], ITEM)
    want = {}
    for key, text in docs:
        for item, score in plain(text, items).items():
            want[key, item] = max(score, want.get((key, item), 0))
    for at_once in (10**6, 37):  # one block of seeds, and many
        monkeypatch.setattr(d, "SEEDS_AT_ONCE", at_once)
        got = {}
        for r in d.overlaps(rows, bank).collect():
            got[r.doc_id, r.item_id] = max(r.words, got.get((r.doc_id, r.item_id), 0))
        assert got == want
    clean = sorted([(k, t) for k, t in docs if not plain(t, items)], key=repr)
    assert sorted(((r.doc_id, r.text) for r in d.remove(rows, bank).collect()), key=repr) == clean


def test_empty_tables(spark):
    docs, items = cases()
    rows, bank = spark.createDataFrame([(*r, "x") for r in docs], DOC), spark.createDataFrame([(*r, 1) for r in items], ITEM)
    assert d.remove(rows, bank.limit(0)).count() == len(docs)
    assert d.remove(rows.limit(0), bank).count() == 0
