"""Collocations against plain counting, with samples that propose too little and tables that are too small."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from weftline.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, k int, n long"


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain(docs, least=10, top=2000):
    f = defaultdict(Counter)
    for _, text, lang, *_ in docs:
        for words in pieces(text):
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        wanted = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in wanted.items():
            if any(len(q) > len(p) and 100 * c >= 50 * a and p in (q[:2], q[1:]) for q, c in wanted.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def documents():
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta", "é", "ß漢", "x\x00y", "nb sp", "rare", "İ"]
    docs = []
    for i in range(300):
        words = [rng.choice(vocabulary[: 4 + i % 7]) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]) for w in words)
        docs.append((i, text, rng.choice(["en", "en", "en", "de", None, "und", ""]), "p", 1, 2))
    docs += [docs[4]] * 30  # repeated rows count
    docs += [(None, None, None, None, None, None), (1, "", "en", None, None, None), (2, "hot hot hot " * 20000, "en", None, None, None), (3, " .,", "only", None, None, None)]
    return docs


@pytest.mark.parametrize("proposing", [{}, {"sample": 10**6}, {"sample": 1, "lowered": 1}, {"sample": 3, "lowered": 4, "max_bits": 1 << 15}])
def test_collocations(spark, proposing):
    docs = documents()
    got = collocations.collocations(spark.createDataFrame(docs, SCHEMA), **proposing)
    assert sorted(map(tuple, got.collect())) == plain(docs)


def test_top_and_empty(spark):
    docs = documents()
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(docs, SCHEMA), top=3).collect())) == plain(docs, top=3)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)).count() == 0


def test_tokens_of_sliced_array():
    text = pa.array(["skip this", "A b.c", None, "", "d\te\nf", "g"])[1:]
    words, row, onward = collocations.tokens(text)
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f", "g"]
    assert row.tolist() == [0, 0, 0, 3, 3, 3, 4]
    assert onward.tolist() == [True, False, False, True, False, False, False]


def test_two_passes_whatever_the_sample_misses(spark, monkeypatch):
    calls, counts = [], collocations._counts
    monkeypatch.setattr(collocations, "_counts", lambda *args, **named: calls.append(named) or counts(*args, **named))
    docs = documents()
    got = collocations.collocations(spark.createDataFrame(docs, SCHEMA), sample=10**6)
    assert sorted(map(tuple, got.collect())) == plain(docs)
    assert len(calls) == 3  # the sample and two passes
