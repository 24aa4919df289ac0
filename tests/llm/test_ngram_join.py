"""Links and components against every pair, with groups, levels and empty rows."""

import random
import re
from itertools import combinations

import pytest

from weftline.llm import ngram_join

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(sets[i]), least.get(find(i), key)) for i, (key, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 20, 28, 40, 70, 130, 300]))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            cut = rng.randint(0, len(copy) // 6)
            rows.append(" ".join(copy[cut:]))
    rows += [" ".join(rng.choices(vocabulary, k=k) + passage) for k in (0, 3, 8, 12, 15, 18, 25, 60)]
    rows += ["", None, " \n ", "a b", "A\tb", "a b c d", "é É", "one two three four five", rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[1]), (3, "a b c d"), (None, None)]


@pytest.mark.parametrize("seed,frequent", [(1, 64), (2, 1), (3, 3)])
def test_components_match_all_pairs(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)  # low values bring combinations into play
    monkeypatch.setattr(ngram_join, "STEP", 4)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA + ", component_id string")
    got = ngram_join.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table_and_one_of_each_group(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.jaccard_join(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1), (2, text + " end", 2), (2, text + " end", 3), (None, text, 4), (7, "", 5), (7, "", 6), (None, None, 7), (9, "other words", 8)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA + ", _key long")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(2, text + " end"), (7, ""), (7, ""), (9, "other words")]
    assert [(r.text, r._key) for r in kept if r.doc_id is None] == [(None, 7)]


def test_frequent_prefixes_share_a_combination():
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (24, 31, 33, 47, 64, 100, 127, 200):
        for _ in range(30):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            lost = rng.integers(0, size // 8 + 1)
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, lost).astype(np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            count = lambda s: (s % np.uint64(997)).astype(np.int64)
            one, _ = ngram_join.signatures(a, count(a), (50, 600), 75, 100)
            two, _ = ngram_join.signatures(b, count(b), (50, 600), 75, 100)
            assert len(np.intersect1d(one, two))


def test_large_group_of_near_copies_is_not_paired_member_by_member(spark, monkeypatch):
    """Copies with up to nine words replaced; those with most link with nothing."""
    rng, size = random.Random(7), 240
    base = [f"w{i}" for i in range(146)]
    rows = []
    for i in range(size):
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.choice([1, 2, 3, 6, 7, 8, 9])):
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy)))
    compared, compare = [], ngram_join._compare

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_compare", counted)
    monkeypatch.setattr(ngram_join, "CROWDED", 100, raising=False)
    monkeypatch.setattr(ngram_join, "FREQUENT", 16)
    found = ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    assert sum(compared) < 10 * size


@pytest.mark.parametrize("crowded", [0, 20])
def test_crowded_sets_lose_no_link(spark, monkeypatch, crowded):
    """Few pivots tried, so that stars of crowded and of other sets stay open."""
    rng = random.Random(11)
    rows = corpus(5)
    for length in (40, 90):
        base = [f"b{length}w{i}" for i in range(length)]
        for _ in range(40):
            copy = list(base)
            for at in rng.sample(range(length), rng.randint(0, length // 18)):
                copy[at] = f"z{rng.randrange(6)}"
            rows.append((1000 + len(rows), " ".join(copy[rng.randint(0, length // 9):])))
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "CROWDED", crowded, raising=False)
    found = ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
