"""Held-out accuracy, exact selection and rows without text or labels."""

import random

import pytest

from weftline.llm import importance

DOC, LABEL = "doc_id long, text string, _weight string", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    common, rude = [f"w{i}" for i in range(500)], ["nasty", "vile"]
    docs, labels = [], []
    for i in range(1500):
        kind = rng.random()
        body = rng.choices(common, k=rng.randint(5, 200))
        if kind < 0.15:
            body = [w + "!!" for w in body]
        elif kind < 0.3:
            for _ in range(3 + len(body) // 20):
                body[rng.randrange(len(body))] = rng.choice(rude)
        docs.append((i, " ".join(body), "x"))
        if i % 2:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    truth = {i for i, t, _ in docs if "!!" not in t and not set(t.split()) & set(rude)}
    docs += [(None, "w1 w2 w3", "x"), (2000, None, "x"), (2001, "", "x"), (2002, " \n", "x"), (2003, "W1 " * 20000, "x"), docs[2], docs[2]]
    labels += [(None, 1, 0), (1, 0, 0), (7777, 1, 0), (3, None, None)]
    return docs, labels, truth


def test_unlabelled_documents(spark, corpus):
    docs, labels, truth = corpus
    out = importance.resample(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL))
    assert out.columns == ["doc_id", "text", "_weight"]
    kept = [r.doc_id for r in out.collect()]
    unlabelled = [i for i in range(0, 1500, 2)]
    assert len([i for i in unlabelled if i in truth and i in kept]) >= 0.97 * len([i for i in unlabelled if i in truth])
    assert len([i for i in unlabelled if i not in truth and i in kept]) <= 0.05 * len([i for i in unlabelled if i not in truth])
    assert {None, 2000, 2001, 2002, 2003} <= set(kept) and kept.count(2) in (0, 3)


def test_selection_is_the_k_largest_draws(spark, corpus):
    docs, labels, _ = corpus
    out, weight, draw, least = importance.weighted(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL))
    rows = out.collect()
    assert weight == "__weight"
    draws = sorted((r[draw] for r in rows), reverse=True)
    k = sum(d >= least for d in draws)
    assert draws[k - 1] == least and 0 < k < len(rows)
    again = importance.kept_rows(spark.createDataFrame(docs[::-1], DOC), spark.createDataFrame(labels[::-1], LABEL)).collect()
    assert sorted((r.doc_id for r in again), key=repr) == sorted((r.doc_id for r in rows if r[draw] >= least), key=repr)


def test_level_misses_few_good_documents(spark, monkeypatch):
    """Good documents with some evidence against them stay, as held-out ones of their kind do."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1200):
        body, good = [f"w{rng.randrange(300)}" for _ in range(60)], i % 4 != 0
        body += ["edge"] if rng.random() < (0.1 if good else 0.9) else []
        docs.append((i, " ".join(body + (["bad"] * 5 + ["worse", "worst", "awful"] if not good else [])), "x"))
        if i % 8 < 6:
            labels.append((i, int(good), 0))
    kept = {r.doc_id for r in importance.resample(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()}
    fine = [i for i in range(1200) if i % 4]
    assert len([i for i in fine if i in kept]) >= 0.98 * len(fine) and not [i for i in range(0, 1200, 4) if i in kept]


def test_nothing_known(spark, corpus):
    docs, labels, _ = corpus
    frame, empty = spark.createDataFrame(docs[:30] + docs[-7:], DOC), spark.createDataFrame([], LABEL)
    assert importance.resample(frame, empty).count() == 37
    assert importance.resample(frame.limit(0), spark.createDataFrame(labels, LABEL)).count() == 0


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 7.0, -3.5, rng.gauss(0, 1e-9)]) for _ in range(4000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 1000, 2500, 4000):
        assert importance.kth_largest(frame, "v", k) == ordered[k - 1]
    assert importance.kth_largest(frame, "v", 4001) == float("-inf")
