"""Counts and components against every cosine; crowded buckets; unusable vectors."""

import numpy as np
import pytest

from weftline.llm import embedding_dups


def brute(rows, threshold=0.95):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units, n = [unit(v) for _, v in rows], len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        before = list(group)
        for i in range(n):
            for j in near[i]:
                group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[group[i]] = min(key, least.get(group[i], key))
    return sorted(((key, len(near[i]), least.get(group[i], key)) for i, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [512, 8])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for size in (40, 12, 5, 1, 1, 1):
        centre = rng.normal(size=24)
        rows += [(centre + rng.normal(size=24) * 0.1).tolist() for _ in range(size)]
    rows += [rows[0]] * 7 + [(np.array(rows[50]) * 3).tolist()]
    rows += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [3.0]]
    rows = list(enumerate(rows)) + [(None, rows[1]), (3, rows[2]), (None, None)]
    frame = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, rep string")
    got = embedding_dups.near_duplicates(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert embedding_dups.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_near_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.952 * a + np.sqrt(1 - 0.952**2) * side
    one = embedding_dups.bucket_codes(a, embedding_dups.TABLES, 2, embedding_dups.PROBES, 4)
    two = embedding_dups.bucket_codes(b, embedding_dups.TABLES, 2, embedding_dups.PROBES, 4)
    met = (one[:, :, None] == two[:, None, :]).any(axis=(1, 2))
    assert met.mean() > 0.99
