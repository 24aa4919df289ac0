"""Shared helpers of the corpus operators."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from weftline.llm import common


@pytest.mark.parametrize("kinds", [1, 2])
def test_counters_travel_in_blocks(spark, monkeypatch, kinds):
    rng = np.random.default_rng(kinds)
    shares = rng.integers(0, 5, (4, kinds, 1 << 14)) + (np.int64(1) << 40)
    shares[:, :, 4096:8192] = 0  # an empty block

    def rows(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield common.counter_batch(r for kind in range(kinds) for r in common.counter_rows(shares[i, kind], kind))

    brought = []
    for name in ("collect", "toPandas"):
        true = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, true=true: brought.append(out := true(self)) or out)
    got = common.total_counters(spark.range(0, 4, 1, 4).mapInArrow(rows, common.COUNTERS), kinds, 14)
    assert (got == shares.sum(axis=0)).all()
    assert sum(map(len, brought)) <= kinds * 4  # once a row per counter


def test_no_counters(spark):
    assert not common.total_counters(spark.createDataFrame([], common.COUNTERS), 2, 14).any()
