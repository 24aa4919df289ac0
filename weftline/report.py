"""Figures of a run that come with the writes it makes anyway.

A report hangs aggregates on tables as they are written, so no figure costs a pass of its
own; they are read once the writes are done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Report:
    """Collects (metric, value); of a metric that is seen more than once the last value counts."""

    def __init__(self):
        self._found: list[dict | Observation] = []

    def watch(self, df: DataFrame, /, **measures: Column) -> DataFrame:
        """df with measures that its next write takes along; the write must read all of it."""
        seen = Observation()
        self._found.append(seen)
        return df.observe(seen, *[column.alias(name) for name, column in measures.items()])

    def note(self, /, **values: float) -> None:
        """Figures that the driver knows."""
        self._found.append(values)

    def values(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for found in self._found:
            for name, value in (found if isinstance(found, dict) else found.get).items():
                out[name] = float(value or 0)
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.values().items()), "metric string, value double")


def watched(report: Report | None, df: DataFrame, /, **measures: Column) -> DataFrame:
    """df as it is, or watched if there is a report."""
    return df if report is None else report.watch(df, **measures)
