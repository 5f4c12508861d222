"""Counters and bucketed histograms of a run, gathered while the data flows."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Upper bounds of the buckets, in seconds.
STAGE_BUCKETS = [0.05, 0.1, 0.5, 1, 5, 10, 30, 60, 300]
TOOL_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1, 5, 10]


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the aggregates once df has been computed by an action."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """le, n: how many values are at most each bound (cumulative); the last bound is infinite."""
    each = df.agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate([*bounds, float("inf")])])
    rows = F.arrays_zip(F.array(*[F.lit(float(b)) for b in [*bounds, float("inf")]]).alias("le"), F.array(*[F.col(f"b{i}") for i in range(len(bounds) + 1)]).alias("n"))
    return each.select(F.explode(rows).alias("x")).select(F.col("x.le").alias("le"), F.col("x.n").alias("n"))


class Timers:
    """Seconds per stage, as rows for `histogram`."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - start))
