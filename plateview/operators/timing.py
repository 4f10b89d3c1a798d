"""Throughput of jobs: a row per run, with what was read and what came out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from plateview.sources.scratch import measured_bytes

RUNS = "job string, run int, seconds double, rows long, rows_per_second double, input_bytes long"


def run(table: DataFrame) -> int:
    """Compute every row and column of the table, keeping nothing; the number of rows, observed on the way."""
    seen = Observation()
    table.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return int(seen.get["rows"])


def timed_runs(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], inputs: Iterable[DataFrame] = (), repeats: int = 1) -> DataFrame:
    """Each job ``repeats`` times, as a table of ``RUNS``.

    A job is a function that builds its result, for the small jobs that run while a result is built are part of its
    cost. ``inputs`` are the tables that the jobs read; their bytes relate the figures to the size of the data.
    """
    size = sum(measured_bytes(table) for table in inputs)
    rows = []
    for name, build in jobs.items():
        for i in range(repeats):
            began = time.perf_counter()
            n = run(build())
            took = time.perf_counter() - began
            rows.append((name, i, took, n, n / took, size))
    return spark.createDataFrame(rows, RUNS)
