"""Measures of a run: nearest-rank percentiles and timed queries."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nearest_rank(values: Column, q: float) -> Column:
    """The value at place round((n - 1) * q) of a sorted array, halves to even; of none 0."""
    n = F.size(values)
    at = F.least(n, F.bround((n - 1) * q, 0).cast("int") + 1)
    return F.when(n > 0, F.try_element_at(F.array_sort(values), at)).otherwise(F.lit(0.0))


def latency_report(runs: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """(by, n, mean, p50, p95, p99) of timings; p50 is the median between the middle two, the others are nearest ranks. Without a timing n is 0 and ranks are 0.

    A group is sorted, not held as an array: each rank is the value at its place.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    number = F.count(value).over(Window.partitionBy(*by))
    rows = runs.withColumns({"_place": place, "_number": number})
    at = lambda q: F.coalesce(F.max(F.when(F.col("_place") == F.bround((F.col("_number") - 1) * q, 0).cast("int") + 1, F.col(value))), F.lit(0.0))
    middle = F.avg(F.when((F.col("_place") == F.floor((F.col("_number") + 1) / 2)) | (F.col("_place") == F.ceil((F.col("_number") + 1) / 2)), F.col(value)))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), middle.alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def timed(spark: SparkSession, cases: dict[str, Callable[[], DataFrame]], iterations: int = 5) -> DataFrame:
    """(case, iteration, rows, latency_ms) of counting each case's result."""
    out = []
    for name, case in cases.items():
        for i in range(iterations):
            began = time.perf_counter()
            rows = case().count()
            out.append((name, i, rows, (time.perf_counter() - began) * 1000.0))
    return spark.createDataFrame(out, "case string, iteration int, rows long, latency_ms double")


def random_windows(bounds: tuple[float, float, float, float], n: int, share: float = 0.08, seed: int = 7) -> list[tuple[float, float, float, float]]:
    """``n`` seeded boxes inside ``bounds``, each ``share`` of it a side."""
    low, high = np.array(bounds[:2]), np.array(bounds[2:])
    side = (high - low) * share
    corners = low + np.random.default_rng(seed).random((n, 2)) * (high - low - side)
    return [(*map(float, c), *map(float, c + side)) for c in corners]


def grid_roads(spark: SparkSession, n: int) -> DataFrame:
    """``n`` short synthetic roads on a grid a hundred wide."""
    lon = F.lit(116.0) + F.pmod("id", F.lit(100)) * 0.001
    lat = F.lit(39.0) + F.floor(F.col("id") / 100) * 0.001
    line = F.array(F.struct(lon.alias("lon"), lat.alias("lat")), F.struct((lon + 0.0008).alias("lon"), (lat + 0.0002).alias("lat")))
    return spark.range(n).select(F.format_string("road_%d", "id").alias("id"), line.alias("geometry"), F.col("id").alias("pos"))


def markdown(rows: DataFrame) -> str:
    """A small report as a Markdown table."""
    cells = [list(map(str, r)) for r in rows.collect()]
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(c) + " |" for c in cells)])
