"""Intervals and exact tests."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, exp, lgamma, log, log1p, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share k of n; (0, 1) for n = 0."""
    p, zz = k / n, F.lit(z * z)
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def noise(n: Column, p: float = 0.05) -> Column:
    """What a share may differ by chance: two deviations; nothing from 1,000 rows on."""
    return F.when(n >= 1000, 0.0).otherwise(2 * F.sqrt(F.lit(p * (1 - p)) / n))


def tail(n: int, k: int) -> float:
    """The chance of k or fewer of n even moves, for k up to n / 2.

    The largest term comes from Stirling's series and deviances, which lose no digits for large n; the others follow from it by their ratios.
    Ten roots of n terms are all that count.
    """
    if n <= 500:
        return sum(comb(n, i) for i in range(k + 1)) / 2**n
    rest = lambda x: (1 / 12 - (1 / 360 - 1 / 1260 / x**2) / x**2) / x
    off = lambda x: x * log1p((x - n / 2) / (n / 2)) - (x - n / 2)
    if k < 16:  # under 1e-100
        most = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2))
    else:
        most = exp(rest(n) - rest(k) - rest(n - k) - off(k) - off(n - k)) * sqrt(n / (2 * pi * k * (n - k)))
    i = np.arange(k, max(k - int(10 * sqrt(n)) - 50, 0), -1, dtype=np.float64)
    return most * (1 + float(np.cumprod(i / (n - i + 1)).sum()))


@F.pandas_udf(DoubleType())
def sign_p(a: pd.Series, b: pd.Series) -> pd.Series:
    """Two-sided exact test that a and b moves are equally likely. McNemar's exact test is the same."""
    return pd.Series([min(1.0, 2 * tail(int(x + y), int(min(x, y)))) for x, y in zip(a, b, strict=True)])


def bootstrap_ratio(clusters: DataFrame, groups: list[str], top: str, bottom: str, cluster: str, reps: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(groups, ratio, low, high): the ratio of sums of top and bottom, with bounds from resampled clusters.

    clusters has one row for each group and cluster. Each takes part in each repetition as often as a Poisson number of mean 1 says, drawn
    from a hash of the cluster's name, so that the result is the same wherever a row is computed. Tasks send sums of repetitions on.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(groups))), strict=True))
            for key, seed, x, y in zip(names, *(batch.column(len(groups) + i).to_pylist() for i in range(3)), strict=True):
                weight = np.random.default_rng(seed % (1 << 63)).poisson(1.0, reps)
                own = sums.setdefault(key, np.zeros((2, reps)))
                own[0] += weight * (x or 0.0)
                own[1] += weight * (y or 0.0)
        for key, (x, y) in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * reps) for k in key), pa.array(range(reps), pa.int32()), pa.array(x), pa.array(y)], [*groups, "rep", "x", "y"])

    if not groups:
        return bootstrap_ratio(clusters.withColumn("all", F.lit("all")), ["all"], top, bottom, cluster, reps, alpha)
    keyed = clusters.select(*(F.col(g).cast("string") for g in groups), F.xxhash64(F.col(cluster).cast("string")), F.col(top).cast("double"), F.col(bottom).cast("double"))
    fields = ", ".join([*(f"{g} string" for g in groups), "rep int", "x double", "y double"])
    drawn = keyed.mapInArrow(draw, fields).groupBy(*groups, "rep").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("y <> 0")
    ends = drawn.groupBy(*groups).agg(F.sort_array(F.collect_list(F.col("x") / F.col("y"))).alias("v"))
    at = lambda q: F.get("v", F.least((F.lit(q) * F.size("v")).cast("int"), F.size("v") - 1))
    point = clusters.groupBy(*(F.col(g).cast("string").alias(g) for g in groups)).agg((F.sum(top) / F.sum(bottom)).alias("ratio"))
    bounds = ends.select(*groups, at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))
    return point.join(bounds, groups, "left")
