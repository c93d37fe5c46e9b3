"""Counts by class, shares, floors and quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_shares(df: DataFrame, group: list[str], value: str, tops: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(group, rows, distinct, singletons, top_k...): how concentrated the values of each group are."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value)))
    share = lambda c: F.sum(c) / F.sum("n")
    return best.groupBy(*group).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), (F.sum((F.col("n") == 1).cast("int")) / F.count(F.lit(1))).alias("singletons"), *(share(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)).alias(f"top_{k}") for k in tops))


def floors(counts: DataFrame, value: str, low: int, high: int, floor: int) -> DataFrame:
    """(value, n, ok) for every value from low to high. A value without rows has none and fails."""
    spark = counts.sparkSession
    domain = spark.range(low, high + 1).select(F.col("id").cast("int").alias(value))
    dense = domain.join(counts.groupBy(value).agg(F.sum("n").alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))
    return dense.withColumn("ok", F.col("n") >= floor)


def distance(have: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(distance): half the sum of differences of two tables of counts (key, n), as shares."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.sum("n").alias("total"))
        return df.groupBy(key).agg(F.sum("n").alias("n")).join(F.broadcast(total)).select(key, (F.col("n") / F.col("total")).alias(name))

    both = shares(have, "x").join(shares(target, "y"), key, "full")
    return both.agg((F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))) / 2).alias("distance"))


def order_statistic(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, names...): for each share q the value at place int(q * n) of the sorted ones; the last one at most.

    Equal values are counted first, so a group's places are found from the running counts of its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*group)
    upto = counts.withColumn("upto", F.sum("c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(own))
    place = {name: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1) for name, q in shares.items()}
    return upto.groupBy(*group).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > at, F.col(value))).alias(name) for name, at in place.items()))


def distinct_grams(tokens: DataFrame, group: list[str], column: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(group, distinct_k...): the share of distinct ones among all k-grams of each group's token arrays."""
    from ..functions.text import grams

    parts = []
    for k in sizes:
        counts = tokens.select(*group, F.explode(F.transform(grams(column, k), lambda g: F.xxhash64(g))).alias("g")).groupBy(*group, "g").agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.groupBy(*group).agg((F.count(F.lit(1)) / F.sum("n")).alias(f"distinct_{k}")))
    return reduce(lambda a, b: a.join(b, group, "full"), parts)


def share_bands(df: DataFrame, field: str, caps: float, margin: Column) -> DataFrame:
    """(value, n, share, ok): no value of a field has more than a share of the rows, with a margin for few rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.col("total") <= caps + margin).alias("ok"))


def synthetic_room(real: Column, bar: int, share: float) -> Column:
    """Synthetic rows that a class may have: by its share of the real ones, or what lacks to the bar, with four more."""
    return F.greatest(F.floor(real * share / (1 - share)), F.lit(bar) - real + 4, F.lit(0))


def value_fill(real: Column, made: Column, floor: int) -> Column:
    """Synthetic rows of a value that count towards its floor."""
    return F.least(made, F.greatest(F.lit(0), F.lit(floor) - real))
