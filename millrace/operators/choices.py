"""Choice among runs: metric after metric, all within the noise of the best go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walked(metrics: DataFrame, order: list[tuple[str, int, float]], vetoed: DataFrame | None = None, group: str = "arm") -> DataFrame:
    """(group, run, round, metric): the last round that each run was in, and the metric by which it went; null for those that are left.

    metrics: (group, run, metric, value), and all metrics of order for each run; a missing value is worse than any. order: the metrics by rank, each
    with 1 (more is better) or -1 and the band of noise: in its round a run stays if it is within the band of the best that is still there. A
    group with one run left is done. Runs of vetoed (group, run) go in round 0, by `veto`, and are no one's best. Of a group whose runs all
    have a veto none is left. A group's runs, of which each is
    one row by then, come together in one task.
    """
    wide = metrics.groupBy(group, "run").agg(*(F.max(F.when(F.col("metric") == m, F.col("value") * sign)).alias(f"m{k}") for k, (m, sign, _) in enumerate(order)))
    out = F.lit(None).cast("int")
    if vetoed is not None:
        no = vetoed.select(F.col(group).alias("__g"), F.col("run").alias("__r")).distinct()
        wide = wide.join(no, (F.col(group) == F.col("__g")) & (F.col("run") == F.col("__r")), "left")
        out = F.when(F.col("__r").isNotNull(), F.lit(0))
    state = wide.withColumn("out", out)
    own = Window.partitionBy(group)
    # All rounds go over the same groups: one shuffle, as many steps as metrics.
    for k, (_, _, band) in enumerate(order, 1):
        value = F.coalesce(F.col(f"m{k - 1}"), F.lit(float("-inf")))
        here = F.col("out").isNull()
        best = F.max(F.when(here, value)).over(own)
        several = F.sum(here.cast("int")).over(own) > 1
        state = state.withColumn("out", F.when(here & several & (value < best - band), F.lit(k)).otherwise(F.col("out")))
    names = F.array(F.lit("veto"), *(F.lit(m) for m, _, _ in order))
    return state.select(group, "run", F.coalesce("out", F.lit(len(order))).alias("round"), F.get(names, F.col("out")).alias("metric"))


def chosen(walk: DataFrame, group: str = "arm") -> DataFrame:
    """(group, run, tied): of the runs that are left the first by name, and how many there are; null and 0 if none is left."""
    left = walk.where("metric is null").groupBy(group).agg(F.min("run").alias("run"), F.count(F.lit(1)).alias("tied"))
    return walk.select(group).distinct().join(left, group, "left").select(group, "run", F.coalesce("tied", F.lit(0)).alias("tied"))
